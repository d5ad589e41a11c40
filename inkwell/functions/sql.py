"""The column expressions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from inkwell.functions import text as tx


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> list[str]:
    """Makes normalize_text, count_words, count_units, alias_key, compact_number,
    confidence_band and is_running_line temporary SQL functions; gives their names."""
    space = tx.SPACE
    normal = f"trim(regexp_replace(regexp_replace(t, {_quoted(rf'\[\d{{4,}}\]{space}*')}, ''), {_quoted(f'{space}+')}, ' '))"
    one = f"trim(regexp_replace(t, {_quoted(f'{space}+')}, ' '))"
    functions = {
        "normalize_text": ("STRING", normal),
        "count_words": ("BIGINT", f"CAST(regexp_count({normal}, {_quoted(tx.LATIN_WORD)}) AS BIGINT)"),
        "count_units": ("BIGINT", f"CAST(regexp_count({normal}, {_quoted(tx.CJK)}) + regexp_count(regexp_replace({normal}, {_quoted(tx.CJK)}, ' '), {_quoted(tx.UNIT_WORD)}) AS BIGINT)"),
        "alias_key": ("STRING", "regexp_replace(upper(t), '[^A-Z0-9]', '')"),
        "compact_number": ("STRING", f"regexp_replace(upper(t), {_quoted(r'[^\p{L}\p{N}]')}, '')"),
        "confidence_band": ("STRING", "CASE WHEN CAST(t AS DOUBLE) >= 80 THEN 'high' WHEN CAST(t AS DOUBLE) >= 50 THEN 'medium' ELSE 'low' END"),
        "is_running_line": ("BOOLEAN", f"{one} RLIKE {_quoted(tx.PATENT_HEADER)} OR {one} RLIKE {_quoted(tx.PAGE_LABEL)}"),
    }
    for name, (kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return list(functions)
