"""Queries of the general training-data operators: name -> function of (spark, sf_dir), and
their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import nested, timestamps
from inkwell.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.found(
        table(spark, sf_dir, "lookup_responses"), table(spark, sf_dir, "priority_claims"), table(spark, sf_dir, "feeds")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.found(table(spark, sf_dir, "raw_records"))


def _typed(state: str) -> Callable[[SparkSession, str], DataFrame]:
    """The typed table of a state, elements given as text included with null columns."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = nested.nodes(table(spark, sf_dir, "raw_records"), "raw_id", "payload")
        whole, bare = nested.variants(rows, state), nested.variants(rows, state, "text")
        both = whole.withColumn("shape", F.lit("object")).unionByName(bare.withColumn("shape", F.lit("text")), allowMissingColumns=True)
        return both.withColumnRenamed("record_key", "raw_id")

    return query


#: A query for each typed table.
TYPED = {f"p5_{s}s" if not s.endswith("y") else f"p5_{s[:-1]}ies": s for s in nested.TYPED_COLUMNS}

# The same grammar walked by DuckDB's JSON functions: a node is opened if it is text that holds
# JSON, an array counts by its elements, a lone value as one.
_MEMBER = "CASE WHEN json_type({v}) = 'OBJECT' THEN {v} -> '$.\"{key}\"' END"
_OPENED = "CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({v} ->> '$', '^\\s*[\\[{{]') AND json_valid({v} ->> '$') THEN CAST({v} ->> '$' AS JSON) ELSE {v} END"
_ELEMENTS = "CASE WHEN {v} IS NULL OR json_type({v}) = 'NULL' THEN [] WHEN json_type({v}) = 'ARRAY' THEN from_json({v}, '[\"JSON\"]') ELSE [{v}] END"


def _walk(rules: list[nested.Rule]) -> str:
    """WITH clauses n_<state>: raw_id, path, parent_path, pos, node of the elements."""
    steps = ["n_root AS (SELECT raw_id, NULL AS path, " + _OPENED.format(v="j") + " AS node FROM (SELECT raw_id, CAST(payload AS JSON) AS j FROM raw_records WHERE json_valid(payload)))"]
    for r in rules:
        source, value = f"n_{r.parent}", "node"
        for i, key in enumerate(r.path.split(".")):
            step = f"s_{r.state}_{i}"
            steps.append(f"{step} AS (SELECT raw_id, path, {_OPENED.format(v='m')} AS node FROM (SELECT raw_id, path, {_MEMBER.format(v=value, key=key)} AS m FROM {source}))")
            source = step
        prefix = f"'{r.path}'" if r.parent == "root" else f"path || '.{r.path}'"
        steps.append(
            f"n_{r.state} AS (SELECT raw_id, {prefix} || '[' || pos || ']' AS path, path AS parent_path, CAST(pos AS INT) AS pos, {_OPENED.format(v='e')} AS node FROM "
            f"(SELECT raw_id, path, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS pos FROM (SELECT raw_id, path, {_ELEMENTS.format(v='node')} AS es FROM {source})) "
            "WHERE e IS NOT NULL AND json_type(e) <> 'NULL')"
        )
    return "WITH " + ", ".join(steps)


def _member_text(key: str) -> str:
    return f"CASE WHEN json_type(node) = 'OBJECT' THEN node ->> '$.\"{key}\"' ELSE {{other}} END"


_LABELS = {r.state: r.label for r in nested.LOOKUP_ANSWER}
_FOUND = " UNION ALL ".join(f"SELECT raw_id, path, {_member_text(label).format(other='''node ->> '$' ''')} AS label FROM n_{s}" for s, label in _LABELS.items())


def _typed_sql(state: str) -> str:
    columns = ", ".join(f"{_member_text(c).format(other='NULL')} AS {c}_value" for c in nested.TYPED_COLUMNS[state])
    label = _member_text(_LABELS[state]).format(other="node ->> '$'")
    shape = "CASE WHEN json_type(node) = 'OBJECT' THEN 'object' ELSE 'text' END"
    return f"{_walk(nested.LOOKUP_ANSWER)} SELECT raw_id, path, parent_path, pos, {label} AS label, {columns}, {shape} AS shape FROM n_{state}"


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, **{name: _typed(state) for name, state in TYPED.items()}}
ORACLE_SQL = {"p5_found": f"{_walk(nested.LOOKUP_ANSWER)} {_FOUND}", **{name: _typed_sql(state) for name, state in TYPED.items()}}
