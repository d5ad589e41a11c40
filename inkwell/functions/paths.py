"""Key paths of JSON payloads of any depth, found level by level in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import cut


def key_paths(records: DataFrame, key: str, payload: str) -> DataFrame:
    """key, path, name, kind, value: every member and element of any depth; path is written like
    `a.b[0].c`, kind is the first word of the type, value the text of a scalar. Invalid payloads
    give no rows.

    A level holds the members of the objects and arrays of the one before it and is kept, so a
    payload is parsed once and each value opened once; the work ends at the first empty level."""
    spark = records.sparkSession
    level = records.select(F.col(key).alias("k"), F.lit("").alias("path"), F.lit("").alias("name"), F.try_parse_json(payload).alias("v"))
    kind = F.lower(F.regexp_extract(F.schema_of_variant("v"), r"^(\w+)", 1))
    level = level.filter("v is not null").withColumn("kind", kind)
    out = None
    while out is None or level.limit(1).count():
        below = spark.sql(
            """SELECT l.k, CASE WHEN e.key IS NULL THEN concat(l.path, '[', e.pos, ']') WHEN l.path = '' THEN e.key ELSE concat(l.path, '.', e.key) END AS path,
                coalesce(e.key, l.name) AS name, e.value AS v FROM {level} l, LATERAL variant_explode(l.v) e""",
            level=level.filter(F.col("kind").isin("object", "array")),
        )
        level = cut(below.withColumn("kind", kind))
        out = level if out is None else out.unionByName(level)
    return out.select(F.col("k").alias(key), "path", "name", "kind", F.when(~F.col("kind").isin("object", "array"), F.try_variant_get("v", "$", "string")).alias("value"))


def find_keys(records: DataFrame, key: str, payload: str, names: list[str]) -> DataFrame:
    """Rows of key_paths() whose name is one of `names` in any case."""
    return key_paths(records, key, payload).filter(F.lower("name").isin(*[n.lower() for n in names]))
