"""A record store on DataFrames: upsert, aliases, lookups, existence, expiry, budgets, merges.

Latest-wins and first-wins use aggregates (max_by, min_by), which combine before the shuffle,
so a key that holds a third of all rows is reduced where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.identifiers import alias_key


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row for each key: that with the greatest `order`."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*rows.columns)


def first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row for each key: that with the smallest `order`."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*rows.columns)


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`existing` with the rows of `incoming` put in their places; on equal `order` the
    incoming row wins."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [*order, "_new"]).drop("_new")


def inserted_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `incoming` whose key `existing` lacks."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def linked(rows: DataFrame, links: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(links.select(*on).distinct(), on, "left_semi")


def unlinked(rows: DataFrame, links: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(links.select(*on).distinct(), on, "left_anti")


def aliases(records: DataFrame, key: str, names: list[str], order: str) -> DataFrame:
    """alias, key: every name of a record as an alias; the first record in `order` keeps it."""
    rows = records.select(key, order, F.explode(F.array(*names)).alias("name")).withColumn("alias", alias_key(F.col("name")))
    return rows.filter(F.coalesce(F.col("alias"), F.lit("")) != "").groupBy("alias").agg(F.min_by(key, F.struct(order, key)).alias(key))


def two_tier(requests: DataFrame, exact: DataFrame, alias: DataFrame, number: str, name: str, key: str) -> DataFrame:
    """`requests` with key and tier: 1 by exact number (exact: number, key), else 2 by the
    alias of `name` (alias: alias, key), else null."""
    one = exact.select(F.col(number), F.col(key).alias("_k1"))
    two = alias.select(F.col("alias").alias("_alias"), F.col(key).alias("_k2"))
    rows = requests.withColumn("_alias", alias_key(F.col(name))).join(one, number, "left").join(two, "_alias", "left")
    tier = F.when(F.col("_k1").isNotNull(), 1).when(F.col("_k2").isNotNull(), 2)
    return rows.withColumn(key, F.coalesce("_k1", "_k2")).withColumn("tier", tier).drop("_k1", "_k2", "_alias")


def filled(value: Column) -> Column:
    """The value, null if it is an empty string or array."""
    return F.when(F.length(value.cast("string")) > 0, value)


def merged(primary: DataFrame, fallback: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of `primary`; each of `columns` falls back where it is null or empty."""
    other = fallback.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    rows = primary.join(other, keys, "left")
    return rows.select(*keys, *(F.coalesce(filled(F.col(c)), filled(F.col(f"_{c}"))).alias(c) for c in columns))


def picked(rows: DataFrame, keys: list[str], rank: Column, order: list[str]) -> DataFrame:
    """One row for each key by priority: the smallest rank, then the smallest `order`."""
    return first(rows.withColumn("_rank", rank), keys, ["_rank", *order]).drop("_rank")


def within_budget(rows: DataFrame, keys: list[str], order: list[str], size: Column, cap: int) -> DataFrame:
    """Adds running (sum of sizes so far) and within (whether that stays within the cap)."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(upto)).withColumn("within", F.col("running") <= cap)


def expired(rows: DataFrame, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    return rows.filter(F.unix_timestamp(F.col(at)) + ttl_seconds <= F.unix_timestamp(now))
