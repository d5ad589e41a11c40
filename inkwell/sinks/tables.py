"""Writers of record tables, and deletes that are counted before they happen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.urls import object_path
from inkwell.operators.store import first, linked, unlinked


def saved_documents(existing: DataFrame, incoming: DataFrame, order: str = "saved_at") -> DataFrame:
    """Documents with `incoming` put in: one for each (patent_id, type, strategy, sha256), the
    latest in `order`, with its path in the object store. Needs source, number and filename."""
    keys = ["patent_id", "type", "strategy", "sha256"]
    both = existing.drop("storage_path").withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in keys]
    rows = both.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(order, "_new")).alias("_r")).select(*keys, "_r.*").drop("_new")
    return rows.withColumn("storage_path", object_path(F.col("source"), F.col("number"), F.col("sha256"), F.col("filename")))


def append_events(events: DataFrame, path: str, at: str = "created_at", elapsed: str = "elapsed_ms") -> None:
    """Appends events to a log in folders by day; a negative elapsed time is written as 0."""
    rows = events.withColumn(elapsed, F.greatest(F.col(elapsed), F.lit(0))).withColumn("day", F.to_date(at))
    rows.write.mode("append").partitionBy("day").parquet(path)


def changed(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with the columns of `changes` (at most one row a key) put over them where they
    aren't null; keys that `rows` lacks add nothing."""
    columns = [c for c in changes.columns if c not in keys]
    put = changes.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    both = rows.join(put, keys, "left")
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns), *(F.col(f"_{c}").alias(c) for c in columns if c not in rows.columns))


@dataclass(frozen=True)
class Cleanup:
    """What a clean-up takes away and what it leaves, as plans; counts is one row."""

    kept: dict[str, DataFrame]
    removed: dict[str, DataFrame]
    counts: DataFrame


def unlinked_records(tables: dict[str, DataFrame], links: DataFrame, key: str = "patent_id", size: str = "byte_size") -> Cleanup:
    """`tables` by name, each with `key`, those of the patents under `patents`: rows of patents
    without a link are removed from all of them. counts: patents, linked, targets, documents,
    bytes of the removed documents, and how many of them request files still name."""
    linked_keys = links.filter(F.col(key).isNotNull()).select(key).distinct()
    targets = unlinked(tables["patents"], linked_keys, [key]).select(key)
    kept, removed = {}, {}
    for name, rows in tables.items():
        if key in rows.columns:
            removed[name], kept[name] = linked(rows, targets, [key]), unlinked(rows, targets, [key])
    documents = removed.get("documents")
    counted = [tables["patents"].agg(F.count("*").alias("patents")), linked_keys.agg(F.count("*").alias("linked")), targets.agg(F.count("*").alias("targets"))]
    if documents is not None:
        total = F.coalesce(F.sum(F.coalesce(F.col(size), F.lit(0))), F.lit(0)).cast("bigint")
        counted.append(documents.agg(F.count("*").alias("documents"), total.alias("bytes")))
        if "request_files" in tables:
            named = linked(documents.select("document_id"), tables["request_files"], ["document_id"])
            counted.append(named.agg(F.countDistinct("document_id").alias("referenced")))
    # One row of each count, put side by side by an aggregate.
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    counts = rows.agg(*(F.max(c).alias(c) for c in rows.columns))
    return Cleanup(kept, removed, counts)


def cleaned(plan: Cleanup, folder: str, expected: dict[str, int], dry_run: bool = True) -> dict[str, int]:
    """Writes the tables that a clean-up leaves to `folder`/<name> and gives its counts. Nothing is
    written on a dry run, or where a count differs from `expected` or a removed document is still
    named: then ValueError. The old tables are the caller's to drop, so a failure loses nothing."""
    counts = plan.counts.first().asDict()
    wrong = {k: (n, counts.get(k)) for k, n in expected.items() if counts.get(k) != n}
    if wrong or counts.get("referenced"):
        raise ValueError(f"nothing removed: {wrong or {'referenced': counts['referenced']}}")
    if not dry_run:
        for name, rows in plan.kept.items():
            rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
    return counts


def delivered(documents: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: documents, missing (no object at their path), wrong_size, public (object open to
    all): how the object store agrees with the documents."""
    rows = documents.select("storage_path", "byte_size").join(objects.select("storage_path", F.col("size").alias("_size"), F.col("public").alias("_public")), "storage_path", "left")
    return rows.agg(
        F.count("*").alias("documents"), F.count_if(F.col("_size").isNull()).alias("missing"), F.count_if(F.col("_size") != F.col("byte_size")).alias("wrong_size"),
        F.count_if(F.coalesce("_public", F.lit(False))).alias("public"),
    )


def newest(documents: DataFrame, keys: list[str], at: str = "fetched_at", **wanted: str | None) -> DataFrame:
    """The newest document of each key; of `wanted` only what isn't None is asked for."""
    for column, value in wanted.items():
        if value is not None:
            documents = documents.filter(F.col(column) == value)
    return first(documents.withColumn("_o", -F.unix_micros(F.col(at).cast("timestamp"))), keys, ["_o"]).drop("_o")
