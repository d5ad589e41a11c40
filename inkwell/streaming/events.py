"""Streaming forms: windowed counts of an event log, and a store kept by micro-batches."""

from __future__ import annotations

import shutil

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from inkwell.operators.store import latest, upserted
from inkwell.session import cut


def once(events: DataFrame, key: str = "event_id", at: str = "created_at", late: str = "30 days") -> DataFrame:
    """Each event once, however often it is delivered (on a stream: within the watermark)."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def outcome_counts(events: DataFrame, width: str = "1 day", at: str = "created_at") -> DataFrame:
    """window_start, outcome, events, elapsed_ms (sum) of tumbling windows. On a stream with a
    watermark windows are emitted when it passes them; on a table all at once."""
    grouped = events.groupBy(F.window(F.col(at), width).alias("w"), "outcome")
    counted = grouped.agg(F.count("*").alias("events"), F.sum("elapsed_ms").alias("elapsed_ms"))
    return counted.select(F.col("w.start").alias("window_start"), "outcome", "events", "elapsed_ms")


def kept_latest(stream: DataFrame, path: str, keys: list[str], order: list[str], parts: int = 64, kept: int = 3) -> DataStreamWriter:
    """Writer that keeps the latest row of each key below `path`.

    Rows lie in `parts` parts by a hash of their key. A micro-batch writes only the parts that it
    touches, as `version=<batch>/part=<n>`, then a list of the newest version of every part
    (`list=<batch>`). A batch that runs again after a failure overwrites its own version and
    list and nothing else. Files that none of the `kept` newest lists names are dropped."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _list(spark, path, number)
        rows = latest(batch, keys, order).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        rows = cut(rows)
        touched = [r.part for r in rows.select("part").distinct().collect()]  # parts at most
        old = [(n, v) for n, v in before.items() if n in touched]
        both = _read(spark, path, old)
        rows = rows if both is None else upserted(both, rows, [*keys, "part"], order)
        rows.repartition(max(1, len(touched)), "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/version={number}")
        now = {**before, **dict.fromkeys(touched, number)}
        spark.createDataFrame(sorted(now.items()), "part int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/list={number}")
        _tidy(spark, path, number, kept)

    return stream.writeStream.foreachBatch(write)


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders `kind=<number>` that hold files. A list is one file, there as a
    whole or not at all, and written after the versions it names."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
        rows = files.load(f"{path}/{kind}=*").select(F.regexp_extract("path", rf"/{kind}=(\d+)/", 1).cast("long").alias("n")).distinct().collect()
    except AnalysisException:  # no such folder yet
        return []
    return sorted(r.n for r in rows if r.n is not None)


def _list(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Newest version of each part, as the newest complete list (below `before`) has it."""
    done = [n for n in _folders(spark, path, "list") if before is None or n < before]
    return {r.part: r.version for r in spark.read.parquet(f"{path}/list={done[-1]}").collect()} if done else {}


def _read(spark: SparkSession, path: str, listed: list[tuple[int, int]]) -> DataFrame | None:
    if not listed:
        return None
    return spark.read.option("basePath", path).parquet(*(f"{path}/version={v}/part={n}" for n, v in listed)).drop("version")


def _tidy(spark: SparkSession, path: str, number: int, kept: int) -> None:
    """Drops lists and versions that no list in use names, as far as the path is a local or
    mounted folder; elsewhere the store's own life cycle rules do that."""
    root = path.removeprefix("file://")
    if "://" in root:
        return
    lists = _folders(spark, path, "list")
    for n in lists[:-kept]:
        shutil.rmtree(f"{root}/list={n}", ignore_errors=True)
    used = {v for n in lists[-kept:] for v in _list(spark, path, n + 1).values()}
    for v in _folders(spark, path, "version"):
        if v not in used and v < number:
            shutil.rmtree(f"{root}/version={v}", ignore_errors=True)


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The store as the newest complete list (below `before`, if given) has it."""
    rows = _read(spark, path, sorted(_list(spark, path, before).items()))
    return None if rows is None else rows.drop("part")
