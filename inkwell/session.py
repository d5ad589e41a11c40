"""Session helpers: reading tables, the shared checkpoint folder, cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`, one Parquet file or a folder of them."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir if the cluster names
    one; a machine-local temporary folder only where it is unset and the master is local.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_own_folder()}"


@cache
def _own_folder() -> str:
    """A folder of this process, gone when it ends; for a local master only."""
    path = tempfile.mkdtemp(prefix="inkwell-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder (a reliable checkpoint), so that
    later branches read it instead of computing it again and a lost executor costs nothing.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


@contextmanager
def bounded(spark: SparkSession, seconds: float) -> Iterator[str]:
    """Jobs started inside are cancelled after that many seconds, then TimeoutError; the tag that
    it gives cancels them earlier (`cancelJobsWithTag`)."""
    tag, late = f"bounded-{uuid.uuid4().hex}", threading.Event()
    context = spark.sparkContext

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        yield tag
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"not done within {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def spread(df: DataFrame, *keys) -> DataFrame:
    """Repartition to the number of shuffle partitions before work that is heavy per row;
    small files would otherwise put it all into one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)
