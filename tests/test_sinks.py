from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from inkwell.operators import recognition
from inkwell.session import bounded
from inkwell.settings import Settings, loaded
from inkwell.sinks import files, tables


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", b"one"), ("a/b.txt", b"one"), ("../x", b"y"), ("/abs", b"y"), ("n", None)], "name string, content binary")
    rows = files.uploaded(df, str(tmp_path)).collect()
    assert {(r.name, r.byte_size, r.error) for r in rows} == {("a/b.txt", 3, None), ("../x", None, "unsafe_name"), ("/abs", None, "unsafe_name"), ("n", None, "no_content")}
    assert (tmp_path / "a/b.txt").read_bytes() == b"one" and [f for _, _, fs in os.walk(tmp_path) for f in fs] == ["b.txt"]


def test_artifacts(spark, tmp_path):
    keys = [f"{k:032x}" for k in range(3)]
    df = spark.createDataFrame([(keys[0], "My file.pdf", "application/pdf", b"abc"), (keys[1], "", None, b"xy"), ("bad", "n", None, b"z")], "artifact_id string, filename string, mime_type string, content binary")
    made = spark.createDataFrame(files.artifacts(df, str(tmp_path), 1000, 5).collect())
    assert {(r.artifact_id, r.filename, r.byte_size, r.expires_at_epoch) for r in made.collect()} == {(keys[0], "My-file.pdf", 3, 1060), (keys[1], "document.bin", 2, 1060)}
    assert {(r.artifact_id, bytes(r.content)) for r in files.read_artifacts(made, str(tmp_path)).collect()} == {(keys[0], b"abc"), (keys[1], b"xy")}
    (tmp_path / keys[1] / "document.bin").write_bytes(b"xz")
    wanted = made.unionByName(made.limit(1).withColumn("artifact_id", F.lit("../etc")))
    assert {(r.artifact_id, r.error) for r in files.read_artifacts(wanted, str(tmp_path)).collect()} == {(keys[0], None), (keys[1], "unavailable"), ("../etc", "unavailable")}
    assert files.remove_expired(made, str(tmp_path), 1059).count() == 0
    assert {r.artifact_id for r in files.remove_expired(made, str(tmp_path), 1060).collect()} == set(keys[:2]) and os.listdir(tmp_path) == []


def test_tables(spark, tmp_path):
    schema = "patent_id int, type string, strategy string, sha256 string, source string, number string, filename string, saved_at int"
    old = spark.createDataFrame([(1, "pdf", "s", "aa", "epo", "EP1", "a b.pdf", 1)], schema)
    new = spark.createDataFrame([(1, "pdf", "s", "aa", "epo", "EP1", "c.pdf", 1), (1, "pdf", "s", "bb", "epo", "EP1", "d.pdf", 1)], schema)
    assert {(r.sha256, r.storage_path) for r in tables.saved_documents(old, new).collect()} == {("aa", "epo/EP1/aa-c.pdf"), ("bb", "epo/EP1/bb-d.pdf")}
    events = spark.createDataFrame([(1, -5, "2024-01-01"), (2, 7, "2024-01-02")], "id int, elapsed_ms bigint, at string").withColumn("created_at", F.to_timestamp("at"))
    for _ in range(2):
        tables.append_events(events, f"{tmp_path}/log")
    assert sorted((r.id, r.elapsed_ms) for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [(1, 0), (1, 0), (2, 7), (2, 7)]
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    assert {tuple(r) for r in tables.changed(rows, spark.createDataFrame([(1, "z", None), (9, "q", "q")], "k int, v string, w string"), ["k"]).collect()} == {(1, "z", "x"), (2, "b", "y")}
    docs = spark.createDataFrame([(1, "a", 3), (1, "b", 9), (2, "a", 1)], "patent_id int, kind string, t int").withColumn("fetched_at", F.timestamp_seconds("t"))
    assert {(r.patent_id, r.t) for r in tables.newest(docs, ["patent_id"], kind=None).collect()} == {(1, 9), (2, 1)}
    assert {(r.patent_id, r.t) for r in tables.newest(docs, ["patent_id"], kind="a").collect()} == {(1, 3), (2, 1)}
    asked = spark.createDataFrame([(1, "ready", None), (2, "new", "own")], "doc int, status string, path string")
    assert {tuple(r) for r in files.prepared(asked, spark.createDataFrame([(1, "old", "p")], "doc int, status string, path string"), "doc", ["path", "status"]).collect()} == {(1, "ready", "p"), (2, "new", "own")}


def test_cleanup_is_counted_before_it_happens(spark, tmp_path):
    data = {
        "patents": spark.createDataFrame([(1,), (2,), (3,)], "patent_id int"), "documents": spark.createDataFrame([(2, 20, 7), (3, 30, None), (1, 10, 5)], "patent_id int, document_id int, byte_size bigint"),
        "events": spark.createDataFrame([(1, "a"), (3, "b"), (None, "c")], "patent_id int, e string"), "request_files": spark.createDataFrame([(10,)], "document_id int"),
    }
    plan = tables.unlinked_records(data, spark.createDataFrame([(1,), (1,), (None,)], "patent_id int"))
    assert tables.cleaned(plan, str(tmp_path), {"targets": 2, "documents": 2}) == {"patents": 3, "linked": 1, "targets": 2, "documents": 2, "bytes": 7, "referenced": 0}
    assert os.listdir(tmp_path) == []
    with pytest.raises(ValueError, match="targets"):
        tables.cleaned(plan, str(tmp_path), {"targets": 1}, dry_run=False)
    tables.cleaned(plan, str(tmp_path), {"targets": 2}, dry_run=False)
    assert {r.e for r in spark.read.parquet(f"{tmp_path}/events").collect()} == {"a", "c"} and spark.read.parquet(f"{tmp_path}/patents").count() == 1
    named = {**data, "request_files": spark.createDataFrame([(20,)], "document_id int")}
    with pytest.raises(ValueError, match="referenced"):
        tables.cleaned(tables.unlinked_records(named, spark.createDataFrame([(1,)], "patent_id int")), str(tmp_path), {})
    objects = spark.createDataFrame([("a", 5, False), ("b", 6, True)], "storage_path string, size bigint, public boolean")
    assert tuple(tables.delivered(spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "storage_path string, byte_size bigint"), objects).first()) == (3, 1, 1, 1)


def test_settings_and_limits(spark, tmp_path):
    (tmp_path / ".env").write_text("# x\nINKWELL_MAX_FILES=7\nexport INKWELL_RECOGNITION_LANGUAGE='de'\nINKWELL_MAX_PAGES=2\n", encoding="utf-8")
    got = loaded(str(tmp_path / ".env"), {"INKWELL_MAX_PAGES": "9"})
    assert (got.max_files, got.recognition_language, got.max_pages, got.request_timeout_seconds) == (7, "de", 9, Settings().request_timeout_seconds)
    with pytest.raises(ValueError):
        loaded(None, {"INKWELL_MAX_FILES": "many"})
    with bounded(spark, 60):
        assert spark.range(10).count() == 10
    began = time.monotonic()
    with pytest.raises(TimeoutError), bounded(spark, 1):
        spark.range(4, numPartitions=4).select(F.expr("reflect('java.lang.Thread', 'sleep', 60000L)")).collect()
    assert time.monotonic() - began < 30


def test_recognition_helpers(spark):
    df = spark.createDataFrame([(["deu", "eng", "xyz"],), (["xyz"],)], "w array<string>").select(recognition.installed(F.col("w"), ["eng", "deu"]).alias("l"))
    assert [r.l for r in df.collect()] == [["deu", "eng"], ["eng"]]
    rows = spark.createDataFrame([("a", 80.0, "en", "p2", []), ("", None, "en", "p1", ["w"]), ("b", 60.0, "en", "p2", [])], recognition.RESULT)
    out, seen = recognition.diagnostics(rows)
    assert out.count() == 3 and {k: seen.get[k] for k in ("images", "recognised", "with_warnings", "providers", "confidence")} == {"images": 3, "recognised": 2, "with_warnings": 1, "providers": ["p1", "p2"], "confidence": 70.0}
