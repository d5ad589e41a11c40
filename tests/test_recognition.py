from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import identifiers as ids
from inkwell.functions import paths
from inkwell.operators import recognition
from inkwell.operators.recognition import Recognised


def test_engine_failures_stay_single(spark):
    class Fake:  # local, so that it travels to the workers with the call
        def recognize(self, images, language):
            if any(i == b"bad" for i in images):
                raise ValueError("bad image")
            return [Recognised(i.decode(), 90.0, language, "fake") for i in images]

    images = spark.createDataFrame([(1, b"one"), (2, b"bad"), (3, b"three"), (4, None)], "k int, content binary")
    got = {r.k: (r.text, r.warnings) for r in recognition.recognised(images.coalesce(1), "k", Fake).collect()}
    assert got == {1: ("one", []), 2: ("", ["ocr_failed: ValueError"]), 3: ("three", []), 4: ("", [])}


def test_words_to_lines(spark):
    rows = [("a", 1, 1, 1, 1, 2, "valve", 80.0), ("a", 1, 1, 1, 1, 1, " The", 60.0), ("a", 1, 1, 1, 2, 1, "opens", -1.0), ("a", 1, 1, 1, 2, 2, " ", 10.0), ("b", 1, 1, 1, 1, 1, "x", -1.0)]
    df = spark.createDataFrame(rows, "k string, page int, block int, paragraph int, line int, word int, text string, confidence double")
    assert {r.k: (r.text, r.confidence, r.band) for r in recognition.lines_of_words(df, "k").collect()} == {"a": ("The valve\nopens", 70.0, "medium"), "b": ("x", None, "low")}


def test_first_success(spark):
    rows = [("a", 1, "", None, "en", "p1", ["slow"]), ("a", 2, "text", 50.0, "en", "p2", []), ("a", 3, "late", 99.0, "en", "p3", ["no"]), ("b", 1, "", None, "en", "p1", ["x"]), ("b", 2, " ", None, "en", "p2", ["y"])]
    df = spark.createDataFrame(rows, f"k string, rank int, {recognition.RESULT}")
    assert {r.k: (r.provider, r.warnings) for r in recognition.first_success(df, "k").collect()} == {"a": ("p2", ["slow"]), "b": ("p2", ["x", "y"])}


def test_key_paths(spark):
    df = spark.createDataFrame([(1, '{"a": {"B": [1, {"c": null}]}, "d": "x"}'), (2, "no"), (3, None)], "k int, p string")
    got = {(r.path, r.kind, r.value) for r in paths.key_paths(df, "k", "p").collect()}
    assert got == {("a", "object", None), ("a.B", "array", None), ("a.B[0]", "bigint", "1"), ("a.B[1]", "object", None), ("a.B[1].c", "void", None), ("d", "string", "x")}
    assert {r.path for r in paths.find_keys(df, "k", "p", ["b", "C"]).collect()} >= {"a.B", "a.B[1].c"}


def test_rest_number(spark):
    df = spark.createDataFrame([("WO2020123456A1",), ("PCT/AT2025/060357",), ("EP1234567A1",)], "x string")
    got = [r.y for r in df.select(ids.normalized_number(F.col("x")).alias("r")).select(ids.rest_number(F.col("r")).alias("y")).collect()]
    assert got == ["WO20123456", "AT2025060357", None]


def test_key_paths_of_any_depth(spark):
    deep = '{"a": ' * 40 + "1" + "}" * 40
    df = spark.createDataFrame([(1, deep, "v"), (2, "[]", "w"), (3, "nope", "x"), (4, None, "y"), (5, "7", "z")], "k bigint, p string, v string")
    rows = paths.key_paths(df, "k", "p").collect()
    assert len(rows) == 40 and max(r.path.count(".") for r in rows) == 39
    assert [r.value for r in rows if r.path.count(".") == 39] == ["1"]
    assert paths.key_paths(df.limit(0), "k", "p").count() == 0
