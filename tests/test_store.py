from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import store

ROWS = [("a", 1, "x"), ("a", 3, "y"), ("b", 2, ""), ("b", 2, None), (None, 9, "n"), (None, 8, "m")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "k string, t int, v string")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_latest_and_first(spark):
    df = frame(spark)
    assert [r for r in rows_of(store.latest(df, ["k"], ["t", "v"])) if r[0] != "b"] == [("a", 3, "y"), (None, 9, "n")]
    assert [r for r in rows_of(store.first(df, ["k"], ["t", "v"])) if r[0] != "b"] == [("a", 1, "x"), (None, 8, "m")]
    assert store.latest(df.limit(0), ["k"], ["t"]).count() == 0


def test_upsert(spark):
    old, new = frame(spark, [("a", 1, "x"), ("b", 5, "y")]), frame(spark, [("a", 1, "z"), ("c", 0, "w"), ("b", 4, "q")])
    assert rows_of(store.upserted(old, new, ["k"], ["t"])) == [("a", 1, "z"), ("b", 5, "y"), ("c", 0, "w")]
    assert rows_of(store.inserted_if_absent(old, new, ["k"])) == [("c", 0, "w")]


def test_links(spark):
    left, links = frame(spark), spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {r.k for r in store.linked(left, links, ["k"]).collect()} == {"a"}
    assert {r.k for r in store.unlinked(left, links, ["k"]).collect()} == {"b", None}


def test_two_tiers(spark):
    records = spark.createDataFrame([(1, "EP-1", "EP1A", 1), (2, "ep 1", "EP2", 2), (3, "--", None, 3)], "id int, display string, number string, at int")
    alias = store.aliases(records, "id", ["display", "number"], "at")
    assert {(r.alias, r.id) for r in alias.collect()} == {("EP1", 1), ("EP1A", 1), ("EP2", 2)}
    asked = spark.createDataFrame([("EP2", "?"), ("none", "ep/1"), (None, None)], "number string, name string")
    got = store.two_tier(asked, records.select("number", "id").filter("number is not null"), alias, "number", "name", "id")
    assert {(r.number, r.id, r.tier) for r in got.collect()} == {("EP2", 2, 1), ("none", 1, 2), (None, None, None)}


def test_merge_pick_budget_expiry(spark):
    main, other = frame(spark, [("a", 1, ""), ("b", 2, "keep")]), frame(spark, [("a", 9, "fallback"), ("b", 9, "not")])
    assert rows_of(store.merged(main, other, ["k"], ["v"])) == [("a", "fallback"), ("b", "keep")]
    ranked = store.picked(frame(spark), ["k"], F.when(F.col("v") == "x", 0).otherwise(1), ["t"])
    assert ("a", 1, "x") in rows_of(ranked)
    running = store.within_budget(frame(spark, [("a", 1, "xx"), ("a", 2, "yy"), ("a", 3, "z")]), ["k"], ["t"], F.length("v"), 4)
    assert [(r.running, r.within) for r in running.orderBy("t").collect()] == [(2, True), (4, True), (5, False)]
    at = spark.createDataFrame([("2020-01-01 00:00:00",), ("2020-01-02 00:00:00",)], "s string").select(F.to_timestamp("s").alias("at"))
    assert store.expired(at, "at", F.to_timestamp(F.lit("2020-01-02 00:00:00")), 86400).count() == 1
