from __future__ import annotations

from inkwell.operators.store import latest
from inkwell.streaming import events

SCHEMA = "event_id bigint, outcome string, elapsed_ms bigint, created_at timestamp"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 40, "hit" if i % 3 else "miss", i, f"2024-01-{1 + i % 9:02d} 0{i % 9}:00:00") for i in range(120)]
    table = spark.createDataFrame(rows, "event_id bigint, outcome string, elapsed_ms bigint, created_at string").selectExpr("event_id", "outcome", "elapsed_ms", "timestamp(created_at) created_at")
    for part in range(3):
        table.filter(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    query = events.outcome_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/c1").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (str(r.window_start), r.outcome, r.events, r.elapsed_ms)
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, events.outcome_counts(table).collect()))

    query = events.kept_latest(stream, f"{tmp_path}/store", ["event_id"], ["created_at", "elapsed_ms"]).option("checkpointLocation", f"{tmp_path}/c2").start()
    query.processAllAvailable()
    query.stop()
    kept = events.current(spark, f"{tmp_path}/store")
    assert sorted(map(tuple, kept.select("event_id", "elapsed_ms").collect())) == sorted(
        map(tuple, latest(table, ["event_id"], ["created_at", "elapsed_ms"]).select("event_id", "elapsed_ms").collect())
    )
    assert events.current(spark, f"{tmp_path}/nowhere") is None
    import os

    assert len([x for x in os.listdir(f"{tmp_path}/store") if x.startswith("list=")]) <= 3


def test_a_batch_touches_its_own_parts_only(spark, tmp_path):
    import os

    def put(n, rows):
        spark.createDataFrame(rows, "k bigint, v bigint").coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
        stream = spark.readStream.schema("k bigint, v bigint").parquet(f"{tmp_path}/in/*")
        query = events.kept_latest(stream, f"{tmp_path}/s", ["k"], ["v"], parts=16).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()

    put(0, [(k, 0) for k in range(200)])
    put(1, [(7, 5), (8, -1)])
    assert {tuple(r) for r in events.current(spark, f"{tmp_path}/s").collect()} == {(k, 5 if k == 7 else 0) for k in range(200)}
    assert len([x for x in os.listdir(f"{tmp_path}/s/version=1") if x.startswith("part=")]) <= 2
    assert {tuple(r) for r in events.current(spark, f"{tmp_path}/s", before=1).collect()} == {(k, 0) for k in range(200)}


def test_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "event_id bigint, outcome string").selectExpr("*", "timestamp('2024-01-01') created_at")
    assert events.once(df).count() == 2
