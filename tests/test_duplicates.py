from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import duplicates


def jaccard(a, b):
    grams = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    x, y = grams(a), grams(b)
    return (len(x & y) / len(x | y) if x and y else 0.0), min(len(x), len(y))


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    common = [rng.choice(words) for _ in range(30)]
    texts = []
    for _ in range(14):
        base = common + [rng.choice(words) for _ in range(rng.randint(5, 60))]
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    texts += ["short text of few words only here", "", None, "a b c d"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, size int")
    got = {(r.key_a, r.key_b): r.jaccard for r in duplicates.near_pairs(df).collect()}
    reps = {}
    for i, t in enumerate(texts):
        if t:
            reps.setdefault(t, i)
    expected = {}
    items = sorted((i, t) for t, i in reps.items())
    for x, (i, a) in enumerate(items):
        for j, b in items[x + 1 :]:
            s, least = jaccard(a, b)
            if least >= duplicates.MIN_GRAMS and s >= 0.8:
                expected[(i, j)] = round(s, 4)
    assert expected
    assert got == expected


def test_exact_classes(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, ""), (5, None)], "doc_id bigint, text string")
    assert {tuple(r) for r in duplicates.exact_classes(df).collect()} == {(3, 1, 2), (1, 1, 2), (2, 2, 1)}
    assert duplicates.exact_classes(df.limit(0)).count() == 0
    assert duplicates.near_pairs(df.limit(0)).count() == 0


def test_near_classes(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(5, base), (2, base), (3, base + " end"), (4, "other text"), (6, None), (7, base.replace("w1 ", "ｗ１ "))], "doc_id bigint, text string")
    assert {tuple(r) for r in duplicates.near_classes(df).collect()} == {(5, 2, 2, 2), (2, 2, 2, 2), (3, 3, 1, 2), (4, 4, 1, 0), (7, 7, 1, 2)}
    assert duplicates.near_classes(df.limit(0)).count() == 0


def test_near_pairs_at_the_threshold_of_any_length(spark):
    rng = random.Random(8)
    texts = []
    for n in (24, 40, 64, 90, 150, 300, 700, 1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts.append(" ".join(words))
        for share in (0.07, 0.09, 0.1, 0.11, 0.111, 0.112, 0.12, 0.13, 0.2):
            # One side is longer by new words, or a run is put in place of another.
            texts.append(" ".join([*words, *(f"x{rng.randrange(10**6)}" for _ in range(round(n * share * 2)))]))
            other, k = list(words), rng.randrange(n // 2)
            other[k : k + max(0, round(n * share) - 4)] = [f"y{rng.randrange(10**6)}" for _ in range(max(0, round(n * share) - 4))]
            texts.append(" ".join(other))
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    expected = {}
    for i, a in enumerate(sets):
        for j, b in list(enumerate(sets))[i + 1 :]:
            s = len(a & b) / len(a | b)
            if min(len(a), len(b)) >= duplicates.MIN_GRAMS and s >= 0.8:
                expected[(i, j)] = round(s, 4)
    assert len(expected) > 70
    assert {(r.key_a, r.key_b): r.jaccard for r in duplicates.near_pairs(df).collect()} == expected


def written_for_each_byte(spark, query):
    """Bytes that the shuffles of `query` write for each byte of text, on texts of common lines."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(3000)]
    lines = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(1000)]
    texts = [" ".join(rng.choice(lines) + f" {rng.randrange(100)}" for _ in range(100)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    query(df).collect()
    return (written() - before) / sum(map(len, texts))


def test_near_pairs_write_less_than_their_budget(spark):
    """Disk is four times the table; whole sets were shuffled several times before."""
    assert written_for_each_byte(spark, duplicates.near_pairs) < 4


def test_near_classes_write_less_than_their_budget(spark):
    assert written_for_each_byte(spark, duplicates.near_classes) < 4


def shuffle_blocks(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).name().startswith("shuffle") for i in range(blocks.length()))


def test_near_classes_drop_the_shuffles_of_their_steps(spark):
    base = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join([*base, *["end"] * (i // 2)])) for i in range(8)], "doc_id bigint, text string")
    before = shuffle_blocks(spark)
    planned = duplicates.near_classes(df)
    assert shuffle_blocks(spark) <= before
    assert planned.count() == 8


def test_tables_of_hashes(spark, monkeypatch):
    h = np.array([1, 2, 2, 3, 3, 3], np.uint64) << np.uint64(60)
    ids = np.array([0, 1, 255, 256, 70000], np.uint32)
    assert duplicates._unpacked(duplicates._packed(ids)).tolist() == ids.tolist()
    docs = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "doc bigint").repartition(3)
    for gathered in (duplicates.GATHERED, 0):
        monkeypatch.setattr(duplicates, "GATHERED", gathered)
        asked = np.array([0, 1, 2, 3], np.uint64) << np.uint64(60)
        table = duplicates._table(docs, duplicates._documents, 2).value
        assert table.count(asked).tolist() == [0, 1, 2, 3]
        assert table.has(asked).tolist() == [False, False, True, True]
        assert duplicates._table(docs, duplicates._documents, 1).value.has(asked).tolist() == [False, True, True, True]


def test_units_for_candidates(spark):
    texts = ["[0001] The valve[00123]  opens [12] [x]", "[0002]\u3000発明の 図1 と弁 （２）", "don't read-only a/b ﬁne ｆｕｌｌ ① e\u0301te\u0301", "ΣΑΣ İstanbul Straße", "한국어 vale 12\u00a0mm", "-", " ", "a" * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    whole = tx.with_nfkc(rows, "text").select("doc", tx.unit_tokens(F.col("text")).alias("units"))
    assert sorted(map(tuple, duplicates._units(rows).collect())) == sorted(map(tuple, whole.collect()))


def test_windows_and_pieces(monkeypatch):
    monkeypatch.setattr(duplicates, "ROWS", 3)
    monkeypatch.setattr(duplicates, "UNITS", 12)
    rows = [[1, 2, 3, 4, 5, 6], [], [1, 2, 3, 4], [2, 3, 4, 5, 6], list(range(40)), [1, 2, 3, 4, 5], [7]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], ["units"])
    pieces = list(duplicates._pieces(iter([batch.slice(1), batch])))
    assert [x for p in pieces for x in p.column("units").to_pylist()] == rows[1:] + rows
    assert all(len(p) <= 3 for p in pieces)
    row, h = duplicates._windows(batch.column("units"))
    assert row.tolist() == [0, 0, 3, *[4] * 36, 5]
    assert h[1] == h[2] and h[0] == h[-1] and h[0] != h[1]
    assert np.array_equal(np.concatenate(list(duplicates._grams(iter([batch.slice(3)])))), h[2:])
