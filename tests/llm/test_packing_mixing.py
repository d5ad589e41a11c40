from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import mixing, packing
from inkwell.llm.tokens import TOKENIZER, with_size


def one_by_one(lengths, capacity):
    """Shortest pack first for single items, longest first."""
    packs = []
    for n in sorted(lengths, reverse=True):
        fits = [p for p in packs if sum(p) + n <= capacity]
        if fits:
            min(fits, key=sum).append(n)
        else:
            packs.append([n])
    return packs


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_the_plan_of_single_items(seed):
    rng = random.Random(seed)
    lengths = [min(40, int(rng.expovariate(0.12)) + 1) for _ in range(rng.randint(1, 300))]
    patterns = packing.plan(Counter(lengths), 40)
    assert Counter(n for p, k in patterns for n in p for _ in range(k)) == Counter(lengths)
    assert all(sum(p) <= 40 for p, _ in patterns)
    assert sum(k for _, k in patterns) == len(one_by_one(lengths, 40))


def test_slots_cover_every_rank_once():
    histogram = {30: 3, 12: 7, 5: 11, 1: 4}
    taken = Counter()
    for length, a, b, *_ in packing.slots(packing.plan(histogram, 40)):
        taken.update((length, r) for r in range(a, b))
    assert taken == Counter((k, r) for k, n in histogram.items() for r in range(n))


def test_packed(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    rng = random.Random(1)
    sizes = [(i, 20 if i % 3 == 0 else rng.randint(0, 130)) for i in range(200)]
    bins = spark.createDataFrame([("a", 50), ("b", 100), ("none", 0)], "bin_kind string, capacity_tokens int")
    out = packing.packed(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), bins).collect()
    for kind, capacity in (("a", 50), ("b", 100)):
        rows = [r for r in out if r.bin_kind == kind]
        pieces = Counter()
        for r in rows:
            pieces[r.doc_id] += r.tokens
        assert pieces == Counter({i: n for i, n in sizes if n})
        assert Counter((r.doc_id) for r in rows) == Counter({i: -(-n // capacity) for i, n in sizes if n})
        ends = sorted((r.pack_id, r.offset, r.tokens) for r in rows)
        assert all(x[1] + x[2] == y[1] if x[0] == y[0] else y[1] == 0 for x, y in zip(ends, ends[1:])) and ends[0][1] == 0
        assert max(a + n for _, a, n in ends) <= capacity
    empty = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert packing.packed(empty, bins).count() == 0 and packing.packed(empty, bins.limit(0)).count() == 0


def slowly(weights, seats):
    out = dict.fromkeys(weights, 0)
    for _ in range(seats):
        k = min((k for k in weights if weights[k] > 0), key=lambda k: (-weights[k] / (2 * out[k] + 1), str(k)))
        out[k] += 1
    return out


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1234])
def test_apportionment(seats):
    weights = {"a": 0.5, "b": 0.3, "c": 0.19, "d": 0.01, "e": 0}
    assert mixing.apportioned(weights, seats) == slowly(weights, seats)
    capped = mixing.apportioned(weights, seats, {"a": 3, "b": 99, "c": 99, "d": 99})
    assert capped["a"] <= 3 and sum(capped.values()) <= seats


def test_mixed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 60)
    rng = random.Random(4)
    sizes = [(i, "big" if i < 700 else "mid" if i < 900 else "small", rng.randint(1, 60)) for i in range(1000)] + [(2000, None, 50), (2001, "other", 50), (2002, "big", 0)]
    df = spark.createDataFrame(sizes, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(df, targets, block=20)
    rows = mix.collect()
    most = {"big": 1, "mid": 2, "small": 4}
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.uses <= most[r.source] for r in rows)
    shares = {r.source: r for r in mixing.reached(mix, targets).collect()}
    for source, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(shares[source].actual_share - share) < 0.02
    assert shares["absent"].tokens == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed(df, targets, block=20).collect()))
    assert mixing.mixed(df.limit(0), targets).count() == 0 and mixing.mixed(df, targets.limit(0)).count() == 0


def test_a_total_asked_for(spark):
    """A source that holds too little leaves its part open, the others keep theirs."""
    df = spark.createDataFrame([(i, "big" if i < 900 else "tiny", 10) for i in range(910)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 2)], "source string, target_share double, max_repeats int")
    own = {r.source: r for r in mixing.reached(mixing.mixed(df, targets, block=20), targets).collect()}
    assert own["big"].tokens == own["tiny"].tokens == 200 and own["big"].shortfall == own["tiny"].shortfall == 0
    asked = {r.source: r for r in mixing.reached(mixing.mixed(df, targets, block=20, total=4000), targets, 4000).collect()}
    assert (asked["big"].tokens, asked["big"].shortfall) == (2000, 0) and (asked["tiny"].tokens, asked["tiny"].shortfall, asked["tiny"].most_uses) == (200, 1800, 2)


def test_shards_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 1)
    monkeypatch.setattr(mixing, "SHARDS", 3)
    df = spark.createDataFrame([(i, "a", 7) for i in range(100)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mixed(df, targets, block=10).count() >= 95  # half a document a shard


def test_ranks_meet_their_places():
    """The as-of search gives the place that a scan of all places gives."""
    rng = random.Random(5)
    kinds = [("a", 40), ("b", 17)]
    slots = {k: packing.slots(packing.plan(Counter(rng.randint(1, c) for _ in range(300)), c)) for k, c in kinds}
    places = packing._Places(kinds, slots)
    asked = [(k, length, rng.randrange(first, end)) for k, _ in kinds for length, first, end, *_ in slots[k]]
    pack, place, offset = places.of([k for k, _, _ in asked], np.array([n for _, n, _ in asked]), np.array([r for _, _, r in asked]))
    for (kind, length, rank), *got in zip(asked, pack, place, offset):
        (want,) = [(p + rank - first, at, o) for n, first, end, p, at, o in slots[kind] if n == length and first <= rank < end]
        assert tuple(got) == want


@pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no tokenizer here")
def test_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "y"), (3, None, "z"), (4, "<|endoftext|>", "w")], "doc_id bigint, text string, tokens string")
    got = {r.doc_id: r.tokens for r in with_size(df, ["doc_id"]).collect()}
    assert got[2] == got[3] == 0 and 2 <= got[1] <= 4 and got[4] > 1
