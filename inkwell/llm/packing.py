"""Filling containers of fixed capacity with texts.

Shortest-pack-first over the length histogram: lengths are placed longest first, each item
into the pack that holds least so far, a new pack only where none has room. The plan works on
counts (patterns of lengths and how often each is used), so its cost depends on the capacity
and not on the number of items. Items are then ranked within their length and joined to the
patterns by rank: an as-of search in the sorted first ranks of the places, one row in, one out.

The places are sent to all workers. There are no more than a pattern can add: a length opens,
splits or finishes at most one pattern for each room that packs have left, so `capacity` ** 2 / 2
in all; in practice far fewer, see the README for figures.

Ranks are taken in shards of bounded size, so a length that a third of all items share is
never gathered in one task. An item larger than the capacity is split into full pieces and a
rest; no other is split. Defined results: texts without tokens (null, empty) are in no
container; repeated rows are items of their own.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.tokens import TOKENIZER, with_size
from inkwell.session import cut

SHARD_ROWS = 50_000  # rows of one length that are ranked in one task at most, about


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, longest first; number of such packs)."""
    rooms: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # room left -> pattern -> packs
    heap: list[int] = []

    def put(room: int, pattern: tuple[int, ...], packs: int) -> None:
        if room not in rooms or not rooms[room]:
            heapq.heappush(heap, -room)
        rooms[room][pattern] = rooms[room].get(pattern, 0) + packs

    for length in sorted((k for k, n in histogram.items() if n > 0 and 0 < k <= capacity), reverse=True):
        left = histogram[length]
        while left:
            while heap and not rooms[-heap[0]]:
                heapq.heappop(heap)
            room = -heap[0] if heap else 0
            if room < length:
                # None has room: new packs, each filled before the next is opened.
                each = min(capacity // length, left)
                packs = left // each
                put(capacity - each * length, (length,) * each, packs)
                left -= packs * each
                continue
            pattern, packs = rooms[room].popitem()
            used = min(left, packs)
            if packs > used:
                rooms[room][pattern] = packs - used
            elif not rooms[room]:
                heapq.heappop(heap)
            put(room - length, (*pattern, length), used)
            left -= used
    return sorted(((p, n) for by in rooms.values() for p, n in by.items()), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first pack, place in the pack, offset in the pack): the
    items of a length with ranks in [first, end) go to packs counted from the first one."""
    out, taken, pack = [], defaultdict(int), 0
    for pattern, packs in patterns:
        offset = 0
        for place, length in enumerate(pattern):
            out.append((length, taken[length], taken[length] + packs, pack, place, offset))
            taken[length] += packs
            offset += length
        pack += packs
    return out


def packed(sizes: DataFrame, bins: DataFrame) -> DataFrame:
    """`sizes` has doc_id, tokens; `bins` has bin_kind, capacity_tokens (a small fixed table).
    Rows bin_kind, capacity, pack_id, place, offset, doc_id, piece, tokens."""
    spark = sizes.sparkSession
    sizes = cut(sizes.filter("tokens > 0").select("doc_id", "tokens"))
    kinds = [(r.bin_kind, r.capacity_tokens) for r in bins.select("bin_kind", "capacity_tokens").distinct().collect() if r.capacity_tokens and r.capacity_tokens > 0]
    if not kinds:
        kinds = [("none", 1)]
        sizes = sizes.limit(0)
    each_bin = F.explode(F.array(*(F.struct(F.lit(k).alias("bin_kind"), F.lit(c).alias("capacity")) for k, c in kinds)))
    pieces = F.ceil(F.col("tokens") / F.col("capacity")).cast("int")
    items = sizes.select("doc_id", "tokens", each_bin.alias("b")).select("b.*", "doc_id", "tokens")
    items = items.select("bin_kind", "capacity", "doc_id", "tokens", F.posexplode(F.sequence(F.lit(1), pieces)).alias("piece", "nth"))
    items = items.select("bin_kind", "capacity", "doc_id", "piece", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("tokens"))
    # Bounded by the capacities: at most capacity rows for each kind of container.
    counted = items.groupBy("bin_kind", "tokens").agg(F.count("*").alias("n")).collect()
    places = _Places(kinds, {kind: slots(plan({r.tokens: r.n for r in counted if r.bin_kind == kind}, capacity)) for kind, capacity in kinds})
    places = spark.sparkContext.broadcast(places)

    shards = max([1, *(-(-r.n // SHARD_ROWS) for r in counted)])
    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))
    group = ["bin_kind", "tokens", "shard"]
    items = items.withColumn("shard", shard)
    before = items.groupBy(*group).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("bin_kind", "tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("within", within).join(before, group).withColumn("rank", F.col("before") + F.col("within"))
    out = "bin_kind string, capacity int, pack_id long, place int, offset int, " + f"doc_id {sizes.schema['doc_id'].dataType.simpleString()}, piece int, tokens int"
    names = ["bin_kind", "capacity", "pack_id", "place", "offset", "doc_id", "piece", "tokens"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, tokens, rank = batch.column("bin_kind"), batch.column("tokens"), batch.column("rank")
            pack, place, offset = places.value.of(kind.to_pylist(), tokens.to_numpy(), rank.to_numpy())
            yield pa.RecordBatch.from_arrays([kind, batch.column("capacity"), pa.array(pack), pa.array(place), pa.array(offset), batch.column("doc_id"), batch.column("piece"), tokens], names=names)

    return ranked.select("bin_kind", "capacity", "doc_id", "piece", "tokens", "rank").mapInArrow(placed, out)


class _Places:
    """The places of all kinds of container in the order of kind, length and first rank. Ranks
    of a length have no gaps, so all ranks laid end to end make one sorted array of starts."""

    def __init__(self, kinds: list[tuple[str, int]], slots: dict[str, list[tuple]]) -> None:
        self.kinds = {kind: i for i, (kind, _) in enumerate(kinds)}
        self.base = np.zeros((len(kinds), 2 + max(c for _, c in kinds)), np.int64)
        rows, total = [], 0
        for kind, _ in kinds:
            for length, first, end, pack, place, offset in sorted(slots[kind]):
                if first == 0:
                    self.base[self.kinds[kind], length] = total
                rows.append((total, first, pack, place, offset))
                total += end - first
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.starts, self.first, self.pack = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        self.place, self.offset = table[:, 3].astype(np.int32), table[:, 4].astype(np.int32)

    def of(self, kinds: list[str], lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """pack, place, offset of the items with these ranks within their lengths."""
        at = self.base[[self.kinds[k] for k in kinds], lengths] + ranks if len(kinds) else np.zeros(0, np.int64)
        k = np.searchsorted(self.starts, at, "right") - 1
        return self.pack[k] + ranks - self.first[k], self.place[k], self.offset[k]


def pack(documents: DataFrame, bins: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    return packed(with_size(documents, ["doc_id"], path=tokenizer), bins)


def fill(packs: DataFrame) -> DataFrame:
    """Rows bin_kind, packs, tokens, unused_share of a packing."""
    one = packs.groupBy("bin_kind", "capacity", "pack_id").agg(F.sum("tokens").alias("tokens"))
    out = one.groupBy("bin_kind", "capacity").agg(F.count("*").alias("packs"), F.sum("tokens").alias("tokens"))
    return out.withColumn("unused_share", 1 - F.col("tokens") / (F.col("packs") * F.col("capacity")))
