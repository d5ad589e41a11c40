"""Exact and near duplicates of texts.

Near duplicates: two texts of at least 20 five-word grams whose Jaccard similarity is 0.8 or
more. Equal texts are one representative. Every text orders its grams by their frequency,
rarest first. If two sets reach the threshold, they share a gram among the first
n - ceil(0.8 n) + 1 of either, and k of them if either prefix is longer by k - 1. So only these
prefixes meet in an equi-join, pairs that share too few of their grams go, and frequent
boilerplate never brings texts together. Every candidate is then compared on its whole sets, so
the result is exact.

Any order of the grams gives the same result, so frequencies are counted by buckets of their
hashes, in tables of bounded size (`BUCKETS`, `FINE_BUCKETS`). Copies are left out before, by a
list of the first keys of the texts, which is bounded too and may let some copies through.
Nothing but the prefixes is shuffled, without grams that occur once: the texts are read again,
once for the prefixes and once for the sets of the candidates. The shuffles of a step go when it
ends.

Defined results: null and empty texts have no partner; texts below 20 grams only exact ones;
ties and repeated rows fall into one class; an empty table gives an empty one.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.session import cut

if TYPE_CHECKING:
    from pyspark import Broadcast

MIN_GRAMS = 20
THRESHOLD = 0.8
GRAM = 5
# Buckets of hashes, one byte each where they are broadcast, and finer ones, one bit each; they
# travel in parts.
BUCKET_BITS, FINE_BITS = 24, 28
BUCKETS, FINE_BUCKETS, PARTS = 1 << BUCKET_BITS, 1 << FINE_BITS, 64
FINE, FINE_PART = FINE_BUCKETS // BUCKETS, FINE_BUCKETS // PARTS
# Fine buckets that a task gathers before it passes them on.
GATHERED = 1 << 22
# One more gram must be shared by the prefixes for so many grams of both texts.
GRAMS_A_SHARED = 64
# Rows and units that are looked at together, so memory is bounded; the row takes 14 bits.
ROWS, UNITS = 1 << 13, 1 << 20
# Counts below are kept as they are in a byte, others by eighths of their logarithm.
EXACT_COUNTS = 128
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def exact_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (smallest key of the equal texts), copies: one row for each document."""
    rows = documents.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(key, F.unhex(F.sha2(F.col(text), 256)).alias("digest"))
    classes = rows.groupBy("digest").agg(F.min(key).alias("class_id"), F.count("*").alias("copies"))
    return rows.join(classes, "digest").select(key, "class_id", "copies")


def near_classes(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, class_id, copies, links: one row for each document with text; class_id is the
    smallest key of the equal texts, links the number of other texts that are near it."""
    pairs = near_pairs(documents, key, text, threshold)
    links = pairs.select(F.explode(F.array("key_a", "key_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return exact_classes(documents, key, text).join(links, "class_id", "left").select(key, "class_id", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def near_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of class representatives (key_a, key_b, shared, jaccard); with exact_classes()
    they say which documents are near duplicates without listing pairs of copies."""
    rows = documents.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    # Equal texts have one hash, so their copies are one candidate; different texts of one hash
    # would be candidates together.
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("doc"))
    firsts = _table(rows.groupBy("doc").agg(F.min("key").alias("key")).select(F.xxhash64("key").alias("doc")), _documents, 1)
    rows = rows.filter(_listed(firsts)(F.xxhash64("key")))
    found = _cut(_candidates(rows, threshold))
    wanted = _table(found.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")), _documents, 1)
    rows = rows.filter(_listed(wanted)(F.col("doc"))).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # Units are taken where the text is read and pass the shuffle in its place; behind it they
    # are a plain column, which the grams address by position.
    rows = tx.with_nfkc(rows, "text").select("key", "doc", "digest", tx.unit_tokens(F.col("text")).alias("tokens"))
    reps = rows.groupBy("doc", "digest").agg(F.min("key").alias("key"), F.any_value("tokens").alias("tokens"))
    # Grams travel as 64-bit hashes; a collision within one pair of texts would need 2^-64.
    sets = reps.select("key", "doc", tx.five_grams(F.col("tokens")).alias("grams"))
    sets = sets.select("key", "doc", F.transform("grams", lambda g: F.xxhash64(g)).alias("grams"))
    sets = _cut(sets.withColumn("size", F.size("grams")).filter(F.col("size") >= MIN_GRAMS))
    both = found.join(sets.toDF("key_1", "doc_a", "grams_a", "size_a"), "doc_a").join(sets.toDF("key_2", "doc_b", "grams_b", "size_b"), "doc_b")
    both = both.filter(F.col("key_1") != F.col("key_2")).withColumn("shared", F.size(F.array_intersect("grams_a", "grams_b")))
    jaccard = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    both = both.withColumn("jaccard", jaccard).filter(F.col("jaccard") >= threshold)
    return both.select(F.least("key_1", "key_2").alias("key_a"), F.greatest("key_1", "key_2").alias("key_b"), F.col("shared").cast("bigint").alias("shared"), F.round("jaccard", 4).alias("jaccard"))


def _candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """doc_a, doc_b: hashes of the texts in `rows` (doc, text) that may reach the threshold."""
    units = _units(rows.select("doc", "text"))
    hashed = units.select("doc", F.transform("units", lambda u: F.xxhash64(F.lower(u))).alias("units"))
    counts = _table(hashed.select("units"), _grams, 2)
    prefix = hashed.mapInArrow(_prefixes(counts, threshold), "gram bigint, doc bigint, size int, place int")
    a, b = prefix.toDF("gram", "doc_a", "size_a", "place_a"), prefix.toDF("gram", "doc_b", "size_b", "place_b")
    total = F.col("size_a") + F.col("size_b")
    more = F.floor(total / GRAMS_A_SHARED)
    # J = s / (total - s), and of the shared grams at most `more` come before this one.
    enough = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + more >= total * (threshold / (1 + threshold)) - 1e-6
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold - 1e-6
    met = a.join(b, "gram").filter((F.col("doc_a") < F.col("doc_b")) & fits & enough).select("doc_a", "doc_b", total.alias("total"))
    met = met.groupBy("doc_a", "doc_b", "total").agg(F.count("*").alias("shared"))
    return met.filter(F.col("shared") > F.floor(F.col("total") / GRAMS_A_SHARED)).select("doc_a", "doc_b").distinct()


def _units(rows: DataFrame) -> DataFrame:
    """doc, units: tx.unit_tokens() of the texts in NFKC, for the whole table. White space is left
    as it is, as no unit holds any, and what only some texts need is looked for in those that may
    need it."""

    @F.pandas_udf("string")
    def changed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))

    wide = lambda t: F.octet_length(t) != F.length(t)
    text = F.col("text")
    rows = rows.select("doc", F.coalesce(changed(F.when(wide(text), text)), text).alias("text"))
    rows = rows.select("doc", F.when(text.contains("["), F.regexp_replace(text, rf"\[\d{{4,}}\]{tx.SPACE}*", "")).otherwise(text).alias("text"))
    rows = rows.select("doc", "text", (wide(text) & text.rlike(tx.CJK)).alias("cjk"))
    words = F.regexp_extract_all(F.when(F.col("cjk"), F.regexp_replace(text, tx.CJK, " ")).otherwise(text), F.lit(tx.UNIT_WORD), F.lit(0))
    signs = F.when(F.col("cjk"), F.regexp_extract_all(text, F.lit(tx.CJK), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc", F.concat(signs, words).alias("units"))


def _windows(units: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every run of five in the rows of `units` (hashes)."""
    ends = units.offsets.to_numpy()
    values = units.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].view(np.uint64)
    row = np.repeat(np.arange(len(units)), np.diff(ends))
    last = max(0, len(values) - GRAM + 1)
    h = values[:last].copy()
    for k in range(1, GRAM):
        h = h * MIX_A + values[k : last + k]
    h = (h ^ (h >> np.uint64(32))) * MIX_B
    h ^= h >> np.uint64(32)
    inside = row[:last] == row[len(row) - last :]
    return row[:last][inside], h[inside]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, first = batch.column("units").offsets.to_numpy(), 0
        while first < len(batch):
            last = int(np.searchsorted(ends, ends[first] + UNITS, "right")) - 1
            last = max(first + 1, min(last, first + ROWS))
            yield batch.slice(first, last - first)
            first = last


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    return (_windows(x.column("units"))[1] for x in _pieces(batches))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    return (x.column("doc").to_numpy(zero_copy_only=False).view(np.uint64) for x in batches)


def _bucket(hashes: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.uint32)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is planned and run inside go when it ends, not when the driver
    happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _cut(df: DataFrame) -> DataFrame:
    with _shuffles_dropped(df.sparkSession):
        return cut(df.select("*"))


class _Table:
    """How often hashes fall into buckets; packed as long as nothing asks."""

    def __init__(self) -> None:
        self.packed: dict[int, tuple[bytes, bytes]] = {}

    @cached_property
    def counts(self) -> np.ndarray:
        """A byte for each bucket that keeps the order of the counts; 0 and 1 are exact."""
        return self._whole(0, BUCKETS)

    @cached_property
    def bits(self) -> np.ndarray:
        return self._whole(1, FINE_BUCKETS // 8)

    def _whole(self, k: int, size: int) -> np.ndarray:
        out = np.zeros(size, np.uint8)
        for part, x in self.packed.items():
            out[part * (size // PARTS) : (part + 1) * (size // PARTS)] = np.frombuffer(zlib.decompress(x[k]), np.uint8)
        return out

    def count(self, hashes: np.ndarray) -> np.ndarray:
        return self.counts[_bucket(hashes)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the fine bucket of each hash got as many as the table was asked for."""
        ids = _bucket(hashes, FINE_BITS)
        return (self.bits[ids >> 3] >> (ids & 7).astype(np.uint8) & 1).astype(bool)


def _merged(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.concatenate(ids), np.concatenate(counts)
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(n, first)


def _packed(ids: np.ndarray) -> bytes:
    """Distinct numbers in their order as gaps, bytes of 255 going on."""
    gaps = np.diff(ids.astype(np.int64), prepend=0)
    out = np.full(len(gaps) + int((gaps // 255).sum()), 255, np.uint8)
    out[np.cumsum(gaps // 255 + 1) - 1] = gaps % 255
    return zlib.compress(out.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    gaps = np.frombuffer(zlib.decompress(blob), np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 255]


def _table(df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], least: int) -> Broadcast:
    """How often the hashes of `df` fall into each bucket, and whether `least` times into each
    fine one, as a broadcast _Table. Lists, of which `least` is 1, have no counts."""

    def rows(ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.searchsorted(ids, np.arange(PARTS + 1, dtype=np.int64) * FINE_PART)
        for k in np.flatnonzero(np.diff(ends)):
            own = slice(ends[k], ends[k + 1])
            n = zlib.compress(np.minimum(counts[own], 0xFFFF).astype("<u2").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(ids[own] - k * FINE_PART)], pa.binary()), pa.array([n], pa.binary())], ["part", "ids", "counts"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for h in hashes(batches):
            at, n = np.unique(_bucket(h, FINE_BITS), return_counts=True)
            ids, counts = [*ids, at], [*counts, n]
            if sum(map(len, ids)) > 2 * GATHERED:
                at, n = _merged(ids, counts)
                ids, counts = [at], [n]
                if len(at) > GATHERED:
                    yield from rows(at, n)
                    ids, counts = [at[:0]], [n[:0]]
        if any(map(len, ids)):
            yield from rows(*_merged(ids, counts))

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(FINE_PART, np.int64)
        for ids, n in zip(parts["ids"], parts["counts"], strict=True):
            counts[_unpacked(ids)] += np.frombuffer(zlib.decompress(n), "<u2")
        bits = np.packbits(counts >= least, bitorder="little")
        counts = counts.reshape(-1, FINE).sum(1) * (least > 1)
        high = EXACT_COUNTS + 8 * np.log2(np.maximum(counts, EXACT_COUNTS) / EXACT_COUNTS)
        counts = np.where(counts < EXACT_COUNTS, counts, np.minimum(high, 0xFF)).astype(np.uint8)
        return pd.DataFrame({"part": parts["part"].iloc[:1], "counts": [zlib.compress(counts.tobytes(), 1)], "bits": [zlib.compress(bits.tobytes(), 1)]})

    out = _Table()
    with _shuffles_dropped(df.sparkSession):
        parts = df.mapInArrow(counted, "part int, ids binary, counts binary").groupBy("part").applyInPandas(added, "part int, counts binary, bits binary")
        for r in parts.collect():
            out.packed[r.part] = bytes(r.counts), bytes(r.bits)
    return df.sparkSession.sparkContext.broadcast(out)


def _listed(table: Broadcast) -> Callable[[Column], Column]:
    """Whether a hash may be among those counted in `table`."""

    @F.pandas_udf("boolean")
    def listed(hashes: pd.Series) -> pd.Series:
        return pd.Series(table.value.has(hashes.to_numpy().view(np.uint64)))

    return listed


def _prefixes(counts: Broadcast, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The prefixes of texts (doc, units): gram, doc, the text's size, the gram's place from 0.
    A gram that is alone in its fine bucket takes a place but meets nothing, so it is left out."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            row, h = _windows(batch.column("units"))
            # Row, count and the first 42 bits of the hash in one number sort fastest.
            at = row.astype(np.uint64) << np.uint64(50) | counts.value.count(h).astype(np.uint64) << np.uint64(42) | h >> np.uint64(22)
            order = np.argsort(at)
            if ((at[order][1:] == at[order][:-1]) & (h[order][1:] != h[order][:-1])).any():
                order = np.lexsort((h, at))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            row, h = row[new], h[new]
            size = np.bincount(row, minlength=len(batch))
            place = np.arange(len(h)) - (np.cumsum(size) - size)[row]
            # As many as any size of a partner asks for; one more, as both numbers are rounded.
            places = size - np.ceil(size * threshold - 1e-6) + 2 + size * (1 + threshold) // GRAMS_A_SHARED
            kept = np.flatnonzero((place < places[row]) & (size[row] >= MIN_GRAMS))
            kept = kept[counts.value.has(h[kept])]
            row = row[kept]
            docs = batch.column("doc").to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(h[kept].view(np.int64)), pa.array(docs), pa.array(size[row], pa.int32()), pa.array(place[kept], pa.int32())], ["gram", "doc", "size", "place"])

    return prefixes
