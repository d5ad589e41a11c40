"""A collection in which every source has its target share of all tokens.

The total is the one asked for, or else the largest that no source has to exceed its repeats
for. With a total of its own a source that holds too little gives what it may and leaves the
rest open (`reached` tells how much); the other sources keep their quotas. The total is cut into
blocks of equally many tokens, which Sainte-Laguë apportionment (highest quotients share / (2k + 1))
gives to sources as integer quotas, and each source's quota to its shards in proportion to
their tokens. Within a shard documents stand in seeded order; the blocks of a quota are those
that come first, a whole round of the shard for every repeat before the next one begins.
A document is used as often as selected blocks begin in it, never more than its source's
`max_repeats`.

A source has one shard for every `SHARD_ROWS` documents, `SHARDS` at most, so no source is ever
ordered in one task and no more than that many rows of each source come to the driver. Defined
results: documents
without tokens or without a source in the targets are left out; a target without documents
gets nothing and the others' shares are taken relative to their sum; null or negative shares
count as 0 and null repeats as 1; repeated rows of one doc_id count as one document.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.tokens import TOKENIZER, with_size
from inkwell.session import cut

BLOCK = 1024  # tokens of a block
SHARD_ROWS = 50_000  # documents of a source in a shard, about
SHARDS = 4_096  # shards of a source at most
SEED = 7


def apportioned(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """Seats by Sainte-Laguë: the highest quotients weight / (2k + 1), ties by key. Most seats
    come from one divisor, the last few from a heap, so it takes no time for each seat."""
    caps = caps or {}
    live = {k: w for k, w in weights.items() if w > 0 and caps.get(k, 1) > 0}
    out = {k: 0 for k in weights}
    total = sum(live.values())
    if not live or seats <= 0:
        return out
    divisor = total / seats
    for k, w in live.items():
        out[k] = max(0, min(math.floor(w / divisor + 0.5) - 2, caps.get(k, seats)))
    left = seats - sum(out.values())
    heap = [(-w / (2 * out[k] + 1), str(k), k) for k, w in live.items()]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, name, k = heapq.heappop(heap)
        if out[k] >= caps.get(k, seats):
            continue
        out[k] += 1
        left -= 1
        heapq.heappush(heap, (-live[k] / (2 * out[k] + 1), name, k))
    return out


def mixed(sizes: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = SEED, total: int | None = None) -> DataFrame:
    """`sizes` has doc_id, source, tokens; `targets` has source, target_share, max_repeats (a
    small fixed table); `total` is the number of tokens asked for. Rows doc_id, source, tokens,
    uses (1 or more)."""
    spark = sizes.sparkSession
    sizes = cut(sizes.filter("tokens > 0 and source is not null").groupBy("doc_id").agg(F.max("source").alias("source"), F.max("tokens").alias("tokens")))
    wanted = {r.source: (max(0.0, r.target_share or 0.0), max(1, r.max_repeats or 1)) for r in targets.select("source", "target_share", "max_repeats").collect() if r.source is not None}
    # One row for each source.
    have = {r.source: r for r in sizes.filter(F.col("source").isin(*wanted) if wanted else F.lit(False)).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    shares = {s: wanted[s][0] for s in have if wanted[s][0] > 0}
    scale = sum(shares.values())
    caps = {s: have[s].tokens * wanted[s][1] // block for s in shares}
    if total is None:
        quotas = apportioned(shares, int(min((have[s].tokens * wanted[s][1] / (x / scale) for s, x in shares.items()), default=0) // block), caps)
    else:
        # Capped after the apportionment: what one source lacks is not given to the others.
        quotas = {s: min(n, caps[s]) for s, n in apportioned(shares, total // block).items()}

    shards = {s: min(SHARDS, max(1, -(-have[s].n // SHARD_ROWS))) for s in shares}
    plan = spark.createDataFrame([(s, shards[s]) for s in shares] or [("", 1)], "source string, shards int")
    rows = sizes.join(F.broadcast(plan), "source")
    rows = rows.withColumn("order", F.xxhash64("doc_id", F.lit(seed))).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("shards")).cast("int"))
    # One row for each shard, SHARDS of each source at most.
    held = rows.groupBy("source", "shard").agg(F.sum("tokens").alias("held")).collect()
    tasks = []
    for s in shares:
        mine = {r.shard: r.held for r in held if r.source == s}
        got = apportioned(mine, quotas[s], {k: n * wanted[s][1] // block for k, n in mine.items()})
        tasks += [(s, k, got[k] * block // n, got[k] * block % n) for k, n in mine.items()]
    # rounds: times every document of the shard is used; rest: tokens of the round begun.
    plan = spark.createDataFrame(tasks or [("", 0, 0, 0)], "source string, shard int, rounds long, rest long")
    ordered = Window.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("tokens").over(ordered), F.lit(0))).join(F.broadcast(plan), ["source", "shard"])
    # A document belongs to the blocks before the rest's end if its middle lies there, so what
    # a shard uses misses its quota by half a document either way.
    begun = (F.col("rest") > 0) & (F.col("before") + F.col("tokens") / 2 <= F.col("rest"))
    uses = F.col("rounds") + begun.cast("long")
    return rows.withColumn("uses", uses.cast("int")).filter("uses > 0").select("doc_id", "source", "tokens", "uses")


def reached(mix: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Rows source, target_share, actual_share, tokens, documents, most_uses, shortfall: the
    tokens that a source lacks of its share of `total` (of all tokens reached, if none was
    asked for), 0 if it lacks none."""
    per = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    out = targets.select("source", "target_share").join(per, "source", "left")
    out = out.withColumn("total", F.sum("tokens").over(Window.partitionBy()))  # one row a source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    asked = F.col("total") if total is None else F.lit(total)
    lacking = F.greatest(F.lit(0), F.coalesce(F.round(F.col("target_share") * asked).cast("bigint"), F.lit(0)) - F.coalesce("tokens", F.lit(0)))
    share = F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0))
    return out.select("source", "target_share", share.alias("actual_share"), zero("tokens"), zero("documents"), zero("most_uses"), lacking.alias("shortfall"))


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total: int | None = None) -> DataFrame:
    return mixed(with_size(documents, ["doc_id", "source"], path=tokenizer), targets, total=total)
