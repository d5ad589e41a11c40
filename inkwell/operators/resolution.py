"""Which of several answers counts: ordered candidates, fallbacks between sources, related
publications.

Each rule is a rank, so one aggregate with map-side combine decides for all requests at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcomes after which the next candidate or source may be tried.
NEXT_CANDIDATE = ["no_result"]
NEXT_SOURCE = ["rate_limit", "unavailable", "invalid"]
# Document codes of a publication in order of preference.
PUBLICATION_CODES = ["PAMPH", "APBDY", "PUB", "A1", "A2"]
ORIGINAL_CODES = ["PAMPH", "PUB", "A1", "A2"]  # of the older service


def first_hit(requests: DataFrame, candidates: str, answers: DataFrame, key: str) -> DataFrame:
    """`requests` has key and an array of candidates; `answers` has candidate, outcome,
    payload. Rows key, candidate, outcome, payload, attempts: the first answer that is no
    `no_result`, else the last; attempts counts the candidates up to it."""
    tried = requests.select(key, F.posexplode(candidates).alias("pos", "candidate")).join(answers, "candidate", "left")
    tried = tried.withColumn("outcome", F.coalesce("outcome", F.lit("no_result")))
    ends = ~F.col("outcome").isin(*NEXT_CANDIDATE)
    order = F.struct(F.when(ends, 0).otherwise(1), F.when(ends, F.col("pos")).otherwise(-F.col("pos")))
    return tried.groupBy(key).agg(F.min_by(F.struct("candidate", "outcome", "payload", (F.col("pos") + 1).alias("attempts")), order).alias("r")).select(key, "r.*")


def with_fallback(primary: DataFrame, second: DataFrame, key: str, when: list[str]) -> DataFrame:
    """`primary` and `second` have key, outcome, payload. The second source counts only where
    the first one's outcome is in `when` and the second is ok; adds source (1 or 2)."""
    other = second.filter("outcome = 'ok'").select(key, F.col("payload").alias("_payload"))
    rows = primary.join(other, key, "left")
    take = F.col("outcome").isin(*when) & F.col("_payload").isNotNull()
    return rows.select(
        key, F.when(take, "ok").otherwise(F.col("outcome")).alias("outcome"), F.when(take, F.col("_payload")).otherwise(F.col("payload")).alias("payload"), F.when(take, 2).otherwise(1).alias("source")
    )


def code_rank(code: Column, codes: list[str] = PUBLICATION_CODES) -> Column:
    """Rank of a document code; unknown codes come last."""
    table = F.create_map(*[F.lit(x) for i, c in enumerate(codes) for x in (c, i)])
    return F.coalesce(F.element_at(table, F.upper(code)), F.lit(len(codes)))


def publication_documents(documents: DataFrame, key: str, codes: list[str] = PUBLICATION_CODES) -> DataFrame:
    """Of each key's documents (document_id, document_code, pos) the publication: by code, then
    by position; of equal (document_id, document_code) the last one counts."""
    last = documents.groupBy(key, "document_id", "document_code").agg(F.max("pos").alias("pos"))
    picked = last.groupBy(key).agg(F.min_by(F.struct("document_id", "document_code", "pos"), F.struct(code_rank(F.col("document_code"), codes), "pos")).alias("d"))
    return picked.select(key, "d.*")


def related(members: DataFrame, key: str, number: str, own: list[str]) -> DataFrame:
    """key, related: distinct numbers of family members without the request's own spellings
    (columns `own`), compared without punctuation, in order of `pos`."""
    bare = lambda c: F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")
    rows = members.filter(F.col(number).isNotNull())
    for c in own:
        rows = rows.filter(bare(F.col(number)) != F.coalesce(bare(F.col(c)), F.lit("")))
    first = rows.groupBy(key, number).agg(F.min("pos").alias("pos"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", number))), lambda x: x[number]).alias("related"))


def starred(base: DataFrame, key: str, optional: dict[str, DataFrame]) -> DataFrame:
    """`base` with the columns of each optional table, and missing: names of those without a
    row, in order. A missing constituent is a warning, never an error."""
    rows = base
    for name, table in optional.items():
        rows = rows.join(table.withColumn(f"_has_{name}", F.lit(True)), key, "left")
    missing = F.filter(F.array(*(F.when(F.col(f"_has_{n}").isNull(), F.lit(n)) for n in optional)), lambda x: x.isNotNull())
    return rows.withColumn("missing", missing).drop(*(f"_has_{n}" for n in optional))
