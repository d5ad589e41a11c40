"""Lines of documents under their section headings, and measures of the parts.

Rows stay long (file, sequence, part, text); a heading carries forward to the lines after it
by a window over the file, and the five parts are pivoted only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as tx

PARTS = ["abstract", "abstract_drawing", "description", "description_drawings", "claims", "unclassified"]
# Parts whose words count as document text and those of drawings.
DOCUMENT_PARTS = ["abstract", "description", "claims"]
DRAWING_PARTS = ["abstract_drawing", "description_drawings"]
CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}


def lines(pages: DataFrame, file_key: str, page: str, text: str = "text") -> DataFrame:
    """One row for each non-blank line: file_key, page, line_no, line (collapsed). Running
    lines and pages that are search reports are left out."""
    rows = pages.filter(F.col(text).isNotNull() & ~tx.has_search_report(F.col(text)))
    rows = rows.select(file_key, page, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", tx.collapsed(F.col("line")))
    return rows.filter((F.col("line") != "") & ~tx.is_running_line(F.col("line")))


def sectioned(rows: DataFrame, file_key: str, order: list[str], line: str = "line", keep_headings: bool = False) -> DataFrame:
    """Adds part (that of the last heading before, over pages; `unclassified` before the
    first), is_heading and segment (number of headings so far). Heading rows are dropped
    unless `keep_headings`."""
    before = Window.partitionBy(file_key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = tx.with_nfkc(rows.withColumn("_own", F.col(line)), "_own")  # full-width headings and digits
    rows = rows.withColumn("_own", tx.heading_part(F.col("_own")))
    rows = rows.withColumn("part", F.coalesce(F.last("_own", ignorenulls=True).over(before), F.lit("unclassified")))
    rows = rows.withColumn("segment", F.sum(F.col("_own").isNotNull().cast("int")).over(before)).withColumn("is_heading", F.col("_own").isNotNull()).drop("_own")
    return rows if keep_headings else rows.filter(~F.col("is_heading"))


def joined(rows: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """keys and text: the texts of a group in order, joined by spaces; blank ones are left out."""
    rows = rows.filter(F.trim(F.col(text)) != "")
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: F.trim(p["_t"])), " ").alias(text))


def merged_method(method: Column) -> Column:
    """Aggregate: `none` without any, the one method, else `mixed`."""
    used = F.collect_set(F.when(method != "none", method))
    return F.when(F.size(used) == 0, "none").when(F.size(used) == 1, F.element_at(used, 1)).otherwise("mixed")


def lowest_confidence(confidence: Column) -> Column:
    """Aggregate: the lowest of those that are not `none`."""
    rank = F.min(F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE_RANK.items() for x in kv]), confidence))
    names = F.create_map(*[F.lit(x) for k, v in CONFIDENCE_RANK.items() for x in (v, k)])
    return F.coalesce(F.element_at(names, rank), F.lit("none"))


def measured(drafts: DataFrame, file_key: str = "file_id", seq: str = "draft_id") -> DataFrame:
    """Drafts (file, part, seq, text, status, method, confidence) measured by file and part:
    words (of the text in NFKC), status, method, confidence. The last writer of a status is the
    last draft with text, as blank ones write nothing; without any it is the last draft."""
    filled = F.trim(F.coalesce(F.col("text"), F.lit(""))) != ""
    drafts = tx.with_nfkc(drafts, "text")
    d = drafts.withColumn("_words", F.coalesce(tx.count_units(F.col("text")), F.lit(0))).withColumn("_filled", filled)
    return d.groupBy(file_key, "part").agg(
        F.sum("_words").alias("word_count"),
        F.max_by("status", F.struct(F.col("_filled").cast("int"), F.col(seq))).alias("status"),
        merged_method(F.when(F.col("_filled"), F.coalesce("method", F.lit("none"))).otherwise(F.lit("none"))).alias("method"),
        lowest_confidence(F.when(F.col("_filled"), F.coalesce("confidence", F.lit("none"))).otherwise(F.lit("none"))).alias("confidence"),
    )


def by_file(parts: DataFrame, warnings: DataFrame | None = None, file_key: str = "file_id") -> DataFrame:
    """The five parts of each file side by side, with document, drawing and total words and a
    status: failed if no part has text, partial if the file has warnings (file_key,
    warnings), else success."""
    words = lambda p: F.coalesce(F.sum(F.when(F.col("part") == p, F.col("word_count"))), F.lit(0))
    many = lambda ps: sum((words(p) for p in ps), F.lit(0))
    out = parts.groupBy(file_key).agg(
        *(words(p).alias(f"{p}_words") for p in PARTS),
        (many(DOCUMENT_PARTS) + words("unclassified")).alias("document_text_words"),
        many(DRAWING_PARTS).alias("drawing_words"),
        F.max(~F.col("status").isin("missing", "error")).alias("_any"),
    )
    if warnings is not None:
        out = out.join(warnings.select(file_key, "warnings"), file_key, "left")
    else:
        out = out.withColumn("warnings", F.lit(0))
    out = out.withColumn("total_words", F.col("document_text_words") + F.col("drawing_words"))
    status = F.when(~F.col("_any"), "failed").when(F.coalesce("warnings", F.lit(0)) > 0, "partial").otherwise("success")
    return out.withColumn("file_status", status).drop("_any", "warnings")


def rolled_up(files: DataFrame, keys: list[str]) -> DataFrame:
    """Seven sums over files and one status: success or failed if all are, else partial."""
    sums = [F.sum(f"{p}_words").alias(f"{p}_words") for p in PARTS] + [F.sum("total_words").alias("total_words"), F.count("*").alias("files")]
    all_of = lambda s: F.min((F.col("file_status") == s).cast("int")) == 1
    return files.groupBy(*keys).agg(*sums, F.when(all_of("success"), "success").when(all_of("failed"), "failed").otherwise("partial").alias("status"))


def marked_errors(parts: DataFrame, errors: DataFrame, file_key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """`parts` as by measured() and `errors` (file_key, part, message): (parts, warnings). A part
    without words takes the status `error` (method ocr, confidence none), one with words stays;
    either way the error is a warning: file_key, warnings (how many), messages in order."""
    hit = errors.select(file_key, "part").distinct().withColumn("_hit", F.lit(True))
    rows = parts.join(hit, [file_key, "part"], "full")
    lost = F.col("_hit").isNotNull() & (F.coalesce("word_count", F.lit(0)) == 0)
    marks = {"status": "error", "method": "ocr", "confidence": "none"}
    rows = rows.select(file_key, "part", F.coalesce("word_count", F.lit(0)).alias("word_count"), *(F.when(lost, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in marks.items()))
    return rows, errors.groupBy(file_key).agg(F.count("*").alias("warnings"), F.array_sort(F.collect_list("message")).alias("messages"))


def downgraded(files: DataFrame, pairs: DataFrame, key: str = "file_id") -> DataFrame:
    """`files` with file_status `partial` in place of `success` where the file is one of a pair
    of duplicates (key_a, key_b); counts stay."""
    twins = pairs.select(F.explode(F.array("key_a", "key_b")).alias(key)).distinct().withColumn("_twin", F.lit(True))
    rows = files.join(twins, key, "left")
    return rows.withColumn("file_status", F.when(F.col("_twin").isNotNull() & (F.col("file_status") == "success"), "partial").otherwise(F.col("file_status"))).drop("_twin")


def cover_parts(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds abstract and figure_text of a cover page: the abstract is what follows the first
    abstract marker, up to the second or to another heading; figure text is taken from the
    lines between the last (54) line and the marker."""
    # Fixed value: the marker of an abstract on a cover.
    marker = r"(?i)(?:^|\n)\s*(?:\(?57\)?\s*)?(?:abstract|zusammenfassung|abr[eé]g[eé]|resumen|resumo|реферат|摘要|要約|초록|ملخص)\s*[:：]?\s*"
    pieces = F.split(F.col(text), marker)
    body = F.transform(F.split(F.get(pieces, F.lit(1)), "\n"), lambda x: F.trim(x))
    stop = F.array_position(F.transform(body, lambda x: F.coalesce(tx.heading_part(x).isin("abstract_drawing", "description", "claims", "description_drawings"), F.lit(False))), True)
    kept = F.when(stop > 0, F.slice(body, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(body)
    abstract = F.array_join(F.filter(kept, lambda x: (x != "") & ~tx.is_running_line(x)), " ")
    region = F.element_at(F.split(F.get(pieces, F.lit(0)), r"(?m)^\s*\(?54\)?\b.*$"), -1)
    figures = F.array_join(F.filter(F.transform(F.split(region, "\n"), lambda x: F.trim(x)), tx.figure_like), " ")
    has = F.size(pieces) > 1
    return pages.withColumn("abstract", F.when(has, abstract).otherwise("")).withColumn("figure_text", F.when(has, figures).otherwise(""))
