"""Recognised text: engines behind one protocol, words to lines, mean confidence, the first
engine that succeeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from inkwell.functions.text import confidence_band


@dataclass
class Recognised:
    """What an engine says of one image."""

    text: str = ""
    confidence: float | None = None
    language: str = ""
    provider: str = ""
    warnings: list[str] = field(default_factory=list)


class Engine(Protocol):
    """An engine is made once in each worker and gets the images of a batch."""

    def recognize(self, images: list[bytes], language: str) -> list[Recognised]: ...


RESULT = "text string, confidence double, language string, provider string, warnings array<string>"


def recognised(images: DataFrame, key: str, make_engine, language: str = "en", batch_size: int = 4) -> DataFrame:
    """`images` has key and content. Rows key and RESULT; an image on which the engine fails
    gives an empty text with the warning `ocr_failed`, never a failed job."""
    schema = f"{images.select(key).schema[key].name} {images.select(key).schema[key].dataType.simpleString()}, {RESULT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = make_engine()
        for batch in batches:
            content, out = batch.column("content").to_pylist(), []
            for k in range(0, len(content), batch_size):
                part = [c or b"" for c in content[k : k + batch_size]]
                try:
                    out += engine.recognize(part, language)
                except Exception:  # noqa: BLE001 - one bad image must not fail the others
                    for image in part:
                        try:
                            out += engine.recognize([image], language)
                        except Exception as e:  # noqa: BLE001
                            out.append(Recognised(language=language, warnings=[f"ocr_failed: {type(e).__name__}"]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), pa.array([r.text for r in out], pa.string()), pa.array([r.confidence for r in out], pa.float64()), pa.array([r.language for r in out], pa.string()),
                    pa.array([r.provider for r in out], pa.string()), pa.array([r.warnings for r in out], pa.list_(pa.string())),
                ],
                names=[key, "text", "confidence", "language", "provider", "warnings"],
            )

    return images.select(key, "content").mapInArrow(run, schema)


def lines_of_words(words: DataFrame, key: str) -> DataFrame:
    """`words` has key, page, block, paragraph, line, word, text, confidence. One row for each
    key: text (words joined to lines in order) and mean confidence of words that have one (a
    negative confidence means none)."""
    at = [key, "page", "block", "paragraph", "line"]
    filled = words.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    lines = filled.groupBy(*at).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: F.trim(w["text"])), " ").alias("line_text"),
        F.sum(F.when(F.col("confidence") >= 0, F.col("confidence"))).alias("sum"),
        F.count_if(F.col("confidence") >= 0).alias("n"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*at[1:], "line_text"))), lambda x: x["line_text"]), "\n")
    out = lines.groupBy(key).agg(joined.alias("text"), (F.sum("sum") / F.nullif(F.sum("n"), F.lit(0))).alias("confidence"))
    return out.withColumn("band", confidence_band(F.col("confidence")))


def first_success(attempts: DataFrame, key: str) -> DataFrame:
    """`attempts` has key, rank and RESULT. For each key the result of the first engine with
    text, else the last one's, with the warnings of the engines before it."""
    order = F.struct(F.when(F.trim("text") != "", 0).otherwise(1), F.when(F.trim("text") != "", F.col("rank")).otherwise(-F.col("rank")))
    picked = attempts.groupBy(key).agg(
        F.min_by(F.struct("rank", "text", "confidence", "language", "provider"), order).alias("r"), F.array_sort(F.collect_list(F.struct("rank", "warnings"))).alias("all")
    )
    before = F.filter("all", lambda w: w["rank"] <= F.col("r.rank"))
    warnings = F.array_distinct(F.flatten(F.transform(before, lambda w: F.coalesce(w["warnings"], F.array().cast("array<string>")))))
    return picked.select(key, "r.text", "r.confidence", "r.language", "r.provider", warnings.alias("warnings"))


def installed(wanted: Column, present: list[str], default: str = "eng") -> Column:
    """The wanted languages (array) that an engine has, in their order; its default if none."""
    both = F.array_intersect(wanted, F.array(*map(F.lit, present)) if present else F.array().cast("array<string>"))
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.lit(default)))


def diagnostics(results: DataFrame, name: str = "recognition") -> tuple[DataFrame, Observation]:
    """`results` (RESULT) unchanged, and counts that are there when an action has run over it:
    images, recognised, with_warnings, providers (sorted, distinct), mean confidence."""
    seen = Observation(name)
    return results.observe(
        seen, F.count(F.lit(1)).alias("images"), F.count_if(F.trim("text") != "").alias("recognised"), F.count_if(F.size("warnings") > 0).alias("with_warnings"),
        F.array_sort(F.collect_set("provider")).alias("providers"), F.avg("confidence").alias("confidence"),
    ), seen
