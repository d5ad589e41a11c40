"""Queries of the llm operators: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import addresses, confusables, language_id, mixing, names, ocr, packing, pii
from inkwell.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.found(table(spark, sf_dir, "lookup_responses"), table(spark, sf_dir, "party_names"))


def p3_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.looks(confusables.stacked(table(spark, sf_dir, "lookup_responses"), table(spark, sf_dir, "party_names")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.found(
        table(spark, sf_dir, "lookup_responses"), table(spark, sf_dir, "ocr_pages"), table(spark, sf_dir, "documents")
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.found(table(spark, sf_dir, "ocr_pages"), table(spark, sf_dir, "part_drafts"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.found(table(spark, sf_dir, "representatives"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(table(spark, sf_dir, "party_names"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked(table(spark, sf_dir, "party_names"))


def p2_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.probed(table(spark, sf_dir, "party_names"))


def p6_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.probed(table(spark, sf_dir, "representatives"))


def p6_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.buildings(table(spark, sf_dir, "representatives"))


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_bins"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_packs(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_masked(table(spark, sf_dir, "documents"), "text", "masked").select("doc_id", "masked")


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.repaired_texts(ocr.stacked(table(spark, sf_dir, "ocr_pages"), table(spark, sf_dir, "part_drafts"))).select("rec", "rec_id", "repaired")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_entities, p2_probe, p3_found, p3_looks, p4_found, p4_texts, p6_found, p6_buildings, p6_probe, p7_found, p8_packs, p8_fill, p9_mix, p9_shares, p10_found, p10_masked)
}
ORACLE_SQL: dict[str, str] = {}
