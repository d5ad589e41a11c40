from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkwell.functions import identifiers as ids


def number(spark, raw, source=None):
    return spark.createDataFrame([(raw,)], "x string").select(ids.normalized_number(F.col("x"), source).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "source", "normalized", "lookup", "kind"),
    [
        ("US20210184727A1", "epo", "US2021184727A1", "US2021184727", "publication"),
        ("EP 25 188 322.9", None, "EP25188322.9", "EP25188322", "application"),
        ("EP25188322", None, "EP25188322", "EP25188322", "application"),
        ("ep-1234567-b1", None, "EP1234567B1", "EP1234567.B1", "publication"),
        ("wo/2025/076543", None, "WO2025076543", "WO2025076543", "publication"),
        ("WO 2025 076543 A1", None, "WO2025076543A1", "WO2025076543A1", "publication"),
        ("PCT AT 2025 060357", None, "PCTAT2025060357", "AT2025060357", "publication"),
        ("PCT/AT2025/060357", "wipo", "PCTAT2025060357", "AT2025060357", "publication"),
    ],
)
def test_understood(spark, raw, source, normalized, lookup, kind):
    r = number(spark, raw, source)
    assert (r.normalized_number, r.lookup_number, r.reference_type, r.error_code) == (normalized, lookup, kind, None)


@pytest.mark.parametrize("raw", ["", "  ", None, "123456", "WO/26/137030", "EPABC", "PCT/X", "中文"])
def test_invalid(spark, raw):
    assert number(spark, raw).error_code == "invalid_patent_number_format"


def test_other_source(spark):
    assert number(spark, "US1234567A1").error_code == "unsupported_jurisdiction"
    assert number(spark, "EP1234567A1", "wipo").error_code == "unsupported_jurisdiction"


def test_keys(spark):
    row = spark.createDataFrame([("wo/2025-07 é",)], "x string").select(ids.alias_key("x").alias("a"), ids.compact_number(F.col("x")).alias("c")).first()
    assert (row.a, row.c) == ("WO202507", "WO202507É")
