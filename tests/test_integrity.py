from __future__ import annotations

import base64
import hashlib
import hmac

from pyspark.sql import functions as F

from inkwell.functions import integrity


def test_hmac_and_receipts(spark):
    for key in (b"k", b"x" * 100):
        row = spark.createDataFrame([("a message, ünicode",)], "m string").select(integrity.hmac_sha256(key, F.col("m")).alias("h")).first()
        assert bytes(row.h) == hmac.new(key, "a message, ünicode".encode(), hashlib.sha256).digest()
    df = spark.createDataFrame([("x" * 200,)], "m string").withColumn("r", integrity.signed(b"k", "lookup", F.lit(1000), F.struct("m")))
    r = df.first().r
    payload, signature = r.split(".")
    assert "\n" not in r and "=" not in r
    assert signature == base64.urlsafe_b64encode(hmac.new(b"k", payload.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()
    check = lambda key, purpose, now, ttl=60, c="r": df.select(integrity.verified(key, purpose, F.col(c), F.lit(now), ttl).alias("y")).first().y
    assert check(b"k", "lookup", 1060) and check(b"k", "lookup", 940)
    assert not check(b"k", "lookup", 1061) and not check(b"k", "lookup", 939)
    assert not check(b"q", "lookup", 1000) and not check(b"k", "analysis", 1000) and not check(b"k", "lookup", 1000, c="m")


def test_dates(spark):
    rows = spark.createDataFrame([("20200131",), ("2020",), (None,)], "d string").select(integrity.iso_date(F.col("d")).alias("y")).collect()
    assert [r.y for r in rows] == ["2020-01-31", "2020", None]
