"""Checksums, keyed signatures and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # bytes of a SHA-256 block


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 as binary, composed of two digests."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > BLOCK else key
    key = key.ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))


def url_base64(data: Column) -> Column:
    """URL-safe base64 without padding and line breaks."""
    return F.translate(F.base64(data), "+/=\r\n", "-_")


def from_url_base64(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.unbase64(F.concat(plain, F.repeat(F.lit("="), (4 - F.length(plain) % 4) % 4)))


def signed(key: bytes, purpose: str, issued_at: Column, data: Column) -> Column:
    """`payload.signature` of a struct column: keys sorted, nulls kept, no spaces."""
    body = F.struct(data.alias("data"), issued_at.cast("bigint").alias("issued_at"), F.lit(purpose).alias("purpose"))
    payload = url_base64(F.to_json(body, {"ignoreNullFields": "false"}).cast("binary"))
    return F.concat(payload, F.lit("."), url_base64(hmac_sha256(key, payload)))


def verified(key: bytes, purpose: str, receipt: Column, now: Column, ttl_seconds: int) -> Column:
    """Whether a receipt has two parts, the right signature and purpose, and an age within the
    time limit; a clock may run ahead by a minute."""
    payload, signature = F.split_part(receipt, F.lit("."), F.lit(1)), F.split_part(receipt, F.lit("."), F.lit(2))
    body = from_url_base64(payload).cast("string")
    issued = F.get_json_object(body, "$.issued_at").cast("bigint")
    good = (
        receipt.rlike(r"^[^.]+\.[^.]+$")
        & (signature == url_base64(hmac_sha256(key, payload)))
        & (F.get_json_object(body, "$.purpose") == purpose)
        & (issued <= now + 60)
        & (now - issued <= ttl_seconds)
    )
    return F.coalesce(good, F.lit(False))


def iso_date(value: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD, anything else as it is."""
    return F.when(value.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2))).otherwise(value)


def iso_instant(at: Column) -> Column:
    """A timestamp as text in UTC, whatever the session's zone."""
    us = F.unix_micros(at.cast("timestamp"))
    rest = F.pmod(us, F.lit(86_400_000_000))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int")).cast("string")
    clock = F.concat(two(F.floor(rest / 3_600_000_000)), F.lit(":"), two(F.pmod(F.floor(rest / 60_000_000), F.lit(60))), F.lit(":"), two(F.pmod(F.floor(rest / 1_000_000), F.lit(60))))
    return F.concat(day, F.lit("T"), clock, F.lit("Z"))


def expires_at(now: Column, ttl_seconds: int) -> Column:
    """When what is kept from now on runs out, a minute at the least; null for null."""
    return iso_instant(F.timestamp_seconds(F.unix_seconds(now.cast("timestamp")) + max(ttl_seconds, 60)))


def bearer_matches(header: Column, key: str) -> Column:
    """Whether an authorisation header bears the key. Digests are compared, not the texts."""
    return F.coalesce(F.sha2(header, 256) == F.sha2(F.lit(f"Bearer {key}"), 256), F.lit(False))


def error_body(code: Column, message: Column, source: Column, details: Column | None = None) -> Column:
    """An error as JSON: {"error": {code, message, source, details}}."""
    inner = F.struct(code.alias("code"), message.alias("message"), source.alias("source"), (F.lit(None).cast("string") if details is None else details).alias("details"))
    return F.to_json(F.struct(inner.alias("error")), {"ignoreNullFields": "false"})
