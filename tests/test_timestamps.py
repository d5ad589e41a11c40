from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from inkwell.operators import timestamps

FEEDS = [("mue", "Europe/Berlin", "dmy"), ("alx", "America/New_York", "mdy"), ("tyo", "Asia/Tokyo", "ymd"), ("blr", "Asia/Kolkata", "dmy")]


def keys(spark, rows):
    """rows: (raw, kind, feed)."""
    values = spark.createDataFrame([("response", i, "f", k, r, f) for i, (r, k, f) in enumerate(rows)], "rec string, rec_id bigint, field string, kind string, raw string, feed string")
    feeds = spark.createDataFrame(FEEDS, "feed string, zone_name string, day_order string")
    return [(r.utc_key, r.why) for r in timestamps.normalise(values, feeds).orderBy("rec_id").collect()]


DAYS = [
    ("20200131", "mue", "20200131"), (" 20200131 ", "mue", "20200131"), ("２０２００１３１", None, "20200131"), ("20200131Z", "mue", "20200131"),
    ("2020-01-31T23:59:00-05:00", "alx", "20200131"), ("31.01.20", "mue", "20200131"), ("1/31/20", "alx", "20200131"), ("2/3/2020", "alx", "20200203"),
    ("2/3/2020", "mue", "20200302"), ("2/3/2020", None, None), ("31/1/2020", None, "20200131"), ("31/1/2020", "alx", "20200131"), ("4/4/2020", None, "20200404"),
    ("2020/1/3", None, "20200103"), ("2020 01 03", "alx", "20200103"), ("2020年1月3日", None, "20200103"), ("2020-031", None, "20200131"), ("2020-366", None, "20201231"),
    ("2021-366", None, None), ("2020-W53-7", None, "20210103"), ("2021-W53-1", None, None), ("2021-W01-1", None, "20210104"), ("2 de enero de 2020", None, "20200102"),
    ("3. März 2020", None, "20200303"), ("21 février 2020", None, "20200221"), ("June 2nd, 2020", None, "20200602"), ("Sept 2, 2020", None, "20200902"), ("07-FEB-2020", None, "20200207"),
    ("2020", "mue", None), ("2020-01", "mue", None), ("00000000", "mue", None), ("20200231", "mue", None), ("2020-00-12", "mue", None), ("", "mue", None), (None, "mue", None),
    ("n/a", "mue", None), ("31 Foo 2020", None, None), ("20-01-02", "tyo", "20200102"), ("x" * 5000, "mue", None),
]


@pytest.mark.parametrize("chunk", [DAYS])
def test_days(spark, chunk):
    got = keys(spark, [(raw, "day", feed) for raw, feed, _ in chunk])
    assert [(c[0], c[1], k) for c, (k, _) in zip(chunk, got)] == [tuple(c) for c in chunk]


INSTANTS = [
    ("2020-01-31T10:00:00.123456Z", "mue", "2020-01-31T10:00:00.123456Z", "canonical"), ("2020-01-31 10:00", "mue", "2020-01-31T09:00:00.000000Z", "ok"),
    ("2020-07-31T10:00:00,5", "mue", "2020-07-31T08:00:00.500000Z", "ok"), ("2020-03-29T02:30:00", "mue", None, "skipped"), ("2020-10-25 02:30:00", "mue", None, "twice"),
    ("2020-10-25 02:30:00 CEST", "mue", "2020-10-25T00:30:00.000000Z", "ok"), ("2020-10-25 02:30:00 CET", "mue", "2020-10-25T01:30:00.000000Z", "ok"),
    ("2020-10-25T02:30:00+01:00[Europe/Berlin]", None, "2020-10-25T01:30:00.000000Z", "ok"), ("2020-01-31T10:00:00[Asia/Tokyo]", None, "2020-01-31T01:00:00.000000Z", "ok"),
    ("2020-01-31T10:00:00", None, None, "no_zone"), ("2020-01-31 10:00:00 IST", "blr", "2020-01-31T04:30:00.000000Z", "ok"), ("2020-01-31 10:00:00 IST", "mue", None, "skipped"),
    ("Fri, 31 Jan 2020 10:00:00 -0500", None, "2020-01-31T15:00:00.000000Z", "ok"), ("Fri, 31 Jan 2020 10:00:00 GMT", "tyo", "2020-01-31T10:00:00.000000Z", "ok"),
    ("1/31/2020 12:05:06 AM", "alx", "2020-01-31T05:05:06.000000Z", "ok"), ("Jan 31, 2020 1:05:06 PM", "alx", "2020-01-31T18:05:06.000000Z", "ok"), ("1580464800", None, "2020-01-31T10:00:00.000000Z", "ok"),
    ("1580464800123", "mue", "2020-01-31T10:00:00.123000Z", "ok"), ("20200131100000", "mue", "2020-01-31T09:00:00.000000Z", "ok"), ("20200131T100000Z", "mue", "2020-01-31T10:00:00.000000Z", "ok"),
    ("31.01.2020, 10.00.00", "mue", "2020-01-31T09:00:00.000000Z", "ok"), ("2020-01-31T10:00:00.123456789+00:00", "mue", "2020-01-31T10:00:00.123456Z", "ok"), ("2020-01-31T25:00:00Z", "mue", None, "unreadable"),
    ("never", "mue", None, "unreadable"), ("2020-01-31", "mue", None, "unreadable"), (None, "mue", None, "empty"), ("", None, None, "empty"), ("2020-01-31T10:00:00[No/Zone]", "mue", None, "no_zone"),
]


def test_instants(spark):
    got = keys(spark, [(raw, "instant", feed) for raw, feed, _, _ in INSTANTS])
    assert [(c[0], *g) for c, g in zip(INSTANTS, got)] == [(c[0], c[2], c[3]) for c in INSTANTS]


def test_offsets_against_the_zone_database(spark):
    feeds = {f: z for f, z, _ in FEEDS}
    rows, expected = [], []
    for feed, zone in feeds.items():
        z = ZoneInfo(zone)
        for step in range(0, 365 * 24, 37):
            local = dt.datetime(2021, 1, 1) + dt.timedelta(hours=step, minutes=30)
            fits = {
                local.replace(tzinfo=z, fold=k).utcoffset()
                for k in (0, 1)
                if local.replace(tzinfo=z, fold=k).astimezone(dt.timezone.utc).astimezone(z).replace(tzinfo=None) == local
            }
            rows.append((local.strftime("%Y-%m-%dT%H:%M:%S"), "instant", feed))
            expected.append((local - fits.pop()).strftime("%Y-%m-%dT%H:%M:%S.000000Z") if len(fits) == 1 else None)
    assert [k for k, _ in keys(spark, rows)] == expected


def test_years_before_and_after_the_intervals(spark):
    """Local mean time, wars, and years far ahead come out as the zone database has them."""
    rows, expected = [], []
    for feed, zone in {f: z for f, z, _ in FEEDS}.items():
        z = ZoneInfo(zone)
        for year in (1000, 1701, 1839, 1840, 1899, 1920, 1945, 1969, 2099, 2100, 2130, 2131, 2200, 2296, 2397, 2400, 9998):
            for month, day, hour in ((1, 1, 0), (3, 27, 2), (4, 8, 12), (7, 15, 9), (10, 27, 2), (11, 2, 1), (12, 31, 23)):
                local = dt.datetime(year, month, day, hour, 30)
                fits = {
                    local.replace(tzinfo=z, fold=k).utcoffset()
                    for k in (0, 1)
                    if local.replace(tzinfo=z, fold=k).astimezone(dt.timezone.utc).astimezone(z).replace(tzinfo=None) == local
                }
                rows.append((local.isoformat(), "instant", feed))
                expected.append(f"{local - fits.pop():%Y-%m-%dT%H:%M:%S.000000Z}".zfill(27) if len(fits) == 1 else None)
    got = [k for k, _ in keys(spark, rows)]
    assert [(r[0], r[2], a) for r, a in zip(rows, got)] == [(r[0], r[2], b) for r, b in zip(rows, expected)]


def test_the_sessions_zone_does_not_matter(spark):
    rows = [("2020-12-31 23:30", "instant", "mue"), ("1.1.2021", "day", "mue"), ("2021-01-01T00:30:00+14:00", "instant", None)]
    expected = keys(spark, rows)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        assert keys(spark, rows) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [k for k, _ in expected] == ["2020-12-31T22:30:00.000000Z", "20210101", "2020-12-31T10:30:00.000000Z"]


def test_tables(spark):
    responses = spark.createDataFrame(
        [(1, "mue", "31.01.2020", "20200130", None, "x"), (2, None, None, "2/3/2020", "", "y"), (1, "mue", "31.01.2020", "20200130", None, "x")],
        "response_id bigint, feed string, publication_date string, application_date string, last_successful_fetch_at string, zone string",
    )
    claims = spark.createDataFrame([(7, 1, "1.2.2020", "z"), (8, 9, "2020-05-01", "z")], "claim_id bigint, response_id bigint, date string, t_zone string")
    feeds = spark.createDataFrame(FEEDS, "feed string, zone_name string, day_order string")
    got = sorted({tuple(r) for r in timestamps.found(responses.dropDuplicates(), claims, feeds).collect()})
    assert got == [("priority", 7, "date", "20200201"), ("priority", 8, "date", "20200501"), ("response", 1, "publication_date", "20200131")]
    assert timestamps.found(responses.limit(0), claims.limit(0), feeds).count() == 0
