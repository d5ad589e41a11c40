"""Dates and instants in mixed formats, precisions and zones, brought to one form.

A value is split into fields by one regular expression for each family of formats, so the
whole parse stays in the JVM. What is left open by the value itself (digit order, zone of a
local time, meaning of a zone abbreviation) is settled by the feed of its row:

* digit order: `feeds.day_order`, used only where the digits alone leave it open;
* zone: an as-of join of local times to the zone's offset intervals. The intervals are
  exploded by calendar year and gathered per (zone, year), so a value meets exactly one
  array and needs no shuffle. Two matching intervals mean an ambiguous time, none a skipped
  one, exactly one gives the offset.

Defined results: null, empty, partial and impossible values give null; a local time without
zone and without feed gives null; values may carry any amount of surrounding white space and
full-width digits; repeated rows give repeated results; an empty table gives an empty one.
The input's other columns are never touched, whatever their names.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and short forms in the languages of the feeds.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene janeiro",
    2: "february feb februar février fevrier févr fevr febrero fevereiro fev",
    3: "march mar märz maerz mrz mars marzo março marco",
    4: "april apr avril avr abril abr",
    5: "may mai mayo maio",
    6: "june jun juni juin junio junho",
    7: "july jul juli juillet juil julio julho",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre set setembro",
    10: "october oct oktober okt octobre octubre outubro out",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez décembre decembre déc diciembre dic dezembro",
}

SEP = "\u0001"
#: Years of the offset intervals. No zone had another offset before the first one; after the last
#: one rules repeat with the calendar, so a later year takes the intervals of a like one of ALIKE.
FIRST_YEAR, LAST_YEAR = 1840, 2130
ALIKE = range(2101, 2131)

#: Pattern and the numbers of its groups for year, month, day, hour, minute, second, fraction,
#: half of day, zone. A month may be a name. First match wins.
_TIME = r"(?:(?:T|\s|,\s*)\s*(\d{1,2})[:.h](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?[Mm]\.?)?)?"
_ZONE = r"\s*((?:Z|z|[+-]\d{2}:?\d{2}|[A-Z]{2,5})?(?:\[[A-Za-z0-9_+/-]+\])?)"
_WEEKDAY = r"(?:\p{L}{2,10}\.?,\s+)?"
_FORMS = [
    # 20200131, 20200131Z, 20200131T101112Z, 20200131101112
    ("ymd", rf"(\d{{4}})(\d{{2}})(\d{{2}})(?:T?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?()?)?{_ZONE}", "123456789"),
    # 2020-01-31, 2020/1/3, 2020.01.31, 2020 01 31, 2020年1月31日, 2020년 1월 31일
    ("ymd", rf"(\d{{4}})\s*[-/. 年년]\s*(\d{{1,2}})\s*[-/. 月월]\s*(\d{{1,2}})\s*[日일]?{_TIME}{_ZONE}", "123456789"),
    # 31.01.2020, 1/31/20: the order is settled later
    ("open", rf"(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_TIME}{_ZONE}", "123456789"),
    # 31 January 2020, 31. Januar 2020, 31 de enero de 2020, 31-JAN-2020, Fri, 31 Jan 2020
    ("dmy", rf"{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th|er|º|\.)?[-\s]*(?:de\s+)?(\p{{L}}{{3,}})\.?[-,\s]*(?:de\s+)?(\d{{4}}){_TIME}{_ZONE}", "321456789"),
    # January 31, 2020, Jan 31st 2020
    ("mdy", rf"{_WEEKDAY}(\p{{L}}{{3,}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_TIME}{_ZONE}", "312456789"),
    # 2020-W05-5
    ("week", rf"(\d{{4}})-?W(\d{{2}})-?([1-7]){_TIME}{_ZONE}", "123456789"),
    # 2020-031
    ("ordinal", rf"(\d{{4}})-(\d{{3}})(){_TIME}{_ZONE}", "123456789"),
]


def _cleaned(value: Column) -> Column:
    wide = "０１２３４５６７８９／－：．，＋"
    text = F.translate(value, wide + " 　   ", "0123456789/-:.,+     ")
    return F.trim(F.regexp_replace(text, r"[\s​﻿]+", " "))


def _fields(text: Column) -> Column:
    """Array of ten strings: form, year, month, day, hour, minute, second, fraction, half,
    zone; null if no form fits."""
    out = F.lit(None).cast("array<string>")
    for name, pattern, groups in reversed(_FORMS):
        whole = f"^{pattern}$"
        template = SEP.join([name, *(f"${g}" for g in groups)])
        out = F.when(text.rlike(whole), F.split(F.regexp_replace(text, whole, template), SEP)).otherwise(out)
    return out


def _number(x: Column) -> Column:
    return x.try_cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, null if there is none."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, zero, zero, zero).cast("date")


def parsed(rows: DataFrame, value: str, day_order: str) -> DataFrame:
    """`rows` with t_text (the cleaned value), t_day (date), t_local_us and t_zone; the last
    three are null where the value is no full date or has no time. t_local_us: microseconds of
    the local clock reading since 1970 as if it were UTC. t_zone: the zone as written."""
    rows = rows.withColumn("t_text", _cleaned(F.col(value)))
    # A step of its own: the optimiser then evaluates the patterns once, not once per field.
    rows = rows.withColumn("t_f", _fields(F.col("t_text")))
    f = F.col("t_f")
    rows = rows.select(
        "*",
        f[0].alias("t_form"),
        _number(f[1]).alias("t_a"),
        F.coalesce(_number(f[2]), F.element_at(_months(), F.lower(f[2]))).alias("t_b"),
        _number(f[3]).alias("t_c"),
        (F.length(f[3]) == 2).alias("t_short"),
        f[9].alias("t_zone"),
        _local_time(f).alias("t_time_us"),
    ).drop("t_f")
    form, a, b, c, short, order = (F.col(x) for x in ("t_form", "t_a", "t_b", "t_c", "t_short", day_order))
    # In the open form a and b are day and month in some order and c is the year; with ymd and
    # three groups of two digits the year comes first.
    year_first = short & (F.coalesce(order, F.lit("ymd")) == "ymd")
    settled = (
        F.when(form != "open", F.lit("ymd"))
        .when(year_first, F.when(order == "ymd", F.lit("yy")))
        .when((a > 12) & (b <= 12) | (a == b), F.lit("dmy"))
        .when((b > 12) & (a <= 12), F.lit("mdy"))
        .otherwise(F.when(order != "ymd", order))
    )
    rows = rows.withColumn("t_order", settled)
    order = F.col("t_order")
    full = F.when(short, c + 2000).otherwise(c)
    plain = (
        F.when(order == "ymd", _date(a, b, c))
        .when(order == "yy", _date(a + 2000, b, c))
        .when(order == "dmy", _date(full, b, a))
        .when(order == "mdy", _date(full, a, b))
    )
    one = F.lit(1)
    fourth = _date(a, one, F.lit(4))
    monday = F.date_sub(fourth, F.weekday(fourth))
    # Week 53 exists only where that week's Thursday still lies in the year.
    week = F.when((b >= 1) & (F.year(F.date_add(monday, (b - 1) * 7 + 3)) == a), F.date_add(monday, (b - 1) * 7 + c - 1))
    nth = F.date_add(_date(a, one, one), b - 1)
    ordinal = F.when((b >= 1) & (F.year(nth) == a), nth)
    day = F.when(form == "week", week).when(form == "ordinal", ordinal).otherwise(plain)
    rows = rows.withColumn("t_day", day)
    midnight = F.datediff("t_day", F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
    rows = rows.withColumn("t_local_us", midnight + F.col("t_time_us"))
    return rows.drop("t_form", "t_a", "t_b", "t_c", "t_short", "t_order", "t_time_us")


def _local_time(f: Column) -> Column:
    """Microseconds of the day, null if there is no time or an impossible one."""
    half = F.lower(F.substring(f[8], 1, 1))
    hour = _number(f[4])
    hour = (
        F.when(half == "", hour)
        .when(hour.between(1, 12) & (half == "a"), hour % 12)
        .when(hour.between(1, 12) & (half == "p"), hour % 12 + 12)
    )
    minute = _number(f[5])
    second = F.when(f[6] == "", F.lit(0)).otherwise(_number(f[6]))
    micro = _number(F.substring(F.rpad(f[7], 6, "0"), 1, 6))
    good = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    return F.when(good, ((hour * 60 + minute) * 60 + second).cast("long") * 1_000_000 + micro)


def _months() -> Column:
    return F.create_map(*[F.lit(x) for n, words in MONTHS.items() for w in words.split() for x in (w, n)])


def _new_year(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def _day_of(us: Column) -> Column:
    """The date of microseconds since 1970, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int"))


def _stamp(us: Column) -> Column:
    rest = F.pmod(us, F.lit(86_400_000_000))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    hour, minute, second = F.floor(rest / 3_600_000_000), F.pmod(F.floor(rest / 60_000_000), F.lit(60)), F.pmod(F.floor(rest / 1_000_000), F.lit(60))
    micro = F.lpad(F.pmod(rest, F.lit(1_000_000)).cast("string"), 6, "0")
    return F.concat(_day_of(us).cast("string"), F.lit("T"), two(hour), F.lit(":"), two(minute), F.lit(":"), two(second), F.lit("."), micro, F.lit("Z"))


def _interval_year(year: Column) -> Column:
    """The year whose intervals hold for a local year: one that begins on the same weekday and
    has as many days, where it lies after all of them."""
    like = {}
    for y in ALIKE:
        leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
        like.setdefault((7 if leap else 0) + dt.date(y, 1, 1).weekday(), y)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    kind = F.when(leap, 7).otherwise(0) + F.weekday(_new_year(year))
    later = F.get(F.array(*(F.lit(like[k]) for k in range(14))), kind)
    return F.when(year > LAST_YEAR, later).otherwise(F.greatest(year, F.lit(FIRST_YEAR)))


def offset_intervals(zones: DataFrame) -> DataFrame:
    """For each zone name in the one column of `zones`: its offset intervals, exploded by the
    local years they touch and gathered per (zone, local_year).

    intervals: array of struct(start_s, end_s of the local clock, offset_s, abbr). Names that
    are no zones give no rows. Bounded by the zone database: below 600 zones times 290 years.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for z in batch.iloc[:, 0].dropna() for r in _zone_years(z)]
            yield pd.DataFrame(rows, columns=["zone", "local_year", "start_s", "end_s", "offset_s", "abbr"])

    flat = zones.mapInPandas(build, "zone string, local_year int, start_s long, end_s long, offset_s long, abbr string")
    return flat.groupBy("zone", "local_year").agg(
        F.collect_list(F.struct("start_s", "end_s", "offset_s", "abbr")).alias("intervals")
    )


def _zone_years(name: str) -> list[tuple]:
    try:
        zone = ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return []
    utc = dt.timezone.utc

    def state(t: int) -> tuple[int, str]:
        x = dt.datetime.fromtimestamp(t, utc).astimezone(zone)
        return int(x.utcoffset().total_seconds()), x.tzname()

    begin = int(dt.datetime(FIRST_YEAR, 1, 1, tzinfo=utc).timestamp()) - 86400
    end = int(dt.datetime(LAST_YEAR + 1, 1, 1, tzinfo=utc).timestamp()) + 86400
    step, spans = 7 * 86400, []
    start, now = begin, state(begin)
    for t in range(begin + step, end + step, step):
        after = state(t)
        if after == now:
            continue
        low, high = t - step, t
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if state(mid) == now else (low, mid)
        spans.append((start, high, *now))
        start, now = high, after
    spans.append((start, end, *now))
    out = []
    for a, b, offset, abbr in spans:
        first = max(FIRST_YEAR, dt.datetime.fromtimestamp(a + offset, utc).year)
        last = min(LAST_YEAR, dt.datetime.fromtimestamp(b + offset - 1, utc).year)
        if a == begin:
            a = -(10**12)  # for all years before
        out += [(name, y, a + offset, b + offset, offset, abbr) for y in range(first, last + 1)]
    return out


def normalise(values: DataFrame, feeds: DataFrame) -> DataFrame:
    """`values` has rec, rec_id, field, kind (`day` or `instant`), raw, feed; `feeds` has feed,
    zone_name, day_order. Adds utc_key (null if the value denotes no single day or instant)
    and why: ok, canonical, empty, unreadable, no_zone, skipped, twice.
    """
    feeds = feeds.select("feed", "zone_name", "day_order").dropDuplicates(["feed"])
    rows = values.join(F.broadcast(feeds), "feed", "left")  # a feed table has a fixed, small size
    rows = parsed(rows, "raw", "day_order")
    text = F.col("t_text")
    epoch = F.when(text.rlike(r"^\d{10}$"), text.cast("long") * 1_000_000).when(
        text.rlike(r"^\d{13}$"), text.cast("long") * 1000
    )
    zone = F.col("t_zone")
    named = F.nullif(F.regexp_extract(zone, r"\[(.+)\]$", 1), F.lit(""))
    bare = F.regexp_replace(zone, r"\[.*$", "")
    digits = F.regexp_replace(bare, ":", "")
    stated = (
        F.when(F.upper(bare).isin("Z", "UTC", "GMT", "UT"), F.lit(0))
        .when(
            digits.rlike(r"^[+-](0\d|1[0-5])[0-5]\d$"),
            (F.substring(digits, 2, 2).cast("int") * 3600 + F.substring(digits, 4, 2).cast("int") * 60)
            * F.when(digits.startswith("-"), -1).otherwise(1),
        )
    )
    instant = F.col("kind") == "instant"
    rows = (
        rows.withColumn("epoch_us", F.when(instant, epoch))
        .withColumn("stated_s", F.when(instant, stated))
        .withColumn("abbr_given", F.when(instant & stated.isNull(), F.nullif(bare, F.lit(""))))
        .withColumn("local_us", F.when(instant, F.col("t_local_us")))
        .withColumn("at_zone", F.when(F.col("local_us").isNotNull() & F.col("stated_s").isNull(), F.coalesce(named, F.col("zone_name"))))
        .withColumn("local_year", F.year(_day_of(F.col("local_us"))))
        .withColumn("at_year", _interval_year(F.col("local_year")))
    )
    bracketed = values.filter(F.col("kind") == "instant").select(
        F.nullif(F.regexp_extract("raw", r"\[([A-Za-z0-9_+/-]+)\]\s*$", 1), F.lit("")).alias("zone")
    )
    zones = feeds.select(F.col("zone_name").alias("zone")).union(bracketed.filter("zone is not null")).distinct()
    table = offset_intervals(zones).withColumnRenamed("local_year", "interval_year")
    rows = rows.join(
        F.broadcast(table),  # bounded by the zone database, see offset_intervals
        (rows["at_zone"] == table["zone"]) & (rows["at_year"] == table["interval_year"]),
        "left",
    )
    # Local seconds in the year whose intervals count.
    shift = F.when(F.col("local_year") > LAST_YEAR, F.datediff(_new_year(F.col("local_year")), _new_year(F.col("at_year"))).cast("long") * 86_400).otherwise(F.lit(0))
    rows = rows.withColumn("local_s", F.floor(F.col("local_us") / 1_000_000) - shift)
    local_s = F.col("local_s")
    hits = F.filter(
        "intervals",
        lambda i: (i["start_s"] <= local_s)
        & (local_s < i["end_s"])
        & (F.col("abbr_given").isNull() | (i["abbr"] == F.col("abbr_given"))),
    )
    rows = rows.withColumn("hits", hits)
    one = F.when(F.size("hits") == 1, F.element_at("hits", 1)["offset_s"])
    offset = F.coalesce(F.col("stated_s").cast("long"), one)
    us = F.coalesce(F.col("epoch_us"), F.col("local_us") - offset * 1_000_000)
    stamp = _stamp(us)
    day = F.date_format("t_day", "yyyyMMdd")
    rows = rows.withColumn("utc_key", F.when(instant, stamp).otherwise(day))
    why = (
        F.when(F.col("raw").isNull() | (text == ""), "empty")
        .when(F.col("utc_key") == F.col("raw"), "canonical")
        .when(F.col("utc_key").isNotNull(), "ok")
        .when(F.col("local_us").isNull() | ~instant, "unreadable")
        .when(F.col("at_zone").isNull() | F.col("zone").isNull(), "no_zone")
        .when(F.size("hits") == 0, "skipped")
        .otherwise("twice")
    )
    return rows.withColumn("why", why).select("rec", "rec_id", "field", "kind", "raw", "feed", "utc_key", "why")


def stacked(responses: DataFrame, claims: DataFrame) -> DataFrame:
    """The date and fetch values of both tables as rows for normalise()."""
    of_responses = responses.select(
        F.lit("response").alias("rec"),
        F.col("response_id").alias("rec_id"),
        "feed",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(c).alias("field"), F.lit(k).alias("kind"), F.col(c).alias("raw"))
                    for c, k in (("publication_date", "day"), ("application_date", "day"), ("last_successful_fetch_at", "instant"))
                )
            )
        ).alias("v"),
    ).select("rec", "rec_id", "v.field", "v.kind", "v.raw", "feed")
    of_claims = claims.select("claim_id", "response_id", "date").join(
        responses.select("response_id", "feed"), "response_id", "left"
    ).select(
        F.lit("priority").alias("rec"),
        F.col("claim_id").alias("rec_id"),
        F.lit("date").alias("field"),
        F.lit("day").alias("kind"),
        F.col("date").alias("raw"),
        "feed",
    )
    return of_responses.unionByName(of_claims)


def found(responses: DataFrame, claims: DataFrame, feeds: DataFrame) -> DataFrame:
    """Rows (rec, rec_id, field, utc_key) of the values that are not canonical yet and denote
    exactly one day or instant; distinct as the ids are unique."""
    rows = normalise(stacked(responses, claims).filter(F.col("raw").isNotNull()), feeds)
    return rows.filter(F.col("why") == "ok").select("rec", "rec_id", "field", "utc_key")
