import datetime as dt

import pytest
from pyspark.sql import functions as F

from castweave.operators import timestamps as T

UTC = dt.UTC
SCHEMA = "parse_id long, podcast_id long, published_at string, duration_raw string, feed_timezone string, fetched_at timestamp, wall string"


def ms(*parts):
    return int(dt.datetime(*parts, tzinfo=UTC).timestamp() * 1000)


CASES = [
    ("2017-08-03T19:16:41Z", None, ms(2017, 8, 3, 19, 16, 41)),
    ("Sat, 08 Nov 2014 11:45:06 +0900", None, ms(2014, 11, 8, 2, 45, 6)),
    ("WED APR 27 17:10:54 UTC+05:45 2016", "Asia/Kathmandu", ms(2016, 4, 27, 11, 25, 54)),
    ("2016-03-18 12:53", "Europe/Berlin", ms(2016, 3, 18, 11, 53)),
    ("18.03.2016 12:53", "Europe/Berlin", ms(2016, 3, 18, 11, 53)),
    ("11/17/2019 00:15", "Europe/Berlin", ms(2019, 11, 16, 23, 15)),
    ("02/03/2016 12:53", "Europe/Berlin", None),  # two readings
    ("05/05/2016 12:00", "UTC", ms(2016, 5, 5, 12)),  # both orders are one day
    ("15. Juni 2025 18:09", "Europe/Berlin", ms(2025, 6, 15, 16, 9)),
    ("14 novembre 2014 01:15", "America/Chicago", ms(2014, 11, 14, 7, 15)),
    ("Dec 25, 2022 2:10 a.m.", "Asia/Kathmandu", ms(2022, 12, 24, 20, 25)),
    ("Nov 13, 2025 12:56 PM", "UTC", ms(2025, 11, 13, 12, 56)),
    ("20180413T102459Z", None, ms(2018, 4, 13, 10, 24, 59)),
    ("1535163450752", None, 1535163450752),
    ("1684858880", None, 1684858880000),
    ("1635345630105000", None, 1635345630105),
    ("2012-04-22T10:52:39,19+10:00", None, ms(2012, 4, 22, 0, 52, 39) + 190),
    ("2022-08-10T20:39:40-07:00[America/Phoenix]", None, ms(2022, 8, 11, 3, 39, 40)),
    ("2015-04-30 15:33:00 America/Phoenix", None, ms(2015, 4, 30, 22, 33)),
    ("Mon, 11 Aug 2014 09:44:16 IST", "Asia/Kolkata", ms(2014, 8, 11, 4, 14, 16)),
    ("26 March 2017 03:28 BST", "Europe/London", ms(2017, 3, 26, 2, 28)),
    ("14 May 2026 10:51 MST", None, ms(2026, 5, 14, 17, 51)),
    ("Sat, 22 Oct 22 12:24:19 +0200", None, ms(2022, 10, 22, 10, 24, 19)),
    ("2016-12-06", "Asia/Tokyo", ms(2016, 12, 5, 15)),
    ("2016-12-06", None, None),  # local time without a zone
    ("2021-03-28 01:13:00", "Europe/London", None),  # never happened there
    ("2020-10-25 01:05", "Europe/London", None),  # happened twice
    ("2023-02-30T10:00:00Z", None, None),
    ("2022-06-14T25:10:00Z", None, None),
    ("0000-00-00 00:00:00", "UTC", None),
    ("yesterday", "UTC", None),
    ("", "UTC", None),
    (None, None, None),
    ("x" * 100_000, "UTC", None),
    ("2016-12-06 10:00:00", "Not/AZone", None),
]


def test_readings(spark):
    rows = [(i, i, text, None, zone, None, "clash") for i, (text, zone, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.parse_id: r.value_ms for r in T.found_times(df).collect() if r.field == "published_at"}
    for i, (text, _, wanted) in enumerate(CASES):
        assert got.get(i) == wanted, text


def test_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1, 1, "2016-03-18 12:53", None, "Europe/Berlin", None, "")], SCHEMA)
        assert T.found_times(df).first().value_ms == ms(2016, 3, 18, 11, 53)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("00:29:22", 1_762_000), ("30:33", 1_833_000), ("146:53", 8_813_000), ("1:75:20", None), ("10:75", None), ("1799", 1_799_000),
     ("3533.75", 3_533_750), ("0:14:01,900", 841_900), ("P0DT1H8M52S", 4_132_000), ("PT20M0S", 1_200_000), ("PT", None), ("P", None),
     ("1103082 ms", 1_103_082), ("22 min 6 sec", 1_326_000), ("1 hr 35 min", 5_700_000), ("31 mins.", 1_860_000), ("2921s", 2_921_000),
     (" 03:01:47 ", 10_907_000), ("-1", None), ("about an hour", None), ("NaN", None), ("--:--", None), ("", None), (None, None), ("0", 0)],
)
def test_durations(spark, raw, wanted):
    df = spark.createDataFrame([(raw,)], "d string")
    assert df.select(T.duration_ms(F.col("d"))).first()[0] == wanted


def test_estimated_zone(spark):
    """A feed without zone that is fetched within minutes reveals its offset history, summer time included."""
    rows = []
    for i in range(40):
        utc = dt.datetime(2020, 1 + i % 12, 3, 12, i, tzinfo=UTC)
        local = utc.astimezone(__import__("zoneinfo").ZoneInfo("America/Denver"))
        rows.append((i, 7, local.strftime("%Y-%m-%d %H:%M:%S"), None, None, utc + dt.timedelta(minutes=3 + i % 5), ""))
    df = spark.createDataFrame(rows, SCHEMA)
    out = T.normalise_times(df, "parse_id", "published_at", "feed_timezone", "podcast_id", "fetched_at")
    assert {r.basis for r in out.collect()} == {"estimated"}
    assert out.where("parse_id = 0").first().value_ms == ms(2020, 1, 3, 12, 0)
    assert T.found_times(df).count() == 0


def test_empty_and_repeated(spark):
    assert T.found_times(spark.createDataFrame([], SCHEMA)).count() == 0
    row = (1, 1, "1684858880", "10", None, None, "")
    assert T.found_times(spark.createDataFrame([row, row], SCHEMA)).count() == 2


def test_withheld_zones_are_estimated(spark):
    """Feeds fetched within the hour: at least nine of ten instants of a withheld zone come out right, late fetches or not."""
    import random
    import zoneinfo

    rng = random.Random(8)
    rows, want = [], {}
    zones = ["Asia/Tehran", "Asia/Karachi", "Asia/Yangon", "America/New_York", "Europe/Berlin", "Australia/Sydney", "America/Caracas", "Asia/Kathmandu", "UTC", "Pacific/Auckland"]
    for feed, zone in enumerate(zones):
        for k in range(60):
            at = dt.datetime(2023, 1, 1, tzinfo=UTC) + dt.timedelta(days=6 * k, minutes=rng.randrange(1440))
            late = dt.timedelta(days=40) if k % 13 == 0 else dt.timedelta(minutes=rng.randrange(1, 50))
            key = 100 * feed + k
            rows.append((key, feed, at.astimezone(zoneinfo.ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), None, None, at + late, "clash"))
            want[key] = int(at.timestamp() * 1000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.parse_id: r for r in T.normalise_times(df, "parse_id", "published_at", "feed_timezone", "podcast_id", "fetched_at").collect()}
    assert len(got) == len(rows) and {r.basis for r in got.values()} <= {"estimated", "none"}
    assert sum(got[k].value_ms == v for k, v in want.items()) >= 0.9 * len(want)


def test_histories_are_distinct_and_whole():
    names = T.offset_histories(2015, 2024)
    assert 60 < len(names) < 300
    offsets = {dt.datetime(2024, 1, 9, 12, tzinfo=UTC).astimezone(__import__("zoneinfo").ZoneInfo(n)).utcoffset() for n in names}
    assert {dt.timedelta(hours=h) for h in (3.5, 4.5, 5, 6, 6.5)} <= offsets


def test_abbreviation_with_two_offsets(spark):
    df = spark.createDataFrame([(1, 1, "2010-07-01 12:00 MSK", None, "Europe/Moscow", None, ""), (2, 1, "2012-01-01 12:00 MSK", None, "Europe/Moscow", None, "")], SCHEMA)
    read = T.read_times(df, "published_at", "feed_timezone").select("parse_id", T.instant_ms().alias("ms"))
    assert {r.parse_id: r.ms for r in read.collect()}[2] == ms(2012, 1, 1, 8)
