"""Timestamps and lengths in mixed notations, precisions and zones, brought to one form.

Everything is built from column expressions: each notation is one anchored pattern that
rewrites the text to ``year|month|day|hour|minute|second|fraction|half|zone``, so a row costs
a few pattern tests and no Python. Instants come out as milliseconds since 1970-01-01 UTC.

Local times without a zone get the zone their feed states. Feeds that state none are estimated:
each offset history of the zone database is tried on all the feed's local times, and the one with
the fewest violations (published after it was fetched) wins, then the one that leaves the least
lag before fetching, where one late fetch counts little. The trial is aggregated per (feed,
candidate) before anything is compared, so a feed with a third of all rows is as cheap as any other.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castweave.runtime import cut

# Month names in the languages feeds use; the first three letters of English
# names and the usual abbreviations of the others are added by rule below.
MONTHS = {
    1: "january januar janvier enero gennaio janeiro januari jänner",
    2: "february februar février fevrier febrero febbraio fevereiro februari",
    3: "march märz maerz mars marzo março marco maart",
    4: "april avril abril aprile",
    5: "may mai mayo maggio maio mei",
    6: "june juni juin junio giugno junho",
    7: "july juli juillet julio luglio julho",
    8: "august août aout agosto augustus",
    9: "september septembre septiembre settembre setembro sept",
    10: "october oktober octobre octubre ottobre outubro okt",
    11: "november novembre noviembre novembro",
    12: "december dezember décembre decembre diciembre dicembre dezembro dez",
}
# Abbreviations that are read without a feed zone, in minutes east of UTC.
PLAIN_ZONES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
_UNIX_ZERO = "timestamp_ntz'1970-01-01 00:00:00'"
_YMD = r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_HALF = r"(?: ?([ap])\.?m\.?(?![a-z]))?"
_ZONE = r"(?: ?([^ ,].*))?"
_DOW = r"(?:\p{L}+\.?,? )?"
_MONTH = r"(\p{L}+)\.?"


def _month_table() -> dict[str, int]:
    table: dict[str, int] = {}
    for number, names in MONTHS.items():
        for name in names.split():
            table[name] = number
            if len(name) > 4:
                table.setdefault(name[:3], number)
                table.setdefault(name[:4], number)
    return table


def _patterns() -> list[tuple[str, str]]:
    """(pattern, replacement to ``y|m|d|H|M|S|fraction|half|zone``), tried in order."""
    return [
        (rf"^{_YMD}(?:[t ]{_CLOCK}{_HALF}{_ZONE})?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10"),
        (r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))? ?(z|[-+]\d.*)?)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
        (rf"^{_DOW}{_MONTH} (\d{{1,2}}) {_CLOCK} ?(.*?) ?(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
        (
            rf"^{_DOW}(\d{{1,2}})(?:\.|st|nd|rd|th|er)?[ -](?:de )?{_MONTH}[ -](?:de )?(\d{{4}}|\d{{2}})"
            rf"(?:,?(?: um| at| à| a las)? {_CLOCK}(?: uhr)?{_HALF}{_ZONE})?$",
            "$3|$2|$1|$4|$5|$6|$7|$8|$9",
        ),
        (
            rf"^{_DOW}{_MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,?(?: at)? {_CLOCK}{_HALF}{_ZONE})?$",
            "$3|$1|$2|$4|$5|$6|$7|$8|$9",
        ),
        (r"^(\d{4})年 ?(\d{1,2})月 ?(\d{1,2})日(?: ?(\d{1,2})[:時](\d{2})(?:[:分](\d{2})秒?)?分?)?$", "$1|$2|$3|$4|$5|$6|||"),
        (rf"^(\d{{1,2}})([./-])(\d{{1,2}})\2(\d{{4}})(?:,? {_CLOCK}{_HALF}{_ZONE})?$", "$4|#$1$2$3|0|$5|$6|$7|$8|$9|$10"),
    ]


def clean_text(value: Column) -> Column:
    """White space of any kind squeezed and stripped, lower case."""
    return F.lower(F.trim(F.regexp_replace(value, r"[\s   ﻿]+", " ")))


def _number(text: Column) -> Column:
    return text.try_cast("int")


def zone_names(spark: SparkSession) -> list[str]:
    """IANA zone names this session can convert (about 600, from the JVM's own table)."""
    names = spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds()
    return sorted(n for n in names if "/" in n and not n.startswith("SystemV") or n in ("UTC", "GMT"))


@lru_cache
def offset_histories(first_year: int, last_year: int) -> tuple[str, ...]:
    """One zone for every different history of offsets within the years, by rule from the installed zone database.

    Sampled on four days of every month; of zones with one history the smallest name stands for all.
    """
    days = [dt.datetime(y, m, d, 12, tzinfo=dt.UTC) for y in range(first_year, last_year + 1) for m in range(1, 13) for d in (1, 9, 17, 25)]
    seen: dict[tuple, str] = {}
    for name in sorted(zoneinfo.available_timezones()):
        if name == "UTC" or "/" in name and not name.startswith(("Etc/", "posix/", "right/", "SystemV/")):
            zone = zoneinfo.ZoneInfo(name)
            seen.setdefault(tuple(day.astimezone(zone).utcoffset() for day in days), name)
    return tuple(sorted(seen.values()))


@lru_cache
def zone_abbreviations() -> tuple[dict[str, int], tuple[str, ...]]:
    """``zone|abbreviation`` to minutes east of UTC where a zone used it with one offset since 2000, and those with more.

    Built by rule from the installed zone database, sampled on two days of every month.
    """
    seen: dict[str, set[int]] = {}
    days = [dt.datetime(y, m, d, 12, tzinfo=dt.UTC) for y in (2000, 2006, 2012, 2018, 2024, 2030) for m in range(1, 13) for d in (8, 22)]
    for name in zoneinfo.available_timezones():
        if "/" not in name or name.startswith(("Etc/", "posix/", "right/")):
            continue
        zone = zoneinfo.ZoneInfo(name)
        for day in days:
            local = day.astimezone(zone)
            if (abbr := local.tzname()) and abbr.isalpha():
                seen.setdefault(f"{name}|{abbr.lower()}", set()).add(int(local.utcoffset().total_seconds() // 60))
    return {k: min(v) for k, v in seen.items() if len(v) == 1}, tuple(sorted(k for k, v in seen.items() if len(v) > 1))


def _literal_map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain(*table.items())))


def parse_notation(value: Column) -> Column:
    """Text to ``y|m|d|H|M|S|fraction|half|zone`` or null where no notation fits."""
    text = clean_text(value)
    form = F.lit(None).cast("string")
    for pattern, target in reversed(_patterns()):
        form = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, target)).otherwise(form)
    return form


def _epoch_ms(text: Column) -> Column:
    digits = text.rlike(r"^\d+$")
    long = text.try_cast("long")
    size = F.length(text)
    return (
        F.when(digits & size.isin(9, 10), long * 1000)
        .when(digits & (size == 13), long)
        .when(digits & (size == 16), F.floor(long / 1000))
        .when(digits & (size == 19), F.floor(long / 1000000))
    )


def _wall(y, m, d, H, M, S) -> Column:
    stamp = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", y, m, d, H, M, S)
    ok = y.between(1, 9999) & m.between(1, 12) & d.between(1, 31) & H.between(0, 23) & M.between(0, 59) & S.between(0, 59)
    return F.when(ok, F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")).cast("string").try_cast("timestamp_ntz"))


def _ms(ntz: Column) -> Column:
    return F.timestamp_diff("SECOND", F.expr(_UNIX_ZERO), ntz) * 1000


def wall_to_ms(wall: Column, zone: Column) -> Column:
    """Wall time in an IANA zone to ms; null where it never occurs there or occurs twice."""
    utc = F.convert_timezone(zone, F.lit("UTC"), wall)
    there = lambda u: F.convert_timezone(F.lit("UTC"), zone, u)
    twice = F.lit(False)
    for minutes in (30, 60, 120, -30, -60, -120):
        twice = twice | (there(utc + F.expr(f"interval {minutes} minutes")) == wall)
    return F.when((there(utc) == wall) & ~twice, _ms(utc))


def read_times(df: DataFrame, value: str, zone: str) -> DataFrame:
    """Add ``wall`` (local time), ``offset_min``, ``zone_name``, ``millis`` and ``epoch_ms``.

    ``wall`` is null where the text states no possible date and time. ``offset_min`` is set by an
    explicit offset or an abbreviation, ``zone_name`` by a named zone or else by the feed.
    """
    spark = df.sparkSession
    zones = zone_names(spark)
    by_lower = {z.lower(): z for z in zones}
    text = clean_text(F.col(value))
    part = F.split(F.col("_form"), r"\|")
    out = df.withColumn("_form", parse_notation(F.col(value))).withColumn("epoch_ms", _epoch_ms(text))
    p = [F.nullif(F.trim(F.get(part, F.lit(i))), F.lit("")) for i in range(9)]
    month_text = p[1]
    numeric = month_text.startswith("#")
    first = _number(F.regexp_extract(month_text, r"^#(\d+)", 1))
    second = _number(F.regexp_extract(month_text, r"(\d+)$", 1))
    dotted = month_text.contains(".")
    # One reading: day first with points, the only possible order, or both orders the same day.
    day_first = dotted | (first > 12) | (first == second)
    month_first = ~dotted & (second > 12) & (first <= 12)
    year = _number(p[0])
    year = F.when(F.length(p[0]) == 2, year + F.when(year < 70, 2000).otherwise(1900)).otherwise(year)
    month = F.when(numeric, F.when(day_first, second).when(month_first, first)).otherwise(
        F.coalesce(_number(month_text), F.element_at(_literal_map(_month_table()), F.coalesce(month_text, F.lit(""))))
    )
    day = F.when(numeric, F.when(day_first, first).when(month_first, second)).otherwise(_number(p[2]))
    hour, half = F.coalesce(_number(p[3]), F.lit(0)), p[7]
    hour = (
        F.when(half.isNull(), hour)
        .when(~hour.between(1, 12), F.lit(99))
        .when(half == "p", hour % 12 + 12)
        .otherwise(hour % 12)
    )
    minute, second_ = F.coalesce(_number(p[4]), F.lit(0)), F.coalesce(_number(p[5]), F.lit(0))
    out = out.withColumns(
        {
            "wall": _wall(year, month, day, hour, minute, second_),
            "millis": F.coalesce(_number(F.rpad(F.substring(p[6], 1, 3), 3, "0")), F.lit(0)),
            "_zone": F.coalesce(p[8], F.lit("")),
        }
    )
    zone_text = F.col("_zone")
    offset = r"^(?:utc|gmt)?([-+])(\d{1,2}):?(\d{2})?(?:\[[^\]]*\])?$"
    off_h, off_m = _number(F.regexp_extract(zone_text, offset, 2)), F.coalesce(_number(F.regexp_extract(zone_text, offset, 3)), F.lit(0))
    minutes = (off_h * 60 + off_m) * F.when(F.regexp_extract(zone_text, offset, 1) == "-", -1).otherwise(1)
    explicit = F.when((off_h <= 14) & (off_m < 60), minutes)
    local = F.when(F.col(zone).isin(zones), F.col(zone))
    fixed, moved = zone_abbreviations()
    abbr = F.when(zone_text.isin("z", "ut", "utc", "gmt"), F.lit(0)).otherwise(
        F.coalesce(
            F.element_at(_literal_map(fixed), F.concat_ws("|", local, zone_text)),
            F.element_at(_literal_map(PLAIN_ZONES), zone_text),
        )
    )
    stated = zone_text != ""
    names = F.element_at(_literal_map(by_lower), F.regexp_replace(zone_text, r"^\[|\]$", ""))
    # An abbreviation that the feed's zone used with several offsets means the one in force at that wall time.
    names = F.coalesce(names, F.when(F.concat_ws("|", local, zone_text).isin(*moved), local))
    return out.withColumns(
        {
            "offset_min": F.when(stated, F.coalesce(explicit, abbr)),
            "zone_name": F.when(stated, names).otherwise(local),
            "zone_stated": stated,
        }
    ).drop("_form", "_zone")


def instant_ms() -> Column:
    """Instant of the columns of :func:`read_times` in ms: by offset, or by the zone stated; null where neither tells."""
    by_offset = F.when(F.col("offset_min").isNotNull(), _ms(F.col("wall")) - F.col("offset_min") * 60000)
    return F.coalesce(by_offset, wall_to_ms(F.col("wall"), F.col("zone_name"))) + F.col("millis")


def estimate_zones(read: DataFrame, feed: str, fetched: str, candidates: tuple[str, ...] | None = None) -> DataFrame:
    """Zone per feed whose local times state none: ``feed``, ``estimated_zone``, ``violations``, ``local_times``.

    Every offset history of the years the times lie in is tried (``candidates`` to try others). Fewest times after
    fetching win; ties go to the least summed logarithm of the lag, then to the zone's name. Feeds without such
    times, and times without ``fetched``, give no row.
    """
    open_ = read.where(
        F.col("wall").isNotNull() & F.col("zone_name").isNull() & ~F.col("zone_stated") & F.col(fetched).isNotNull()
    ).select(F.col(feed).alias("feed"), "wall", F.unix_millis(F.col(fetched).cast("timestamp")).alias("_fetched"))
    if candidates is None:
        years = open_.agg(F.min(F.year("wall")).alias("lo"), F.max(F.year("wall")).alias("hi")).first()
        # Before 1970 and after 2037 zones follow the rules of those years.
        candidates = offset_histories(*(min(max(y or 2000, 1970), 2037) for y in (years["lo"], years["hi"])))
    tried = open_.withColumn("zone", F.explode(F.array(*map(F.lit, candidates))))
    lag = F.col("_fetched") - _ms(F.convert_timezone(F.col("zone"), F.lit("UTC"), F.col("wall")))
    score = tried.groupBy("feed", "zone").agg(
        F.sum((lag < 0).cast("long")).alias("violations"),
        F.round(F.sum(F.log1p(F.abs(lag) / 60000)), 6).alias("_lag"),
        F.count(F.lit(1)).alias("local_times"),
    )
    best = score.groupBy("feed").agg(F.min(F.struct("violations", "_lag", "zone", "local_times")).alias("b"))
    return best.select(
        "feed", F.col("b.zone").alias("estimated_zone"), F.col("b.violations").alias("violations"), F.col("b.local_times").alias("local_times")
    )


def normalise_times(
    df: DataFrame, key: str, value: str, zone: str, feed: str, fetched: str, candidates: tuple[str, ...] | None = None
) -> DataFrame:
    """``key``, ``value_ms`` and ``basis`` of every row of ``df``.

    ``basis`` tells what the reading rests on: ``epoch``, ``offset``, ``zone``, ``estimated`` (the
    zone was estimated from the feed's fetch times) or ``none`` (null ``value_ms``: no text, no
    possible date and time, two readings, or a wall time that occurs twice or never). Empty input
    gives no rows; a repeated key is read row by row.
    """
    slim = df.select(key, value, zone, F.col(feed).alias("_feed"), F.col(fetched).alias("_fetched_at"))
    # Parsed once, read twice (zone trial and conversion); also keeps filters out of the parse.
    read = cut(
        read_times(slim, value, zone).select(
            key, "_feed", "_fetched_at", "epoch_ms", "wall", "millis", "offset_min", "zone_name", "zone_stated"
        )
    )
    zones = estimate_zones(read, "_feed", "_fetched_at", candidates)
    unstated = F.col("zone_name").isNull() & ~F.col("zone_stated")
    joined = read.join(zones, unstated & (F.col("_feed") == F.col("feed")), "left")
    by_offset = F.when(F.col("offset_min").isNotNull(), _ms(F.col("wall")) - F.col("offset_min") * 60000)
    by_zone = wall_to_ms(F.col("wall"), F.col("zone_name"))
    guessed = wall_to_ms(F.col("wall"), F.col("estimated_zone"))
    stamp = F.coalesce(by_offset, by_zone, guessed) + F.col("millis")
    basis = (
        F.when(F.col("epoch_ms").isNotNull(), "epoch")
        .when(by_offset.isNotNull(), "offset")
        .when(by_zone.isNotNull(), "zone")
        .when(guessed.isNotNull(), "estimated")
        .otherwise("none")
    )
    return joined.select(F.col(key), F.coalesce(F.col("epoch_ms"), stamp).cast("long").alias("value_ms"), basis.alias("basis"))


def duration_ms(value: Column) -> Column:
    """Length in ms, or null for text that states none, a negative one, or an impossible one."""
    text = clean_text(value)
    ms = lambda seconds: F.floor(seconds.cast("decimal(24,6)") * 1000).cast("long")
    dec = lambda t: F.regexp_replace(t, ",", ".").try_cast("decimal(18,6)")

    def group(pattern: str, i: int) -> Column:
        return F.coalesce(dec(F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))), F.lit(0))

    number = r"^\d+(?:[.,]\d+)?$"
    clock3, clock2 = r"^(\d+):(\d{1,2}):(\d{1,2}(?:[.,]\d+)?)$", r"^(\d+):(\d{1,2}(?:[.,]\d+)?)$"
    iso = r"^p(?=.*\d)(?:(\d+(?:[.,]\d+)?)w)?(?:(\d+(?:[.,]\d+)?)d)?(?:t(?=.*\d)(?:(\d+(?:[.,]\d+)?)h)?(?:(\d+(?:[.,]\d+)?)m)?(?:(\d+(?:[.,]\d+)?)s)?)?$"
    unit = r"(?:(\d+(?:[.,]\d+)?) ?(?:{})\.?)?"
    words = (
        "^(?=.*\\d)"
        + unit.format("h|hr|hrs|hours?|std|stunden?|heures?|horas?|時間")
        + "(?:,? ?(?:and |und |et |y )?)"
        + unit.format("m|min|mins|minutes?|minuten?|minutos?|分")
        + "(?:,? ?(?:and |und |et |y )?)"
        + unit.format("s|sec|secs|seconds?|sek|sekunden?|secondes?|segundos?|秒")
        + "$"
    )
    millis = r"^(\d+) ?(?:ms|msec|milliseconds?)$"
    c3 = (group(clock3, 2) < 60) & (group(clock3, 3) < 60)
    return (
        F.when(text.rlike(number), ms(dec(text)))
        .when(text.rlike(clock3), F.when(c3, ms(group(clock3, 1) * 3600 + group(clock3, 2) * 60 + group(clock3, 3))))
        .when(text.rlike(clock2), F.when(group(clock2, 2) < 60, ms(group(clock2, 1) * 60 + group(clock2, 2))))
        .when(text.rlike(millis), F.regexp_extract(text, millis, 1).try_cast("long"))
        .when(
            text.rlike(iso),
            ms(group(iso, 1) * 604800 + group(iso, 2) * 86400 + group(iso, 3) * 3600 + group(iso, 4) * 60 + group(iso, 5)),
        )
        .when(text.rlike(words), ms(group(words, 1) * 3600 + group(words, 2) * 60 + group(words, 3)))
    )


def found_times(parsed: DataFrame) -> DataFrame:
    """Values of published_at and duration_raw with exactly one reading, from the operators above."""
    times = normalise_times(parsed, "parse_id", "published_at", "feed_timezone", "podcast_id", "fetched_at")
    stamps = times.where(F.col("basis").isin("epoch", "offset", "zone")).select(
        "parse_id", F.lit("published_at").alias("field"), "value_ms"
    )
    lengths = parsed.select("parse_id", F.lit("duration_raw").alias("field"), duration_ms(F.col("duration_raw")).alias("value_ms"))
    return stamps.unionByName(lengths.where(F.col("value_ms").isNotNull())).distinct()
