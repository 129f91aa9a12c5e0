"""Weekly evolution of the network: first-seen tables once, then weekly and cumulative counts.

A graph per week is never rebuilt: every node, edge and show carries the first date it was seen,
and a week's cumulative graph is a filter on that date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_of(c: Column, tz: str = "UTC") -> Column:
    """Monday of the local date of an instant in ``tz``."""
    return F.to_date(F.date_trunc("week", F.from_utc_timestamp(c.cast("timestamp"), tz)))


def week_cutoff(week: Column, tz: str = "UTC") -> Column:
    """First instant after a week: next Monday's local midnight."""
    return F.to_utc_timestamp(F.date_add(week, 7).cast("timestamp"), tz)


def first_seen(appearance: DataFrame, tz: str = "UTC") -> dict[str, DataFrame]:
    """Frames ``key..., week`` of people, undirected edges and shows; undated episodes don't count."""
    dated = appearance.where("published_at IS NOT NULL").withColumn("week", week_of(F.col("published_at"), tz))
    guests = dated.where("role = 'guest'").select("episode_id", "week", F.col("person_id").alias("g"))
    hosts = dated.where("role = 'host'").select("episode_id", F.col("person_id").alias("h"))
    met = guests.join(hosts, "episode_id").where("g <> h")
    return {
        "people": dated.groupBy("person_id").agg(F.min("week").alias("week")),
        "edges": met.groupBy(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b")).agg(F.min("week").alias("week")),
        "podcasts": dated.groupBy("podcast_id").agg(F.min("week").alias("week")),
    }


def weekly_new(appearance: DataFrame) -> DataFrame:
    """``week, new_people, new_edges, new_podcasts, episodes``; weeks without any news don't appear."""
    seen = first_seen(appearance)
    parts = [df.groupBy("week").agg(F.count(F.lit(1)).alias("n")).select("week", F.lit(k).alias("k"), "n") for k, df in seen.items()]
    dated = appearance.where("published_at IS NOT NULL").select("episode_id", week_of(F.col("published_at")).alias("week"))
    parts.append(dated.distinct().groupBy("week").agg(F.count(F.lit(1)).alias("n")).select("week", F.lit("episodes").alias("k"), "n"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0))
    return every.groupBy("week").agg(
        pick("people").alias("new_people"), pick("edges").alias("new_edges"), pick("podcasts").alias("new_podcasts"),
        pick("episodes").alias("episodes"),
    )


def weekly_cumulative(new: DataFrame) -> DataFrame:
    """Running totals of :func:`weekly_new` by week (one row per week, so one ordered pass)."""
    window = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c: F.sum(c).over(window)
    return new.select(
        "week", total("new_people").alias("people"), total("new_edges").alias("edges"), total("new_podcasts").alias("podcasts"),
        total("episodes").alias("episodes"),
    )


def weeks_missing(
    episode: DataFrame, stored: DataFrame, bootstrap: bool = True, recompute: bool = False, max_weeks: int | None = None
) -> DataFrame:
    """Weeks still to compute: from after the last stored one (or the first, with ``bootstrap``) to the latest.

    With ``recompute`` stored weeks are done again. Nothing stored and no ``bootstrap`` gives no rows.
    """
    dated = episode.where("published_at IS NOT NULL").select(week_of(F.col("published_at")).alias("week"))
    bounds = dated.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    last = stored.agg(F.max("week").alias("last"))
    start = F.lit(None).cast("date")
    if bootstrap:
        start = F.col("lo")
    if not recompute:
        start = F.coalesce(F.date_add(F.col("last"), 7), start)
    both = bounds.withColumn("last", last.scalar()).withColumn("start", start).where("start <= hi")
    weeks = both.select(F.explode(F.sequence("start", "hi", F.expr("interval 7 days"))).alias("week"))
    if not recompute:
        weeks = weeks.join(stored.select("week"), "week", "left_anti")
    return weeks.orderBy("week").limit(max_weeks) if max_weeks is not None else weeks


def tracked_ids(metric: DataFrame, key: str, ranks: list[str], limit: int) -> DataFrame:
    """Distinct keys within the first ``limit`` of any rank column."""
    within = F.lit(False)
    for rank in ranks:
        within = within | F.coalesce(F.col(rank) <= limit, F.lit(False))
    return metric.where(within & F.col(key).isNotNull()).select(key).distinct()


def melt(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Wide series to ``key, series, value``."""
    typed = df.select(key, *(F.col(v).cast("double").alias(v) for v in values))
    return typed.unpivot([key], values, "series", "value")
