"""Recommended shows by shared guests, with penalties, filters, two orders and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castweave.functions import text
from castweave.operators.relational import ms

GUEST_PENALTY, GENRE_PENALTY = 120, 25
CANDIDATES, SHOWN, ACTIVE_DAYS = 200, 20, 60


def selected_guests(appearance: DataFrame, selected: list[int]) -> DataFrame:
    return appearance.where((F.col("role") == "guest") & F.col("podcast_id").isin(selected)).select("person_id").distinct()


def score_candidates(
    podcast: DataFrame, episode: DataFrame, appearance: DataFrame, selected: list[int], excluded: list[int] = ()
) -> DataFrame:
    """Candidate shows with overlap, rate, penalty and the two adjusted scores.

    The first limit takes the best by overlap before shows without an English name are dropped;
    the penalty counts any guest shared with an excluded show, not only those of the selection.
    """
    out = [x for x in excluded if x not in selected]
    guests = appearance.where("role = 'guest'")
    ours = selected_guests(appearance, selected)
    names = podcast.select(F.col("id").alias("podcast_id"), "name", "active", "genres")
    overlap = (
        guests.where(~F.col("podcast_id").isin([*selected, *out]))
        .join(ours, "person_id", "left_semi")
        .groupBy("podcast_id")
        .agg(F.countDistinct("person_id").alias("shared"), F.count(F.lit(1)).alias("matching"))
        .join(names, "podcast_id")
        .orderBy(F.desc("shared"), F.desc("matching"), F.asc("name"))
        .limit(CANDIDATES)
    )
    unique = guests.groupBy("podcast_id").agg(F.countDistinct("person_id").alias("unique_guests"))
    latest = episode.groupBy("podcast_id").agg(F.max(ms(F.col("published_at"))).alias("latest_ms"))
    theirs = guests.where(F.col("podcast_id").isin(out or [-1])).select("person_id").distinct()
    shared_out = (
        guests.join(theirs, "person_id", "left_semi").groupBy("podcast_id").agg(F.countDistinct("person_id").alias("out_guests"))
    )
    out_genres = podcast.where(F.col("id").isin(out or [-1])).agg(
        F.array_distinct(F.flatten(F.collect_list("genres"))).alias("g")
    ).scalar()
    scored = (
        overlap.where(text.is_english_name(F.col("name")))
        .join(unique, "podcast_id", "left")
        .join(latest, "podcast_id", "left")
        .join(shared_out, "podcast_id", "left")
        .withColumn("unique_guests", F.coalesce("unique_guests", F.lit(0)))
    )
    rate = F.when(F.col("unique_guests") > 0, F.col("shared") / F.col("unique_guests")).otherwise(F.lit(0.0))
    penalty = F.coalesce("out_guests", F.lit(0)) * GUEST_PENALTY + F.size(F.array_intersect("genres", out_genres)) * GENRE_PENALTY
    return (
        scored.withColumn("rate", rate)
        .withColumn("penalty", penalty)
        .withColumn("rate_score", (F.bround(F.col("rate") * 10000) + F.col("shared") - F.col("penalty")).cast("long"))
        .withColumn("overlap_score", F.col("shared") * 100 + F.col("matching") - F.col("penalty"))
        .drop("out_guests")
    )


def recommend(
    scored: DataFrame, sort: str = "rate", genres: list[str] = (), active_since_ms: int | None = None, limit: int = SHOWN
) -> DataFrame:
    """The best candidates after the filters; an unknown ``sort`` is read as ``rate``.

    ``active_since_ms`` keeps shows not marked inactive whose latest episode (if any) is not older.
    """
    if genres:
        scored = scored.where(F.arrays_overlap("genres", F.array(*map(F.lit, genres))))
    if active_since_ms is not None:
        recent = F.col("latest_ms").isNull() | (F.col("latest_ms") >= active_since_ms)
        scored = scored.where(~F.col("active").eqNullSafe(False) & recent)
    if sort == "overlap":
        order = [F.desc("overlap_score"), F.desc("shared"), F.desc("matching"), F.asc("name")]
    else:
        order = [F.desc("rate_score"), F.desc("rate"), F.desc("shared"), F.desc("matching"), F.asc("name")]
    return scored.orderBy(*order).limit(limit)


def shared_guests(appearance: DataFrame, selected: list[int], candidates: DataFrame, n: int = 5) -> DataFrame:
    """Best shared guests of each candidate: appearances on both, then on the candidate, then name."""
    guests = appearance.where("role = 'guest'")
    on_ours = guests.where(F.col("podcast_id").isin(selected)).groupBy("person_id").agg(F.count(F.lit(1)).alias("ours"))
    theirs = (
        guests.join(candidates.select("podcast_id"), "podcast_id", "left_semi")
        .groupBy("podcast_id", "person_id", "name")
        .agg(F.count(F.lit(1)).alias("theirs"))
        .join(on_ours, "person_id")
        .withColumn("total", F.col("ours") + F.col("theirs"))
    )
    window = Window.partitionBy("podcast_id").orderBy(F.desc("total"), F.desc("theirs"), F.asc("name"), F.asc("person_id"))
    return theirs.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def explain(appearance: DataFrame, podcast: DataFrame, selected: list[int], candidates: DataFrame, n: int = 3) -> DataFrame:
    """For each candidate the selected show with most shared guests (ties: largest name) and its best guests."""
    guests = appearance.where("role = 'guest'")
    counts = lambda df, c: df.groupBy("podcast_id", "person_id", "name").agg(F.count(F.lit(1)).alias(c))
    ours = counts(guests.where(F.col("podcast_id").isin(selected)), "ours")
    names = podcast.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    theirs = counts(guests.join(candidates.select("podcast_id"), "podcast_id", "left_semi"), "theirs")
    pairs = theirs.join(
        ours.select(F.col("podcast_id").alias("source_id"), "person_id", "ours"), "person_id"
    ).join(names, "source_id")
    by_source = pairs.groupBy("podcast_id", "source_id", "source").agg(F.count(F.lit(1)).alias("shared"))
    best = by_source.groupBy("podcast_id").agg(F.max(F.struct("shared", "source", "source_id")).alias("b"))
    chosen = best.select("podcast_id", "b.source_id", "b.source", "b.shared").join(
        pairs.drop("source"), ["podcast_id", "source_id"]
    )
    window = Window.partitionBy("podcast_id").orderBy(
        F.desc(F.col("ours") + F.col("theirs")), F.desc("theirs"), F.asc("name"), F.asc("person_id")
    )
    ranked = chosen.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
    return ranked.groupBy("podcast_id", "source", "shared").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), ", ").alias("guests")
    )
