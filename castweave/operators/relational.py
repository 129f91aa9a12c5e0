"""Listings, rankings, shared guests, co-hosts and show classification over the catalog.

Each function returns a lazy frame. Fact tables are aggregated before dimensions are joined, so
shuffles carry one row per key; ties are broken by id and null order is spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castweave.functions import text
from castweave.runtime import cut

COHOST_EPISODES, COHOST_SHARE = 100, 0.20


def ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def show_counts(appearance: DataFrame) -> DataFrame:
    """Per show: distinct guests, distinct hosts, guest appearances."""
    role = F.col("role")
    return appearance.groupBy("podcast_id").agg(
        F.countDistinct(F.when(role == "guest", F.col("person_id"))).alias("guests"),
        F.countDistinct(F.when(role == "host", F.col("person_id"))).alias("hosts"),
        F.count(F.when(role == "guest", 1)).alias("guest_appearances"),
    )


def podcast_listing(podcast: DataFrame, episode: DataFrame, appearance: DataFrame, limit: int = 1000) -> DataFrame:
    """Shows with at least one guest: counts and latest date; most guests first, then name; English names."""
    episodes = episode.groupBy("podcast_id").agg(
        F.countDistinct("id").alias("episodes"), F.max(ms(F.col("published_at"))).alias("latest_ms")
    )
    counts = show_counts(appearance).where("guests > 0")
    joined = (
        podcast.select(F.col("id").alias("podcast_id"), "name")
        .join(counts, "podcast_id")
        .join(episodes, "podcast_id", "left")
        .select("podcast_id", "name", "guests", "hosts", F.coalesce("episodes", F.lit(0)).alias("episodes"), "latest_ms")
    )
    top = joined.orderBy(F.desc("guests"), F.asc("name")).limit(limit)
    return top.where(text.is_english_name(F.col("name")))


def podcast_guests(appearance: DataFrame, podcast_id: int, limit: int = 100) -> DataFrame:
    """Guests of one show who never host it: appearances and latest date, most frequent first."""
    here = appearance.where(F.col("podcast_id") == podcast_id)
    hosts = here.where("role = 'host'").select("person_id")
    return (
        here.where("role = 'guest'")
        .join(hosts, "person_id", "left_anti")
        .groupBy("person_id", "name")
        .agg(F.count(F.lit(1)).alias("appearances"), F.max(ms(F.col("published_at"))).alias("latest_ms"))
        .orderBy(F.desc("appearances"), F.asc("name"), F.asc("person_id"))
        .limit(limit)
    )


def people_stats(appearance: DataFrame) -> DataFrame:
    """Per person: guest and host appearances, distinct shows, first and latest date."""
    return appearance.groupBy("person_id", "name").agg(
        F.count(F.when(F.col("role") == "guest", 1)).alias("guest_appearances"),
        F.count(F.when(F.col("role") == "host", 1)).alias("host_appearances"),
        F.countDistinct("podcast_id").alias("podcasts"),
        F.min(ms(F.col("published_at"))).alias("first_ms"),
        F.max(ms(F.col("published_at"))).alias("latest_ms"),
    )


RANKINGS = {
    "guest": "guest_appearances",
    "host": "host_appearances",
    "podcasts": "podcasts",
    "recent": "latest_ms",
}


def ranked_people(appearance: DataFrame, metric: str = "guest", limit: int = 250) -> DataFrame:
    """People by a chosen metric (unknown ones fall back to guest appearances), then name and id."""
    column = RANKINGS.get(metric, RANKINGS["guest"])
    return people_stats(appearance).orderBy(F.desc_nulls_last(column), F.asc("name"), F.asc("person_id")).limit(limit)


def search(df: DataFrame, column: str, query: str) -> DataFrame:
    """Case-insensitive substring search without wildcards."""
    return df.where(F.lower(F.col(column)).contains(query.lower()))


def common_guests(appearance: DataFrame, first: int, second: int, limit: int = 250) -> DataFrame:
    """Guests of both shows with their appearances on the second one."""
    guests = appearance.where("role = 'guest'")
    one = guests.where(F.col("podcast_id") == first).select("person_id").distinct()
    return (
        guests.where(F.col("podcast_id") == second)
        .join(one, "person_id", "left_semi")
        .groupBy("person_id", "name")
        .agg(F.count(F.lit(1)).alias("appearances"))
        .orderBy(F.desc("appearances"), F.asc("name"), F.asc("person_id"))
        .limit(limit)
    )


def hosts_by_podcast(appearance: DataFrame) -> DataFrame:
    """Distinct ``podcast_id, person_id, name`` of hosts; rows, not lists, so a large show stays spread."""
    return appearance.where("role = 'host'").select("podcast_id", "person_id", "name").distinct()


def frequent_guests(appearance: DataFrame, episode: DataFrame) -> DataFrame:
    """(show, person) whose guest episodes pass 100 or a fifth of the show's episodes, both strictly."""
    guest = appearance.where("role = 'guest'").groupBy("podcast_id", "person_id").agg(
        F.countDistinct("episode_id").alias("guest_episodes")
    )
    total = episode.groupBy("podcast_id").agg(F.countDistinct("id").alias("episodes"))
    passes = (F.col("guest_episodes") > COHOST_EPISODES) | (F.col("guest_episodes") > COHOST_SHARE * F.col("episodes"))
    return guest.join(total, "podcast_id").where(passes)


def promote_cohosts(appearance: DataFrame, episode: DataFrame) -> DataFrame:
    """Appearances after frequent guests became hosts of their show; repeats collapse."""
    keys = frequent_guests(appearance, episode).select("podcast_id", "person_id", F.lit(True).alias("_co"))
    role = F.when(F.col("_co"), "host").otherwise(F.col("role"))
    joined = appearance.join(keys, ["podcast_id", "person_id"], "left")
    return joined.select("episode_id", "podcast_id", "person_id", role.alias("role")).distinct()


def guest_ratio(appearance: DataFrame, episode: DataFrame, least: int, below: float) -> DataFrame:
    """Shows of at least ``least`` episodes of which less than the share ``below`` has a guest."""
    with_guest = appearance.where("role = 'guest'").groupBy("podcast_id").agg(
        F.countDistinct("episode_id").alias("guest_episodes")
    )
    total = episode.groupBy("podcast_id").agg(F.countDistinct("id").alias("episodes"))
    guests = F.coalesce(F.col("guest_episodes"), F.lit(0))
    return (
        total.where(F.col("episodes") >= least)
        .join(with_guest, "podcast_id", "left")
        .select("podcast_id", "episodes", guests.alias("guest_episodes"), (guests / F.col("episodes")).alias("ratio"))
        .where(F.col("ratio") < below)
    )


def preferred(df: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """Rows of the highest ``priority`` value per key (a later pass hides an earlier one)."""
    best = df.groupBy(*keys).agg(F.max(priority).alias("_best"))
    return df.join(best, keys).where(F.col(priority) == F.col("_best")).drop("_best")


def materialise(candidate: DataFrame, appearance: DataFrame, least: float = 0.90) -> DataFrame:
    """Guests from extraction candidates: preferred pass, confident, cleaned, no hosts, one row per name.

    The confidence kept for a repeated name is the one of the candidate read last: the largest raw
    normalised name, and among equal ones the lowest confidence.
    """
    best = preferred(candidate, ["episode_id"], "pass_no").where(F.col("confidence") >= least)
    clean = text.clean_display_name(F.col("name"))
    named = best.select(
        "episode_id", "podcast_id", "confidence", clean.alias("name"), text.normalize_extraction(F.col("name")).alias("_raw")
    ).withColumn("normalized", text.normalize_extraction(F.col("name")))
    named = named.where((F.col("normalized") != "") & ~text.is_single_token(F.col("name")))
    hosts = appearance.where("role = 'host'").select(
        "podcast_id", text.normalize_extraction(text.clean_display_name(F.col("name"))).alias("normalized")
    )
    kept = named.join(hosts.distinct(), ["podcast_id", "normalized"], "left_anti")
    return kept.groupBy("episode_id", "normalized").agg(
        F.max_by("confidence", F.struct("_raw", -F.col("confidence"))).alias("confidence"), F.min("name").alias("name")
    )


def host_appearances(hosts: DataFrame, episode: DataFrame, existing: DataFrame) -> DataFrame:
    """``episode_id, person_id`` of hosts on every episode of their show that ``existing`` lacks.

    ``hosts(podcast_id, person_id)`` is small per show; the rows follow the episodes.
    """
    episodes = episode.select(F.col("id").alias("episode_id"), "podcast_id").distinct()
    wanted = hosts.select("podcast_id", "person_id").distinct().join(episodes, "podcast_id").select("episode_id", "person_id")
    return wanted.join(existing.where("role = 'host'").select("episode_id", "person_id"), ["episode_id", "person_id"], "left_anti")


def metadata_hosts(podcast: DataFrame) -> DataFrame:
    """``podcast_id, name`` of hosts named in show metadata, cleaned; single words and repeats dropped."""
    named = podcast.select(F.col("id").alias("podcast_id"), F.explode("metadata.legacy.hosts").alias("raw"))
    clean = named.select("podcast_id", text.clean_display_name(F.col("raw")).alias("name"))
    return clean.where((F.col("name") != "") & ~text.is_single_token(F.col("name"))).distinct()


def prune_single_tokens(person: DataFrame, appearance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People of at least two name tokens, and the appearances that are left with them."""
    kept = person.where(~F.coalesce(text.is_single_token(F.col("name")), F.lit(True)))
    return kept, appearance.join(kept.select(F.col("id").alias("person_id")), "person_id", "left_semi")


def chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """``chunk`` number of each row, ``size`` rows each in order of ``key`` as text."""
    ranked = global_rank(df.withColumn("_zero", F.lit(0)), "_zero", key, "_rank")
    return ranked.withColumn("chunk", F.floor((F.col("_rank") - 1) / size)).drop("_zero", "_rank")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def global_rank(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """1-based position by value descending, then key as text; no ties.

    Rank by range: values are range-partitioned and each partition's rank is offset by the sizes of
    those before it, so no single task ever sees all rows.
    """
    order = [F.desc(value), F.asc(F.col(key).cast("string"))]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    numbered = cut(numbered)
    sizes = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = numbered.join(F.broadcast(offsets.drop("_n")), "_p")
    return joined.withColumn(name, F.col("_i") - F.col("_first") + F.col("_offset") + 1).drop("_p", "_i", "_first", "_offset")


def diverse_sample(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in a fixed pseudo-random order, one per group first and only then further ones."""
    dice = F.xxhash64(F.col(key), F.lit(seed))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(dice, F.col(key)))
    # No group gives more than n rows, and the bound lets Spark drop the rest before the shuffle.
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", dice, F.col(key)).limit(n)


def histogram(df: DataFrame, value: str, bins: int = 24, log: bool = False) -> DataFrame:
    """Equal-width bins over the positive values, or over their decimal logarithms; the last one closed.

    Empty bins don't appear.
    """
    x = F.log10(F.col(value)) if log else F.col(value).cast("double")
    values = df.where(F.col(value) > 0).select(x.alias("v"))
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return values.join(F.broadcast(edges)).groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def most_common(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, ``value``: the most frequent non-null value of each key, ties to the smaller one."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_b"))
    return best.select(key, F.col("_b.v").alias(value))


# Short names of the rankings by a stored rank; any other name is read as the first.
METRIC_RANKS = {
    "pr": "pagerank_rank", "hub": "hub_rank", "auth": "authority_rank", "degree": "degree_rank",
    "bt": "betweenness_rank", "close": "closeness_rank",
}


def ranked_by_metric(metric: DataFrame, rank: str = "pr", query: str = "", limit: int = 250) -> DataFrame:
    """People of the latest run with a representative person, by a stored rank and then by name; repeats collapse.

    ``appearances`` goes by guest appearances, most first.
    """
    latest = metric.where(F.col("run_id") == metric.agg(F.max("run_id")).scalar())
    shown = latest.where(F.col("representative_person_id").isNotNull())
    if query:
        shown = search(shown, "display_name", query)
    if rank == "appearances":
        order = [F.desc_nulls_last("guest_appearances")]
    else:
        order = [F.asc_nulls_last(METRIC_RANKS.get(rank, METRIC_RANKS["pr"]))]
    return shown.distinct().orderBy(*order, "display_name", "canonical_id").limit(limit)


def feed_health(podcast: DataFrame, episode: DataFrame, state: DataFrame) -> DataFrame:
    """One row per show: activity, distinct episodes, the newest one, and the state of its feed.

    ``state(podcast_id, last_status, failure_count)`` may lack shows. ``problem`` tells failures, an error status or
    no episodes.
    """
    counted = episode.groupBy("podcast_id").agg(F.countDistinct("id").alias("episodes"), F.max(ms(F.col("published_at"))).alias("newest_ms"))
    rows = podcast.select(F.col("id").alias("podcast_id"), "name", "active", "is_interview_podcast")
    rows = rows.join(counted, "podcast_id", "left").join(state.select("podcast_id", "last_status", "failure_count"), "podcast_id", "left")
    rows = rows.withColumns({"episodes": F.coalesce("episodes", F.lit(0)), "failure_count": F.coalesce("failure_count", F.lit(0))})
    bad = (F.col("failure_count") > 0) | (F.col("episodes") == 0) | (F.coalesce("last_status", F.lit(0)) >= 400)
    return rows.withColumn("problem", bad)


def feed_health_sums(rows: DataFrame) -> DataFrame:
    """One row of counts over :func:`feed_health`."""
    n = lambda test: F.count(F.when(test, 1))
    return rows.agg(
        F.count(F.lit(1)).alias("feeds"), n(F.col("active")).alias("active"), n(~F.col("is_interview_podcast")).alias("non_interview"),
        n(F.col("last_status") < 400).alias("succeeded"), n(F.col("failure_count") > 0).alias("failed"),
        n(F.col("episodes") == 0).alias("without_episodes"), F.sum("episodes").alias("episodes"), n(F.col("problem")).alias("problems"),
    )


def crosstab(df: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Sum of a weight of at least one over two keys."""
    return df.groupBy(a, b).agg(F.sum(F.greatest(F.col(weight), F.lit(1))).alias("weight"))
