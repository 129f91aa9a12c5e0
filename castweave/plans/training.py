"""Queries of the general training-data operators (problems 2 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castweave.operators import skew, timestamps
from castweave.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.found_times(table(spark, sf_dir, "parsed_episode"))


def p2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise_times(
        table(spark, sf_dir, "parsed_episode"), "parse_id", "published_at", "feed_timezone", "podcast_id", "fetched_at"
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("episode", "podcast", "person_network_metric", "canonical")
    return skew.found_hot(*(table(spark, sf_dir, n) for n in names))


def p5_show_feed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, title characters and dates of episode joined with parsed_episode, per show, without the join's rows."""
    episode = table(spark, sf_dir, "episode").select(
        "podcast_id", F.length("title").alias("title_chars"), "published_at"
    )
    parsed = table(spark, sf_dir, "parsed_episode").select("podcast_id", F.length("guid").alias("guid_chars"))
    left = skew.key_state(episode, "podcast_id", "e", sums=["title_chars"], maxs=["published_at"])
    right = skew.key_state(parsed, "podcast_id", "p", sums=["guid_chars"])
    return skew.join_states(left, right, "e", "p").select(
        F.col("key").alias("podcast_id"),
        F.col("n").alias("joined_rows"),
        F.col("e_sum_title_chars").alias("title_chars"),
        F.col("p_sum_guid_chars").alias("guid_chars"),
        F.unix_millis(F.col("e_max_published_at").cast("timestamp")).alias("latest_ms"),
    )


def p5_distinct_guids(spark: SparkSession, sf_dir: str) -> DataFrame:
    episode = table(spark, sf_dir, "episode")
    return skew.distinct_per_key(episode, "podcast_id", "guid", "guids").withColumnRenamed("key", "podcast_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_normalised": p2_normalised,
    "p5_found": p5_found,
    "p5_show_feed_rollup": p5_show_feed_rollup,
    "p5_distinct_guids": p5_distinct_guids,
}

SQL = {
    "p5_found": """
        SELECT 'podcast_id' AS key_field, podcast_id AS key_value FROM episode WHERE podcast_id IS NOT NULL
        GROUP BY podcast_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM episode)
        UNION ALL
        SELECT 'guest_appearances', CAST(guest_appearances AS BIGINT) FROM person_network_metric
        WHERE guest_appearances IS NOT NULL
        GROUP BY guest_appearances HAVING count(*) >= 0.02 * (SELECT count(*) FROM person_network_metric)""",
    "p5_show_feed_rollup": """
        SELECT e.podcast_id, count(*) AS joined_rows, CAST(sum(length(e.title)) AS BIGINT) AS title_chars,
               CAST(sum(length(p.guid)) AS BIGINT) AS guid_chars, epoch_ms(max(e.published_at)) AS latest_ms
        FROM episode e JOIN parsed_episode p ON e.podcast_id = p.podcast_id GROUP BY e.podcast_id""",
    "p5_distinct_guids": """
        SELECT podcast_id, count(DISTINCT guid) AS guids FROM episode WHERE guid IS NOT NULL GROUP BY podcast_id""",
}
