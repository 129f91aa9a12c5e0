"""Catalog views over the tables of a folder, and the same views as SQL for the oracle.

Shows, episodes, people, entities and pairs are tables of their own. Appearances (who was host or
guest of which episode) and extraction candidates come from the line items: order key is the
episode, part key the person, line 1 the host; ``1 - l_discount`` is a candidate's confidence.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castweave.functions import text
from castweave.runtime import table


class Catalog:
    """Lazy frames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def podcast(self) -> DataFrame:
        return self.raw("podcast").withColumn("genres", text.web_genres(F.col("metadata")))

    @cached_property
    def episode(self) -> DataFrame:
        """Episodes without exact repeats."""
        cols = ("id", "podcast_id", "guid", "title", "description", "published_at", "duration_raw", "explicit")
        return self.raw("episode").select(*cols).distinct()

    @cached_property
    def person(self) -> DataFrame:
        return self.raw("person")

    @cached_property
    def appearance(self) -> DataFrame:
        """episode_id, podcast_id, published_at, person_id, name, role; one row per (episode, person, role)."""
        role = F.when(F.col("l_linenumber") == 1, "host").otherwise("guest").alias("role")
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("person_id"), role
        )
        episodes = self.episode.select(F.col("id").alias("episode_id"), "podcast_id", "published_at").distinct()
        people = self.person.select(F.col("id").alias("person_id"), "name")
        return lines.distinct().join(episodes, "episode_id").join(people, "person_id")

    @cached_property
    def candidate(self) -> DataFrame:
        """Extracted guest names: episode_id, podcast_id, pass_no, name, confidence."""
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("episode_id"),
            F.col("l_partkey").alias("person_id"),
            F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("pass_no"),
            F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        )
        episodes = self.episode.select(F.col("id").alias("episode_id"), "podcast_id").distinct()
        people = self.person.select(F.col("id").alias("person_id"), "name")
        return lines.join(episodes, "episode_id").join(people, "person_id")


EPISODES = """ep AS (
    SELECT DISTINCT id, podcast_id, guid, title, description, published_at, duration_raw, explicit FROM episode)"""
APPEARANCES = (
    EPISODES
    + """,
app AS (
    SELECT DISTINCT e.id AS episode_id, e.podcast_id, e.published_at, p.id AS person_id, p.name,
           CASE WHEN l_linenumber = 1 THEN 'host' ELSE 'guest' END AS role
    FROM lineitem JOIN ep e ON l_orderkey = e.id JOIN person p ON l_partkey = p.id)"""
)
CANDIDATES = (
    EPISODES
    + """,
cand AS (
    SELECT e.id AS episode_id, e.podcast_id, p.id AS person_id, p.name,
           CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS pass_no, round(1 - l_discount, 2) AS confidence
    FROM lineitem JOIN ep e ON l_orderkey = e.id JOIN person p ON l_partkey = p.id)"""
)
NON_ENGLISH_SQL = (
    r"[\x{0600}-\x{06ff}\x{0750}-\x{077f}\x{08a0}-\x{08ff}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
)
GENRES_SQL = "list_distinct([trim(x) for x in coalesce(metadata.legacy.categories, []) if trim(x) <> ''])"
