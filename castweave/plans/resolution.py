"""Queries of the entity resolution chain, stored rankings, feed health and weekly snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castweave.operators import entities as E
from castweave.operators import network as N
from castweave.operators import relational as ops
from castweave.operators import resolution as R
from castweave.plans.listings import NORM
from castweave.plans.records import WEEKLY, _pairs
from castweave.sources.catalog import APPEARANCES, EPISODES, GENRES_SQL, Catalog

QUERIES: dict = {}
SQL: dict[str, str] = {}
SNAPSHOT_WEEK = "2023-12-25"


def query(sql: str | None = None):
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Catalog(spark, sf_dir))

        QUERIES[function.__name__] = run
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


OBSERVED = f"""{APPEARANCES}, ob AS (SELECT DISTINCT substr(sha256('appearance|' || episode_id || '|' || person_id || '|' || role), 1, 24)
    AS observation_id, episode_id, podcast_id, person_id, role, name AS observed_name, {NORM.format("name")} AS normalized_name
    FROM app WHERE name IS NOT NULL)"""


@query(f"WITH {OBSERVED} SELECT * FROM ob")
def er_observations(c: Catalog) -> DataFrame:
    return R.observations(c.appearance).drop("seen_at")


def _existing(observation: DataFrame) -> DataFrame:
    """An earlier run's links: every host was linked by hand to an entity of its person."""
    manual = F.concat(F.lit("manual-"), F.col("person_id").cast("string"))
    return observation.where("role = 'host'").select("observation_id", manual.alias("am_entity_id"), F.lit("manual").alias("method"))


LINKS = f"""{OBSERVED}, li AS (SELECT observation_id, CASE WHEN role = 'host' THEN 'manual-' || person_id
    ELSE substr(sha256('person|' || normalized_name), 1, 24) END AS am_entity_id,
    CASE WHEN role = 'host' THEN 'manual' ELSE 'exact_name' END AS method FROM ob)"""


@query(f"WITH {LINKS} SELECT * FROM li")
def er_links(c: Catalog) -> DataFrame:
    observed = R.observations(c.appearance)
    return R.links(observed, _existing(observed))


@query(
    f"""WITH {LINKS}, k AS (SELECT normalized_name, count(*) AS n FROM ob GROUP BY 1),
    e AS (SELECT substr(sha256('person|' || normalized_name), 1, 24) AS entity_id, normalized_name, n FROM k WHERE n >= 2),
    s AS (SELECT DISTINCT am_entity_id AS entity_id, podcast_id FROM li JOIN ob USING (observation_id) WHERE podcast_id IS NOT NULL),
    g AS (SELECT DISTINCT s.entity_id, unnest({GENRES_SQL}) AS genre FROM s JOIN podcast ON podcast.id = s.podcast_id),
    sc AS (SELECT entity_id, count(*) AS shows FROM s GROUP BY 1), gc AS (SELECT entity_id, string_agg(genre, '|' ORDER BY genre) AS genres FROM g GROUP BY 1)
    SELECT e.entity_id, normalized_name, n AS observation_count, coalesce(shows, 0) AS shows, coalesce(genres, '') AS genres
    FROM e LEFT JOIN sc USING (entity_id) LEFT JOIN gc USING (entity_id)"""
)
def er_profiles(c: Catalog) -> DataFrame:
    observed = R.observations(c.appearance)
    linked = R.links(observed, _existing(observed))
    genres = c.podcast.select(F.col("id").alias("podcast_id"), "genres")
    rows = R.profiles(E.canonicals(observed), linked, observed, genres, least=2)
    return rows.select(
        "entity_id", "normalized_name", "observation_count", F.size("podcast_ids").cast("long").alias("shows"), F.array_join("genres", "|").alias("genres")
    )


@query()
def score_decisions(c: Catalog) -> DataFrame:
    profile = c.raw("entity_profile")
    features = E.pair_features(E.profile_pairs(E.near_in_graph(_pairs(c), profile), profile))
    return E.scored(features).withColumn("reasons", F.array_join("reasons", "; "))


@query(
    """WITH r AS (SELECT DISTINCT * FROM person_network_metric WHERE run_id = (SELECT max(run_id) FROM person_network_metric)
        AND representative_person_id IS NOT NULL)
    SELECT canonical_id, display_name, hub_rank FROM r ORDER BY hub_rank NULLS LAST, display_name, canonical_id LIMIT 250"""
)
def rankings_by_metric(c: Catalog) -> DataFrame:
    return ops.ranked_by_metric(c.raw("person_network_metric"), "hub").select("canonical_id", "display_name", "hub_rank")


@query(
    """WITH n AS (SELECT canonical_id, representative_person_id AS p, count(*) AS n FROM person_network_metric
        WHERE representative_person_id IS NOT NULL GROUP BY 1, 2)
    SELECT canonical_id, p AS representative_person_id FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY n DESC, p) AS r FROM n) WHERE r = 1"""
)
def representative_person(c: Catalog) -> DataFrame:
    return ops.most_common(c.raw("person_network_metric"), "canonical_id", "representative_person_id")


@query(
    """WITH v AS (SELECT log10(observation_count) AS v FROM canonical WHERE observation_count > 0), b AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
    SELECT CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 24)), 23) ELSE 0 END AS INTEGER) AS bin, count(*) AS count FROM v, b GROUP BY 1"""
)
def histogram_log(c: Catalog) -> DataFrame:
    return ops.histogram(c.raw("canonical"), "observation_count", log=True)


@query(
    f"""WITH {EPISODES}, n AS (SELECT podcast_id, count(DISTINCT id) AS n FROM ep GROUP BY 1),
    r AS (SELECT active, is_interview_podcast, coalesce(n, 0) AS n FROM podcast LEFT JOIN n ON podcast_id = id)
    SELECT count(*) AS feeds, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE NOT is_interview_podcast) AS non_interview,
        0::BIGINT AS succeeded, 0::BIGINT AS failed, count(*) FILTER (WHERE n = 0) AS without_episodes, CAST(sum(n) AS BIGINT) AS episodes,
        count(*) FILTER (WHERE n = 0) AS problems FROM r"""
)
def feed_health(c: Catalog) -> DataFrame:
    """No table holds fetch states, so shows without episodes are the only problems here."""
    state = c.spark.createDataFrame([], "podcast_id long, last_status int, failure_count int")
    return ops.feed_health_sums(ops.feed_health(c.podcast, c.episode, state))


@query(
    f"""WITH {WEEKLY}, past AS (SELECT * FROM d WHERE week <= DATE '{SNAPSHOT_WEEK}'),
    pm AS (SELECT DISTINCT least(g.person_id, h.person_id) AS a, greatest(g.person_id, h.person_id) AS b FROM past g JOIN past h
        ON g.episode_id = h.episode_id AND g.role = 'guest' AND h.role = 'host' AND g.person_id <> h.person_id)
    SELECT DATE '{SNAPSHOT_WEEK}' AS week, count(DISTINCT person_id) AS people, count(DISTINCT podcast_id) AS podcasts,
        count(DISTINCT episode_id) AS episodes, count(*) FILTER (WHERE role = 'guest') AS guest_appearances,
        (SELECT count(*) FROM pm) AS edges,
        (SELECT count(*) FROM p WHERE week = DATE '{SNAPSHOT_WEEK}') AS new_people,
        (SELECT count(*) FROM m WHERE week = DATE '{SNAPSHOT_WEEK}') AS new_edges,
        (SELECT count(*) FROM s WHERE week = DATE '{SNAPSHOT_WEEK}') AS new_podcasts FROM past"""
)
def week_sizes(c: Catalog) -> DataFrame:
    row = N.week_snapshot(c.appearance, SNAPSHOT_WEEK)
    return row.select("week", "people", "podcasts", "episodes", "guest_appearances", "edges", "new_people", "new_edges", "new_podcasts")


@query()
def week_snapshot(c: Catalog) -> DataFrame:
    return N.week_snapshot(c.appearance, SNAPSHOT_WEEK)


@query()
def week_people(c: Catalog) -> DataFrame:
    stored = c.raw("person_network_metric").select(F.col("representative_person_id").alias("id"), "pagerank_rank", "hub_rank")
    return N.week_people(c.appearance, SNAPSHOT_WEEK, stored, 100)
