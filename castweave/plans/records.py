"""Queries over texts, entities, weekly evolution, feeds, legacy analytics and the event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castweave.functions import similarity as sim
from castweave.functions import text
from castweave.operators import entities as E
from castweave.operators import evolution as V
from castweave.operators import relational as ops
from castweave.operators.relational import ms
from castweave.plans.listings import NORM, clean_names_sql
from castweave.sources import feeds
from castweave.sources.catalog import APPEARANCES, EPISODES, GENRES_SQL, Catalog
from castweave.streaming import weekly

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Catalog(spark, sf_dir))

        QUERIES[function.__name__] = run
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


TOKENS = "regexp_extract_all(lower({0}), '[a-z]+|[0-9]+')"
NOISE_SQL = "[" + ", ".join(f"'{w}'" for w in text.NOISE) + "]"
ALPHA = "[t for t in " + TOKENS + " if NOT regexp_full_match(t, '[0-9]+')]"
CLEAN = "[t for t in " + TOKENS + f" if NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains({NOISE_SQL}, t)]"


# --- texts ---------------------------------------------------------------------------------


@query(f"SELECT id, {NORM.format('name')} AS normalized FROM person")
def normalize_extraction(c: Catalog) -> DataFrame:
    return c.person.select("id", text.normalize_extraction(F.col("name")).alias("normalized"))


@query("SELECT id, trim(regexp_replace(replace(strip_accents(lower(name)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS normalized FROM person")
def normalize_graph(c: Catalog) -> DataFrame:
    return c.person.select("id", text.normalize_graph(F.col("name")).alias("normalized"))


@query(f"WITH {clean_names_sql('person')} SELECT id, clean AS display_name FROM named")
def clean_display_name(c: Catalog) -> DataFrame:
    return c.person.select("id", text.clean_display_name(F.col("name")).alias("display_name"))


@query(f"SELECT id, substr(sha256('person|' || {NORM.format('name')}), 1, 24) AS entity_id FROM person")
def stable_ids(c: Catalog) -> DataFrame:
    return c.person.select("id", text.stable_id(24, F.lit("person"), text.normalize_extraction(F.col("name"))).alias("entity_id"))


# The sample buckets, each by patterns for title and description (case is ignored) or by a condition.
BUCKETS = {
    "explicit_with_title": {"title": r"\b(with|w/|featuring)\b"},
    "guest_language_description": {"description": r"\b(guest|joined by|talks? with|interview)\b"},
    "possible_topic_confusion": {
        "title": r"\b(on|about|case for|against|death of|life of)\b",
        "description": r"\b(discuss|discussion|debate|topic|story of)\b",
    },
    "likely_solo_or_recap": {
        "title": r"\b(solo|monologue|recap|mailbag|bonus|trailer)\b",
        "description": r"\b(solo|monologue|recap|mailbag|bonus|trailer)\b",
    },
    "multi_guest_or_panel": {
        "title": r"\b(and|&|panel|roundtable)\b",
        "description": r"\b(panel|roundtable|joined by|guests)\b",
    },
    "short_metadata": "description = ''",
    "recent_large_podcasts": "published_at IS NOT NULL",
    "older_archive": "year(published_at) < 2016",
}


def _bucket_sql(rule) -> str:
    if isinstance(rule, str):
        return rule
    return " OR ".join(f"coalesce(regexp_matches({field}, '(?i){pattern}'), false)" for field, pattern in rule.items())


def bucket(rule) -> Column:
    """Whether an episode belongs to a sample bucket."""
    if isinstance(rule, str):
        return F.coalesce(F.expr(rule), F.lit(False))
    hit = F.lit(False)
    for field, pattern in rule.items():
        hit = hit | F.coalesce(F.col(field).rlike("(?i)" + pattern), F.lit(False))
    return hit


@query(f"WITH {EPISODES} SELECT " + ", ".join(f"count(*) FILTER (WHERE {_bucket_sql(rule)}) AS {k}" for k, rule in BUCKETS.items()) + " FROM ep")
def regex_buckets(c: Catalog) -> DataFrame:
    return c.episode.agg(*(F.count(F.when(bucket(rule), 1)).alias(k) for k, rule in BUCKETS.items()))


SIGNAL = "(?i)(?:" + "|".join(text.GUEST_SIGNALS).replace("'", "''") + ")"


@query(
    f"""WITH {EPISODES} SELECT podcast_id, count(*) AS episodes,
    count(*) FILTER (WHERE regexp_matches(title, '{SIGNAL}') OR regexp_matches(description, '{SIGNAL}')) AS signals FROM ep GROUP BY 1"""
)
def guest_signal_episodes(c: Catalog) -> DataFrame:
    hit = text.has_guest_signal(F.col("title")) | text.has_guest_signal(F.col("description"))
    return c.episode.groupBy("podcast_id").agg(F.count(F.lit(1)).alias("episodes"), F.count(F.when(hit, 1)).alias("signals"))


@query(
    "SELECT doc_id, trim(regexp_extract(text, '" + text.LOCAL_GUEST.replace("'", "''") + "', 1)) AS guest FROM documents"
    " WHERE trim(regexp_extract(text, '" + text.LOCAL_GUEST.replace("'", "''") + "', 1)) <> ''"
)
def local_guest_extract(c: Catalog) -> DataFrame:
    """Over the texts of documents, as the pattern is meant for whole texts; titles here hold no names."""
    return c.raw("documents").select("doc_id", text.local_guest(F.col("text")).alias("guest")).where("guest IS NOT NULL")


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS events FROM events GROUP BY 1")
def json_props_extract(c: Catalog) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return c.raw("events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(F.lit(1)).alias("events"))


@query("SELECT parse_id, CASE WHEN length(trim(title)) <= 40 THEN trim(title) ELSE rtrim(regexp_replace(substr(trim(title), 1, 40), '\\s\\S*$', '')) || '...' END AS short_title FROM parsed_episode")
def short_titles(c: Catalog) -> DataFrame:
    return c.raw("parsed_episode").select("parse_id", text.truncate_words(F.col("title"), 40).alias("short_title"))


# --- entities ------------------------------------------------------------------------------

_T, _C = ALPHA.format("normalized_name"), CLEAN.format("normalized_name")
KEYS = f"""tk AS (SELECT entity_id, {_T} AS t, {_C} AS c FROM entity_profile),
    ks AS (SELECT DISTINCT entity_id, unnest([
        'token-set:' || array_to_string(list_sort(t), ' '),
        CASE WHEN len(t) >= 2 THEN 'first-last:' || t[1] || ':' || t[-1] END,
        CASE WHEN len(t) >= 2 THEN 'first-two:' || t[1] || ':' || t[2] END,
        CASE WHEN len(c) >= 1 THEN 'clean-token-set:' || array_to_string(list_sort(c), ' ') END,
        CASE WHEN len(c) >= 2 THEN 'clean-first-last:' || c[1] || ':' || c[-1] END,
        CASE WHEN len(c) >= 2 THEN 'clean-first-two:' || c[1] || ':' || c[2] END,
        CASE WHEN len(c) >= 2 THEN 'clean-first-last-prefix:' || c[1] || ':' || substr(c[-1], 1, 4) END]) AS key FROM tk WHERE len(t) > 0)"""


@query(f"WITH {KEYS} SELECT entity_id, key FROM ks WHERE key IS NOT NULL")
def blocking_keys(c: Catalog) -> DataFrame:
    return c.raw("entity_profile").select("entity_id", F.explode(E.blocking_keys(F.col("normalized_name"))).alias("key"))


@query(
    f"""WITH {KEYS}, k AS (SELECT key FROM ks WHERE key IS NOT NULL GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200),
    m AS (SELECT ks.* FROM ks JOIN k USING (key))
    SELECT a.entity_id AS left_id, b.entity_id AS right_id, string_agg(a.key, ' ' ORDER BY a.key) AS blocking_keys
    FROM m a JOIN m b ON a.key = b.key AND a.entity_id < b.entity_id GROUP BY 1, 2"""
)
def blocking_pairs(c: Catalog) -> DataFrame:
    pairs = E.block_pairs(c.raw("entity_profile"))
    return pairs.select("left_id", "right_id", F.array_join("blocking_keys", " ").alias("blocking_keys"))


@query()
def candidate_ranking(c: Catalog) -> DataFrame:
    out = E.candidate_pairs(c.raw("entity_profile"))
    return out.select("left_id", "right_id", "keys", "shared", "rarer")


def _pairs(c: Catalog) -> DataFrame:
    return c.raw("candidate_pair").where("left_id <> right_id").select(
        F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")
    ).distinct()


PAIRS = """pr AS (SELECT DISTINCT least(left_id, right_id) AS left_id, greatest(left_id, right_id) AS right_id
    FROM candidate_pair WHERE left_id <> right_id)"""


def _jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct({a} || {b})) > 0 THEN round_even(len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})), 6) ELSE 0 END"


@query(
    f"""WITH {PAIRS}, x AS (SELECT left_id, right_id,
        list_distinct(coalesce(l.alpha_tokens, [])) AS lt, list_distinct(coalesce(r.alpha_tokens, [])) AS rt,
        {CLEAN.format("l.normalized_name")} AS lc, {CLEAN.format("r.normalized_name")} AS rc,
        coalesce(l.genres, []) AS lg, coalesce(r.genres, []) AS rg, coalesce(l.roles, []) AS lr, coalesce(r.roles, []) AS rr,
        coalesce(l.podcast_ids, []) AS lp, coalesce(r.podcast_ids, []) AS rp
        FROM pr JOIN entity_profile l ON l.entity_id = left_id JOIN entity_profile r ON r.entity_id = right_id)
    SELECT left_id, right_id, {_jaccard_sql("lt", "rt")} AS token_jaccard, {_jaccard_sql("lc", "rc")} AS cleaned_token_jaccard,
        {_jaccard_sql("lg", "rg")} AS genre_jaccard, {_jaccard_sql("lr", "rr")} AS role_jaccard,
        CAST(len(list_intersect(lp, rp)) AS DOUBLE) AS shared_podcast_count FROM x"""
)
def set_features(c: Catalog) -> DataFrame:
    features = E.pair_features(E.profile_pairs(_pairs(c), c.raw("entity_profile")))
    return features.select(
        "left_id", "right_id", "token_jaccard", "cleaned_token_jaccard", "genre_jaccard", "role_jaccard", "shared_podcast_count"
    )


@query()
def pair_features(c: Catalog) -> DataFrame:
    profile = c.raw("entity_profile")
    return E.pair_features(E.profile_pairs(E.near_in_graph(_pairs(c), profile), profile))


@query(
    f"""WITH {PAIRS}, on_ AS (SELECT DISTINCT entity_id, unnest(podcast_ids) AS s FROM entity_profile)
    SELECT left_id, right_id FROM pr JOIN entity_profile l ON l.entity_id = left_id JOIN entity_profile r ON r.entity_id = right_id
    WHERE EXISTS (SELECT 1 FROM on_ a JOIN on_ n1 ON n1.s = a.s JOIN on_ n2 ON n2.entity_id = n1.entity_id JOIN on_ b ON b.s = n2.s
        WHERE a.entity_id = left_id AND b.entity_id = right_id AND n1.entity_id <> left_id AND n1.entity_id <> right_id)"""
)
def near_pairs(c: Catalog) -> DataFrame:
    profile = c.raw("entity_profile")
    known = profile.select("entity_id")
    pairs = _pairs(c).join(known.toDF("left_id"), "left_id", "left_semi").join(known.toDF("right_id"), "right_id", "left_semi")
    return E.near_in_graph(pairs, profile).where("near > 0").select("left_id", "right_id")


@query(
    f"""WITH h AS (SELECT id AS podcast_id, unnest(metadata.legacy.hosts) AS name FROM podcast), {clean_names_sql("h")}
    SELECT DISTINCT podcast_id, clean AS name FROM named WHERE clean <> '' AND len(regexp_extract_all(lower(clean), '[a-z0-9]+')) >= 2"""
)
def metadata_hosts(c: Catalog) -> DataFrame:
    return ops.metadata_hosts(c.podcast)


@query()
def heuristic_score(c: Catalog) -> DataFrame:
    profile = c.raw("entity_profile")
    features = E.pair_features(E.profile_pairs(E.near_in_graph(_pairs(c), profile), profile))
    return features.select("left_id", "right_id", E.heuristic_score().alias("score"))


@query()
def name_distances(c: Catalog) -> DataFrame:
    name = c.raw("entity_profile").select("entity_id", "normalized_name")
    left, right = name.toDF("left_id", "l"), name.toDF("right_id", "r")
    joined = _pairs(c).join(left, "left_id").join(right, "right_id")
    return joined.select("left_id", "right_id", sim.osa("l", "r").alias("osa"), sim.seq_ratio("l", "r").alias("ratio"))


MERGES = """WITH a AS (SELECT DISTINCT left_id, right_id, match_probability FROM candidate_pair WHERE status = 'accepted' AND left_id <> right_id),
    k AS (SELECT am_entity_id AS id, coalesce(observation_count, 0) AS o, length(display_name) AS n, display_name AS d FROM canonical),
    j AS (SELECT a.*, l.o > r.o OR (l.o = r.o AND (l.n > r.n OR (l.n = r.n AND (l.d < r.d OR (l.d = r.d AND l.id < r.id))))) AS lw
        FROM a JOIN k l ON l.id = left_id JOIN k r ON r.id = right_id)
    SELECT DISTINCT CASE WHEN lw THEN left_id ELSE right_id END AS target_id, CASE WHEN lw THEN right_id ELSE left_id END AS source_id,
        match_probability FROM j"""


@query(MERGES)
def merge_target_choice(c: Catalog) -> DataFrame:
    accepted = c.raw("candidate_pair").where("status = 'accepted'").select("left_id", "right_id", "match_probability")
    return E.merge_targets(accepted.distinct(), c.raw("canonical")).distinct()


@query(
    f"""WITH RECURSIVE t AS ({MERGES}), b AS (SELECT source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id
        ORDER BY coalesce(match_probability, -1) DESC, target_id) AS r FROM t) WHERE r = 1),
    f AS (SELECT source_id, target_id FROM b UNION SELECT f.source_id, b.target_id FROM f JOIN b ON b.source_id = f.target_id)
    SELECT source_id, target_id FROM f WHERE target_id NOT IN (SELECT source_id FROM b)"""
)
def merges_applied(c: Catalog) -> DataFrame:
    return E.apply_merges(merge_target_choice(c), "match_probability")


@query(
    """WITH p AS (SELECT DISTINCT pair_id, left_id, right_id, match_probability, status FROM candidate_pair)
    SELECT pair_id, left_id, right_id, match_probability FROM p WHERE status = 'candidate' AND match_probability BETWEEN 0.35 AND 0.85
    ORDER BY abs(match_probability - 0.5), left_id, right_id, pair_id LIMIT 250"""
)
def labeling_uncertain(c: Catalog) -> DataFrame:
    pairs = c.raw("candidate_pair").select("pair_id", "left_id", "right_id", "match_probability", "status").distinct()
    kept = pairs.where((F.col("status") == "candidate") & F.col("match_probability").between(0.35, 0.85))
    nearest = kept.orderBy(F.abs(F.col("match_probability") - 0.5), "left_id", "right_id", "pair_id").limit(250)
    return nearest.drop("status")


@query(
    f"""WITH {APPEARANCES}, o AS (SELECT {NORM.format("name")} AS normalized_name, name, role, epoch_ms(published_at) AS t FROM app),
    n AS (SELECT normalized_name, name, count(*) AS c FROM o GROUP BY 1, 2),
    b AS (SELECT normalized_name, name AS display_name FROM (SELECT *, row_number() OVER (PARTITION BY normalized_name ORDER BY c DESC, name) AS r FROM n) WHERE r = 1)
    SELECT substr(sha256('person|' || normalized_name), 1, 24) AS am_entity_id, display_name, normalized_name,
        string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*) AS observation_count, min(t) AS first_ms, max(t) AS last_ms
    FROM o JOIN b USING (normalized_name) GROUP BY normalized_name, display_name"""
)
def entity_canonicals(c: Catalog) -> DataFrame:
    observed = c.appearance.select(
        text.normalize_extraction(F.col("name")).alias("normalized_name"), F.col("name").alias("observed_name"), "role",
        ms(F.col("published_at")).alias("seen_at"),
    )
    return E.canonicals(observed).select(
        "am_entity_id", "display_name", "normalized_name", F.array_join("roles", ",").alias("roles"), "observation_count",
        F.col("first_seen_at").alias("first_ms"), F.col("last_seen_at").alias("last_ms"),
    )


@query(
    """SELECT p.normalized_name AS name, coalesce(r.t, p.normalized_name) AS resolved FROM person p LEFT JOIN (
        SELECT normalized_name AS a, trim(substr(normalized_name, 1, length(normalized_name) - 5)) AS t FROM person
        WHERE ends_with(normalized_name, ' here')) r ON r.a = p.normalized_name"""
)
def alias_rules(c: Catalog) -> DataFrame:
    name = F.col("normalized_name")
    rules = c.person.where(name.endswith(" here")).select(
        name.alias("alias"), F.trim(F.substr(name, F.lit(1), F.length(name) - 5)).alias("target"), F.lit("").alias("podcast")
    )
    names = c.person.select(name.alias("name"), F.lit("any").alias("podcast"))
    return E.apply_alias_rules(names, rules).select("name", "resolved")


# --- evolution -----------------------------------------------------------------------------

WEEK = "CAST(date_trunc('week', published_at AT TIME ZONE 'UTC') AS DATE)"
WEEKLY = f"""{APPEARANCES}, d AS (SELECT *, {WEEK} AS week FROM app WHERE published_at IS NOT NULL),
    m AS (SELECT least(g.person_id, h.person_id) AS a, greatest(g.person_id, h.person_id) AS b, min(g.week) AS week FROM d g JOIN d h
        ON g.episode_id = h.episode_id AND g.role = 'guest' AND h.role = 'host' AND g.person_id <> h.person_id GROUP BY 1, 2),
    p AS (SELECT person_id, min(week) AS week FROM d GROUP BY 1), s AS (SELECT podcast_id, min(week) AS week FROM d GROUP BY 1),
    w AS (SELECT week, CAST(sum(np) AS BIGINT) AS new_people, CAST(sum(ne) AS BIGINT) AS new_edges, CAST(sum(ns) AS BIGINT) AS new_podcasts,
        CAST(sum(x) AS BIGINT) AS episodes FROM (
        SELECT week, count(*) AS np, 0 AS ne, 0 AS ns, 0 AS x FROM p GROUP BY 1 UNION ALL SELECT week, 0, count(*), 0, 0 FROM m GROUP BY 1
        UNION ALL SELECT week, 0, 0, count(*), 0 FROM s GROUP BY 1
        UNION ALL SELECT week, 0, 0, 0, count(DISTINCT episode_id) FROM d GROUP BY 1) GROUP BY 1)"""


@query(f"WITH {WEEKLY} SELECT * FROM w")
def weekly_new_counts(c: Catalog) -> DataFrame:
    return V.weekly_new(c.appearance)


@query(
    f"""WITH {WEEKLY} SELECT week, CAST(sum(new_people) OVER o AS BIGINT) AS people, CAST(sum(new_edges) OVER o AS BIGINT) AS edges,
    CAST(sum(new_podcasts) OVER o AS BIGINT) AS podcasts, CAST(sum(episodes) OVER o AS BIGINT) AS episodes FROM w
    WINDOW o AS (ORDER BY week)"""
)
def weekly_cumulative(c: Catalog) -> DataFrame:
    return V.weekly_cumulative(V.weekly_new(c.appearance))


@query(
    f"""WITH {EPISODES}, d AS (SELECT {WEEK} AS week FROM ep WHERE published_at IS NOT NULL)
    SELECT CAST(unnest(generate_series(DATE '2024-01-08', max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM d"""
)
def weeks_missing(c: Catalog) -> DataFrame:
    stored = c.spark.sql("SELECT explode(sequence(DATE '2023-12-04', DATE '2024-01-01', INTERVAL 7 DAYS)) AS week")
    return V.weeks_missing(c.episode, stored)


@query("SELECT DISTINCT canonical_id FROM person_network_metric WHERE canonical_id IS NOT NULL AND (pagerank_rank <= 100 OR hub_rank <= 100)")
def tracked_ids(c: Catalog) -> DataFrame:
    return V.tracked_ids(c.raw("person_network_metric"), "canonical_id", ["pagerank_rank", "hub_rank"], 100)


@query(
    f"""WITH {WEEKLY}, t AS (SELECT week, CAST(new_people AS DOUBLE) AS new_people, CAST(new_edges AS DOUBLE) AS new_edges,
        CAST(new_podcasts AS DOUBLE) AS new_podcasts FROM w)
    SELECT week, series, value FROM t UNPIVOT (value FOR series IN (new_people, new_edges, new_podcasts))"""
)
def evolution_melt(c: Catalog) -> DataFrame:
    return V.melt(V.weekly_new(c.appearance), "week", ["new_people", "new_edges", "new_podcasts"])


@query("SELECT max(run_id) AS run_id, count(*) AS rows FROM person_network_metric WHERE run_id = (SELECT max(run_id) FROM person_network_metric)")
def latest_metric_run(c: Catalog) -> DataFrame:
    metric = c.raw("person_network_metric").select("run_id")
    latest = metric.where(F.col("run_id") == metric.agg(F.max("run_id")).scalar())
    return latest.agg(F.max("run_id").alias("run_id"), F.count(F.lit(1)).alias("rows"))


# --- feeds ---------------------------------------------------------------------------------


@query(
    """WITH n AS (SELECT podcast_id, guid, title, duration_raw FROM (SELECT *, row_number() OVER (PARTITION BY podcast_id, guid
        ORDER BY fetched_at DESC, parse_id DESC) AS r FROM parsed_episode WHERE podcast_id IS NOT NULL AND guid IS NOT NULL) WHERE r = 1),
    o AS (SELECT podcast_id, guid, title, duration_raw FROM (SELECT *, row_number() OVER (PARTITION BY podcast_id, guid ORDER BY id DESC) AS r
        FROM (SELECT DISTINCT id, podcast_id, guid, title, duration_raw FROM episode WHERE podcast_id IS NOT NULL AND guid IS NOT NULL)) WHERE r = 1)
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.podcast_id = o.podcast_id AND n.guid = o.guid)"""
)
def episode_upsert(c: Catalog) -> DataFrame:
    keys, cols = ["podcast_id", "guid"], ["podcast_id", "guid", "title", "duration_raw"]
    keyed = lambda df: df.where(F.col("podcast_id").isNotNull() & F.col("guid").isNotNull())
    new = feeds.latest_by_key(
        keyed(c.raw("parsed_episode")).select(*cols, "fetched_at", "parse_id"), keys, [F.col("fetched_at"), F.col("parse_id")]
    )
    old = feeds.latest_by_key(keyed(c.episode).select(*cols, "id"), keys, [F.col("id")])
    return feeds.upsert(old.select(*cols), new.select(*cols), keys)


@query(
    """SELECT parse_id, CASE WHEN trim(coalesce(guid, '')) <> '' THEN trim(guid) WHEN trim(coalesce(episode_url, '')) <> '' THEN trim(episode_url)
    ELSE 'generated:' || sha256(coalesce(nullif(trim(title), ''), 'Untitled episode') || '|' || coalesce(trim(published_at), '')) END AS key FROM parsed_episode"""
)
def guid_fallback(c: Catalog) -> DataFrame:
    none = F.lit(None).cast("string")
    key = feeds.guid_of(none, F.col("guid"), F.col("episode_url"), F.col("title"), F.col("published_at"))
    return c.raw("parsed_episode").select("parse_id", key.alias("key"))


@query()
def feed_parse(c: Catalog) -> DataFrame:
    """Shows written as RSS, one payload each, and parsed back to episodes."""
    escape = lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(
        F.lit("<item><guid>"), escape(F.col("guid")), F.lit("</guid><title>"), escape(F.col("title")),
        F.lit("</title><pubDate>"), escape(F.col("published_at")), F.lit("</pubDate><enclosure url=\""), escape(F.col("enclosure_url")),
        F.lit("\"/><duration>"), escape(F.col("duration_raw")), F.lit("</duration></item>"),
    )
    part = F.floor(F.col("parse_id") / 200)  # at most 200 items a page, so no page grows with its show
    pages = c.raw("parsed_episode").groupBy(F.col("podcast_id").alias("feed_id"), part.alias("page")).agg(F.array_join(F.collect_list(item), "").alias("items"))
    control = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
    xml = F.concat(F.lit("<rss><channel><title>t</title>"), F.regexp_replace("items", control, ""), F.lit("</channel></rss>"))
    payloads = pages.select("feed_id", F.encode(xml, "utf-8").alias("payload"))
    return feeds.episodes_of(feeds.parse_feeds(payloads)).select("feed_id", "guid", "title", "duration_raw")


@query(
    """SELECT chart, count(*) AS shows FROM (SELECT DISTINCT id, unnest(metadata.apple_podcasts.chart_sources) AS chart FROM podcast) GROUP BY 1"""
)
def chart_sources(c: Catalog) -> DataFrame:
    charts = c.podcast.select("id", F.explode("metadata.apple_podcasts.chart_sources").alias("chart")).distinct()
    return charts.groupBy("chart").agg(F.count(F.lit(1)).alias("shows"))


# --- legacy analytics ----------------------------------------------------------------------


@query(f"SELECT coalesce(({GENRES_SQL.replace('list_distinct(', '').removesuffix(')')})[1], 'Unknown') AS category, count(*) AS podcasts FROM podcast GROUP BY 1")
def category_counts(c: Catalog) -> DataFrame:
    first = F.coalesce(F.try_element_at("genres", F.lit(1)), F.lit("Unknown"))
    return c.podcast.groupBy(first.alias("category")).agg(F.count(F.lit(1)).alias("podcasts"))


_FIRST = f"coalesce(({GENRES_SQL.replace('list_distinct(', '').removesuffix(')')})[1], 'Unknown')"


@query(
    f"""WITH {APPEARANCES}, k AS (SELECT id, {_FIRST} AS category FROM podcast)
    SELECT a.category AS left_category, b.category AS right_category, CAST(sum(n) AS BIGINT) AS weight FROM (
        SELECT x.podcast_id AS a, y.podcast_id AS b, count(*) AS n FROM (SELECT DISTINCT person_id, podcast_id FROM app WHERE role = 'guest') x
        JOIN (SELECT DISTINCT person_id, podcast_id FROM app WHERE role = 'guest') y ON x.person_id = y.person_id AND x.podcast_id < y.podcast_id
        GROUP BY 1, 2) e JOIN k a ON a.id = e.a JOIN k b ON b.id = e.b GROUP BY 1, 2"""
)
def category_mixing_crosstab(c: Catalog) -> DataFrame:
    from castweave.operators.graph import shared_guest_pairs

    first = F.coalesce(F.try_element_at("genres", F.lit(1)), F.lit("Unknown"))
    kinds = c.podcast.select("id", first.alias("category"))
    pairs = shared_guest_pairs(c.appearance)
    joined = pairs.join(kinds.toDF("a", "left_category"), "a").join(kinds.toDF("b", "right_category"), "b")
    return ops.crosstab(joined, "left_category", "right_category", "shared_guests")


@query(f"WITH {EPISODES} SELECT podcast_id, round(avg(TRY_CAST(duration_raw AS DOUBLE)), 6) AS mean FROM ep GROUP BY 1")
def mean_of_parsable(c: Catalog) -> DataFrame:
    return c.episode.groupBy("podcast_id").agg(F.round(F.avg(F.col("duration_raw").try_cast("double")), 6).alias("mean"))


@query(
    """WITH v AS (SELECT CAST(observation_count AS DOUBLE) AS v FROM canonical WHERE observation_count > 0),
    b AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
    SELECT CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 24), 23) ELSE 0 END AS INTEGER) AS bin, count(*) AS count
    FROM v, b GROUP BY 1"""
)
def histogram_24(c: Catalog) -> DataFrame:
    return ops.histogram(c.raw("canonical"), "observation_count")


# --- stream --------------------------------------------------------------------------------


@query(
    """SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS events FROM events GROUP BY 1, 2"""
)
def weekly_stream_counts(c: Catalog) -> DataFrame:
    out = weekly.run_once(c.spark, c.sf_dir, "events.parquet", lambda s: weekly.weekly_counts(s, "ts", "event_type"), ["w", "event_type"])
    return out.select(F.to_date("w.start").alias("week"), "event_type", "events")
