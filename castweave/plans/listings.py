"""Queries over shows, people, rankings and recommendations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castweave.functions import text
from castweave.operators import recommend as R
from castweave.operators import relational as ops
from castweave.sources.catalog import APPEARANCES, CANDIDATES, EPISODES, GENRES_SQL, NON_ENGLISH_SQL, Catalog

SELECTED, EXCLUDED = [290, 983, 800], [650]
ACTIVE_SINCE_MS = 1_735_689_600_000  # 2025-01-01
FIRST, SECOND = 983, 800
QUERIES: dict = {}
SQL: dict[str, str] = {}
_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def clean_names_sql(source: str, name: str = "name") -> str:
    """CTEs that end in ``named``: the rows of ``source`` with ``clean``, the cleaned display name."""
    squeezed = [_SQUEEZE.format(f"c{i}") for i in range(6)]
    return f"""n1 AS (SELECT *, CASE WHEN regexp_full_match(trim({name}), '@[A-Za-z][A-Za-z0-9_]{{2,30}}')
            THEN replace(substr(trim({name}), 2), '_', ' ') ELSE trim({name}) END AS c1 FROM {source}),
        n2 AS (SELECT *, regexp_replace(regexp_replace(c1, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g') AS c2 FROM n1),
        n3 AS (SELECT *, CASE WHEN lower(c2) = 'autopritts' THEN 'Auto Pritts' ELSE c2 END AS c3 FROM n2),
        n4 AS (SELECT *, CASE WHEN len(string_split({squeezed[3]}, ' ')) >= 3 AND lower(string_split({squeezed[3]}, ' ')[-1]) = 'here'
            THEN array_to_string(string_split({squeezed[3]}, ' ')[:-2], ' ') ELSE c3 END AS c4 FROM n3),
        n5 AS (SELECT *, CASE WHEN contains({squeezed[4]}, ' ') THEN regexp_replace({squeezed[4]}, '([A-Za-z])[0-9]{{1,4}}$', '\\1') ELSE c4 END AS c5 FROM n4),
        named AS (SELECT * EXCLUDE (c1, c2, c3, c4, c5), {_SQUEEZE.format(
            "CASE WHEN length(regexp_replace(c5, '[^\\p{L}]', '', 'g')) > 2 AND upper(regexp_replace(c5, '[^\\p{L}]', '', 'g')) = regexp_replace(c5, '[^\\p{L}]', '', 'g') "
            f"THEN array_to_string([upper(w[1]) || lower(w[2:]) for w in regexp_extract_all(c5, '[{_LETTERS}]+|[^{_LETTERS}]+')], '') ELSE c5 END"
        )} AS clean FROM n5)"""


NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def query(sql: str | None = None):
    """Register a function of a catalog as a query, with its SQL."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Catalog(spark, sf_dir))

        QUERIES[function.__name__] = run
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


@query(
    f"""WITH {APPEARANCES} SELECT (SELECT count(*) FROM podcast) AS podcasts, (SELECT count(*) FROM ep) AS episodes,
    (SELECT count(*) FROM person) AS people, (SELECT count(*) FROM app) AS appearances"""
)
def catalog_counts(c: Catalog) -> DataFrame:
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return c.spark.range(1).select(
        count(c.podcast.select("id")).alias("podcasts"),
        count(c.episode).alias("episodes"),
        count(c.person.select("id")).alias("people"),
        count(c.appearance).alias("appearances"),
    )


@query(
    f"""WITH {APPEARANCES}, n AS (
        SELECT podcast_id, count(DISTINCT person_id) FILTER (WHERE role = 'guest') AS guests,
               count(DISTINCT person_id) FILTER (WHERE role = 'host') AS hosts FROM app GROUP BY 1),
    t AS (SELECT podcast_id, count(DISTINCT id) AS episodes, epoch_ms(max(published_at)) AS latest_ms FROM ep GROUP BY 1)
    SELECT * FROM (SELECT p.id AS podcast_id, p.name, guests, hosts, coalesce(episodes, 0) AS episodes, latest_ms
        FROM podcast p JOIN n ON n.podcast_id = p.id LEFT JOIN t ON t.podcast_id = p.id WHERE guests > 0
        ORDER BY guests DESC, p.name LIMIT 1000) WHERE NOT regexp_matches(name, '{NON_ENGLISH_SQL}')"""
)
def podcasts_listing(c: Catalog) -> DataFrame:
    return ops.podcast_listing(c.podcast, c.episode, c.appearance)


@query(
    f"""WITH {APPEARANCES} SELECT person_id, name, count(*) AS appearances, epoch_ms(max(published_at)) AS latest_ms
    FROM app WHERE podcast_id = {FIRST} AND role = 'guest'
      AND person_id NOT IN (SELECT person_id FROM app WHERE podcast_id = {FIRST} AND role = 'host')
    GROUP BY 1, 2 ORDER BY appearances DESC, name, person_id LIMIT 100"""
)
def podcast_detail_guests(c: Catalog) -> DataFrame:
    return ops.podcast_guests(c.appearance, FIRST)


PEOPLE = """SELECT person_id, name, count(*) FILTER (WHERE role = 'guest') AS guest_appearances,
    count(*) FILTER (WHERE role = 'host') AS host_appearances, count(DISTINCT podcast_id) AS podcasts,
    epoch_ms(min(published_at)) AS first_ms, epoch_ms(max(published_at)) AS latest_ms FROM app GROUP BY 1, 2"""


@query(f"WITH {APPEARANCES} {PEOPLE}")
def people_listing(c: Catalog) -> DataFrame:
    return ops.people_stats(c.appearance)


@query(
    f"""WITH {APPEARANCES} SELECT * FROM ({PEOPLE})
    ORDER BY guest_appearances DESC, name, person_id LIMIT 250"""
)
def rankings_by_appearances(c: Catalog) -> DataFrame:
    return ops.ranked_people(c.appearance, "guest")


@query(
    f"""WITH {APPEARANCES} SELECT * FROM ({PEOPLE})
    ORDER BY latest_ms DESC NULLS LAST, name, person_id LIMIT 250"""
)
def rankings_by_date(c: Catalog) -> DataFrame:
    return ops.ranked_people(c.appearance, "recent")


@query("SELECT id, name FROM person WHERE contains(lower(name), 'ov')")
def people_search(c: Catalog) -> DataFrame:
    return ops.search(c.person, "name", "OV").select("id", "name")


@query(
    f"""WITH {APPEARANCES} SELECT person_id, podcast_id, count(DISTINCT episode_id) AS episodes FROM app
    GROUP BY 1, 2 HAVING count(DISTINCT episode_id) > 1"""
)
def person_podcast_rows(c: Catalog) -> DataFrame:
    counted = c.appearance.groupBy("person_id", "podcast_id").agg(F.countDistinct("episode_id").alias("episodes"))
    return counted.where("episodes > 1")


@query(
    f"""WITH {APPEARANCES} SELECT person_id, name, count(*) AS appearances FROM app
    WHERE podcast_id = {SECOND} AND role = 'guest'
      AND person_id IN (SELECT person_id FROM app WHERE podcast_id = {FIRST} AND role = 'guest')
    GROUP BY 1, 2 ORDER BY appearances DESC, name, person_id LIMIT 250"""
)
def common_guests(c: Catalog) -> DataFrame:
    return ops.common_guests(c.appearance, FIRST, SECOND)


@query(
    f"WITH {APPEARANCES} SELECT DISTINCT podcast_id, person_id, name FROM app WHERE role = 'host'"
)
def hosts_by_podcast(c: Catalog) -> DataFrame:
    return ops.hosts_by_podcast(c.appearance)


COHOSTS = """g AS (SELECT podcast_id, person_id, count(DISTINCT episode_id) AS guest_episodes FROM app
        WHERE role = 'guest' GROUP BY 1, 2),
    t AS (SELECT podcast_id, count(DISTINCT id) AS episodes FROM ep GROUP BY 1),
    co AS (SELECT podcast_id, person_id, guest_episodes, episodes FROM g JOIN t USING (podcast_id)
        WHERE guest_episodes > 100 OR guest_episodes > 0.2 * episodes)"""


@query(f"WITH {APPEARANCES}, {COHOSTS} SELECT * FROM co")
def cohost_pairs_share(c: Catalog) -> DataFrame:
    return ops.frequent_guests(c.appearance, c.episode)


@query(
    f"""WITH {APPEARANCES}, {COHOSTS} SELECT DISTINCT episode_id, app.podcast_id, app.person_id,
    CASE WHEN co.person_id IS NOT NULL THEN 'host' ELSE role END AS role
    FROM app LEFT JOIN co ON co.podcast_id = app.podcast_id AND co.person_id = app.person_id"""
)
def promote_cohosts(c: Catalog) -> DataFrame:
    return ops.promote_cohosts(c.appearance, c.episode)


@query(
    f"""WITH {APPEARANCES}, g AS (SELECT podcast_id, count(DISTINCT episode_id) AS n FROM app WHERE role = 'guest' GROUP BY 1),
    t AS (SELECT podcast_id, count(DISTINCT id) AS episodes FROM ep GROUP BY 1)
    SELECT podcast_id, episodes, coalesce(n, 0) AS guest_episodes, coalesce(n, 0) / episodes AS ratio
    FROM t LEFT JOIN g USING (podcast_id) WHERE episodes >= 3 AND coalesce(n, 0) / episodes < 0.5"""
)
def guest_ratio_below(c: Catalog) -> DataFrame:
    return ops.guest_ratio(c.appearance, c.episode, least=3, below=0.5)


@query("SELECT id, name FROM podcast WHERE is_interview_podcast IS DISTINCT FROM false")
def null_safe_exclude(c: Catalog) -> DataFrame:
    return c.podcast.where(~F.col("is_interview_podcast").eqNullSafe(False)).select("id", "name")


@query(f"SELECT id, name FROM podcast WHERE NOT regexp_matches(name, '{NON_ENGLISH_SQL}')")
def english_script_filter(c: Catalog) -> DataFrame:
    return c.podcast.where(text.is_english_name(F.col("name"))).select("id", "name")


@query(
    """SELECT id, name FROM podcast WHERE replace(lower(trim(coalesce(metadata.rss.language, ''))), '_', '-') IN ('', 'en')
    OR starts_with(replace(lower(trim(coalesce(metadata.rss.language, ''))), '_', '-'), 'en-')"""
)
def english_language_code(c: Catalog) -> DataFrame:
    code = F.coalesce(F.col("metadata.rss.language"), F.lit(""))
    return c.podcast.where(text.is_english_code(code)).select("id", "name")


@query(
    """SELECT id, name FROM podcast WHERE active IS NOT DISTINCT FROM false OR is_interview_podcast IS NOT DISTINCT FROM false
    OR metadata.extraction_policy.skip_guest_extraction IS NOT DISTINCT FROM true"""
)
def policy_struct_predicate(c: Catalog) -> DataFrame:
    skip = F.col("metadata.extraction_policy.skip_guest_extraction").eqNullSafe(True)
    return c.podcast.where(F.col("active").eqNullSafe(False) | F.col("is_interview_podcast").eqNullSafe(False) | skip).select(
        "id", "name"
    )


@query(
    f"""WITH {APPEARANCES} SELECT DISTINCT person_id FROM app
    WHERE role = 'guest' AND podcast_id IN ({", ".join(map(str, SELECTED))})"""
)
def reco_selected_guests(c: Catalog) -> DataFrame:
    return R.selected_guests(c.appearance, SELECTED)


def _reco_sql(excluded: list[int]) -> str:
    out = ", ".join(map(str, excluded)) or "-1"
    ours = ", ".join(map(str, SELECTED))
    return f"""WITH {APPEARANCES}, ga AS (SELECT * FROM app WHERE role = 'guest'),
    pod AS (SELECT id, name, active, {GENRES_SQL} AS genres FROM podcast),
    sel AS (SELECT DISTINCT person_id FROM ga WHERE podcast_id IN ({ours})),
    o AS (SELECT podcast_id, name, active, genres, shared, matching FROM (
            SELECT podcast_id, count(DISTINCT person_id) AS shared, count(*) AS matching FROM ga
            WHERE person_id IN (SELECT person_id FROM sel) AND podcast_id NOT IN ({ours}, {out}) GROUP BY 1) x
        JOIN pod ON pod.id = podcast_id ORDER BY shared DESC, matching DESC, name LIMIT 200),
    u AS (SELECT podcast_id, count(DISTINCT person_id) AS unique_guests FROM ga GROUP BY 1),
    l AS (SELECT podcast_id, epoch_ms(max(published_at)) AS latest_ms FROM ep GROUP BY 1),
    x AS (SELECT podcast_id, count(DISTINCT person_id) AS og FROM ga
        WHERE person_id IN (SELECT person_id FROM ga WHERE podcast_id IN ({out})) GROUP BY 1),
    xg AS (SELECT coalesce(list_distinct(flatten(list(genres))), []) AS g FROM pod WHERE id IN ({out})),
    s0 AS (SELECT o.podcast_id, name, active, genres, shared, matching, coalesce(unique_guests, 0) AS unique_guests, latest_ms,
            CASE WHEN unique_guests > 0 THEN shared / unique_guests ELSE 0 END AS rate,
            coalesce(og, 0) * 120 + len(list_intersect(genres, xg.g)) * 25 AS penalty
        FROM o LEFT JOIN u USING (podcast_id) LEFT JOIN l USING (podcast_id) LEFT JOIN x USING (podcast_id), xg
        WHERE NOT regexp_matches(name, '{NON_ENGLISH_SQL}')),
    s AS (SELECT *, CAST(round_even(rate * 10000, 0) + shared - penalty AS BIGINT) AS rate_score,
            CAST(shared * 100 + matching - penalty AS BIGINT) AS overlap_score FROM s0)"""


RECO_COLUMNS = "podcast_id, name, shared, matching, unique_guests, latest_ms, rate, CAST(penalty AS BIGINT) AS penalty, rate_score, overlap_score"
RATE_ORDER = "ORDER BY rate_score DESC, rate DESC, shared DESC, matching DESC, name LIMIT 20"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "podcast_id", "name", "shared", "matching", "unique_guests", "latest_ms", "rate",
        F.col("penalty").cast("long").alias("penalty"), "rate_score", "overlap_score",
    )


def _scored(c: Catalog, excluded: list[int] = ()) -> DataFrame:
    return R.score_candidates(c.podcast, c.episode, c.appearance, SELECTED, list(excluded))


@query(f"{_reco_sql([])} SELECT {RECO_COLUMNS} FROM s")
def reco_candidates_scored(c: Catalog) -> DataFrame:
    return _shown(_scored(c))


@query(f"{_reco_sql([])} SELECT {RECO_COLUMNS} FROM s {RATE_ORDER}")
def reco_sorted_rate(c: Catalog) -> DataFrame:
    return _shown(R.recommend(_scored(c), "rate"))


@query(f"{_reco_sql([])} SELECT {RECO_COLUMNS} FROM s ORDER BY overlap_score DESC, shared DESC, matching DESC, name LIMIT 20")
def reco_sorted_overlap(c: Catalog) -> DataFrame:
    return _shown(R.recommend(_scored(c), "overlap"))


@query(f"{_reco_sql([])} SELECT {RECO_COLUMNS} FROM s WHERE list_has_any(genres, ['Comedy', 'Music']) {RATE_ORDER}")
def reco_genre_filter(c: Catalog) -> DataFrame:
    return _shown(R.recommend(_scored(c), "rate", genres=["Comedy", "Music"]))


@query(
    f"""{_reco_sql([])} SELECT {RECO_COLUMNS} FROM s WHERE active IS DISTINCT FROM false
    AND (latest_ms IS NULL OR latest_ms >= {ACTIVE_SINCE_MS}) {RATE_ORDER}"""
)
def reco_active_only(c: Catalog) -> DataFrame:
    return _shown(R.recommend(_scored(c), "rate", active_since_ms=ACTIVE_SINCE_MS))


@query(f"{_reco_sql(EXCLUDED)} SELECT {RECO_COLUMNS} FROM s")
def reco_exclusion_penalty(c: Catalog) -> DataFrame:
    return _shown(_scored(c, EXCLUDED))


@query(
    f"""{_reco_sql([])}, top AS (SELECT podcast_id FROM s {RATE_ORDER}),
    ours AS (SELECT person_id, count(*) AS ours FROM ga WHERE podcast_id IN ({", ".join(map(str, SELECTED))}) GROUP BY 1),
    b AS (SELECT podcast_id, person_id, name, count(*) AS theirs FROM ga
        WHERE podcast_id IN (SELECT podcast_id FROM top) GROUP BY 1, 2, 3)
    SELECT * FROM (SELECT podcast_id, person_id, name, theirs, ours, ours + theirs AS total,
        row_number() OVER (PARTITION BY podcast_id ORDER BY ours + theirs DESC, theirs DESC, name, person_id) AS rank
        FROM b JOIN ours USING (person_id)) WHERE rank <= 5"""
)
def reco_shared_guests_top5(c: Catalog) -> DataFrame:
    return R.shared_guests(c.appearance, SELECTED, R.recommend(_scored(c), "rate"))


@query(
    f"""{_reco_sql([])}, top AS (SELECT podcast_id FROM s {RATE_ORDER}),
    ours AS (SELECT podcast_id AS source_id, person_id, count(*) AS ours FROM ga
        WHERE podcast_id IN ({", ".join(map(str, SELECTED))}) GROUP BY 1, 2),
    b AS (SELECT podcast_id, person_id, name, count(*) AS theirs FROM ga
        WHERE podcast_id IN (SELECT podcast_id FROM top) GROUP BY 1, 2, 3),
    pr AS (SELECT b.podcast_id, b.person_id, b.name, theirs, ours, source_id, p.name AS source
        FROM b JOIN ours USING (person_id) JOIN podcast p ON p.id = source_id),
    n AS (SELECT podcast_id, source_id, source, count(*) AS shared FROM pr GROUP BY 1, 2, 3),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY podcast_id ORDER BY shared DESC, source DESC, source_id DESC) AS r
        FROM n) WHERE r = 1),
    k AS (SELECT pr.podcast_id, best.source, best.shared, pr.name,
        row_number() OVER (PARTITION BY pr.podcast_id ORDER BY ours + theirs DESC, theirs DESC, pr.name, pr.person_id) AS rank
        FROM pr JOIN best ON best.podcast_id = pr.podcast_id AND best.source_id = pr.source_id)
    SELECT podcast_id, source, shared, string_agg(name, ', ' ORDER BY rank) AS guests FROM k WHERE rank <= 3 GROUP BY 1, 2, 3"""
)
def reco_explanations(c: Catalog) -> DataFrame:
    return R.explain(c.appearance, c.podcast, SELECTED, R.recommend(_scored(c), "rate"))


@query(
    f"""WITH {CANDIDATES}, p AS (SELECT *, max(pass_no) OVER (PARTITION BY episode_id) AS best FROM cand)
    SELECT episode_id, pass_no, count(*) AS names FROM p WHERE pass_no = best GROUP BY 1, 2"""
)
def preferred_extraction(c: Catalog) -> DataFrame:
    best = ops.preferred(c.candidate, ["episode_id"], "pass_no")
    return best.groupBy("episode_id", "pass_no").agg(F.count(F.lit(1)).alias("names"))


@query(f"WITH {CANDIDATES} SELECT id FROM ep WHERE id NOT IN (SELECT episode_id FROM cand)")
def select_unextracted(c: Catalog) -> DataFrame:
    done = c.candidate.select(F.col("episode_id").alias("id"))
    return c.episode.select("id").distinct().join(done, "id", "left_anti")


@query(
    f"""WITH {CANDIDATES} SELECT DISTINCT id FROM ep
    WHERE id IN (SELECT episode_id FROM cand WHERE confidence >= 0.92 AND confidence < 0.97)
      AND id NOT IN (SELECT episode_id FROM cand WHERE confidence >= 0.97)
      AND id NOT IN (SELECT episode_id FROM cand WHERE pass_no = 2)"""
)
def select_confidence_band(c: Catalog) -> DataFrame:
    key = F.col("episode_id").alias("id")
    low = c.candidate.where((F.col("confidence") >= 0.92) & (F.col("confidence") < 0.97)).select(key)
    high = c.candidate.where(F.col("confidence") >= 0.97).select(key)
    second = c.candidate.where("pass_no = 2").select(key)
    ids = c.episode.select("id").distinct()
    return ids.join(low, "id", "left_semi").join(high, "id", "left_anti").join(second, "id", "left_anti")


@query(
    f"""WITH {CANDIDATES}, hosts AS (SELECT e.podcast_id, p.name FROM lineitem JOIN ep e ON l_orderkey = e.id
        JOIN person p ON l_partkey = p.id WHERE l_linenumber = 1),
    both_ AS (SELECT episode_id, podcast_id, name, confidence, false AS host FROM (
            SELECT *, max(pass_no) OVER (PARTITION BY episode_id) AS best FROM cand) WHERE pass_no = best AND confidence >= 0.95
        UNION ALL SELECT NULL, podcast_id, name, NULL, true FROM hosts),
    {clean_names_sql("both_")},
    k AS (SELECT *, {NORM.format("clean")} AS normalized, {NORM.format("name")} AS raw FROM named)
    SELECT episode_id, normalized, list(confidence ORDER BY raw DESC, confidence)[1] AS confidence, min(clean) AS name FROM k
    WHERE NOT host AND normalized <> '' AND len(regexp_extract_all(lower(clean), '[a-z0-9]+')) >= 2
      AND NOT EXISTS (SELECT 1 FROM k h WHERE h.host AND h.podcast_id = k.podcast_id AND h.normalized = k.normalized)
    GROUP BY 1, 2"""
)
def materialise_appearances(c: Catalog) -> DataFrame:
    return ops.materialise(c.candidate, c.appearance, least=0.95)


@query("SELECT id, name FROM person WHERE normalized_name <> '' AND NOT contains(normalized_name, ' ')")
def single_token_names(c: Catalog) -> DataFrame:
    blank = F.col("normalized_name") != ""
    return c.person.where(blank & ~F.col("normalized_name").contains(" ")).select("id", "name")


@query(
    f"""WITH {APPEARANCES}, s AS (SELECT person_id, count(*) FILTER (WHERE role = 'guest') AS guest_appearances FROM app GROUP BY 1)
    SELECT person_id, guest_appearances,
           row_number() OVER (ORDER BY guest_appearances DESC, CAST(person_id AS VARCHAR)) AS rank FROM s"""
)
def metric_ranks(c: Catalog) -> DataFrame:
    stats = ops.people_stats(c.appearance).select("person_id", "guest_appearances")
    return ops.global_rank(stats, "guest_appearances", "person_id", "rank")


@query(
    f"""WITH {EPISODES}, t AS (SELECT id, podcast_id, row_number() OVER (PARTITION BY podcast_id ORDER BY published_at DESC NULLS LAST, id) AS rank
    FROM ep) SELECT podcast_id, id, rank FROM t WHERE rank <= 3"""
)
def latest_episodes_per_show(c: Catalog) -> DataFrame:
    order = [F.desc_nulls_last("published_at"), F.asc("id")]
    return ops.top_per_group(c.episode.select("id", "podcast_id", "published_at"), ["podcast_id"], order, 3).select(
        "podcast_id", "id", "rank"
    )


@query()
def diverse_episode_sample(c: Catalog) -> DataFrame:
    return ops.diverse_sample(c.episode.select("id", "podcast_id"), "podcast_id", "id", 500, seed=7)
