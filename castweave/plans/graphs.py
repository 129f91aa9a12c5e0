"""Queries over the appearance graph; iterations are unrolled in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castweave.operators import graph as G
from castweave.operators import network as N
from castweave.operators import paths as P
from castweave.operators import relational as ops
from castweave.plans.listings import COHOSTS
from castweave.runtime import cut
from castweave.sources.catalog import APPEARANCES, Catalog

QUERIES: dict = {}
SQL: dict[str, str] = {}
ROUNDS, SAMPLE, DEPTH, LABEL_ROUNDS = 10, 25, 8, 10
SOURCE, TARGET = 1, 2
WINDOW = ("2015-01-01", "2022-12-31")


def query(sql: str | None = None):
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Catalog(spark, sf_dir))

        QUERIES[function.__name__] = run
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


EDGES = (
    APPEARANCES
    + """,
e AS (SELECT g.person_id AS src, h.person_id AS dst, count(*) AS weight FROM app g JOIN app h
      ON g.episode_id = h.episode_id AND g.role = 'guest' AND h.role = 'host' AND g.person_id <> h.person_id GROUP BY 1, 2),
n AS (SELECT DISTINCT person_id AS id FROM app),
u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS weight FROM e GROUP BY 1, 2),
st AS (SELECT a AS src, b AS dst FROM u UNION ALL SELECT b, a FROM u)"""
)


def nodes(c: Catalog) -> DataFrame:
    return c.appearance.select(F.col("person_id").alias("id")).distinct()


@query(f"WITH {EDGES} SELECT * FROM e")
def person_edges(c: Catalog) -> DataFrame:
    return G.person_edges(c.appearance)


@query(f"WITH {EDGES} SELECT a, b, CAST(weight AS BIGINT) AS weight FROM u")
def undirected_edges(c: Catalog) -> DataFrame:
    return G.undirected(G.person_edges(c.appearance))


@query(
    f"""WITH {APPEARANCES}, g AS (SELECT DISTINCT person_id, podcast_id FROM app WHERE role = 'guest')
    SELECT x.podcast_id AS a, y.podcast_id AS b, count(*) AS shared_guests FROM g x JOIN g y
    ON x.person_id = y.person_id AND x.podcast_id < y.podcast_id GROUP BY 1, 2"""
)
def podcast_similarity(c: Catalog) -> DataFrame:
    return G.shared_guest_pairs(c.appearance)


@query(
    f"""WITH {EDGES}, d AS (SELECT src AS id, count(*) AS degree FROM st GROUP BY 1)
    SELECT id, coalesce(degree, 0) AS degree,
           round(coalesce(degree, 0) / ((SELECT count(*) FROM n) - 1), 9) AS degree_centrality FROM n LEFT JOIN d USING (id)"""
)
def degree_centrality(c: Catalog) -> DataFrame:
    out = G.degree(G.undirected(G.person_edges(c.appearance)), nodes(c))
    return out.withColumn("degree_centrality", F.round("degree_centrality", 9))


def _pagerank_sql(rounds: int) -> str:
    steps = ["o AS (SELECT src, sum(weight) AS w FROM e GROUP BY 1)", "k AS (SELECT count(*) AS c FROM n)",
             "r0 AS (SELECT id, 1.0 / c AS r FROM n, k)"]
    for i in range(rounds):
        steps.append(
            f"""r{i + 1} AS (SELECT n.id, 0.85 * (coalesce(x.s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i}
                WHERE id NOT IN (SELECT src FROM o)) / c) + 0.15 / c AS r FROM n CROSS JOIN k LEFT JOIN (
                SELECT e.dst, sum(r * weight / w) AS s FROM e JOIN o ON o.src = e.src JOIN r{i} ON r{i}.id = e.src GROUP BY 1
                ) x ON x.dst = n.id)"""
        )
    return f"WITH {EDGES}, {', '.join(steps)} SELECT id, round(r, 9) AS rank FROM r{rounds}"


@query(_pagerank_sql(ROUNDS))
def pagerank_k(c: Catalog) -> DataFrame:
    ranks = G.pagerank(G.person_edges(c.appearance), nodes(c), iterations=ROUNDS, tolerance=None)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


def _hits_sql(rounds: int) -> str:
    steps = ["h0 AS (SELECT id, 1.0 AS h FROM n)"]
    for i in range(rounds):
        steps += [
            f"a{i} AS (SELECT dst AS id, sum(h * weight) AS a FROM e JOIN h{i} ON h{i}.id = src GROUP BY 1)",
            f"w{i} AS (SELECT src AS id, sum(a * weight) AS h FROM e JOIN a{i} ON a{i}.id = dst GROUP BY 1)",
            f"h{i + 1} AS (SELECT id, h / (SELECT sum(h) FROM w{i}) AS h FROM w{i})",
        ]
    steps.append(f"af AS (SELECT dst AS id, sum(h * weight) AS a FROM e JOIN h{rounds} ON h{rounds}.id = src GROUP BY 1)")
    return f"""WITH {EDGES}, {", ".join(steps)} SELECT n.id, round(coalesce(h, 0), 9) AS hub,
        round(coalesce(a / (SELECT sum(a) FROM af), 0), 9) AS authority
        FROM n LEFT JOIN h{rounds} h ON h.id = n.id LEFT JOIN af ON af.id = n.id"""


@query(_hits_sql(ROUNDS))
def hits_k(c: Catalog) -> DataFrame:
    scores = G.hits(G.person_edges(c.appearance), nodes(c), iterations=ROUNDS, tolerance=None)
    return scores.select("id", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


def _levels_sql() -> str:
    steps = [f"s AS (SELECT id FROM n ORDER BY CAST(id AS VARCHAR) LIMIT {SAMPLE})",
             "l0 AS (SELECT id AS src, id AS node, 0 AS dist FROM s)", "v0 AS (SELECT * FROM l0)"]
    for i in range(DEPTH):
        steps += [
            f"""l{i + 1} AS (SELECT DISTINCT l.src, st.dst AS node, {i + 1} AS dist FROM l{i} l JOIN st ON st.src = l.node
                WHERE NOT EXISTS (SELECT 1 FROM v{i} v WHERE v.src = l.src AND v.node = st.dst))""",
            f"v{i + 1} AS (SELECT * FROM v{i} UNION ALL SELECT * FROM l{i + 1})",
        ]
    return ", ".join(steps)


def _distances(c: Catalog) -> DataFrame:
    steps = G.both_ways(G.undirected(G.person_edges(c.appearance)))
    people = cut(nodes(c))
    return G.source_sums(steps, people, G.first_by_text(people, SAMPLE))


@query(
    f"""WITH {EDGES}, {_levels_sql()} SELECT n.id, round(coalesce(count(dist) / sum(dist), 0), 9) AS closeness
    FROM n LEFT JOIN (SELECT * FROM v{DEPTH} WHERE dist > 0) v ON v.node = n.id GROUP BY n.id"""
)
def closeness_sampled(c: Catalog) -> DataFrame:
    out = G.closeness(_distances(c), nodes(c), sampled=True)
    return out.withColumn("closeness", F.round("closeness", 9))


@query(f"WITH {EDGES}, {_levels_sql()} SELECT round(coalesce(avg(dist), 0), 9) AS average_path FROM v{DEPTH} WHERE dist > 0")
def avg_path_sampled(c: Catalog) -> DataFrame:
    return G.average_path(_distances(c)).select(F.round("average_path", 9).alias("average_path"))


def _betweenness_sql() -> str:
    steps = [f"s AS (SELECT id FROM n ORDER BY CAST(id AS VARCHAR) LIMIT {SAMPLE})",
             "l0 AS (SELECT id AS src, id AS node, CAST(1 AS DOUBLE) AS paths FROM s)", "v0 AS (SELECT src, node FROM l0)"]
    for i in range(DEPTH):
        steps += [
            f"""l{i + 1} AS (SELECT l.src, st.dst AS node, sum(paths) AS paths FROM l{i} l JOIN st ON st.src = l.node
                WHERE NOT EXISTS (SELECT 1 FROM v{i} v WHERE v.src = l.src AND v.node = st.dst) GROUP BY 1, 2)""",
            f"v{i + 1} AS (SELECT * FROM v{i} UNION ALL SELECT src, node FROM l{i + 1})",
        ]
    steps.append(f"d{DEPTH} AS (SELECT src, node, CAST(0 AS DOUBLE) AS delta FROM l{DEPTH})")
    for i in range(DEPTH - 1, 0, -1):
        steps.append(
            f"""d{i} AS (SELECT a.src, a.node, sum(a.paths / b.paths * (1 + coalesce(d.delta, 0))) AS delta FROM l{i} a
                JOIN st ON st.src = a.node JOIN l{i + 1} b ON b.src = a.src AND b.node = st.dst
                LEFT JOIN d{i + 1} d ON d.src = b.src AND d.node = b.node GROUP BY 1, 2)"""
        )
    every = " UNION ALL ".join(f"SELECT node, delta FROM d{i}" for i in range(1, DEPTH + 1))
    return f"""WITH {EDGES}, {", ".join(steps)}, k AS (SELECT CAST(count(*) AS DOUBLE) AS c FROM n),
        x AS (SELECT node, sum(delta) AS d FROM ({every}) GROUP BY 1)
        SELECT id, round(coalesce(d, 0) / ((c - 1) * (c - 2)) * c / {SAMPLE}, 9) AS betweenness
        FROM n CROSS JOIN k LEFT JOIN x ON x.node = id"""


@query(_betweenness_sql())
def betweenness_sampled(c: Catalog) -> DataFrame:
    steps = cut(G.both_ways(G.undirected(G.person_edges(c.appearance))))
    dist = G.distances(steps, G.first_by_text(nodes(c), SAMPLE))
    return G.betweenness(steps, nodes(c), dist, SAMPLE).withColumn("betweenness", F.round("betweenness", 9))


# The queries above are bounded to what unrolled SQL can bear; those below run the operators' own parameters, without SQL.


@query()
def pagerank(c: Catalog) -> DataFrame:
    return G.pagerank(G.person_edges(c.appearance), nodes(c))


@query()
def hits(c: Catalog) -> DataFrame:
    return G.hits(G.person_edges(c.appearance), nodes(c))


def _graph(c: Catalog) -> tuple[DataFrame, DataFrame]:
    return cut(G.both_ways(G.undirected(G.person_edges(c.appearance)))), cut(nodes(c))


@query()
def closeness(c: Catalog) -> DataFrame:
    return N.closeness(*_graph(c))


@query()
def betweenness(c: Catalog) -> DataFrame:
    return N.betweenness(*_graph(c))


@query()
def average_path(c: Catalog) -> DataFrame:
    steps, people = _graph(c)
    sources, _ = N.sources(people, N.PATH_SAMPLE)
    return G.average_path(G.source_sums(steps, people, sources))


@query()
def person_metrics(c: Catalog) -> DataFrame:
    return N.person_metrics(c.appearance)


@query()
def podcast_metrics(c: Catalog) -> DataFrame:
    return N.podcast_metrics(c.appearance)


def _labels_sql() -> str:
    steps = ["c0 AS (SELECT id, id AS component FROM n)"]
    for i in range(LABEL_ROUNDS):
        steps.append(
            f"""c{i + 1} AS (SELECT c.id, least(c.component, coalesce(min(d.component), c.component)) AS component
            FROM c{i} c LEFT JOIN st ON st.src = c.id LEFT JOIN c{i} d ON d.id = st.dst GROUP BY c.id, c.component)"""
        )
    return ", ".join(steps) + f", comp AS (SELECT * FROM c{LABEL_ROUNDS})"


@query(f"WITH {EDGES}, {_labels_sql()} SELECT id, component FROM comp")
def connected_components(c: Catalog) -> DataFrame:
    return G.components(G.both_ways(G.undirected(G.person_edges(c.appearance))), nodes(c))


@query(
    f"""WITH {EDGES}, {_labels_sql()},
    big AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1),
    m AS (SELECT id FROM comp WHERE component = (SELECT component FROM big)),
    iu AS (SELECT a, b FROM u WHERE a IN (SELECT id FROM m) AND b IN (SELECT id FROM m)),
    ist AS (SELECT a AS src, b AS dst FROM iu UNION ALL SELECT b, a FROM iu),
    dg AS (SELECT m.id, count(dst) AS d FROM m LEFT JOIN ist ON src = m.id GROUP BY 1),
    tri AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM iu x JOIN iu y ON x.b = y.a JOIN iu z ON z.a = x.a AND z.b = y.b),
    tc AS (SELECT id, count(*) AS t FROM (SELECT i AS id FROM tri UNION ALL SELECT j FROM tri UNION ALL SELECT k FROM tri) GROUP BY 1),
    l AS (SELECT d, coalesce(t, 0) AS t FROM dg LEFT JOIN tc USING (id))
    SELECT count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges, round(sum(d) / (count(*) * (count(*) - 1)), 9) AS density,
           round(avg(CASE WHEN d > 1 THEN 2 * t / (d * (d - 1)) ELSE 0 END), 9) AS average_clustering,
           round(sum(t) / sum(d * (d - 1) / 2), 9) AS transitivity FROM l"""
)
def largest_component_structure(c: Catalog) -> DataFrame:
    pairs = cut(G.undirected(G.person_edges(c.appearance)))
    members = G.largest_component(G.components(G.both_ways(pairs), nodes(c)))
    out = G.structure(pairs, members)
    return out.select("nodes", "edges", *(F.round(x, 9).alias(x) for x in ("density", "average_clustering", "transitivity")))


def _events(c: Catalog) -> DataFrame:
    """Appearances as path events; frequent guests count as hosts of their show in every row."""
    keys = ops.frequent_guests(c.appearance, c.episode).select("podcast_id", "person_id", F.lit(True).alias("_co"))
    role = F.when(F.col("_co"), "host").otherwise(F.col("role"))
    english = c.podcast.where(ops.text.is_english_name(F.col("name"))).select(F.col("id").alias("podcast_id"))
    joined = c.appearance.join(english, "podcast_id", "left_semi").join(keys, ["podcast_id", "person_id"], "left")
    return joined.select(
        F.concat(F.lit("person:"), "person_id").alias("person"),
        F.concat(F.lit("show:"), "podcast_id").alias("show"),
        role.alias("kind"),
        F.to_date("published_at").alias("date"),
    )


MERGED = f"""{APPEARANCES}, {COHOSTS},
    ev AS (SELECT 'person:' || app.person_id AS person, 'show:' || app.podcast_id AS "show",
        CASE WHEN co.person_id IS NOT NULL THEN 'host' ELSE role END AS kind, CAST(published_at AT TIME ZONE 'UTC' AS DATE) AS date
        FROM app LEFT JOIN co ON co.podcast_id = app.podcast_id AND co.person_id = app.person_id
        WHERE app.podcast_id IN (SELECT id FROM podcast WHERE NOT regexp_matches(name,
            '[\\x{{0600}}-\\x{{06ff}}\\x{{0750}}-\\x{{077f}}\\x{{08a0}}-\\x{{08ff}}\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]'))),
    me AS (SELECT person, "show", CASE WHEN bool_or(kind = 'host') THEN 'host' ELSE 'guest' END AS kind,
        CASE WHEN bool_or(kind = 'host') THEN [] ELSE list_sort(list_distinct(list(date) FILTER (WHERE date IS NOT NULL))) END AS dates,
        CASE WHEN bool_or(kind = 'host') THEN min(date) END AS active_start,
        CASE WHEN bool_or(kind = 'host') THEN max(date) END AS active_end FROM ev GROUP BY 1, 2)"""
IN_WINDOW = f"""(CASE WHEN kind = 'host' THEN coalesce(active_start <= DATE '{WINDOW[1]}' AND active_end >= DATE '{WINDOW[0]}', false)
    ELSE len([d for d in coalesce(dates, []) if d BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}']) > 0 END)"""


@query(
    f"""WITH {MERGED} SELECT person, "show", kind, coalesce(len(dates), 0) AS dates, active_start, active_end, {IN_WINDOW} AS in_window FROM me"""
)
def edge_merge_windows(c: Catalog) -> DataFrame:
    merged = P.merge_edges(_events(c))
    return merged.select(
        "person", "show", "kind", F.size("dates").cast("long").alias("dates"), "active_start", "active_end",
        P.in_window(*WINDOW).alias("in_window"),
    )


def _path_sql(where: str) -> str:
    steps = [
        f"""ed AS (SELECT person AS node, "show" AS next, kind <> 'host' AS late FROM me WHERE {where}
            UNION ALL SELECT "show", person, kind <> 'host' FROM me WHERE {where})""",
        f"p0 AS (SELECT 'person:{SOURCE}' AS node, false AS late, ['person:{SOURCE}'] AS path)",
        "s0 AS (SELECT node FROM p0)",
    ]
    for i in range(6):
        late = "ed.late" if i == 0 else "p.late"
        steps += [
            f"""p{i + 1} AS (SELECT node, b.late AS late, b.path AS path FROM (SELECT ed.next AS node,
                min(struct_pack(late := {late}, path := list_append(p.path, ed.next))) AS b FROM p{i} p JOIN ed ON ed.node = p.node
                WHERE ed.next NOT IN (SELECT node FROM s{i}) GROUP BY 1))""",
            f"s{i + 1} AS (SELECT node FROM s{i} UNION ALL SELECT node FROM p{i + 1})",
        ]
    union = " UNION ALL ".join(f"SELECT path FROM p{i} WHERE node = 'person:{TARGET}'" for i in range(7))
    return f"""WITH {MERGED}, {", ".join(steps)}, f AS ({union})
        SELECT CAST(generate_subscripts(path, 1) - 1 AS INTEGER) AS position, unnest(path) AS node FROM f"""


@query(_path_sql("true"))
def shortest_path(c: Catalog) -> DataFrame:
    return P.shortest_path(P.merge_edges(_events(c)), f"person:{SOURCE}", f"person:{TARGET}")


@query(_path_sql(IN_WINDOW))
def shortest_path_windowed(c: Catalog) -> DataFrame:
    edges = P.merge_edges(_events(c)).where(P.in_window(*WINDOW))
    return P.shortest_path(edges, f"person:{SOURCE}", f"person:{TARGET}")


@query()
def path_explain(c: Catalog) -> DataFrame:
    edges = P.merge_edges(_events(c))
    people = c.person.select(F.concat(F.lit("person:"), "id").alias("node"), "name")
    shows = c.podcast.select(F.concat(F.lit("show:"), "id").alias("node"), "name")
    path = P.shortest_path(edges, f"person:{SOURCE}", f"person:{TARGET}")
    return P.explain_path(path, edges, people.unionByName(shows))


@query()
def suggest_name(c: Catalog) -> DataFrame:
    asked = c.spark.createDataFrame([("Thadeus Kogrugelok",), ("Nadia Bukezorat",), ("Omar Rugronifall",)], "query string")
    return P.suggest_names(asked, c.person.select("name"))
