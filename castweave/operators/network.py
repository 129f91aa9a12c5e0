"""Metrics of a whole network in one table, and the network as it stood at the end of each week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castweave.operators import brandes as B
from castweave.operators import evolution as E
from castweave.operators import graph as G
from castweave.operators import links as L
from castweave.operators.relational import global_rank, people_stats
from castweave.runtime import cut, cut_bare

#: Up to so many nodes every one is a source of the average path; beyond, the first in string order are.
PATH_SAMPLE = 200
SCORES = ("pagerank", "hub", "authority", "closeness", "betweenness", "degree_centrality")


def sources(nodes: DataFrame, sample: int | None = G.SAMPLE) -> tuple[DataFrame, bool]:
    """(source nodes, whether they are a sample); with ``None`` every node is a source."""
    sampled = sample is not None and nodes.count() > sample
    return (G.first_by_text(nodes, sample) if sampled else nodes), sampled


def closeness(steps: DataFrame, nodes: DataFrame, sample: int = G.SAMPLE) -> DataFrame:
    """Exact closeness up to ``sample`` nodes, beyond from a sample of sources."""
    first, sampled = sources(nodes, sample)
    return G.closeness(G.source_sums(steps, nodes, first), nodes, sampled)


def betweenness(steps: DataFrame, nodes: DataFrame, sample: int = G.SAMPLE) -> DataFrame:
    """Exact betweenness up to ``sample`` nodes, beyond from a sample of sources."""
    first, sampled = sources(nodes, sample)
    k = sample if sampled else None
    steps = cut(steps)
    if steps.count() > B.MOST_STEPS:  # too large for one task: a row per source and node
        return G.betweenness(steps, nodes, G.distances(steps, first), k)
    return G.scaled(B.dependencies(steps, first), nodes, k)


def path_scores(steps: DataFrame, nodes: DataFrame, numbers: tuple[DataFrame, int], sample: int | None = None) -> DataFrame:
    """``id, closeness, betweenness``, both from the same searches, by default from every node whatever the size of the graph.

    ``numbers`` are the nodes as :func:`brandes.numbered` gives them. With ``sample`` as the functions above have it.
    """
    first, sampled = sources(nodes, sample)
    many = steps.count() > B.MOST_STEPS  # too large for one task: frames, with the same values
    found = _searched_as_frames(steps, nodes, first, numbers) if many else cut(B.searched(steps, first, *numbers))
    counts = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("reached", "total"))
    near = G.closeness(nodes.join(found, "id", "left").select("id", *counts), nodes, sampled)
    return near.join(G.scaled(found.select("id", "d"), nodes, sample if sampled else None), "id")


def _searched_as_frames(steps: DataFrame, nodes: DataFrame, first: DataFrame, numbers: tuple[DataFrame, int]) -> DataFrame:
    """As :func:`brandes.searched`, from at most ``G.SAMPLE`` sources at once, as their number has no bound."""
    ids, n = numbers
    steps, first = cut(steps), cut(ids.join(first, "id", "left_semi"))
    found = nodes.select("id", F.lit(0.0).alias("d"), *(F.lit(0).cast("long").alias(c) for c in ("reached", "total")))
    for i in range(0, n, G.SAMPLE):
        block = first.where(F.col("node").between(i, i + G.SAMPLE - 1)).select("id")
        part = G.source_sums(steps, nodes, block).join(G.dependencies(steps, G.distances(steps, block)), "id", "left")
        both = found.unionByName(part.select("id", F.coalesce("d", F.lit(0.0)).alias("d"), "reached", "total"))
        found = cut_bare(both.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("d", "reached", "total"))))
    return found


def link_scores(edges: DataFrame, nodes: DataFrame, numbers: tuple[DataFrame, int]) -> DataFrame:
    """``id, pagerank, hub, authority`` of every node; ``numbers`` as in :func:`path_scores`."""
    many = edges.count()
    if many > L.MOST_EDGES:  # too large for one task: jobs for every round
        return G.pagerank(edges, nodes).withColumnRenamed("rank", "pagerank").join(G.hits(edges, nodes), "id")
    return cut(L.scores(edges, *numbers, many))


def _ranked(scores: DataFrame, names: tuple[str, ...]) -> DataFrame:
    for name in names:
        scores = global_rank(scores, name, "id", f"{name.removesuffix('_centrality')}_rank")
    return scores


def score_people(appearance: DataFrame, sample: int | None = None) -> DataFrame:
    """``id`` and the six scores of every person of ``appearance``, from all of them as sources unless ``sample`` is given."""
    edges, nodes = cut(G.person_edges(appearance)), cut(appearance.select(F.col("person_id").alias("id")).distinct())
    pairs = cut(G.undirected(edges))
    steps = cut(G.both_ways(pairs))
    numbers = B.numbered(nodes)
    scores = link_scores(edges, nodes, numbers).join(path_scores(steps, nodes, numbers, sample), "id")
    return cut(scores.join(G.degree(pairs, nodes).select("id", "degree_centrality"), "id"))


def person_metrics(appearance: DataFrame, sample: int | None = None) -> DataFrame:
    """One row per person: six scores, their ranks, appearances, shows and the latest date.

    Closeness and betweenness are exact whatever the number of people, unless ``sample`` is given.

    Ranks go by score, then by id as text. Scores of people without an edge are those of an isolated node.
    """
    stats = people_stats(appearance).drop("first_ms").withColumnRenamed("person_id", "id")
    return _ranked(score_people(appearance, sample), SCORES).join(stats, "id")


def podcast_metrics(appearance: DataFrame, sample: int = G.SAMPLE) -> DataFrame:
    """One row per show on the graph of shared guests: closeness, betweenness, degree, ranks and number of neighbours.

    Shows are those of any guest or host; a show that shares no guest has zeros.
    """
    nodes = cut(appearance.select(F.col("podcast_id").alias("id")).distinct())
    pairs = cut(G.shared_guest_pairs(appearance).select("a", "b"))
    steps = cut(G.both_ways(pairs))
    scores = G.degree(pairs, nodes).withColumnRenamed("degree", "shared_guest_edges")
    scores = scores.join(closeness(steps, nodes, sample), "id").join(betweenness(steps, nodes, sample), "id")
    return _ranked(cut(scores), ("closeness", "betweenness", "degree_centrality"))


def at_cutoff(appearance: DataFrame, week: str, tz: str = "UTC") -> DataFrame:
    """Appearances on episodes published before the end of the Monday-based ``week``; undated ones never."""
    return appearance.where(F.col("published_at").cast("timestamp") < E.week_cutoff(F.to_date(F.lit(week)), tz))


def week_snapshot(appearance: DataFrame, week: str, tz: str = "UTC", sample: int = PATH_SAMPLE) -> DataFrame:
    """One row: sizes of the network at the end of a week, what the week added, structure of its largest component."""
    now = cut(at_cutoff(appearance, week, tz))
    pairs = cut(G.undirected(G.person_edges(now)))
    people = cut(now.select(F.col("person_id").alias("id")).distinct())
    members = cut(G.largest_component(G.components(G.both_ways(pairs), people)))
    inside = pairs.join(members.withColumnRenamed("id", "a"), "a", "left_semi")
    first, _ = sources(members, sample)
    path = G.average_path(G.source_sums(G.both_ways(inside), members, first))
    monday = F.to_date(F.lit(week))
    seen = E.first_seen(now, tz)
    new = {k: df.where(F.col("week") == monday).agg(F.count(F.lit(1)).alias(f"new_{k}")) for k, df in seen.items()}
    sizes = now.agg(
        F.countDistinct("person_id").alias("people"), F.countDistinct("podcast_id").alias("podcasts"),
        F.countDistinct("episode_id").alias("episodes"), F.count(F.when(F.col("role") == "guest", 1)).alias("guest_appearances"),
    )
    shape = G.structure(pairs, members).withColumnsRenamed({"nodes": "component_people", "edges": "component_edges"})
    row = sizes.join(pairs.agg(F.count(F.lit(1)).alias("edges")))  # joins of single rows
    for part in (*new.values(), shape, path):
        row = row.join(part)
    return row.withColumn("week", monday)


def tracked(scores: DataFrame, metric: DataFrame | None, limit: int) -> DataFrame:
    """``id`` of the people to keep: the ``limit`` best of any stored rank and a quarter (at least 10) of any present one.

    Without stored ranks (``metric`` with ``id`` and rank columns) the ``limit`` best of any present one.
    """
    names = [f"{s.removesuffix('_centrality')}_rank" for s in SCORES]
    if metric is None or metric.isEmpty():
        return E.tracked_ids(scores, "id", names, limit)
    stored = E.tracked_ids(metric, "id", [n for n in names if n in metric.columns], limit)
    return stored.unionByName(E.tracked_ids(scores, "id", names, max(10, limit // 4))).distinct()


def week_people(appearance: DataFrame, week: str, metric: DataFrame | None, limit: int, tz: str = "UTC", sample: int | None = None) -> DataFrame:
    """Metrics of the tracked people at the end of a week, from all people of that time unless ``sample`` is given."""
    rows = cut(person_metrics(at_cutoff(appearance, week, tz), sample))
    return rows.join(tracked(rows, metric, limit), "id", "left_semi").withColumn("week", F.to_date(F.lit(week)))


def store_weeks(spark: SparkSession, appearance: DataFrame, weeks: list[str], path: str, recompute: bool = False, tz: str = "UTC") -> list[str]:
    """Write the snapshots of ``weeks`` below ``path``, one folder each; stored weeks are left unless ``recompute``.

    Returns the weeks written. A week is written whole or not at all, so a broken run goes on where it stopped.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    for week in weeks:
        target = f"{path}/week={week}"
        if not recompute and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")):
            continue
        week_snapshot(appearance, week, tz).drop("week").write.mode("overwrite").parquet(target)
        done.append(week)
    return done
