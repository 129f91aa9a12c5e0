"""Graphs of who appears with whom: edges, centralities and structure, as iterated frames.

Every iteration is a join and an aggregation with map-side combination; lineage is cut into the
shared checkpoint folder, and only counts or single numbers reach the driver. Breadth-first
searches run from all sources in one frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castweave.runtime import cut

SAMPLE = 1000


def person_edges(appearance: DataFrame) -> DataFrame:
    """Guest to host of the same episode: ``src, dst, weight`` (episodes together)."""
    guests = appearance.where("role = 'guest'").select("episode_id", F.col("person_id").alias("src"))
    hosts = appearance.where("role = 'host'").select("episode_id", F.col("person_id").alias("dst"))
    met = guests.join(hosts, "episode_id").where("src <> dst")
    return met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """``a < b`` once per pair, weights of both directions added."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum("weight").alias("weight")
    )


def both_ways(pairs: DataFrame) -> DataFrame:
    """Undirected pairs as ``src, dst`` in both directions."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )


def shared_guest_pairs(appearance: DataFrame) -> DataFrame:
    """Shows ``a < b`` with the number of guests they share.

    Guests are first grouped by the set of shows they were on, so that the pairs of a set are
    counted once with a weight and not once per guest.
    """
    on = appearance.where("role = 'guest'").groupBy("person_id").agg(F.array_sort(F.collect_set("podcast_id")).alias("shows"))
    sets = on.where(F.size("shows") > 1).groupBy("shows").agg(F.count(F.lit(1)).alias("n"))
    first = sets.select("n", "shows", F.posexplode("shows").alias("i", "a"))
    pairs = first.select("n", "a", F.explode(F.slice("shows", F.col("i") + 2, F.size("shows"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("shared_guests"))


def degree(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, degree, degree_centrality`` of every node of ``nodes(id)``; 0 for isolated ones."""
    n = nodes.agg(F.count(F.lit(1))).scalar()
    counted = both_ways(pairs).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    joined = nodes.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return joined.withColumn("degree_centrality", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(F.lit(0.0)))


def pagerank(
    edges: DataFrame, nodes: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6
) -> DataFrame:
    """Weighted PageRank ``id, rank``; dangling mass is spread evenly.

    Stops when the summed change falls below ``nodes * tolerance`` (never with ``None``) or after
    ``iterations``. An empty node table gives no rows.
    """
    edges, nodes = cut(edges), cut(nodes.select("id"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    state = cut(nodes.join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").select(
        "id", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / n).alias("rank")
    ))
    # One action a round: the change of this one and the dangling mass for the next.
    sums = (F.sum("change"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)))
    loose = state.agg(sums[1]).scalar() if iterations else 0.0
    for _ in range(iterations):
        inflow = share.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("rank") * F.col("share")).alias("inflow")
        )
        new = F.lit(damping) * (F.coalesce("inflow", F.lit(0.0)) + loose / n) + (1 - damping) / n
        state = state.join(inflow, "id", "left").select("id", "dangling", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
        state = cut(state)
        change, loose = state.agg(*sums).first()
        if tolerance is not None and change < n * tolerance:
            break
        loose = F.lit(loose)
        state = state.drop("change")
    return state.select("id", "rank")


def hits(edges: DataFrame, nodes: DataFrame, iterations: int = 500, tolerance: float | None = 1e-8) -> DataFrame:
    """``id, hub, authority`` on the weighted graph, each normalised to sum 1.

    Stops when the hubs' summed change falls below ``tolerance`` (never with ``None``) or after ``iterations``.
    """
    edges = cut(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    weigh = lambda hub: edges.join(hub.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(
        F.sum(F.col("hub") * F.col("weight")).alias("authority")
    )
    hub = edges.select(F.col("src").alias("id"), F.lit(1.0).alias("hub")).distinct()
    for _ in range(iterations):
        raw = edges.join(weigh(hub).select(F.col("id").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("id")).agg(
            F.sum(F.col("authority") * F.col("weight")).alias("raw")
        )
        both = cut(raw.join(hub, "id"))
        total = both.agg(F.sum("raw")).first()[0]
        if not total:
            break
        hub = both.select("id", (F.col("raw") / total).alias("hub"))
        if tolerance is not None and both.agg(F.sum(F.abs(F.col("raw") / total - F.col("hub")))).first()[0] < tolerance:
            break
    authority = cut(weigh(hub))
    total = authority.agg(F.sum("authority")).first()[0] or 1.0
    authority = authority.withColumn("authority", F.col("authority") / total)
    return nodes.join(hub, "id", "left").join(authority, "id", "left").select(
        "id", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("authority", F.lit(0.0)).alias("authority")
    )


def first_by_text(nodes: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest ids in string order: the documented sample of sources."""
    return nodes.orderBy(F.col("id").cast("string")).limit(k)


def distances(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """``src, node, dist, paths`` of all reachable nodes (the source at 0), with the number of shortest paths.

    ``steps(src, dst)`` holds every edge in both directions.
    """
    steps = cut(steps.select(F.col("src").alias("node"), F.col("dst").alias("next")))  # read at every level
    front = cut(sources.select(F.col("id").alias("src"), F.col("id").alias("node"), F.lit(0).alias("dist"), F.lit(1.0).alias("paths")))
    seen, level = front, 0
    while not front.isEmpty():
        level += 1
        reached = (
            front.join(steps, "node")
            .groupBy("src", F.col("next").alias("node"))
            .agg(F.sum("paths").alias("paths"))
            .join(seen.select("src", "node"), ["src", "node"], "left_anti")
            .select("src", "node", F.lit(level).alias("dist"), "paths")
        )
        front = cut(reached)
        seen = seen.unionByName(front)
    return seen


def source_sums(steps: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, reached, total`` of every node: how many other ``sources`` reach it, and the sum of their distances.

    The searches of all sources run at once: a node carries one bit per source, 64 to a number, so a level costs one
    row per edge of the frontier whatever the number of sources. That number has a bound (:data:`SAMPLE`).
    """
    numbered = sources.select("id", (F.row_number().over(Window.orderBy(F.col("id").cast("string"))) - 1).alias("_k"))
    many = sources.count()
    steps = cut(steps.select(F.col("src").alias("id"), F.col("dst").alias("next")))
    places = range(-(-many // 64))
    bit = lambda i: F.when(F.floor(F.col("_k") / 64) == i, F.expr("shiftleft(1L, cast(_k % 64 as int))"))
    state = cut(
        nodes.select("id").join(numbered, "id", "left").select(
            "id", *(F.coalesce(bit(i), F.lit(0).cast("long")).alias(f"s{i}") for i in places),
            *(F.coalesce(bit(i), F.lit(0).cast("long")).alias(f"n{i}") for i in places),
            F.lit(0).cast("long").alias("reached"), F.lit(0).cast("long").alias("total"),
        )
    )
    level = 0
    fresh = F.lit(False)
    for i in places:
        fresh = fresh | (F.col(f"n{i}") != 0)
    while many:
        level += 1
        front = state.where(fresh).select("id", *(f"n{i}" for i in places))
        came = front.join(steps, "id").groupBy(F.col("next").alias("id")).agg(*(F.bit_or(f"n{i}").alias(f"c{i}") for i in places))
        first = {f"n{i}": F.coalesce(F.col(f"c{i}").bitwiseAND(F.bitwise_not(F.col(f"s{i}"))), F.lit(0).cast("long")) for i in places}
        state = state.drop(*(f"n{i}" for i in places)).join(came, "id", "left").withColumns(first)
        bits = sum((F.bit_count(f"n{i}") for i in places), F.lit(0))
        state = cut(
            state.select(
                "id", *(F.col(f"s{i}").bitwiseOR(F.col(f"n{i}")).alias(f"s{i}") for i in places), *(f"n{i}" for i in places),
                (F.col("reached") + bits).alias("reached"), (F.col("total") + bits * level).alias("total"),
            )
        )
        if not state.agg(F.bool_or(fresh)).first()[0]:
            break
    return state.select("id", "reached", "total")


def closeness(sums: DataFrame, nodes: DataFrame, sampled: bool) -> DataFrame:
    """``id, closeness`` of every node from :func:`source_sums`.

    Exact: reached/sum times reached/(n-1). Sampled: reached/sum over the sample, without factor.
    """
    n = nodes.agg(F.count(F.lit(1))).scalar()
    value = F.when(F.col("total") > 0, F.col("reached") / F.col("total"))
    if not sampled:
        value = value * F.col("reached") / (n - 1)
    return sums.select("id", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def average_path(sums: DataFrame) -> DataFrame:
    """One row: mean distance of the pairs of a source and another node it reaches; 0 without pairs."""
    mean = F.try_divide(F.sum("total"), F.sum("reached"))
    return sums.agg(F.coalesce(mean, F.lit(0.0)).alias("average_path"))


def betweenness(steps: DataFrame, nodes: DataFrame, dist: DataFrame, k: int | None = None) -> DataFrame:
    """``id, betweenness`` by Brandes' accumulation over the sources of ``dist``, normalised.

    ``k`` is the number of sampled sources; ``None`` where all nodes are sources.
    """
    return scaled(dependencies(steps, dist), nodes, k)


def dependencies(steps: DataFrame, dist: DataFrame) -> DataFrame:
    """``id, d``: summed dependencies of the sources of ``dist`` on every node that has any."""
    steps, deepest = cut(steps), dist.agg(F.max("dist")).first()[0] or 0
    delta = None
    found = []
    for level in range(deepest, 0, -1):
        below = dist.where(F.col("dist") == level).select("src", F.col("node").alias("w"), F.col("paths").alias("pw"))
        if delta is not None:
            below = below.join(delta.select("src", F.col("node").alias("w"), "delta"), ["src", "w"], "left")
        else:
            below = below.withColumn("delta", F.lit(None).cast("double"))
        above = dist.where(F.col("dist") == level - 1).select("src", "node", "paths")
        pairs = below.join(steps.select(F.col("src").alias("w"), F.col("dst").alias("node")), "w").join(above, ["src", "node"])
        gain = F.sum(F.col("paths") / F.col("pw") * (1 + F.coalesce("delta", F.lit(0.0))))
        delta = cut(pairs.groupBy("src", "node").agg(gain.alias("delta")))
        if level > 1:
            found.append(delta)
    if not found:
        return dist.select(F.col("node").alias("id"), F.lit(0.0).alias("d")).limit(0)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.where("src <> node").groupBy(F.col("node").alias("id")).agg(F.sum("delta").alias("d"))


def scaled(sums: DataFrame, nodes: DataFrame, k: int | None) -> DataFrame:
    """``id, betweenness`` of every node from summed dependencies ``id, d`` of all nodes or of ``k`` sampled ones."""
    n = nodes.count()
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / k if k else 1.0)
    return nodes.join(sums, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * scale).alias("betweenness"))


def components(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, component`` (smallest id of the component) by label spreading with pointer jumping."""
    steps = cut(steps)  # read in every round
    label = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = steps.join(label.select(F.col("id").alias("src"), "component"), "src").groupBy(F.col("dst").alias("id")).agg(
            F.min("component").alias("near")
        )
        lower = label.join(near, "id", "left").select(
            "id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old")
        )
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = cut(lower.join(jump, "component", "left").select("id", F.least("component", "up").alias("component"), "old"))
        label = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return label


def largest_component(component: DataFrame) -> DataFrame:
    """``id`` of the members of the largest component; ties go to the smallest label."""
    sizes = component.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    best = sizes.agg(F.max_by("component", F.struct("size", -F.col("component")))).scalar()
    return component.where(F.col("component") == best).select("id")


def structure(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average clustering and transitivity of the graph on ``nodes``.

    Triangles are found from the end with fewer neighbours, so a hub opens few wedges.
    """
    inside = cut(
        pairs.select("a", "b")
        .join(nodes.withColumnRenamed("id", "a"), "a", "left_semi")
        .join(nodes.withColumnRenamed("id", "b"), "b", "left_semi")
    )
    steps = both_ways(inside)
    deg = steps.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    rank = lambda c: deg.select(F.col("id").alias(c), F.struct("degree", "id").alias(f"r{c}"))
    ordered = inside.join(rank("a"), "a").join(rank("b"), "b")
    up = ordered.select(
        F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("lo"),
        F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("hi"),
    )
    wedge = up.select("lo", F.col("hi").alias("x")).join(up.select("lo", F.col("hi").alias("y")), "lo").where("x < y")
    closing = up.select(F.least("lo", "hi").alias("x"), F.greatest("lo", "hi").alias("y"))
    triangles = wedge.join(closing, ["x", "y"], "left_semi")
    corners = triangles.select(F.explode(F.array("lo", "x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    local = nodes.join(deg, "id", "left").join(corners, "id", "left").select(
        F.coalesce("degree", F.lit(0)).alias("d"), F.coalesce("t", F.lit(0)).alias("t")
    )
    d, t = F.col("d"), F.col("t")
    wedges = F.sum(d * (d - 1) / 2)
    return local.agg(
        F.count(F.lit(1)).alias("nodes"),
        (F.sum("d") / 2).cast("long").alias("edges"),
        F.coalesce(F.when(F.count(F.lit(1)) > 1, F.sum("d") / (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1))), F.lit(0.0)).alias("density"),
        F.coalesce(F.avg(F.when(d > 1, 2 * t / (d * (d - 1))).otherwise(F.lit(0.0))), F.lit(0.0)).alias("average_clustering"),
        F.coalesce(F.when(wedges > 0, F.sum("t") / wedges), F.lit(0.0)).alias("transitivity"),
    )
