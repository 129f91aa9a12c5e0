"""Consolidating pairwise matches into groups by random graph contraction.

Every round draws a fresh hash order of the vertices. Each vertex hooks to the first of itself
and its neighbours in that order; edges are relabelled to the hooks, loops dropped and repeats
removed. A constant share of the vertices disappears per round whatever the shape of the graph
(long chains and stars included), so rounds grow with the logarithm of the largest component.
The smallest member travels up with every vertex that others hook to; the per-round mappings
are then expanded backwards, each one smaller than the one before.

Nothing is ever collected: per round the driver sees one edge count. Hooking and deduplication
are aggregations with map-side combination, so a vertex with a third of all edges costs one row
per task; where such a vertex is a join key it is joined apart (``join_hot``). Each round is
written to the shared checkpoint folder and survives lost executors; estimated sizes are not carried
over rounds, where every join multiplies them (``cut_bare``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castweave.operators.skew import hot_values, join_hot
from castweave.runtime import cut_bare as cut


def connected_groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``member``, ``group_id`` for every vertex linked to another one; group_id is the smallest member.

    Null ends and self-pairs link nothing; order and repetition of pairs don't matter. Members of
    no real link don't appear. An empty input gives no rows. Works for any orderable id type.
    """
    a, b = F.col(left), F.col(right)
    edges = cut(
        pairs.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .distinct()
    )
    steps: list[DataFrame] = []
    least: DataFrame | None = None  # smallest member below each vertex of this round
    round_ = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.lit(round_), c).alias("h"), c.alias("id"))  # noqa: E731, B023
        hooks = both.groupBy(F.col("u").alias("vertex")).agg(F.min(order(F.col("v"))).alias("n"))
        hooks = hooks.select("vertex", F.least(F.col("n"), order(F.col("vertex")))["id"].alias("hook"))
        if least is None:
            hooks = hooks.withColumn("low", F.col("vertex"))
        else:
            hooks = hooks.join(least, "vertex", "left").withColumn("low", F.coalesce("low", "vertex"))
        hooks = cut(hooks)
        steps.append(hooks)
        # Vertices that are done keep their smallest member in the mapping they were hooked by.
        least = hooks.groupBy(F.col("hook").alias("vertex")).agg(F.min("low").alias("low"))
        start = join_hot(edges, hooks.select(F.col("vertex").alias("u"), F.col("hook").alias("hu")), "u")
        ends = join_hot(start, hooks.select(F.col("vertex").alias("v"), F.col("hook").alias("hv")), "v", hot=hot_values(edges, "v"))
        edges = cut(
            ends.where(F.col("hu") != F.col("hv"))
            .select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v"))
            .distinct()
        )
        round_ += 1
    if not steps:
        return edges.select(F.col("u").alias("member"), F.col("v").alias("group_id"))
    # A vertex nobody carries on is the end of its group: its smallest member is the group's name.
    label: DataFrame | None = None
    for hooks in reversed(steps):
        own = hooks.groupBy(F.col("hook")).agg(F.min("low").alias("low"))
        if label is not None:
            later = label.select(F.col("member").alias("hook"), "group_id")
            own = own.join(later, "hook", "left").select("hook", F.coalesce("group_id", "low").alias("group_id"))
        else:
            own = own.withColumnRenamed("low", "group_id")
        named = join_hot(hooks.select(F.col("vertex").alias("member"), "hook"), own, "hook")
        label = cut(named.select("member", "group_id"))
    return label


def found_groups(candidate_pair: DataFrame) -> DataFrame:
    """Entities linked by accepted pairs with the smallest id of their group."""
    accepted = candidate_pair.where(F.col("status") == "accepted").select("left_id", "right_id")
    return connected_groups(accepted, "left_id", "right_id").select(
        F.col("member").alias("am_entity_id"), "group_id"
    )
