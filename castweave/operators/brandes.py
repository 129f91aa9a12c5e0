"""Betweenness and distances by a search from each source, in tasks that hold the graph as arrays.

A row for every source, node and edge is a thousand times the graph; the graph itself is small beside that. So the
sources are dealt out to tasks, and each task gets the edges as 32-bit numbers and searches from one source after another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castweave.runtime import cut, ship

#: Directed edges that a task may hold (4 bytes each); larger graphs are searched as frames, see ``network.betweenness``.
MOST_STEPS = 50_000_000
#: Copies of the graph that are sent out at most, and edges looked at in one step of a search.
COPIES, CHUNK = 64, 1 << 20


class Search:
    """Searches over ``near[start[v] : start[v] + size[v]]``, the neighbours of ``v``; every edge stands with both ends.

    A level is found from the nodes of the last one or from the nodes not met yet, whichever have fewer edges.
    ``total`` sums the dependencies; ``reached`` counts the other sources that reach a node, ``far`` sums their distances.
    """

    def __init__(self, start: np.ndarray, size: np.ndarray, near: np.ndarray):
        self.start, self.size, self.near = start, size, near
        n = len(start)
        self.dist, self.paths, self.total = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
        self.reached, self.far = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.ends, self.linked, self.fresh = int(size.sum()), size > 0, np.empty(n, bool)
        self.count = np.arange(min(CHUNK, self.ends))

    def edges(self, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(part of ``rows``, its sizes, where each one's edges begin, neighbours), at most ``CHUNK`` edges at once but for a single node's."""
        ends = np.cumsum(self.size[rows])
        first = 0
        while first < len(rows):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
            part = slice(first, last)
            lengths = self.size[rows[part]]
            begin = ends[part] - lengths - done
            at = np.repeat(self.start[rows[part]] - begin, lengths)
            at += self.count[: len(at)] if len(at) <= len(self.count) else np.arange(len(at))
            yield part, lengths, begin, self.near.take(at)
            first = last

    def gather(self, rows: np.ndarray, edges: Iterable, value: np.ndarray) -> np.ndarray:
        """Sum of the neighbours' ``value`` for each of ``rows``, which all have neighbours."""
        out = np.empty(len(rows))
        for part, _, begin, other in edges:
            out[part] = np.add.reduceat(value.take(other), begin)
        return out

    def spread(self, edges: Iterable, value: np.ndarray) -> np.ndarray:
        """Sum of ``value`` over the rows that each node is a neighbour of."""
        out = None
        for part, lengths, _, other in edges:
            sums = np.bincount(other, np.repeat(value[part], lengths), len(self.dist))
            out = sums if out is None else out + sums
        return out

    def run(self, source: int) -> None:
        dist, paths, fresh = self.dist, self.paths, self.fresh
        np.copyto(fresh, self.linked)
        dist[source], paths[source], fresh[source] = 0, 1.0, False
        front, ahead = np.array([source]), int(self.size[source])
        rest = self.ends - ahead  # edges of the nodes not met yet
        levels, left = [], None
        while ahead and rest:
            pull = rest < ahead
            if pull:
                left = np.flatnonzero(fresh) if left is None else left
            rows = left if pull else front
            edges = self.edges(rows)
            if min(ahead, rest) <= CHUNK:
                edges = list(edges)
            if pull:
                sums = self.gather(rows, edges, paths * (dist == len(levels)))
                paths[rows] = sums
                hit = sums > 0
                found, left = (rows, rows[:0]) if hit.all() else (rows[hit], rows[~hit])
            else:
                sums = self.spread(edges, paths.take(front)) * fresh
                paths += sums
                found, left = np.flatnonzero(sums > 0), None
            if not len(found):
                break
            levels.append((front, rows, edges if isinstance(edges, list) else None, found))
            dist[found], fresh[found] = len(levels), False
            front, ahead = found, int(self.size[found].sum())
            rest -= ahead
        delta = np.zeros(len(front))
        for level in range(len(levels), 0, -1):
            front, rows, edges, found = levels.pop()
            self.total[found] += delta
            if level == 1:
                break
            edges = self.edges(rows) if edges is None else edges
            gain = (1 + delta) / paths.take(found)
            if rows is found:
                sums = self.spread(edges, gain).take(front)
            else:
                value = np.zeros(len(dist))
                value[found] = gain
                sums = self.gather(rows, edges, value) if rows is front else self.spread(edges, value.take(rows)).take(front)
            delta = paths.take(front) * sums
        np.maximum(dist, 0, out=dist)
        self.far += dist
        self.reached += dist > 0
        dist.fill(-1)
        paths.fill(0.0)


def _parts(start: np.ndarray, size: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The smallest node of every node's connected component."""
    graph = Search(start, size, near)
    label, rows = np.arange(len(start)), np.flatnonzero(size)
    while True:
        low = label.copy()
        for part, lengths, _, other in graph.edges(rows):
            np.minimum.at(low, np.repeat(rows[part], lengths), label[other])
        np.minimum.at(low, label, low.copy())
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _search_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one copy: ``task, tasks, node, is_source, near``; gives ``node, delta, reached, far`` over the task's share of sources."""
    nodes, sources, sizes, near, task, tasks = [], [], [], [], 0, 1
    for batch in batches:
        if not batch.num_rows:
            continue
        task, tasks = batch.column("task")[0].as_py(), batch.column("tasks")[0].as_py()
        nodes.append(batch.column("node").to_numpy())
        sources.append(batch.column("is_source").to_numpy(zero_copy_only=False))
        lists = batch.column("near")
        sizes.append(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        near.append(lists.flatten().to_numpy())
    if not nodes:
        return
    node, size = np.concatenate(nodes), np.concatenate(sizes)
    n = int(node.max()) + 1
    start_of, size_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    start_of[node], size_of[node] = np.cumsum(size) - size, size
    chosen = np.zeros(n, bool)
    chosen[node[np.concatenate(sources)]] = True
    every = np.concatenate(near)
    near.clear()
    # A search stays in its component, so each component is numbered for itself; by degree, as the nodes met last have few.
    label = _parts(start_of, size_of, every)
    order = np.lexsort((size_of, label))
    order = order[size_of[order] > 0]
    edge = np.flatnonzero(np.diff(label[order], prepend=-1, append=n))
    place = np.zeros(n, np.int32)
    place[order] = np.arange(len(order)) - np.repeat(edge[:-1], np.diff(edge))
    mine = np.zeros(len(order), bool)
    mine[np.flatnonzero(chosen[order])[task::tasks]] = True
    total, reached, far = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    graph = Search(start_of, size_of, every)
    for first, last in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if not mine[first:last].any():
            continue
        inside = order[first:last]
        size = size_of[inside]
        search = Search(np.cumsum(size) - size, size, np.concatenate([place[other] for *_, other in graph.edges(inside)]))
        for source in np.flatnonzero(mine[first:last]):
            search.run(source)
        total[inside], reached[inside], far[inside] = search.total, search.reached, search.far
    hit = np.flatnonzero(reached)
    values = (hit.astype(np.int32), total[hit], reached[hit], far[hit])
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["node", "delta", "reached", "far"])


def numbered(ids: DataFrame) -> tuple[DataFrame, int]:
    """``id, node``: the distinct ``ids(id)`` with numbers from 0 without gaps; and how many they are."""
    ends = cut(ids.distinct().withColumn("at", F.monotonically_increasing_id()))
    # Numbers without gaps: the partition's offset and the place in the partition.
    counts = ends.groupBy(F.shiftright("at", 33).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per partition
    if not counts:
        return ends.select("id", F.lit(0).alias("node")), 0
    offsets, n = [0] * (max(r["p"] for r in counts) + 1), 0
    for r in sorted(counts):
        offsets[r["p"]], n = n, n + r["n"]
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.element_at(F.array(*map(F.lit, offsets)), F.shiftright("at", 33).cast("int") + 1)
    return cut(ends.select("id", place.cast("int").alias("node"))), n


def dependencies(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, d``: summed dependencies of the ``sources(id)`` on every node that they reach.

    ``steps(src, dst)`` holds every edge in both directions, at most :data:`MOST_STEPS` of them.
    """
    return searched(steps, sources, *numbered(steps.select(F.col("src").alias("id")))).select("id", "d")


def searched(steps: DataFrame, sources: DataFrame, numbers: DataFrame, n: int) -> DataFrame:
    """``id, d, reached, total`` of every node that one of the other ``sources(id)`` reaches, by one search from each.

    The summed dependencies ``d`` as in :func:`dependencies`, ``reached`` and ``total`` as in ``graph.source_sums``.
    ``numbers`` and ``n`` are :func:`numbered` ends of the ``steps``; more nodes do no harm.
    """
    near = (
        steps.join(numbers.withColumnRenamed("id", "src"), "src")
        .join(numbers.select(F.col("id").alias("dst"), F.col("node").alias("other")), "dst")
        .groupBy("node").agg(F.array_sort(F.collect_list("other")).alias("near"))
    )
    chosen = numbers.join(sources.select("id"), "id").select("node", F.lit(True).alias("is_source"))
    rows = near.join(chosen, "node", "left").select("node", F.coalesce("is_source", F.lit(False)).alias("is_source"), "near")
    tasks = max(1, min(n, COPIES, steps.sparkSession.sparkContext.defaultParallelism))
    copies = rows.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(tasks).alias("tasks"), "node", "is_source", "near")
    found = copies.repartitionById(tasks, "task").mapInArrow(_search_task, "node int, delta double, reached long, far long")
    sums = found.groupBy("node").agg(F.sum("delta").alias("d"), F.sum("reached").alias("reached"), F.sum("far").alias("total"))
    return sums.join(numbers, "node").select("id", "d", "reached", "total")


ship(__name__)
