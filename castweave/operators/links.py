"""PageRank and HITS in a task that holds the edges as arrays.

Both take up to hundreds of rounds, and as frames every round is several jobs, whatever the size of the graph. The
edges of a graph are few numbers, so one task takes them sorted and does all rounds; the rounds and where they stop are
those of ``graph.pagerank`` and ``graph.hits``, which remain for larger graphs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castweave.runtime import ship

#: Edges that the task may hold (16 bytes each); larger graphs go as frames, see ``network.link_scores``.
MOST_EDGES = 25_000_000
#: Edges looked at in one step, and rows given back at once.
CHUNK, ROWS = 1 << 20, 1 << 16


def _flow(start: np.ndarray, end: np.ndarray, weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sum of ``value * weight`` over the edges that end in each node, added in the order of the edges."""
    out = np.zeros(len(value))
    for i in range(0, len(start), CHUNK):
        part = slice(i, i + CHUNK)
        np.add.at(out, end[part], value[start[part]] * weight[part])
    return out


def pagerank(
    src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, iterations: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6
) -> np.ndarray:
    """As ``graph.pagerank`` for nodes ``0 .. n - 1``."""
    out = _flow(dst, src, weight, np.ones(n))
    dangling = np.ones(n, bool)
    dangling[src] = False
    rank = np.full(n, 1 / n)
    for _ in range(iterations):
        inflow = _flow(src, dst, weight, np.divide(rank, out, out=np.zeros(n), where=~dangling))
        new = damping * (inflow + rank[dangling].sum() / n) + (1 - damping) / n
        change, rank = np.abs(new - rank).sum(), new
        if tolerance is not None and change < n * tolerance:
            break
    return rank


def hits(
    src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, iterations: int = 500, tolerance: float | None = 1e-8
) -> tuple[np.ndarray, np.ndarray]:
    """Hubs and authorities as ``graph.hits`` has them, for nodes ``0 .. n - 1``."""
    hub = np.zeros(n)
    hub[src] = 1.0
    for _ in range(iterations):
        raw = _flow(dst, src, weight, _flow(src, dst, weight, hub))
        total = raw.sum()
        if not total:
            break
        raw /= total
        change, hub = np.abs(raw - hub).sum(), raw
        if tolerance is not None and change < tolerance:
            break
    authority = _flow(src, dst, weight, hub)
    return hub, authority / (authority.sum() or 1.0)


def scores(edges: DataFrame, numbers: DataFrame, n: int, many: int) -> DataFrame:
    """``id, pagerank, hub, authority`` of every id of ``numbers(id, node)``, ``node`` from 0 to ``n - 1``.

    ``edges(src, dst, weight)`` are ``many``, at most :data:`MOST_EDGES`; their ends are among the ids.
    """
    if not n:
        return numbers.select("id", *(F.lit(0.0).alias(c) for c in ("pagerank", "hub", "authority")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, weight, at = np.empty(many, np.int32), np.empty(many, np.int32), np.empty(many), 0
        for batch in batches:
            part = slice(at, at := at + batch.num_rows)
            for array, name in ((src, "s"), (dst, "d"), (weight, "weight")):
                array[part] = batch.column(name).to_numpy()
        if at != many:
            raise ValueError(f"{at} edges came, {many} were counted")
        values = (np.arange(n, dtype=np.int32), pagerank(src, dst, weight, n), *hits(src, dst, weight, n))
        for i in range(0, n, ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(v[i : i + ROWS]) for v in values], names=["node", "pagerank", "hub", "authority"])

    pairs = edges.join(numbers.select(F.col("id").alias("src"), F.col("node").alias("s")), "src").join(
        numbers.select(F.col("id").alias("dst"), F.col("node").alias("d")), "dst"
    )
    rows = pairs.select("s", "d", F.col("weight").cast("double").alias("weight")).repartition(1).sortWithinPartitions("d", "s")
    found = rows.mapInArrow(task, "node int, pagerank double, hub double, authority double")
    return found.join(numbers, "node").select("id", "pagerank", "hub", "authority")


ship(__name__)
