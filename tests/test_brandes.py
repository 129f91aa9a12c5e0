"""Betweenness by searches over arrays: no row per source and node, the same values as the frames give."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graph import bfs, frames, make, neighbours

from castweave.operators import brandes as B
from castweave.operators import graph as G
from castweave.operators import network as N


@pytest.mark.parametrize("sample", [5, 1000])
def test_no_row_for_every_source_and_node(spark, monkeypatch, sample):
    n, pairs = make(7, 60, 90)
    nodes, undirected = frames(spark, n, pairs)
    steps = G.both_ways(undirected)
    first, sampled = N.sources(nodes, sample)
    want = {r.id: r.betweenness for r in G.betweenness(steps, nodes, G.distances(steps, first), sample if sampled else None).collect()}

    def refuse(*_):
        raise AssertionError("a row per source and node")

    with monkeypatch.context() as patched:
        patched.setattr(G, "distances", refuse)
        assert {r.id: r.betweenness for r in N.betweenness(steps, nodes, sample).collect()} == pytest.approx(want)
    monkeypatch.setattr(B, "MOST_STEPS", 1)  # larger graphs go as frames, whole as well
    assert {r.id: r.betweenness for r in N.betweenness(steps, nodes, sample).collect()} == pytest.approx(want)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_steps_of_any_size(monkeypatch, chunk):
    monkeypatch.setattr(B, "CHUNK", chunk)
    n, pairs = make(3, 40, 80)
    near = neighbours(n, pairs)
    size = np.array([len(near[v]) for v in range(n)])
    search = B.Search(np.cumsum(size) - size, size, np.array([w for v in range(n) for w in near[v]], np.int32))
    want = np.zeros(n)
    for s in range(n):
        search.run(s)
        d, paths, order = bfs(near, s)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if d[v] == d[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            want[w] += delta[w] if w != s else 0
    assert search.total == pytest.approx(want)


def test_names_as_ids_and_lone_nodes(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdz"], "id string")
    pairs = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "a string, b string, weight long")
    got = {r.id: r.betweenness for r in N.betweenness(G.both_ways(pairs), nodes).collect()}
    assert got == pytest.approx({"a": 0, "b": 4 / 12, "c": 4 / 12, "d": 0, "z": 0})
    assert N.betweenness(G.both_ways(pairs).where(F.lit(False)), nodes).count() == 5
