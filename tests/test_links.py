"""PageRank and HITS in one task, distances from the searches of betweenness: the values of the frames, no jobs for rounds."""

import pytest
from pyspark.sql import functions as F
from test_graph import frames, make
from test_network import APP, rows

from castweave.operators import brandes as B
from castweave.operators import graph as G
from castweave.operators import links as L
from castweave.operators import network as N


def directed(spark, seed, n, pairs):
    """A random graph; every third edge goes down, weights differ, some nodes have no edge."""
    nodes, _ = frames(spark, n, make(seed, n, pairs)[1])
    edges = [((b, a) if i % 3 == 0 else (a, b)) + (1 + i % 4,) for i, (a, b) in enumerate(sorted(make(seed, n - 4, pairs)[1]))]
    return nodes, spark.createDataFrame(edges, "src long, dst long, weight long")


def values(df, *names):
    return {r.id: pytest.approx([r[x] for x in names], abs=1e-12) for r in df.collect()}


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_links_as_the_frames_have_them(spark, monkeypatch, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    monkeypatch.setattr(L, "ROWS", 7)
    nodes, edges = directed(spark, 5, 24, 30)
    got = {r.id: [r.pagerank, r.hub, r.authority] for r in N.link_scores(edges, nodes, B.numbered(nodes)).collect()}
    frames_ = G.pagerank(edges, nodes).withColumnRenamed("rank", "pagerank").join(G.hits(edges, nodes), "id")
    assert len(got) == nodes.count() and got == values(frames_, "pagerank", "hub", "authority")


@pytest.mark.parametrize("sample", [5, 1000])
def test_paths_as_the_frames_have_them(spark, monkeypatch, sample):
    nodes, edges = directed(spark, 9, 30, 40)
    steps = G.both_ways(G.undirected(edges))
    want = values(N.closeness(steps, nodes, sample).join(N.betweenness(steps, nodes, sample), "id"), "closeness", "betweenness")
    numbers = B.numbered(nodes)
    for most in (B.MOST_STEPS, 1):  # larger graphs go as frames, whole as well
        monkeypatch.setattr(B, "MOST_STEPS", most)
        got = {r.id: [r.closeness, r.betweenness] for r in N.path_scores(steps, nodes, numbers, sample).collect()}
        assert len(got) == nodes.count() and got == want


def test_larger_graphs_go_as_frames(spark, monkeypatch):
    app = spark.createDataFrame(rows(), APP)
    want = values(N.score_people(app), *N.SCORES)
    monkeypatch.setattr(L, "MOST_EDGES", 1)
    assert {r.id: [r[x] for x in N.SCORES] for r in N.score_people(app).collect()} == want


def test_person_metrics_without_jobs_for_rounds(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("jobs for every round")

    app = spark.createDataFrame(rows(), APP)
    for name in ("pagerank", "hits", "source_sums", "distances"):
        monkeypatch.setattr(G, name, refuse)
    got = {r.id: r for r in N.person_metrics(app).collect()}
    assert {k: r.closeness for k, r in got.items()} == pytest.approx({1: 4 / 9, 2: 4 / 5, 3: 4 / 6, 4: 4 / 8, 5: 4 / 8})
    assert {k: r.betweenness for k, r in got.items()} == pytest.approx({1: 0, 2: 5 / 6, 3: 3 / 6, 4: 0, 5: 0})
    assert sum(r.pagerank for r in got.values()) == pytest.approx(1) and sum(r.hub for r in got.values()) == pytest.approx(1)
    assert N.person_metrics(app.where(F.lit(False))).count() == 0


def test_week_people_without_jobs_for_rounds(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("jobs for every round")

    app = spark.createDataFrame(rows(), APP)
    for name in ("pagerank", "hits", "source_sums", "distances"):
        monkeypatch.setattr(G, name, refuse)
    # 1 - 3 - 2 - 4 until the end of that week; 5 has no date.
    got = {r.id: r for r in N.week_people(app, "2024-01-08", None, 10).collect()}
    assert {k: r.closeness for k, r in got.items()} == pytest.approx({1: 3 / 6, 2: 3 / 4, 3: 3 / 4, 4: 3 / 6})
    assert {k: r.betweenness for k, r in got.items()} == pytest.approx({1: 0, 2: 4 / 6, 3: 4 / 6, 4: 0})
    assert sum(r.pagerank for r in got.values()) == pytest.approx(1) and sum(r.authority for r in got.values()) == pytest.approx(1)
