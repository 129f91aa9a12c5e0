"""Closeness and betweenness of people come from all of them, however many there are."""

import pytest
from pyspark.sql import functions as F
from test_graph import bfs, neighbours

from castweave.operators import brandes as B
from castweave.operators import graph as G
from castweave.operators import network as N


def appearances(spark, edges):
    rows = [(i, 1, p, str(p), role) for i, edge in enumerate(edges) for p, role in zip(edge, ("guest", "host"), strict=True)]
    app = spark.createDataFrame(rows, "episode_id long, podcast_id long, person_id long, name string, role string")
    return app.withColumn("published_at", F.lit("2024-01-02").cast("timestamp")).cache()


def exact(n, edges):
    """(closeness, betweenness) of every node by plain searches from all nodes."""
    near, close, between = neighbours(n, edges), {}, dict.fromkeys(range(n), 0.0)
    for s in range(n):
        d, paths, order = bfs(near, s)
        far = sum(d.values())
        close[s] = (len(d) - 1) ** 2 / far / (n - 1) if far else 0.0
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if d[v] == d[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            between[w] += delta[w] if w != s else 0
    return close, {v: x / ((n - 1) * (n - 2)) for v, x in between.items()}


def graph(n):
    """A tree, a cycle across it, and two pairs apart."""
    return [(i, (i - 1) // 4) for i in range(1, n - 4)] + [(n - 5, 5), (n - 4, n - 3), (n - 2, n - 1)]


def test_person_metrics_of_more_people_than_a_sample(spark):
    n = G.SAMPLE + 60
    close, between = exact(n, graph(n))
    got = {r.id: r for r in N.person_metrics(appearances(spark, graph(n))).collect()}
    assert {k: r.closeness for k, r in got.items()} == pytest.approx(close)
    assert {k: r.betweenness for k, r in got.items()} == pytest.approx(between)


def test_larger_graphs_as_frames_have_all_sources_too(spark, monkeypatch):
    n = 30
    close, between = exact(n, graph(n))
    monkeypatch.setattr(B, "MOST_STEPS", 1)
    monkeypatch.setattr(G, "SAMPLE", 16)  # two blocks of sources
    got = {r.id: r for r in N.score_people(appearances(spark, graph(n))).collect()}
    assert {k: r.closeness for k, r in got.items()} == pytest.approx(close)
    assert {k: r.betweenness for k, r in got.items()} == pytest.approx(between)


def test_week_people_of_more_people_than_a_sample(spark):
    n = N.PATH_SAMPLE + 60
    close, between = exact(n, graph(n))
    got = {r.id: r for r in N.week_people(appearances(spark, graph(n)), "2024-01-01", None, n).collect()}
    assert len(got) == n
    assert {k: r.closeness for k, r in got.items()} == pytest.approx(close)
    assert {k: r.betweenness for k, r in got.items()} == pytest.approx(between)
