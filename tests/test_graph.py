"""Graph operators against plain Python on small random graphs."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from castweave.operators import graph as G


def make(seed, n=14, m=18):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return n, sorted(pairs)


def frames(spark, n, pairs):
    return (
        spark.createDataFrame([(i,) for i in range(n)], "id long"),
        spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, weight long"),
    )


def neighbours(n, pairs):
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return near


def bfs(near, s):
    dist, paths, order, queue = {s: 0}, {s: 1}, [], deque([s])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if w not in dist:
                dist[w], paths[w] = dist[v] + 1, 0
                queue.append(w)
            if dist[w] == dist[v] + 1:
                paths[w] += paths[v]
    return dist, paths, order


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_closeness_betweenness_components(spark, seed):
    n, pairs = make(seed)
    nodes, undirected = frames(spark, n, pairs)
    near, steps = neighbours(n, pairs), G.both_ways(undirected)
    dist = G.distances(steps, nodes)
    want = {(s, v): bfs(near, s)[0][v] for s in range(n) for v in bfs(near, s)[0]}
    assert {(r.src, r.node): r.dist for r in dist.collect()} == want
    sums = G.source_sums(steps, nodes, nodes)
    close = {r.id: r.closeness for r in G.closeness(sums, nodes, sampled=False).collect()}
    between = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        d, paths, order = bfs(near, s)
        total, reached = sum(d.values()), len(d) - 1
        assert close[s] == pytest.approx(reached / total * reached / (n - 1) if total else 0.0)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if d[v] == d[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                between[w] += delta[w]
    ours = {r.id: r.betweenness for r in G.betweenness(steps, nodes, dist).collect()}
    for v in range(n):
        assert ours[v] == pytest.approx(between[v] / ((n - 1) * (n - 2)))
    labels = {r.id: r.component for r in G.components(steps, nodes).collect()}
    assert labels == {v: min(bfs(near, v)[0]) for v in range(n)}
    average = G.average_path(sums).first()[0]
    assert average == pytest.approx(sum(want.values()) / sum(1 for x in want.values() if x))


def test_structure(spark):
    n, pairs = make(5, 9, 16)
    nodes, undirected = frames(spark, n, pairs)
    near = neighbours(n, pairs)
    closed = sum(b in near[a] for v in range(n) for a, b in itertools.combinations(sorted(near[v]), 2))
    wedges = sum(len(near[v]) * (len(near[v]) - 1) / 2 for v in range(n))
    local = [
        sum(b in near[a] for a, b in itertools.combinations(near[v], 2)) / (len(near[v]) * (len(near[v]) - 1) / 2)
        if len(near[v]) > 1
        else 0.0
        for v in range(n)
    ]
    row = G.structure(undirected, nodes).first()
    assert (row.nodes, row.edges) == (n, len(pairs))
    assert row.density == pytest.approx(2 * len(pairs) / (n * (n - 1)))
    assert row.transitivity == pytest.approx(closed / wedges)
    assert row.average_clustering == pytest.approx(sum(local) / n)


def test_pagerank_and_hits(spark):
    edges = [(0, 1, 2), (1, 2, 1), (2, 0, 1), (3, 2, 4), (0, 2, 1)]
    n = 5
    rank = [1 / n] * n
    for _ in range(100):
        out = {s: sum(w for a, _, w in edges if a == s) for s in range(n)}
        loose = sum(rank[s] for s in range(n) if not out[s])
        rank = [0.15 / n + 0.85 * (loose / n + sum(rank[a] * w / out[a] for a, b, w in edges if b == v)) for v in range(n)]
    frame = spark.createDataFrame(edges, "src long, dst long, weight long")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    got = {r.id: r.rank for r in G.pagerank(frame, nodes, iterations=40, tolerance=1e-7).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-6)
    for v in range(n):
        assert got[v] == pytest.approx(rank[v], abs=1e-4)
    hub = [1.0] * n
    for _ in range(20):
        auth = [sum(hub[a] * w for a, b, w in edges if b == v) for v in range(n)]
        hub = [sum(auth[b] * w for a, b, w in edges if a == v) for v in range(n)]
        hub = [h / sum(hub) for h in hub]
    scores = {r.id: r.hub for r in G.hits(frame, nodes, iterations=20, tolerance=None).collect()}
    for v in range(n):
        assert scores[v] == pytest.approx(hub[v], abs=1e-9)


def test_two_shows_with_a_shared_guest(spark):
    """Two hosts, one shared guest: three nodes, two edges, one pair of shows."""
    rows = [(1, 10, 1, "host"), (1, 10, 3, "guest"), (2, 20, 2, "host"), (2, 20, 3, "guest")]
    app = spark.createDataFrame(rows, "episode_id long, podcast_id long, person_id long, role string")
    edges = G.person_edges(app)
    assert {tuple(r) for r in edges.collect()} == {(3, 1, 1), (3, 2, 1)}
    assert [tuple(r) for r in G.shared_guest_pairs(app).collect()] == [(10, 20, 1)]
    nodes = app.select(F.col("person_id").alias("id")).distinct()
    degrees = {r.id: r.degree for r in G.degree(G.undirected(edges), nodes).collect()}
    assert degrees == {1: 1, 2: 1, 3: 2}


def test_empty(spark):
    nodes = spark.createDataFrame([], "id long")
    edges = spark.createDataFrame([], "src long, dst long, weight long")
    steps = edges.select("src", "dst")
    assert G.pagerank(edges, nodes).count() == 0
    assert G.hits(edges, nodes, iterations=2).count() == 0
    dist = G.distances(steps, nodes)
    assert dist.count() == 0 and G.average_path(G.source_sums(steps, nodes, nodes)).first()[0] == 0.0
    assert G.components(steps, nodes).count() == 0
    assert G.betweenness(steps, nodes, dist).count() == 0
    assert G.structure(G.undirected(edges), nodes).first().nodes == 0


def test_many_sources_share_numbers(spark):
    """More than 64 sources: distances by bits are those of one search per source."""
    n = 150
    edges = [(i, (i * 7 + 3) % n) for i in range(0, n, 2)] + [(i, i + 1) for i in range(0, 90)]
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    nodes, undirected = frames(spark, n, edges)
    near, sources = neighbours(n, edges), sorted(range(n), key=str)[:130]
    want = {v: [0, 0] for v in range(n)}
    for s in sources:
        for v, d in bfs(near, s)[0].items():
            if d:
                want[v][0] += 1
                want[v][1] += d
    got = G.source_sums(G.both_ways(undirected), nodes, G.first_by_text(nodes, 130)).collect()
    assert {r.id: [r.reached, r.total] for r in got} == want


def test_hits_stops_when_nothing_changes(spark):
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, 1), (2, 0, 1), (3, 2, 4), (0, 2, 1)], "src long, dst long, weight long")
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    long, short = (sorted((r.id, round(r.hub, 6)) for r in G.hits(edges, nodes, **k).collect()) for k in ({"iterations": 60, "tolerance": None}, {"tolerance": 1e-9}))
    assert long == short
