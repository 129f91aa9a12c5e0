"""The graph queries with the operators' own parameters, against plain Python."""

from types import SimpleNamespace

import pytest
from test_graph import bfs, neighbours

from castweave.plans import graphs


def catalog(spark, edges):
    """Every edge is an episode of a guest and a host."""
    rows = [(i, p, role) for i, edge in enumerate(edges) for p, role in zip(edge, ("guest", "host"), strict=True)]
    return SimpleNamespace(appearance=spark.createDataFrame(rows, "episode_id long, person_id long, role string").cache())


@pytest.mark.parametrize("n", [40, 1100])
def test_sources(spark, n):
    """40 nodes are all sources; of 1,100 the first 1,000 are, and 200 for the average path."""
    edges = [(i, (i - 1) // 4) for i in range(1, n)] + [(n - 1, 5)]
    near, c = neighbours(n, edges), catalog(spark, edges)
    sources = sorted(range(n), key=str)[:1000]
    total, reached, between = [0] * n, [0] * n, [0.0] * n
    lengths = []
    for k, s in enumerate(sources):
        d, paths, order = bfs(near, s)
        lengths += [x for x in d.values() if x and k < 200]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if d[v] == d[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                total[w] += d[w]
                reached[w] += 1
                between[w] += delta[w]
    close = {r.id: r.closeness for r in graphs.closeness(c).collect()}
    assert close == pytest.approx({v: reached[v] / total[v] for v in range(n)})
    scale = n / len(sources) / ((n - 1) * (n - 2))
    assert {r.id: r.betweenness for r in graphs.betweenness(c).collect()} == pytest.approx({v: between[v] * scale for v in range(n)})
    assert graphs.average_path(c).first()[0] == pytest.approx(sum(lengths) / len(lengths))


def test_rounds(spark):
    n = 30
    edges = [(i, (i + 1) % n) for i in range(n)] + [(i, i // 3) for i in range(4, n, 2)] + [(0, 7)] * 3
    c = catalog(spark, edges)
    rank, rounds = [1 / n] * n, 0
    out = [sum(a == v for a, _ in edges) for v in range(n)]
    while rounds < 100:
        new, rounds = [0.15 / n + 0.85 * sum(rank[a] / out[a] for a, b in edges if b == v) for v in range(n)], rounds + 1
        change, rank = sum(abs(x - y) for x, y in zip(new, rank, strict=True)), new
        if change < n * 1e-6:
            break
    assert rounds > graphs.ROUNDS
    assert {r.id: r.rank for r in graphs.pagerank(c).collect()} == pytest.approx(dict(enumerate(rank)), abs=1e-12)
    hub, change = [1.0] * n, 1.0
    while change >= 1e-8:
        auth = [sum(hub[a] for a, b in edges if b == v) for v in range(n)]
        new = [sum(auth[b] for a, b in edges if a == v) for v in range(n)]
        new = [h / sum(new) for h in new]
        change, hub = sum(abs(x - y) for x, y in zip(new, hub, strict=True)), new
    assert {r.id: r.hub for r in graphs.hits(c).collect()} == pytest.approx(dict(enumerate(hub)), abs=1e-12)
