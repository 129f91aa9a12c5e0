"""Network metrics make no row for every source and node."""

import pytest
from castweave.operators import graph as G
from castweave.operators import network as N
from test_network import APP, rows


@pytest.mark.parametrize("query", ["person_metrics", "week_people"])
def test_scores_without_a_row_for_every_source_and_node(spark, monkeypatch, query):
    def refuse(*_):
        raise AssertionError("a row per source and node")

    monkeypatch.setattr(G, "distances", refuse)
    app = spark.createDataFrame(rows(), APP)
    if query == "person_metrics":
        got = {r.id: r.betweenness for r in N.person_metrics(app).collect()}
        assert got == pytest.approx({1: 0, 2: 5 / 6, 3: 3 / 6, 4: 0, 5: 0})
    else:
        got = {r.id: r.betweenness for r in N.week_people(app, "2024-01-08", None, 10).collect()}
        assert got == pytest.approx({1: 0, 2: 4 / 6, 3: 4 / 6, 4: 0})
