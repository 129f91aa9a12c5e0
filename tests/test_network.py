"""Metrics of a whole network and its weekly snapshots on small graphs whose values are known."""

import datetime as dt

import pytest
from castweave.operators import network as N

APP = "episode_id long, podcast_id long, person_id long, name string, role string, published_at timestamp"


def day(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC)


def rows():
    """Two shows: one with hosts 1, one with 2; guest 3 on both, guest 4 on the second a week later, 5 undated."""
    one, two, three = day("2024-01-02"), day("2024-01-03"), day("2024-01-10")
    return [
        (1, 10, 1, "Ann", "host", one), (1, 10, 3, "Cid", "guest", one),
        (2, 20, 2, "Bob", "host", two), (2, 20, 3, "Cid", "guest", two),
        (3, 20, 2, "Bob", "host", three), (3, 20, 4, "Dot", "guest", three),
        (4, 20, 5, "Eve", "guest", None), (4, 20, 2, "Bob", "host", None),
    ]


def test_person_metrics(spark):
    got = {r.id: r for r in N.person_metrics(spark.createDataFrame(rows(), APP)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    # 1 - 3 - 2 - 4 and 2 - 5: node 2 lies between five of six pairs of the others, node 3 between three.
    assert got[2].betweenness == pytest.approx(5 / 6) and got[3].betweenness == pytest.approx(3 / 6)
    assert got[2].closeness == pytest.approx(4 / 5) and got[2].closeness_rank == 1
    assert got[2].degree_centrality == pytest.approx(3 / 4) and got[2].degree_rank == 1
    assert got[2].host_appearances == 3 and got[3].guest_appearances == 2 and got[3].podcasts == 2
    assert sum(r.pagerank for r in got.values()) == pytest.approx(1, abs=1e-5)
    assert sorted(r.authority_rank for r in got.values()) == [1, 2, 3, 4, 5]
    assert sum(r.hub for r in got.values()) == pytest.approx(1)


def test_podcast_metrics(spark):
    got = {r.id: r for r in N.podcast_metrics(spark.createDataFrame(rows(), APP)).collect()}
    assert {k: r.shared_guest_edges for k, r in got.items()} == {10: 1, 20: 1}
    assert got[10].closeness == 1.0 and (got[10].closeness_rank, got[20].closeness_rank) == (1, 2)


def test_week_snapshot(spark):
    app = spark.createDataFrame(rows(), APP)
    first, second = (N.week_snapshot(app, w).first() for w in ("2024-01-01", "2024-01-08"))
    assert (first.people, first.edges, first.podcasts, first.episodes, first.guest_appearances) == (3, 2, 2, 2, 2)
    assert (first.new_people, first.new_edges, first.new_podcasts) == (3, 2, 2)
    assert (second.people, second.new_people, second.new_edges, second.new_podcasts) == (4, 1, 1, 0)
    assert (second.component_people, second.component_edges) == (4, 3)
    assert second.density == pytest.approx(0.5) and second.transitivity == 0
    assert second.average_path == pytest.approx((1 + 2 + 3 + 1 + 2 + 1) / 6)


def test_week_people_and_stored_weeks(spark, tmp_path):
    app = spark.createDataFrame(rows(), APP)
    metric = spark.createDataFrame([(4, 1), (9, 1), (1, 900)], "id long, pagerank_rank int")
    kept = {r.id for r in N.week_people(app, "2024-01-08", metric, 1).collect()}
    assert kept == {1, 2, 3, 4}  # one stored, the ten best of the week, nobody who is not there
    path = str(tmp_path / "weeks")
    weeks = ["2024-01-01", "2024-01-08"]
    assert N.store_weeks(spark, app, weeks, path) == weeks
    assert N.store_weeks(spark, app, weeks, path) == []
    assert N.store_weeks(spark, app, weeks[1:], path, recompute=True) == weeks[1:]
    assert {str(r.week): r.people for r in spark.read.parquet(path).collect()} == {"2024-01-01": 3, "2024-01-08": 4}


def test_empty(spark):
    app = spark.createDataFrame([], APP)
    assert N.person_metrics(app).count() == 0 and N.podcast_metrics(app).count() == 0
    row = N.week_snapshot(app, "2024-01-01").first()
    assert (row.people, row.edges, row.component_people, row.average_path) == (0, 0, 0, 0.0)
    assert N.tracked(spark.createDataFrame([], "id long, pagerank_rank int, hub_rank int, authority_rank int, closeness_rank int, betweenness_rank int, degree_rank int"), None, 5).count() == 0
