import datetime as dt

from castweave.operators import paths as P

EVENTS = "person string, show string, kind string, date date"


def day(text):
    return dt.date.fromisoformat(text) if text else None


def edges(spark, rows):
    return P.merge_edges(spark.createDataFrame([(p, s, k, day(d)) for p, s, k, d in rows], EVENTS))


def walk(spark, rows, a, b, window=None):
    merged = edges(spark, rows)
    if window:
        merged = merged.where(P.in_window(*window))
    return [r.node for r in P.shortest_path(merged, a, b).orderBy("position").collect()]


BASE = [
    ("alice", "show:a", "host", "2020-01-01"), ("bob", "show:a", "guest", "2020-02-01"),
    ("bob", "show:b", "host", "2024-01-01"), ("carla", "show:b", "guest", "2024-02-01"),
]


def test_path_and_sentence(spark):
    assert walk(spark, BASE, "alice", "carla") == ["alice", "show:a", "bob", "show:b", "carla"]
    merged = edges(spark, BASE)
    names = spark.createDataFrame([("alice", "Alice"), ("show:a", "A"), ("bob", "Bob"), ("show:b", "B"), ("carla", "Carla")], "node string, name string")
    text = P.explain_path(P.shortest_path(merged, "alice", "carla"), merged, names).first()[0]
    assert text == "Alice is a host of A, who had as a guest Bob, who was a guest on B, who had as a guest Carla."
    same = P.explain_path(P.shortest_path(merged, "bob", "bob"), merged, names).first()[0]
    assert same == "Bob is the same person."


def test_host_route_wins_and_no_path(spark):
    rows = [("x", "show:1", "guest", "2020-01-01"), ("y", "show:1", "guest", "2020-01-01"),
            ("x", "show:2", "host", "2020-01-01"), ("y", "show:2", "guest", "2020-01-01"), ("z", "show:9", "host", None)]
    assert walk(spark, rows, "x", "y") == ["x", "show:2", "y"]
    assert walk(spark, rows, "x", "z") == []
    assert walk(spark, rows, "x", "nobody") == []


def test_windows(spark):
    assert walk(spark, BASE, "alice", "bob", ("2024-01-01", "2024-12-31")) == []
    assert walk(spark, BASE, "bob", "carla", ("2024-01-01", "2024-12-31")) == ["bob", "show:b", "carla"]
    merged = {(r.person, r.show): r for r in edges(spark, [*BASE, ("bob", "show:a", "host", None), ("q", "show:a", "host", None)]).collect()}
    both = merged["bob", "show:a"]
    assert both.kind == "host" and both.dates == [] and both.active_start == both.active_end == day("2020-02-01")
    undated = edges(spark, [("q", "show:a", "host", None)])
    assert undated.where(P.in_window("2000-01-01", None)).count() == 0
    assert undated.where(P.in_window(None, None)).count() == 1


def test_names(spark):
    names = spark.createDataFrame([("Joe Rogan",), ("José Andrés",), ("Bob Ray",)], "name string")
    asked = spark.createDataFrame([("jose andres",), ("Joe Rogan",), ("Nobody",)], "query string")
    assert {r.query: r.resolved for r in P.resolve_names(asked, names).collect()} == {
        "jose andres": "José Andrés", "Joe Rogan": "Joe Rogan", "Nobody": None,
    }
    typo = spark.createDataFrame([("Joe Rogain",)], "query string")
    assert P.suggest_names(typo, names).first().name == "Joe Rogan"
    assert P.suggest_names(typo, names.limit(0)).count() == 0


def test_answers_without_a_path(spark):
    edges = P.merge_edges(spark.createDataFrame(
        [("person:1", "show:1", "host", dt.date(2024, 1, 1)), ("person:2", "show:1", "guest", dt.date(2024, 1, 1)), ("person:3", "show:2", "host", dt.date(2024, 1, 1))],
        "person string, show string, kind string, date date"))
    names = spark.createDataFrame(
        [("person:1", "Ann Lee"), ("person:2", "Bob Roy"), ("person:3", "Cid Poe"), ("show:1", "One"), ("show:2", "Two")], "node string, name string"
    )
    ask = lambda a, b: tuple(P.connect(edges, names, a, b).first())
    assert ask("ann lee", "Bob Roy")[0] and ask("Ann Lee", "Bob Roy")[1].startswith("Ann Lee is a host of One")
    assert ask("Ann Lee", "Cid Poe") == (False, "No connection found between Ann Lee and Cid Poe.", "")
    assert ask("An Lee", "Cid Po") == (False, "Sorry, we could not find An Lee in the database. Did you mean Ann Lee?", "Ann Lee")
    assert ask("Ann Lee", "Bob Roi")[2] == "Bob Roy"
    assert P.explain_path(P.shortest_path(edges, "person:1", "person:3"), edges, names).count() == 0
    assert {r.query: r.name for r in P.suggest_names(spark.createDataFrame([("An Lee",), ("Bob Roi",)], "query string"), names.select("name")).collect()} == {"An Lee": "Ann Lee", "Bob Roi": "Bob Roy"}
