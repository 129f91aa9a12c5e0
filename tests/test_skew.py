from collections import Counter

from pyspark.sql import functions as F

from castweave.operators import skew


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_join_states_equal_plain_join(spark):
    left = frame(spark, [(i % 3 if i % 7 else None, i if i % 5 else None) for i in range(60)], "k long, v long")
    right = frame(spark, [(i % 4 if i % 6 else None, i) for i in range(30)], "k long, w long")
    ours = skew.join_states(skew.key_state(left, "k", "l", ["v"]), skew.key_state(right, "k", "r", ["w"]), "l", "r")
    plain = left.join(right, "k").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w"))
    got = {(r.key, r.n, r.l_sum_v, r.r_sum_w) for r in ours.collect()}
    assert got == {(r.k, r.n, r.v, r.w) for r in plain.collect()}


def test_hot_keys_and_distinct(spark):
    rows = [(1, "a")] * 97 + [(2, "b")] * 2 + [(None, "c")]
    df = frame(spark, rows, "k long, v string")
    hot = skew.hot_keys(skew.key_state(df, "k", "s"), "s_n")
    assert {r.key for r in hot.collect()} == {1, 2}
    assert Counter({r.key: r.d for r in skew.distinct_per_key(df, "k", "v", "d").collect()}) == {1: 1, 2: 1, None: 1}


def test_empty(spark):
    df = frame(spark, [], "k long, v string")
    assert skew.hot_keys(skew.key_state(df, "k", "s"), "s_n").count() == 0
    assert skew.distinct_per_key(df, "k", "v", "d").count() == 0


def test_found(spark):
    episode = frame(spark, [(1, "x", 5)] * 50 + [(2, "y", 5)], "podcast_id long, key string, n int")
    podcast = frame(spark, [(2,), (3,)], "id long")
    metric = frame(spark, [("e", 3), ("f", 3), (None, 3), ("e", None)], "canonical_id string, guest_appearances int")
    canonical = frame(spark, [("e", 3)], "am_entity_id string, guest_appearances int")
    got = {tuple(r) for r in skew.found_hot(episode, podcast, metric, canonical).collect()}
    assert got == {("podcast_id", 1), ("guest_appearances", 3)}


def test_join_hot_is_the_plain_join(spark, monkeypatch):
    rows = frame(spark, [(7 if i % 3 else i if i % 5 else None, i) for i in range(300)], "k long, v long")
    lookup = frame(spark, [(i, f"n{i}") for i in range(0, 300, 2)] + [(7, "hot"), (None, "x")], "k long, name string")
    monkeypatch.setattr(skew, "SPLIT_FROM", 10)
    monkeypatch.setattr(skew, "HOT_PARTS", 4)
    assert skew.hot_values(rows, "k") == [7]
    for how in ("inner", "left"):
        got = Counter(map(tuple, skew.join_hot(rows, lookup, "k", how).collect()))
        assert got == Counter(map(tuple, rows.join(lookup, "k", how).collect()))


def test_joined_rows(spark):
    fact = frame(spark, [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (None, "b")], "k long, g string")
    dimension = frame(spark, [(1, 0), (1, 0), (2, 0), (None, 0)], "k long, g int")
    got = {(r.key, r.n) for r in skew.joined_rows(fact, "k", "g", dimension, "k").collect()}
    assert got == {("a", 5), ("b", 2)}
