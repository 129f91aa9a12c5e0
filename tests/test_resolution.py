"""The entity resolution chain on small tables whose results are known."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from castweave.operators import entities as E
from castweave.operators import relational as ops
from castweave.operators import resolution as R

APP = "episode_id long, podcast_id long, person_id long, name string, role string, published_at timestamp"
AT = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)


def observed(spark):
    rows = [
        (1, 10, 5, "Ann Lee", "guest", AT), (1, 10, 5, "Ann Lee", "guest", AT), (2, 20, 6, "ANN LEE", "guest", AT),
        (2, 20, 7, "Bob Roy", "host", None), (3, None, 8, None, "guest", AT),
    ]
    return R.observations(spark.createDataFrame(rows, APP))


def test_observations_are_stable(spark):
    first, second = ({r.observation_id: r.normalized_name for r in observed(spark).collect()} for _ in range(2))
    assert first == second and sorted(first.values()) == ["ann lee", "ann lee", "bob roy"]


def test_links_made_by_hand_are_kept(spark):
    rows = observed(spark)
    bob = rows.where("role = 'host'").first().observation_id
    schema = "observation_id string, am_entity_id string, method string"
    before = spark.createDataFrame([(bob, "robert", "manual"), ("gone", "x", "manual")], schema)
    got = {r.observation_id: (r.am_entity_id, r.method) for r in R.links(rows, before).collect()}
    assert got.pop(bob) == ("robert", "manual")
    assert len(got) == 2 and len(set(got.values())) == 1 and set(m for _, m in got.values()) == {R.EXACT}
    again = R.links(rows, R.links(rows, before))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in R.links(rows, before).collect()}


def test_profiles(spark):
    rows = observed(spark)
    link = R.links(rows, spark.createDataFrame([], "observation_id string, am_entity_id string, method string"))
    genres = spark.createDataFrame([(10, ["Arts", "News"]), (20, ["News"]), (30, ["Other"])], "podcast_id long, genres array<string>")
    got = {r.normalized_name: r for r in R.profiles(E.canonicals(rows), link, rows, genres).collect()}
    assert got["ann lee"].podcast_ids == [10, 20] and got["ann lee"].genres == ["Arts", "News"] and got["ann lee"].observation_count == 2
    assert got["bob roy"].roles == ["host"] and got["bob roy"].tokens == ["bob", "roy"]
    assert R.profiles(E.canonicals(rows), link, rows, genres, least=2).count() == 1


def test_examples_leave_contradictions_out(spark):
    pairs = spark.createDataFrame(
        [("a", "b", "accepted"), ("b", "a", "accepted"), ("c", "d", "rejected"), ("e", "f", "accepted"), ("f", "e", "rejected"), ("g", "g", "accepted"), ("h", "i", "candidate")],
        "left_id string, right_id string, status string",
    )
    features = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 0.0), ("e", "f", 0.5), ("h", "i", 0.5)], "left_id string, right_id string, x double")
    assert {(r.left_id, r.label) for r in R.examples(pairs, features).collect()} == {("a", 1), ("c", 0)}


def test_training_measures_a_held_out_quarter(spark):
    rows = [(f"l{i}", f"r{i}", float(i % 2) + (i % 7) * 0.01, None if i % 5 else 0.3, i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "left_id string, right_id string, x double, y double, label int")
    model, found = R.train_measured(df, ["x", "y"])
    assert 14 <= found["holdout_examples"] <= 26 and found["accuracy"] == 1.0 and found["roc_auc"] == pytest.approx(1.0)
    assert R.weights(model, ["x", "y"])[0][0] == "x"
    scored = R.probabilities(model, df, ["x", "y"])
    assert scored.where((F.col("probability") > 0.5) == (F.col("label") == 1)).count() == 80
    _, none = R.train_measured(df.where("label = 0").limit(12).unionByName(df.where("label = 1").limit(3)), ["x", "y"])
    assert none == {}
    with pytest.raises(ValueError):
        R.train_measured(df.limit(4), ["x", "y"])


def test_measures(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)], "label int, probability double")
    got = R.measure(rows)
    assert got["accuracy"] == 0.5 and got["precision"] == 0.5 and got["recall"] == 0.5 and got["f1"] == 0.5
    assert got["roc_auc"] == pytest.approx(0.75)


def test_score_reasons_and_decisions(spark):
    names = sorted(
        {"name_sequence_ratio", "token_jaccard", "cleaned_name_sequence_ratio", "cleaned_token_jaccard", "nickname_stripped_name_sequence_ratio",
         "nickname_stripped_token_jaccard", "role_jaccard", "genre_jaccard", "shared_podcast_count", "graph_distance_proxy", "has_graph_distance_proxy",
         "same_token_set", "same_cleaned_token_set", "one_name_has_quoted_nickname", "same_nickname_stripped_token_set", "one_name_contains_other_tokens",
         "same_first_token", "same_last_token", "same_cleaned_first_token", "same_cleaned_last_token", "both_group_names", "same_group_name_tokens", "one_group_name"}
    )
    full = dict.fromkeys(names, 0.0) | dict.fromkeys(
        ["name_sequence_ratio", "token_jaccard", "cleaned_name_sequence_ratio", "cleaned_token_jaccard", "same_token_set", "same_cleaned_token_set",
         "same_first_token", "same_last_token", "same_cleaned_first_token", "same_cleaned_last_token"], 1.0
    )
    rows = [("a", "b", *(full[n] for n in names)), ("c", "d", *([0.0] * len(names))), ("e", "f", *((full | {"one_group_name": 1.0})[n] for n in names)), ("g", "h", *([None] * len(names)))]
    df = spark.createDataFrame(rows, "left_id string, right_id string, " + ", ".join(f"{n} double" for n in names))
    got = {r.left_id: r for r in E.scored(df).collect()}
    assert got["a"].score == 0.999 and got["a"].decision == "accepted" and got["a"].reasons[0] == "same token set"
    assert "high nickname-stripped similarity" in got["a"].reasons
    assert got["c"].score == 0.0 and got["c"].decision == "rejected" and got["c"].reasons[-1] == "no graph proximity"
    assert got["e"].score == 0.3 and got["e"].reasons[-1] == "group name compared with person name"
    assert got["g"].score == got["c"].score


def test_blocking_keys_and_classes(spark):
    df = spark.createDataFrame([("x1", "dr john a smith"), ("x2", "smith john"), ("x3", "")], "entity_id string, normalized_name string")
    got = {r.entity_id: set(r.k) for r in df.select("entity_id", E.blocking_keys(F.col("normalized_name")).alias("k")).collect()}
    assert got["x1"] == {
        "token-set:a dr john smith", "first-last:dr:smith", "first-two:dr:john", "clean-token-set:a john smith", "clean-first-last:john:smith",
        "clean-first-two:john:a", "clean-first-last-prefix:john:smit",
    }
    assert got["x3"] == set()
    many = [(f"e{i:02}", "john smith") for i in range(6)] + [("f1", "john smithe"), ("f2", "john a smith"), ("f3", "john smalltown")]
    profile = spark.createDataFrame(many, "entity_id string, normalized_name string")
    pairs, members = E.block_class_pairs(profile, block_limit=4)
    classes = {r.entity_id: r.class_id for r in members.collect()}
    assert {k: v for k, v in classes.items() if k.startswith("e")} == {f"e{i:02}": "e00" for i in range(6)}
    assert {("e00", "f1"), ("e00", "f2")} <= {tuple(r) for r in pairs.collect()}
    assert E.block_class_pairs(profile.limit(0))[0].count() == 0


def test_merges_take_unknown_probabilities_last(spark):
    rows = [("s", "a", None), ("s", "b", 0.2), ("b", "c", None)]
    df = spark.createDataFrame(rows, "source_id string, target_id string, p double")
    assert {tuple(r) for r in E.apply_merges(df, "p").collect()} == {("s", "c"), ("b", "c")}


def test_known_hosts(spark):
    app = spark.createDataFrame([(1, 10, 5, "Ann Lee", "host", AT)], APP)
    cand = spark.createDataFrame([(10, "ann lee", "host", 0.99), (10, "Bob Roy", "host", 0.95), (10, "Low", "host", 0.2)], "podcast_id long, name string, role string, confidence double")
    podcast = spark.createDataFrame([(10, {"legacy": {"categories": [], "hosts": ["Cid Poe", "Bob Roy"]}})], "id long, metadata struct<legacy:struct<categories:array<string>,hosts:array<string>>>")
    assert {(r.name, r.kind) for r in R.known_hosts(app, cand, podcast).collect()} == {("Ann Lee", "confirmed"), ("Bob Roy", "extracted"), ("Cid Poe", "metadata")}


def test_rankings_modes_health(spark):
    metric = spark.createDataFrame([(1, "a", "A", 1, 2, 9), (2, "a", "A", 1, 2, 5), (2, "a", "A", 1, 2, 5), (2, "b", "B", 2, 1, 7), (2, "c", "C", None, 3, 8)],
                                   "run_id int, canonical_id string, display_name string, representative_person_id long, hub_rank int, guest_appearances int")
    assert [r.canonical_id for r in ops.ranked_by_metric(metric, "hub").collect()] == ["b", "a"]
    assert [r.canonical_id for r in ops.ranked_by_metric(metric, "appearances").collect()] == ["b", "a"]
    assert [r.canonical_id for r in ops.ranked_by_metric(metric, "hub", query="b").collect()] == ["b"]
    votes = spark.createDataFrame([("k", 2), ("k", 2), ("k", 1), ("k", 1), ("j", None)], "key string, v long")
    assert [tuple(r) for r in ops.most_common(votes, "key", "v").collect()] == [("k", 1)]
    podcast = spark.createDataFrame([(1, "a", True, None), (2, "b", False, False)], "id long, name string, active boolean, is_interview_podcast boolean")
    episode = spark.createDataFrame([(1, 1, AT), (1, 1, AT), (2, 1, None)], "id long, podcast_id long, published_at timestamp")
    state = spark.createDataFrame([(1, 500, 0)], "podcast_id long, last_status int, failure_count int")
    rows = ops.feed_health(podcast, episode, state)
    assert {r.podcast_id: (r.episodes, r.problem) for r in rows.collect()} == {1: (2, True), 2: (0, True)}
    assert tuple(ops.feed_health_sums(rows).first()) == (2, 1, 1, 0, 0, 1, 2, 2)
    logs = spark.createDataFrame([(v,) for v in (1, 10, 100, 0, None)], "v long")
    assert {r.bin: r["count"] for r in ops.histogram(logs, "v", 2, log=True).collect()} == {0: 1, 1: 2}
