import pytest
from pyspark.sql import functions as F

from castweave.operators import entities as E

SCHEMA = (
    "entity_id string, display_name string, normalized_name string, tokens array<string>, alpha_tokens array<string>, "
    "observation_count int, roles array<string>, podcast_ids array<bigint>, genres array<string>"
)


def profile(i, display, normalized, shows=(1,), genres=("comedy",), roles=("guest",)):
    tokens = normalized.split() if normalized else []
    return (i, display, normalized, tokens, [t for t in tokens if t.isalpha()], 2, list(roles), list(shows), list(genres))


def features(spark, left, right):
    profiles = spark.createDataFrame([left, right], SCHEMA)
    pairs = spark.createDataFrame([(left[0], right[0])], "left_id string, right_id string")
    return E.pair_features(E.profile_pairs(pairs, profiles)).withColumn("score", E.heuristic_score())


def test_all_features_are_there(spark):
    df = features(spark, profile("a", "Tim Andrews", "tim andrews"), profile("b", "Tim Andrews Here", "tim andrews here"))
    assert len(df.columns) == 2 + 67 + 1
    row = df.first()
    assert (row.token_overlap_count, row.shared_podcast_count, row.shared_genre_count, row.graph_distance_proxy) == (2, 1, 1, 2)


@pytest.mark.parametrize(
    ("left", "right", "least", "most"),
    [
        (("a", "Dr. Zach Bush", "dr zach bush"), ("b", "Zach Bush, MD", "zach bush md"), 0.95, 1),
        (("a", 'Michael "Killer Mike" Render', "michael killer mike render"), ("b", "Michael Render", "michael render"), 0.95, 1),
        (("a", "The Lucas Brothers", "the lucas brothers"), ("b", "The Sklar Brothers", "the sklar brothers"), 0, 0.2),
        (("a", "Jane Doe", "jane doe"), ("b", "Omar Quill", "omar quill"), 0, 0.35),
    ],
)
def test_scores(spark, left, right, least, most):
    score = features(spark, profile(*left), profile(*right)).first().score
    assert least <= score <= most


def test_nulls_make_features_not_errors(spark):
    blank = ("b", None, None, None, None, None, None, None, None)
    row = features(spark, profile("a", "Tim", "tim"), blank).first()
    assert row.token_jaccard == 0.0 and row.shared_podcast_count == 0.0


def test_blocking(spark):
    keys = spark.createDataFrame([("tim andrews here",), ("123",), ("",)], "n string").select(E.blocking_keys(F.col("n")))
    first, digits, empty = (set(r[0]) for r in keys.collect())
    assert "clean-first-two:tim:andrews" in first and len(first) == 7
    assert digits == empty == set()
    rows = [profile(str(i), "x", n) for i, n in enumerate(["tim andrews", "andrews tim", "tim andrews here", "jo caiaccio", "jo caiacio"])]
    pairs = E.candidate_pairs(spark.createDataFrame(rows, SCHEMA))
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == {("0", "1"), ("0", "2"), ("3", "4")}


def test_merges_and_aliases(spark):
    canonical = spark.createDataFrame(
        [("a", "Ann", 5), ("b", "Anna", 5), ("c", "An", 1), ("d", None, None)], "am_entity_id string, display_name string, observation_count int"
    )
    pairs = spark.createDataFrame([("a", "b", 0.9), ("c", "a", 0.8), ("d", "c", 0.7), ("c", "c", 0.9)], "left_id string, right_id string, p double")
    targets = E.merge_targets(pairs, canonical)
    assert {(r.target_id, r.source_id) for r in targets.collect()} == {("b", "a"), ("a", "c"), ("c", "d")}
    merged = {r.source_id: r.target_id for r in E.apply_merges(targets, "p").collect()}
    assert merged == {"a": "b", "c": "b", "d": "b"}
    rules = spark.createDataFrame(E.KNOWN_ALIASES, "alias string, target string, podcast string")
    names = spark.createDataFrame([("neil tyson", "StarTalk Radio"), ("neil tyson", "Other"), ("dr drew", "Any")], "name string, podcast string")
    assert [r.resolved for r in E.apply_alias_rules(names, rules).orderBy("podcast").collect()] == ["dr drew pinsky", "neil tyson", "neil degrasse tyson"]


def test_training(spark):
    rows = [(i, float(i > 9), float(i > 9) + (i % 3) / 10) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, label double, x double")
    model = E.train(df.withColumn("y", F.lit(None).cast("double")), "label", ["x", "y"])
    scored = model.transform(df.withColumn("y", F.lit(0.0))).select("label", F.col("probability").cast("string").alias("p"), "prediction").collect()
    assert all(r.label == r.prediction for r in scored)
    with pytest.raises(ValueError, match="ten labels"):
        E.train(df.limit(5).withColumn("y", F.lit(0.0)), "label", ["x", "y"])


def test_canonicals(spark):
    rows = [("tim a", "Tim A", "guest", 1), ("tim a", "Tim A", "host", 5), ("tim a", "TIM A", "guest", None)]
    row = E.canonicals(spark.createDataFrame(rows, "normalized_name string, observed_name string, role string, seen_at long")).first()
    assert (row.display_name, row.aliases, row.roles, row.observation_count) == ("Tim A", ["TIM A", "Tim A"], ["guest", "host"], 3)
