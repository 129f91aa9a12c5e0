import random

from castweave.llm.contract import connected_groups, found_groups


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {(x, find(x)) for x in list(parent)}


def check(spark, pairs, kind="string"):
    df = spark.createDataFrame(pairs, f"l {kind}, r {kind}")
    assert {tuple(x) for x in connected_groups(df, "l", "r").collect()} == brute(pairs)


def test_random_graphs(spark):
    rng = random.Random(3)
    check(spark, [(str(rng.randrange(90)), str(rng.randrange(90))) for _ in range(70)])


def test_chain_star_nulls_repeats(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(120)]
    star = [("hub", f"leaf{i}") for i in range(200)]
    check(spark, chain + star + star + [("x", "x"), (None, "y"), ("z", None), ("b", "a"), ("a", "b")])


def test_numbers(spark):
    check(spark, [(10, 9), (9, 100), (5, 6)], "long")


def test_empty(spark):
    assert connected_groups(spark.createDataFrame([], "l string, r string"), "l", "r").count() == 0


def test_found_uses_accepted_only_and_ignores_clashing_columns(spark):
    schema = "left_id string, right_id string, status string, member string, u string, hook string"
    rows = [("a", "b", "accepted", "m", "u", "h"), ("b", "c", "rejected", None, None, None), ("c", "d", None, "", "", "")]
    got = {tuple(r) for r in found_groups(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "a"), ("b", "a")}


def test_estimated_sizes_do_not_grow_with_the_rounds(spark):
    pairs = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(200)], "l string, r string")
    size = connected_groups(pairs, "l", "r")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size < 1 << 200
