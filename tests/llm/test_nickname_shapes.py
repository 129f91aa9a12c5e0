import random

from castweave.llm import names
from pyspark.sql import functions as F


def groups_of(spark, typed):
    df = spark.createDataFrame([("p", str(i), n) for i, n in enumerate(typed)], "kind string, key string, name string")
    groups = {}
    for r in names.link_names(df).collect():
        groups.setdefault(r.group_id, set()).add(typed[int(r.key)])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_common_surname(spark):
    """A nickname is found however many names share the surname; one that fits two of them belongs to neither."""
    given = ["Omar", "Fiona", "Hiroshi", "Bjarne", "Quentin", "Wanjiru", "Xiomara", "Yevgeni", "Zbigniew", "Kasimir", "Ludmilla", "Eskil"]
    typed = [f"{g} Trevandor" for g in given] + ["Guadalupe Trevandor", "Lupe Trevandor", "Hermione Trevandor", "Hermengild Trevandor", "Hermie Trevandor"]
    assert groups_of(spark, typed) == {frozenset(("Guadalupe Trevandor", "Lupe Trevandor"))}


def test_same_links_as_all_pairs(spark):
    rng = random.Random(11)
    tokens = {"".join(rng.choice("abio") for _ in range(rng.randrange(2, 9))) for _ in range(160)} | {"robbie", "roberta", "x" * 90, "x" * 80 + "y"}
    tokens = sorted(tokens | {t[2:] for t in tokens if len(t) > 6} | {t[:4] + t[3] + "ie" for t in tokens if len(t) > 6})
    rows = [("k", f"{t} {rest}", t, rest) for t in tokens for rest in (1, 2) if rest == 1 or len(t) % 2]
    parts = spark.createDataFrame(rows, "kind string, core string, token string, rest long").where(F.col("token") != "").localCheckpoint()
    want = {(a, b) for _, a, t, r in rows for _, b, o, q in rows if r == q and len(t) >= 3 and len(o) > len(t) and names.nickname_shaped(t, o)}
    got = {(r.a, r.b) for r in names.shape_links(parts).collect()}
    assert got == want and len(want) > 100
