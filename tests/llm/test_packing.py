import os
import random

import pytest

from castweave.llm import packing


def run(spark, sizes, capacity):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc long, n long")
    return packing.pack(df, "doc", "n", capacity).toPandas()


def check(out, sizes, capacity):
    assert out.groupby("container_id").n_tokens.sum().max() <= capacity
    assert out.groupby("doc").n_tokens.sum().to_dict() == {i: s or 0 for i, s in enumerate(sizes)}
    for i, s in enumerate(sizes):
        assert (out.doc == i).sum() == max(1, -(-(s or 0) // capacity))


def test_whole_and_full(spark):
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 7, 50, 99, 100, 101, 250, rng.randrange(1, 100)]) for _ in range(3000)] + [None]
    out = run(spark, sizes, 100)
    check(out, sizes, 100)
    used = sum(max(s or 0, 1) for s in sizes)
    assert out.container_id.nunique() <= used / 100 * 1.02 + 1


def test_hot_size(spark):
    sizes = [37] * 2000 + [26] * 1000
    out = run(spark, sizes, 100)
    check(out, sizes, 100)
    assert out.container_id.nunique() == 1000


def test_ranges_match_like_one_sweep(spark, monkeypatch):
    """Brackets closed over many ranges are those one stack closes, whatever the ranges."""
    rng = random.Random(4)
    sizes = [rng.randrange(1, 60) for _ in range(300)]
    gaps = [rng.randrange(1, 60) for _ in range(250)]
    docs = spark.createDataFrame([(str(i), 0, s, s) for i, s in enumerate(sizes)], "key string, part int, n_tokens long, value long")
    slots = spark.createDataFrame(list(enumerate(gaps)), "cid long, value long")
    monkeypatch.setattr(packing, "RANGE_ROWS", 60)
    pairs, left = packing.sweep_round(spark, docs, slots, 550)
    pairs, left = pairs.collect(), left.collect()
    events = sorted([(s, 0) for s in sizes] + [(g, 1) for g in gaps])
    stack, want = [], []
    for value, is_gap in events:
        if not is_gap:
            stack.append(value)
        elif stack:
            want.append((value, stack.pop()))
    assert sorted((gaps[p.cid], p.value) for p in pairs) == sorted(want)
    assert sorted(d.value for d in left) == sorted(stack)
    assert len({p.key for p in pairs} | {d.key for d in left}) == len(sizes) and len({p.cid for p in pairs}) == len(pairs)


def test_between_ranges():
    intervals, rest = packing.between_ranges({0: (2, 3), 1: (1, 1), 3: (4, 0), 4: (0, 2)})
    assert intervals == [(1, 0, 1, 0, 2), (3, 0, 1, 1, 0), (3, 1, 3, 0, 1)]
    assert rest == {4: 2}


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None, 5)] * 7 + [(3, 5)] * 7 + [(3, 25)], "doc long, n long")
    out = packing.pack(df, "doc", "n", 10).toPandas()
    assert out.groupby("container_id").n_tokens.sum().max() <= 10
    assert len(out) == 17 and out.container_id.nunique() == 10 and out.doc.isna().sum() == 7


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer file")
def test_fill_of_the_test_documents(spark, sf_dir):
    """Within 1% of the least number of containers that the tokens allow."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = packing.pack_documents(docs).toPandas()
    assert out.groupby("container_id").n_tokens.sum().max() <= packing.CAPACITY
    assert out.container_id.nunique() <= -(-out.n_tokens.clip(lower=1).sum() // packing.CAPACITY) * 1.01 + 1
    assert out.groupby("doc_id").part.count().shape[0] == docs.count()


def test_empty(spark):
    df = spark.createDataFrame([], "doc long, n long")
    assert packing.pack(df, "doc", "n", 10).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer file")
def test_documents(spark):
    rows = [(1, "hello world", "x", 3), (2, None, "x", 3), (None, "", "x", 3), (3, "word " * 5000, "x", 3), (3, "again", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, _size int")
    out = packing.pack_documents(df, capacity=512).toPandas()
    assert out.groupby("container_id").n_tokens.sum().max() <= 512
    assert len(out[out.doc_id == 3]) >= 10 and out.doc_id.isna().sum() == 1
