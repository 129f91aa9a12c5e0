import random

from castweave.llm import leakage

RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(3)) for _ in range(600)]


def words(n, rng):
    return [rng.choice(VOCAB) for _ in range(n)]


ITEM = words(90, random.Random(1))
OTHER = words(80, random.Random(2))


def leaks(spark, docs, items=None):
    docs = spark.createDataFrame([(i, d, "clash", 1) for i, d in enumerate(docs)], "doc_id long, text string, item_id string, words int")
    items = spark.createDataFrame(items or [(1, " ".join(ITEM)), (2, " ".join(OTHER))], "item_id long, text string")
    out = leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text")
    return {(r.doc_id, r.item_id) for r in out.collect()}


def noise(n=60, seed=0):
    return " ".join(words(n, random.Random(seed + 100)))


def test_full_partial_and_altered(spark):
    part = ITEM[30:55]
    edited = [w if i % 8 else "changed" for i, w in enumerate(ITEM[5:70])]
    hidden = " ".join(w[:2] + "­" + w[2:] for w in part)
    inserted = " ".join(ITEM[10:25]) + " [an unrelated remark in between] " + " ".join(ITEM[25:40])
    docs = [
        noise() + " " + " ".join(ITEM) + " " + noise(seed=1),
        noise() + " " + " ".join(part) + " " + noise(seed=2),
        " ".join(edited),
        noise() + " " + hidden.upper(),
        inserted,
        "<p>" + ", ".join(part) + ".</p>",
        " ".join(ITEM[:12]) + " " + noise(),  # too short a quotation
        noise(200),
        None,
        "",
        " ".join(OTHER[20:45]) + " x " + " ".join(ITEM[20:45]),
        " ".join(ITEM) + " " + noise(30_000, seed=5),
    ]
    assert leaks(spark, docs) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (10, 1), (10, 2), (11, 1)}


def test_shared_frame_is_no_leak(spark):
    frame = "the {} of {} kept a {} under the {} and a list of {} on the wall of {} until the {} asked for {} in return"
    fill = lambda seed: frame.format(*words(8, random.Random(seed)))
    items = [(i, " ".join(fill(10 * i + k) for k in range(4))) for i in range(1, 4)]
    assert leaks(spark, [" ".join(fill(500 + k) for k in range(6))], items) == set()


def test_brute_force_agreement(spark):
    """Windows of 20 to 40 words are all found, windows of at most 12 are not."""
    rng = random.Random(11)
    docs, want = [], set()
    for i in range(60):
        n = rng.choice([8, 12, 20, 24, 40])
        a = rng.randrange(0, 90 - n)
        docs.append(noise(40, i) + " " + " ".join(ITEM[a : a + n]) + " " + noise(40, i + 1000))
        if n >= 20:
            want.add((i, 1))
    assert leaks(spark, docs) == want


def test_empty_tables_and_a_small_map(spark, monkeypatch):
    assert leaks(spark, [" ".join(ITEM)], [(1, None)]) == set()
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")
    assert leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text").count() == 0
    monkeypatch.setattr(leakage, "MAP_BITS", 6)  # foreign terms pass and are left out by the joins
    assert leaks(spark, [" ".join(ITEM), " ".join(OTHER)]) == {(0, 1), (1, 2)}
    monkeypatch.setattr(leakage, "SEND_ROWS", 1)  # more items than are sent: the postings are exchanged by term
    assert leaks(spark, [" ".join(ITEM), noise(), " ".join(OTHER)]) == {(0, 1), (2, 2)}


def test_short_edited_and_parted_passages(spark):
    """Short passages with changed words, and two halves around a long insertion."""
    edit = lambda a, n, *at: " ".join("changed" if k in at else w for k, w in enumerate(ITEM[a : a + n]))
    docs = [noise(40, i) + " " + x + " " + noise(40, i + 50) for i, x in enumerate((
        edit(10, 20, 10), edit(30, 22, 11), edit(20, 26, 8, 17), edit(50, 30, 7, 15, 22), edit(10, 18, 9),
        edit(10, 12) + " " + noise(61, 90) + " " + edit(22, 12), edit(10, 12) + " " + noise(900, 91) + " " + edit(22, 12),
        edit(10, 9) + " " + noise(61, 92) + " " + edit(19, 9),
        edit(10, 11) + " " + noise(80, 93) + " " + edit(21, 11), edit(10, 15) + " " + noise(80, 94) + " " + edit(25, 15),
        edit(40, 24, 4, 9, 14, 19), edit(40, 28, 4, 9, 14, 19, 24), " ".join(w + (" added" if k % 3 == 2 else "") for k, w in enumerate(ITEM)),
        edit(0, 90, *range(4, 90, 5)),
    ))]
    assert leaks(spark, docs) == {(i, 1) for i in (0, 1, 2, 3, 5, 6, 8, 9, 10, 11, 12, 13)}


def test_terms_hold_in_texts_of_any_batch():
    """A term's hash and place depend on its words alone, and no term spans two texts."""
    texts = [["a", "b", "c", "d"], [], ["x"], ["b", "c", "d"], ["a", "b"]]
    term, owner, place = leakage.term_hashes(texts)
    alone = [leakage.term_hashes([t])[0].tolist() for t in texts]
    assert [term[owner == i].tolist() for i in range(5)] == alone
    assert place.tolist() == [0, 1, 0] and alone[0][1] == alone[3][0]


def test_repeated_rows_and_texts(spark):
    df = spark.createDataFrame([(1, " ".join(ITEM)), (1, " ".join(ITEM)), (1, " ".join(OTHER)), (None, " ".join(ITEM))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(ITEM)), (7, " ".join(OTHER)), (8, " ".join(ITEM)), (None, " ".join(ITEM))], "item_id long, text string")
    got = sorted(tuple(r)[:2] for r in leakage.find_leaks(df, "doc_id", "text", items, "item_id", "text").collect())
    assert got == [(1, 7), (1, 8)]
