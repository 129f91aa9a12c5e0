from castweave.llm import contexts, pii


def test_every_document_counts(spark):
    """Surroundings that five of 6,000 documents have are learned, and words are counted over all of them."""
    texts = ["It rained on the old mill again."] * 5_995 + ["Our partner Omar Hoffmann live."] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit_names(df, "doc_id", "text")
    assert model.both["partner live"] > 0
    text = "Our partner Zofia Nowak live."
    assert [text[a:b] for a, b, kind in pii.find_pii(text, model) if kind == "name"] == ["Zofia Nowak"]
    more = spark.createDataFrame([(9_000, text), (9_001, "The market is open.")], "doc_id long, text string")
    got = {tuple(r) for r in pii.find_in(df.unionByName(more), "doc_id", "text").where("doc_id >= 9000").collect()}
    assert got == {(9_000, "name", "Zofia Nowak")}
    out = {r.doc_id: r.redacted_text for r in pii.redact_in(df.unionByName(more), "doc_id", "text", "k").where("doc_id >= 9000").collect()}
    assert out[9_000].startswith("Our partner [NAME:") and out[9_001] == "The market is open."


def test_counts_are_handed_out_whole(spark, monkeypatch):
    """Many small hand-outs add up to the same model as one."""
    texts = [f"Our partner Omar Hoffmann{'abcde'[i % 5]} live, word{'xyz'[i % 3]} and so on." for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = pii.fit_names(df, "doc_id", "text")
    monkeypatch.setattr(pii, "TALLIED", 1)
    assert pii.fit_names(df, "doc_id", "text") == want


def test_words_in_lower_case():
    tally = contexts.Tally()
    tally.add("so the Old mill, mill x@mail.com and v.two said.ok end. Über über a 3rd well-known it's", [])
    words = {v for (kind, _, v), _ in tally.seen.items() if kind == "word"}
    assert words == {"so", "the", "mill", "and", "said", "end", "über", "well", "known", "it"}
