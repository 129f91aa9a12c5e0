from pyspark.sql import functions as F

from castweave.functions import similarity, text


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v"))).first()[0]


def test_normalisers(spark):
    assert one(spark, " José  Andrés! ", text.normalize_graph) == "jose andres"
    assert one(spark, "Renée & Co", text.normalize_graph) == "renee and co"
    assert one(spark, "José", text.normalize_extraction) == "jos"
    assert one(spark, None, text.normalize_graph) is None
    assert one(spark, "", text.normalize_extraction) == ""


def test_display_names(spark):
    cases = {
        "Tim Andrews Here": "Tim Andrews",
        "Tim AndrewsHere": "Tim Andrews",
        "EnglishNick67": "English Nick",
        "@EnglishNick67": "English Nick",
        "John Here": "John Here",
        "SHAQUILLE O'NEAL": "Shaquille O'Neal",
        "autopritts": "Auto Pritts",
    }
    for raw, wanted in cases.items():
        assert one(spark, raw, text.clean_display_name) == wanted


def test_tokens(spark):
    assert one(spark, "dr zach bush", text.clean_tokens) == ["zach", "bush"]
    assert one(spark, "zach bush md", text.clean_tokens) == ["zach", "bush"]
    stripped = lambda c: text.nickname_stripped(c, c)
    assert one(spark, 'Michael "Killer Mike" Render', stripped) == ["michael", "render"]
    alias = spark.createDataFrame([(["nick", "englishnick"],)], "a array<string>").select(text.alias_stripped(F.col("a")))
    assert alias.first()[0] == ["nick", "english"]


def test_flags_and_bounds(spark):
    assert [one(spark, v, text.explicit_flag) for v in ("Yes", "clean", "maybe")] == [True, False, None]
    assert one(spark, "x" * 1200, lambda c: F.length(text.bounded_text(c, 1000))) == 1000
    assert one(spark, "a b c d e", lambda c: text.truncate_words(c, 4)) == "a b..."
    assert one(spark, "中文 show", text.is_english_name) is False
    assert one(spark, "en_US", text.is_english_code) is True


def test_similarities():
    assert similarity.osa_distance("caiaccio", "caiacio") == 1
    assert similarity.osa_distance("caiaccio", "caiaicio") <= 2
    assert similarity.osa_distance("ca", "abc") == 3
    assert similarity.match_score("rogan joe", "joe rogan") == 1
    assert similarity.osa_similarity("", "") == 1.0 and similarity.osa_similarity("a", "") == 0.0
    assert similarity.sequence_ratio("tide", "diet") == 0.25 and similarity.sequence_ratio("diet", "tide") == 0.5


def test_small_functions(spark):
    from castweave.functions import params

    distance = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(text.ngram_distance(F.col("a"), F.col("b"))).first()[0]
    assert distance("abcd", "abcd") == 0 and distance("ab", "abc") == 1 and distance("", "") == 0
    assert [one(spark, v, text.is_resolved_name) for v in ("Ann Lee", "Ann", "Unknown Guest", "Ann (host) Lee", None)] == [True, False, False, False, None]
    assert one(spark, "['a', 'b']", text.loose_list) == ["a", "b"]
    assert [one(spark, v, text.loose_boolean) for v in ("TRUE", "0", "")] == [True, False, None]
    assert params.int_list(["1,2", "x", None, "2"]) == [1, 2] and params.text_list([" a,b ", "a"]) == ["a", "b"]
    assert str(params.iso_date("2024-02-29")) == "2024-02-29" and params.iso_date("2024-02-30") is None and params.iso_date(None) is None
