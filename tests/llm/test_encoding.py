import pytest

from castweave.llm import encoding

TEXTS = [
    "Un café de Málaga, con niños de fondo",
    "“We didn’t plan it,” says the host – twice…",
    "Größe & Öl über Straßen",
    "Запись сделана ночью в студии",
    "Smörgåsbord from Ålesund, £12 or €15",
    "Wersja pełna, bez cięć, żółć i śmiech",
    "夜の notebook",
    "À propos de l’été",
]


@pytest.mark.parametrize("text", [*TEXTS, "plain", "", "SÃO PAULO", "30° C", "Çay, güneş, şehir", "Сёмга и рёбра", "naïve ÀÉ", "№ 5 – §7"])
def test_correct_text_is_left_alone(text):
    assert encoding.restore(text) == (text, [])


def damage(text, wrong):
    out = bytearray(text.encode("utf-8"))
    return "".join(_decode(bytes([b]), wrong) for b in out)


def _decode(byte, wrong):
    try:
        return byte.decode(wrong)
    except UnicodeDecodeError:
        return chr(byte[0])


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1250"])
@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text, wrong):
    bad = damage(text, wrong)
    restored, labels = encoding.restore(f"Intro: {bad}. The end")
    assert labels
    assert restored == f"Intro: {text}. The end"


def test_twice_partly_and_lost():
    twice = damage(damage("Façade über €5", "cp1252"), "cp1252")
    assert encoding.restore(twice)[0] == "Façade über €5"
    partly = "Gespräch " + damage("über", "cp1252") + " Bücher"
    assert encoding.restore(partly) == ("Gespräch über Bücher", ["utf8>cp1252"])
    assert encoding.restore("The quarry� part") == ("The quarry� part", ["lost"])
    cyrillic = "Ночной эфир".encode("cp1251").decode("cp1252")
    assert encoding.restore(cyrillic + " show")[0] == "Ночной эфир show"


def test_long_text():
    long = "Запись сделана " * 20_000 + damage("ночью", "cp1252")
    restored, labels = encoding.restore(long)
    assert labels and restored.endswith("ночью") and len(restored) == 15 * 20_000 + 5


def test_tables(spark):
    schema = "parse_id long, title string, description string, field string, value string, labels string"
    rows = [(1, "cafÃ©", None, "f", "v", "l"), (2, "", "ok", "", "", ""), (None, None, None, None, None, None), (3, "café", "itâ€™s", "", "", "")]
    podcast = spark.createDataFrame([(1, "Ãœber"), (2, None)], "id long, name string")
    got = encoding.damaged_tables(spark.createDataFrame(rows, schema), podcast).collect()
    assert {(r.source_table, r.record_id, r.field, r.restored) for r in got} == {
        ("parsed_episode", 1, "title", "café"), ("parsed_episode", 3, "description", "it’s"), ("podcast", 1, "name", "Über"),
    }
    empty = encoding.damaged_tables(spark.createDataFrame([], schema), podcast.limit(0))
    assert empty.count() == 0


def test_long_stretches_are_not_torn(monkeypatch):
    """Damage throughout, without a space and over many parts, comes back exactly wherever the parts meet."""
    text = "山の救助について話しました次回もお楽しみに" * 60
    russian = "Сегодня мы говорим о ночных поездах и старых мостах " * 40
    for limit in (50, 51, 52, 97):
        monkeypatch.setattr(encoding, "STRETCH_MAX", limit)
        assert encoding.restore(text.encode().decode("cp437"))[0] == text
        assert encoding.restore(russian.encode("cp1251").decode("cp1252"))[0] == russian
