import datetime as dt
import random

import pytest

from castweave.llm import pii


def found(text):
    return {(kind, text[a:b]) for a, b, kind in pii.find_pii(text)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("With Margaret Voshizol-Pebruwen and Thaddeus H. Hethodoton we look back", {("name", "Margaret Voshizol-Pebruwen"), ("name", "Thaddeus H. Hethodoton")}),
        ("Special thanks to Dr. Elizabeth Gorodorf for the photographs", {("name", "Elizabeth Gorodorf")}),
        ("Editing by Raymond von Brothevik, music by S. Lekulin.", {("name", "Raymond von Brothevik"), ("name", "S. Lekulin")}),
        ("Avec Codretrelock, Frederick, nous parlons", {("name", "Codretrelock, Frederick")}),
        ("music by OMAR FELOTHULUND.", {("name", "OMAR FELOTHULUND")}),
        ("with penelope kufenukin and isabella netrik we look back", {("name", "penelope kufenukin"), ("name", "isabella netrik")}),
        ("So says Alexander. Back at The Lucky Show", set()),
        ("So says Kofi. The town of Oskfell", set()),
        ("Write to margaret619 (at) workshop (dot) example (dot) org now", {("email", "margaret619 (at) workshop (dot) example (dot) org")}),
        ("✉ hello[at]bakery-ledger[dot]example – short; <a.b+c@x-y.example.com>.", {("email", "hello[at]bakery-ledger[dot]example"), ("email", "a.b+c@x-y.example.com")}),
        ("Call (573) 555-0188 after six, or +44 20 7946 0432.", {("phone", "(573) 555-0188"), ("phone", "+44 20 7946 0432")}),
        ("Rufen Sie +49 (0)30 23125 417 nach sechs an.", {("phone", "+49 (0)30 23125 417")}),
        ("☎ 01 99 00 84 52 Our", {("phone", "01 99 00 84 52")}),
        ("text 18405550131 now", {("phone", "18405550131")}),
        ("Order 8577-751 shipped. Catalogue no. 60-56124 is out. Build 2.54.547 of 2460/72, ref=52736.", set()),
        ("Please check SSN 906-12-4188 before; passport X05540689 and DNI 00714452-W.", {("id_number", "906-12-4188"), ("id_number", "X05540689"), ("id_number", "00714452-W")}),
        ("my social is 968 12 3333; (Ausweisnummer: L0X57K346) NI number QQ 36 14 75 B", {("id_number", "968 12 3333"), ("id_number", "L0X57K346"), ("id_number", "QQ 36 14 75 B")}),
        ("Send the tapes to 1746 Brackwater St., Apt 32A, Fenwick 00820.", {("address", "1746 Brackwater St., Apt 32A, Fenwick 00820")}),
        ("at Flat 6, 1041 Wrenfield House, Lunmere QX6 5ZZ and never left", {("address", "Flat 6, 1041 Wrenfield House, Lunmere QX6 5ZZ")}),
        ("outside 63 rue du Foundry, 00934 Fenbeck in the rain", {("address", "63 rue du Foundry, 00934 Fenbeck")}),
        ("in Tannerystraße 209, 00952 Silwick. P.O. Box 1755, Corvwick.", {("address", "Tannerystraße 209, 00952 Silwick"), ("address", "P.O. Box 1755, Corvwick")}),
        ("", set()),
        (None, set()),
    ],
)
def test_kinds(text, want):
    assert found(text) == want


def test_feistel_is_a_permutation_that_can_be_undone():
    seen = {pii.feistel(v, 10, 26, "k", "t") for v in range(260)}
    assert seen == set(range(260))
    assert all(pii.feistel(pii.feistel(v, 10, 26, "k", "t"), 10, 26, "k", "t", undo=True) == v for v in range(260))


def test_formats_survive():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("0123456789ABCxyz -().") for _ in range(rng.randrange(1, 18)))
        out = pii.permute_format(text, "key", "phone")
        assert len(out) == len(text)
        for a, b in zip(text, out, strict=True):
            assert (a.isdigit(), a.isupper(), a.islower()) == (b.isdigit(), b.isupper(), b.islower())
        assert pii.permute_format(out, "key", "phone", undo=True) == text
    assert pii.permute_format("555-0188-99", "a", "p") != pii.permute_format("555-0188-99", "b", "p")


def test_dates_stay_dates():
    for day in ("1990-02-28", "2099-12-31", "1900-01-01"):
        out = pii.permute_date(day, "key")
        dt.date.fromisoformat(out)
        assert pii.permute_date(out, "key", undo=True) == day
    assert pii.permute_date("not a date", "key") == "not a date"


def test_redaction_links_and_reads_on():
    a, n = pii.redact("Call +1-490-555-0170 or write to Nadia Bukezorad.", "k")
    b, _ = pii.redact("nadia bukezorad again: +1-490-555-0170", "k")
    assert n == 2 and "0170" not in a and "Bukezorad" not in a and a.startswith("Call [PHONE:+1-")
    tag = a[a.index("[NAME") : a.index("]", a.index("[NAME")) + 1]
    assert tag in b and a[5 : a.index("]") + 1] in b
    assert pii.redact(None, "k") == (None, 0) and pii.redact("plain text", "k") == ("plain text", 0)


def test_numbers_stay_linked_however_they_are_written():
    place = lambda kind, text: pii.placeholder(kind, text, "k")
    digits = lambda text: "".join(c for c in text if c.isdigit())
    assert digits(place("phone", "(415) 223-4567")) == digits(place("phone", "415-223-4567")) == digits(place("phone", "+1 415.223.4567"))[1:]
    assert digits(place("phone", "+44 (0)20 7946 0432"))[3:] == digits(place("phone", "020 7946 0432"))[1:] == digits(place("phone", "+442079460432"))[2:]
    assert place("id_number", "00714452-w")[-2] == place("id_number", "00714452W")[-2]
    assert len(place("name", "Paolo Vibrunor")) == len("[NAME:]") + 32


def test_numbers_are_validated():
    assert pii.valid_card("4111 1111 1111 1111") and not pii.valid_card("4111 1111 1111 1112")
    assert pii.valid_iban("DE89 3704 0044 0532 0130 00") and not pii.valid_iban("DE88370400440532013000")
    assert pii.valid_dni("12345678Z") and not pii.valid_dni("12345678A")
    assert found("card 4111-1111-1111-1111, account DE89370400440532013000 today") == {("id_number", "4111-1111-1111-1111"), ("id_number", "DE89370400440532013000")}
    assert found("codes 000-00-0000, 666-12-3456 and 12345678A, order 4111111111111112") == set()
    assert found("DNI 12345678A") == {("id_number", "12345678A")}


def test_no_part_of_a_mailbox_is_left():
    local = "a" * 90
    assert found(f"write to {local}@example.org now") == {("email", f"{local}@example.org")}


def test_names_outside_the_lists(spark):
    """Names whose given name no list has are found by where they stand: nine of ten, and no titles of shows."""
    rng = random.Random(6)
    frames = [
        "With {} we look back at the old mill.", "So says {} about the canal.", "Music by {}, as always.", "This week {} tells us how it began.",
        "We called {} again. Nobody answered.", "Ein Gespräch mit {} über Züge.", "Avec {} nous parlons de la mer.",
    ]
    listed = ["Omar", "Paolo", "Thomas", "Nadia", "Julia", "Hannah", "Claire", "Ingrid"]
    surnames = ["Hoffmann", "Papadopoulos", "Zhang", "Okafor", "Lindqvist", "Moreau", "Tanaka", "Nowak", "Haddad", "Silva"]
    shows = ["Back at The Silver Kettle we waited.", "The crew of The Hidden Ladder cancelled.", "Am Ende bleibt ein Heft.", "Market Radio plays tonight.", "In Berlin Mitte it rained."]
    texts = []
    for _ in range(400):
        parts = [rng.choice(frames).format(f"{rng.choice(listed)} {rng.choice(surnames)}") for _ in range(3)] + rng.sample(shows, 2)
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit_names(df, "doc_id", "text")
    others = ["Gertrude Hoffmann", "Dimitri Papadopoulos", "Wei Zhang", "Aisha Okafor", "Sven Lindqvist", "Chloé Moreau", "Kenji Tanaka", "Zofia Nowak", "Layla Haddad", "Thiago Silva"]
    hit = total = 0
    for frame in frames:
        for name in others:
            got = {text[a:b] for text in [" ".join((shows[0], frame.format(name), shows[3]))] for a, b, kind in pii.find_pii(text, model) if kind == "name"}
            hit, total = hit + (name in got), total + 1
            assert got <= {name}
    assert hit >= 0.9 * total


def test_frames(spark):
    schema = "doc_id long, text string, kind string, pii_text string, redacted_text string"
    rows = [(1, "Paolo Vibrunor and Paolo Vibrunor", "k", "p", "r"), (None, "Omar Vibrunor", "", "", ""), (2, None, None, None, None), (3, "", "", "", "")]
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in pii.find_in(df, "doc_id", "text").collect()] == [(1, "name", "Paolo Vibrunor")]
    out = pii.redact_in(df, "doc_id", "text", "k").collect()
    assert len(out) == 4 and {r.doc_id: r.replaced for r in out} == {1: 2, None: 1, 2: 0, 3: 0}
    assert pii.find_in(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        pii.redact_in(df, "doc_id", "text", "")


def test_very_long_text():
    text = "Call 555-010-0199 now. With Paolo Vibrunor we talk. " * 20_000
    assert len(pii.find_pii(text)) == 40_000
