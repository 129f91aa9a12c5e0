"""What is looked for only where it can stand is found as by a search of the whole text."""

import random
import re

from castweave.llm import contexts, pii

PIECES = [
    "12 Main ſt, Town", "Rıver Road 5, 12", "C/Mayor 5, 28001 Madrid", "x Weg 12, 10115 Berlin", "HAUPTSTRASSE 5, 10115 BERLIN",
    "P.O. Box 12, Town", "〒123-4567 東京", "mary smith", "MARY SMITH", "Łucja Nowak", "anna o'brien", "joe [at] mail dot com",
    "joe AT mail dot com", "a@b.co", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "GB82GB82 1234 1234 1234 1234", "３٤",
    "İ", "ẞ", "Σ", "\n", "\n\n", "'", "-", ".", "_", "“", ",", "it was said that the road to the old mill is long", "McCabe", "O'Dell Mackay",
]
WHOLE_GIVEN = re.compile(rf"(?<![\w@.+'’-])({pii._trie(pii._FORMS)})(?![\w@＠'’­])(?!\.[a-z])")
WHOLE_RUN = re.compile(contexts.RUN.pattern.replace(f"[{contexts._UP}](?<![\\w@.+'’-].){contexts._CAP_REST}", rf"(?<![\w@.+'’-]){contexts._CAP}", 1))


def texts():
    rng = random.Random(8)
    for i in range(1500):
        words = (rng.choice(PIECES) + rng.choice((" ", " ", "", ", ")) for _ in range(rng.randrange(1, 40)))
        text = "".join(words)
        yield text.lower() if i % 3 == 0 else text.upper() if i % 11 == 0 else text


def test_same_as_searches_of_the_whole_text():
    for text in texts():
        lower = text.lower()
        folded = pii._folded(text, lower)
        given = [m for m in WHOLE_GIVEN.finditer(text) if not m[0].islower() or pii._all_lower(text, m.start())]
        assert pii._given(text, lower) == [(*m.span(), m[0]) for m in given]
        numbers = [m.span() for m in pii._RUN.finditer(text)]
        assert [m.span() for m in pii._long_numbers(text, numbers)] == [m.span() for m in pii._LONG_NUMBER.finditer(text)]
        assert [m.span() for m in pii._mail_hints(text, folded)] == [m.span() for m in pii._EMAIL_AT.finditer(text)]
        for a, b in numbers:
            low, high = max(0, a - 60), min(len(text), b + 150)
            assert pii._hinted(text, folded, low, high) == (pii._ADDRESS_HINT.search(text, low, high) is not None)
        assert WHOLE_RUN.pattern != contexts.RUN.pattern
        assert [m.span() for m in contexts.RUN.finditer(text)] == [m.span() for m in WHOLE_RUN.finditer(text)]
        tally = contexts.Tally()
        tally.add(text, [])
        heads = {m[0] for m in map(contexts._LOWER.match, set(contexts._TOKEN.findall(text))) if m}
        assert {w for kind, _, w in tally.seen if kind == "word"} == heads


def test_numbers_do_not_search_their_surroundings_for_addresses(monkeypatch):
    """The search of 210 characters around every number before a comma took a fifth of the whole scan."""
    monkeypatch.setattr(pii, "_ADDRESS_HINT", None)
    text = "In 2019, 300 of 412, then 7, went to 12 Mill Road, Springfield 12345, and 5, 6, 7 stayed."
    assert [text[a:b] for a, b, kind in pii.find_pii(text) if kind == "address"] == ["12 Mill Road, Springfield 12345"]
