"""Where personal names stand in a corpus, learned from the names that are sure.

Runs of capitalised words are told apart by what stands before and after them: over all
documents, runs that hold a sure name (title, initial, known given name) count for their
surroundings, all other runs against them. A run of two or three words in surroundings that
belong to names is then taken for a name whatever its words are, unless one of them is an
ordinary word of the corpus or the run has an article, as titles of shows have.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castweave.runtime import cut, ship

#: Least probability of a name, and how often surroundings must have been seen.
LEAST, SEEN = 0.5, 5
#: In how many documents, and in which share of them, a word must stand in lower case to be an ordinary one.
ORDINARY, ORDINARY_SHARE = 3, 0.0015

_UP, _LO = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪİĶĹĽŁŃŇŌŐŒŘŚŞŠŢŤŪŮŰŹŻŽ", "a-zß-öø-ÿāăąćčďđēęěğģīıķĺľłńňōőœřśşšţťūůűźżž"
_CAP = rf"(?:[OD]['’]|Mc|Mac)?[{_UP}][{_LO}]+(?:-[{_UP}][{_LO}]+)*"
# The same where its first letter has been read: a pattern is searched faster if it begins with a set of characters.
_CAP_REST = rf"(?:(?:(?<=[OD])['’]|(?<=M)a?c)[{_UP}])?[{_LO}]+(?:-[{_UP}][{_LO}]+)*"
_GAP = r"(?:[  ]{1,2}|\n(?!\n))"
_PART = r"(?:von der|van der|van den|de la|von|van|del|della|de|da|di|du|dos|al|el|bin|ibn|ter|den)"
#: A run of capitalised words, with initials and particles inside.
RUN = re.compile(rf"[{_UP}](?<![\w@.+'’-].){_CAP_REST}(?:{_GAP}(?:[{_UP}]\.{_GAP})?(?:{_PART}{_GAP})?{_CAP})+(?![\w@'’])")
_LAST_WORD = re.compile(r"(\w+['’]?|[^\w\s])\s*$")
_NEXT_WORD = re.compile(r"[  \n]*(\w+|[^\w\s])")
_TOKEN = re.compile(r"[\w@.]+")
#: For bytes of UTF-8: ASCII that no token holds to blanks; other characters are told apart by ``_TOKEN``.
_BLANKS = bytes(b if b > 127 or _TOKEN.match(chr(b)) else 32 for b in range(256))
_LOWER = re.compile(rf"[{_LO}]{{2,}}(?!\w)")
# Articles that make a run of capitalised words a title.
ARTICLES = frozenset("the a an die der das ein eine el la los las le les un une".split())
# Pronouns and forms of address that are written with a capital.
PRONOUNS = frozenset("i sie ihr ihnen wir ich er es usted ustedes vous nous señor señora herr frau madame monsieur sir madam".split())


class Contexts(NamedTuple):
    """Log-odds of a name by what stands before and after, by both together, and the ordinary words."""

    prior: float
    before: dict[str, float]
    after: dict[str, float]
    both: dict[str, float]
    ordinary: frozenset[str]

    def odds(self, before: str, after: str) -> float:
        pair = self.both.get(f"{before} {after}")
        if pair is not None:
            return pair
        return self.prior + self.before.get(before, 0.0) + self.after.get(after, 0.0)


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """The word or sign before and after a span, in lower case; ``^`` and ``$`` at the ends and at blank lines."""
    head, tail = text[max(0, start - 30) : start], _NEXT_WORD.match(text, end)
    before = None if head.endswith("\n\n") else _LAST_WORD.search(head)
    return before[1].lower() if before else "^", tail[1].lower() if tail else "$"


def runs(text: str, stop: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Spans of two or three capitalised words that could be a name: no article before, no word of ``stop`` in it."""
    for m in RUN.finditer(text):
        words = list(re.finditer(rf"(?<![\w'’-]){_CAP}", m[0]))
        first = 0
        while first < len(words) and words[first][0].lower() in stop:
            if words[first][0].lower() in ARTICLES:
                first = len(words)
            first += 1
        kept = words[first:]
        if 1 < len(kept) < 4 and not any(w[0].lower() in stop or w[0].lower() in PRONOUNS for w in kept):
            yield m.start() + kept[0].start(), m.start() + kept[-1].end()


def placed(text: str, spans: list[tuple[int, int, str]], stop: frozenset[str]) -> Iterator[tuple[int, int, str, str, bool, bool]]:
    """``start, end, before, after, sure, free`` of every run: whether it holds a sure name, and whether it touches no span."""
    used, sure = bytearray(len(text)), bytearray(len(text))
    for a, b, kind in spans:
        used[a:b] = b"\x01" * (b - a)
        if kind == "name":
            sure[a:b] = used[a:b]
    for a, b in runs(text, stop):
        yield a, b, *surroundings(text, a, b), sure.find(1, a, b) >= 0, used.find(1, a, b) < 0


@lru_cache(65536)
def _lower_heads(part: bytes) -> tuple[str, ...]:
    """The lower-case words that tokens begin with, unless they go on as part of another; a part is a token but for signs beyond ASCII."""
    heads = map(_LOWER.match, _TOKEN.findall(part.decode("utf-8", "surrogatepass")))
    return tuple(h[0] for h in heads if h)


class Tally:
    """Counts of one task, handed out whenever there are many, so that they stay bounded whatever the task reads."""

    def __init__(self) -> None:
        self.spans: Counter = Counter()
        self.words: Counter = Counter()

    def __len__(self) -> int:
        return len(self.spans) + len(self.words)

    def add(self, text: str, found: list[tuple[int, int, str, str, bool, bool]]) -> None:
        for a, b, before, after, sure, free in found:
            kind = "name" if sure else "other"
            self.spans.update(((kind, "all", ""), (kind, "before", before), (kind, "after", after), (kind, "both", f"{before} {after}")))
            if free:
                self.spans.update(("run", "", w.lower()) for w in text[a:b].split())
        parts = set(text.encode("utf-8", "surrogatepass").translate(_BLANKS).split())
        self.words.update(set().union(*map(_lower_heads, parts)))
        self.spans["docs", "", ""] += 1

    @property
    def seen(self) -> dict[tuple[str, str, str], int]:
        return {**self.spans, **{("word", "", w): n for w, n in self.words.items()}}

    def rows(self) -> list[tuple[str, str, str, int]]:
        out = [(*k, n) for k, n in self.seen.items()]
        self.spans.clear()
        self.words.clear()
        return out


def fit(counts: DataFrame) -> Contexts:
    """A model from ``kind, part, value, n`` of all documents, as :class:`Tally` gives them.

    What the driver gets are surroundings seen often enough to count, and the ordinary words that some run holds.
    """
    sums = cut(counts.groupBy("kind", "part", "value").agg(F.sum("n").alias("n")))
    docs = sums.where("kind = 'docs'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    asked = sums.where("kind = 'run'").select("value")
    often = sums.where((F.col("kind") == "word") & (F.col("n") >= max(ORDINARY, docs * ORDINARY_SHARE)))
    ordinary = frozenset(r["value"] for r in often.join(asked, "value", "left_semi").select("value").collect())
    names_, others = (F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)) for kind in ("name", "other"))
    known = sums.where(F.col("kind").isin("name", "other")).groupBy("part", "value").agg(names_.alias("names"), others.alias("others"))
    table: dict[str, dict[str, tuple[int, int]]] = {"all": {}, "before": {}, "after": {}, "both": {}}
    for part, value, n, o in known.where((F.col("part") == "all") | (F.col("names") + F.col("others") >= SEEN)).collect():
        table[part][value] = n, o
    n, o = table["all"].get("", (0, 0))
    prior = math.log((n + 1) / (o + 1))
    odds = lambda part: {k: math.log((n + 0.5) / (o + 0.5)) - (0 if part == "both" else prior) for k, (n, o) in table[part].items()}
    return Contexts(prior, odds("before"), odds("after"), odds("both"), ordinary)


def accepts(model: Contexts, run: str, before: str, after: str) -> bool:
    """Whether a run in these surroundings is a name."""
    if any(w.lower() in model.ordinary for w in run.split()):
        return False
    # Surroundings never seen together count only where each side is known.
    known = f"{before} {after}" in model.both or before in model.before and after in model.after
    return known and model.odds(before, after) > math.log(LEAST / (1 - LEAST))


def names_in(text: str, model: Contexts, stop: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Spans of ``text`` that stand where names stand."""
    for a, b in runs(text, stop):
        if accepts(model, text[a:b], *surroundings(text, a, b)):
            yield a, b


ship(__name__)
