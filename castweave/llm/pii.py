"""Personal information in free text: found, typed, and replaced by placeholders.

Detection is by format and lead-in for e-mail addresses, phone numbers, identity numbers, street
addresses and birth dates, and by given names, initials and titles for personal names, in mixed,
all-capital and all-lower text. Names with none of these are found by what stands around them,
learned from the whole corpus (``contexts.py``). Each text is scanned once, in Arrow batches, without a shuffle.

Replacement keeps values linked across documents without revealing them: digits and letters of
numbers are permuted by a keyed Feistel network within their own format (same length, same
punctuation, same kind of character at each place), dates within the calendar, and names,
addresses and e-mail addresses get a keyed tag. Equal values, whatever their case, spacing or
punctuation, get equal characters in every document, and the permutation can be undone with the
key. Numbers with a check digit (cards, bank accounts, Spanish identity numbers) are validated.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castweave.llm import contexts
from castweave.llm.names import NICKNAMES
from castweave.runtime import cut, ship

KINDS = ("name", "email", "phone", "id_number", "address")
ROUNDS = 10

# Given names that anchor a personal name, with usual short forms.
GIVEN = (
    "Abby Abigail Adam Ahmed Alex Alexander Alice Amara Anaïs Andrew Andy Anna Anthony Becky Bella Ben Benjamin Bill "
    "Bob Björn Carla Carlos Carmen Charles Christopher Claire Daniel David Debbie Deborah Declan Diego Dorothy Dot Drew "
    "Edward Elena Elizabeth Emily Emma Ewan Fatima Fiona Fran Francesca Frederick Fred Gabe Gabriel George Greg Gregory "
    "Hannah Hans Harriet Hattie Helen Hiro Inés Ingrid Isabella Jackie Jacqueline James Jane Javier Jennifer Jen John Jo "
    "Jonathan Jon Joseph Josephine José Juan Julia Jürgen Karen Kate Katherine Ken Kenneth Kit Klaus Kofi Larry Laura "
    "Lawrence Leila Len Leonard Liz Lucas Luis Łucja Maeve Margaret María Marie Mark Mary Mateo Matilda Michael Mike "
    "Mohammed Nadia Nancy Nate Nathaniel Ned Nicholas Nick Oliver Ollie Omar Paolo Patricia Paul Peggy Penelope Penny "
    "Pepe Peter Philip Pierre Pip Priya Rachel Ray Raymond Rebecca Renée Richard Robert Sam Samantha Sarah Sofia Søren "
    "Steph Stephanie Sue Susan Susannah Tad Tamsin Tariq Ted Thaddeus Theodore Thomas Tilly Tim Timothy Trish Val "
    "Valerie Vicky Victoria Vin Vincent Walt Walter William Yoli Yolanda Yuki Zach Zachary Zoë"
).split()
# Given names that are ordinary words too.
_WORDS = frozenset("Bill Dolly Dot Drew Gail Jo Kit Mark Mick Nick Penny Ray Rob Sandy Sue Val".split())
_CUES = frozenset("by with and says was is es heute est con avec to week mailbag ton schnitt montage dr prof ms mr mrs y et und".split())
_NEVER = frozenset("Al Dick Ed Pat Rich Will".split())
# Words that follow a given name, or stand where a surname could, without being one.
STOP = frozenset(
    "a after all am an and another are as asks at aus avec back be because before between both but by call called calls "
    "con critics de del der des despite did die do does du each ein eine el en er erzählt est et every explains for "
    "from für had half has have he her here his how i if il in is ist it its la las le les listeners llegó los lui "
    "mit more music my next no nobody not nous of oddly on or order our para parlons please por producers read "
    "recorded said says schnitt she since so some special still talks tells thanks that the their then there they "
    "this to ton two un una und une venue von was we well were what when which while who whose with write y you your "
    "zu hablamos habla returns joined spoke told wrote dr prof mr mrs ms rev tel call box guest editing street road "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september "
    "october november december".split()
)
_BEFORE_PLACE = frozenset("in from near outside aus à en nach desde over under".split())
UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪİĶĹĽŁŃŇŌŐŒŘŚŞŠŢŤŪŮŰŹŻŽ"
LO = "a-zß-öø-ÿāăąćčďđēęěğģīıķĺľłńňōőœřśşšţťūůűźżž"
ANY = UP + LO


def _trie(words: list[str]) -> str:
    """A pattern that matches exactly ``words``, sharing prefixes."""
    if words == [""]:
        return ""
    heads: dict[str, list[str]] = {}
    for word in words:
        if word:
            heads.setdefault(word[0], []).append(word[1:])
    parts = [re.escape(head) + _trie(tails) for head, tails in sorted(heads.items())]
    body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{body})?" if "" in words else body


# Given names and short forms; ordinary words among them need title case or a cue before them, some never count.
_ALL_GIVEN = {*GIVEN, *(short.title() for shorts in NICKNAMES.values() for short in shorts.split())} - _NEVER
_FORMS = sorted({f for g in _ALL_GIVEN for f in (g, g.upper(), g.lower())})
_GIVEN_SET = frozenset(_FORMS)
_REACH = max(map(len, _FORMS)) + 2  # characters that tell whether a given name begins at a place
# Patterns that begin with the characters a match can begin with are searched many times faster than those that begin
# with a look at what stands before; so what must not stand before comes second here and below.
_HEADS = sorted({f[0] for f in _FORMS if not f.islower()})
_GIVEN_TAILS = "|".join(f"(?<={h}){_trie([f[1:] for f in _FORMS if f[0] == h])}" for h in _HEADS)
_NO_WORD_AFTER = r"(?![\w@＠'’\u00ad])(?!\.[a-z])"
_GIVEN = re.compile(rf"[{''.join(_HEADS)}](?<![\w@.+'’-].)(?:{_GIVEN_TAILS}){_NO_WORD_AFTER}")
_GIVEN_L = re.compile(rf"(?<![\w@.+'’-])(?:{_trie([f for f in _FORMS if f.islower()])}){_NO_WORD_AFTER}")
_PART = r"(?:(?i:von der|van der|van den|de la|de los|von|van|del|della|de|da|di|du|dos|al|el|bin|ibn|ben|ter|den|st\.) )"
_SUR_T = rf"(?:(?:[OD]['’]|Mc|Mac|al-)?[{UP}][{LO}]+(?:-(?:[OD]['’]|Mc)?[{UP}][{LO}]+)*)(?![{ANY}])"
_SUR_U = rf"(?:(?:[OD]['’])?[{UP}]{{3,}}(?:-(?:[OD]['’])?[{UP}]{{2,}})*)(?![{ANY}])"
_SUR_L = rf"(?:(?:[od]['’])?[{LO}]{{3,}}(?:-(?:[od]['’])?[{LO}]{{2,}})*)(?![{ANY}])"
_GAP = r"(?:[ \u00a0]{1,2}|\n(?!\n))"


def _after(sur: str, initial: str) -> re.Pattern:
    return re.compile(rf"(?:{_GAP}(?:{initial}\.|(?P<mid>[{ANY}]+)(?={_GAP})))?{_GAP}(?P<part>{_PART}?)(?P<sur>{sur})")


def _plain_after(sur: str) -> re.Pattern:
    return re.compile(rf"{_GAP}(?P<part>{_PART}?)(?P<sur>{sur})")


_STYLES = {
    "t": (_after(rf"(?:{_SUR_T}|{_SUR_U})", f"[{UP}]"), _plain_after(rf"(?:{_SUR_T}|{_SUR_U})"), _SUR_T),
    "u": (_after(_SUR_U, f"[{UP}]"), _plain_after(_SUR_U), _SUR_U),
    "l": (_after(_SUR_L, f"[{LO}]"), _plain_after(_SUR_L), _SUR_L),
}
_BEFORE = {
    s: re.compile(rf"(?<![\w'’-])(?P<part>{_PART}?)(?P<sur>{p[2]}),{_GAP}$") for s, p in _STYLES.items()
}
_INITIAL = re.compile(
    rf"[{UP}](?<![\w.'’&].)\.(?:[{UP}]\.)?{_GAP}?(?P<part>{_PART}?)(?P<sur>{_SUR_T}|{_SUR_U})"
)
_INITIAL_L = re.compile(rf"(?<![\w.'’&])([{LO}])\.{_GAP}(?P<part>{_PART}?)(?P<sur>{_SUR_L})")
_COMMA_INITIAL = re.compile(rf",{_GAP}[{UP}]\.(?![\w])")
_REVERSED_INITIAL = re.compile(rf"(?<![\w'’-])(?P<sur>{_SUR_T}|{_SUR_U})$")
_TITLED = re.compile(
    rf"[DMPR](?<!\w.)(?:(?<=D)[rR]|(?<=P)(?:rof(?:essor)?|ROF)|(?<=M)(?:rs?|RS?|[sS])|(?<=R)(?:ev|EV))\.?{_GAP}([{UP}][{LO}]+(?:{_GAP}[{UP}]\.)?{_GAP}{_PART}?{_SUR_T})"
)

_DOT, _AT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?| dot )", r"(?:[@＠]|\s?[\[(]\s?at\s?[\])]\s?| at )"
_EMAIL_AT = re.compile(r"[@＠]|[\[(]\s?at\s?[\])]| at (?=[\w-]+ dot )", re.I)
_AT_BRACKET = re.compile(r"[\[(]\s?at\s?[\])]")
_EMAIL_AT_L = re.compile(r"[@＠]|[\[(]\s?at\s?[\])]| at (?=[\w-]+ dot )")
_LOCAL = re.compile(r"(?i)[a-z0-9][a-z0-9._%+-]*\Z")
_EMAIL = re.compile(rf"(?i)[a-z0-9][a-z0-9._%+-]*{_AT}[a-z0-9][a-z0-9-]*(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}")

_WORD = rf"[{ANY}][{ANY}'’-]*"
_TOWN = rf"{_WORD}"
_CODE = r"(?:\d{5}(?:-\d{4})?|[A-Za-z]{1,2}\d[A-Za-z\d]? \d[A-Za-z]{2})"
_KIND = (
    r"(?:street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|drive|dr\.?|boulevard|blvd\.?|court|ct\.?|close|terrace|place|"
    r"pl\.?|square|sq\.?|way|crescent|house|mews|row|gardens|grove|hill|walk|circle|highway|hwy|parkway|pkwy)"
)
_UNIT = r"(?:flat|apt\.?|apartment|unit|suite|room|no\.) ?#?\w{1,5}"
_ADDRESS = re.compile(
    r"(?i)(?<![\w-])(?:"
    rf"(?:{_UNIT}, )?\d{{1,5}}[a-z]? (?:[nsew]\. )?(?:{_WORD} ){{1,3}}{_KIND}(?:, {_UNIT})?, {_TOWN}(?: {_CODE})?"
    rf"|p\.? ?o\.? ?box \d+, {_TOWN}(?: {_CODE})?"
    rf"|(?:postfach|apartado|bp|boîte postale) \d+, (?:\d{{5}} )?{_TOWN}"
    rf"|\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|impasse|chemin|allée|quai|cours)"
    rf" (?:du |de la |de l['’]|des |de |d['’])?{_WORD}(?: {_WORD})?, \d{{5}} {_TOWN}"
    rf"|[{ANY}-]+(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|ring|damm) \d{{1,4}}[a-z]?, \d{{5}} {_TOWN}"
    rf"|(?:[{ANY}]+ )(?:straße|strasse|platz|allee|weg) \d{{1,4}}[a-z]?, \d{{5}} {_TOWN}"
    rf"|(?:calle|c/|avda\.?|avenida|plaza|paseo) ?(?:de (?:la |los |las )?|del )?{_WORD}(?: {_WORD})?,? (?:n\.?º ?)?\d{{1,4}}"
    rf"(?:, \d{{1,2}}[ºª]? ?[a-z]?)?, (?:\d{{5}} )?{_TOWN}"
    r"|〒\d{3}-\d{4} ?[^\s。、]{3,40}"
    r")(?![\w-])"
)

_NO_DIGIT_BEFORE, _NO_DIGIT_AFTER = r"(?<![\w+/.,:=#-])(?<!\d )", r"(?![\w])(?![-./]\d)"
_PHONE = re.compile(
    _NO_DIGIT_BEFORE + r"(?:"
    r"(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}"
    r"|\+?1[2-9]\d{2}[2-9]\d{6}"
    r"|\+44 ?(?:\(0\) ?)?\d{2,4} ?\d{3,4} ?\d{3,4}|0(?:20 \d{4} \d{4}|7\d{3} ?\d{6}|1\d{2,3} \d{3} \d{3,4})"
    r"|(?:\+33 ?(?:\(0\) ?)?|0)[1-9](?:[ .-]\d{2}){4}"
    r"|\+49 ?(?:\(0\) ?)?\d{2,5}[ /-]\d{3,8}(?:[ -]\d{1,5})?"
    r"|(?:\+34 ?)?[6789]\d{2}(?: \d{3} \d{3}|(?: \d{2}){3})"
    r"|(?:\+81[ -]?|0(?!0))\d{1,3}-\d{2,4}-\d{4}"
    r"|\+(?!1|33|44|49)\d{1,3}(?:[ .-]?\(?\d{2,5}\)?){2,5}"
    r")" + _NO_DIGIT_AFTER
)

_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_DNI = r"(?<![\w-])(?:[xyz]-?\d{7}|\d{8})-?[a-z](?![\w-])"
_NINO = r"(?<![\w-])[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d](?![\w-])"
_LEAD = (
    r"(?:\bssn|social security(?: number| no\.?)?|\bmy social(?: is)?|passport|passeport|pasaporte|reisepass(?:nummer)?|"
    r"ausweis(?:nummer|nr\.?)?|\bdni|\bnie|\bnif|identity (?:card|number)|\bid(?: card| number| no\.?)|national id|"
    r"driver['’]?s? licen[cs]e|steuer-?id|sécurité sociale|insurance number|tax id|旅券番号|マイナンバー|パスポート)"
)
_ID = re.compile(
    rf"(?i){_SSN}|{_DNI}|{_NINO}|{_LEAD}[\s:#.]{{0,3}}(?:is |no\.? |number |nummer |n[º°o]\.? )?"
    r"(?P<value>\d{3} \d{2} \d{4}|(?=[a-z]*\d)[a-z0-9][a-z0-9-]{5,13})(?![\w-])"
)
_BORN = re.compile(r"(?i)(?:\bborn(?: on)?|\bdob|geboren am|née? le|nacid[oa] el)[:\s]{1,2}(?P<value>\d{4}-\d{2}-\d{2})(?!\d)")
_LONG_NUMBER = re.compile(
    r"(?<![\w.,-])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3\d{3}[ -]?\d{6}[ -]?\d{5}|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\w-])"
)
_RUN = re.compile(r"\d+")
_ADDRESS_HINT = re.compile(
    r"(?i)\b(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|court|ct|close|terrace|place|pl|square|sq|way|"
    r"crescent|house|mews|row|gardens|grove|hill|walk|circle|highway|hwy|parkway|pkwy|box|postfach|apartado|bp|postale|rue|"
    r"impasse|chemin|allée|quai|cours|calle|c/|avda|avenida|plaza|paseo)\b|(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|ring|damm) \d|〒"
)
# The same by whole words, and by what is no word of its own.
_HINT_WORDS = frozenset(
    "street st road rd avenue ave lane ln drive dr boulevard blvd court ct close terrace place pl square sq way crescent house mews "
    "row gardens grove hill walk circle highway hwy parkway pkwy box postfach apartado bp postale rue impasse chemin allée quai cours "
    "calle avda avenida plaza paseo".split()
)
_HINT_ENDS = ("straße ", "strasse ", "str. ", "gasse ", "weg ", "platz ", "allee ", "ufer ", "ring ", "damm ", "c/", "〒")
_HINT_PART = re.compile(rf"(?:{'|'.join(map(re.escape, _HINT_ENDS[:-2]))})\d|c(?<!\w.)/\b|〒")
_WHOLE = re.compile(r"\b\w+")
#: Characters on each side of a given name in small letters that must be small too.
NEAR = 120


def _style(word: str) -> str:
    return "t" if not (word.isupper() or word.islower()) or len(word) == 1 else "u" if word.isupper() else "l"


def _all_lower(text: str, at: int) -> bool:
    near = text[max(0, at - NEAR) : at + NEAR]
    return near == near.lower()


def _given(text: str, lower: str) -> list[tuple[int, int, str]]:
    """Given names with their places, in order; those in small letters only where no capital is near."""
    found = [(*m.span(), m[0]) for m in _GIVEN.finditer(text)]
    small: set[tuple[int, int, str]] = set()
    if len(lower) != len(text) or len(text) <= NEAR:
        small.update((*m.span(), m[0]) for m in _GIVEN_L.finditer(text))
    else:
        # What _all_lower looks at around a place holds one of these stretches, and the place is in it.
        last = len(text) - NEAR
        for low in (*range(0, last, NEAR), last):
            if text[low : low + NEAR] == lower[low : low + NEAR]:
                near = _GIVEN_L.finditer(text, low, low + NEAR + _REACH)
                small.update((*m.span(), m[0]) for m in near if m.start() < low + NEAR)
    return sorted([*found, *(s for s in small if _all_lower(text, s[0]))]) if small else found


def _folded(text: str, lower: str) -> str | None:
    """``text`` in small letters at the same places, where a pattern finds what it finds in ``text`` whatever the case."""
    return lower.replace("ſ", "s").replace("ı", "i") if len(lower) == len(text) else None


def _mail_hints(text: str, folded: str | None) -> Iterator[re.Match]:
    """The matches of ``_EMAIL_AT``."""
    if folded is None:
        return _EMAIL_AT.finditer(text)
    some = "@" in folded or "＠" in folded or " dot " in folded and " at " in folded
    return _EMAIL_AT_L.finditer(folded) if some or _AT_BRACKET.search(folded) else iter(())


def _long_numbers(text: str, runs: list[tuple[int, int]]) -> Iterator[re.Match]:
    """The matches of ``_LONG_NUMBER``: they begin with a run of 4 digits or more, or two letters before one of 2 or more."""
    last = 0
    for a, b in runs:
        start = a - 2 if a > 1 and "A" <= text[a - 1] <= "Z" else a
        if start >= last and b - a > (3 if start == a else 1) and (m := _LONG_NUMBER.match(text, start)):
            yield m
            last = m.end()


def _hinted(text: str, folded: str | None, low: int, high: int) -> bool:
    """Whether ``_ADDRESS_HINT`` is found between ``low`` and ``high``."""
    if folded is None:
        return _ADDRESS_HINT.search(text, low, high) is not None
    if not _HINT_WORDS.isdisjoint(_WHOLE.findall(folded, low, high)):
        return True
    window = folded[low:high]
    return any(part in window for part in _HINT_ENDS) and _HINT_PART.search(folded, low, high) is not None


def _surname(word: str) -> bool:
    return word.lower() not in STOP and len(word) > 2


class _Marks:
    """Which characters of a text belong to a span already; a test costs the same in texts of any length."""

    def __init__(self, size: int):
        self.used = bytearray(size)
        self.spans: list[tuple[int, int, str]] = []

    def taken(self, start: int, end: int) -> bool:
        return self.used.find(1, start, end) >= 0

    def add(self, start: int, end: int, kind: str) -> None:
        self.used[start:end] = b"\x01" * (end - start)
        self.spans.append((start, end, kind))


def _names(text: str, marks: _Marks, lower: str) -> None:
    taken = marks.taken
    end = 0
    for start, after, word in _given(text, lower):
        if start < end or taken(start, after):
            continue
        style = _style(word)
        if style != "t" and word.title() in _WORDS:
            before = text[max(0, start - 14) : start].split()
            if not before or before[-1].strip(".,:").lower() not in _CUES:
                continue
        full, plain, _ = _STYLES[style]
        stop = None
        a = full.match(text, after)
        if a and _surname(a["sur"]) and (not a["mid"] or a["mid"] in _GIVEN_SET):
            stop = a.end()
        else:
            a = plain.match(text, after)
            if a and _surname(a["sur"]):
                stop = a.end()
        if stop is None:
            b = _BEFORE[style].search(text, max(end, start - 70), start)
            if b and _surname(b["sur"]):
                before = text[max(0, b.start() - 14) : b.start()].split()
                if not before or before[-1].lower() not in _BEFORE_PLACE:
                    start, stop = b.start(), after
                    tail = re.compile(rf"{_GAP}[{ANY}]\.(?![\w])").match(text, stop)
                    if tail and not text[tail.end() : tail.end() + 2].strip().isupper():
                        stop = tail.end()
        if stop is not None and not taken(start, stop):
            marks.add(start, stop, "name")
            end = stop
    for pattern in (_INITIAL, _INITIAL_L) if text == lower else (_INITIAL,):
        for m in pattern.finditer(text):
            if len(m["sur"]) > 3 and _surname(m["sur"]) and not taken(m.start(), m.end()):
                marks.add(m.start(), m.end(), "name")
    for tail in _COMMA_INITIAL.finditer(text):
        low = max(0, tail.start() - 40)
        m = _REVERSED_INITIAL.search(text[low : tail.start()])
        if m and len(m["sur"]) > 3 and _surname(m["sur"]) and not taken(low + m.start(), tail.end()):
            before = text[max(0, low + m.start() - 14) : low + m.start()].split()
            if not before or before[-1].lower() not in _BEFORE_PLACE:
                marks.add(low + m.start(), tail.end(), "name")
    for m in _TITLED.finditer(text):
        words = m[1].split()
        if _surname(words[0]) and _surname(words[-1]) and not taken(m.start(1), m.end(1)):
            marks.add(m.start(1), m.end(1), "name")


def find_pii(text: str | None, model: contexts.Contexts | None = None) -> list[tuple[int, int, str]]:
    """Sorted, disjoint ``(start, end, kind)`` spans of a text; kinds of ``KINDS`` and ``birth_date``.

    E-mail addresses go before addresses, identity numbers, phone numbers and names. With ``model``
    names are found by their surroundings too.
    """
    if not text:
        return []
    marks = _Marks(len(text))
    taken = marks.taken
    last, lower = 0, text.lower()
    folded = _folded(text, lower)
    for hint in _mail_hints(text, folded):
        if hint.start() < last:
            continue
        end = hint.start() - (text[hint.start() - 1 : hint.start()].isspace() and hint[0][0] != " ")
        local = _LOCAL.search(text, max(last, end - 65), end)
        if local and local.start() == end - 65:  # no mailbox is that long, but none is cut either
            local = _LOCAL.search(text, last, end)
        m = local and _EMAIL.match(text, local.start())
        if m:
            marks.add(m.start(), m.end(), "email")
            last = m.end()
    # All other kinds hold digits: each run of digits is looked at with its surroundings only.
    runs = [m.span() for m in _RUN.finditer(text)]
    for a, b in runs:
        low, high = max(0, a - 60), min(len(text), b + 150)
        if "," in text[b : b + 80] and not taken(a, b) and _hinted(text, folded, low, high):
            for m in _ADDRESS.finditer(text, low, high):
                if m.start() <= a < m.end() and not taken(m.start(), m.end()):
                    marks.add(m.start(), m.end(), "address")
                    break
    for a, b in runs:
        long = b - a > 2 or text[b : b + 1].isalpha() or a and (text[a - 1].isalpha() or text[max(0, a - 3) : a].strip().isupper())
        long = long or a > 2 and text[a - 1] == " " and text[a - 3 : a - 1].isalpha() and text[b + 1 : b + 3].isdigit()
        if not long or taken(a, b):
            continue
        for m in _ID.finditer(text, max(0, a - 60), min(len(text), b + 20)):
            x, y = m.span("value") if m["value"] else m.span()
            if x <= a < y and sum(c.isdigit() for c in text[x:y]) > 3 and not taken(x, y) and (m["value"] or _plausible(text[x:y])):
                marks.add(x, y, "id_number")
                break
        if b - a == 4 and text[b : b + 1] == "-":
            for m in _BORN.finditer(text, max(0, a - 30), b + 10):
                if m.start("value") == a and not taken(*m.span("value")):
                    marks.add(*m.span("value"), "birth_date")
    for a, b in runs:
        start = a - 1 if a and text[a - 1] in "+(" else a
        m = _PHONE.match(text, start)
        if m and not taken(m.start(), m.end()):
            marks.add(m.start(), m.end(), "phone")
    for m in _long_numbers(text, runs):
        if not taken(m.start(), m.end()) and (valid_card(m[0]) or valid_iban(m[0])):
            marks.add(m.start(), m.end(), "id_number")
    _names(text, marks, lower)
    if model:
        for start, end in contexts.names_in(text, model, STOP):
            if not taken(start, end):
                marks.add(start, end, "name")
    return sorted(marks.spans)


def _plausible(text: str) -> bool:
    """Whether a number without lead-in could have been given out: no barred range, no wrong check letter."""
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", text):
        return text[:3] not in ("000", "666") and text[4:6] != "00" and text[7:] != "0000"
    plain = re.sub(r"[^0-9A-Za-z]", "", text)
    return not re.fullmatch(r"[XYZxyz\d]\d{7}[A-Za-z]", plain) or valid_dni(plain)


def valid_card(text: str) -> bool:
    """Whether the digits of ``text`` are a card number by length, issuer and Luhn's check digit."""
    digits = [int(c) for c in text if c.isdigit()]
    if not 13 <= len(digits) <= 19 or digits[0] not in (2, 3, 4, 5, 6) or any(c.isalpha() for c in text):
        return False
    doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def valid_iban(text: str) -> bool:
    """Whether ``text`` is a bank account number by form and the check of ISO 7064."""
    plain = "".join(text.split()).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", plain):
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def valid_dni(text: str) -> bool:
    """Whether a Spanish identity number has the check letter its digits give."""
    plain = re.sub(r"[^0-9A-Z]", "", text.upper())
    if not re.fullmatch(r"[XYZ\d]\d{7}[A-Z]", plain):
        return False
    number = int(plain[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2"))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[number % 23] == plain[-1]  # fixed value: the check letters


def _prf(key: str, tweak: str, round_: int, value: int, size: int) -> int:
    data = f"{tweak}|{round_}|{value}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key.encode()[:64], digest_size=24).digest(), "big") % size


def feistel(value: int, left: int, right: int, key: str, tweak: str, undo: bool = False) -> int:
    """Keyed permutation of ``range(left * right)``: alternating Feistel rounds over two mixed-radix halves."""
    a, b = divmod(value, right)
    for r in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        sign = -1 if undo else 1
        if r % 2:
            b = (b + sign * _prf(key, tweak, r, a, right)) % right
        else:
            a = (a + sign * _prf(key, tweak, r, b, left)) % left
    return a * right + b


def permute_format(text: str, key: str, tweak: str, undo: bool = False) -> str:
    """Permute the ASCII digits and letters of ``text`` within its format; all else stays in place.

    A place keeps its kind: digits stay digits, capitals capitals, small letters small letters. What
    stands between the places doesn't matter for the permutation.
    """
    radix = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 0 for c in text]
    places = [i for i, r in enumerate(radix) if r]
    if len(places) < 2:
        return text
    half = len(places) // 2
    value, left, right = 0, 1, 1
    shape = "".join("0" if radix[i] == 10 else "a" for i in places)
    for n, i in enumerate(places):
        base = ord("0") if radix[i] == 10 else ord("a") if text[i].islower() else ord("A")
        value = value * radix[i] + ord(text[i]) - base
        if n < half:
            left *= radix[i]
        else:
            right *= radix[i]
    value = feistel(value, left, right, key, f"{tweak}|{shape}", undo)
    out = list(text)
    for i in reversed(places):
        value, digit = divmod(value, radix[i])
        base = ord("0") if radix[i] == 10 else ord("a") if text[i].islower() else ord("A")
        out[i] = chr(base + digit)
    return "".join(out)


# Country codes of one and of two digits; all others have three.
_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def _lead(phone: str) -> int:
    """Length of what stays of a phone number: country code and trunk digit, however they are written."""
    m = re.match(r"\+(\d{1,3})", phone)
    if m:
        code = next((m[1][:n] for n in (1, 2) if m[1][:n] in _CODES), m[1])
        rest = re.compile(r"[ ./-]*\(0\)").match(phone, 1 + len(code))
        return rest.end() if rest else 1 + len(code)
    digits = [c for c in phone if c.isdigit()]
    if digits[:1] == ["0"] or digits[:1] == ["1"] and len(digits) == 11:
        return phone.index(digits[0]) + 1
    return 0


def permute_date(text: str, key: str, undo: bool = False) -> str:
    """Permute an ISO date of 1900 to 2099 within the calendar; other texts come back unchanged."""
    start = dt.date(1900, 1, 1)
    days = (dt.date(2100, 1, 1) - start).days
    try:
        value = (dt.date.fromisoformat(text) - start).days
    except ValueError:
        return text
    if not 0 <= value < days:
        return text
    while True:  # cycle walking keeps the permutation inside the calendar
        value = feistel(value, 271, 270, key, "date", undo)
        if value < days:
            return (start + dt.timedelta(value)).isoformat()


def placeholder(kind: str, text: str, key: str) -> str:
    """Typed placeholder of a value; equal values get equal ones, but for how a number is punctuated.

    Numbers keep their format with permuted places; the country code and the trunk digit of a phone stay.
    """
    if kind == "phone":
        at = _lead(text)
        return f"[PHONE:{text[:at]}{permute_format(text[at:], key, kind)}]"
    if kind == "id_number":
        return f"[ID_NUMBER:{permute_format(text.upper(), key, kind)}]"
    if kind == "birth_date":
        return f"[BIRTH_DATE:{permute_date(text, key)}]"
    value = " ".join(text.casefold().split())
    tag = hashlib.blake2b(value.encode(), key=key.encode()[:64], digest_size=16).hexdigest()
    return f"[{kind.upper()}:{tag}]"


def replaced(text: str | None, spans: list[tuple[int, int, str]], key: str) -> tuple[str | None, int]:
    """Text with every span replaced by its placeholder, and how many were."""
    if not spans:
        return text, 0
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], placeholder(kind, text[start:end], key)]
        at = end
    return "".join(out) + text[at:], len(spans)


def redact(text: str | None, key: str, model: contexts.Contexts | None = None) -> tuple[str | None, int]:
    """Text with every span replaced by its placeholder, and how many were; null stays null."""
    return replaced(text, find_pii(text, model), key)


#: Counts that a task holds before it hands them out.
TALLIED = 200_000
_SCANNED = (
    "id long, text string, starts array<int>, ends array<int>, kinds array<string>, found array<string>, run_starts array<int>, "
    "run_ends array<int>, runs array<string>, befores array<string>, afters array<string>, "
    "counts array<struct<kind: string, part: string, value: string, n: long>>"
)
_INTS, _TEXTS = pa.list_(pa.int32()), pa.list_(pa.string())
_COUNTS = pa.list_(pa.struct([("kind", pa.string()), ("part", pa.string()), ("value", pa.string()), ("n", pa.int64())]))
_TYPES = (pa.int64(), pa.string(), _INTS, _INTS, _TEXTS, _TEXTS, _INTS, _INTS, _TEXTS, _TEXTS, _TEXTS, _COUNTS)
_COLUMNS = [c.split()[0] for c in re.sub(r"<.*?>+", "", _SCANNED).split(", ")]


def _batch(rows: list[tuple], names: list[str], types: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def scan(documents: DataFrame, doc_id: str, text: str, whole: bool) -> DataFrame:
    """Everything that all documents tell without a model, each read once; kept in the shared folder.

    A row for each document: ``id``, its spans (``starts, ends, kinds, found``) and the runs of capitalised words outside
    of them (``run_starts, run_ends, runs, befores, afters``), with its ``text`` if ``whole``. Rows with ``counts``
    instead are what the model is fitted on; documents without id or text are not counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = contexts.Tally()
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = find_pii(value)
                placed = list(contexts.placed(value, spans, STOP)) if value else []
                if key is not None and value is not None:
                    tally.add(value, placed)
                free = [r[:4] for r in placed if r[5]]
                rows.append((
                    key, value if whole else None, *([s[i] for s in spans] for i in range(3)), [value[a:b] for a, b, _ in spans],
                    [r[0] for r in free], [r[1] for r in free], [value[r[0] : r[1]] for r in free], [r[2] for r in free], [r[3] for r in free], None,
                ))
            yield _batch(rows, _COLUMNS, _TYPES)
            if len(tally) > TALLIED:
                yield _batch([(*[None] * 11, tally.rows())], _COLUMNS, _TYPES)
        yield _batch([(*[None] * 11, tally.rows())], _COLUMNS, _TYPES)

    return cut(documents.select(F.col(doc_id).cast("long"), text).mapInArrow(run, _SCANNED))


def _model(scanned: DataFrame) -> contexts.Contexts:
    return contexts.fit(scanned.select(F.explode("counts").alias("c")).select("c.*"))


def fit_names(documents: DataFrame, doc_id: str, text: str) -> contexts.Contexts:
    """What stands around names in ``documents``, all of them."""
    return _model(scan(documents, doc_id, text, False))


def _by_place(model: contexts.Contexts, row: dict) -> list[int]:
    """Which runs of a scanned document are names."""
    return [i for i, r in enumerate(zip(row["runs"], row["befores"], row["afters"], strict=True)) if contexts.accepts(model, *r)]


def find_in(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, kind, pii_text``: the distinct strings of each kind in every row of ``documents``.

    Null and empty texts have none; repeated texts are reported under each of their ids; rows
    without id are left out; an empty table gives no rows.
    """
    scanned = scan(documents.where(F.col(doc_id).isNotNull()), doc_id, text, False)
    model = _model(scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                found = {(k, t) for k, t in zip(row["kinds"], row["found"], strict=True) if k in KINDS}
                found.update(("name", row["runs"][i]) for i in _by_place(model, row))
                rows += [(row["id"], *f) for f in sorted(found)]
            yield _batch(rows, ["doc_id", "kind", "pii_text"], (pa.int64(), pa.string(), pa.string()))

    kept = scanned.where("counts IS NULL").select("id", "kinds", "found", "runs", "befores", "afters")
    return kept.mapInArrow(run, "doc_id long, kind string, pii_text string")


def redact_in(documents: DataFrame, doc_id: str, text: str, key: str) -> DataFrame:
    """``doc_id, redacted_text, replaced`` of every row of ``documents``; null ids and texts stay null.

    ``key`` is the secret of the permutations and tags; an empty one is refused.
    """
    if not key:
        raise ValueError("a secret key is needed")
    scanned = scan(documents, doc_id, text, True)
    model = _model(scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                spans = [*zip(row["starts"], row["ends"], row["kinds"], strict=True)]
                spans += [(row["run_starts"][i], row["run_ends"][i], "name") for i in _by_place(model, row)]
                rows.append((row["id"], *replaced(row["text"], sorted(spans), key)))
            yield _batch(rows, ["doc_id", "redacted_text", "replaced"], (pa.int64(), pa.string(), pa.int32()))

    return scanned.where("counts IS NULL").drop("counts", "found").mapInArrow(run, "doc_id long, redacted_text string, replaced int")


ship(__name__)
