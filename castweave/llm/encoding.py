"""Garbled text from a wrong character encoding: found with a hidden Markov model and restored.

States: one clean state, one state per (true encoding, wrong decoding) pair, and one for
replacement characters, whose text is lost. A clean step emits one character; a step of a UTF-8
pair emits the run of characters that one encoded character turned into, so multi-byte damage is
only ever labelled where its bytes are valid; a step of a single-byte pair emits one character.
Viterbi decoding gives the labels, each labelled span gets its state's inverse transform, and
the model runs again on the result until nothing changes (text damaged twice).

Pure ASCII values are set aside in the JVM; only the others reach Python, in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castweave.runtime import ship

# Wrong decodings of UTF-8 bytes, most common first.
UTF8_AS = ("cp1252", "cp437", "mac_roman", "cp1250", "cp1251", "cp850", "cp1254", "iso8859_15", "cp866", "cp1253")
# Fixed values: (true encoding, wrong decoding) of single-byte text.
SINGLE = (("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1253", "cp1252"))
# Fixed costs, in units of -log probability.
ENTER, RARE, USUAL, STAY, SINGLE_ENTER = 4.0, 3.0, 4, 1.0, 6.0
PASSES = 3
# Stretches with foreign characters, at most that many ASCII ones apart, are decoded together.
_STRETCH = re.compile(r"[^\x00-\x7f](?:[\x00-\x7f]{0,8}[^\x00-\x7f])*")
STRETCH_MAX = 4_000
#: Characters that one character can have turned into: four bytes, each of them up to three more.
LONGEST_ARC = 12


def _byte_map(wrong: str) -> dict[str, int]:
    """Character to byte under a decoding; undefined bytes and C1 controls map to themselves."""
    table = {}
    for byte in range(128, 256):
        try:
            table[bytes([byte]).decode(wrong)] = byte
        except UnicodeDecodeError:
            table[chr(byte)] = byte
    if wrong == "cp1252":  # the same text read as Latin-1 keeps the C1 controls
        for byte in range(128, 160):
            table.setdefault(chr(byte), byte)
    return table


UTF8_MAPS = [(f"utf8>{wrong}", _byte_map(wrong)) for wrong in UTF8_AS]
# Entering a pair costs by how common it is: those beyond the usual ones need stronger evidence.
ENTER_COST = {f"utf8>{w}{t}": ENTER + (0.0 if i < USUAL else RARE) for i, w in enumerate(UTF8_AS) for t in ("", " twice")}


def _single_map(true: str, wrong: str) -> dict[str, str]:
    table = {}
    for char, byte in _byte_map(wrong).items():
        try:
            back = bytes([byte]).decode(true)
        except UnicodeDecodeError:
            continue
        if byte >= 0xC0 and unicodedata.category(back)[0] == "L":
            table[char] = back
    return table


SINGLE_MAPS = [(f"{true}>{wrong}", _single_map(true, wrong)) for true, wrong in SINGLE]


def _script(char: str) -> str:
    code = ord(char)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "latin"
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "greek"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    return "other"


def _common(code: int) -> bool:
    """Whether a code point belongs to the scripts and signs ordinary text is made of."""
    return (
        code < 0x250
        or 0x370 <= code < 0x530
        or 0x5D0 <= code < 0x6FF
        or 0x900 <= code < 0x980
        or 0xE00 <= code < 0xE80
        or 0x1E00 <= code < 0x1F00
        or 0x2010 <= code < 0x2040
        or 0x20A0 <= code < 0x20C0
        or 0x2100 <= code < 0x2300
        or 0x2600 <= code < 0x27C0
        or 0x3000 <= code < 0x3400
        or 0x4E00 <= code < 0xA000
        or 0xAC00 <= code < 0xD7B0
        or 0xFF00 <= code < 0xFFEF
        or 0x1F300 <= code < 0x1FB00
    )


def clean_cost(char: str, before: str) -> float:
    """Cost of a character in correct text, given the one before it."""
    if char < "\x80":
        return 0.0 if char >= " " or char in "\t\n\r" else 6.0
    code = ord(char)
    category = unicodedata.category(char)
    foreign_before = before >= "\x80"
    if 0x2B0 <= code < 0x300 or not _common(code):
        return 12.0
    if 0x2500 <= code < 0x25A0:
        return 9.0
    if category[0] == "L" and char not in "ªº":
        script = _script(char)
        if script != "latin":
            if not foreign_before or _script(before) != script:
                return 4.0
            return 4.5 if char.isupper() and before.islower() else 1.5
        if not foreign_before:
            return 5.0
        return 6.0 if unicodedata.category(before)[0] == "L" and _script(before) == "latin" else 5.0
    if category in ("Cc", "Cn", "Co"):
        return 14.0
    if foreign_before and unicodedata.category(before)[0] == "L" and ord(before) < 0x530:
        return 6.0 if char in "’‘“”…–—»«" else 10.0
    if category == "Sm" and before.isalpha():
        return 8.0
    return 3.0 if code > 0x2E80 else 5.0


def _utf8_arc(text: str, i: int, table: dict[str, int]) -> tuple[int, str] | None:
    """(length, character) where the characters from ``i`` are one UTF-8 character read wrongly."""
    lead = table.get(text[i])
    if lead is None or lead < 0xC2 or lead > 0xF4:
        return None
    size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    if i + size > len(text):
        return None
    data = [lead]
    for char in text[i + 1 : i + size]:
        byte = table.get(char)
        if byte is None or not 0x80 <= byte < 0xC0:
            return None
        data.append(byte)
    try:
        char = bytes(data).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return (size, char) if unicodedata.category(char) not in ("Cn", "Co") else None


def _double_arc(text: str, i: int, table: dict[str, int]) -> tuple[int, str] | None:
    """Like :func:`_utf8_arc` for characters that were read wrongly in the same way twice."""
    inner, at = "", i
    while at < len(text) and len(inner) < 4 and (arc := _utf8_arc(text, at, table)):
        at, inner = at + arc[0], inner + arc[1]
        if len(inner) > 1 and (outer := _utf8_arc(inner, 0, table)) and outer[0] == len(inner):
            return at - i, outer[1]
    return None


def label_once(text: str) -> tuple[str, list[str]]:
    """One Viterbi pass: the text with every damaged span inverted, and the labels of the spans.

    Only stretches around foreign characters are decoded; ASCII in between is clean by itself. A
    stretch longer than ``STRETCH_MAX`` is decoded in parts that meet where no damaged character lies
    across, so memory stays bounded on any text and nothing is torn.
    """
    if text.isascii():
        return text, []
    out, at, labels = [], 0, set()
    for m in _STRETCH.finditer(text):
        out.append(text[at : m.start()])
        a = m.start()
        while a < m.end():
            # The last part takes what is left, so that none is too short to tell.
            b = _border(text, a + STRETCH_MAX, m.end()) if m.end() - a >= 2 * STRETCH_MAX else m.end()
            part, met = _label_stretch(text[a:b], text[a - 1] if a else " ")
            out.append(part)
            labels.update(met)
            a = b
        at = m.end()
    return "".join(out) + text[at:], sorted(labels)


def _border(text: str, at: int, end: int) -> int:
    """The first place from ``at`` on where a stretch can be parted: after an ASCII character that is no letter, else
    (none within ``STRETCH_MAX``) where no run of bytes of one character lies across."""
    for i in range(at, min(end, at + STRETCH_MAX)):
        if text[i - 1] < "\x80" and not text[i - 1].isalpha():
            return i
    for i in range(at, end):
        arcs = (arc for k in range(max(0, i - LONGEST_ARC), i) for _, t in UTF8_MAPS for f in (_utf8_arc, _double_arc) if (arc := f(text, k, t)) and k + arc[0] > i)
        if next(arcs, None) is None:
            return i
    return end


def _label_stretch(text: str, first_before: str) -> tuple[str, list[str]]:
    """Viterbi decoding of one stretch after the character ``first_before``."""
    arcs: dict[int, list] = {}
    for i, char in enumerate(text):
        if char < "\x80":
            continue
        found = [(name, arc) for name, table in UTF8_MAPS if (arc := _utf8_arc(text, i, table))]
        found += [(f"{name} twice", arc) for name, table in UTF8_MAPS[:4] if (arc := _double_arc(text, i, table))]
        if found:
            arcs[i] = found
    run = best_run = 0
    for char in text:
        run = run + 1 if "\x80" <= char < "Ѐ" else 0
        best_run = max(best_run, run)
    if not arcs and best_run < 3:
        return text, ["lost"] * (text.count("�") > 0)
    size = len(text)
    # best[i]: state -> (cost, previous position, previous state, emitted)
    best: list[dict[str, tuple]] = [{} for _ in range(size + 1)]
    best[0]["clean"] = (0.0, -1, "", "")

    def offer(at: int, state: str, cost: float, back: int, came: str, out: str) -> None:
        if state not in best[at] or cost < best[at][state][0]:
            best[at][state] = (cost, back, came, out)

    for i in range(size):
        here = best[i]
        if not here:
            continue
        char, before = text[i], text[i - 1] if i else first_before
        low_state = min(here, key=lambda s: here[s][0])
        low = here[low_state][0]
        if char == "�":
            offer(i + 1, "clean", low + 1.0, i, low_state, char)
            continue
        # A change of state is charged on entering a damaged one.
        offer(i + 1, "clean", low + clean_cost(char, before), i, low_state, char)
        for name, (length, out) in arcs.get(i, ()):
            step = STAY + clean_cost(out, here[name][3] if name in here and here[name][3] else " ")
            if name in here:
                offer(i + length, name, here[name][0] + step, i, name, out)
            offer(i + length, name, low + ENTER_COST[name] + step, i, low_state, out)
        if char < "\x80" and not char.isalpha():  # a single-byte span goes on over spaces and signs
            for name, _ in SINGLE_MAPS:
                if name in here:
                    offer(i + 1, name, here[name][0] + 0.1, i, name, char)
        elif char >= "\x80":
            for name, table in SINGLE_MAPS:
                out = table.get(char)
                if out is None:
                    continue
                inside = name in here
                step = 2.5 + (2.5 if inside and here[name][3].islower() and out.isupper() else 0.0)
                if inside:
                    offer(i + 1, name, here[name][0] + step, i, name, out)
                if not before.isalpha() or before < "\x80" and not before.isalpha():
                    offer(i + 1, name, low + SINGLE_ENTER + step + (1.5 if out.islower() and before not in " " else 0), i, low_state, out)
    state = min(best[size], key=lambda s: best[size][s][0])
    at, pieces, labels = size, [], []
    while at > 0:
        _, back, came, out = best[at][state]
        pieces.append(out)
        if state != "clean":
            labels.append(state)
        at, state = back, came
    restored = "".join(reversed(pieces))
    return restored, sorted(set(labels)) + ["lost"] * ("�" in text)


def restore(text: str) -> tuple[str, list[str]]:
    """Restored text and the labels met; text without damage comes back unchanged without labels."""
    labels: list[str] = []
    for _ in range(PASSES):
        after, met = label_once(text)
        labels += [m for m in met if m not in labels]
        if after == text:
            break
        text = after
    return text, labels


def _label_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        results = [restore(t) for t in batch["value"]]
        batch["restored"] = [r[0] for r in results]
        batch["labels"] = [",".join(r[1]) for r in results]
        yield batch[batch["labels"] != ""][["source_table", "record_id", "field", "value", "restored", "labels"]]


def damaged_values(df: DataFrame, source_table: str, key: str, fields: tuple[str, ...]) -> DataFrame:
    """``source_table, record_id, field, value, restored, labels`` of every damaged value of ``fields``.

    ``labels`` names the states met, comma-separated; ``lost`` marks replacement characters, which
    stay in ``restored``. Nulls, blanks and pure ASCII are never damaged; repeated rows repeat;
    a null key stays null; an empty table gives no rows.
    """
    values = df.select(
        F.col(key).cast("string").alias("record_id"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x"),
    ).select(F.lit(source_table).alias("source_table"), "record_id", "x.field", "x.value")
    foreign = values.where(F.col("value").rlike(r"[^\x00-\x7F]"))
    schema = "source_table string, record_id string, field string, value string, restored string, labels string"
    found = foreign.mapInPandas(_label_batches, schema)
    return found.withColumn("record_id", F.col("record_id").cast("long"))


def damaged_tables(parsed_episode: DataFrame, podcast: DataFrame) -> DataFrame:
    """Damaged titles, descriptions and show names with their restored text."""
    return damaged_values(parsed_episode, "parsed_episode", "parse_id", ("title", "description")).unionByName(
        damaged_values(podcast, "podcast", "id", ("name",))
    )


ship(__name__)
