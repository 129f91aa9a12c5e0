"""Variant spellings of names typed by people, linked to one entity.

1. Every distinct spelling becomes a signature: accents folded, handles and compact forms split,
   titles, degrees, quoted nicknames and remarks dropped, known short forms mapped to their long
   form. The long tokens, sorted, are the *core* of a name; initials are kept apart.
2. A symmetric-delete index over the distinct tokens gives each token the forms it shares with
   other tokens (one character deleted; two in very long tokens; letters sorted in short ones).
   Cores meet in blocks of such forms, with up to two tokens varying and the others exact. A form
   of n letters is shared by at most n + 1 times as many tokens as the alphabet has letters, so a
   block stays small whatever the number of rows: a given name or surname held by a third of all
   rows is exact in each of its blocks and falls apart by the tokens beside it.
3. Cores that meet are aligned by optimal assignment of their tokens; accepted links are closed
   by graph contraction. Different middle initials part a group again.
4. What fits several groups is linked to none: initials for whole names, abbreviations, nicknames
   that quotations in the data or their shape tell, and missing middle names are attached only
   where exactly one group is in reach.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castweave.llm.contract import connected_groups
from castweave.operators.skew import join_hot
from castweave.runtime import cut, ship

# Given names and their usual short forms.
NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex al sandy xander", "andrew": "andy drew", "anthony": "tony",
    "benjamin": "ben benny", "catherine": "cathy", "charles": "charlie chuck", "christopher": "chris kit",
    "daniel": "dan danny", "david": "dave", "deborah": "debbie deb", "dorothy": "dot dottie dolly",
    "edward": "ed ned eddie", "elizabeth": "liz beth betty lizzie eliza", "francesca": "fran frankie",
    "frederick": "fred freddie", "gabriel": "gabe", "gregory": "greg", "harriet": "hattie", "isabella": "bella izzy",
    "jacqueline": "jackie", "james": "jim jimmy", "jennifer": "jen jenny", "jonathan": "jon jonny", "jose": "pepe",
    "joseph": "joe", "josephine": "jo josie", "katherine": "kate kathy katie", "kenneth": "ken kenny",
    "lawrence": "larry", "leonard": "len lenny", "margaret": "peggy maggie meg", "matilda": "tilly mattie",
    "matthew": "matt", "michael": "mike mick", "nathaniel": "nate nat", "nicholas": "nick nicky",
    "oliver": "ollie", "patricia": "trish pat patty", "penelope": "penny", "peter": "pete", "philip": "phil pip",
    "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich", "robert": "bob rob bobby",
    "samantha": "sam", "stephanie": "steph", "stephen": "steve", "susannah": "sue susie", "thaddeus": "tad thad",
    "theodore": "ted theo", "thomas": "tom", "timothy": "tim", "valerie": "val", "victoria": "vicky tori",
    "vincent": "vin vince vinny", "walter": "walt wally", "william": "bill will billy", "yolanda": "yoli",
    "zachary": "zach zack", "tamsin": "tammy", "eleanor": "ellie nell", "susan": "suzie",
}
# Words of organisation names and their abbreviations.
ORGANISATIONS = {
    "brothers": "bros", "collective": "coll", "company": "co", "ensemble": "ens", "foundation": "fdn found",
    "institute": "inst", "media": "med", "orchestra": "orch", "productions": "prod prods", "troupe": "tr",
    "university": "univ", "association": "assn assoc", "department": "dept", "society": "soc",
}
# Titles, degrees, legal forms and remarks that don't belong to a name.
DROPPED = frozenset(
    "dr prof professor rev reverend mr mrs ms miss sir dame hon phd md jr sr esq mba inc llc ltd gmbh corp "
    "group the with guest returns here feat featuring host".split()
)
ROOT = {short: name for name, shorts in (NICKNAMES | ORGANISATIONS).items() for short in shorts.split()}
# Letters that decomposition leaves as they are.
FOLD = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"})
#: Letters from which one deletion is indexed, and two; a token shorter than the first may only swap letters.
MIN_EDIT, MIN_TWO = 5, 12
#: Tokens of more letters (no words, but typed all the same) are indexed by their halves and may differ by one edit.
LONG = 64
_QUOTED = re.compile(r"[\"“”„«»]([^\"“”„«»]*)[\"“”„«»]|\([^)]*\)|\[[^\]]*\]")
_WORD = re.compile(r"([^\W\d_]+(?:['’][^\W\d_]+)*)(\.?)")


class Spelling(NamedTuple):
    """What is read from a typed name: long tokens with short forms resolved, the same as typed, and more."""

    long: list[str]
    raw: list[str]
    initials: list[str]
    short: list[str]  # long tokens that look like abbreviations
    nick: list[str]  # quoted words


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.casefold()).translate(FOLD)
    return "".join(c for c in text if not unicodedata.combining(c))


def _contracted(word: str) -> bool:
    """Whether a word has no vowel after its first letter, as dept or mgmt."""
    return len(word) > 1 and not any(c in "aeiouy" for c in word[1:])


def read_name(name: str | None) -> Spelling | None:
    """A typed name's parts; None where no letters are left.

    A comma moves the part before it to the end; an unsplittable handle stays one token.
    """
    if not name:
        return None
    nick: list[str] = []
    text = _QUOTED.sub(lambda m: nick.append(m[1] or "") or " ", name)
    if not any(c.isalpha() for c in text):
        text, nick = re.sub(r"[\"“”„«»()\[\]]", " ", name), []
    text = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", text) if " " not in text.strip() else text
    text = fold(text)
    text = re.sub(r"(?<=[^\W\d_])\d+\b", "", text)
    head, comma, tail = text.partition(",")
    tail_words = [w for w, _ in _WORD.findall(tail)]
    if comma and any(w not in DROPPED for w in tail_words):
        text = f"{tail} {head}"
    words = _WORD.findall(text)
    kept = [(w.replace("'", "").replace("’", ""), dot) for w, dot in words if w not in DROPPED] or words
    if not kept:
        return None
    raw = [w for w, _ in kept if len(w) > 1]
    long = [ROOT.get(w, w) for w in raw]
    initials = [w for w, _ in kept if len(w) == 1]
    short = [w for w, dot in kept if 1 < len(w) < 6 and w not in ROOT and (dot or _contracted(w) or len(raw) > 2)]
    return Spelling(long, raw, initials, short, [fold(n) for n in nick if n.isalpha()])


def signature(name: str | None) -> tuple[list[str], list[str]] | None:
    """(long tokens, initials) of a typed name; None where no letters are left."""
    read = read_name(name)
    return (read.long, read.initials) if read else None


def edit_distance(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance (an adjacent swap costs 1), cut off above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    same = len(os.path.commonprefix([a, b]))
    a, b = a[same:], b[same:]
    same = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if max(len(a), len(b)) > LONG:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        two, one = one, row
    return one[-1]


DIFFERENT = 9


def token_cost(a: str, b: str) -> int:
    """0 equal, 1 one edit or an abbreviation, 2 two edits in a very long token, 9 different.

    Tokens of up to four letters may only swap neighbours; an initial stands for any word it begins.
    """
    if a == b:
        return 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) == 1:
        return 1 if long[0] == short else DIFFERENT
    if len(short) >= MIN_EDIT - 1 and len(long) >= MIN_EDIT:
        distance = edit_distance(a, b)
        if distance == 1 or distance == 2 and len(short) >= MIN_TWO and len(long) <= LONG:
            return distance
    elif len(short) == len(long) > 2 and sorted(short) == sorted(long) and edit_distance(a, b) == 1:
        return 1
    return DIFFERENT


def assign(costs: list[list[int]]) -> int:
    """Least total cost of giving every row a column of its own (no more rows than columns).

    Shortest augmenting paths with potentials, so the work grows with the cube of the tokens.
    """
    n, m = len(costs), len(costs[0])
    inf = float("inf")
    row_price, col_price = [0] * (n + 1), [0] * (m + 1)
    owner, back = [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], column = i, 0
        least, done = [inf] * (m + 1), [False] * (m + 1)
        while owner[column]:
            done[column] = True
            row, step, nearest = owner[column], inf, 0
            for j in range(1, m + 1):
                if done[j]:
                    continue
                slack = costs[row - 1][j - 1] - row_price[row] - col_price[j]
                if slack < least[j]:
                    least[j], back[j] = slack, column
                if least[j] < step:
                    step, nearest = least[j], j
            for j in range(m + 1):
                if done[j]:
                    row_price[owner[j]] += step
                    col_price[j] -= step
                else:
                    least[j] -= step
            column = nearest
        while column:
            owner[column] = owner[back[column]]
            column = back[column]
    return sum(costs[owner[j] - 1][j - 1] for j in range(1, m + 1) if owner[j])


def aligned(left: list[str], right: list[str]) -> bool:
    """Whether two token lists name the same entity: optimal assignment of the shorter to the longer.

    Every token of the shorter list must find its partner at a total cost of at most two edits;
    a longer list may keep one more token (a middle name) where all others are matched exactly.
    """
    if len(left) > len(right):
        left, right = right, left
    if not left or len(right) - len(left) > (len(left) > 1):
        return False
    if len(left) == 2 and len(right) == 2:
        (a, b), (c, d) = left, right
        best = min(token_cost(a, c) + token_cost(b, d), token_cost(a, d) + token_cost(b, c))
    else:
        best = assign([[token_cost(a, b) for b in right] for a in left])
    return best <= (2 if len(left) == len(right) else 0)


def abbreviates(short: str, long: str) -> bool:
    """Whether ``short`` is a beginning of ``long``, or its letters in order with the first and the last."""
    if len(short) + 2 > len(long) or short[0] != long[0]:
        return False
    if long.startswith(short):
        return True
    rest = iter(long)
    return _contracted(short) and long[-1] == short[-1] and all(c in rest for c in short)


def nickname_shaped(short: str, long: str) -> bool:
    """Whether ``short`` is an end of ``long`` (Xander), or a beginning with a usual ending (Robbie)."""
    if len(short) >= 4 and len(long) > len(short) + 1 and long.endswith(short):
        return True
    stem = re.sub(r"(?:ie|ey|y|i|o)$", "", short)
    if len(stem) > 3 and stem[-1] == stem[-2]:
        stem = stem[:-1]
    return stem != short and len(stem) >= 3 and len(long) > len(stem) + 1 and long.startswith(stem)


def _sign_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for kind, key, name in zip(batch["kind"], batch["key"], batch["name"], strict=True):
            if read := read_name(name):
                core = " ".join(sorted(read.long))
                sig = core + "/" + "".join(read.initials)
                rows.append((kind, key, sig, core, *read))
        yield pd.DataFrame(rows, columns=["kind", "key", "sig", "core", *Spelling._fields])


def one_deleted(token: str) -> list[str]:
    """The token and what it may share with one that differs by one edit.

    These are its forms with one character deleted. A very long token gives its halves instead, told apart by its
    length and by one less: one edit leaves one of the halves as it is.
    """
    if len(token) <= LONG:
        return [token, *{token[:i] + token[i + 1 :] for i in range(len(token))}]
    forms = [token]
    for size in (len(token), len(token) - 1):
        half = size // 2 - 1
        forms += [f"<{size}{token[:half]}", f">{size}{token[-half:]}"]
    return forms


def token_forms(token: str) -> list[str]:
    """Forms of a token under which it meets others: deletions, two in very long ones, sorted letters in short ones."""
    if len(token) < 3:
        return [token]
    if len(token) < MIN_EDIT:
        return [token, "~" + "".join(sorted(token))]
    once = one_deleted(token)
    if not MIN_TWO <= len(token) <= LONG:
        return once
    return [*once, *{f"={form[:i]}{form[i + 1:]}" for form in once for i in range(len(form))}, *("=" + form for form in once)]


def _with_forms(forms, column: str):
    """A ``mapInPandas`` function that turns ``column`` into the list of its ``forms``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["forms"] = [forms(t) for t in batch[column]]
            yield batch

    return run


def _key_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index entries of cores: blocks of token forms, edits in up to two tokens."""
    for batch in batches:
        rows = []
        for kind, core, parts in zip(batch["kind"], batch["core"], batch["parts"], strict=True):
            tokens = core.split()
            forms = {p["token"]: list(p["forms"]) for p in parts if p["forms"] is not None}
            options = [[t, *(f for f in forms.get(t, ()) if f != t)] for t in tokens]
            once = [[f for f in o if f[0] != "="] for o in options]  # a token with two edits leaves none to others
            keys = set(options[0]) if len(tokens) == 1 else set()
            for i in range(len(tokens)):
                others = tokens[:i] + tokens[i + 1 :]
                if others and len(once[i]) < len(options[i]):
                    keys.update("|".join(sorted([*others, f])) for f in options[i] if f[0] == "=")
                for j in range(i):
                    rest = tokens[:j] + tokens[j + 1 : i] + tokens[i + 1 :]
                    keys.update("|".join(sorted([*rest, f, g])) for f in once[i] for g in once[j])
            rows += [(kind, core, key) for key in keys]
        yield pd.DataFrame(rows, columns=["kind", "core", "block"])


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every way to part a handle into two words; short forms resolved as well."""
    for batch in batches:
        rows = []
        for kind, core in zip(batch["kind"], batch["core"], strict=True):
            for i in range(3, len(core) - 2):
                left, right = core[:i], core[i:]
                for a, b in {(left, right), (ROOT.get(left, left), ROOT.get(right, right))}:
                    rows.append((kind, core, " ".join(sorted((a, b))), a, b))
        yield pd.DataFrame(rows, columns=["kind", "handle", "core", "left", "right"])


def _align_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = [aligned(a.split(), b.split()) for a, b in zip(batch["a"], batch["b"], strict=True)]
        yield batch[keep][["kind", "a", "b"]]


def _short_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = [abbreviates(a, b) for a, b in zip(batch["token"], batch["other"], strict=True)]
        yield batch[keep][["kind", "a", "b"]]


def _shape_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = [nickname_shaped(a, b) for a, b in zip(batch["token"], batch["other"], strict=True)]
        yield batch[keep][["kind", "a", "b"]]


def shape_links(parts: DataFrame) -> DataFrame:
    """``kind, a, b``: cores equal but for a token that is shaped as a nickname of the other's, see :func:`nickname_shaped`.

    ``parts(kind, core, token, rest)``. Names of one rest meet under the token or stem that a nickname is and the ends and
    beginnings of the longer token, so a rest that many names share gives a row for each of those and not for each pair.
    """
    tokens = parts.select("token").distinct()
    length = F.length("token")
    stem = F.regexp_replace("token", "(ie|ey|y|i|o)$", "")
    root = F.when(F.length(stem) > 3, F.regexp_replace(stem, r"(.)\1$", "$1")).otherwise(stem)
    nick = F.array(
        F.when(length >= 4, F.xxhash64(F.lit(">"), "token")),
        F.when((root != F.col("token")) & (F.length(root) >= 3), F.xxhash64(F.lit("<"), root)),
    )
    short = tokens.where(length >= 3).select("token", F.explode(F.array_compact(nick)).alias("form"))
    sizes = F.sequence(F.lit(3), length - 2)
    ends = F.transform(sizes, lambda n: F.xxhash64(F.lit(">"), F.col("token").substr(length - n + 1, n)))
    heads = F.transform(sizes, lambda n: F.xxhash64(F.lit("<"), F.col("token").substr(F.lit(1), n)))
    long = tokens.where(length >= 5).select("token", F.explode(F.concat(ends, heads)).alias("form"))
    # Few forms are those of a nickname and of a longer token as well; only they are written out for the names.
    met = cut(
        short.select("form", F.lit(True).alias("is_short"), "token").unionByName(
            long.join(short.select("form").distinct(), "form", "left_semi").select("form", F.lit(False).alias("is_short"), "token")
        )
    )
    met = met.join(met.where("NOT is_short").select("form").distinct(), "form", "left_semi")
    forms = cut(met.groupBy("token", "is_short").agg(F.collect_list("form").alias("forms")))
    side = lambda is_short: join_hot(
        parts, forms.where(F.col("is_short") == is_short).select("token", "forms"), "token", "left"
    ).where("forms IS NOT NULL").withColumn("form", F.explode("forms"))
    left = side(True).select("kind", "rest", "form", F.col("core").alias("a"), "token")
    right = side(False).select("rest", "form", F.col("core").alias("b"), F.col("token").alias("other"))
    found = left.join(right, ["rest", "form"]).where(F.length("other") > F.length("token"))
    return found.mapInPandas(_shape_batches, "kind string, a string, b string")


def handle_splits(cores: DataFrame, tokens: DataFrame) -> DataFrame:
    """``kind, handle, core``: names of two words that a core of one token may write together.

    One of the two words must be a token of the data: an edit leaves at least one of them as it is.
    """
    alone = cores.where(~F.col("core").contains(" ") & F.length("core").between(8, LONG)).select("kind", "core")
    splits = cut(alone.mapInPandas(_split_batches, "kind string, handle string, core string, left string, right string"))
    left, right = (splits.join(tokens.withColumnRenamed("token", side), side, "left_semi") for side in ("left", "right"))
    return left.unionByName(right).select("kind", "handle", "core").distinct()


def core_links(spelled: DataFrame, index: DataFrame, cores: DataFrame) -> DataFrame:
    """``kind, a, b``: cores whose tokens align, found by the index, and cores that write a whole name together."""
    met = (
        index.withColumnRenamed("core", "a")
        .join(index.select(F.col("core").alias("b"), "block"), "block")
        .where("a < b")
        .select("kind", "a", "b")
        .distinct()
    )
    linked = met.mapInPandas(_align_batches, "kind string, a string, b string")
    joined = spelled.where(F.size("long") > 1).select("kind", F.col("core").alias("b"), F.array_join("raw", "").alias("a")).distinct()
    together = joined.join(cores.select("kind", F.col("core").alias("a")), ["kind", "a"], "left_semi")
    return linked.unionByName(together.select("kind", "a", "b")).distinct()


def unsure_links(spelled: DataFrame, cores: DataFrame) -> DataFrame:
    """``kind, a, b``: cores ``a`` that may stand for ``b``: abbreviations, nicknames, missing middle names."""
    schema = "kind string, a string, b string"
    tokens = F.split("core", " ")
    parts = cut(
        cores.where(F.col("core").contains(" ")).select(
            "kind", "core", tokens.alias("tokens"), F.posexplode(tokens).alias("i", "token")
        ).select(
            "kind", "core", "token",
            F.xxhash64("kind", F.array_join(F.filter("tokens", lambda t, i: i != F.col("i")), " ")).alias("rest"),
        )
    )
    other = parts.select("rest", F.col("core").alias("b"), F.col("token").alias("other"))
    # Abbreviations: a short word of one name begins, or contracts, a word of another; all else is equal.
    shorts = spelled.select("kind", "core", F.explode("short").alias("token")).distinct()
    seek = parts.join(shorts, ["kind", "core", "token"]).select("kind", "rest", F.col("core").alias("a"), "token")
    short = seek.join(other, "rest").where("a <> b").mapInPandas(_short_batches, schema)
    # Nicknames quoted beside a long form in at least two names.
    quoted = spelled.where((F.size("nick") > 0) & (F.size("raw") > 1)).select(
        F.explode("nick").alias("token"), F.col("raw")[0].alias("long"), "core"
    )
    known = quoted.where(F.col("token") != F.col("long")).groupBy("token", "long").agg(F.countDistinct("core").alias("n"))
    called = parts.join(known.where("n > 1"), "token").select("kind", "rest", F.col("core").alias("a"), F.col("long").alias("other"))
    nick = called.join(other, ["rest", "other"]).where("a <> b").select("kind", "a", "b")
    # Nicknames by shape: met through the beginnings and ends of the longer token, however many names share the rest.
    shaped = shape_links(parts)
    # A missing middle name: both ends equal, one or more words between them.
    ends = F.array_join(F.array_sort(F.array(F.col("long")[0], F.element_at("long", -1))), " ")
    between = spelled.where(F.size("long") > 2).select("kind", ends.alias("a"), F.col("core").alias("b")).distinct()
    middle = cores.select("kind", F.col("core").alias("a")).join(between, ["kind", "a"])
    return short.unionByName(nick).unionByName(shaped).unionByName(middle).distinct()


def link_names(names: DataFrame) -> DataFrame:
    """``kind``, ``key``, ``sig``, ``group_id`` of every named row of ``names(kind, key, name)``.

    Rows of one ``kind`` and ``group_id`` name the same entity; groups never span kinds. Null,
    empty and letterless names and null keys are in no group. Repeated rows keep their own keys.
    """
    lists = ", ".join(f"{f} array<string>" for f in Spelling._fields)
    named = names.where(F.col("name").isNotNull() & F.col("key").isNotNull())
    signed = cut(named.mapInPandas(_sign_batches, f"kind string, key string, sig string, core string, {lists}"))
    spelled = cut(signed.drop("key").distinct())
    whole = (F.size("long") > 1) | (F.size("initials") == 0)
    typed = F.filter(F.arrays_zip("raw", "long"), lambda t: t["raw"] != t["long"])  # short forms begin with letters of their own
    heads = F.array_distinct(F.flatten(F.collect_set(F.transform(typed, lambda t: t["raw"].substr(1, 1)))))
    # A short form as typed is a core of its own beside the long one, so that typing errors in it are found too.
    as_typed = F.array_join(F.array_sort("raw"), " ")
    alias = spelled.where(whole & (F.col("raw") != F.col("long"))).select("kind", as_typed.alias("a"), F.col("core").alias("b")).distinct()
    known = spelled.where(whole).select("kind", "core", "raw", "long").unionByName(
        alias.select("kind", F.col("a").alias("core"), F.split("a", " ").alias("raw"), F.split("a", " ").alias("long"))
    )
    cores = cut(known.groupBy("kind", "core").agg(heads.alias("heads")))
    # Names that handles may write together are cores for the index, linked with their handle.
    typed_tokens = spelled.select(F.explode(F.array_union("long", "raw")).alias("token")).distinct()
    splits = cut(handle_splits(cores, typed_tokens))
    indexed = cores.select("kind", "core").unionByName(splits.select("kind", "core")).distinct()
    in_core = cut(indexed.select("kind", "core", F.explode(F.array_distinct(F.split("core", " "))).alias("token")))
    # Forms that more than one token has; all others can't meet anything.
    tokens = in_core.select("token").unionByName(typed_tokens).distinct()
    forms = tokens.mapInPandas(_with_forms(token_forms, "token"), "token string, forms array<string>")
    forms = cut(forms.select("token", F.explode("forms").alias("form")))
    shared = forms.select(F.xxhash64("form").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    live = forms.withColumn("h", F.xxhash64("form")).join(shared, "h", "left_semi").groupBy("token").agg(F.collect_list("form").alias("forms"))
    live = cut(live)
    parts = join_hot(in_core, live, "token", "left").groupBy("kind", "core").agg(F.collect_list(F.struct("token", "forms")).alias("parts"))
    index = parts.mapInPandas(_key_batches, "kind string, core string, block string")
    index = cut(index.select("kind", "core", F.xxhash64("kind", "block").alias("block")))
    node = lambda c: F.concat_ws("\t", "kind", c)
    linked = core_links(spelled, index, cores).unionByName(alias)
    linked = linked.unionByName(splits.select("kind", F.col("handle").alias("a"), F.col("core").alias("b")))
    closed = connected_groups(linked.select(node("a").alias("a"), node("b").alias("b")), "a", "b")
    clusters = cores.select("kind", "core", node("core").alias("member")).join(closed, "member", "left").select(
        "kind", "core", F.coalesce("group_id", "member").alias("cluster")
    )
    # Different middle initials part a cluster; a name without one between them belongs to neither.
    letter = F.coalesce(F.nullif(F.substring_index("sig", "/", -1).substr(1, 1), F.lit("")), F.lit(""))
    sigs = spelled.where(whole).select("kind", "sig", "core", letter.alias("letter")).distinct()
    sigs = cut(sigs.join(clusters, ["kind", "core"]))
    stated = F.when(F.col("letter") != "", F.col("letter"))
    torn = sigs.groupBy("cluster").agg(F.min(stated).alias("lo"), F.max(stated).alias("hi"))
    torn = torn.where("lo < hi").select("cluster", F.lit(True).alias("torn"))
    grouped = join_hot(sigs, torn, "cluster", "left").withColumn(
        "group", F.when(F.col("torn"), F.concat_ws("\t", "cluster", "letter")).otherwise(F.col("cluster"))
    )
    grouped = cut(grouped.select("kind", "sig", "core", "letter", "group"))
    # Abbreviations, nicknames, missing middle names: group to group, only where one group fits.
    unsure = unsure_links(spelled, cores)
    side = lambda c, g, m: grouped.select("kind", F.col("core").alias(c), F.col("group").alias(g), F.col("letter").alias(m))
    pairs = unsure.join(side("a", "ga", "ma"), ["kind", "a"]).join(side("b", "gb", "mb"), ["kind", "b"])
    fits = (F.col("ma") == "") | (F.col("mb") == "") | (F.col("ma") == F.col("mb"))
    whose = pairs.where(fits & (F.col("ga") != F.col("gb"))).groupBy("ga").agg(F.min("gb").alias("lo"), F.max("gb").alias("hi"))
    homes = connected_groups(whose.where("lo = hi"), "ga", "lo").select(F.col("member").alias("group"), F.col("group_id").alias("home"))
    grouped = cut(join_hot(grouped, homes, "group", "left").select("kind", "sig", "core", F.coalesce("home", "group").alias("group")))
    # Initials for a whole name: the nearest names in reach, only where they are one group.
    alone = cut(spelled.where(~whole).select("kind", "sig", F.col("long")[0].alias("token"), F.col("initials")[0].alias("letter")).distinct())
    words = F.split("core", " ")
    offers = grouped.join(cores, ["kind", "core"]).where(F.size(words) > 1).select(
        "kind", "group", "heads", words.alias("words"), F.posexplode(words).alias("at", "token")
    )
    others = F.transform(F.filter("words", lambda w, i: i != F.col("at")), lambda w: w.substr(1, 1))
    offers = offers.select("kind", "group", "token", F.explode(F.array_union(others, "heads")).alias("letter"))
    offers = offers.groupBy("kind", "token", "letter").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
    edited = live.select("token", F.explode("forms").alias("form")).where(~F.col("form").rlike("^[=~<>]"))
    near = alone.select("token").distinct().join(edited, "token")
    near = near.withColumnRenamed("token", "own").join(edited, "form").select("own", "token").where("own <> token").distinct()
    seek = alone.withColumn("far", F.lit(0)).unionByName(
        alone.withColumnRenamed("token", "own").join(near, "own").select("kind", "sig", "token", "letter", F.lit(1).alias("far"))
    )
    met = seek.join(offers, ["kind", "token", "letter"], "left")
    here = lambda c: F.when(F.col("far") == 0, F.col(c))
    reach = met.groupBy("kind", "sig").agg(
        F.min(here("lo")).alias("lo0"), F.max(here("hi")).alias("hi0"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    one = F.when(F.col("lo0") == F.col("hi0"), F.col("lo0")).when(F.col("lo0").isNull() & (F.col("lo") == F.col("hi")), F.col("lo"))
    attached = reach.select("kind", "sig", F.coalesce(one, node("sig")).alias("group_id"))
    homes = grouped.select("kind", "sig", F.col("group").alias("group_id")).distinct().unionByName(attached)
    return signed.select("kind", "key", "sig").join(homes, ["kind", "sig"])


def name_pairs(person: DataFrame, entity_profile: DataFrame) -> DataFrame:
    """Pairs of rows of one table that name the same person or organisation, smaller key first.

    A profile without display name goes by its normalised name. The pairs of a group are expanded
    because the result asks for all of them; :func:`link_names` gives membership instead.
    """
    people = person.select(F.lit("person").alias("kind"), F.col("id").cast("string").alias("key"), "name")
    shown = F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), F.col("normalized_name"))
    entities = entity_profile.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("key"), shown.alias("name"))
    rows = cut(link_names(people.unionByName(entities)).select("kind", "group_id", "key").distinct())
    left = rows.select("kind", "group_id", F.col("key").alias("left_key"))
    right = rows.select("kind", "group_id", F.col("key").alias("right_key"))
    return (
        left.join(right, ["kind", "group_id"])
        .where(F.col("left_key") < F.col("right_key"))
        .select(F.col("kind").alias("record_kind"), "left_key", "right_key")
        .distinct()
    )


ship(__name__)
