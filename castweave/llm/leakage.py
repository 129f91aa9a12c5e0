"""Evaluation passages inside a training corpus, found with a distributed positional inverted index.

1. Items and documents are cut into terms of three adjacent words. The corpus is read once: of its
   terms those are stored, with their positions, that may occur in a test item. What is sent to
   the tasks for that is a bit map of the items' terms whose size has a fixed bound; more items
   only let more foreign terms pass, which the joins on the exact term remove.
2. The stored postings give the document frequency of every item term. Terms the corpus lacks are
   left out first, then the rarest of every stretch of an item are looked up, and their lists,
   adjusted by the offset within the item, are intersected per document and item. Documents with
   several terms that few items have are candidates as well.
3. Candidates are matched in full: exact runs are chained in order, with penalties for words of
   the item that are missing between them, which bridges light edits and inserted matter but not
   the shared frame of two sentences made alike. Short or widely parted passages are decided by
   the words carried alone, counting only parts that have a term few items have.

Postings, frequencies, candidates and matches are tables; nothing of documents or items is
collected, and all joins are on terms or on document and item.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castweave.runtime import cut, ship

MIN_WORDS = 20
TERM = 3
STRETCH, STEP, RAREST = 8, 4, 4
BREAK_COST, ITEM_GAP_COST, DOC_GAP_COST, DOC_GAP_MAX = 1.0, 2.0, 0.02, 60
LEAST_SCORE = 18.5
OWN_ITEMS, OWN_TERMS, EDIT_GAP, ITEM_GAP_MAX = 2, 4, 2, 8
SPREAD = 8
#: The bit map has at most 2 ** MAP_BITS bits (8 MB), and at least 2 ** 16.
MAP_BITS = 26
#: Tables with a row per item term are sent to all tasks up to so many rows (about 32 MB); beyond, the postings are
#: exchanged by term instead.
SEND_ROWS = 1_000_000
# Characters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "абвгеикмнорстухѕіјԁɡһӏοαεικνρτυχ",
    "a6breиkmhopctyxsijdghloaeikvptux",
)
_HIDDEN = re.compile("[̀-ͯ­​-‏⁠﻿︎️]+")
_OTHER_SCRIPT = re.compile("[ɐ-ʯͰ-ԯ]")
_TAGS = re.compile(r"</?[a-z][^<>]{0,40}>")
_DASHES = re.compile(r"[–—…]+")
_SIGNS = re.compile(r"[^\w\s]+|_+")


def words(text: str | None) -> list[str]:
    """Words in lower case without marks, hidden characters, tags, look-alikes and signs."""
    if not text:
        return []
    text = text.lower()
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if not text.isascii():
        text = _DASHES.sub(" ", _HIDDEN.sub("", unicodedata.normalize("NFKD", text)))
        if _OTHER_SCRIPT.search(text):
            text = text.translate(LOOKALIKES)
    text = text.replace("/", " ").replace("|", " ")
    return _SIGNS.sub("", text).split()


def term_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, position) of every term of the tokenised ``texts``, 64 bits, the same on every machine."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = [w for t in texts for w in t]
    if len(flat) < TERM:
        none = np.empty(0, np.int64)
        return none, none, none
    hashed = pd.util.hash_array(np.array(flat, dtype=object))
    # Odd multipliers.
    a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    term = hashed[:-2] * a + hashed[1:-1] * b + hashed[2:] * c
    term ^= term >> np.uint64(29)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[:-2] == owner[2:]
    starts = np.cumsum(sizes) - sizes
    owner = owner[:-2][inside]
    return term[inside].view(np.int64), owner, np.flatnonzero(inside) - starts[owner]


def _split(values: np.ndarray, owner: np.ndarray, many: int) -> list[np.ndarray]:
    return np.split(values, np.searchsorted(owner, np.arange(1, many)))


def item_table(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id, iid, terms`` of every item of at least ``MIN_WORDS`` words; ``iid`` tells rows of one id apart."""

    def cut_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [words(t) for t in batch["text"]]
            keep = np.array([len(t) >= MIN_WORDS for t in tokens], dtype=bool)
            batch, tokens = batch[keep], [t for t in tokens if len(t) >= MIN_WORDS]
            term, owner, _ = term_hashes(tokens)
            batch["terms"] = _split(term, owner, len(tokens)) if tokens else []
            yield batch[["item_id", "iid", "terms"]]

    slim = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item_id).cast("long").alias("item_id"), F.xxhash64(item_id, text).alias("iid"), F.col(text).alias("text")
    )
    return slim.distinct().mapInPandas(cut_terms, "item_id long, iid long, terms array<long>")


def term_map(terms: DataFrame) -> tuple[np.ndarray, int]:
    """Bit map of the distinct ``term`` column, by the top bits of a term, and how many bits are looked at."""
    terms = terms.select("term").distinct()
    bits = min(MAP_BITS, max(16, (32 * terms.count()).bit_length()))
    at = F.expr(f"shiftrightunsigned(term, {64 - bits})")
    cells = terms.groupBy(F.shiftright(at, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - bits}) & 63 AS int))")).alias("mask"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    for row in cells.toLocalIterator():  # at most 2 ** (MAP_BITS - 6) rows
        table[row["cell"]] = np.uint64(row["mask"] & 0xFFFFFFFFFFFFFFFF)
    return table, bits


def posting_table(documents: DataFrame, doc_id: str, text: str, table: np.ndarray, bits: int) -> DataFrame:
    """``doc_id, uid, terms, places``: a document's terms that the bit map lets pass, with their word positions.

    ``uid`` tells texts of one id apart; a repeated row is kept once, a document without such terms not at all.
    """
    sent = documents.sparkSession.sparkContext.broadcast(table)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            tokens = [words(t) for t in batch["text"]]
            term, owner, place = term_hashes(tokens)
            top = term.view(np.uint64) >> np.uint64(64 - bits)
            passed = (known[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))) & np.uint64(1) == 1
            term, owner, place = term[passed], owner[passed], place[passed]
            batch = batch[["doc_id", "uid"]]
            batch["terms"] = _split(term, owner, len(tokens))
            batch["places"] = _split(place.astype(np.int32), owner, len(tokens))
            yield batch[np.bincount(owner, minlength=len(tokens)) > 0]

    slim = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("uid"), F.col(text).alias("text")
    )
    found = slim.mapInPandas(index, "doc_id long, uid long, terms array<long>, places array<int>")
    return found.dropDuplicates(["doc_id", "uid"])


def _pick_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rarest terms of every stretch of an item, among those the corpus has."""
    for batch in batches:
        rows = []
        for iid, terms, frequency in zip(batch["iid"], batch["terms"], batch["df"], strict=True):
            frequency = np.asarray(frequency)
            seeds = set()
            for a in range(0, max(1, len(terms) - STRETCH + STEP), STEP):
                here = a + np.flatnonzero(frequency[a : a + STRETCH])
                seeds.update(here[np.argsort(frequency[here], kind="stable")[:RAREST]].tolist())
            rows += [(iid, s, terms[s]) for s in sorted(seeds)]
        yield pd.DataFrame(rows, columns=["iid", "seed", "term"])


def best_chain(runs: list[tuple[int, int, int]]) -> tuple[float, int, int]:
    """(score, words carried, words matched) of the best chain of ``(doc start, item start, words)`` runs.

    Words carried are the item's words from the chain's first to its last, without gaps above two.
    """
    runs = sorted(runs)
    reach = DOC_GAP_MAX + max((n for _, _, n in runs), default=0)
    score = [float(n) for _, _, n in runs]
    carried = [n for _, _, n in runs]
    matched = [n for _, _, n in runs]
    for j, (dj, ij, nj) in enumerate(runs):
        for k in range(j - 1, -1, -1):
            dk, ik, nk = runs[k]
            if dj - dk > reach:
                break
            item_gap, doc_gap = ij - (ik + nk), dj - (dk + nk)
            lap = max(0, -item_gap, -doc_gap)
            if lap >= nj or ij <= ik or dj <= dk or doc_gap > DOC_GAP_MAX or item_gap > ITEM_GAP_MAX:
                continue
            cost = BREAK_COST + ITEM_GAP_COST * max(0, item_gap) + DOC_GAP_COST * max(0, doc_gap)
            total = score[k] + nj - lap - cost
            if total > score[j]:
                score[j] = total
                carried[j] = carried[k] + nj - lap + (item_gap if 0 < item_gap <= 2 else 0)
                matched[j] = matched[k] + nj - lap
    best = max(range(len(runs)), key=lambda j: score[j], default=None)
    return (score[best], carried[best], matched[best]) if best is not None else (0.0, 0, 0)


def own_chain(runs: list[tuple[int, int, int]], own: np.ndarray) -> tuple[int, int]:
    """(words carried, words matched) of the chain that carries most, whatever lies between its parts in the document.

    Runs with at most ``EDIT_GAP`` words between them form parts; a part of at least ``SPREAD`` words counts
    if one of its runs has a term that few items have (``own``, by item position). Shorter parts far
    from each other are no passage: long documents gather an item's phrases by chance.
    """
    parts, near = [], []  # near: parts that a run can still go on from
    for run in sorted(runs):
        d, i, n = run
        near = [p for p in near if d - p[2] <= EDIT_GAP]
        best = (d, i, d + n, i + n, n, n, bool(own[i : i + n - TERM + 1].any()))
        for start, item, end, stop, carried, matched, has in near:
            lap = max(0, stop - i, end - d)
            if lap < n and i > item and d > start and i - stop <= EDIT_GAP and d - end <= EDIT_GAP:
                gap, more = max(0, i - stop), n - lap
                best = max(best, (start, item, d + n, i + n, carried + gap + more, matched + more, has or best[6]), key=lambda x: (x[4], x[6]))
        near.append(best)
        if best[6] and best[4] >= SPREAD:
            parts.append(best)
    # Parts in the order of their starts; those that have ended before are known by where they end in the item.
    parts.sort()
    ending = sorted(range(len(parts)), key=lambda k: parts[k][2])
    ended: dict[int, tuple[int, int]] = {}
    totals: list[tuple[int, int]] = []
    done = 0
    for d, i, _, _, carried, matched, _ in parts:
        while done < len(ending) and parts[ending[done]][2] <= d:
            k = ending[done]
            ended[parts[k][3]] = max(ended.get(parts[k][3], (0, 0)), totals[k])
            done += 1
        more = max((ended.get(i - gap, (0, 0)) for gap in range(ITEM_GAP_MAX + 1)), default=(0, 0))
        totals.append((more[0] + carried, more[1] + matched))
    return max(totals, default=(0, 0))


def _runs(terms: np.ndarray, where: np.ndarray, places: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """Maximal runs of equal words between a document (terms at positions) and an item (positions by term)."""
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for term, position in zip(terms.tolist(), where.tolist(), strict=True):
        for item_position in places.get(term, ()):
            by_diagonal[position - item_position].append(position)
    runs = []
    for diagonal, positions in by_diagonal.items():
        start = last = positions[0]
        for p in positions[1:]:
            if p != last + 1:
                runs.append((start, start - diagonal, last - start + TERM))
                start = p
            last = p
        runs.append((start, start - diagonal, last - start + TERM))
    return runs


def match(terms: np.ndarray, where: np.ndarray, places: dict[int, list[int]], own: np.ndarray) -> tuple[int, int] | None:
    """(words carried, words matched) where a document carries an item, else None."""
    runs = _runs(terms, where, places)
    score, carried, matched = best_chain(runs)
    if score >= LEAST_SCORE and carried >= MIN_WORDS:
        return carried, matched
    starts = {i + k for _, i, n in runs for k in range(n - TERM + 1)}
    if sum(bool(own[i]) for i in starts) < OWN_TERMS:
        return None
    carried, matched = own_chain(runs, own)
    return (carried, matched) if carried >= MIN_WORDS else None


def _match_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[int, tuple[dict[int, list[int]], np.ndarray]] = {}
    for batch in batches:
        rows = []
        columns = (batch[c] for c in ("doc_id", "item_id", "iid", "terms", "places", "item_terms", "own"))
        for doc, item, iid, terms, places, item_terms, own in zip(*columns, strict=True):
            if iid not in known:
                if len(known) > 5_000:
                    known.clear()
                at = defaultdict(list)
                for position, term in enumerate(item_terms.tolist()):
                    at[term].append(position)
                known[iid] = dict(at), np.asarray(own, dtype=bool)
            if found := match(terms, places, *known[iid]):
                rows.append((doc, item, *found))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words_carried", "words_matched"])


def find_leaks(
    documents: DataFrame, doc_id: str, text: str, eval_item: DataFrame, item_id: str, item_text: str
) -> DataFrame:
    """``doc_id, item_id, words_carried, words_matched`` of every document that carries an item's words.

    A document carries an item if at least ``MIN_WORDS`` of its words appear in order. Null and
    short texts match nothing; repeated documents are reported each; rows without id are left out;
    empty tables give no rows.
    """
    items = cut(item_table(eval_item, item_id, item_text))
    item_terms = items.select("iid", F.xxhash64("terms").alias("same"), F.posexplode("terms").alias("at", "term"))
    postings = cut(posting_table(documents, doc_id, text, *term_map(item_terms)))
    # Frequency of every term in the corpus, and in how many different items it is.
    in_corpus = postings.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    in_items = item_terms.groupBy("term").agg((F.countDistinct("same") <= OWN_ITEMS).alias("own"))
    known = item_terms.join(in_items, "term").join(in_corpus, "term", "left").groupBy("iid").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("df", F.lit(0)).alias("df"), "own"))).alias("x")
    )
    items = cut(items.join(known, "iid").select("item_id", "iid", "terms", "x.df", "x.own"))
    # Offset-adjusted lists of the rarest terms: at least three must meet in a document, spread over the item.
    seeds = items.mapInPandas(_pick_seeds, "iid long, seed int, term long")
    small = item_terms.count() <= SEND_ROWS
    send = F.broadcast if small else lambda df: df
    # Partitioned by document once: hits are joined with the seeds and counted where their document lies.
    placed = postings.repartition("doc_id", "uid")
    hit = placed.select("doc_id", "uid", F.explode(F.arrays_zip("terms", "places")).alias("p"))
    hit = hit.select("doc_id", "uid", F.col("p.terms").alias("term"), F.col("p.places").alias("place"))
    # Zones overlap with the next, so that what is near always shares one.
    zone = F.floor((F.col("place") - F.col("seed")) / DOC_GAP_MAX).cast("int")
    zones = hit.join(send(seeds), "term").select("doc_id", "uid", "iid", "seed", F.explode(F.array(zone, zone + 1)).alias("zone"))
    met = zones.groupBy("doc_id", "uid", "iid", "zone").agg(
        F.count(F.lit(1)).alias("n"), F.min("seed").alias("lo"), F.max("seed").alias("hi")
    )
    met = met.where((F.col("n") > 2) & (F.col("hi") - F.col("lo") >= SPREAD)).select("doc_id", "uid", "iid")
    # Terms few items have, however far apart.
    own = items.select("iid", F.explode(F.arrays_zip("terms", "own")).alias("t")).where("t.own").select("iid", "t.terms").distinct()
    owned = placed.select("doc_id", "uid", F.explode(F.array_distinct("terms")).alias("terms")).join(send(own), "terms")
    owned = owned.groupBy("doc_id", "uid", "iid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OWN_TERMS)
    candidates = met.unionByName(owned.select("doc_id", "uid", "iid")).distinct()
    full = candidates.join(postings, ["doc_id", "uid"]).join(
        items.select("item_id", "iid", F.col("terms").alias("item_terms"), "own"), "iid"
    )
    found = full.mapInPandas(_match_batches, "doc_id long, item_id long, words_carried int, words_matched int")
    return found.groupBy("doc_id", "item_id").agg(F.max("words_carried").alias("words_carried"), F.max("words_matched").alias("words_matched"))


ship(__name__)
