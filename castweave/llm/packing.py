"""Filling fixed-capacity containers with documents measured in tokens.

Best fit in bulk-synchronous rounds. Documents and the gaps of open containers are range-sorted
together by size, and every gap takes the largest document before it that is still free: read as
brackets, each gap closes the nearest open document, which is its best fit. The sweep runs in all
ranges at once; what a range can't close within itself is settled between ranges by rank: ranges
tell how many gaps and documents are left over, these counts are matched like brackets again, and
the left-over rows meet by the ranks so found. Then gaps are updated and the next round begins.
Where even the largest document fits a gap several times, the gap takes several at once. When no
gap is left for a document, as many containers are opened as the remaining tokens fill.

The driver sees sums and two counts per range; documents, gaps and placements are tables. A size
that a third of all documents share is split over ranges by hash.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castweave.runtime import cut, ship

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows that one range of a sweep holds.
RANGE_ROWS = 20_000


def load_encoding(path: str):
    """The tokenizer of a rank file; special tokens' strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``key`` and ``n_tokens`` of every row; null and empty texts have 0 tokens.

    The tokenizer's file is sent to the executors, which need no copy of their own.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(SparkFiles.get(name))
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "n_tokens": [len(encoding.encode_ordinary(t or "")) for t in batch[text]]})

    kind = dict(documents.dtypes)[key]
    # Keys travel as text, so that nulls don't turn whole numbers into floats on the way.
    slim = documents.select(F.col(key).cast("string").alias(key), text)
    return slim.mapInPandas(count, f"`{key}` string, n_tokens long").withColumn(key, F.col(key).cast(kind))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Close the brackets of one range: pairs, gaps left over (by rank) and documents left over (by place on the stack)."""
    columns = ["role", "key", "part", "n_tokens", "value", "cid", "pid", "pos"]
    pid, open_, gaps = TaskContext.get().partitionId(), [], 0
    for batch in batches:
        rows = []
        for key, part, tokens, value, cid in zip(*(batch[c].tolist() for c in ("key", "part", "n_tokens", "value", "cid")), strict=True):
            if cid < 0:
                open_.append((key, part, tokens, value))
            elif open_:
                rows.append(("pair", *open_.pop(), cid, pid, 0))
            else:
                rows.append(("gap", None, 0, 0, value, cid, pid, gaps))
                gaps += 1
        yield pd.DataFrame(rows, columns=columns)
    yield pd.DataFrame([("doc", *d, -1, pid, pos) for pos, d in enumerate(open_)], columns=columns)


def between_ranges(left: dict[int, tuple[int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Match what ranges left over, ``pid -> (gaps, documents)``: intervals and the documents still left per range.

    An interval ``(gap range, first rank, end rank, document range, top)`` gives the gap of rank r the
    document at place ``top - (r - first rank)``.
    """
    stack: list[list[int]] = []
    intervals = []
    for pid in sorted(left):
        gaps, docs = left[pid]
        rank = 0
        while rank < gaps and stack:
            owner, many = stack[-1]
            take = min(many, gaps - rank)
            intervals.append((pid, rank, rank + take, owner, many - 1))
            rank += take
            stack[-1][1] -= take
            if not stack[-1][1]:
                stack.pop()
        if docs:
            stack.append([pid, docs])
    return intervals, dict(map(tuple, stack))


def sweep_round(spark: SparkSession, docs: DataFrame, slots: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(placed, left): one maximal best-fit matching of ``docs`` with ``slots``."""
    both = docs.select("key", "part", "n_tokens", "value", F.lit(-1).cast("long").alias("cid")).unionByName(
        slots.select(F.lit(None).cast("string").alias("key"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("n_tokens"), "value", "cid")
    )
    # Documents come before gaps of their size; equal ones in hash order, so that any size can be split.
    order = ["value", F.col("cid") >= 0, F.xxhash64("key", "part", "cid")]
    ranged = both.repartitionByRange(rows // RANGE_ROWS + 1, *order).sortWithinPartitions(*order)
    schema = "role string, key string, part int, n_tokens long, value long, cid long, pid int, pos long"
    swept = cut(ranged.mapInPandas(_sweep, schema))
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    left = swept.where("role <> 'pair'").groupBy("pid").agg(count("gap").alias("g"), count("doc").alias("d"))
    intervals, rest = between_ranges({r["pid"]: (r["g"], r["d"]) for r in left.collect()})  # two counts per range
    pairs = swept.where("role = 'pair'").select("key", "part", "n_tokens", "value", "cid")
    loose = swept.where("role = 'doc'")
    if intervals:
        table = F.broadcast(spark.createDataFrame(intervals, "pid int, lo long, hi long, owner int, top long"))
        gaps = swept.where("role = 'gap'").join(table, "pid").where("pos >= lo AND pos < hi")
        gaps = gaps.select("cid", F.col("owner").alias("pid"), (F.col("top") - (F.col("pos") - F.col("lo"))).alias("pos"))
        pairs = pairs.unionByName(loose.drop("cid").join(gaps, ["pid", "pos"]).select("key", "part", "n_tokens", "value", "cid"))
    if not rest:
        return pairs, loose.where("false").select("key", "part", "n_tokens", "value")
    still = F.broadcast(spark.createDataFrame(list(rest.items()), "pid int, still long"))
    return pairs, loose.join(still, "pid").where("pos < still").select("key", "part", "n_tokens", "value")


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``key, part, n_tokens, container_id``: every row of ``sizes`` in containers of ``capacity``.

    A row larger than the capacity is cut into parts of the capacity, each filling a container
    (negative ids), and a rest that is packed like any other document; all others stay whole as
    part 0. Rows of size 0 (empty texts) or null size take one unit, so that containers hold a
    bounded number of rows. Equal sizes are told apart by ``key``; an empty input gives no rows.
    """
    spark, kind = sizes.sparkSession, dict(sizes.dtypes)[key]
    whole = F.coalesce(F.col(size), F.lit(0)).cast("long")
    items = sizes.select(F.col(key).cast("string").alias("key"), F.greatest(whole, F.lit(1)).alias("_n"), whole.alias("_true"))
    cuts = F.floor((F.col("_n") - 1) / F.lit(capacity)).cast("int")
    parts = items.select("key", "_n", "_true", F.explode(F.sequence(F.lit(0), cuts)).alias("part"))
    used = F.least(F.lit(capacity), F.col("_n") - F.col("part") * capacity)
    parts = parts.select("key", "part", used.alias("value"), F.least(used, F.col("_true")).alias("n_tokens"))
    # Full containers need no round: each is numbered by the row it holds, once and for all by the cut.
    parts = cut(parts.withColumn("cid", -1 - F.monotonically_increasing_id()))
    placed = [parts.where(F.col("value") == capacity).select("key", "part", "n_tokens", "cid")]
    docs = parts.where(F.col("value") < capacity).select("key", "part", "n_tokens", "value")
    gaps = spark.range(0).select(F.col("id").alias("cid"), F.col("id").alias("gap"))
    opened = 0
    while True:
        sums = docs.agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"),
            F.count(F.when(F.col("value") * 2 > capacity, 1)).alias("big"),
        ).first()
        if not sums["n"]:
            break
        fitting = gaps.where(F.col("gap") >= sums["lo"])
        many, widest = fitting.agg(F.count(F.lit(1)), F.max("gap")).first()
        if not many or widest < sums["lo"]:
            more = max(-(-sums["total"] // capacity), sums["big"])
            fresh = spark.range(opened, opened + more).select(F.col("id").alias("cid"), F.lit(capacity).cast("long").alias("gap"))
            opened, gaps = opened + more, gaps.unionByName(fresh)
            continue
        # As many slots as the largest document fits a gap, but no more in all than twice the documents and gaps.
        at_once = max(1, -(-2 * sums["n"] // many))
        slots = F.least(F.lit(at_once), F.greatest(F.lit(1), F.floor(F.col("gap") / sums["hi"]))).cast("int")
        each = fitting.select("cid", F.col("gap").alias("value"), F.explode(F.sequence(F.lit(1), slots)).alias("_slot")).drop("_slot")
        pairs, docs = sweep_round(spark, docs, each, sums["n"] + many)
        pairs = cut(pairs)
        placed.append(pairs.select("key", "part", "n_tokens", "cid"))
        taken = pairs.groupBy("cid").agg(F.sum("value").alias("taken"))
        gaps = gaps.join(taken, "cid", "left").select("cid", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap"))
        gaps = cut(gaps.where("gap > 0"))
    every = placed[0]
    for part in placed[1:]:
        every = every.unionByName(part)
    return every.select(F.col("key").cast(kind).alias(key), "part", "n_tokens", F.col("cid").alias("container_id"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Documents by ``doc_id`` and ``text`` in containers of ``capacity`` tokens of a public tokenizer."""
    return pack(token_counts(documents, "doc_id", "text", tokenizer), "doc_id", "n_tokens", capacity)


ship(__name__)
