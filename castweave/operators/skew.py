"""Eager aggregation: per-key results that stay evenly spread when a few keys hold most rows.

Both inputs of a join are first reduced to one compact state per join key. Spark runs that
reduction map-side, so a key with a third of all rows reaches the shuffle as at most one row
per map task. The states are then joined (one row per key on either side, never rows times
rows), and the aggregates of the joined rows follow algebraically:

* rows of the join         = left count * right count
* sum of a left column     = left sum * right count (and the other way round)
* min / max                = unchanged where the other side has a row

Values that do not combine by addition (distinct counts) are reduced in two levels: first to
(key, value), which spreads a hot key over its values, then to the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a table's rows from which a key counts as hot.
HOT_SHARE = 0.02
#: A key with more than one row in so many is joined apart, in frames of at least ``SPLIT_FROM`` rows.
HOT_PARTS = 256
SPLIT_FROM = 200_000


def key_state(
    df: DataFrame,
    key: str | Column,
    prefix: str,
    sums: Sequence[str] = (),
    mins: Sequence[str] = (),
    maxs: Sequence[str] = (),
) -> DataFrame:
    """One row per key: ``key``, ``<prefix>_n`` and the asked sums, minima and maxima.

    Null keys form a state of their own (``key`` null). Sums ignore nulls and are null where
    a key has none but nulls; an empty input gives no rows.
    """
    col = F.col(key) if isinstance(key, str) else key
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_n")]
    aggs += [F.sum(c).alias(f"{prefix}_sum_{c}") for c in sums]
    aggs += [F.min(c).alias(f"{prefix}_min_{c}") for c in mins]
    aggs += [F.max(c).alias(f"{prefix}_max_{c}") for c in maxs]
    return df.groupBy(col.alias("key")).agg(*aggs)


def join_states(left: DataFrame, right: DataFrame, l: str, r: str, how: str = "inner") -> DataFrame:
    """Join the :func:`key_state` frames of prefixes ``l`` and ``r``; ``n`` counts the plain join's rows.

    Sums of one side are multiplied by the other side's count, as the plain join repeats them.
    With ``how='left'`` a key without partner keeps its rows once, as an outer join does.
    Null keys never match (SQL equality).
    """
    times_l = F.coalesce(F.col(f"{l}_n"), F.lit(1))
    times_r = F.coalesce(F.col(f"{r}_n"), F.lit(1))
    joined = left.join(right.withColumnRenamed("key", "_r"), F.col("key") == F.col("_r"), how).drop("_r")
    sums = {c: F.col(c) * times_r for c in left.columns if c.startswith(f"{l}_sum_")}
    sums |= {c: F.col(c) * times_l for c in right.columns if c.startswith(f"{r}_sum_")}
    return joined.withColumns(sums | {"n": times_l * times_r})


def distinct_per_key(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Distinct non-null values per key in two levels; a hot key is spread over its values."""
    pairs = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.lit(1).alias("_one"))
    return pairs.groupBy(F.col(key).alias("key")).agg(F.count("_one").alias(name))


def hot_values(rows: DataFrame, key: str) -> list:
    """Values of ``key`` with at least 1/``HOT_PARTS`` of the rows (so at most ``HOT_PARTS``); none in small frames."""
    total = rows.count()
    if total < SPLIT_FROM:
        return []
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counted.where(F.col("_n") * HOT_PARTS >= total).select(key).collect()]


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join ``rows`` with ``lookup`` (one row per ``key``) where one key may hold any share of ``rows``.

    The ``hot`` keys (by default those of :func:`hot_values`, for which ``rows`` should be cut) are
    joined by broadcast, which has a bound whatever the size of either side; all others by shuffle.
    ``how`` is ``inner`` or ``left``; null keys match nothing.
    """
    hot = hot_values(rows, key) if hot is None else hot
    if not hot:
        return rows.join(lookup, key, how)
    warm = F.coalesce(F.col(key).isin(hot), F.lit(False))
    some = rows.where(warm).join(F.broadcast(lookup.where(F.col(key).isin(hot))), key, how)
    return some.unionByName(rows.where(~warm).join(lookup, key, how))


def hot_keys(state: DataFrame, count_col: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys of a compact state that hold at least ``share`` of all rows (null keys count as rows only).

    The total is rolled up from the states, one row per key, and not from the table again.
    """
    total = state.agg(F.sum(count_col)).scalar()
    return state.where(F.col("key").isNotNull() & (F.col(count_col) >= F.lit(share) * total))


def joined_rows(fact: DataFrame, fact_key: str, group: str, dimension: DataFrame, key: str) -> DataFrame:
    """Rows of ``fact LEFT JOIN dimension`` per value of ``group``: ``key``, ``n``.

    Both inputs are reduced by the join key first (the fact by group as well), the states are
    joined, counts multiplied, and the products rolled up. A fact without partner counts once;
    a dimension key held twice counts twice, as the join does.
    """
    left = fact.groupBy(F.col(fact_key).alias("_k"), F.col(group).alias("key")).agg(F.count(F.lit(1)).alias("_l"))
    right = dimension.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_r"))
    times = left.join(right, "_k", "left").withColumn("_n", F.col("_l") * F.coalesce("_r", F.lit(1)))
    return times.groupBy("key").agg(F.sum("_n").alias("n"))


def found_hot(episode: DataFrame, podcast: DataFrame, metric: DataFrame, canonical: DataFrame) -> DataFrame:
    """Hot podcast_id values of ``episode`` and hot guest_appearances values of the metric table.

    Episodes go through the eager join with their show and metric rows through the eager join with
    their entity, so the counts are those of the joined rows (show ids and entity ids are unique);
    repeats included, null keys left out.
    """
    parts = [
        ("podcast_id", joined_rows(episode, "podcast_id", "podcast_id", podcast, "id")),
        ("guest_appearances", joined_rows(metric, "canonical_id", "guest_appearances", canonical, "am_entity_id")),
    ]
    by_show, by_count = (
        hot_keys(state, "n").select(F.lit(field).alias("key_field"), F.col("key").cast("long").alias("key_value"))
        for field, state in parts
    )
    return by_show.unionByName(by_count)
