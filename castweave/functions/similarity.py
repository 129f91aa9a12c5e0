"""String similarities that Spark has no expression for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType

from castweave.runtime import ship


def sequence_ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio on six places; not symmetric, so the order of the two matters."""
    return round(SequenceMatcher(None, a or "", b or "").ratio(), 6)


def osa_distance(a: str | None, b: str | None) -> int:
    """Edit distance in which an adjacent swap costs one (restricted form)."""
    a, b = a or "", b or ""
    if a == b:
        return 0
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            step = min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                step = min(step, older[j - 1] + 1)
            row.append(step)
        older, last = last, row
    return last[-1]


def osa_similarity(a: str | None, b: str | None) -> float:
    a, b = a or "", b or ""
    longest = max(len(a), len(b))
    return 1.0 if not longest else 0.0 if not a or not b else round(1 - osa_distance(a, b) / longest, 6)


def match_score(a: str | None, b: str | None) -> float:
    """Better of the ratios of two normalised names as they are and with their words sorted."""
    direct = SequenceMatcher(None, a or "", b or "").ratio()
    in_order = SequenceMatcher(None, " ".join(sorted((a or "").split())), " ".join(sorted((b or "").split()))).ratio()
    return max(direct, in_order)


def _lift(function, kind: DataType):
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x, y) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(apply, kind)


seq_ratio = _lift(sequence_ratio, DoubleType())
osa = _lift(osa_distance, IntegerType())
osa_sim = _lift(osa_similarity, DoubleType())
name_match_score = _lift(match_score, DoubleType())

ship(__name__)
