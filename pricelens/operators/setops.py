"""Union, distinct, sort and top-n."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_rank


def consolidate(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns missing in a frame become NULL."""
    if not frames:
        raise ValueError("nothing to consolidate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_pairs(df: DataFrame, a: str = "Province", b: str = "City") -> DataFrame:
    """Distinct (a, b) pairs."""
    return df.select(a, b).dropDuplicates()


def sort_desc(df: DataFrame, by: str, tiebreak: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """O1: order by ``by`` descending (ties by ``tiebreak`` ascending) and
    expose the position as a ``rank`` column so that results stay
    order-insensitive; the ranking is distributed (no single-task window)."""
    order = [F.col(by).desc_nulls_last()] + [F.col(c).asc() for c in tiebreak]
    return global_rank(df, order, name)


def top_n(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """O2: the first ``n`` distinct values of ``key`` in ascending order
    (Spark plans this as a distributed take-ordered)."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n)
