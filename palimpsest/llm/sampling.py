"""Bounded samples by hash order, taken without ordering or gathering the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAST, _SPAN = -(1 << 63), 1 << 64


def below(hash_: Column, share: float) -> Column:
    """True for about `share` of all hashes: the smallest ones."""
    return hash_ <= F.lit(min((1 << 63) - 1, _LEAST + int(share * _SPAN)))


def ample(n: int, total: int) -> float:
    """A share of `total` rows that holds the n smallest hashes with room to spare."""
    return 1.0 if total <= 2 * n else min(1.0, (1.5 * n + 200) / total)


def smallest(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows of `df` with the smallest hash of `keys`, in that order; no more than about 1.5 n rows are moved for it."""
    order = F.xxhash64(*keys)
    total = df.count()
    return df.where(below(order, ample(n, total))).orderBy(order, *keys).limit(n)
