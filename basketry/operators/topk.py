"""Ordered views: K1, K2, K5 (limits here are the feature: top-k reports)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_pairs(pairs: DataFrame, k: int = 20) -> DataFrame:
    """K1: k pairs with the highest total utility; ties by item1, item2."""
    return pairs.orderBy(F.desc("total_util"), "item1", "item2").limit(k)


def top_singles(singles: DataFrame, k: int = 20) -> DataFrame:
    """K2: k items with the highest total utility; ties by item."""
    return singles.orderBy(F.desc("total_util"), "item").limit(k)


def uo_head(uo: DataFrame, k: int = 20) -> DataFrame:
    """K5: a repeatable head of the UO-list (by tid, then item)."""
    return uo.orderBy("tid", "item").limit(k)
