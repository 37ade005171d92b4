"""Comparing two pattern results: U1-U4, C1.

The reference collects both pattern sets to the driver as Python sets; here
the sets stay distributed and are compared with one grouping by their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_KEYS = ("item1", "item2")


def pattern_set(df: DataFrame, keys=PAIR_KEYS) -> DataFrame:
    """U4: the distinct pattern keys of a result."""
    return df.select(*keys).distinct()


def common_patterns(a: DataFrame, b: DataFrame, keys=PAIR_KEYS) -> DataFrame:
    """Patterns in both results."""
    return pattern_set(a, keys).intersect(pattern_set(b, keys))


def any_patterns(a: DataFrame, b: DataFrame, keys=PAIR_KEYS) -> DataFrame:
    """Patterns in either result."""
    return pattern_set(a, keys).union(pattern_set(b, keys)).distinct()


def aligned(a: DataFrame, b: DataFrame, keys=PAIR_KEYS) -> DataFrame:
    """Both key sets side by side: (keys..., in_left, in_right).

    ``only_left`` / ``only_right`` are filters of this frame.
    """
    left = a.select(*keys, F.lit(True).alias("in_left"), F.lit(False).alias("in_right"))
    right = b.select(*keys, F.lit(False).alias("in_left"), F.lit(True).alias("in_right"))
    both = left.union(right).groupBy(*keys)
    return both.agg(F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right"))


def compare(a: DataFrame, b: DataFrame, keys=PAIR_KEYS) -> DataFrame:
    """One row (n_left, n_right, n_common, n_any, jaccard).

    Jaccard is |common| / |any|, and 0 when both results are empty.
    """
    j = aligned(a, b, keys)
    agg = j.agg(
        F.count(F.when(F.col("in_left"), 1)).alias("n_left"),
        F.count(F.when(F.col("in_right"), 1)).alias("n_right"),
        F.count(F.when(F.col("in_left") & F.col("in_right"), 1)).alias("n_common"),
        F.count(F.lit(1)).alias("n_any"),
    )
    return agg.withColumn(
        "jaccard",
        F.when(F.col("n_any") > 0, F.col("n_common") / F.col("n_any")).otherwise(F.lit(0.0)),
    )


def only_left(a: DataFrame, b: DataFrame, keys=PAIR_KEYS) -> DataFrame:
    """Patterns found by the left run only (the except direction of U3)."""
    j = aligned(a, b, keys)
    return j.where(F.col("in_left") & ~F.col("in_right")).select(*keys)


def only_right(a: DataFrame, b: DataFrame, keys=PAIR_KEYS) -> DataFrame:
    """Patterns found by the right run only."""
    j = aligned(a, b, keys)
    return j.where(F.col("in_right") & ~F.col("in_left")).select(*keys)
