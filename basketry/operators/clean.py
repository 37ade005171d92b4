"""Row filters on basket lines: F1-F4, F9, J4, J5, A10."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.columns import numeric_token
from basketry.operators.sizing import bounded_broadcast


def drop_incomplete(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """drop rows with a null in any key column."""
    cols = list(columns) if columns is not None else ["tid", "item", "quantity", "unit_price"]
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    # Explicit IS NOT NULL conjuncts (not dropna's atleastnnonnulls) so each
    # check can be pushed into the Parquet scan.
    cond = F.col(cols[0]).isNotNull()
    for c in cols[1:]:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def keep_positive(df: DataFrame) -> DataFrame:
    """quantity > 0 and unit_price > 0, both finite numbers.

    NaN sorts above every number in Spark, so ``> 0`` alone would keep it;
    one upper bound removes NaN and infinity (and reaches the scan too).
    """
    return df.where(finite_positive("quantity") & finite_positive("unit_price"))


def finite_positive(column: str):
    """Condition: a number above zero that is neither NaN nor infinite."""
    return (F.col(column) > 0) & (F.col(column) < F.lit(float("inf")))


def _is_string(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _as_text(df: DataFrame, column: str):
    c = F.col(column)
    return c if _is_string(df, column) else c.cast("string")


def drop_blank_items(df: DataFrame) -> DataFrame:
    """an empty token is not an item (only text items can be blank)."""
    if not _is_string(df, "item"):
        return df
    return df.where(F.length(F.col("item")) > 0)


def clean_lines(df: DataFrame, given_tu: bool = False) -> DataFrame:
    """F1 + F2 + F9 in one step; Catalyst pushes the null and range checks
    into the Parquet scan when the lines come straight from a table.

    ``given_tu``: the ``tu`` column will be used, so lines without it go too;
    a computed TU does not need the column, whatever it holds.
    """
    required = ["tid", "item", "quantity", "unit_price"] + (["tu"] if given_tu else [])
    return drop_blank_items(keep_positive(drop_incomplete(df, required)))


def keep_numeric_items(df: DataFrame, column: str = "item") -> DataFrame:
    """keep rows whose item is a run of digits."""
    return df.where(numeric_token(_as_text(df, column)))


def exclude_items(
    df: DataFrame, items, column: str = "item", max_rows: int = 1_000_000, holds: list | None = None
) -> DataFrame:
    """Drop denylisted items.

    A literal list becomes ``NOT IN`` (a fixed, bounded set); a DataFrame of
    items becomes a ``left_anti`` join, broadcast only after its size is
    checked.
    """
    if isinstance(items, DataFrame):
        side, _ = bounded_broadcast(items.select(F.col(items.columns[0]).alias(column)).distinct(), max_rows, holds)
        return df.join(side, on=column, how="left_anti")
    items = list(items)
    if not items:
        return df
    # Items are compared as text, so a numeric item column never has to
    # cast a denylist word (which would fail under ANSI mode).
    return df.where(~_as_text(df, column).isin(items))


def keep_items(
    df: DataFrame, items, column: str = "item", max_rows: int = 1_000_000, holds: list | None = None
) -> DataFrame:
    """Keep rows whose item is in ``items`` (a DataFrame or a list)."""
    if isinstance(items, DataFrame):
        side, _ = bounded_broadcast(items.select(F.col(items.columns[0]).alias(column)).distinct(), max_rows, holds)
        return df.join(side, on=column, how="left_semi")
    return df.where(_as_text(df, column).isin(list(items)))


def merge_duplicates(df: DataFrame) -> DataFrame:
    """A10: one line per (tid, item), quantities and line utilities summed.

    ``unit_price`` becomes the quantity-weighted price, so that
    ``quantity * unit_price`` equals the summed line utility.
    """
    agg = df.groupBy("tid", "item").agg(
        F.sum("quantity").alias("quantity"),
        F.sum(F.col("quantity") * F.col("unit_price")).alias("_value"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    return agg.select(
        "tid",
        "item",
        "quantity",
        (F.col("_value") / F.col("quantity")).alias("unit_price"),
        "n_lines",
    )
