"""The first N transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def sample_first(df: DataFrame, n: int, by="tid") -> DataFrame:
    """Rows of the ``n`` smallest transactions in ``by`` order.

    ``by`` is a column name or a list of names; ties share the order of the
    full key.  The key list is a distributed top-n (``orderBy().limit(n)``
    plans as TakeOrderedAndProject), then a semi-join, broadcast because the
    limit bounds it to ``n`` rows.  The limit is the feature here, not a shortcut.
    """
    keys = [by] if isinstance(by, str) else list(by)
    if "tid" not in keys:
        keys = keys + ["tid"]
    first = df.select(*keys).distinct().orderBy(*keys).limit(n).select("tid")
    return df.join(F.broadcast(first), on="tid", how="left_semi")


def first_lines(df: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """Line files: the ``n`` first physical lines, before blank or bad lines
    are skipped (apply to the raw text frame after ``with_tid``)."""
    first = df.select(order).orderBy(order).limit(n)
    return df.join(F.broadcast(first), on=order, how="left_semi")
