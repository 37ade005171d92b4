"""Any table as basket lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import as_col


def _double(c) -> Column:
    return as_col(c).try_cast("double")


def from_table(
    df: DataFrame,
    tid,
    item,
    quantity=None,
    unit_price=None,
    tu=None,
    customer=None,
    seq=None,
    string_keys: bool = False,
) -> DataFrame:
    """Project a table onto the basket-lines contract.

    Each argument is a column name or a Column expression.  Keys keep their
    source type by default: a bigint key is shuffled and hashed as 8 bytes
    instead of a string.  Item order is string order everywhere; the miner
    casts the item once per (transaction, item) entry, after the duplicate
    merge.  ``string_keys=True`` casts both keys here (for outputs that sort
    by the string tid).  Numbers go through ``try_cast`` so bad values become
    null and are removed by the cleaning step instead of failing under ANSI
    mode.  A missing quantity or price is the constant 1.
    """
    key = (lambda c: as_col(c).cast("string")) if string_keys else as_col
    cols = [
        key(tid).alias("tid"),
        key(item).alias("item"),
        (_double(quantity) if quantity is not None else F.lit(1.0)).alias("quantity"),
        (_double(unit_price) if unit_price is not None else F.lit(1.0)).alias("unit_price"),
    ]
    if tu is not None:
        cols.append(_double(tu).alias("tu"))
    if customer is not None:
        cols.append(as_col(customer).cast("string").alias("customer_id"))
    if seq is not None:
        cols.append(as_col(seq).alias("seq"))
    return df.select(*cols)
