"""Scalar column builders.

All of these return ``pyspark.sql.Column`` expressions so they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The item-token pattern of the numeric filter (F3) and the
# range of the synthetic price (D4, prices in [1, 10)).
NUMERIC_TOKEN_PATTERN = "^[0-9]+$"
HASH_PRICE_LOW = 1.0
HASH_PRICE_SPAN = 9.0


def as_col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def try_double(c) -> Column:
    """ANSI-safe string/number to double; bad input becomes null."""
    return as_col(c).try_cast("double")


def numeric_token(c) -> Column:
    """True when the token is a non-empty run of ASCII digits."""
    return as_col(c).rlike(NUMERIC_TOKEN_PATTERN)


def hash_price(item) -> Column:
    """Deterministic synthetic unit price in [1, 10).

    ``1 + 9 * u`` where ``u`` is the first 32 bits of ``md5(item)`` read as an
    unsigned integer over 2**32.  Unlike ``rand(seed)`` it does not depend on
    partitioning or row order, and any SQL engine with ``md5`` can reproduce it.
    """
    head = F.substring(F.md5(as_col(item).cast("string")), 1, 8)
    u = F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)
    return F.lit(HASH_PRICE_LOW) + F.lit(HASH_PRICE_SPAN) * u


def itemset_label(item1, item2, sep: str = ",") -> Column:
    """Display label of a pair (D9).  Comparisons use (item1, item2), not this."""
    return F.concat_ws(sep, as_col(item1), as_col(item2))


def grid_slices(n_items, split_items: int) -> Column:
    """Number of slices per side of a transaction's pair-join grid.

    ``ceil(n / split_items)``, at least 1.  A basket of up to ``split_items``
    entries is one cell; a hot basket is spread over ``S * S`` cells.
    """
    return F.greatest(
        F.lit(1), F.ceil(as_col(n_items) / F.lit(float(split_items))).cast("int")
    )
