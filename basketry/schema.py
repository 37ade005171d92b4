"""Declared schemas and the basket-lines contract.

Every loader returns a DataFrame with at least the columns of ``BASKET_LINES``.
Optional columns keep their meaning throughout the library:

* ``tu``          transaction utility read from the source (``MineSpec(tu="given")``)
* ``customer_id`` carried for reporting only
* ``seq``         any orderable value giving file / table order, needed by the
                  first-seen price policy

``tid`` and ``item`` may be any atomic type: loaders from text give strings,
``from_table`` keeps the source type unless ``string_keys=True``.  Item order
is always the order of the item's text.  The schemas below show text keys;
the UO-list keeps the source types, and results (singles, pairs) always have
text items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BASKET_LINES = T.StructType(
    [
        T.StructField("tid", T.StringType(), True),
        T.StructField("item", T.StringType(), True),
        T.StructField("quantity", T.DoubleType(), True),
        T.StructField("unit_price", T.DoubleType(), True),
    ]
)


def require_columns(df: DataFrame, columns, what: str = "input") -> DataFrame:
    """Raise ``ValueError`` naming every missing column (F11); return ``df``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(
            f"{what} is missing required column(s) {missing}; has {df.columns}"
        )
    return df


def require_basket_lines(df: DataFrame) -> DataFrame:
    return require_columns(df, BASKET_LINES.fieldNames(), "basket lines")
