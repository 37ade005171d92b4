"""Column expressions used across the library (all JVM-side, no UDFs)."""

from basketry.functions.columns import (
    as_col,
    hash_price,
    itemset_label,
    numeric_token,
    grid_slices,
    try_double,
)

__all__ = [
    "as_col",
    "hash_price",
    "itemset_label",
    "numeric_token",
    "grid_slices",
    "try_double",
]
