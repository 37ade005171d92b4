"""Load a basket source by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basketry.sources.csv import read_csv_baskets, read_member_day_baskets
from basketry.sources.text import read_line_baskets, read_utility_lines

# Source kinds and the loader each maps to.
LOADERS = {
    "retail": read_csv_baskets,
    "member_day": read_member_day_baskets,
    "lines": read_line_baskets,
    "utility_lines": read_utility_lines,
}

# Dataset names of the reference runs, folded to a source kind.
ALIASES = {
    "online_retail": "retail",
    "onlineretail": "retail",
    "grocery": "member_day",
    "groceries": "member_day",
    "kosarak": "lines",
    "chess": "utility_lines",
    "mushroom": "utility_lines",
    "mushrooms": "utility_lines",
    "foodmart": "utility_lines",
}


def load_baskets(spark, kind: str, path: str, **opts) -> DataFrame:
    """Basket lines from ``path`` with the loader for ``kind`` (case-folded).

    Unknown kinds raise ``ValueError``.  ``path`` is any Hadoop-FS URI (S7).
    """
    key = kind.strip().lower()
    key = ALIASES.get(key, key)
    if key not in LOADERS:
        known = sorted(set(LOADERS) | set(ALIASES))
        raise ValueError(f"unknown basket source {kind!r}; known: {known}")
    return LOADERS[key](spark, path, **opts)
