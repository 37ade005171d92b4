"""Basket sources and sinks."""

from basketry.sources.csv import parse_member_day, parse_retail, read_csv_baskets, read_member_day_baskets, rejected_lines
from basketry.sources.dispatch import load_baskets
from basketry.sources.sample import first_lines, sample_first
from basketry.sources.sinks import write_patterns, write_uo_list
from basketry.sources.tables import from_table
from basketry.sources.text import (
    parse_line_baskets,
    parse_utility_lines,
    read_line_baskets,
    read_utility_lines,
    with_stable_ids,
    with_tid,
)

__all__ = [
    "first_lines",
    "from_table",
    "load_baskets",
    "parse_line_baskets",
    "parse_member_day",
    "parse_retail",
    "parse_utility_lines",
    "read_csv_baskets",
    "read_line_baskets",
    "read_member_day_baskets",
    "read_utility_lines",
    "rejected_lines",
    "sample_first",
    "with_stable_ids",
    "with_tid",
    "write_patterns",
    "write_uo_list",
]
