"""basketry: size-1 and size-2 high-utility-occupancy patterns on Spark.

All operators take and return DataFrames and stay on the JVM (no UDFs).
"""

from basketry.operators.compare import aligned, any_patterns, common_patterns, compare, only_left, only_right
from basketry.operators.metrics import run_metrics, tagged
from basketry.operators.profile import (
    basket_items,
    basket_lists,
    dense_numbers,
    distinct_transactions,
    item_support,
    merged_transactions,
    pair_cooccurrence,
    pair_tid_bitmaps,
    pattern_counts,
    profile,
    transaction_sketch,
    tu_mismatch,
    tu_summary,
)
from basketry.operators.patterns import pair_row_count, pair_rows, pairs, singles
from basketry.operators.topk import top_pairs, top_singles, uo_head
from basketry.operators.utility import item_catalogue, remaining_occupancy, row_utility, uo_list
from basketry.plans import RETAIL_DENYLIST, MineResult, MineSpec, actual_price, mean_price_gated, mine, mine_many, mine_together
from basketry.sources import from_table, load_baskets, rejected_lines, sample_first, with_stable_ids, write_patterns, write_uo_list

__all__ = [
    "MineResult",
    "MineSpec",
    "RETAIL_DENYLIST",
    "actual_price",
    "aligned",
    "any_patterns",
    "basket_items",
    "basket_lists",
    "common_patterns",
    "compare",
    "dense_numbers",
    "distinct_transactions",
    "from_table",
    "item_catalogue",
    "item_support",
    "load_baskets",
    "mean_price_gated",
    "merged_transactions",
    "mine",
    "mine_many",
    "mine_together",
    "only_left",
    "only_right",
    "pair_cooccurrence",
    "pair_row_count",
    "pair_rows",
    "pair_tid_bitmaps",
    "pairs",
    "pattern_counts",
    "profile",
    "rejected_lines",
    "remaining_occupancy",
    "row_utility",
    "run_metrics",
    "sample_first",
    "singles",
    "tagged",
    "top_pairs",
    "top_singles",
    "transaction_sketch",
    "tu_mismatch",
    "tu_summary",
    "uo_head",
    "uo_list",
    "with_stable_ids",
    "write_patterns",
    "write_uo_list",
]
