"""The mining plan and its policy spec."""

from basketry.plans.mine import MineResult, candidates, mine, mine_many, mine_together
from basketry.plans.spec import RETAIL_DENYLIST, MineSpec, actual_price, mean_price_gated

__all__ = ["MineResult", "MineSpec", "RETAIL_DENYLIST", "candidates", "actual_price", "mean_price_gated", "mine", "mine_many", "mine_together"]
