"""``MineSpec``: every policy of the mining operator in one place.

The reference scripts differ from each other in the choices below; here each
is an explicit field instead of a separate code path.

price
    ``"actual"``      row utility = quantity * unit_price
    ``"mean"``        quantity * mean unit_price of the item
    ``"constant"``    quantity * ``constant_price``
    ``"hash"``        quantity * deterministic price in [1, 10) from md5(item)
    ``"first_seen"``  quantity * unit_price of the item's first line by ``seq``
tu
    ``"computed"``    TU = sum of row utilities of the transaction
    ``"given"``       TU read from the ``tu`` column of the lines
exclude, exclude_when
    items removed from the result; ``"after_tu"`` keeps them in the TU
    denominator (Spark scripts), ``"before_tu"`` removes them first (Python)
duplicates
    ``"sum"``  repeated lines of an item in a transaction are one entry
    ``"keep"`` each line is its own entry; a repeated pair counts m*n times
prune
    ``"none"``    every co-occurring pair is measured
    ``"winners"`` pairs only of size-1 winners (lossy, reference parity)
    ``"exact"``   pairs only of items whose upper bounds reach the thresholds
                  (no false dismissals; both duplicate modes)
    ``"bounds"``  as ``"exact"``, and of their pairs only those whose own upper
                  bounds, from buckets of pairs, a bounded number, reach them
                  (no false dismissals; pairs are generated twice, but only
                  few are shuffled)
min_tu
    optional TU floor on top of ``TU > 0``
split_items
    transactions with at most this many entries pair on the UO-list's tid
    partitioning with no exchange; larger ones take the grid join over
    ``S * S`` cells, ``S = ceil(n / split_items)``; results do not change
broadcast_max_rows
    a small side (price catalogue, winners, item lists) is broadcast only when
    one aggregate proves it is at most this many rows (and 256 MB); otherwise
    it is joined by shuffle.  0 disables these broadcasts and their eager
    checks: ``mine`` then runs no job until the caller's action
tu_by
    ``"window"``    TU and basket size from a window over tid on the
                    deduplicated entries (one basket's distinct items in a
                    task; no extra join)
    ``"aggregate"`` a partially aggregated ``groupBy(tid)`` joined back, which
                    spreads a heavy basket; for
                    catalogues so large that one basket's distinct items
                    should not sit in one task.
heavy_rows
    entries of one item or transaction above which a join spreads them over
    several tasks; results do not change
reuse
    how the UO-list, read by both the size-1 and size-2 steps, is kept:
    ``"persist"`` (MEMORY_AND_DISK), ``"checkpoint"`` (reliable, in the
    session's ``spark.checkpoint.dir``) or ``"none"`` (recompute)
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from basketry.operators.sizing import HEAVY_ROWS

PRICES = ("actual", "mean", "constant", "hash", "first_seen")
TUS = ("computed", "given")
EXCLUDE_WHEN = ("after_tu", "before_tu")
DUPLICATES = ("sum", "keep")
PRUNES = ("none", "winners", "exact", "bounds")
REUSES = ("persist", "checkpoint", "none")
TU_BY = ("window", "aggregate")

# The item denylist of the retail runs.
RETAIL_DENYLIST = ("M", "POST", "BANK CHARGES", "DOT", "ADJUST", "C2", "AMAZONFEE")


@dataclass(frozen=True)
class MineSpec:
    min_util: float
    min_uo_single: float
    min_uo_pair: float | None = None
    price: str = "actual"
    constant_price: float = 1.0
    tu: str = "computed"
    exclude: tuple = field(default_factory=tuple)
    exclude_when: str = "after_tu"
    duplicates: str = "sum"
    prune: str = "none"
    min_tu: float | None = None
    split_items: int = 4096
    broadcast_max_rows: int = 1_000_000
    reuse: str = "persist"
    tu_by: str = "window"
    heavy_rows: int = HEAVY_ROWS

    def __post_init__(self):
        for name, value, allowed in (
            ("price", self.price, PRICES),
            ("tu", self.tu, TUS),
            ("exclude_when", self.exclude_when, EXCLUDE_WHEN),
            ("duplicates", self.duplicates, DUPLICATES),
            ("prune", self.prune, PRUNES),
            ("reuse", self.reuse, REUSES),
            ("tu_by", self.tu_by, TU_BY),
        ):
            if value not in allowed:
                raise ValueError(f"MineSpec.{name}={value!r}; expected one of {allowed}")
        if self.split_items < 1:
            raise ValueError("split_items must be >= 1")
        if self.heavy_rows < 1:
            raise ValueError("heavy_rows must be >= 1")
        object.__setattr__(self, "exclude", tuple(self.exclude))

    @property
    def pair_uo(self) -> float:
        return self.min_uo_single if self.min_uo_pair is None else self.min_uo_pair

    def with_(self, **changes) -> "MineSpec":
        return replace(self, **changes)


def mean_price_gated(min_util, min_uo_single, min_uo_pair=None, **kw) -> MineSpec:
    """Mean price, pairs gated by size-1 winners (M1)."""
    return MineSpec(min_util, min_uo_single, min_uo_pair, price="mean", prune="winners", **kw)


def actual_price(min_util, min_uo, gated: bool = True, **kw) -> MineSpec:
    """Actual price; gated (M3) or, as in the retail script, ungated (M2)."""
    return MineSpec(
        min_util, min_uo, min_uo, price="actual", prune="winners" if gated else "none", **kw
    )
