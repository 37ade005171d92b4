"""Utilities and occupancy: D1-D8, A1-A3, A14, F5, F6, J1, J2, W1.

Physical shape of ``uo_list`` (all lazy, no action except the size check of
a price catalogue):

1. entries  ``groupBy(tid, item)``  partial aggregation, shuffle on
   (tid, item): a transaction with a third of all rows still spreads over
   every reducer because the item is part of the key, and afterwards holds
   at most one entry per distinct item.
2. TU and entry count per transaction: a window over tid on those entries
   (one more shuffle, by tid, of deduplicated entries; a hot transaction is
   bounded by the item catalogue, not by its row count).

A window straight over the raw lines would save step 1's shuffle but would
put all lines of a hot transaction into one task.  Keys keep their source
type through every shuffle; items become text only in outputs.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.columns import hash_price
from basketry.operators.clean import clean_lines, exclude_items, finite_positive
from basketry.operators.sizing import HEAVY_ROWS, bounded_broadcast, keep, spread_join

if TYPE_CHECKING:
    from basketry.plans.spec import MineSpec

# Fixed value: lowest first-seen price kept by the first-seen policy.
FIRST_SEEN_FLOOR = 0.01


def mean_prices(lines: DataFrame) -> DataFrame:
    """A1: mean unit price per item -> (item, unit_profit)."""
    return lines.groupBy("item").agg(F.avg("unit_price").alias("unit_profit"))


def first_seen_prices(lines: DataFrame, floor: float | None = FIRST_SEEN_FLOOR) -> DataFrame:
    """Price of each item's first line in ``seq`` order.

    ``min_by`` is an ordinary aggregate, so it runs with partial aggregation;
    no window and no sort of the whole table.
    """
    if "seq" not in lines.columns:
        raise ValueError('price="first_seen" needs a "seq" column giving line order')
    price = F.min_by("unit_price", "seq")
    if floor is not None:
        price = F.greatest(price, F.lit(float(floor)))
    return lines.groupBy("item").agg(price.alias("unit_profit"))


def item_catalogue(lines: DataFrame, policy: str = "first_seen") -> DataFrame:
    """Distinct items with their price under a policy, and line counts."""
    if policy == "first_seen":
        price = F.greatest(F.min_by("unit_price", "seq"), F.lit(FIRST_SEEN_FLOOR))
    elif policy == "mean":
        price = F.avg("unit_price")
    else:
        raise ValueError("item_catalogue policy must be 'first_seen' or 'mean'")
    return lines.groupBy("item").agg(
        price.alias("unit_profit"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def with_catalogue_price(
    lines: DataFrame, catalogue: DataFrame, max_rows: int, holds: list | None = None, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Attach ``unit_profit`` by item.

    The catalogue has one row per distinct item with ``n_rows``, the item's rows in
    ``lines``; it is broadcast only when a count proves it small.  Else ordinary items
    are joined by shuffle, and heavy items' rows are spread by their transaction.
    """
    side, small = bounded_broadcast(catalogue, max_rows, holds)
    if small:
        return lines.join(side, on="item", how="inner").drop("n_rows")
    return spread_join(lines, side, "item", by="tid", n="n_rows", heavy_rows=heavy_rows).drop("n_rows")


def own_price(spec: MineSpec):
    """Price of a row that needs no other row, or None."""
    if spec.price == "actual":
        return F.col("unit_price")
    if spec.price == "constant":
        return F.lit(float(spec.constant_price))
    if spec.price == "hash":
        return hash_price(F.col("item").cast("string"))
    return None


def row_utility(lines: DataFrame, spec: MineSpec, holds: list | None = None) -> DataFrame:
    """Add ``util`` = quantity * price under ``spec.price``."""
    q, own = F.col("quantity"), own_price(spec)
    if own is not None:
        return lines.withColumn("util", q * own)
    cat = mean_prices(lines) if spec.price == "mean" else first_seen_prices(lines)
    counts = lines.groupBy("item").agg(F.count(F.lit(1)).alias("n_rows"))
    priced = with_catalogue_price(lines, cat.join(counts, "item"), spec.broadcast_max_rows, holds, spec.heavy_rows)
    return priced.withColumn("util", q * F.col("unit_profit")).drop("unit_profit")


def transaction_utility(util_rows: DataFrame, given: bool = False) -> DataFrame:
    """A2: (tid, tu, n_items) from rows that carry ``util`` (or ``iu``)."""
    u = "iu" if "iu" in util_rows.columns else "util"
    tu = F.max("tu") if given else F.sum(u)
    return util_rows.groupBy("tid").agg(tu.alias("tu"), F.count(F.lit(1)).alias("n_items"))


def transaction_totals(lines: DataFrame, spec: MineSpec, clean: bool = True, holds: list | None = None) -> DataFrame:
    """A2 alone: (tid, tu) under ``spec``, without the UO-list.

    One partially aggregated ``groupBy(tid)`` of row utilities, for counts and
    summaries of transactions.
    """
    given = spec.tu == "given"
    if clean:
        lines = clean_lines(lines, given_tu=given and "tu" in lines.columns)
    if spec.exclude and spec.exclude_when == "before_tu":
        lines = exclude_items(lines, spec.exclude)
    rows = lines if given else row_utility(lines, spec, holds)
    totals = rows.groupBy("tid").agg((F.max("tu") if given else F.sum("util")).alias("tu"))
    keep = finite_positive("tu")
    if spec.min_tu is not None:
        keep = keep & (F.col("tu") >= F.lit(float(spec.min_tu)))
    return totals.where(keep)


def base_entries(lines: DataFrame, *specs: MineSpec) -> DataFrame:
    """One row per (tid, item) with the sums that every price policy of ``specs`` needs.

    One scan and one shuffle of the lines, whatever the number of runs that
    ``price_entries`` then makes from it.  With kept duplicates ``mult`` counts the merged
    lines; with a given TU the row carries it.
    """
    aggs = {}
    for spec in specs:
        own = own_price(spec)
        if own is not None:
            aggs[own_sum(spec)] = F.sum(F.col("quantity") * own)
            continue
        aggs["_q"] = F.sum("quantity")
        if spec.price == "mean":
            aggs |= {"_p": F.sum("unit_price"), "_n": F.count(F.lit(1))}
        elif "seq" not in lines.columns:
            raise ValueError('price="first_seen" needs a "seq" column giving line order')
        else:
            aggs["_first"] = F.min(F.struct("seq", "unit_price"))
    if any(s.duplicates == "keep" for s in specs):
        aggs["mult"] = F.count(F.lit(1))
    if any(s.tu == "given" for s in specs):
        aggs["tu"] = F.max("tu")
    return lines.groupBy("tid", "item").agg(*[c.alias(name) for name, c in aggs.items()])


def own_sum(spec: MineSpec) -> str:
    """Name of the sum of a price that needs no other row."""
    return f"_{spec.price}" + (f"_{spec.constant_price}".replace(".", "_") if spec.price == "constant" else "")


def price_entries(base: DataFrame, spec: MineSpec, holds: list | None = None) -> DataFrame:
    """Entries ``(tid, item, iu[, mult][, tu])`` under ``spec`` from ``base_entries``.

    A price per item is taken from the entries and joined to them, never to raw lines.
    """
    kept = [c for c, on in (("mult", spec.duplicates == "keep"), ("tu", spec.tu == "given")) if on]
    if own_price(spec) is not None:
        return base.select("tid", "item", F.col(own_sum(spec)).alias("iu"), *kept)
    if spec.price == "mean":
        price = F.sum("_p") / F.sum("_n")
    else:
        price = F.greatest(F.min("_first")["unit_price"], F.lit(FIRST_SEEN_FLOOR))
    catalogue = base.groupBy("item").agg(price.alias("unit_profit"), F.count(F.lit(1)).alias("n_rows"))
    rows = base.select("tid", "item", "_q", *kept)
    priced = with_catalogue_price(rows, catalogue, spec.broadcast_max_rows, holds, spec.heavy_rows)
    return priced.select("tid", "item", (F.col("_q") * F.col("unit_profit")).alias("iu"), *kept)


def uo_entries(lines: DataFrame, spec: MineSpec, holds: list | None = None) -> DataFrame:
    """A3 without TU: one row per (tid, item) with ``iu``, the summed utility.

    With kept duplicates the row also carries ``mult``, the number of lines
    merged into it.  The kept-duplicate measures are exact functions of
    (iu, mult): m copies of i with total A and n copies of j with total B
    give m*n pair rows whose utilities add up to n*A + m*B.  So both modes
    shuffle one row per distinct (tid, item), and a large group of copies
    costs no more than one entry.

    Prices per item read the entries twice.  Column pruning would make the two reads
    different plans, so with ``holds`` the entries are held once (as ``spec.reuse`` says):
    one scan and one shuffle of the lines.
    """
    base = base_entries(lines, spec)
    if own_price(spec) is None:
        base = _held(base, spec, holds)
    return price_entries(base, spec, holds)


def _held(df: DataFrame, spec: MineSpec, holds: list | None) -> DataFrame:
    if holds is None or spec.reuse == "none":
        return df
    holds.append(keep(df, spec.reuse))
    return holds[-1]


def uo_list(
    lines: DataFrame, spec: MineSpec, clean: bool = True, holds: list | None = None, base: DataFrame | None = None
) -> DataFrame:
    """The UO-list: (tid, item, iu, tu, uo, n_items), TU > 0 only.

    ``tid`` and ``item`` keep their source types (a bigint key shuffles and
    groups as 8 bytes); the text form is produced only in outputs.
    ``n_items`` is the number of entries of the transaction before any
    after-TU exclusion; it sizes the pair-join grid.

    Each (tid, item) is one entry (kept duplicates add a ``mult`` column), so
    a transaction has at most one row per distinct item: TU and ``n_items``
    are a window over tid on the entries, with no extra aggregate and join.
    With ``tu_by="aggregate"`` TU is a ``groupBy(tid)`` of the tasks' partial totals
    instead, joined back: an ordinary transaction meets its total once, a heavy one
    (more than ``spec.heavy_rows`` entries) in as many tasks as its share asks for.

    ``base``: entries of ``base_entries`` over cleaned lines, to be used instead of ``lines``.
    """
    given = spec.tu == "given"
    if base is None:
        if clean:
            lines = clean_lines(lines, given_tu=given and "tu" in lines.columns)
        if given and "tu" not in lines.columns:
            raise ValueError('tu="given" needs a "tu" column')
    rows = lines if base is None else base
    if spec.exclude and spec.exclude_when == "before_tu":
        rows = exclude_items(rows, spec.exclude)
    entries = uo_entries(rows, spec, holds) if base is None else price_entries(rows, spec, holds)
    extra = ["mult"] if spec.duplicates == "keep" else []
    if spec.tu_by == "window":
        w = Window.partitionBy("tid")
        tu = F.max("tu").over(w) if given else F.sum("iu").over(w)
        uo = entries.select(
            "tid", "item", "iu", *extra, tu.alias("tu"), F.count(F.lit(1)).over(w).alias("n_items")
        )
    else:
        entries = _held(entries, spec, holds)
        per_tid = transaction_utility(entries, given=given)
        rows = entries.drop("tu") if given else entries
        uo = spread_join(rows, per_tid, "tid", by="item", n="n_items", heavy_rows=spec.heavy_rows)
    keep = finite_positive("tu")
    if spec.min_tu is not None:
        keep = keep & (F.col("tu") >= F.lit(float(spec.min_tu)))
    uo = uo.where(keep).select(
        "tid",
        "item",
        "iu",
        "tu",
        (F.col("iu") / F.col("tu")).alias("uo"),
        "n_items",
        *extra,
    )
    if spec.exclude and spec.exclude_when == "after_tu":
        uo = exclude_items(uo, spec.exclude)
    return uo


#: About how many ranges the items of a heavy transaction are cut into, found as 32 of 32.
RANGES = 1024


def _in_ranges(heavy: DataFrame, heavy_rows: int) -> DataFrame:
    """``heavy`` with ``_range``, the range of its transaction's items, in string order.

    A transaction is cut at its items whose hash falls on one of ``n_items / RANGES``
    values: an even, repeatable sample of about ``RANGES`` of them, whatever its size.
    """
    item = F.col("item").cast("string")
    every = F.greatest(F.lit(1), F.ceil(F.col("n_items") / F.lit(float(RANGES))))
    cut = F.when(F.pmod(F.xxhash64(item), every) == 0, item)
    cuts = heavy.groupBy("tid").agg(F.sort_array(F.collect_list(cut)).alias("_fine"), F.count(F.lit(1)).alias("_n"))
    cuts = cuts.withColumn("_coarse", F.filter("_fine", lambda x, k: k % 32 == 31))
    rows = spread_join(heavy, cuts, "tid", by="item", n="_n", heavy_rows=heavy_rows)
    at = F.size(F.filter("_coarse", lambda x: x <= item)) * 32
    place = at + F.size(F.filter(F.slice("_fine", at + 1, F.lit(32)), lambda x: x <= item))
    return rows.withColumn("_range", place).drop("_fine", "_coarse", "_n")


def remaining_occupancy(uo: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Share of the transaction held by the items after ``item``.

    ``ruo(i, t) = sum of uo(j, t) over items j > i`` (string order), 0 for the
    last item.  Runs as a window over tid in descending item order, where the
    items after it are a growing frame, summed once; the same frame written
    as "following" rows would be summed anew for every row.

    A transaction of more than ``heavy_rows`` entries (``n_items``) is cut into ranges of
    items: the window runs inside a range, and the sums of the ranges after it, a
    prefix sum over about ``RANGES`` rows, are joined back.
    """
    text = F.col("item").cast("string").desc()

    def after(*by):
        frame = Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("uo").over(frame), F.lit(0.0))

    heavy = uo.where(F.col("n_items") > heavy_rows)
    rows = _in_ranges(heavy, heavy_rows)
    sums = rows.groupBy("tid", "_range").agg(F.sum("uo").alias("uo"))
    sums = sums.select("tid", "_range", after("tid", F.col("_range").desc()).alias("_later"))
    # Pinned to a shuffle on (tid, range): a broadcast would leave a transaction where it is.
    rows = rows.hint("merge").join(sums, ["tid", "_range"])
    rows = rows.withColumn("ruo", after("tid", "_range", text) + F.col("_later")).drop("_range", "_later")
    ordinary = uo.where(F.col("n_items") <= heavy_rows).withColumn("ruo", after("tid", text))
    return ordinary.unionByName(rows)
