"""Size-1 and size-2 pattern measures: A4, A5, A7, J3, J4, F7, F8, D9, §4.3.

Items keep their source type inside the plan: pairs are generated with
``item1 < item2`` in the items' own order and aggregated on those keys (two
bigints for integer item ids, not two strings).  The measures are symmetric,
so only the output labels need string order: ``orient`` turns each key pair
into ``(least, greatest)`` of the text forms at the end.

Pair generation is the expensive step: a transaction with ``n`` entries yields
``n(n-1)/2`` pair rows.  The self-join is therefore keyed on a grid cell
``(tid, a, b)``: a transaction with more than ``split_items`` entries gets
``S = ceil(n / split_items)`` slices, and each entry has a slice
``h = hash(item) mod S``.  On the left an entry goes to the cells ``(h, b)``
for every ``b``; on the right to the cells ``(a, h)`` for every ``a``.  Two
entries i, j meet in exactly one cell, ``(h(i), h(j))``, so every pair is
produced once, and no cell holds more than about ``split_items**2``
candidates however large the transaction.  Ordinary transactions (at most
``split_items`` entries) skip the grid: they join on tid alone, reusing the
UO-list's tid partitioning with no exchange.  The pair aggregate then runs
with map-side partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.columns import itemset_label, grid_slices


def as_text(df: DataFrame, column: str = "item") -> DataFrame:
    """The item column as text (output form)."""
    return df.withColumn(column, F.col(column).cast("string"))


def orient(df: DataFrame) -> DataFrame:
    """Pair keys as text in string order: item1 = least, item2 = greatest."""
    s1 = F.col("item1").cast("string")
    s2 = F.col("item2").cast("string")
    return df.withColumn("_s1", s1).withColumn("_s2", s2).withColumn(
        "item1", F.least("_s1", "_s2")
    ).withColumn("item2", F.greatest("_s1", "_s2")).drop("_s1", "_s2")


def singles(uo: DataFrame) -> DataFrame:
    """A4: (item, total_util, avg_uo, support) over all entries of each item
    (item in its source type; ``as_text`` for output).

    With kept duplicates (``mult``) every merged line counts as an entry:
    support is the sum of ``mult`` and the occupancy average is taken over
    those lines (their utilities add up to ``iu``).
    """
    if "mult" in uo.columns:
        return uo.groupBy("item").agg(
            F.sum("iu").alias("total_util"),
            (F.sum("uo") / F.sum("mult")).alias("avg_uo"),
            F.sum("mult").alias("support"),
        )
    return uo.groupBy("item").agg(
        F.sum("iu").alias("total_util"),
        F.avg("uo").alias("avg_uo"),
        F.count(F.lit(1)).alias("support"),
    )


def _threshold(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def keep_rule(df: DataFrame, min_util: float | Column, min_uo: float | Column) -> DataFrame:
    """both thresholds, both inclusive."""
    return df.where((F.col("total_util") >= _threshold(min_util)) & (F.col("avg_uo") >= _threshold(min_uo)))


def pair_rows(uo: DataFrame, split_items: int = 4096, keep_cells: bool = False) -> DataFrame:
    """One row per co-occurrence (tid, item1 < item2) with both utilities.

    ``uo`` needs tid, item, iu, tu and n_items.  ``item1 < item2`` in the
    items' own type order; ``orient`` gives the string-ordered labels.

    Transactions of at most ``split_items`` entries (all of ``n_items``, so a
    transaction never straddles the two paths) join on tid alone: the
    UO-list is already hash-partitioned and sorted by tid, so that join needs
    no exchange at all.  Larger transactions take the grid join on
    ``(tid, cell_a, cell_b)``.  ``keep_cells`` keeps the cell columns (0, 0 on
    the local path) for inspection.  Both paths are always planned, without
    a job to look which one has rows; AQE drops the empty one's shuffles.
    """
    small = uo.where(F.col("n_items") <= F.lit(split_items))
    hot = uo.where(F.col("n_items") > F.lit(split_items))
    local = _local_pair_rows(small, "mult" in uo.columns)
    if keep_cells:
        local = local.withColumn("cell_a", F.lit(0)).withColumn("cell_b", F.lit(0))
    return local.unionByName(_grid_pair_rows(hot, split_items, keep_cells))


def _local_pair_rows(small: DataFrame, kept: bool) -> DataFrame:
    m1 = [F.col("mult").alias("mult1")] if kept else []
    m2 = [F.col("mult").alias("mult2")] if kept else []
    return (
        small.select("tid", F.col("item").alias("item1"), F.col("iu").alias("iu1"), *m1, "tu")
        .join(small.select("tid", F.col("item").alias("item2"), F.col("iu").alias("iu2"), *m2), on="tid", how="inner")
        .where(F.col("item1") < F.col("item2"))
    )


def _grid_pair_rows(uo: DataFrame, split_items: int, keep_cells: bool) -> DataFrame:
    # The UO-list holds a transaction in one partition: spread its entries over
    # the tasks before each of them is copied to a row of cells.
    uo = uo.repartition("tid", "item")
    s = grid_slices(F.col("n_items"), split_items)
    own = F.pmod(F.xxhash64("item"), s.cast("long")).cast("int")
    every = F.explode(F.sequence(F.lit(0), s - F.lit(1)))
    m1 = [F.col("mult").alias("mult1")] if "mult" in uo.columns else []
    m2 = [F.col("mult").alias("mult2")] if "mult" in uo.columns else []
    left = uo.select(
        "tid",
        F.col("item").alias("item1"),
        F.col("iu").alias("iu1"),
        *m1,
        "tu",
        own.alias("cell_a"),
        every.alias("cell_b"),
    )
    right = uo.select(
        "tid",
        F.col("item").alias("item2"),
        F.col("iu").alias("iu2"),
        *m2,
        every.alias("cell_a"),
        own.alias("cell_b"),
    )
    # The grid only spreads work if both sides are shuffled on the cell keys.
    # A broadcast join would keep the streamed side where it is, and the
    # UO-list holds a whole transaction in one tid partition, so the grid
    # join is pinned to a shuffled sort-merge join.
    rows = left.hint("merge").join(right, on=["tid", "cell_a", "cell_b"], how="inner").where(
        F.col("item1") < F.col("item2")
    )
    return rows if keep_cells else rows.drop("cell_a", "cell_b")


#: Buckets of the pair bounds whose numbers are broadcast; more are broadcast as bits.
PAIR_BUCKETS = 1 << 20
#: Bits of the marks of pairs at most, 64 MB in blocks of 16 words (about 90 MB of rows, which a driver holds
#: up to three times when it sends them); beyond, more rows pass the test.
MARK_BITS = 1 << 29
_WORDS = 16
_BITS = 64 * _WORDS
# Sums in another order differ in the last digits; the bounds are wider by this share.
SLACK = 1 + 1e-9


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("item1", "item2"), F.lit(buckets)).cast("int")


def pair_buckets(
    cand: DataFrame, min_util: float, min_uo: float, split_items: int = 4096, buckets: int = PAIR_BUCKETS
) -> DataFrame:
    """Buckets of pairs whose bounds reach both thresholds -> (bucket).

    Every co-occurring pair falls into one of ``buckets`` by hash.  The summed utility
    of a bucket bounds the total of each of its pairs, and its greatest occupancy bounds
    their averages.  A pair is tested before it is measured: the aggregate
    by bucket shuffles at most ``buckets`` rows of a task, where the measures
    shuffle one row per distinct pair.  The idea is the hash filter of Park, Chen and Yu
    (1995), with utilities in place of counts.
    """
    rows = _bound_rows(cand, split_items)
    bounds = rows.groupBy(_bucket(buckets).alias("bucket")).agg(F.sum("util").alias("util"), F.max("occ").alias("occ"))
    return bounds.where(_reaches("util", min_util) & _reaches("occ", min_uo)).select("bucket")


def pair_marks(cand: DataFrame, min_util: float, min_uo: float, split_items: int, buckets: int) -> DataFrame:
    """``pair_buckets`` as bits -> (_block, _marks), for any number of buckets up to ``MARK_BITS``.

    With about as many buckets as pairs an aggregate by bucket would shuffle a row of each pair.  So the occupancies set
    bits first, and only utilities of the buckets that a pair row reaches ``min_uo`` in are summed.
    """
    rows = _bound_rows(cand, split_items)
    reached = _bucket_marks(rows.where(_reaches("occ", min_uo)).select(_bucket(buckets).alias("bucket")))
    sums = in_buckets(rows, reached, buckets).groupBy(_bucket(buckets).alias("bucket")).agg(F.sum("util").alias("util"))
    return _bucket_marks(sums.where(_reaches("util", min_util)).select("bucket"))


def _bound_rows(cand: DataFrame, split_items: int) -> DataFrame:
    """Pair rows with their utility and occupancy."""
    rows = pair_rows(cand, split_items)
    if "mult1" in rows.columns:
        util = F.col("mult2") * F.col("iu1") + F.col("mult1") * F.col("iu2")
        occ = (F.col("iu1") / F.col("mult1") + F.col("iu2") / F.col("mult2")) / F.col("tu")
    else:
        util = F.col("iu1") + F.col("iu2")
        occ = util / F.col("tu")
    return rows.select("item1", "item2", util.alias("util"), occ.alias("occ"))


def _reaches(bound: str, least: float) -> Column:
    return F.col(bound) * SLACK >= F.lit(float(least))


def _words(spots: DataFrame) -> DataFrame:
    """``(_block, _at)`` as one row a block with its bits, sixteen words."""
    word, bit = F.shiftright("_at", 6), F.expr("shiftleft(1L, _at % 64)")
    words = [F.coalesce(F.bit_or(F.when(word == k, bit)), F.lit(0).cast("long")) for k in range(_WORDS)]
    return spots.repartition("_block").groupBy("_block").agg(F.array(*words).alias("_marks"))


def _bucket_marks(buckets: DataFrame) -> DataFrame:
    at = F.col("bucket")
    return _words(buckets.select(F.floor(at / _BITS).cast("long").alias("_block"), (at % _BITS).cast("int").alias("_at")))


def in_buckets(rows: DataFrame, kept: DataFrame, buckets: int = PAIR_BUCKETS, mark: str | None = None) -> DataFrame:
    """Pair rows of the kept buckets, numbers or bits; their number bounds the broadcast.  With ``mark`` all
    rows, with a column of that name that tells which these are."""
    rows = rows.withColumn("bucket", _bucket(buckets))
    if "_marks" in kept.columns:
        at = F.col("bucket") % _BITS
        held = F.getbit(F.get("_marks", F.floor(at / 64).cast("int")), at % 64) == 1
        met = (F.floor(F.col("bucket") / _BITS).cast("long") == F.col("_block")) & held  # a block has one row
    else:
        kept = kept.withColumnRenamed("bucket", "_block")
        met = F.col("bucket") == F.col("_block")
    if mark is None:
        return rows.join(F.broadcast(kept), met, "left_semi").drop("bucket")
    return rows.join(F.broadcast(kept), met, "left").withColumn(mark, F.col("_block").isNotNull()).drop("bucket", *kept.columns)


def pairs(cand: DataFrame, split_items: int = 4096, kept: DataFrame | None = None, buckets: int = PAIR_BUCKETS) -> DataFrame:
    """A5 + D9: (item1, item2, total_util, avg_uo, support, itemset).

    With ``kept``, of ``pair_buckets`` or ``pair_marks``, only pairs of these buckets are measured.
    """
    rows = pair_rows(cand, split_items)
    if kept is not None:
        rows = in_buckets(rows, kept, buckets)
    if "mult1" in rows.columns:
        # m copies of i (total A) and n of j (total B): m*n pair rows whose
        # utilities add up to n*A + m*B.
        both = F.col("mult2") * F.col("iu1") + F.col("mult1") * F.col("iu2")
        count = F.col("mult1") * F.col("mult2")
        agg = rows.groupBy("item1", "item2").agg(
            F.sum(both).alias("total_util"),
            (F.sum(both / F.col("tu")) / F.sum(count)).alias("avg_uo"),
            F.sum(count).alias("support"),
        )
    else:
        both = F.col("iu1") + F.col("iu2")
        agg = rows.groupBy("item1", "item2").agg(
            F.sum(both).alias("total_util"),
            (F.sum(both / F.col("tu")) / F.count(F.lit(1))).alias("avg_uo"),
            F.count(F.lit(1)).alias("support"),
        )
    return orient(agg).withColumn("itemset", itemset_label("item1", "item2")).select(
        "item1", "item2", "total_util", "avg_uo", "support", "itemset"
    )


def _per_copy(uo: DataFrame) -> Column:
    """Occupancy of one copy of an entry; a pair's mean occupancy in a transaction is the sum of two."""
    return (F.col("iu") / F.col("mult") if "mult" in uo.columns else F.col("iu")) / F.col("tu")


def _reaching_pairs(hot: DataFrame, least: float, split_items: int) -> DataFrame:
    """(item1 < item2) of the pairs whose occupancy in a transaction of ``hot`` reaches ``least``.

    One of the two has at least half of it, and a transaction, whose occupancies add up to
    1, has at most ``2 / least`` such entries.  Only these are joined with the others, on a grid
    of few slices of them by ``n_items / split_items`` slices of all: work linear in the entries.
    """
    uo = hot.withColumn("occ", _per_copy(hot)).repartition("tid", "item")
    s2 = grid_slices(F.col("n_items"), split_items)
    s1 = F.least(s2, F.lit(min(2.0 / least / split_items, 1e6)).cast("int") + 1)
    place = lambda s: F.pmod(F.xxhash64("item"), s.cast("long")).cast("int")
    every = lambda s: F.explode(F.sequence(F.lit(0), s - F.lit(1)))
    big = uo.where(F.col("occ") >= F.lit(least / 2))
    big = big.select("tid", F.col("item").alias("a"), F.col("occ").alias("occ1"), place(s1).alias("cell_a"), every(s2).alias("cell_b"))
    other = uo.select("tid", F.col("item").alias("b"), F.col("occ").alias("occ2"), every(s1).alias("cell_a"), place(s2).alias("cell_b"))
    met = big.hint("merge").join(other, on=["tid", "cell_a", "cell_b"], how="inner")
    # Two such entries meet twice, once from each side.
    once = (F.col("a") != F.col("b")) & ((F.col("occ2") < F.lit(least / 2)) | (F.col("a") < F.col("b")))
    met = met.where(once & (F.col("occ1") + F.col("occ2") >= F.lit(least)))
    return met.select(F.least("a", "b").alias("item1"), F.greatest("a", "b").alias("item2")).distinct()


#: Pair rows of ordinary transactions from which they are tested before the aggregate.
TEST_PAIRS = 4_000_000

def _tested(rows: DataFrame, parts: list[DataFrame], hot_pairs: DataFrame, least: float | Column, test_pairs: int) -> DataFrame:
    """``rows`` of ordinary transactions without those of pairs that reach ``least`` in no transaction.

    Such a pair does not reach it in the mean.  Of a pair that does, one entry has half of ``least``
    at least: these entries meet the others of their transaction, and every pair that reaches it sets the bit of its
    hash.  A row whose bit is not set is left out before the aggregate shuffles it; other pairs with the same
    bit only cost rows.  There are two bits for a pair that can reach it, so the share of rows that
    pass does not grow.  Few pairs, or as many that can reach it, are not tested: the one
    block of number -1 lets all pass.  ``least`` may differ by transaction.
    """
    least, n = F.lit(least) - 1e-5, F.col("n_items") - 1  # quotients of decimals are rounded in the measures
    entries = [p.withColumns({c: F.col(c).cast("double") for c in ("iu", "tu")}).withColumns({"occ": _per_copy(p), "_least": least}) for p in parts]
    half = F.col("occ") >= F.col("_least") / 2
    size = reduce(DataFrame.unionByName, [p.select("n_items", "occ", "_least") for p in entries]).agg(
        (F.sum(n) / 2).alias("pairs"), F.sum(F.when(half, n)).alias("most")
    )
    blocks = F.least(F.ceil(F.col("most") / (32 * _WORDS)) + 1, F.lit(MARK_BITS // _BITS))
    worth = (F.col("pairs") >= F.lit(test_pairs)) & (F.coalesce("most", F.lit(0)) <= F.col("pairs"))
    blocks = size.select(F.when(worth, F.coalesce(blocks, F.lit(1))).cast("long")).scalar()
    reached = hot_pairs.where(blocks.isNotNull())
    for p in entries:
        big = p.where(half & blocks.isNotNull()).select("tid", F.col("item").alias("a"), F.col("occ").alias("occ1"), "_least")
        met = big.join(p.select("tid", F.col("item").alias("b"), F.col("occ").alias("occ2")), "tid")
        met = met.where((F.col("a") != F.col("b")) & (F.col("occ1") + F.col("occ2") >= F.col("_least")))
        reached = reached.unionByName(met.select(F.least("a", "b").alias("item1"), F.greatest("a", "b").alias("item2")))

    h, bits = F.xxhash64("item1", "item2"), _BITS
    place = F.pmod(h, blocks * bits)
    spots = reached.select(F.floor(place / bits).cast("long").alias("_block"), (place % bits).cast("int").alias("_at"))
    marks = _words(spots)
    every = rows.sparkSession.range(1).where(blocks.isNull()).select(F.lit(-1).cast("long").alias("_block"), F.array_repeat(F.lit(-1).cast("long"), _WORDS).alias("_marks"))
    marks = F.broadcast(marks.unionByName(every))  # bounded by MARK_BITS
    place = F.coalesce(place, F.lit(-bits).cast("long"))
    rows = rows.withColumn("_own", F.floor(place / bits).cast("long")).withColumn("_at", F.pmod(place, F.lit(bits)).cast("int"))
    held = F.getbit(F.get("_marks", F.shiftright("_at", 6)), F.col("_at") % 64) == 1
    return rows.join(marks, (F.col("_own") == F.col("_block")) & held).drop("_own", "_at", "_block", "_marks")  # a block has one row


def pairs_reaching(
    cand: DataFrame | list[DataFrame], min_uo: float, split_items: int = 4096, test_pairs: int | None = None, tid_uo: Column | None = None
) -> DataFrame:
    """The rows of ``pairs`` whose ``avg_uo`` can reach ``min_uo``, measured over all transactions.

    ``cand`` may come in parts, each transaction whole in one of them: united entries would be shuffled anew.

    A pair whose mean occupancy reaches ``min_uo`` reaches it in the mean of its
    ordinary transactions (at most ``split_items`` entries) or in some larger one.
    Ordinary transactions are joined with themselves on tid, and their pairs measured; with ``test_pairs``,
    from that many pair rows on, only pairs that reach it in some transaction (``_tested``).  The
    entries are then read four times more, so they should be held.  ``tid_uo``: what the pairs of a
    transaction must reach in that test, by ``tid``, where runs with other thresholds share the plan.
    Of the larger ones only pairs that reach ``min_uo`` in one of them are listed
    (``_reaching_pairs``).  These, and the ordinary pairs that reach it, look up their entries in
    the larger transactions, so no large transaction's pairs are all made.
    """
    parts = cand if isinstance(cand, list) else [cand]
    kept = "mult" in parts[0].columns
    least = float(min_uo) / SLACK
    m = ["mult"] if kept else []
    united = lambda frames: reduce(DataFrame.unionByName, frames)
    hot = united([p.where(F.col("n_items") > F.lit(split_items)) for p in parts])
    util, count = _pair_util(kept)
    small = [p.where(F.col("n_items") <= F.lit(split_items)) for p in parts]
    rows = united([_local_pair_rows(p, kept) for p in small])
    hot_pairs = _reaching_pairs(hot, least, split_items)
    if test_pairs is not None:
        rows = _tested(rows, small, hot_pairs, least if tid_uo is None else tid_uo / SLACK, test_pairs)
    rows = rows.select("item1", "item2", util.alias("util"), (util / F.col("tu")).alias("occ"), count.alias("n"))
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("util", "occ", "n")]
    rows = rows.unionByName(hot_pairs.select("item1", "item2", *empty))
    met = rows.groupBy("item1", "item2").agg(
        F.sum("util").alias("util"), F.sum("occ").alias("occ"), F.sum("n").alias("n"), F.max(F.col("n").isNull()).alias("listed")
    )
    met = met.where(F.col("listed") | (F.col("occ") / F.col("n") >= F.lit(least))).drop("listed")

    own = hot.select("tid", F.col("item").alias("item1"), F.col("iu").alias("iu1"), "tu", *(F.col(c).alias("mult1") for c in m))
    other = hot.select("tid", F.col("item").alias("item2"), F.col("iu").alias("iu2"), *(F.col(c).alias("mult2") for c in m))
    found = met.join(own, "item1", "left").join(other, ["tid", "item2"], "left")
    agg = found.groupBy("item1", "item2").agg(
        F.max("util").alias("util"), F.max("occ").alias("occ"), F.max("n").alias("n"),
        F.sum(util).alias("util2"), F.sum(util / F.col("tu")).alias("occ2"), F.sum(F.when(F.col("iu2").isNotNull(), count)).alias("n2"),
    )
    both = lambda c: F.coalesce(F.col(c) + F.col(f"{c}2"), F.col(c), F.col(f"{c}2")).cast(agg.schema[c].dataType)
    agg = agg.select("item1", "item2", both("util").alias("total_util"), (both("occ") / both("n")).alias("avg_uo"), both("n").alias("support"))
    return orient(agg).withColumn("itemset", itemset_label("item1", "item2")).select(
        "item1", "item2", "total_util", "avg_uo", "support", "itemset"
    )


def _pair_util(kept: bool) -> tuple[Column, Column]:
    """Utility of a pair in a transaction and the pair rows it stands for."""
    if kept:
        return F.col("mult2") * F.col("iu1") + F.col("mult1") * F.col("iu2"), F.col("mult1") * F.col("mult2")
    return F.col("iu1") + F.col("iu2"), F.lit(1).cast("long")


def pair_row_count(uo: DataFrame) -> DataFrame:
    """Number of pair rows without building them.

    Per transaction ``((sum m)^2 - sum m^2) / 2`` over its entries, which is
    ``n(n-1)/2`` when every multiplicity ``m`` is 1 (summed duplicates).
    """
    m = F.col("mult") if "mult" in uo.columns else F.lit(1)
    per_tid = uo.groupBy("tid").agg(F.sum(m).alias("s"), F.sum(m * m).alias("q"))
    return per_tid.agg(
        F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0)).cast("long").alias("pair_rows")
    )


def _max_of_others(col: str, w) -> Column:
    """Per entry, the largest ``col`` among the *other* entries of its
    transaction (null when it has none), from three window aggregates: the
    top value, how many entries hold it, and the largest value below it."""
    c = F.col(col)
    top = F.max(c).over(w)
    n_top = F.count(F.when(c == top, 1)).over(w)
    below = F.max(F.when(c < top, c)).over(w)
    return F.when((c < top) | (n_top >= 2), top).otherwise(below)


def exact_bounds(uo: DataFrame) -> DataFrame:
    """Per-item upper bounds of any pair holding the item (§4.3).

    Summed duplicates: for entry (i, t) let ``m`` be the largest utility of
    another entry of t.  Any pair (i, j) has total_util <= sum_t (iu + m) and
    avg_uo <= max_t (iu + m) / tu.  Utilities are non-negative after F2.

    Kept duplicates (``mult``): a pair's rows in t add up to
    ``mult_j * iu_i + mult_i * iu_j`` and each row's occupancy is
    ``(iu_i / mult_i + iu_j / mult_j) / tu``; bounding every partner term by
    the largest among the other entries (multiplicity, total, mean copy
    utility) gives the same two bounds.

    The "largest among the others" values come from windows over tid on the
    UO-list, which has one entry per distinct item of a basket and is already
    partitioned and sorted by tid, so no exchange or sort is added.
    """
    w = Window.partitionBy("tid")
    if "mult" in uo.columns:
        x = uo.select("tid", "item", "iu", "tu", "mult", (F.col("iu") / F.col("mult")).alias("per_copy"))
        x = x.select(
            "item", "iu", "tu", "mult", "per_copy",
            _max_of_others("iu", w).alias("o_iu"),
            _max_of_others("mult", w).alias("o_mult"),
            _max_of_others("per_copy", w).alias("o_per_copy"),
        ).where(F.col("o_iu").isNotNull())
        util = F.col("o_mult") * F.col("iu") + F.col("mult") * F.col("o_iu")
        occ = (F.col("per_copy") + F.col("o_per_copy")) / F.col("tu")
    else:
        x = uo.select("item", "iu", "tu", _max_of_others("iu", w).alias("o_iu")).where(F.col("o_iu").isNotNull())
        util = F.col("iu") + F.col("o_iu")
        occ = util / F.col("tu")
    # A one-entry transaction has no partner and bounds nothing (filtered above).
    return x.groupBy("item").agg(F.sum(util).alias("util_bound"), F.max(occ).alias("uo_bound"))


def within_bounds(bounds: DataFrame, min_util: float | Column, min_uo: float | Column) -> DataFrame:
    """Items of ``exact_bounds`` whose bounds reach both pair thresholds."""
    return bounds.where((F.col("util_bound") >= _threshold(min_util)) & (F.col("uo_bound") >= _threshold(min_uo)))


def exact_candidates(uo: DataFrame, min_util: float, min_uo: float) -> DataFrame:
    """Items whose bounds reach both pair thresholds."""
    return within_bounds(exact_bounds(uo), min_util, min_uo).select("item")
