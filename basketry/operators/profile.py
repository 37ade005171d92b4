"""Dataset profile and basket views: A6, A8, A9, A11, A12, A13, C2."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.patterns import orient, pair_rows
from basketry.operators.sizing import HEAVY_ROWS, spread_join


def distinct_transactions(uo: DataFrame) -> DataFrame:
    """Number of transactions (after cleaning and the TU floor)."""
    return uo.agg(F.count_distinct("tid").alias("n_transactions"))


def transaction_sketch(lines: DataFrame, by=(), precision: int = 12) -> DataFrame:
    """A6, mergeable: a HyperLogLog sketch of the transactions of each part.

    ``by`` names the columns that part the lines (a day, a source).  A sketch is at most
    about ``2**precision`` bytes, so parts can be stored and merged later without their lines.
    """
    tid = F.col("tid").cast("string")
    return lines.groupBy(*by).agg(F.hll_sketch_agg(tid, F.lit(precision)).alias("sketch"))


def merged_transactions(sketches: DataFrame, by=()) -> DataFrame:
    """About how many different transactions the parts hold together, in each group of ``by``.

    The standard error is about ``1.04 / 2**(precision / 2)``: 1.6 % at 12.
    """
    count = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_transactions")
    return sketches.groupBy(*by).agg(count)


def tu_summary(uo_or_tu: DataFrame) -> DataFrame:
    """Count, mean, stddev, min, max of TU with one row per tid.

    Accepts the UO-list (several rows per tid) or a (tid, tu) frame; TU is
    taken once per transaction, never item-weighted.
    """
    per_tid = uo_or_tu.groupBy("tid").agg(F.max("tu").alias("tu"))
    return per_tid.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("tu").alias("mean"),
        F.stddev_samp("tu").alias("stddev"),
        F.min("tu").alias("min"),
        F.max("tu").alias("max"),
    )


def pattern_counts(singles: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row (n_singles, n_pairs)."""
    sizes = singles.select(F.lit(1).alias("size")).unionByName(pairs.select(F.lit(2).alias("size")))
    return sizes.agg(
        F.count(F.when(F.col("size") == 1, 1)).alias("n_singles"),
        F.count(F.when(F.col("size") == 2, 1)).alias("n_pairs"),
    )


def basket_items(lines: DataFrame) -> DataFrame:
    """A11 in long form: (tid, position, item), the items of a transaction in string order.

    The window sorts a transaction's distinct items without building an array of them;
    ``basket_lists`` is the file format's one row per transaction.
    """
    items = lines.select("tid", F.col("item").cast("string").alias("item")).distinct()
    place = F.row_number().over(Window.partitionBy("tid").orderBy("item")) - 1
    return items.select("tid", place.alias("position"), "item")


def basket_lists(lines: DataFrame, sep: str = " ") -> DataFrame:
    """One row per transaction with its items, sorted, as an array and
    as one joined string (the one-basket-per-line format).

    The per-row array is bounded by the distinct items of one basket
    (duplicates are merged first); it is the output format itself.
    """
    merged = lines.groupBy("tid", "item").agg(F.sum("quantity").alias("quantity"))
    text = F.col("item").cast("string")
    per_tid = merged.groupBy("tid").agg(F.array_sort(F.collect_list(text)).alias("items"))
    return per_tid.select("tid", "items", F.array_join("items", sep).alias("basket"))


#: Parts that keys are numbered in; the prefix sum over them is one row each.
NUMBER_PARTS = 4096


def dense_numbers(keys: DataFrame, key: str, parts: int = NUMBER_PARTS) -> DataFrame:
    """``keys`` with ``number``: 1, 2, ... over the distinct ``key`` values, without gaps.

    ``keys`` has one row per key.  The keys fall into ``parts`` by hash, are numbered in
    each, and the sizes of the parts before are added.  Numbers depend on the set of keys
    only, not on files, partitions or row order.
    """
    rows = keys.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per part
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    rows = rows.withColumn("_inside", inside).join(F.broadcast(offsets), "_part")
    return rows.withColumn("number", F.col("_offset") + F.col("_inside")).drop("_part", "_inside", "_offset")


def pair_tid_bitmaps(
    uo: DataFrame, pairs: DataFrame | None = None, split_items: int = 4096, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """A13 as bitmaps: (item1, item2, bucket, tids), the transactions of each pair as bits.

    Transactions get dense numbers; bit ``b`` of bucket ``k`` is transaction number
    ``32768 (k - 1) + b + 1``, so a pair has at most one row of 4 KB per 32,768
    transactions however often it occurs, and two lists intersect bitwise.  A pair's
    support is the sum of ``bitmap_count(tids)``; repeated lines of kept duplicates are one
    bit.  With ``pairs`` (item1, item2) only those pairs.
    """
    tids = uo.groupBy("tid").agg(F.max("n_items").alias("_n"))
    numbers = dense_numbers(tids, "tid")
    entries = uo.select("tid", "item", "iu", "tu", "n_items")
    if pairs is None:
        rows = spread_join(entries, numbers, "tid", by="item", n="_n", heavy_rows=heavy_rows).drop("tid", "_n")
        found = orient(pair_rows(rows.withColumnRenamed("number", "tid"), split_items).select("item1", "item2", "tid"))
    else:
        # Entries pair where they lie, and only members of the given pairs meet their number:
        # at most a transaction's pairs, taken as no more than 4,096 to an entry to size the spread.
        rows = orient(pair_rows(entries, split_items).select("item1", "item2", "tid"))
        rows = rows.join(pairs.select("item1", "item2"), ["item1", "item2"], "left_semi")
        n = F.col("_n").cast("double")
        numbers = numbers.withColumn("_n", F.least(n * (n - 1) / 2, n * 4096))
        found = spread_join(rows, numbers, "tid", by="item1", n="_n", heavy_rows=heavy_rows)
        found = found.select("item1", "item2", F.col("number").alias("tid"))
    return found.groupBy("item1", "item2", F.bitmap_bucket_number("tid").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("tid")).alias("tids")
    )


def item_support(uo: DataFrame) -> DataFrame:
    """Transactions (entries when duplicates are kept) per item,
    in item order."""
    support = F.sum("mult") if "mult" in uo.columns else F.count(F.lit(1))
    out = uo.groupBy("item").agg(support.alias("support"))
    return out.withColumn("item", F.col("item").cast("string")).orderBy("item")


def pair_cooccurrence(uo: DataFrame, split_items: int = 4096, pairs: DataFrame | None = None) -> DataFrame:
    """The co-occurrence tid lists in long form, one row per
    (item1, item2, tid).

    The reference keeps a Python list of tids per pair; a list per pair is
    unbounded, so the distributed form is one row per member.  Group it by
    pair for counts (``support``) without materialising any list.  With
    ``pairs`` (item1, item2; such as a run's kept pairs) only their members
    come out, as the reference lists them for its winners.
    """
    def only(rows: DataFrame) -> DataFrame:
        return rows if pairs is None else rows.join(pairs.select("item1", "item2"), ["item1", "item2"], "left_semi")

    keep = [c for c in ("tid", "item", "iu", "tu", "n_items", "mult") if c in uo.columns]
    rows = pair_rows(uo.select(*keep), split_items)
    if "mult1" in rows.columns:
        # kept duplicates: the tid occurs m*n times in the pair's list
        return only(orient(rows.select("item1", "item2", "tid", (F.col("mult1") * F.col("mult2")).alias("copies"))))
    return only(orient(rows.select("item1", "item2", "tid")))


def profile(uo: DataFrame) -> DataFrame:
    """One row describing a mined dataset from its UO-list.

    Transactions, entries, distinct items, mean entries per transaction and
    the TU summary (count, mean, stddev, min, max per transaction).  Two
    aggregates: one per transaction (partial aggregation first), one global.
    """
    per_tid = uo.groupBy("tid").agg(F.max("tu").alias("tu"), F.count(F.lit(1)).alias("n"))
    tx = per_tid.agg(
        F.count(F.lit(1)).alias("n_transactions"),
        F.sum("n").alias("n_entries"),
        F.avg("n").alias("mean_basket"),
        F.avg("tu").alias("tu_mean"),
        F.stddev_samp("tu").alias("tu_stddev"),
        F.min("tu").alias("tu_min"),
        F.max("tu").alias("tu_max"),
    )
    items = uo.agg(F.count_distinct("item").alias("n_items"))
    # Two one-row aggregates merged by a union and a max over each column:
    # no join of any kind.
    both = tx.unionByName(items, allowMissingColumns=True)
    cols = tx.columns + items.columns
    return both.agg(*[F.max(c).alias(c) for c in cols])


def tu_mismatch(uo: DataFrame, rel_tol: float = 1e-9) -> DataFrame:
    """Data check for given TU: transactions whose entry utilities do not
    add up to their TU (tid, tu, sum_iu, gap).

    With utilities and TU both read from the source, ``sum(iu) = TU`` should
    hold; rows here are transactions where it does not (beyond ``rel_tol``).
    One aggregate per transaction, partially aggregated.
    """
    per_tid = uo.groupBy("tid").agg(F.max("tu").alias("tu"), F.sum("iu").alias("sum_iu"))
    gap = F.col("tu") - F.col("sum_iu")
    return per_tid.where(F.abs(gap) > F.lit(float(rel_tol)) * F.abs(F.col("tu"))).withColumn("gap", gap)
