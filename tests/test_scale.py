"""Heavy keys, ranges, bounds, bitmaps, numbering: rows where they should lie, results unchanged."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import driver_queries as Q
from basketry import (
    MineSpec,
    basket_items,
    dense_numbers,
    from_table,
    merged_transactions,
    mine,
    mine_together,
    pair_tid_bitmaps,
    rejected_lines,
    remaining_occupancy,
    sample_first,
    transaction_sketch,
    uo_list,
    with_stable_ids,
    write_uo_list,
)
from basketry.operators import patterns as P
from basketry.operators import sizing
from basketry.operators.clean import clean_lines
from basketry.operators.utility import RANGES, _in_ranges, base_entries
from basketry.sources.csv import parse_member_day
from basketry.sources.text import read_line_baskets, read_lines
from tests.conftest import SF001


@pytest.fixture()
def shuffled(spark):
    """No broadcast but those that are asked for, and no coalescing of partitions."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _tasks(df):
    """Rows of each partition that has any."""
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


# ---------------------------------------------------------------- heavy keys

def _skewed(spark, path):
    """Half of all rows have key 0, over several files."""
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    df.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def test_only_heavy_keys_are_copied_and_spread(shuffled, tmp_dir):
    df = _skewed(shuffled, os.path.join(tmp_dir, "t"))
    side = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    heavy = sizing.heavy_keys(side, "k", "n", heavy_rows=300).collect()
    assert [tuple(r) for r in heavy] == [(0, 7)]  # 2,000 rows in parts of 300
    assert sizing.heavy_keys(side, "k", "n", heavy_rows=2000).count() == 0
    got = sizing.spread_join(df, side, "k", by="v", n="n", heavy_rows=300)
    assert _rows(got.select("k", "v", "n", "s")) == _rows(df.join(side, "k").select("k", "v", "n", "s"))
    hot = got.where("k = 0")
    assert max(_tasks(hot)) < 1200 and len(_tasks(hot)) >= 3  # not one task of 2,000
    assert _tasks(sizing.spread_join(df, side, "k", by="v", n="n").where("k = 0")) == [2000]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "SortMerge" in got._jdf.queryExecution().executedPlan().toString() and "GlobalLimit 10000" in text


def test_rows_of_ordinary_keys_are_not_copied(shuffled, tmp_dir):
    df = _skewed(shuffled, os.path.join(tmp_dir, "t"))
    side = df.groupBy("k").agg(F.count("*").alias("n"))
    copies = sizing.spread_join(side, side, "k", by="n", n="n", heavy_rows=300)  # one row a key on the left
    assert copies.count() == side.count()


@pytest.mark.parametrize("spec", [
    MineSpec(price="mean", broadcast_max_rows=0, heavy_rows=5, **Q.L_T),
    MineSpec(price="mean", broadcast_max_rows=0, heavy_rows=5, tu_by="aggregate", **Q.L_T),
    MineSpec(price="first_seen", broadcast_max_rows=0, heavy_rows=3, duplicates="keep", **Q.L_T),
    MineSpec(tu_by="aggregate", heavy_rows=2, **Q.L_T),
])
def test_results_do_not_depend_on_what_is_heavy(spark, spec):
    lines = Q.lines_l(spark, SF001)
    a, b = mine(lines, spec), mine(lines, spec.with_(heavy_rows=10**9))
    assert _rows(Q._pairs_out(a.pairs)) == _rows(Q._pairs_out(b.pairs)) != []
    assert _rows(Q._singles_out(a.singles)) == _rows(Q._singles_out(b.singles))
    a.release(), b.release()


def test_no_task_holds_a_heavy_basket(shuffled):
    spec = MineSpec(0, 0, tu_by="aggregate", heavy_rows=10)
    uo = uo_list(Q.lines_hot_basket(shuffled, SF001), spec)
    n = uo.where("tid = 0").count()
    assert n > 150 and max(_tasks(uo.where("tid = 0"))) < n / 2


# ---------------------------------------------------------------- mean price on one scan

def test_mean_price_scans_the_lines_once(shuffled):
    spec = MineSpec(price="mean", prune="winners", **Q.L_T)
    r = mine(Q.lines_l(shuffled, SF001), spec)
    # Both reads are of the held entries, none of the table.
    tree = uo_list(None, spec, base=r.holds[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation [" in tree and not re.search(r"(?<!InMemory)Relation \[", tree)
    r.release()
    alone = base_entries(clean_lines(Q.lines_l(shuffled, SF001)), spec)._jdf.queryExecution().executedPlan().toString()
    assert alone.count("FileScan") == 1 and alone.count("Exchange hashpartitioning(tid") == 1


def test_runs_together_share_their_entries(spark):
    lines = Q.lines_l(spark, SF001)
    specs = [MineSpec(price="mean", prune="winners", **Q.L_T), MineSpec(**Q.L_T), MineSpec(price="hash", min_util=1.005, min_uo_single=0.2),
             MineSpec(price="constant", constant_price=2.5, duplicates="keep", min_util=5, min_uo_single=0.2),
             MineSpec(price="first_seen", exclude=("1", "2"), exclude_when="before_tu", **Q.L_T)]
    spark.catalog.clearCache()
    together = mine_together(lines, specs)
    for spec, r in zip(specs, together):
        alone = mine(lines, spec)
        assert _rows(Q._pairs_out(r.pairs)) == _rows(Q._pairs_out(alone.pairs))
        assert _rows(Q._singles_out(r.singles)) == _rows(Q._singles_out(alone.singles))
        alone.release()
    assert len({r.holds[0] for r in together}) == 1
    for r in together:
        r.release()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    with pytest.raises(ValueError, match="same"):
        mine_together(lines, [MineSpec(1, 0), MineSpec(1, 0, tu="given")])


def test_driver_queries_release_the_ones_before(spark):
    spark.catalog.clearCache()
    Q.release_held()
    sizes = []
    for name in ("run_compare", "pairs_mean_winners", "singles_actual", "uo_list"):
        Q.REGISTRY[name][0](spark, SF001).collect()
        sizes.append(spark.sparkContext._jsc.getPersistentRDDs().size())
    assert sizes[-1] == 0 and max(sizes) <= 6


# ---------------------------------------------------------------- ranges of a heavy basket

@pytest.mark.parametrize("heavy_rows", [1, 40, 10**6])
def test_remaining_occupancy_in_ranges(spark, heavy_rows):
    uo = uo_list(Q.lines_hot_basket(spark, SF001), MineSpec(0, 0)).persist()
    got = {(r.tid, r.item): r.ruo for r in remaining_occupancy(uo, heavy_rows).collect()}
    baskets = {}
    for r in uo.collect():
        baskets.setdefault(r.tid, []).append((str(r.item), r.item, r.uo))
    for tid, items in baskets.items():
        left = 0.0
        for _, item, u in sorted(items, reverse=True):
            assert abs(got.pop((tid, item)) - left) < 1e-9
            left += u
    assert not got
    uo.unpersist()


def test_ranges_are_even_and_spread(shuffled):
    rows = shuffled.range(30_000).select(F.lit("t").alias("tid"), F.md5(F.col("id").cast("string")).alias("item"), F.lit(1.0).alias("uo"), F.lit(30_000).cast("long").alias("n_items"))
    got = _in_ranges(rows, 1000)
    sizes = [r["count"] for r in got.groupBy("_range").count().collect()]
    assert RANGES / 2 < len(sizes) < 2 * RANGES and max(sizes) < 12 * 30
    ordered = got.groupBy("_range").agg(F.min("item").alias("a"), F.max("item").alias("b")).orderBy("_range").collect()
    assert all(x.b < y.a for x, y in zip(ordered, ordered[1:]))
    parts = _tasks(remaining_occupancy(rows, 1000))
    assert max(parts) < 15_000 and len(parts) > 4


# ---------------------------------------------------------------- pair bounds

@pytest.mark.parametrize("buckets", [1, 64, P.PAIR_BUCKETS])
@pytest.mark.parametrize("duplicates", ["sum", "keep"])
def test_pair_bounds_lose_no_pair(spark, buckets, duplicates, monkeypatch):
    lines = Q.lines_l(spark, SF001)
    spec = MineSpec(duplicates=duplicates, prune="bounds", **Q.L_T)
    r, plain = mine(lines, spec), mine(lines, spec.with_(prune="none"))
    kept = P.pair_buckets(r.uo, spec.min_util, spec.pair_uo, buckets=buckets)
    rows = P.pair_rows(r.uo)
    measured = P.in_buckets(rows, kept, buckets).select("item1", "item2").distinct().count()
    if buckets == P.PAIR_BUCKETS:
        assert measured < 0.7 * rows.select("item1", "item2").distinct().count()
        assert _rows(Q._pairs_out(r.pairs)) == _rows(Q._pairs_out(plain.pairs)) != []
    assert measured >= plain.pairs.count() and kept.count() <= buckets
    r.release(), plain.release()


@pytest.mark.parametrize("duplicates,split", [("sum", 4096), ("keep", 4096), ("sum", 3)])
def test_buckets_follow_the_pairs(spark, duplicates, split, monkeypatch):
    """With a fixed number of buckets more pairs would fill all of them, and nothing would be spared."""
    monkeypatch.setattr(P, "PAIR_BUCKETS", 16)
    lines = Q.lines_l(spark, SF001)
    spec = MineSpec(duplicates=duplicates, prune="bounds", split_items=split, **Q.L_T)
    r, plain = mine(lines, spec), mine(lines, spec.with_(prune="none"))
    rows = P.pair_rows(r.uo, split)
    assert r.buckets >= rows.count() and r.pair_buckets.columns == ["_block", "_marks"]
    kept = P.in_buckets(rows, r.pair_buckets, r.buckets)
    marked = P.in_buckets(rows, r.pair_buckets, r.buckets, mark="m")
    assert marked.count() == rows.count() and marked.where("m").count() == kept.count() < 0.8 * rows.count()
    assert _rows(Q._pairs_out(r.pairs)) == _rows(Q._pairs_out(plain.pairs)) != []
    r.release(), plain.release()
    monkeypatch.setattr(P, "MARK_BITS", 64)
    few = mine(lines, spec)
    assert few.buckets == 64 and few.pairs.count() == plain.pairs.count()
    few.release(), plain.release()
    assert Q.q_pair_bounds_saving(spark, SF001).first().all_kept_measured


def test_pair_bounds_spare_pairs_however_many(spark, monkeypatch):
    want = Q.q_pair_bounds_saving(spark, SF001).first()
    monkeypatch.setattr(P, "PAIR_BUCKETS", 16)
    df = Q.q_pair_bounds_saving(spark, SF001)
    assert tuple(df.first()) == tuple(want) and want.fewer_measured and want.all_kept_measured
    assert "FullOuter" not in df._jdf.queryExecution().optimizedPlan().toString()


# ---------------------------------------------------------------- bitmaps

def test_dense_numbers(spark):
    keys = spark.range(1000).select((F.col("id") * 7919).alias("k"))
    for parts in (1, 8, 4096):
        got = dense_numbers(keys, "k", parts)
        assert sorted(r.number for r in got.collect()) == list(range(1, 1001))
        assert _rows(got) == _rows(dense_numbers(keys.repartition(7), "k", parts))
    assert dense_numbers(keys.limit(0), "k").count() == 0


@pytest.mark.parametrize("split_items", [3, 4096])
def test_bitmaps_hold_the_tids(spark, split_items):
    uo = uo_list(Q.lines_b(spark, SF001), MineSpec(0, 0)).persist()
    bits = pair_tid_bitmaps(uo, split_items=split_items)
    want = Counter((r.item1, r.item2) for r in P.orient(P.pair_rows(uo)).collect())
    got = bits.groupBy("item1", "item2").agg(F.sum(F.bitmap_count("tids")).alias("n"), F.count("*").alias("rows")).collect()
    assert {(r.item1, r.item2): r.n for r in got} == want and {r.rows for r in got} == {1}  # under 32,768 transactions
    numbers = {r.number: r.tid for r in dense_numbers(uo.select("tid").distinct(), "tid").collect()}
    some = bits.orderBy("item1", "item2").first()
    told = {numbers[32768 * (some.bucket - 1) + 8 * i + b + 1] for i, byte in enumerate(some.tids) for b in range(8) if byte >> b & 1}
    rows = {r.tid for r in P.orient(P.pair_rows(uo)).collect() if (r.item1, r.item2) == (some.item1, some.item2)}
    assert told == rows
    uo.unpersist()


def test_bitmaps_of_given_pairs_number_only_their_members(spark):
    r = mine(Q.lines_b(spark, SF001), MineSpec(prune="winners", min_util=1_000_000, min_uo_single=0.2, min_uo_pair=0.3))
    pairs = r.pairs
    assert pairs.count() > 0
    want = {tuple(x) for x in pairs.select("item1", "item2", "support").collect()}
    for uo in (r.uo, r.candidates):
        for heavy in (1, sizing.HEAVY_ROWS):
            bits = pair_tid_bitmaps(uo, pairs, heavy_rows=heavy)
            got = bits.groupBy("item1", "item2").agg(F.sum(F.bitmap_count("tids")).alias("n")).collect()
            assert {(x.item1, x.item2, x.n) for x in got} == want
    plan = bits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_salt") < plan.index("Join LeftSemi")  # the numbers are joined above the choice of pairs
    r.release()


# ---------------------------------------------------------------- tasks by rows

def test_tasks_of_given_tu_follow_the_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert sizing.task_count(spark.range(1001), 10) == 101 and sizing.task_count(spark.range(0), 10) == cores
    want = _rows(Q.q_tu_given_check(spark, SF001))
    monkeypatch.setattr(Q, "task_count", lambda df: sizing.task_count(df, 100), raising=True)
    df, tasks = Q.q_tu_given_check(spark, SF001), -(-Q._t(spark, SF001, "lineitem").count() // 100)
    assert _rows(df) == want
    # Join, entries, window and check run in these tasks, without another shuffle by key.
    shuffled = re.findall(r"hashpartitioning\((.*?)\)", Q.q_tu_given_check(spark, SF001)._jdf.queryExecution().executedPlan().toString())
    assert shuffled and all(s.endswith(f", {tasks}") for s in shuffled)


# ---------------------------------------------------------------- numbering of lines

def _write_files(folder, sizes):
    os.makedirs(folder)
    n = 0
    for k, size in enumerate(sizes):
        with open(os.path.join(folder, f"part-{k:02}.txt"), "w") as f:
            for _ in range(size):
                f.write(f"{n} {n + 1} {n % 7}\n")
                n += 1
    return n


def test_line_ids_do_not_depend_on_splits(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "lines")
    n = _write_files(folder, [900, 10, 3000, 0, 1])
    seen = []
    for split in ("1k", "7k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            lines = read_lines(spark, folder, stable_ids=True)
            assert {r.line_no: int(r.value.split()[0]) for r in lines.collect()} == {i: i for i in range(n)}
            seen.append(_rows(read_line_baskets(spark, folder, stable_ids=True).groupBy("tid").agg(F.count("*").alias("n"))))
            assert _rows(with_stable_ids(spark.read.text(folder), max_rows=0)) == _rows(lines)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] == seen[2] == [(i, 3) for i in range(n)]


# ---------------------------------------------------------------- first N of a member-day file

def test_first_by_member_number_then_date(spark):
    rows = [("10", "01-02-2015", "a"), ("2", "03-01-2015", "b"), ("2", "01-02-2015", "c"), ("2", "01-02-2015", "d"), ("x", "01-01-2015", "e"), (None, "01-01-2015", "f")]
    df = spark.createDataFrame(rows, "Member_number string, Date string, itemDescription string")
    first = lambda n, **kw: [r.item for r in sample_first(parse_member_day(df, order_key=True, **kw), n, by="order_key").orderBy("item").collect()]
    assert first(2, date_format="dd-MM-yyyy") == ["b", "e"]  # x is no number; 3 January comes before 1 February
    assert first(2) == ["c", "d", "e"]  # as text 01-02 comes first
    assert first(3) == ["b", "c", "d", "e"] and first(4) == ["a", "b", "c", "d", "e"]
    assert "order_key" not in parse_member_day(df).columns


# ---------------------------------------------------------------- rejects, long baskets, sketches, stored lists

def test_rejects_and_kept_lines_make_the_whole(spark):
    rows = [("1", "a", "2", "1.5", "c"), ("1", None, "2", "1.5", "c"), ("1", " ", "x", "1", "c"), ("1", "a", "x", "1", "c"), ("1", "a", "-2", "1", "c"),
            ("1", "a", "1", "NaN", "c"), ("1", "a", "1", "0", "c"), ("1", "a", "1", "1", None), (None, "a", "1", "1", "c")]
    df = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, Quantity string, UnitPrice string, CustomerID string").withColumn("n", F.lit(1))
    got = Counter(r.reason for r in rejected_lines(df).collect())
    assert got == {"missing StockCode": 2, "bad Quantity": 1, "not positive Quantity": 1, "bad UnitPrice": 1, "not positive UnitPrice": 1, "missing CustomerID": 1, "missing InvoiceNo": 1}
    assert rejected_lines(df.limit(0)).count() == 0


def test_basket_items(spark, example):
    got = _rows(basket_items(example))
    assert [r for r in got if r[0] == "T1"] == [("T1", 0, "A"), ("T1", 1, "B"), ("T1", 2, "C")] and len(got) == 9


def test_sketches_merge(spark):
    lines = spark.range(60_000).select((F.col("id") % 20_000).alias("tid"), (F.col("id") % 3).alias("part"))
    parts = transaction_sketch(lines, ["part"])
    assert abs(merged_transactions(parts).first()[0] - 20_000) < 0.05 * 20_000
    for r in merged_transactions(parts, ["part"]).collect():
        assert abs(r.n_transactions - 20_000) < 0.05 * 20_000


def test_stored_uo_list_pairs_without_exchange(shuffled):
    uo = uo_list(Q.lines_l(shuffled, SF001), MineSpec(0, 0))
    back = write_uo_list(uo, "uo_list_test", 4, mode="overwrite")
    try:
        assert _rows(Q._uo_out(back)) == _rows(Q._uo_out(uo))
        small = back.where("n_items <= 4096")
        plan = small.alias("a").join(small.alias("b"), "tid")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert _rows(Q._pairs_out(P.pairs(back))) == _rows(Q._pairs_out(P.pairs(uo)))
    finally:
        shuffled.sql("DROP TABLE uo_list_test")


def test_item_order_is_text_order_everywhere(spark):
    lines = from_table(spark.createDataFrame([(1, 10), (1, 9), (1, 100)], "t long, i long"), tid="t", item="i")
    got = [(r.position, r.item) for r in basket_items(lines).orderBy("position").collect()]
    assert got == [(0, "10"), (1, "100"), (2, "9")]


# ---------------------------------------------------------------- pairs of large transactions

@pytest.mark.parametrize("duplicates", ["sum", "keep"])
@pytest.mark.parametrize("min_uo", [0.02, 0.3])
def test_reaching_pairs_equal_all_pairs_above_the_threshold(spark, duplicates, min_uo):
    rows = [(f"H{t}", str(i), 1.0, float(1 + (i * i + t) % 23)) for t in range(3) for i in range(40) if (i + t) % 4]
    rows += [(f"T{t}", str(t * k % 40), 1.0, float(1 + k)) for t in range(60) for k in range(1, 6)]
    lines = spark.createDataFrame(rows, "tid string, item string, quantity double, unit_price double")
    uo = uo_list(lines, MineSpec(0, 0, duplicates=duplicates))
    for split in (1, 16):
        got = P.keep_rule(P.pairs_reaching(uo, min_uo, split), 0, min_uo)
        want = P.keep_rule(P.pairs(uo, split), 0, min_uo)
        assert _rows(Q._pairs_out(got)) == _rows(Q._pairs_out(want)) != []


@pytest.mark.parametrize("duplicates", ["sum", "keep"])
@pytest.mark.parametrize("min_uo, number", [(0.09, "double"), (0.15, "double"), (0.15, "decimal(12,2)"), (0.9, "double")])
def test_tested_pairs_equal_all_pairs_above_the_threshold(spark, duplicates, min_uo, number):
    """Baskets of 40 items, and of 4 in which pairs reach the threshold that others hold below it."""
    rows = [(t, (i * 7 + t) % 90, 1.0, float(1 + (i * i + t) % 23) * (9 if i < 3 else 1)) for t in range(60) for i in range(40)]
    rows += [(t, t * k % 90, 1.0, float(1 + k)) for t in range(100, 130) for k in range(1, 5)] + rows[:50]
    lines = spark.createDataFrame(rows, "tid long, item long, quantity double, unit_price double")
    lines = lines.withColumns({c: F.col(c).cast(number) for c in ("quantity", "unit_price")})
    uo = uo_list(lines, MineSpec(0, 0, duplicates=duplicates))
    for split in (16, 4096):
        want = _rows(Q._pairs_out(P.keep_rule(P.pairs(uo, split), 0, min_uo)))
        for test_pairs in (0, 10**9):
            got = P.keep_rule(P.pairs_reaching(uo, min_uo, split, test_pairs), 0, min_uo)
            assert _rows(Q._pairs_out(got)) == want


def test_long_baskets_aggregate_only_pairs_that_reach_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(P, "TEST_PAIRS", 0)
    rows = spark.range(400 * 40).selectExpr("id div 40 AS tid", "xxhash64(id) AS item", "1.0D AS quantity", "IF(id % 40 < 2, 19.0D, 1.0D) AS unit_price")
    r = mine(rows, MineSpec(1, 0.2, 0.4))
    assert r.pairs.count() == 400
    plan = r.pairs._jdf.queryExecution().analyzed().toString()
    local = P._local_pair_rows(r.uo, False)
    total = local.count()
    left = P._tested(local, [r.uo], P._reaching_pairs(r.uo.where("n_items > 4096"), 0.4, 4096), 0.4, 0).count()
    assert total == 400 * 780 and 400 <= left < total / 2
    assert "bit_or" in plan  # the run tests its rows
    r.release()


def test_large_transaction_lists_only_pairs_that_reach_the_threshold(spark):
    n = 3000  # 4.5 million pairs in one transaction
    rows = spark.range(n).selectExpr("'HOT' AS tid", "id AS item", "1.0D AS quantity", "IF(id < 3, 500.0D, 1.0D) AS unit_price")
    rows = rows.unionByName(spark.range(60).selectExpr("'T' || id div 3 AS tid", "id AS item", "1.0D AS quantity", "2.0D AS unit_price"))
    r = mine(rows, MineSpec(1, 0.2, split_items=64))
    assert P._reaching_pairs(r.uo.where("n_items > 64"), 0.2, 64).count() == 3
    assert r.pairs.count() == 3 + 20 * 3 - 3
    r.release()
