"""Physical plan checks: pushdown, pruning, join strategy, no Python."""

import contextlib
import io

import pytest

from pyspark.sql import functions as F

import driver_queries as Q
from basketry import MineSpec, compare, mine, mine_many, uo_list
from basketry.operators import patterns as P
from tests.conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def _formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_scan_pushdown_and_pruning(spark):
    uo = uo_list(Q.lines_l(spark, SF001), MineSpec(0, 0))
    text = _formatted(uo)
    pushed = [ln for ln in text.splitlines() if ln.startswith("PushedFilters")][0]
    for f in ("IsNotNull(l_orderkey)", "IsNotNull(l_partkey)", "IsNotNull(l_quantity)",
              "IsNotNull(l_extendedprice)", "GreaterThan(l_quantity,0.0)"):
        assert f in pushed
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in text


def test_pair_join_is_keyed_on_tid_and_grid_cell(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        uo = uo_list(Q.lines_l(spark, SF001), MineSpec(0, 0))
        text = _formatted(P.pairs(uo))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text
    assert "hashpartitioning(tid" in text and "cell_a" in text and "cell_b" in text


def test_ordinary_baskets_pair_without_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        uo = uo_list(Q.lines_l(spark, SF001), MineSpec(0, 0)).persist()
        uo.count()
        text = _formatted(P.pairs(uo))
        uo.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda ln: len(ln) - len(ln.lstrip(" :+-|*"))
    free, inside = [], None  # of each join above the cached UO-list: no exchange below it
    tree = text[: text.index("\n(1) ")].splitlines()
    for i, ln in enumerate(tree):
        if inside is not None and depth(ln) > inside:
            continue
        inside = depth(ln) if "InMemoryRelation" in ln else None
        if "SortMergeJoin" in ln:
            below = []
            for under in tree[i + 1 :]:
                if depth(under) <= depth(ln):
                    break
                below.append(under)
            cut = [k for k, u in enumerate(below) if "InMemoryRelation" in u]
            free.append(not any("Exchange" in u for u in below[: cut[0]]))
    assert sorted(free) == [False, True]  # the grid join and the local join
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


@pytest.mark.parametrize("spec", [
    MineSpec(1e5, 0.25, 0.5, price="mean", prune="winners"),
    MineSpec(1e5, 0.25, 0.5, prune="exact"),
    MineSpec(1e5, 0.25, 0.5, price="hash", duplicates="keep"),
])
def test_no_python_in_mining_plans(spark, spec):
    r = mine(Q.lines_l(spark, SF001), spec)
    for df in (r.singles, r.pairs):
        text = _plan(df)
        for bad in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF",
                    "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text
    r.release()


def test_partial_aggregation_before_pair_shuffle(spark):
    uo = uo_list(Q.lines_l(spark, SF001), MineSpec(0, 0))
    text = _formatted(P.pairs(uo))
    assert "partial_sum" in text and "partial_count" in text


def test_small_side_broadcast_only_after_check(spark):
    from basketry.operators.sizing import bounded_broadcast

    small = spark.range(10)
    _, ok = bounded_broadcast(small, 100)
    assert ok
    big, ok = bounded_broadcast(spark.range(1000), 100)
    assert not ok
    assert "ResolvedHint" not in big._jdf.queryExecution().analyzed().toString()
    wide = spark.range(50).selectExpr("repeat('x', 1000) AS item")
    _, ok = bounded_broadcast(wide, 100, max_bytes=10_000)  # 50 kB of text > 10 kB
    assert not ok
    _, ok = bounded_broadcast(wide, 100, max_bytes=100_000)
    assert ok


@pytest.mark.parametrize("name", sorted(Q.REGISTRY))
def test_driver_query_plans_stay_on_the_jvm_without_cartesian_joins(spark, name):
    fn, _ = Q.REGISTRY[name]
    text = _plan(fn(spark, SF001))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in text, bad


def test_checkpoint_dir_is_never_invented():
    from basketry.operators.sizing import checkpoint_dir

    class _Opt:
        def isDefined(self):
            return False

    class _Jsc:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return _Opt()

    class _Conf:
        def get(self, key, default=None):
            return default

    class _Sc:
        _jsc = _Jsc()

        def getConf(self):
            return _Conf()

    class _Spark:
        sparkContext = _Sc()
        conf = _Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Spark())


def test_checkpoint_dir_reads_the_session_setting(spark):
    from basketry.operators.sizing import checkpoint_dir

    configured = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert checkpoint_dir(spark) == configured


def test_grid_join_is_shuffled_even_when_broadcast_is_allowed(spark):
    # A broadcast would leave a hot transaction in its one tid partition.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 30))
    try:
        uo = uo_list(Q.lines_hot_basket(spark, SF001), MineSpec(0, 0))
        text = _formatted(P._grid_pair_rows(uo.where("n_items > 8"), 8, False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    assert "hashpartitioning(tid" in text and "cell_a" in text


def _many_runs(spark):
    lines, events = Q.lines_l(spark, SF001), Q.lines_v(spark, SF001)
    t = dict(min_util=30_000, min_uo_single=0.2, min_uo_pair=0.4)
    return [
        ("winners", lines, MineSpec(prune="winners", **t)),
        ("exact", lines, MineSpec(prune="exact", min_util=50_000, min_uo_single=0.3)),
        ("hash", lines, MineSpec(150, 0.2, 0.4, price="hash")),
        ("denied", events, MineSpec(100, 0.1, exclude=("click",), prune="winners")),
        ("bounds", lines, MineSpec(prune="bounds", **t)),
        ("mean", lines, MineSpec(price="mean", prune="winners", **t)),
        ("mean_again", lines, MineSpec(50_000, 0.2, 0.3, price="mean", exclude=("1", "7"))),
        ("keep", events, MineSpec(100, 0.1, duplicates="keep")),
    ]


def _shown(df):
    return sorted((r.dataset, r.size, r.item1, r.item2 or "", r.itemset, r.support, round(r.total_util, 3), round(r.avg_uo, 9)) for r in df.collect())


@pytest.mark.parametrize("held", [True, False])
def test_runs_in_one_plan_equal_runs_by_themselves(spark, held):
    results, alone, runs = [], [], _many_runs(spark)
    got = _shown(mine_many(runs, results if held else None))
    for name, lines, spec in runs:
        run = mine(lines, spec)
        alone += _shown(run.combined().withColumn("dataset", F.lit(name)))
        run.release()
    assert got == sorted(alone) and {r[0] for r in got} >= {n for n, *_ in runs[:7]} and any(r[1] == 2 for r in got)
    assert not held or len(results) == 4  # actual prices, bounds, mean prices, kept duplicates
    for r in results:
        r.release()


def test_runs_of_one_policy_have_one_set_of_shuffles(spark):
    runs = [(name, lines, spec.with_(reuse="none")) for name, lines, spec in _many_runs(spark)]
    few, many = [], []
    mine_many([runs[0], runs[3]], few)
    mine_many([runs[0], runs[3], runs[2], (*runs[0][:2], MineSpec(9, 0.5, reuse="none"))], many)
    assert len(few) == len(many) == 1
    shuffles = [r.uo._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") for r in (few[0], many[0], mine(*runs[0][1:]))]
    scans = [r.uo._jdf.queryExecution().executedPlan().toString().count("FileScan") for r in (few[0], many[0])]
    assert shuffles == [2, 2, 2] and scans == [2, 4]
    for r in (*few, *many):
        r.release()


def test_gate_too_large_for_a_broadcast_is_shuffled_once(spark):
    runs = [(name, lines, spec.with_(broadcast_max_rows=2)) for name, lines, spec in _many_runs(spark)[:4]]
    results, alone = [], []
    got = _shown(mine_many(runs, results))
    for name, lines, spec in runs:
        run = mine(lines, spec)
        alone += _shown(run.combined().withColumn("dataset", F.lit(name)))
        assert spec.prune == "none" or "Join LeftSemi" not in run.pairs._jdf.queryExecution().optimizedPlan().toString()
        run.release()
    assert got == sorted(alone)
    plan = results[0].pairs._jdf.queryExecution().optimizedPlan().toString()
    # The gated entries are held by transaction; the run without pruning ("hash") is not gated.
    assert "Join LeftSemi" not in plan and len(results[0].candidate_parts) == 2
    assert {r.run for r in results[0].candidate_parts[0].select(F.substring("tid", 1, 6).alias("run")).distinct().collect()} == {"000002"}
    assert sorted(results[0].candidates.columns) == sorted(results[0].uo.columns)
    for r in results:
        r.release()


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_held_runs_on_the_same_lines_share_their_entries(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "TEST_PAIRS", 0)
    lines, t = Q.lines_l(spark, SF001), dict(broadcast_max_rows=limit)
    runs = [
        ("winners", lines, MineSpec(30_000, 0.2, 0.4, prune="winners", **t)),
        ("other", Q.lines_l(spark, SF001), MineSpec(60_000, 0.3, 0.3, prune="winners", **t)),
        ("exact", lines, MineSpec(50_000, 0.3, prune="exact", **t)),
        ("constant", lines, MineSpec(30, 0.2, 0.5, price="constant", constant_price=2.0, prune="winners", **t)),
        ("other", lines, MineSpec(30, 0.2, 0.4, price="constant", constant_price=2.0, **t)),
        ("denied", lines, MineSpec(50_000, 0.3, 0.3, exclude=("1", "7"), prune="winners", **t)),
        ("as text", lines.withColumn("item", F.col("item").cast("decimal(12,0)")), MineSpec(50_000, 0.3, 0.3, **t)),
    ]
    results, alone = [], []
    got = _shown(mine_many(runs, results))
    for name, own, spec in runs:
        run = mine(own, spec)
        alone += _shown(run.combined().withColumn("dataset", F.lit(name)))
        run.release()
    assert got == sorted(alone) and {r[0] for r in got if r[1] == 2} == {name for name, *_ in runs} and len(results) == 1
    tags = {r.run for r in results[0].uo.select(F.substring("tid", 1, 6).alias("run")).distinct().collect()}
    assert tags == {"000000", "000003", "000005", "000006"}
    # Prices that need no other row are sums of one grouping: two scans in all, for keys of two types.
    text = results[0].uo._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 2 * text.count("Window [") > 0
    results[0].release()


def test_runs_with_no_lines_or_null_keys(spark):
    schema = "tid string, item string, quantity double, unit_price double, dataset string, run string"
    empty = spark.createDataFrame([], schema)
    some = spark.createDataFrame([("t", "a", 1.0, 2.0, "x", "y"), ("t", "b", 1.0, 3.0, "x", "y"), (None, "a", 1.0, 1.0, None, None), ("t", None, 1.0, 1.0, "x", "y")], schema)
    out = mine_many([("none", empty, MineSpec(0, 0)), ("some", some, MineSpec(0, 0))])
    assert [(r[0], r[2], r[3]) for r in _shown(out)] == [("some", "a", ""), ("some", "b", ""), ("some", "a", "b")]


def test_results_are_compared_in_one_grouping(spark):
    a = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c")], "item1 string, item2 string")
    b = spark.createDataFrame([("a", "c"), ("b", "c")], "item1 string, item2 string")
    df = compare(a, b)
    assert "FullOuter" not in _plan(df)
    assert tuple(df.first()) == (2, 2, 1, 3, 1 / 3)
