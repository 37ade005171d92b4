"""Properties of the mining operator and brute-force agreement."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry import MineSpec, compare, mine, pair_row_count, uo_list
from basketry.operators import patterns as P
from tests.brute import brute_mine

SCHEMA = "tid string, item string, quantity double, unit_price double"


def _random_rows(seed, n_tids=40, n_items=12, max_len=7):
    rnd = random.Random(seed)
    rows = []
    for t in range(n_tids):
        for _ in range(rnd.randint(1, max_len)):
            item = str(rnd.randint(1, n_items))
            rows.append((f"T{t}", item, float(rnd.randint(1, 5)), float(rnd.randint(1, 20))))
    return rows


def _as_dict(singles, pairs):
    s = {r.item: (r.total_util, r.avg_uo, r.support) for r in singles.collect()}
    p = {(r.item1, r.item2): (r.total_util, r.avg_uo, r.support) for r in pairs.collect()}
    return s, p


def _assert_same(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0], rel=1e-9)
        assert got[k][1] == pytest.approx(want[k][1], rel=1e-9)
        assert got[k][2] == want[k][2]


rows_strategy = st.lists(
    st.tuples(
        st.sampled_from([f"T{i}" for i in range(12)]),
        st.sampled_from(["1", "2", "3", "11", "12", "9", "POST", "a,b"]),
        st.integers(min_value=-1, max_value=4).map(float),
        st.integers(min_value=0, max_value=9).map(float),
    ),
    min_size=1,
    max_size=40,
)


@settings(max_examples=16, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, price=st.sampled_from(["actual", "mean"]), prune=st.sampled_from(["none", "winners", "exact"]),
       placement=st.sampled_from(["after_tu", "before_tu"]), duplicates=st.sampled_from(["sum", "keep"]))
def test_matches_brute_force(spark, rows, price, prune, placement, duplicates):
    df = spark.createDataFrame(rows, SCHEMA)
    spec = MineSpec(5.5, 0.21, 0.41, price=price, prune=prune, exclude=("POST",), exclude_when=placement,
                    split_items=2, duplicates=duplicates)
    r = mine(df, spec)
    got = _as_dict(r.singles, r.pairs)
    # exact pruning has no false dismissals: its answer is the ungated one
    want = brute_mine(rows, 5.5, 0.21, 0.41, price=price, exclude=("POST",), exclude_when=placement,
                      prune="none" if prune == "exact" else prune, duplicates=duplicates)
    _assert_same(got[0], want[0])
    _assert_same(got[1], want[1])
    r.release()


@pytest.fixture(scope="module")
def rnd_df(spark):
    return spark.createDataFrame(_random_rows(7), SCHEMA)


def test_uo_sums_to_one(rnd_df):
    uo = uo_list(rnd_df, MineSpec(0, 0))
    sums = uo.groupBy("tid").agg(F.sum("uo").alias("s")).collect()
    assert sums and all(abs(r.s - 1.0) < 1e-12 for r in sums)


def test_mean_equals_actual_singles_util_when_quantity_constant(spark):
    rows = [(t, i, 1.0, p) for (t, i, _, p) in _random_rows(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    a = {r.item: r.total_util for r in mine(df, MineSpec(0, 0, price="actual")).singles.collect()}
    m = {r.item: r.total_util for r in mine(df, MineSpec(0, 0, price="mean")).singles.collect()}
    assert a.keys() == m.keys()
    for k in a:
        assert a[k] == pytest.approx(m[k], rel=1e-9)


def test_pair_uo_in_unit_interval(rnd_df):
    p = mine(rnd_df, MineSpec(0, 0, 0)).pairs.collect()
    assert p and all(0 < r.avg_uo <= 1 + 1e-12 for r in p)


def test_winners_subset_of_none_and_exact_equals_none(rnd_df):
    base = dict(min_util=40.5, min_uo_single=0.2, min_uo_pair=0.45)
    none = {(r.item1, r.item2) for r in mine(rnd_df, MineSpec(prune="none", **base)).pairs.collect()}
    win = {(r.item1, r.item2) for r in mine(rnd_df, MineSpec(prune="winners", **base)).pairs.collect()}
    exact = {(r.item1, r.item2) for r in mine(rnd_df, MineSpec(prune="exact", **base)).pairs.collect()}
    assert win <= none
    assert exact == none


def test_exact_prune_removes_items_at_high_threshold(rnd_df):
    bounds = sorted(r.util_bound for r in P.exact_bounds(uo_list(rnd_df, MineSpec(0, 0))).collect())
    cut = (bounds[len(bounds) // 2] + bounds[len(bounds) // 2 + 1]) / 2
    r = mine(rnd_df, MineSpec(cut, 0.1, 0.3, prune="exact"))
    n_items = rnd_df.select("item").distinct().count()
    assert r.candidates.select("item").distinct().count() < n_items
    none = mine(rnd_df, MineSpec(cut, 0.1, 0.3, prune="none")).pairs
    assert sorted(map(tuple, r.pairs.collect())) == sorted(map(tuple, none.collect()))


def test_pair_rows_equal_sum_of_n_choose_2(rnd_df):
    uo = uo_list(rnd_df, MineSpec(0, 0))
    direct = P.pair_rows(uo).count()
    assert pair_row_count(uo).first().pair_rows == direct


@pytest.mark.parametrize("split_items", [1, 2, 3, 1000])
def test_split_items_does_not_change_pairs(rnd_df, split_items):
    ref = mine(rnd_df, MineSpec(0, 0, 0, split_items=10**6)).pairs
    got = mine(rnd_df, MineSpec(0, 0, 0, split_items=split_items)).pairs
    a = sorted((r.item1, r.item2, round(r.total_util, 9), round(r.avg_uo, 12), r.support) for r in ref.collect())
    b = sorted((r.item1, r.item2, round(r.total_util, 9), round(r.avg_uo, 12), r.support) for r in got.collect())
    assert a == b


def test_hot_transaction_is_split_over_slices(spark):
    # One transaction holds most rows: its pair join is spread over slices.
    rows = [("HOT", str(i), 1.0, float(1 + i % 7)) for i in range(60)]
    rows += [(f"T{t}", str(t % 5), 1.0, 2.0) for t in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    uo = uo_list(df, MineSpec(0, 0))
    hot = P.pair_rows(uo, split_items=8, keep_cells=True).where(F.col("tid") == "HOT")
    assert hot.count() == 60 * 59 // 2
    cells = hot.groupBy("cell_a", "cell_b").count().collect()
    # S = ceil(60 / 8) = 8 slices per side: the pairs spread over many cells,
    # none holding the whole transaction.
    assert len(cells) > 20
    assert max(c["count"] for c in cells) < 60 * 59 // 2 // 10
    got = mine(df, MineSpec(0, 0, 0, split_items=8)).pairs
    ref = mine(df, MineSpec(0, 0, 0, split_items=10**6)).pairs
    a = sorted((r.item1, r.item2, round(r.total_util, 9), r.support) for r in got.collect())
    b = sorted((r.item1, r.item2, round(r.total_util, 9), r.support) for r in ref.collect())
    assert a == b and len(a) == 60 * 59 // 2


def test_repartition_invariance(rnd_df):
    a = mine(rnd_df, MineSpec(0, 0, 0)).pairs
    b = mine(rnd_df.repartition(5, "item"), MineSpec(0, 0, 0)).pairs
    ra = sorted((r.item1, r.item2, round(r.total_util, 9), r.support) for r in a.collect())
    rb = sorted((r.item1, r.item2, round(r.total_util, 9), r.support) for r in b.collect())
    assert ra == rb


def test_jaccard_identity_and_empty(rnd_df):
    p = mine(rnd_df, MineSpec(0, 0, 0)).pairs
    assert compare(p, p).first().jaccard == 1.0
    empty = p.where(F.lit(False))
    row = compare(empty, empty).first()
    assert (row.n_any, row.jaccard) == (0, 0.0)


def test_exact_bounds_match_brute_force_with_ties(spark):
    rnd = random.Random(11)
    rows = []
    for t in range(30):
        items = rnd.sample([str(i) for i in range(8)], rnd.randint(1, 6))
        for it in items:
            rows.append((f"T{t}", it, 1.0, float(rnd.choice([2, 2, 3, 5]))))  # many ties
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.item: (r.util_bound, r.uo_bound) for r in P.exact_bounds(uo_list(df, MineSpec(0, 0))).collect()}
    baskets = {}
    for t, i, q, p in rows:
        baskets.setdefault(t, {})[i] = q * p
    want = {}
    for t, b in baskets.items():
        tu = sum(b.values())
        for i, u in b.items():
            others = [v for j, v in b.items() if j != i]
            if not others:
                continue
            m = max(others)
            s, o = want.get(i, (0.0, 0.0))
            want[i] = (s + u + m, max(o, (u + m) / tu))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0])
        assert got[k][1] == pytest.approx(want[k][1])


@pytest.mark.parametrize("reuse", ["persist", "checkpoint", "none"])
def test_reuse_modes_agree(rnd_df, reuse):
    base = mine(rnd_df, MineSpec(10.5, 0.2, 0.4, prune="winners"))
    got = mine(rnd_df, MineSpec(10.5, 0.2, 0.4, prune="winners", reuse=reuse))
    key = lambda r: (r.item1, r.item2, round(r.total_util, 9), round(r.avg_uo, 12), r.support)
    assert sorted(map(key, got.pairs.collect())) == sorted(map(key, base.pairs.collect()))
    got.release()
    base.release()


@pytest.mark.parametrize("prune", ["none", "winners", "exact"])
def test_tu_by_aggregate_equals_window(rnd_df, prune):
    key = lambda r: (r.item1, r.item2, round(r.total_util, 9), round(r.avg_uo, 12), r.support)
    a = mine(rnd_df, MineSpec(10.5, 0.2, 0.4, prune=prune))
    b = mine(rnd_df, MineSpec(10.5, 0.2, 0.4, prune=prune, tu_by="aggregate", split_items=3))
    assert sorted(map(key, a.pairs.collect())) == sorted(map(key, b.pairs.collect()))
    sa = sorted((r.item, round(r.total_util, 9), r.support) for r in a.singles.collect())
    sb = sorted((r.item, round(r.total_util, 9), r.support) for r in b.singles.collect())
    assert sa == sb


def test_lazy_mode_without_library_broadcasts(spark, rnd_df):
    key = lambda r: (r.item1, r.item2, round(r.total_util, 9), round(r.avg_uo, 12), r.support)
    a = mine(rnd_df, MineSpec(10.5, 0.2, 0.4, price="mean", prune="winners"))
    jobs_before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert jobs_before  # the eager run above did start jobs, and the tracker sees them
    b = mine(rnd_df, MineSpec(10.5, 0.2, 0.4, price="mean", prune="winners", broadcast_max_rows=0, reuse="none"))
    # building the lazy run started no Spark job
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == jobs_before
    assert sorted(map(key, a.pairs.collect())) == sorted(map(key, b.pairs.collect()))


def test_hot_copy_group_is_one_entry_in_keep_mode(spark):
    rows = [("T0", "A", 1.0, 2.0)] * 5000 + [("T0", "B", 1.0, 3.0), ("T0", "C", 2.0, 1.0), ("T1", "A", 1.0, 2.0),
                                               ("T1", "B", 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    uo = uo_list(df, MineSpec(0, 0, duplicates="keep"))
    a_row = uo.where((F.col("tid") == "T0") & (F.col("item") == "A")).collect()
    assert len(a_row) == 1 and a_row[0].mult == 5000
    r = mine(df, MineSpec(0, 0, 0, duplicates="keep"))
    got = _as_dict(r.singles, r.pairs)
    want = brute_mine(rows, 0, 0, 0, duplicates="keep")
    _assert_same(got[0], want[0])
    _assert_same(got[1], want[1])
    assert got[1][("A", "B")][2] == 5000 + 1  # m*n pair rows: 5000 in T0, 1 in T1


def test_pair_cooccurrence_counts_copies_in_keep_mode(spark):
    from basketry import pair_cooccurrence

    rows = [("T0", "A", 1.0, 2.0)] * 3 + [("T0", "B", 1.0, 3.0)] * 2 + [("T1", "A", 1.0, 1.0), ("T1", "B", 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.tid, r.copies) for r in pair_cooccurrence(uo_list(df, MineSpec(0, 0, duplicates="keep"))).collect()}
    assert got == {("T0", 6), ("T1", 1)}
    plain = pair_cooccurrence(uo_list(df, MineSpec(0, 0))).columns
    assert plain == ["item1", "item2", "tid"]


def test_keep_mode_exact_bounds_prune_and_stay_exact(spark):
    rnd = random.Random(5)
    rows = []
    for t in range(30):
        for _ in range(rnd.randint(1, 7)):
            rows.append((f"T{t}", str(rnd.randint(1, 8)), float(rnd.randint(1, 3)), float(rnd.randint(1, 9))))
    df = spark.createDataFrame(rows, SCHEMA)
    bounds = sorted(r.util_bound for r in P.exact_bounds(uo_list(df, MineSpec(0, 0, duplicates="keep"))).collect())
    cut = (bounds[len(bounds) // 2] + bounds[len(bounds) // 2 + 1]) / 2
    spec = MineSpec(cut, 0.1, 0.2, duplicates="keep")
    exact = mine(df, spec.with_(prune="exact"))
    assert exact.candidates.select("item").distinct().count() < df.select("item").distinct().count()
    want = brute_mine(rows, cut, 0.1, 0.2, duplicates="keep")[1]
    got = {(r.item1, r.item2): (r.total_util, r.avg_uo, r.support) for r in exact.pairs.collect()}
    _assert_same(got, want)
