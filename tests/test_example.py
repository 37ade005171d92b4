"""Worked example of FIXTURES.md §3: exact values for every policy mix."""

import pytest

from basketry import MineSpec, mine

# The expected cells of FIXTURES.md §3 (total_util, avg_uo, support).
ACTUAL = {
    "none": {
        "A": (15, 0.2647, 3), "B": (20, 0.3496, 3), "C": (34, 0.6786, 2), "POST": (16, 0.8000, 1),
        "A,B": (27, 0.7500, 2), "A,C": (16, 0.8000, 1), "A,POST": (20, 1.0000, 1), "B,C": (42, 0.8500, 2),
    },
    "after_tu": {
        "A": (15, 0.2647, 3), "B": (20, 0.3496, 3), "C": (34, 0.6786, 2),
        "A,B": (27, 0.7500, 2), "A,C": (16, 0.8000, 1), "B,C": (42, 0.8500, 2),
    },
    "before_tu": {
        "A": (15, 0.5314, 3), "B": (20, 0.3496, 3), "C": (34, 0.6786, 2),
        "A,B": (27, 0.7500, 2), "A,C": (16, 0.8000, 1), "B,C": (42, 0.8500, 2),
    },
}
MEAN = {
    "none": {
        "A": (16, 0.2790, 3), "B": (20, 0.3590, 3), "C": (34.6667, 0.6430, 2), "POST": (16, 0.8000, 1),
        "A,B": (28, 0.7903, 2), "A,C": (16.6667, 0.8065, 1), "A,POST": (20, 1.0000, 1), "B,C": (42.6667, 0.8065, 2),
    },
    "after_tu": {
        "A": (16, 0.2790, 3), "B": (20, 0.3590, 3), "C": (34.6667, 0.6430, 2),
        "A,B": (28, 0.7903, 2), "A,C": (16.6667, 0.8065, 1), "B,C": (42.6667, 0.8065, 2),
    },
    "before_tu": {
        "A": (16, 0.5457, 3), "B": (20, 0.3590, 3), "C": (34.6667, 0.6430, 2),
        "A,B": (28, 0.7903, 2), "A,C": (16.6667, 0.8065, 1), "B,C": (42.6667, 0.8065, 2),
    },
}


def _cells(result):
    out = {}
    for r in result.singles.collect():
        out[r.item] = (round(r.total_util, 4), round(r.avg_uo, 4), r.support)
    for r in result.pairs.collect():
        out[r.itemset] = (round(r.total_util, 4), round(r.avg_uo, 4), r.support)
    return out


@pytest.mark.parametrize("price,table", [("actual", ACTUAL), ("mean", MEAN)])
@pytest.mark.parametrize("placement", ["none", "after_tu", "before_tu"])
def test_worked_example(example, price, table, placement):
    kw = {} if placement == "none" else {"exclude": ("POST",), "exclude_when": placement}
    r = mine(example, MineSpec(0, 0, 0, price=price, **kw))
    got = _cells(r)
    want = {k: (float(v[0]), v[1], v[2]) for k, v in table[placement].items()}
    assert set(got) == set(want)
    for k, (u, o, s) in want.items():
        gu, go, gs = got[k]
        assert gu == pytest.approx(u, abs=1e-4), k
        assert go == pytest.approx(o, abs=1e-4), k
        assert gs == s, k
    r.release()


def test_gate_example(example):
    # actual price, no denylist, minUtil 20 (19.5), UO 0.35 single / 0.75 (0.749) pair
    gated = mine(example, MineSpec(19.5, 0.35, 0.749, prune="winners"))
    assert [r.item for r in gated.singles.collect()] == ["C"]
    assert gated.pairs.count() == 0
    ungated = mine(example, MineSpec(19.5, 0.35, 0.749, prune="none"))
    assert sorted(r.itemset for r in ungated.pairs.collect()) == ["A,B", "A,POST", "B,C"]


def test_exact_prune_equals_ungated(example):
    a = mine(example, MineSpec(19.5, 0.35, 0.749, prune="exact")).pairs
    b = mine(example, MineSpec(19.5, 0.35, 0.749, prune="none")).pairs
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_spec_rejects_bad_policy():
    with pytest.raises(ValueError):
        MineSpec(1, 0.1, price="random")
    with pytest.raises(ValueError):
        MineSpec(1, 0.1, split_items=0)


def test_duplicates_keep_counts_each_line(example):
    r = mine(example, MineSpec(0, 0, 0, duplicates="keep"))
    cells = _cells(r)
    # C is two lines in T3 (utilities 16 and 8): support 3 entries, and the
    # pair B,C counts T3 twice (m*n) plus T1.
    assert cells["C"][2] == 3
    assert cells["B,C"][2] == 3


def test_denylist_and_allowlist_frames(spark, example):
    from basketry.operators.clean import exclude_items, keep_items

    deny = spark.createDataFrame([("POST",), ("C",)], "code string")
    kept = {r.item for r in exclude_items(example, deny).collect()}
    assert kept == {"A", "B"}
    allow = {r.item for r in keep_items(example, deny).collect()}
    assert allow == {"POST", "C"}
    # literal lists on a numeric item column compare as text (no ANSI cast error)
    nums = spark.createDataFrame([(1, 7), (1, 8)], "tid bigint, item bigint")
    assert [r.item for r in exclude_items(nums, ["7", "POST"]).collect()] == [8]


def test_named_pipelines(example):
    from basketry import actual_price, mean_price_gated

    m = mean_price_gated(19.5, 0.2, 0.5)
    assert (m.price, m.prune, m.pair_uo) == ("mean", "winners", 0.5)
    g = actual_price(19.5, 0.35)
    u = actual_price(19.5, 0.35, gated=False)
    assert (g.prune, u.prune, g.price) == ("winners", "none", "actual")
    assert mine(example, u).pairs.count() >= mine(example, g).pairs.count()


def test_nan_and_non_positive_lines_are_dropped(spark):
    from basketry.operators.clean import clean_lines

    df = spark.createDataFrame(
        [("T1", "A", 1.0, float("nan")), ("T1", "B", float("nan"), 2.0), ("T1", "C", 0.0, 2.0),
         ("T1", "D", 1.0, -1.0), ("T1", "E", 1.0, 2.0), (None, "F", 1.0, 2.0)],
        "tid string, item string, quantity double, unit_price double",
    )
    assert [r.item for r in clean_lines(df).collect()] == ["E"]


@pytest.mark.parametrize("prune", ["none", "winners", "exact"])
def test_empty_input(spark, prune):
    from basketry import compare

    empty = spark.createDataFrame([], "tid string, item string, quantity double, unit_price double")
    r = mine(empty, MineSpec(1.0, 0.1, 0.1, price="mean", prune=prune))
    assert r.singles.count() == 0 and r.pairs.count() == 0
    row = compare(r.pairs, r.pairs).first()
    assert (row.n_any, row.jaccard) == (0, 0.0)
