"""Loaders with temp files: FIXTURES.md §1 edge cases."""

import os

import pytest
from pyspark.sql import functions as F

from basketry import MineSpec, from_table, load_baskets, mine, sample_first, uo_list, write_patterns
from basketry.functions.columns import hash_price
from basketry.schema import require_basket_lines
from basketry.sources.sample import first_lines
from basketry.sources.text import with_tid


def _write(tmp_dir, name, text, encoding="utf-8"):
    p = os.path.join(tmp_dir, name)
    with open(p, "w", encoding=encoding) as f:
        f.write(text)
    return p


def test_line_baskets(spark, tmp_dir):
    p = _write(tmp_dir, "k.txt", "1 2 3\n1\n4 5  6 x7\n\n1 1 2\n")
    df = load_baskets(spark, "Kosarak", p)
    rows = df.collect()
    by_line = {}
    for r in rows:
        by_line.setdefault(r.seq.line_no, []).append(r.item)
    assert sorted(sorted(v) for v in by_line.values()) == [["1"], ["1", "1", "2"], ["1", "2", "3"], ["4", "5", "6"]]
    assert all(r.quantity == 1.0 and r.unit_price == 1.0 for r in rows)
    # repeated item is summed into one entry by the miner
    uo = uo_list(df, MineSpec(0, 0))
    assert uo.count() == 3 + 1 + 3 + 2


def test_line_baskets_hash_price_is_deterministic(spark, tmp_dir):
    p = _write(tmp_dir, "k.txt", "1 2\n2 3\n")
    a = load_baskets(spark, "lines", p, price="hash").orderBy("tid", "item").collect()
    b = load_baskets(spark, "lines", p, price="hash").orderBy("tid", "item").collect()
    assert [r.unit_price for r in a] == [r.unit_price for r in b]
    assert all(1.0 <= r.unit_price < 10.0 for r in a)
    two = [r.unit_price for r in a if r.item == "2"]
    assert len(set(two)) == 1


UTIL = "3 5 1:14:6 5 3\n3 9:7:5 2\n4 8:9\n7 x 2:10:4 1 5\nbroken line\n6:abc:2\n5 6:9:4\n"


def test_utility_lines_zip(spark, tmp_dir):
    p = _write(tmp_dir, "c.txt", UTIL)
    df = load_baskets(spark, "chess", p, utilities="zip", default_price=1.0)
    got = sorted((r.seq.line_no, r.item, r.unit_price, r.tu) for r in df.collect())
    lines = {}
    for ln, item, u, tu in got:
        lines.setdefault(ln, []).append((item, u, tu))
    vals = sorted(lines.values())
    # "broken line" (no colon) is skipped; x is not numeric but keeps position.
    assert [("3", 6.0, 14.0), ("5", 5.0, 14.0), ("1", 3.0, 14.0)] in [sorted(v, key=lambda t: ["3", "5", "1"].index(t[0])) for v in vals if len(v) == 3 and v[0][2] == 14.0]
    line7x = [v for v in vals if v and v[0][2] == 10.0][0]
    assert sorted(line7x) == [("2", 5.0, 10.0), ("7", 4.0, 10.0)]
    # "4 8:9" has no utilities: hash price fallback
    line48 = [v for v in vals if v and v[0][2] == 9.0 and len(v) == 2 and v[0][0] in ("4", "8")][0]
    hp = spark.range(1).select(hash_price(F.lit("4")).alias("h")).first().h
    assert ("4", hp, 9.0) in line48
    # "6:abc:2": non-numeric TU becomes null and is dropped by cleaning
    mined = uo_list(df, MineSpec(0, 0, tu="given"))
    assert mined.where(F.col("tu").isNull()).count() == 0
    assert mined.select("tid").distinct().count() == 5
    # "3 9:7:5 2" is short of nothing; "5 6:9:4" has a short list: 6 gets the hash price
    line56 = [v for v in vals if v and v[0][2] == 9.0 and {x[0] for x in v} == {"5", "6"}][0]
    assert ("5", 4.0, 9.0) in line56
    assert ("6", spark.range(1).select(hash_price(F.lit("6")).alias("h")).first().h, 9.0) in line56


def test_utility_lines_as_items(spark, tmp_dir):
    p = _write(tmp_dir, "m.txt", "3 5 1:14:6 5 3\n4 8:9\n7:2:\n")
    df = load_baskets(spark, "mushroom", p, utilities="as_items")
    # "4 8:9" has no third field and yields nothing; "7:2:" keeps item 7.
    assert sorted(r.item for r in df.collect()) == ["1", "3", "3", "5", "5", "6", "7"]


def test_utility_lines_first_seen_parity(spark, tmp_dir):
    # Python-reader parity: first-seen price from the utilities, floored at 0.01,
    # non-numeric utility -> default price, TU recomputed.
    p = _write(tmp_dir, "c.txt", "1 2:9:4 -3\n2 1:9:7 abc\n")
    df = load_baskets(spark, "chess", p, floor=0.01, default_price=1.0)
    r = mine(df, MineSpec(0, 0, 0, price="first_seen"))
    s = {x.item: x.total_util for x in r.singles.collect()}
    assert s == {"1": pytest.approx(8.0), "2": pytest.approx(0.02)}


RETAIL = (
    "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
    "536365,85123A,X,6,d,2.55,17850,UK\n"
    "536365,71053,X,6,d,3.39,17850,UK\n"
    "536365,85123A,X,2,d,2.55,17850,UK\n"
    "536366,22633,X,6,d,1.85,,UK\n"
    "536367,POST,X,1,d,18.0,12583,FR\n"
    "536367,22633,X,-2,d,1.85,12583,FR\n"
    "536367,21731,X,3,d,0,12583,FR\n"
    "536367,21731,X,3,d,1.65,12583,FR\n"
)


def test_retail_csv(spark, tmp_dir):
    p = _write(tmp_dir, "r.csv", RETAIL, encoding="latin-1")
    df = load_baskets(spark, "online_retail", p, encoding="ISO-8859-1")
    require_basket_lines(df)
    assert df.count() == 7  # null customer dropped
    spec = MineSpec(0, 0, 0, exclude=("POST",), exclude_when="after_tu")
    uo = {(r.tid, r.item): (r.iu, r.tu) for r in uo_list(df, spec).collect()}
    assert uo[("536365", "85123A")][0] == pytest.approx(8 * 2.55)  # repeated item summed
    assert ("536367", "POST") not in uo
    assert uo[("536367", "21731")][1] == pytest.approx(18.0 + 3 * 1.65)  # POST in TU after_tu
    assert df.schema["item"].dataType.simpleString() == "string"


def test_member_day_csv(spark, tmp_dir):
    p = _write(tmp_dir, "g.csv", "Member_number,Date,itemDescription\n1,01-01-2015, milk\n1,01-01-2015,bread \n2,02-01-2015,milk\n,03-01-2015,milk\n")
    df = load_baskets(spark, "grocery", p)
    rows = sorted((r.tid, r.item, r.customer_id) for r in df.collect())
    assert rows == [("1_01-01-2015", "bread", "1"), ("1_01-01-2015", "milk", "1"), ("2_02-01-2015", "milk", "2")]


def test_unknown_source_and_missing_columns(spark, tmp_dir):
    with pytest.raises(ValueError):
        load_baskets(spark, "parquetz", tmp_dir)
    bad = spark.createDataFrame([("a", "b")], "tid string, thing string")
    with pytest.raises(ValueError, match="missing"):
        require_basket_lines(bad)
    p = _write(tmp_dir, "g.csv", "Member,Date\n1,2\n")
    with pytest.raises(ValueError, match="itemDescription"):
        load_baskets(spark, "grocery", p)


def test_from_table_and_sample_first(spark):
    src = spark.createDataFrame(
        [(10, 1, 2.0, 4.0), (2, 1, 1.0, 5.0), (3, 7, 1.0, 1.0), (10, 2, 1.0, 3.0)],
        "o bigint, p bigint, q double, v double",
    )
    lines = from_table(src, "o", "p", "q", F.col("v") / F.col("q"), string_keys=True)
    assert lines.columns == ["tid", "item", "quantity", "unit_price"]
    first = sample_first(lines, 2)  # string order: "10" < "2" < "3"
    assert sorted({r.tid for r in first.collect()}) == ["10", "2"]
    # Source key types are kept by default: the order is then numeric.
    native = from_table(src, "o", "p", "q", F.col("v") / F.col("q"))
    assert sorted({r.tid for r in sample_first(native, 2).collect()}) == [2, 3]


def test_first_lines(spark, tmp_dir):
    p = _write(tmp_dir, "k.txt", "1 2\n\n3\n4 5\n")
    raw = with_tid(spark.read.text(p))
    assert first_lines(raw, 2).count() == 2


def test_write_patterns_roundtrip(spark, tmp_dir, example):
    r = mine(example, MineSpec(0, 0, 0))
    out = os.path.join(tmp_dir, "pairs")
    write_patterns(r.pairs, out)
    back = spark.read.parquet(out)
    assert back.count() == r.pairs.count()


def test_reference_workflow_example(spark, tmp_dir):
    import importlib.util

    spec = importlib.util.spec_from_file_location(
        "reference_workflow", os.path.join(os.path.dirname(os.path.dirname(__file__)), "examples", "reference_workflow.py")
    )
    wf = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(wf)
    p = _write(tmp_dir, "r.csv", RETAIL, encoding="latin-1")
    out = os.path.join(tmp_dir, "out")
    wf.run(spark, "online_retail", p, out, 5.0, 0.05, 0.05, encoding="ISO-8859-1")
    for table in ("profile", "mean_gated", "actual", "comparison"):
        assert spark.read.parquet(os.path.join(out, table)).count() >= 1
    cmp = spark.read.parquet(os.path.join(out, "comparison")).first()
    assert 0.0 <= cmp.jaccard <= 1.0


def test_first_seen_price_over_several_files(spark, tmp_dir):
    """The file named first has the first line, though the other one is larger."""
    for name, text in (("a.txt", "1:4:4\n"), ("b.txt", "1:7:7\n" + "2:3:3\n" * 500)):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(text)
    lines = load_baskets(spark, "utility_lines", tmp_dir, utilities="zip")
    from basketry.operators.utility import first_seen_prices

    assert {r.item: r.unit_profit for r in first_seen_prices(lines).collect()} == {"1": 4.0, "2": 3.0}
