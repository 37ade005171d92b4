"""Driver queries: each SURVEY §7.3 query as a Spark function plus its oracle.

``REGISTRY[name] = (spark_fn, oracle_sql_or_None)``; ``spark_fn(spark,
sf_dir)`` returns a lazy DataFrame over the given tables.  Every query reads
whole tables (no id subsets, no row caps; limits only where a top-k or a
first-N sample is the feature).  Outputs round utilities to 2 places and
occupancies to 6 on both sides, as the last step.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles as O
from basketry import (
    MineSpec,
    any_patterns,
    basket_items,
    basket_lists,
    common_patterns,
    compare,
    distinct_transactions,
    from_table,
    item_catalogue,
    item_support,
    merged_transactions,
    mine_many,
    mine_together,
    pair_cooccurrence,
    pair_row_count,
    pair_tid_bitmaps,
    only_left,
    pattern_counts,
    profile,
    rejected_lines,
    remaining_occupancy,
    row_utility,
    sample_first,
    top_pairs,
    top_singles,
    transaction_sketch,
    tu_mismatch,
    tu_summary,
    uo_head,
    uo_list,
    with_stable_ids,
)
from basketry import mine as _mine
from basketry.operators.clean import clean_lines, exclude_items, keep_numeric_items, merge_duplicates
from basketry.operators.patterns import in_buckets, orient, pair_rows
from basketry.operators.sizing import task_count
from basketry.operators.utility import mean_prices, transaction_totals, transaction_utility, uo_entries
from basketry.sources.csv import parse_member_day, parse_retail
from basketry.sources.text import parse_line_baskets, parse_utility_lines

# Thresholds per dataset, chosen off the data values at sf0.01.
L_T = dict(min_util=100000.005, min_uo_single=0.25013, min_uo_pair=0.50013)
B_T = dict(min_util=30000000.005, min_uo_single=0.2651, min_uo_pair=0.4123)
N_T = dict(min_util=5000000.005, min_uo_single=0.2511, min_uo_pair=0.4011)
V_T = dict(min_util=97000.005, min_uo_single=0.2011, min_uo_pair=0.3981)
G_T = dict(min_util=1000.005, min_uo_single=0.2011, min_uo_pair=0.4011)
BRAND_DENYLIST = ("Brand#13", "Brand#22", "Brand#7")
MIN_TU = 200000.005
SAMPLE_N = 100
TOP_K = 20


# ---------------------------------------------------------------- inputs

def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines_l(spark, d, string_keys: bool = False) -> DataFrame:
    """L: lineitem; tid = order, item = part, price = extendedprice / quantity."""
    li = _t(spark, d, "lineitem")
    return from_table(
        li,
        tid="l_orderkey",
        item="l_partkey",
        quantity="l_quantity",
        unit_price=F.try_divide("l_extendedprice", "l_quantity"),
        seq=F.struct("l_orderkey", "l_linenumber"),
        string_keys=string_keys,
    )


def _lines_part(spark, d, attr: str, string_keys: bool = False) -> DataFrame:
    li = _t(spark, d, "lineitem")
    part = _t(spark, d, "part").select("p_partkey", attr)
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    return from_table(
        j,
        tid="l_orderkey",
        item=attr,
        quantity="l_quantity",
        unit_price=F.try_divide("l_extendedprice", "l_quantity"),
        seq=F.struct("l_orderkey", "l_linenumber"),
        string_keys=string_keys,
    )


def lines_b(spark, d) -> DataFrame:
    """B: item = part brand (25 values)."""
    return _lines_part(spark, d, "p_brand")


def lines_n(spark, d, string_keys: bool = False) -> DataFrame:
    """N: item = part name (64 values)."""
    return _lines_part(spark, d, "p_name", string_keys)


def lines_v(spark, d) -> DataFrame:
    """V: events; tid = user, item = event type, quantity 1, price = value."""
    ev = _t(spark, d, "events")
    return from_table(ev, tid="user_id", item="event_type", unit_price="value", seq="event_id")


def lines_g(spark, d) -> DataFrame:
    """orders joined to lineitem with the order total as given TU.

    The join is on the transaction, so entries and TU need no further shuffle and share its
    tasks: their number follows the rows of lineitem.
    """
    o = _t(spark, d, "orders")
    li = _t(spark, d, "lineitem")
    tasks = task_count(li)
    j = o.repartition(tasks, "o_orderkey").join(li.repartition(tasks, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "inner")
    return from_table(
        j,
        tid="o_orderkey",
        item="l_partkey",
        quantity="l_quantity",
        unit_price=F.try_divide("l_extendedprice", "l_quantity"),
        tu="o_totalprice",
    )


# ---------------------------------------------------------------- output shapes

def _round(c: str, places: int):
    """Round half away from zero on the binary value: ``floor(x * 10^k + 0.5)
    / 10^k`` for the non-negative values here, as the oracle's ``round``
    computes it.  (Spark's ``round`` rounds the decimal string of the double,
    which differs on exact ties such as prices of ``extendedprice / 8``.)"""
    m = float(10**places)
    return (F.floor(F.col(c) * F.lit(m) + F.lit(0.5)) / F.lit(m)).alias(c)


def _r(df: DataFrame, util=(), uo=(), places_util: int = 2, places_uo: int = 6) -> DataFrame:
    out = df
    for c in util:
        out = out.withColumn(c, _round(c, places_util))
    for c in uo:
        out = out.withColumn(c, _round(c, places_uo))
    return out


def _singles_out(df):
    return _r(df.select("item", "total_util", "avg_uo", "support"), ["total_util"], ["avg_uo"])


def _pairs_out(df):
    return _r(
        df.select("item1", "item2", "total_util", "avg_uo", "support", "itemset"), ["total_util"], ["avg_uo"]
    )


def _uo_out(df):
    return _r(df.select(_s("tid"), _s("item"), "iu", "tu", "uo", "n_items"), ["iu", "tu"], ["uo"])


def _s(c: str):
    """Keys as text in outputs (the oracle's VARCHAR keys)."""
    return F.col(c).cast("string").alias(c)


def _line_out(df):
    return df.select(_s("tid"), _s("item"), "quantity", "unit_price")


LINE_COLS = ["tid", "item", "quantity", "unit_price"]
SQL_LINE_COLS = "SELECT tid, item, quantity, unit_price FROM lines"
SQL_UO_OUT = "SELECT tid, item, round(iu, 2) AS iu, round(tu, 2) AS tu, round(uo, 6) AS uo, n_items FROM uo"


def _mine_sql(raw, tail, **kw):
    return O.mine_ctes(raw, **kw) + tail


# ---------------------------------------------------------------- queries

REGISTRY: dict = {}

# What the latest query holds (P1): its frames are lazy, so the next query releases it.
_HELD: list = []


def release_held() -> None:
    """Free the UO-lists and small sides that the latest query held."""
    while _HELD:
        _HELD.pop().release()


def mine(lines, spec):
    _HELD.append(_mine(lines, spec))
    return _HELD[-1]


def query(name, sql=None):
    def deco(fn):
        @wraps(fn)
        def run(spark, d):
            release_held()
            return fn(spark, d)

        REGISTRY[name] = (run, sql)
        return run

    return deco


@query("table_baskets_clean", "WITH " + O.lines_ctes(O.LINES_L) + SQL_LINE_COLS)
def q_table_baskets_clean(spark, d):
    return _line_out(clean_lines(lines_l(spark, d)))


@query(
    "denylist_filter",
    "WITH " + O.lines_ctes(O.LINES_B) + SQL_LINE_COLS + f" WHERE item NOT IN ({O._in_list(BRAND_DENYLIST)})",
)
def q_denylist_filter(spark, d):
    return _line_out(exclude_items(clean_lines(lines_b(spark, d)), BRAND_DENYLIST))


@query(
    "allowlist_semi",
    _mine_sql(
        O.LINES_B,
        "SELECT tid, item, round(iu, 2) AS iu, round(tu, 2) AS tu, round(uo, 6) AS uo, n_items FROM cand",
        prune="winners",
        **B_T,
    ),
)
def q_allowlist_semi(spark, d):
    r = mine(lines_b(spark, d), MineSpec(prune="winners", **B_T))
    return _uo_out(r.candidates)


@query(
    "numeric_token_filter",
    "WITH raw AS ((" + O.LINES_N + ") UNION ALL (" + O.LINES_L + ")),\nlines AS (" + O.CLEAN.format(extra="") + ")\n"
    + SQL_LINE_COLS + " WHERE regexp_matches(item, '^[0-9]+$')",
)
def q_numeric_token_filter(spark, d):
    both = lines_n(spark, d, string_keys=True).unionByName(lines_l(spark, d, string_keys=True))
    return _line_out(keep_numeric_items(clean_lines(both)))


@query(
    "unit_profit_mean",
    "WITH " + O.lines_ctes(O.LINES_L)
    + "SELECT item, round(avg(unit_price), 6) AS unit_profit FROM lines GROUP BY item",
)
def q_unit_profit_mean(spark, d):
    return _r(mean_prices(clean_lines(lines_l(spark, d))).select(_s("item"), "unit_profit"), uo=["unit_profit"])


@query(
    "item_catalogue",
    "WITH " + O.lines_ctes(O.LINES_L)
    + "SELECT item, round(greatest(arg_min(unit_price, {'a': seq1, 'b': seq2}), 0.01), 6) AS unit_profit, "
    "count(*) AS n_lines FROM lines GROUP BY item",
)
def q_item_catalogue(spark, d):
    cat = item_catalogue(clean_lines(lines_l(spark, d)), "first_seen")
    return _r(cat.select(_s("item"), "unit_profit", "n_lines"), uo=["unit_profit"])


def _row_util_q(price):
    def fn(spark, d):
        spec = MineSpec(0, 0, price=price)
        u = row_utility(clean_lines(lines_l(spark, d)), spec)
        return _r(u.select(_s("tid"), _s("item"), "util"), uo=["util"], places_uo=4)

    sql = _mine_sql(O.LINES_L, "SELECT tid, item, round(util, 4) AS util FROM util", min_util=0, min_uo_single=0, price=price)
    return fn, sql


for _name, _price in (
    ("row_util_actual", "actual"),
    ("row_util_mean", "mean"),
    ("price_constant", "constant"),
    ("price_hash", "hash"),
    ("price_first_seen", "first_seen"),
):
    REGISTRY[_name] = _row_util_q(_price)


@query(
    "transaction_utility",
    _mine_sql(O.LINES_L, "SELECT tid, round(tu, 2) AS tu, n_items FROM tt", min_util=0, min_uo_single=0),
)
def q_transaction_utility(spark, d):
    spec = MineSpec(0, 0)
    e = uo_entries(clean_lines(lines_l(spark, d)), spec)
    t = transaction_utility(e).where(F.col("tu") > 0)
    return _r(t.select(_s("tid"), "tu", "n_items"), ["tu"])


@query(
    "tu_filtered",
    _mine_sql(O.LINES_L, "SELECT tid, round(tu, 2) AS tu FROM tt", min_util=0, min_uo_single=0, min_tu=MIN_TU),
)
def q_tu_filtered(spark, d):
    uo = uo_list(lines_l(spark, d), MineSpec(0, 0, min_tu=MIN_TU))
    return _r(uo.select(_s("tid"), "tu").distinct(), ["tu"])


@query(
    "merge_duplicates",
    "WITH " + O.lines_ctes(O.LINES_L)
    + "SELECT tid, item, sum(quantity) AS quantity, round(sum(quantity * unit_price) / sum(quantity), 6) AS unit_price, "
    "count(*) AS n_lines FROM lines GROUP BY tid, item",
)
def q_merge_duplicates(spark, d):
    m = merge_duplicates(clean_lines(lines_l(spark, d)))
    return _r(m.select(_s("tid"), _s("item"), "quantity", "unit_price", "n_lines"), uo=["unit_price"])


@query(
    "basket_lists",
    "WITH " + O.lines_ctes(O.LINES_L)
    + ", d AS (SELECT DISTINCT tid, item FROM lines) "
    "SELECT tid, string_agg(item, ' ' ORDER BY item) AS basket FROM d GROUP BY tid",
)
def q_basket_lists(spark, d):
    return basket_lists(clean_lines(lines_l(spark, d))).select(_s("tid"), "basket")


@query("uo_list", _mine_sql(O.LINES_L, SQL_UO_OUT, min_util=0, min_uo_single=0))
def q_uo_list(spark, d):
    return _uo_out(uo_list(lines_l(spark, d), MineSpec(0, 0)))


@query(
    "uo_list_head",
    _mine_sql(O.LINES_L, SQL_UO_OUT + f" ORDER BY tid, item LIMIT {TOP_K}", min_util=0, min_uo_single=0),
)
def q_uo_list_head(spark, d):
    return _uo_out(uo_head(uo_list(lines_l(spark, d, string_keys=True), MineSpec(0, 0)), TOP_K))


@query("tu_given_uo_list", _mine_sql(O.LINES_G, SQL_UO_OUT, min_util=0, min_uo_single=0, tu="given"))
def q_tu_given_uo_list(spark, d):
    return _uo_out(uo_list(lines_g(spark, d), MineSpec(0, 0, tu="given")))


@query(
    "pairs_tu_given",
    _mine_sql(O.LINES_G, O.PAIRS_OUT_SQL, tu="given", prune="none", **G_T),
)
def q_pairs_tu_given(spark, d):
    return _pairs_out(mine(lines_g(spark, d), MineSpec(tu="given", **G_T)).pairs)


def _order_texts(spark, d, token_sep: str, fmt: str) -> DataFrame:
    """One text line per order (orders without lines give an empty line).

    This writes the one-basket-per-line file format from the table: each
    row holds the lines of one order, bounded by that order's line count,
    which is the format itself.  Parsing then runs on these whole lines.
    """
    li = _t(spark, d, "lineitem")
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    per = li.groupBy("l_orderkey").agg(
        F.array_sort(
            F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("p"), "l_extendedprice"))
        ).alias("ls"),
        F.sum("l_extendedprice").alias("tu"),
        F.min("l_returnflag").alias("flag"),
    )
    items = F.array_join(F.transform("ls", lambda x: x["p"]), token_sep)
    if fmt == "basket":
        text = F.concat_ws(" ", items, F.concat(F.lit("x"), F.col("flag")))
    elif fmt == "zip":
        utils = F.array_join(F.transform("ls", lambda x: x["l_extendedprice"].cast("string")), " ")
        text = F.concat_ws(":", items, F.col("tu").cast("string"), utils)
    else:  # as_items: integer utilities so they read as items
        utils = F.array_join(
            F.transform("ls", lambda x: F.floor(x["l_extendedprice"]).cast("bigint").cast("string")), " "
        )
        text = F.concat_ws(":", items, F.col("tu").cast("string"), utils)
    lines = per.select("l_orderkey", text.alias("value"))
    return o.join(lines, "l_orderkey", "left").select(
        F.col("l_orderkey").alias("okey"), F.coalesce("value", F.lit("")).alias("value")
    )


@query(
    "line_baskets_parse",
    "SELECT CAST(l_orderkey AS VARCHAR) AS tid, CAST(l_partkey AS VARCHAR) AS item, "
    "CAST(count(*) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1, 2",
)
def q_line_baskets_parse(spark, d):
    texts = _order_texts(spark, d, "  ", "basket")
    parsed = parse_line_baskets(texts, key="okey")
    return parsed.groupBy(_s("tid"), "item").agg(F.sum("quantity").alias("quantity"))


@query(
    "utility_lines_parse_zip",
    "WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS tid, CAST(l_partkey AS VARCHAR) AS item, "
    "sum(l_extendedprice) AS iu FROM lineitem GROUP BY 1, 2), "
    "t AS (SELECT tid, sum(iu) AS tu, count(*) AS n_items FROM e GROUP BY tid) "
    "SELECT e.tid, e.item, round(e.iu, 2) AS iu, round(t.tu, 2) AS tu, round(e.iu / t.tu, 6) AS uo, t.n_items "
    "FROM e JOIN t USING (tid)",
)
def q_utility_lines_parse_zip(spark, d):
    texts = _order_texts(spark, d, " ", "zip")
    parsed = parse_utility_lines(texts, key="okey", utilities="zip")
    return _uo_out(uo_list(parsed, MineSpec(0, 0, tu="given")))


@query(
    "utility_lines_parse_as_items",
    "WITH tok AS (SELECT CAST(l_orderkey AS VARCHAR) AS tid, CAST(l_partkey AS VARCHAR) AS item FROM lineitem "
    "UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) FROM lineitem) "
    "SELECT tid, item, CAST(count(*) AS DOUBLE) AS quantity FROM tok GROUP BY tid, item",
)
def q_utility_lines_parse_as_items(spark, d):
    texts = _order_texts(spark, d, " ", "as_items")
    parsed = parse_utility_lines(texts, key="okey", utilities="as_items")
    return clean_lines(parsed).groupBy(_s("tid"), "item").agg(F.sum("quantity").alias("quantity"))


@query(
    "member_day_baskets",
    "SELECT CAST(o_custkey AS VARCHAR) || '_' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS tid, "
    "trim(o_orderpriority) AS item, CAST(o_custkey AS VARCHAR) AS customer_id, CAST(count(*) AS DOUBLE) AS quantity "
    "FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL "
    "GROUP BY 1, 2, 3",
)
def q_member_day_baskets(spark, d):
    lines = _member_day_lines(spark, d)
    return lines.groupBy("tid", "item", "customer_id").agg(F.sum("quantity").alias("quantity"))


def _member_day_lines(spark, d, **kw):
    o = _t(spark, d, "orders").select(
        F.col("o_custkey").alias("Member_number"),
        F.col("o_orderdate").cast("date").alias("Date"),
        F.col("o_orderpriority").alias("itemDescription"),
    )
    return parse_member_day(o, **kw)


_G_LINES = (
    "SELECT CAST(o_custkey AS VARCHAR) || '_' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS tid, "
    "trim(o_orderpriority) AS item, CAST(1.0 AS DOUBLE) AS quantity, CAST(1.0 AS DOUBLE) AS unit_price, 0 AS seq1, 0 AS seq2 FROM orders"
)


@query(
    "mine_member_day_keep",
    _mine_sql(_G_LINES, O.PAIRS_OUT_SQL, price="constant", duplicates="keep", prune="winners",
              min_util=2.5, min_uo_single=0.2011, min_uo_pair=0.2011),
)
def q_mine_member_day_keep(spark, d):
    spec = MineSpec(2.5, 0.2011, 0.2011, price="constant", duplicates="keep", prune="winners")
    return _pairs_out(mine(_member_day_lines(spark, d), spec).pairs)


@query(
    "sample_first_n",
    "WITH " + O.lines_ctes(O.LINES_L)
    + SQL_LINE_COLS + f" WHERE tid IN (SELECT DISTINCT tid FROM lines ORDER BY tid LIMIT {SAMPLE_N})",
)
def q_sample_first_n(spark, d):
    return _line_out(sample_first(clean_lines(lines_l(spark, d, string_keys=True)), SAMPLE_N))


@query("item_support", _mine_sql(O.LINES_B, "SELECT item, count(*) AS support FROM uo GROUP BY item", min_util=0, min_uo_single=0))
def q_item_support(spark, d):
    return item_support(uo_list(lines_b(spark, d), MineSpec(0, 0)))


@query(
    "pair_cooccurrence",
    _mine_sql(
        O.LINES_B,
        "SELECT a.item AS item1, b.item AS item2, a.tid FROM uo a JOIN uo b ON a.tid = b.tid AND a.item < b.item",
        min_util=0,
        min_uo_single=0,
    ),
)
def q_pair_cooccurrence(spark, d):
    return pair_cooccurrence(uo_list(lines_b(spark, d), MineSpec(0, 0))).select("item1", "item2", _s("tid"))


@query("distinct_transactions", _mine_sql(O.LINES_L, "SELECT count(DISTINCT tid) AS n_transactions FROM uo", min_util=0, min_uo_single=0))
def q_distinct_transactions(spark, d):
    return distinct_transactions(transaction_totals(lines_l(spark, d), MineSpec(0, 0)))


@query(
    "pair_row_count",
    _mine_sql(O.LINES_L, "SELECT count(*) AS pair_rows FROM uo a JOIN uo b ON a.tid = b.tid AND a.item < b.item", min_util=0, min_uo_single=0),
)
def q_pair_row_count(spark, d):
    return pair_row_count(uo_list(lines_l(spark, d), MineSpec(0, 0)))


@query(
    "tu_summary",
    _mine_sql(
        O.LINES_L,
        "SELECT count(*) AS n, round(avg(tu), 4) AS mean, round(stddev_samp(tu), 4) AS stddev, "
        "round(min(tu), 4) AS min, round(max(tu), 4) AS max FROM tt",
        min_util=0,
        min_uo_single=0,
    ),
)
def q_tu_summary(spark, d):
    s = tu_summary(transaction_totals(lines_l(spark, d), MineSpec(0, 0)))
    return _r(s, uo=["mean", "stddev", "min", "max"], places_uo=4)


@query("singles_actual", _mine_sql(O.LINES_L, O.SINGLES_OUT_SQL, **L_T))
def q_singles_actual(spark, d):
    return _singles_out(mine(lines_l(spark, d), MineSpec(**L_T)).singles)


@query("singles_mean", _mine_sql(O.LINES_L, O.SINGLES_OUT_SQL, price="mean", **L_T))
def q_singles_mean(spark, d):
    return _singles_out(mine(lines_l(spark, d), MineSpec(price="mean", **L_T)).singles)


@query(
    "topk_singles",
    _mine_sql(O.LINES_L, O.SINGLES_OUT_SQL + f" ORDER BY total_util DESC, item LIMIT {TOP_K}", **L_T),
)
def q_topk_singles(spark, d):
    return _singles_out(top_singles(mine(lines_l(spark, d), MineSpec(**L_T)).singles, TOP_K))


@query("pairs_actual_none", _mine_sql(O.LINES_L, O.PAIRS_OUT_SQL, prune="none", **L_T))
def q_pairs_actual_none(spark, d):
    return _pairs_out(mine(lines_l(spark, d), MineSpec(prune="none", **L_T)).pairs)


@query("pairs_actual_winners", _mine_sql(O.LINES_L, O.PAIRS_OUT_SQL, prune="winners", **L_T))
def q_pairs_actual_winners(spark, d):
    return _pairs_out(mine(lines_l(spark, d), MineSpec(prune="winners", **L_T)).pairs)


@query("pairs_mean_winners", _mine_sql(O.LINES_L, O.PAIRS_OUT_SQL, price="mean", prune="winners", **L_T))
def q_pairs_mean_winners(spark, d):
    return _pairs_out(mine(lines_l(spark, d), MineSpec(price="mean", prune="winners", **L_T)).pairs)


@query("pairs_exact", _mine_sql(O.LINES_L, O.PAIRS_OUT_SQL, prune="none", **L_T))
def q_pairs_exact(spark, d):
    return _pairs_out(mine(lines_l(spark, d), MineSpec(prune="exact", **L_T)).pairs)


@query("pairs_hash_price", _mine_sql(O.LINES_L, O.PAIRS_OUT_SQL, price="hash", prune="none", min_util=1.005, min_uo_single=0.25013, min_uo_pair=0.50013))
def q_pairs_hash_price(spark, d):
    spec = MineSpec(1.005, 0.25013, 0.50013, price="hash")
    return _pairs_out(mine(lines_l(spark, d), spec).pairs)


@query("pairs_first_seen", _mine_sql(O.LINES_L, O.PAIRS_OUT_SQL, price="first_seen", prune="winners", **L_T))
def q_pairs_first_seen(spark, d):
    return _pairs_out(mine(lines_l(spark, d), MineSpec(price="first_seen", prune="winners", **L_T)).pairs)


@query(
    "pairs_denylist_before",
    _mine_sql(O.LINES_B, O.PAIRS_OUT_SQL, exclude=BRAND_DENYLIST, exclude_when="before_tu", **B_T),
)
def q_pairs_denylist_before(spark, d):
    spec = MineSpec(exclude=BRAND_DENYLIST, exclude_when="before_tu", **B_T)
    return _pairs_out(mine(lines_b(spark, d), spec).pairs)


@query(
    "pairs_denylist_after",
    _mine_sql(O.LINES_B, O.PAIRS_OUT_SQL, exclude=BRAND_DENYLIST, exclude_when="after_tu", **B_T),
)
def q_pairs_denylist_after(spark, d):
    spec = MineSpec(exclude=BRAND_DENYLIST, exclude_when="after_tu", **B_T)
    return _pairs_out(mine(lines_b(spark, d), spec).pairs)


@query(
    "singles_denylist_before",
    _mine_sql(O.LINES_B, O.SINGLES_OUT_SQL, exclude=BRAND_DENYLIST, exclude_when="before_tu", **B_T),
)
def q_singles_denylist_before(spark, d):
    spec = MineSpec(exclude=BRAND_DENYLIST, exclude_when="before_tu", **B_T)
    return _singles_out(mine(lines_b(spark, d), spec).singles)


@query("pairs_duplicates_keep", _mine_sql(O.LINES_L, O.PAIRS_OUT_SQL, duplicates="keep", **L_T))
def q_pairs_duplicates_keep(spark, d):
    return _pairs_out(mine(lines_l(spark, d), MineSpec(duplicates="keep", **L_T)).pairs)


@query(
    "topk_pairs",
    _mine_sql(O.LINES_N, O.PAIRS_OUT_SQL + f" ORDER BY total_util DESC, item1, item2 LIMIT {TOP_K}", **N_T),
)
def q_topk_pairs(spark, d):
    return _pairs_out(top_pairs(mine(lines_n(spark, d), MineSpec(**N_T)).pairs, TOP_K))


_COMBINED_SQL = (
    "SELECT 1 AS size, item AS item1, CAST(NULL AS VARCHAR) AS item2, item AS itemset, "
    "round(total_util, 2) AS total_util, round(avg_uo, 6) AS avg_uo, support FROM singles "
    "UNION ALL SELECT 2, item1, item2, itemset, round(total_util, 2), round(avg_uo, 6), support FROM pairs"
)


def _combined_out(df):
    return _r(df, ["total_util"], ["avg_uo"])


@query("patterns_combined", _mine_sql(O.LINES_N, _COMBINED_SQL, prune="winners", **N_T))
def q_patterns_combined(spark, d):
    return _combined_out(mine(lines_n(spark, d), MineSpec(prune="winners", **N_T)).combined())


def _two_runs(spark, d):
    """Both runs on one set of entries: one scan and one shuffle of the lines."""
    a, b = mine_together(lines_l(spark, d), [MineSpec(price="mean", prune="winners", **L_T), MineSpec(prune="none", **L_T)])
    _HELD.extend([a, b])
    return a.pairs, b.pairs


def _two_runs_sql(tail: str) -> str:
    a = O.mine_ctes(O.LINES_L, price="mean", prune="winners", **L_T)
    b = O.mine_ctes(O.LINES_L, prune="none", **L_T)
    return (
        "WITH ra AS (" + a + "SELECT item1, item2 FROM pairs), rb AS (" + b + "SELECT item1, item2 FROM pairs) " + tail
    )


@query("patterns_common", _two_runs_sql("SELECT item1, item2 FROM ra INTERSECT SELECT item1, item2 FROM rb"))
def q_patterns_common(spark, d):
    a, b = _two_runs(spark, d)
    return common_patterns(a, b)


@query("patterns_any", _two_runs_sql("SELECT item1, item2 FROM ra UNION SELECT item1, item2 FROM rb"))
def q_patterns_any(spark, d):
    a, b = _two_runs(spark, d)
    return any_patterns(a, b)


_CMP_TAIL = (
    ", sa AS (SELECT DISTINCT item1, item2 FROM ra), sb AS (SELECT DISTINCT item1, item2 FROM rb), "
    "c AS (SELECT (SELECT count(*) FROM sa) AS n_left, (SELECT count(*) FROM sb) AS n_right, "
    "(SELECT count(*) FROM (SELECT * FROM sa INTERSECT SELECT * FROM sb)) AS n_common, "
    "(SELECT count(*) FROM (SELECT * FROM sa UNION SELECT * FROM sb)) AS n_any) "
)
_JACCARD_SQL = "round(CASE WHEN n_any > 0 THEN CAST(n_common AS DOUBLE) / n_any ELSE 0.0 END, 6) AS jaccard"


def _cmp_sql(select: str) -> str:
    return _two_runs_sql("")[:-1] + _CMP_TAIL + select


@query("run_compare", _cmp_sql("SELECT n_left, n_right, n_common, n_any, " + _JACCARD_SQL + " FROM c"))
def q_run_compare(spark, d):
    a, b = _two_runs(spark, d)
    return _r(compare(a, b), uo=["jaccard"])


@query("jaccard", _cmp_sql("SELECT " + _JACCARD_SQL + " FROM c"))
def q_jaccard(spark, d):
    a, b = _two_runs(spark, d)
    return _r(compare(a, b).select("jaccard"), uo=["jaccard"])


@query("pattern_counts", _mine_sql(O.LINES_L, "SELECT (SELECT count(*) FROM singles) AS n_singles, (SELECT count(*) FROM pairs) AS n_pairs", **L_T))
def q_pattern_counts(spark, d):
    r = mine(lines_l(spark, d), MineSpec(**L_T))
    return pattern_counts(r.singles, r.pairs)


@query("mine_event_baskets", _mine_sql(O.LINES_V, _COMBINED_SQL, prune="none", **V_T))
def q_mine_event_baskets(spark, d):
    return _combined_out(mine(lines_v(spark, d), MineSpec(**V_T)).combined())


@query(
    "mine_many",
    "WITH ra AS (" + O.mine_ctes(O.LINES_L, prune="winners", **L_T) + _COMBINED_SQL + "), "
    "rb AS (" + O.mine_ctes(O.LINES_V, prune="none", **V_T) + _COMBINED_SQL + ") "
    "SELECT *, 'lineitem' AS dataset FROM ra UNION ALL SELECT *, 'events' AS dataset FROM rb",
)
def q_mine_many(spark, d):
    runs = [
        ("lineitem", lines_l(spark, d), MineSpec(prune="winners", **L_T)),
        ("events", lines_v(spark, d), MineSpec(**V_T)),
    ]
    return _combined_out(mine_many(runs, _HELD))


def _many_sql(runs):
    raw = {"lineitem": O.LINES_L, "events": O.LINES_V}
    # Exact pruning gives the ungated result.
    parts = [(k, raw[table], {**kw, "prune": "winners" if kw.get("prune") == "winners" else "none"}) for k, (_, table, kw) in enumerate(runs)]
    ctes = ", ".join(f"r{k} AS ({O.mine_ctes(lines, **kw)}{_COMBINED_SQL})" for k, lines, kw in parts)
    return f"WITH {ctes} " + " UNION ALL ".join(f"SELECT *, '{name}' AS dataset FROM r{k}" for k, (name, _, _) in enumerate(runs))


# Thresholds, pruning, denylists and row prices differ; the runs still share one plan.
_MANY = (
    ("gated", "lineitem", dict(prune="winners", **L_T)),
    ("exact", "lineitem", dict(prune="exact", **L_T)),
    ("constant", "lineitem", dict(price="constant", constant_price=2.0, min_util=150.5, min_uo_single=0.25013, min_uo_pair=0.50013)),
    ("denied", "events", dict(exclude=("click",), **V_T)),
)


@query("mine_many_policies", _many_sql(_MANY))
def q_mine_many_policies(spark, d):
    lines = {"lineitem": lines_l, "events": lines_v}
    return _combined_out(mine_many([(name, lines[table](spark, d), MineSpec(**kw)) for name, table, kw in _MANY], _HELD))


@query(
    "remaining_occupancy",
    _mine_sql(
        O.LINES_L,
        "SELECT tid, item, round(uo, 6) AS uo, round(coalesce(sum(uo) OVER (PARTITION BY tid ORDER BY item "
        "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0), 6) AS ruo FROM uo",
        min_util=0,
        min_uo_single=0,
    ),
)
def q_remaining_occupancy(spark, d):
    r = remaining_occupancy(uo_list(lines_l(spark, d), MineSpec(0, 0)))
    return _r(r.select(_s("tid"), _s("item"), "uo", "ruo"), uo=["uo", "ruo"])


@query("patterns_only_left", _two_runs_sql("SELECT item1, item2 FROM ra EXCEPT SELECT item1, item2 FROM rb"))
def q_patterns_only_left(spark, d):
    a, b = _two_runs(spark, d)
    return only_left(a, b)


@query(
    "dataset_profile",
    _mine_sql(
        O.LINES_L,
        "SELECT count(*) AS n_transactions, CAST(sum(n_items) AS BIGINT) AS n_entries, round(avg(n_items), 6) AS mean_basket, "
        "round(avg(tu), 4) AS tu_mean, round(stddev_samp(tu), 4) AS tu_stddev, round(min(tu), 4) AS tu_min, "
        "round(max(tu), 4) AS tu_max, (SELECT count(DISTINCT item) FROM uo) AS n_items FROM tt",
        min_util=0,
        min_uo_single=0,
    ),
)
def q_dataset_profile(spark, d):
    p = profile(uo_list(lines_l(spark, d), MineSpec(0, 0)))
    p = _r(p, uo=["mean_basket"])
    return _r(p, uo=["tu_mean", "tu_stddev", "tu_min", "tu_max"], places_uo=4)


# ---------------------------------------------------------------- skewed inputs
# Both read the whole lineitem table and remap keys so that one key holds a
# large share of all rows: the plans' skew handling is then checked against
# the oracle on real data, not on a fixture.

HOT_T = dict(min_util=1500000.005, min_uo_single=0.20013, min_uo_pair=0.00140013)
HOT_SPLIT = 256
# Entries of a key that count as heavy in the skewed queries, low enough for the test tables.
HEAVY = 500

_HOT_BASKET_SQL = """
SELECT CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END AS VARCHAR) AS tid,
       CAST(l_partkey AS VARCHAR) AS item, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
       l_orderkey AS seq1, l_linenumber AS seq2
FROM lineitem
"""

_HOT_ITEM_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS tid,
       CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_partkey END AS VARCHAR) AS item,
       l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
       l_orderkey AS seq1, l_linenumber AS seq2
FROM lineitem
"""


def lines_hot_basket(spark, d) -> DataFrame:
    """L with every third order folded into transaction 0 (a third of all rows)."""
    li = _t(spark, d, "lineitem")
    tid = F.when(F.col("l_orderkey") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("l_orderkey"))
    return from_table(li, tid=tid, item="l_partkey", quantity="l_quantity",
                      unit_price=F.try_divide("l_extendedprice", "l_quantity"))


def lines_hot_item(spark, d) -> DataFrame:
    """L with the first line of every order re-labelled as item 0."""
    li = _t(spark, d, "lineitem")
    item = F.when(F.col("l_linenumber") == 1, F.lit(0).cast("long")).otherwise(F.col("l_partkey"))
    return from_table(li, tid="l_orderkey", item=item, quantity="l_quantity",
                      unit_price=F.try_divide("l_extendedprice", "l_quantity"))


@query("hot_basket_pairs", _mine_sql(_HOT_BASKET_SQL, O.PAIRS_OUT_SQL, prune="none", **HOT_T))
def q_hot_basket_pairs(spark, d):
    spec = MineSpec(split_items=HOT_SPLIT, **HOT_T)
    return _pairs_out(mine(lines_hot_basket(spark, d), spec).pairs)


@query("hot_basket_singles", _mine_sql(_HOT_BASKET_SQL, O.SINGLES_OUT_SQL, prune="none", **HOT_T))
def q_hot_basket_singles(spark, d):
    spec = MineSpec(split_items=HOT_SPLIT, **HOT_T)
    return _singles_out(mine(lines_hot_basket(spark, d), spec).singles)


@query("hot_item_pairs", _mine_sql(_HOT_ITEM_SQL, O.PAIRS_OUT_SQL, prune="none", **L_T))
def q_hot_item_pairs(spark, d):
    return _pairs_out(mine(lines_hot_item(spark, d), MineSpec(**L_T)).pairs)


@query(
    "pair_cooccurrence_kept",
    _mine_sql(O.LINES_L, "SELECT p.item1, p.item2, a.tid FROM pairs p JOIN uo a ON a.item = p.item1 "
              "JOIN uo b ON b.item = p.item2 AND b.tid = a.tid", prune="winners", **L_T),
)
def q_pair_cooccurrence_kept(spark, d):
    """A13 for the pairs of a gated run only."""
    r = mine(lines_l(spark, d), MineSpec(prune="winners", **L_T))
    return pair_cooccurrence(r.uo, pairs=r.pairs).select("item1", "item2", _s("tid"))


LONG_T = dict(min_util=90000.005, min_uo_single=0.03013, min_uo_pair=0.09013)

_LONG_SQL = """
SELECT CAST(l_orderkey // 9 AS VARCHAR) AS tid, CAST(l_partkey AS VARCHAR) AS item,
       l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
       l_orderkey AS seq1, l_linenumber AS seq2
FROM lineitem
"""


def lines_long(spark, d) -> DataFrame:
    """L with nine orders to a transaction: long baskets, so mostly pair work."""
    return from_table(_t(spark, d, "lineitem"), tid=F.expr("l_orderkey div 9"), item="l_partkey", quantity="l_quantity",
                      unit_price=F.try_divide("l_extendedprice", "l_quantity"))


@query("long_baskets_pairs", _mine_sql(_LONG_SQL, O.PAIRS_OUT_SQL, prune="none", **LONG_T))
def q_long_baskets_pairs(spark, d):
    return _pairs_out(mine(lines_long(spark, d), MineSpec(**LONG_T)).pairs)


@query("hot_item_pairs_mean", _mine_sql(_HOT_ITEM_SQL, O.PAIRS_OUT_SQL, prune="none", price="mean", **L_T))
def q_hot_item_pairs_mean(spark, d):
    """J1 without a broadcast: the hot item's entries meet their price in tasks of their own."""
    spec = MineSpec(price="mean", broadcast_max_rows=0, heavy_rows=HEAVY, **L_T)
    return _pairs_out(mine(lines_hot_item(spark, d), spec).pairs)


# Python-reader parity on lineitem (M5): mean price, denylist removed before
# TU, one occupancy threshold for both sizes, pairs gated by size-1 winners.
PARITY_DENYLIST = ("1", "2", "3", "5", "8", "13")
PARITY_T = dict(min_util=100000.005, min_uo_single=0.30013, min_uo_pair=0.30013)


@query(
    "pairs_single_threshold_parity",
    _mine_sql(O.LINES_L, O.PAIRS_OUT_SQL, price="mean", exclude=PARITY_DENYLIST, exclude_when="before_tu",
              prune="winners", **PARITY_T),
)
def q_pairs_single_threshold_parity(spark, d):
    spec = MineSpec(price="mean", exclude=PARITY_DENYLIST, exclude_when="before_tu", prune="winners", **PARITY_T)
    return _pairs_out(mine(lines_l(spark, d), spec).pairs)


@query(
    "tu_given_check",
    _mine_sql(
        O.LINES_G,
        "SELECT tid, round(tu, 2) AS tu, round(sum_iu, 2) AS sum_iu, round(tu - sum_iu, 2) AS gap FROM "
        "(SELECT tid, max(tu) AS tu, sum(iu) AS sum_iu FROM uo GROUP BY tid) "
        "WHERE abs(tu - sum_iu) > 1e-9 * abs(tu)",
        min_util=0,
        min_uo_single=0,
        tu="given",
    ),
)
def q_tu_given_check(spark, d):
    m = tu_mismatch(uo_list(lines_g(spark, d), MineSpec(0, 0, tu="given")))
    return _r(m.select(_s("tid"), "tu", "sum_iu", "gap"), ["tu", "sum_iu", "gap"])


@query("hot_basket_pairs_tu_aggregate", _mine_sql(_HOT_BASKET_SQL, O.PAIRS_OUT_SQL, prune="none", **HOT_T))
def q_hot_basket_pairs_tu_aggregate(spark, d):
    """The hot-basket query with TU from the tasks' partial totals, which the hot
    transaction's entries meet in tasks of their own, instead of the window."""
    spec = MineSpec(split_items=HOT_SPLIT, tu_by="aggregate", heavy_rows=HEAVY, **HOT_T)
    return _pairs_out(mine(lines_hot_basket(spark, d), spec).pairs)


@query("pairs_exact_keep", _mine_sql(O.LINES_L, O.PAIRS_OUT_SQL, duplicates="keep", prune="none", **L_T))
def q_pairs_exact_keep(spark, d):
    """Exact pruning with kept duplicates: equal to the ungated result."""
    return _pairs_out(mine(lines_l(spark, d), MineSpec(duplicates="keep", prune="exact", **L_T)).pairs)


# ------------------------------------------------- unclean and renamed input

@query(
    "retail_lines_mapped",
    "SELECT CAST(l_orderkey AS VARCHAR) AS tid, CAST(l_partkey AS VARCHAR) AS item, l_quantity AS quantity, "
    "l_extendedprice AS unit_price, CAST(o_custkey AS VARCHAR) AS customer_id "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL "
    "AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND o_custkey IS NOT NULL",
)
def q_retail_lines_mapped(spark, d):
    """The five retail fields from a table that names them otherwise."""
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    names = {"InvoiceNo": "l_orderkey", "StockCode": "l_partkey", "Quantity": "l_quantity",
             "UnitPrice": "l_extendedprice", "CustomerID": "o_custkey"}
    return parse_retail(rows, mapping=names)


def _unclean(spark, d) -> DataFrame:
    """lineitem with every seventh quantity NaN, every eleventh price infinite, and a TU
    that is NaN, infinite or null in three of five orders."""
    q = F.when(F.col("l_partkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    p = F.when(F.col("l_partkey") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))
    kind = F.col("l_orderkey") % 5
    tu = F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("inf"))).when(kind == 2, F.lit(None))
    rows = _t(spark, d, "lineitem").withColumns({"q": q, "p": p, "given": tu.otherwise(F.lit(1e6))})
    return from_table(rows, tid="l_orderkey", item="l_partkey", quantity="q", unit_price="p", tu="given")


_UNCLEAN_SQL = (
    "WITH e AS (SELECT l_orderkey AS tid, l_partkey AS item, sum(l_quantity * l_extendedprice) AS iu, "
    "count(*) AS n FROM lineitem WHERE l_partkey % 7 <> 0 AND l_partkey % 11 <> 0 AND l_quantity > 0 "
    "AND l_extendedprice > 0 GROUP BY 1, 2), "
    "t AS (SELECT tid, {tu} AS tu, count(*) AS n_items FROM e {where} GROUP BY tid) "
    "SELECT CAST(e.tid AS VARCHAR) AS tid, CAST(e.item AS VARCHAR) AS item, round(e.iu, 2) AS iu, "
    "round(t.tu, 2) AS tu, round(e.iu / t.tu, 6) AS uo, t.n_items FROM e JOIN t USING (tid)"
)


@query("unclean_lines_computed_tu", _UNCLEAN_SQL.format(tu="sum(iu)", where=""))
def q_unclean_lines_computed_tu(spark, d):
    """a bad TU column does not matter where TU is computed."""
    return _uo_out(uo_list(_unclean(spark, d), MineSpec(0, 0)))


@query("unclean_lines_given_tu", _UNCLEAN_SQL.format(tu="CAST(1e6 AS DOUBLE)", where="WHERE tid % 5 > 2"))
def q_unclean_lines_given_tu(spark, d):
    """lines without a finite given TU go."""
    return _uo_out(uo_list(_unclean(spark, d), MineSpec(0, 0, tu="given")))


# ------------------------------------------------- heavy baskets, bounds, bitmaps, numbering

@query(
    "hot_basket_remaining_occupancy",
    _mine_sql(
        _HOT_BASKET_SQL,
        "SELECT tid, item, round(uo, 9) AS uo, round(coalesce(sum(uo) OVER (PARTITION BY tid ORDER BY item "
        "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0), 6) AS ruo FROM uo",
        min_util=0,
        min_uo_single=0,
    ),
)
def q_hot_basket_remaining_occupancy(spark, d):
    """W1 with a third of all rows in one basket, cut into ranges of items."""
    uo = uo_list(lines_hot_basket(spark, d), MineSpec(0, 0, tu_by="aggregate", heavy_rows=HEAVY))
    r = remaining_occupancy(uo, heavy_rows=HEAVY)
    return _r(_r(r.select(_s("tid"), _s("item"), "uo", "ruo"), uo=["uo"], places_uo=9), uo=["ruo"])


@query("pairs_bounds", _mine_sql(O.LINES_L, O.PAIRS_OUT_SQL, prune="none", **L_T))
def q_pairs_bounds(spark, d):
    """Pairs tested by their buckets' bounds before they are measured: the ungated result."""
    return _pairs_out(mine(lines_l(spark, d), MineSpec(prune="bounds", **L_T)).pairs)


@query("pairs_bounds_keep", _mine_sql(O.LINES_L, O.PAIRS_OUT_SQL, duplicates="keep", prune="none", **L_T))
def q_pairs_bounds_keep(spark, d):
    return _pairs_out(mine(lines_l(spark, d), MineSpec(duplicates="keep", prune="bounds", **L_T)).pairs)


@query(
    "pair_bounds_saving",
    _mine_sql(
        O.LINES_L,
        "SELECT (SELECT count(*) FROM pairs_all) AS n_occurring, (SELECT count(*) FROM pairs) AS n_kept, "
        "true AS fewer_measured, true AS all_kept_measured",
        prune="none",
        **L_T,
    ),
)
def q_pair_bounds_saving(spark, d):
    """How many pairs co-occur, are kept, and whether the bounds spared some of the others."""
    r = mine(lines_l(spark, d), MineSpec(prune="bounds", **L_T))
    rows, kept = pair_rows(r.uo), r.pairs.select("item1", "item2")
    # Occurring and kept pairs meet in one grouping on the items' own keys: of a row a pair, and no text.
    own = [F.col(c).cast(rows.schema["item1"].dataType) for c in ("item1", "item2")]
    keys = kept.select(F.least(*own).alias("item1"), F.greatest(*own).alias("item2"), F.lit(False).alias("o"), F.lit(True).alias("k"))
    both = rows.select("item1", "item2", F.lit(True).alias("o"), F.lit(False).alias("k")).unionByName(keys)
    both = both.groupBy("item1", "item2").agg(F.max("o").alias("o"), F.max("k").alias("k"))
    both = orient(in_buckets(both, r.pair_buckets, r.buckets, mark="m"))
    return both.agg(
        F.count_if("o").alias("n_occurring"),
        F.count_if("k").alias("n_kept"),
        (F.count_if(F.col("o") & F.col("m")) < F.count_if("o")).alias("fewer_measured"),
        (F.count_if(F.col("k") & ~(F.col("o") & F.col("m"))) == 0).alias("all_kept_measured"),
    )


@query(
    "pair_tid_bitmaps",
    _mine_sql(O.LINES_L, "SELECT item1, item2, support FROM pairs", prune="winners", **L_T),
)
def q_pair_tid_bitmaps(spark, d):
    """A13 as bitmaps: the kept pairs' supports counted from their bits."""
    r = mine(lines_l(spark, d), MineSpec(prune="winners", **L_T))
    bits = pair_tid_bitmaps(r.candidates, r.pairs)  # these hold every entry of a kept pair
    return bits.groupBy("item1", "item2").agg(F.sum(F.bitmap_count("tids")).alias("support"))


@query(
    "stable_line_ids",
    "SELECT l_orderkey, l_linenumber, row_number() OVER () - 1 AS tid FROM lineitem",
)
def q_stable_line_ids(spark, d):
    """Rows numbered by file and place, whatever the splits."""
    rows = with_stable_ids(_t(spark, d, "lineitem"))
    return rows.select("l_orderkey", "l_linenumber", F.col("tid").cast("long").alias("tid"))


@query(
    "sample_member_day",
    "WITH l AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, trim(o_orderpriority) AS item FROM orders), "
    f"f AS (SELECT DISTINCT o_custkey, day FROM l ORDER BY o_custkey, day LIMIT {SAMPLE_N}) "
    "SELECT CAST(o_custkey AS VARCHAR) || '_' || CAST(day AS VARCHAR) AS tid, item, CAST(count(*) AS DOUBLE) AS quantity "
    "FROM l JOIN f USING (o_custkey, day) GROUP BY 1, 2",
)
def q_sample_member_day(spark, d):
    """S6 on member-day baskets: the first transactions by member number, then date."""
    lines = _member_day_lines(spark, d, order_key=True, date_format="yyyy-MM-dd")
    first = sample_first(lines, SAMPLE_N, by="order_key")
    return first.groupBy("tid", "item").agg(F.sum("quantity").alias("quantity"))


@query(
    "basket_items",
    "WITH " + O.lines_ctes(O.LINES_L)
    + ", d AS (SELECT DISTINCT tid, item FROM lines) "
    "SELECT tid, CAST(row_number() OVER (PARTITION BY tid ORDER BY item) - 1 AS INTEGER) AS position, item FROM d",
)
def q_basket_items(spark, d):
    """A11 in long form."""
    return basket_items(clean_lines(lines_l(spark, d))).select(_s("tid"), "position", "item")


@query(
    "rejected_lines",
    "WITH r AS (SELECT CASE WHEN l_partkey % 13 = 0 THEN 'missing StockCode' WHEN l_partkey % 7 = 0 THEN 'bad Quantity' "
    "WHEN l_partkey % 11 = 0 THEN 'not positive UnitPrice' WHEN l_orderkey % 5 = 0 THEN 'missing CustomerID' END AS reason "
    "FROM lineitem) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason",
)
def q_rejected_lines(spark, d):
    """lines that loading drops, counted by reason."""
    part, text = F.col("l_partkey"), lambda c: F.col(c).cast("string")
    rows = _t(spark, d, "lineitem").select(
        text("l_orderkey").alias("InvoiceNo"),
        F.when(part % 13 != 0, text("l_partkey")).otherwise(F.lit(" ")).alias("StockCode"),
        F.when(part % 7 != 0, text("l_quantity")).otherwise(F.lit("many")).alias("Quantity"),
        F.when(part % 11 != 0, text("l_extendedprice")).otherwise(F.lit("-1")).alias("UnitPrice"),
        F.when(F.col("l_orderkey") % 5 != 0, F.lit("c")).alias("CustomerID"),
    )
    return rejected_lines(rows).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "transaction_sketches",
    "SELECT l_returnflag AS part, true AS close FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'all', true",
)
def q_transaction_sketches(spark, d):
    """A6 by sketches: distinct transactions by part and merged, within 5 % of the exact counts."""
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("tid"), F.col("l_returnflag").alias("part"))
    parts = transaction_sketch(li, ["part"])
    near = merged_transactions(parts, ["part"]).unionByName(merged_transactions(parts).withColumn("part", F.lit("all")))
    exact = li.groupBy("part").agg(F.count_distinct("tid").alias("n"))
    exact = exact.unionByName(li.agg(F.count_distinct("tid").alias("n")).withColumn("part", F.lit("all")))
    off = F.abs(F.col("n_transactions") - F.col("n")) <= 0.05 * F.col("n")
    return near.join(exact, "part").select("part", off.alias("close"))
