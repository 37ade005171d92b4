"""Oracle SQL (DuckDB dialect) for the driver queries.

Each oracle restates a query's semantics in plain SQL over the same
tables, independently of the Spark operators, so the driver can compare
results.  ``mine_ctes`` writes the whole mining chain as CTEs; the
policies mirror ``MineSpec``.
"""

from __future__ import annotations

# SQL text of the basket-line views used by the driver queries.
LINES_L = """
SELECT CAST(l_orderkey AS VARCHAR) AS tid, CAST(l_partkey AS VARCHAR) AS item,
       l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
       l_orderkey AS seq1, l_linenumber AS seq2
FROM lineitem
"""

LINES_B = """
SELECT CAST(l_orderkey AS VARCHAR) AS tid, p_brand AS item,
       l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
       l_orderkey AS seq1, l_linenumber AS seq2
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

LINES_N = """
SELECT CAST(l_orderkey AS VARCHAR) AS tid, p_name AS item,
       l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
       l_orderkey AS seq1, l_linenumber AS seq2
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

LINES_V = """
SELECT CAST(user_id AS VARCHAR) AS tid, event_type AS item,
       CAST(1.0 AS DOUBLE) AS quantity, value AS unit_price,
       event_id AS seq1, 0 AS seq2
FROM events
"""

LINES_G = """
SELECT CAST(o_orderkey AS VARCHAR) AS tid, CAST(l_partkey AS VARCHAR) AS item,
       l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
       o_totalprice AS tu, l_orderkey AS seq1, l_linenumber AS seq2
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
"""

CLEAN = """
SELECT * FROM raw
WHERE tid IS NOT NULL AND item IS NOT NULL AND quantity IS NOT NULL
  AND unit_price IS NOT NULL AND quantity > 0 AND unit_price > 0
  AND isfinite(quantity) AND isfinite(unit_price)
  AND length(item) > 0 {extra}
"""

HASH_PRICE_SQL = "(1.0 + 9.0 * (CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT) / 4294967296.0))"


def lines_ctes(raw_sql: str, given_tu: bool = False) -> str:
    extra = "AND tu IS NOT NULL" if given_tu else ""
    return f"raw AS ({raw_sql}),\nlines AS ({CLEAN.format(extra=extra)})"


def _in_list(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def mine_ctes(
    raw_sql: str,
    min_util: float,
    min_uo_single: float,
    min_uo_pair: float | None = None,
    price: str = "actual",
    constant_price: float = 1.0,
    tu: str = "computed",
    exclude=(),
    exclude_when: str = "after_tu",
    duplicates: str = "sum",
    prune: str = "none",
    min_tu: float | None = None,
) -> str:
    """CTEs ``lines, util, entries, tt, uo, singles_all, singles, cand,
    pairs_all, pairs``: the mining chain in SQL."""
    pair_uo = min_uo_single if min_uo_pair is None else min_uo_pair
    given = tu == "given"
    parts = [lines_ctes(raw_sql, given)]
    src = "lines"
    if exclude and exclude_when == "before_tu":
        parts.append(f"kept AS (SELECT * FROM lines WHERE item NOT IN ({_in_list(exclude)}))")
        src = "kept"
    if price == "actual":
        u = "quantity * unit_price"
        parts.append(f"util AS (SELECT *, {u} AS util FROM {src})")
    elif price == "constant":
        parts.append(f"util AS (SELECT *, quantity * {float(constant_price)} AS util FROM {src})")
    elif price == "hash":
        parts.append(f"util AS (SELECT *, quantity * {HASH_PRICE_SQL.format(x='item')} AS util FROM {src})")
    elif price == "mean":
        parts.append("cat AS (SELECT item, avg(unit_price) AS unit_profit FROM lines GROUP BY item)")
        parts.append(f"util AS (SELECT l.*, l.quantity * c.unit_profit AS util FROM {src} l JOIN cat c USING (item))")
    elif price == "first_seen":
        parts.append(
            "cat AS (SELECT item, greatest(arg_min(unit_price, {'a': seq1, 'b': seq2}), 0.01) AS unit_profit "
            "FROM lines GROUP BY item)"
        )
        parts.append(f"util AS (SELECT l.*, l.quantity * c.unit_profit AS util FROM {src} l JOIN cat c USING (item))")
    else:
        raise ValueError(price)
    tu_col = ", max(tu) AS tu_given" if given else ""
    if duplicates == "sum":
        parts.append(f"entries AS (SELECT tid, item, sum(util) AS iu{tu_col} FROM util GROUP BY tid, item)")
    else:
        tu_sel = ", tu AS tu_given" if given else ""
        parts.append(f"entries AS (SELECT tid, item, util AS iu{tu_sel} FROM util)")
    tu_expr = "max(tu_given)" if given else "sum(iu)"
    floor = f" AND {tu_expr} >= {float(min_tu)}" if min_tu is not None else ""
    parts.append(
        f"tt AS (SELECT tid, {tu_expr} AS tu, count(*) AS n_items FROM entries GROUP BY tid HAVING {tu_expr} > 0{floor})"
    )
    after = f" WHERE e.item NOT IN ({_in_list(exclude)})" if exclude and exclude_when == "after_tu" else ""
    parts.append(
        "uo AS (SELECT e.tid, e.item, e.iu, t.tu, e.iu / t.tu AS uo, t.n_items "
        f"FROM entries e JOIN tt t ON e.tid = t.tid{after})"
    )
    parts.append(
        "singles_all AS (SELECT item, sum(iu) AS total_util, sum(uo) / count(*) AS avg_uo, "
        "count(*) AS support FROM uo GROUP BY item)"
    )
    parts.append(
        f"singles AS (SELECT * FROM singles_all WHERE total_util >= {float(min_util)} "
        f"AND avg_uo >= {float(min_uo_single)})"
    )
    if prune == "winners":
        parts.append("cand AS (SELECT * FROM uo WHERE item IN (SELECT item FROM singles))")
    else:  # "none"; "exact" has the same result by construction
        parts.append("cand AS (SELECT * FROM uo)")
    parts.append(
        "pairs_all AS (SELECT a.item AS item1, b.item AS item2, sum(a.iu + b.iu) AS total_util, "
        "sum((a.iu + b.iu) / a.tu) / count(*) AS avg_uo, count(*) AS support "
        "FROM cand a JOIN cand b ON a.tid = b.tid AND a.item < b.item GROUP BY a.item, b.item)"
    )
    parts.append(
        "pairs AS (SELECT *, item1 || ',' || item2 AS itemset FROM pairs_all "
        f"WHERE total_util >= {float(min_util)} AND avg_uo >= {float(pair_uo)})"
    )
    return "WITH " + ",\n".join(parts) + "\n"


# Rounded output columns shared by Spark and SQL (comparison hygiene).
SINGLES_OUT_SQL = "SELECT item, round(total_util, 2) AS total_util, round(avg_uo, 6) AS avg_uo, support FROM singles"
PAIRS_OUT_SQL = (
    "SELECT item1, item2, round(total_util, 2) AS total_util, round(avg_uo, 6) AS avg_uo, support, itemset FROM pairs"
)
