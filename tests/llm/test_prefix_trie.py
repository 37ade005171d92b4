"""Prefix trie: SQL, brute force, fingerprints, edge rows."""

import hashlib
import re
import zlib

import duckdb
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.llm import prefix_trie as op
from basketry.llm.queries import REGISTRY
from tests.conftest import SF01

NUMBER = st.integers(0, op.PRIME - 1)
ELEMENT = st.tuples(st.integers(0, 50), NUMBER)
KIND = "conv_id bigint, turn bigint, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The trie by dictionaries of turn tuples."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in turns.items()}
    members, ends = {}, {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(len(k) == len(n) + 1 and k[: len(n)] == n for k in members)
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        out.append((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs),
                    sum(len(n) == len(node) + 1 for n in below), sum(map(leaf, below)), saved,
                    hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == NAMES
    return sorted(map(tuple, df.collect()), key=str)


@given(ELEMENT, ELEMENT, ELEMENT, NUMBER)
def test_products(a, b, c, turn):
    assert op.product(op.product(a, b), c) == op.product(a, op.product(b, c))
    assert op.product((0, 0), a) == a == op.product(a, (0, 0))
    assert op.without(a, op.product(a, b)) == b
    assert op.parent(op.product(a, (1, turn))[1], turn) == a[1]


def test_query_against_sql_and_brute_force(spark):
    fn, sql = REGISTRY["op12_prefix_trie"]
    got = rows_of(fn(spark, SF01))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF01}/conversations.parquet'")
    want = con.sql(sql)
    assert want.columns == NAMES and got == sorted(want.fetchall(), key=str)
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{SF01}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def small_rows():
    rows = []
    for c in range(70):
        if c % 20 == 0 and c > 20:
            continue  # conversations without a base
        for k in range((c * 7) % 6):
            rows.append((c, k if k else None, None if k == 1 else "ua"[k % 2], None if c % 9 == 0 else " ".join(["w"] * (1 + k + (c % 3 == 0)))))
    rows += [(None, 0, "u", "lost"), (33, 5, "u", ""), (80, 0, "u", "a b"), (80, 0, "u", "a b"), (80, 0, "u", "a b"), (81, 1, "a", "x " * 30_000), (-7, 0, "u", "n")]
    return rows


def test_edge_rows_and_split_conversations(spark):
    rows = [r for r in small_rows() if r[0] is None or r[0] >= 0]
    rows += [(100, k, "u", f"t {k % 3}") for k in range(300)] + [(120, k, "u", f"t {k % 3}") for k in range(300)]
    df = spark.createDataFrame(rows, KIND).withColumns({"words": F.lit("s"), "h": F.lit(1), "fp": F.lit(0), "tie": F.lit(0)})
    want = brute(rows)
    assert rows_of(op.prefix_trie(df)) == want  # the long ones lie in several sorted partitions
    assert rows_of(op.prefix_trie(df.orderBy(F.desc("turn")).repartition(3))) == want
    assert op.prefix_trie(df.limit(0)).count() == 0
    only = rows_of(op.prefix_trie(df.where("conv_id is null or conv_id = 80")))
    assert only == brute([r for r in rows if r[0] == 80])


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(op, "END_BITS", 4)
    rows = [(c, k, "u", "same") for c in range(200) for k in range(3)]
    assert rows_of(op.prefix_trie(spark.createDataFrame(rows, KIND))) == brute(rows)


def test_equal_hashes_of_unequal_turns_are_found(spark, monkeypatch):
    rows, real, seeds = small_rows()[:120], op.turn_hash, []

    def weak(seed, role, text):
        seeds.append(seed)
        h = real(seed, role, text)
        return F.struct((h["high"] % 3 if seed == 0 else h["high"]).alias("high"), (h["low"] % 1 if seed == 0 else h["low"]).alias("low"))

    monkeypatch.setattr(op, "turn_hash", weak)
    assert rows_of(op.prefix_trie(spark.createDataFrame(rows, KIND))) == brute(rows)
    assert seeds == [0, 1]
