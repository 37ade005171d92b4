"""Periodic runs: brute force over words, edge rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.llm import runs
from basketry.llm.queries import REGISTRY
from tests.conftest import SF001


def brute(word, least):
    """Every maximal stretch of every period, the smallest period of each kept."""
    found, n = {}, len(word)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if word[i] != word[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and word[j] == word[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    # A period q stretch counts only if q is its smallest period, which is the first one found.
    return sorted((s, n_, q) for (s, n_), q in found.items() if not any(
        p < q and all(word[k] == word[k + p] for k in range(s, s + n_ - p)) for p in range(1, q)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(2, 13), st.integers(1, 4))
def test_runs_by_brute_force(word, least, times):
    word = word * times
    got = runs.word_runs([bytes([65 + w]) for w in word], least)
    assert sorted(map(tuple, got.tolist())) == brute(word, least)
    assert got.tolist() == sorted(got.tolist(), key=lambda r: (r[0], r[2]))


def test_long_stretches():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 40, 300)
    word = [b"%d" % w for w in np.concatenate([base, np.tile(base[:97], 20), [99], np.zeros(500, int), base])]
    assert sorted(map(tuple, runs.word_runs(word).tolist())) == brute(word, 12)
    assert runs.word_runs([b"a"] * 30_000).tolist() == [[0, 30_000, 1]]
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    assert sorted(map(tuple, runs.word_runs([c.encode() for c in fib[-1]], 2).tolist())) == brute(fib[-1], 2)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words, 12)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] and best[1] * 1000 // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_by_brute_force(spark):
    fn, _ = REGISTRY["op13_periodic_runs"]
    got = fn(spark, SF001)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect() if len(r.text or "") < 6000]
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(short) > 100 and sum(rows[r.doc_id][1] > 0 for r in short) > 10
    for r in short:
        assert rows[r.doc_id] == expected(r.doc_id, r.text)


def test_edge_rows(spark):
    rows = [(1, None), (None, "a b " * 20), (None, None), (3, " \n\t "), (4, "x\x0by\x1cz " * 9), (4, "x\x0by\x1cz " * 9), (5, "é e " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"runs": F.lit("s"), "start": F.lit(1), "collapsed": F.lit(0)})
    got = runs.periodic_runs(df)
    kept = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in got.collect()}
    assert kept == {(1, ""): [], (None, "a b"): [(0, 40, 2)], (None, ""): [], (3, ""): [], (4, "x y\x1cz"): [(0, 18, 2)], (5, "é e"): [(0, 30_000, 1)]}
    assert got.count() == len(rows) and runs.digest(runs.periodic_runs(df.limit(0))).count() == 0
    empty = [r for r in runs.digest(got).collect() if r.n_runs == 0]
    assert {tuple(r)[2:] for r in empty} == {(None,) * 4 + (hashlib.sha256(b"").hexdigest(),) * 2}


@pytest.mark.parametrize("rounds", [1, 8])
def test_cut_keeps_all_runs(rounds, monkeypatch):
    monkeypatch.setattr(runs, "CUT_ROUNDS", rounds)
    rng = np.random.default_rng(rounds)
    word = [b"%d" % w for w in np.concatenate([rng.integers(0, 900, 500), np.tile(rng.integers(0, 900, 31), 3), rng.integers(0, 900, 500)])]
    assert sorted(map(tuple, runs.word_runs(word).tolist())) == brute(word, 12) != []
