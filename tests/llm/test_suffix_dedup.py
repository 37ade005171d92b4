"""Repeated-substring removal against a dictionary of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import suffix_dedup as S
from basketry.llm.queries import op4_suffix_dedup
from tests.conftest import SF001


def brute(texts, n=S.LENGTH):
    """``(bytes, removed, spans, hash of the rest)`` per text."""
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        rest = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def test_cover():
    assert {(a - b) % S.COVER for a in S.RESIDUES for b in S.RESIDUES} == set(range(S.COVER))


def test_repeated_windows():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 6000).astype(np.uint8)
    for a, b, n in ((100, 3000, 200), (700, 3501, 260), (1200, 4003, 199), (5000, 5300, 290)):
        text[b : b + n] = text[a : a + n]
    windows = np.arange(len(text) - S.LENGTH + 1)
    seen = Counter(text[i : i + S.LENGTH].tobytes() for i in windows)
    want = [seen[text[i : i + S.LENGTH].tobytes()] > 1 for i in windows]
    assert S.repeated_windows(text, windows).tolist() == want and any(want)


def check(df, **kw):
    rows = [(r[0], (r[1] or "").encode()) for r in df.select("doc_id", "text").collect()]
    want = Counter((d, *b) for (d, _), b in zip(rows, brute([t for _, t in rows])))
    assert Counter(tuple(r) for r in S.digest(S.remove_repeats(df, **kw)).collect()) == want
    return want


def test_edge_rows(spark):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(1, 8)))) for _ in range(n))
    p, q = prose(80), prose(60)
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (5, "z" * 201), (6, "ab" * 400 + p), (7, p[:250]), (8, prose(30) + p[20:230] + prose(30)), (9, prose(9) + q + "é" + prose(9) + q), (9, "same " * 60), (9, "same " * 60), (None, q[:205] + "!"), (11, p[:199]), (12, prose(3000) + p)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"block": F.lit("b"), "body": F.lit(1)})
    want = check(df)
    assert sum(w[2] > 0 for w in want) >= 6
    stretch = S.STRETCH
    assert S.remove_repeats(df.limit(0)).count() == 0
    texts = [(r[1] or "").encode() for r in rows]
    buckets = lambda: {int(x) for data, begin, *_ in S.stretches(texts) for least, first, *_ in [S.window_runs(data, begin)] for x in least[first]}
    whole = buckets()
    try:  # long documents in stretches
        S.STRETCH = 1000
        assert buckets() == whole <= set(S.met(texts)[0].tolist())
    finally:
        S.STRETCH = stretch


def test_documents_by_brute_force(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    want = check(df, block_bytes=20_000)
    assert Counter(map(tuple, op4_suffix_dedup(spark, SF001).collect())) == want


def test_many_copies_of_a_row_lie_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "REPEATS", 20)
    rng = np.random.default_rng(6)
    prose = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    p = prose(50)
    rows = [(1, p)] * 300 + [(None, "short")] * 300 + [(k, prose(60) + (p[:210] if k % 7 == 0 else "")) for k in range(2, 60)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), block_bytes=3000)


def _with_passages(n, rng):
    """Documents around two passages that a third of them each hold, with few and many different edges."""
    prose = lambda k: " ".join("".join(map(chr, rng.integers(97, 100, 5))) for _ in range(k))
    p, q = prose(70), prose(50)
    edge = [prose(1) for _ in range(6)]
    rows = []
    for k in range(n):
        text = prose(40)
        if k % 3 == 0:
            text += edge[k % 6] + p + edge[k % 5] + prose(30)
        elif k % 3 == 1:
            text = prose(3) + q[: 220 + k % 40] + prose(20) + (q if k % 9 == 1 else "")
        rows.append((k if k % 7 else None, text))
    return rows + [(n, p)] * 5 + [(n + 1, "same " * 90), (n + 2, None)]


@pytest.mark.parametrize("hot", [1, 20, 100])
def test_split_buckets(spark, hot):
    df = spark.createDataFrame(_with_passages(180, np.random.default_rng(7)), "doc_id bigint, text string")
    want = check(df, block_bytes=4000, hot=hot)
    assert sum(w[2] > 0 for w in want) >= 100


@pytest.mark.parametrize("n, fan", [(1, 8), (7, 8), (8, 8), (9, 8), (60, 8), (100, 5), (700, 3), (1500, 1024)])
def test_hops(n, fan):
    """Every pair meets, and an exchange has at most ``fan`` rows a sender, relays included."""
    base, widths = S.hops(n, fan)
    assert base <= fan and widths[-1] == 1 and base ** len(widths) >= n
    source, target = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    sender, part = source, source
    for width in widths:
        rows = np.unique(np.stack([sender, target // width]), axis=1).shape[1]
        assert rows <= base * len(np.unique(sender)) and len(np.unique(sender)) <= base ** len(widths)
        part = part // base
        sender = np.unique(np.stack([target // width, part]), axis=1, return_inverse=True)[1].ravel()
    assert (part == 0).all()


@pytest.mark.parametrize("hot", [5, 1000])
def test_exchanges_in_hops(spark, hot):
    df = spark.createDataFrame(_with_passages(120, np.random.default_rng(9)), "doc_id bigint, text string")
    check(df, block_bytes=3000, hot=hot, fan=4)


def test_split_buckets_of_documents(spark):
    check(spark.read.parquet(f"{SF001}/documents.parquet"), block_bytes=20_000, hot=2)


def test_a_passage_in_a_third_of_documents_is_sorted_in_several_tasks():
    """No name of a split bucket stands for more than the copies of one window."""
    rng = np.random.default_rng(8)
    texts = [t.encode() for _, t in _with_passages(600, rng) if t]
    value, times = S.met(texts)
    hot = value[times > 100]
    names, met = S.window_names(texts, hot)
    data, begin, _, _ = next(S.stretches(texts))
    least, first, last, _, _ = S.window_runs(data, begin)
    busy = S._among(least[first], hot)
    window, _, title = S.windows_of(data, first[busy], last[busy])
    group, sample = S._alike(data, window, title)
    assert len(hot) and len(sample) == len({data[a : a + S.LENGTH].tobytes() for a in window.tolist()}) == len(names)
    assert met.sum() == len(window) and np.bincount((names[met > 1] % np.uint64(16)).astype(int), minlength=16).min() > 0
