"""SimHash near-dedup against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basketry.llm.simhash import anchors, drop_near_copies, fingerprint, links, simhash_groups


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps, limit):
    """Least index reachable over pairs at most ``limit`` bits apart."""
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= limit) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_fingerprint():
    for text in [None, "", " \n", "One", "a b", "The cat sat\ton THE mat x É é", "x " * 500]:
        assert fingerprint(text) == plain(text)


@pytest.mark.parametrize("limit", [0, 1, 3, 5])
def test_anchors_meet(limit):
    rng = np.random.default_rng(limit)
    x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for b in rng.choice(64, rng.integers(0, limit + 1), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    home, copy = [set() for _ in x], [set() for _ in x]
    for part, a, own, at_home in anchors(x, limit):
        for k, i in zip(a.tolist(), own.tolist()):
            if at_home:
                home[i].add((part, k))
    for part, a, own, _ in anchors(y, limit):
        for k, i in zip(a.tolist(), own.tolist()):
            copy[i].add((part, k))
    assert all(home[i] & copy[i] for i in range(len(x)))


@pytest.mark.parametrize("cell_rows", [20_000, 3])
def test_links_join_all_classes(spark, cell_rows):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {0, *map(int, base)}
    for x in map(int, base[:5]):
        for _ in range(25):
            for b in rng.choice(64, rng.integers(1, 3), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in links(df, 3, cell_rows).collect()]
    label = {x: x for x in fps}
    for u, v in got * len(fps):
        m = min(label[u], label[v])
        if label[u] == label[v] == m:
            continue
        label[u] = label[v] = m
    assert all(label[u] == label[v] for u, v in got)
    want = [fps[i] for i in classes(fps, 3)]
    by = {}
    for x, w in zip(fps, want):
        by.setdefault(w, set()).add(label[x])
    assert all(len(s) == 1 for s in by.values()) and len({min(s) for s in by.values()}) == len(by)


ROWS = [(1, None, "a"), (2, "", "a"), (3, "alpha beta gamma delta", None), (4, "ALPHA  beta\ngamma delta", "b"), (4, "ALPHA  beta\ngamma delta", "b"), (None, "alpha beta gamma delta", "b"), (7, "solo", "b"), (8, "word " * 30_000, "b"), (9, None, None)]


def test_edge_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").withColumns({"fp": F.lit(1), "key": F.lit("k"), "component_id": F.lit(2)})
    got = sorted(((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash_groups(df).collect()))
    f = f"{plain(ROWS[2][1]):016x}"
    assert got == sorted([(1, "0" * 16, 1), (2, "0" * 16, 1), (9, "0" * 16, 1), (3, f, 3), (4, f, 3), (4, f, 3), (0, f, 3), (7, f"{plain('solo'):016x}", 7), (8, f"{plain(ROWS[7][1]):016x}", 8)])
    kept = drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 7, 8]
    assert simhash_groups(df.limit(0)).count() == 0 == drop_near_copies(df.limit(0)).count()


def test_components_without_own_id_stay(spark):
    far = ["one two three four five", "red green blue black white", "north east south west up", "spring summer autumn winter year"]
    assert all((plain(a) ^ plain(b)).bit_count() > 3 for i, a in enumerate(far) for b in far[:i])
    rows = [(None, far[0]), (None, far[1]), (None, far[1].upper()), (5, far[2]), (5, far[3]), (6, far[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted((r.doc_id or 0, r.text.lower()) for r in drop_near_copies(df).collect())
    assert kept == sorted([(0, far[0]), (0, far[1]), (5, far[2]), (5, far[3])])


def test_query_by_brute_force(spark):
    from basketry.llm.queries import op7_simhash
    from tests.conftest import SF001

    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    fps = [plain(t) for _, t in docs]
    want = sorted((d, f"{fp:016x}", docs[c][0]) for (d, _), fp, c in zip(docs, fps, classes(fps, 3)))
    assert sorted(map(tuple, op7_simhash(spark, SF001).collect())) == want
