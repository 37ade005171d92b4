"""Embedding near-dedup against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import hnsw as H
from basketry.llm.hnsw import QUERY_ROWS, Graph, units, vector_links
from tests.conftest import SF001


def brute(ids, vectors, cosine=0.9):
    ok, x = units(vectors)
    at = np.flatnonzero(ok)
    near = x @ x.T >= cosine if len(x) else np.zeros((0, 0), bool)
    label = list(ids)
    links = [0] * len(ids)
    for a, i in enumerate(at):
        links[i] = int(near[a].sum()) - 1
    while True:
        new = list(label)
        for a, i in enumerate(at):
            new[i] = min(label[at[b]] for b in np.flatnonzero(near[a]))
        if new == label:
            return sorted((v, n, c, v == c) for v, n, c in zip(ids, links, label))
        label = new


def test_graph_finds_neighbours():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32))
    x[1500:] = x[:1500] + 0.35 * rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    g.audit(0.9)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.9))}
    got = {(a, b) for i, j in g.near(x, 0.9) for a, b in zip(i.tolist(), j.tolist())}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) < 5


def test_upper_layers_are_walked_in_blocks(monkeypatch):
    x = np.random.default_rng(2).normal(size=(3 * QUERY_ROWS, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g, walked, walk = Graph(x), [], Graph._walk
    monkeypatch.setattr(Graph, "_walk", lambda self, k, q, *a: (walked.append((k, len(q))), walk(self, k, q, *a))[1])
    own = {int(i) for a, b in g.near(x, 0.9999) for i in a[a == b]}
    assert len(own) >= 0.99 * len(x) and max(n for k, n in walked if k) <= QUERY_ROWS
    g.sizes[1] = 1 << 17  # as in a shard of 1.5 million
    assert g._upper_rows() == 512


def test_dense_group_is_whole():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1, 16)) + 0.02 * rng.normal(size=(700, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    assert sum(len(i) for i, _ in g.near(x, 0.9)) == 700 * 700


def test_table_by_brute_force(spark):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    got = sorted(map(tuple, vector_links(df).collect()))
    hit = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.9 * hit and [g[0] for g in got] == [w[0] for w in want]
    assert sum(a == b for a, b in zip(got, want)) >= 0.98 * len(want)


def test_links_count_at_both_ends(spark):
    rng = np.random.default_rng(3)
    n, dim = 4000, 48
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(n, dim))
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * side  # pairs that lie far from all others
    group = x[:1] + 0.02 * rng.normal(size=(2500, dim))  # about 300 in each shard: dense
    rows = [(2 * i + k, v.tolist()) for i, xy in enumerate(zip(x[1:], y[1:])) for k, v in enumerate(xy)]
    rows += [(10_000 + i, v.tolist()) for i, v in enumerate(group)]
    got = {r.vec_id: r for r in vector_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    ends = [(got[2 * i], got[2 * i + 1]) for i in range(n - 1)]
    assert [a.vec_id for a, b in ends if a.n_links != b.n_links or (a.component_id == b.component_id) != (a.n_links > 0)] == []
    assert sum(a.n_links == 1 for a, _ in ends) >= 0.99 * n
    assert all(got[10_000 + i].n_links == 2499 for i in range(2500))


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, -0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [5.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"v": F.lit(1), "n": F.lit("x")})
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vector_links(df).collect()))
    near = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (0, 3, 1, False)]
    assert got == sorted(near + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)])
    assert vector_links(df.limit(0)).count() == 0


def test_chained_vectors_take_products_not_wide_beams(monkeypatch):
    rng = np.random.default_rng(11)
    x = H.to_length_one(np.cumsum(rng.normal(size=(5000, 32)) * 0.15, axis=0) + rng.normal(size=32))
    beams, walk = [], H.Graph._walk
    monkeypatch.setattr(H.Graph, "_walk", lambda self, k, q, entry, beam, limit: (beams.append(beam), walk(self, k, q, entry, beam, limit))[1])
    graph = H.Graph(x)
    graph.audit(0.9)
    links = np.zeros(len(x), np.int64)
    for i, _ in H.linked(graph, x, x, 0.9):
        links += np.bincount(i, minlength=len(x))
    want = (x @ x.T >= 0.9).sum(axis=1)
    assert max(beams) * H.SHARE < len(x) and links.sum() >= 0.99 * want.sum() and (links <= want + 1).all()


def test_shards_hold_a_bound_of_bytes():
    for n, dim in ((200_000, 1024), (3_000_000, 64), (50, 8)):
        shards = H.shard_count(n, n * dim)
        assert shards >= H.LEAST_SHARDS and -(-n // shards) * dim * 12 <= H.SHARD_BYTES + 12 * dim and -(-n // shards) <= H.SHARD_ROWS
    assert H.shard_count(0, 0) == H.LEAST_SHARDS


def test_index_travels_in_small_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    x[3000:] = x[:3000] + 0.02 * rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    tables, write = {}, H.written
    monkeypatch.setattr(H, "written", lambda t, name, *a: tables.setdefault(name, write(t, name, *a)))
    got = vector_links(df).orderBy("vec_id").collect()
    assert all(a.n_links >= 1 and a.component_id == b.component_id for a, b in zip(got[:3000], got[3000:]))
    size = tables["index"].groupBy("shard").agg(F.max(F.length("index")), F.sum(F.length("index"))).collect()
    # 4 bytes a number, not both precisions.
    assert len(size) == H.LEAST_SHARDS and max(r[1] for r in size) <= H.PART and sum(r[2] for r in size) < 6000 * (4 * 32 + 200)
    assert tables["nodes"].schema["v"].dataType.simpleString() == "array<float>"


def test_packed_values_come_back_whole():
    value = (np.arange(20_000), np.zeros((0, 3), np.float32), {"a": np.eye(7)}, "text")
    pieces = list(H.packed(value))
    back = H.Unpacked()
    for p in pieces:
        back.add(p)
    got = back.value()
    assert max(map(len, pieces)) <= H.PART and len(pieces) > 5
    assert (got[0] == value[0]).all() and got[1].shape == (0, 3) and (got[2]["a"] == np.eye(7)).all() and got[3] == "text"
