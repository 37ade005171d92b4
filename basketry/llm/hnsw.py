"""Embedding near-dedup on hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node with a count.  Nodes are dealt to shards by hash; a
task builds the graph of one shard and audits it with probes at the threshold,
widening the search beam until it finds enough of them.  Graphs travel in rows of
``PART`` bytes, with the vectors as they were given.  Then every node queries
every shard.  A query whose beam holds nothing but links is widened again, so no
cap bounds the links of a vector.  Links are verified by cosine in double
precision and united to components.  A link that either end finds counts at both.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import components, written
from basketry.llm.simhash import join_labels

COSINE = 0.9
NEIGHBOURS = 12
BEAM = 48
#: Probes of the audit, and the share of them that must be found.
PROBES = 400
RECALL = 0.995
#: Vectors of a shard, at most on average; fewer than eight shards only for tiny tables.
SHARD_ROWS = 200_000
LEAST_SHARDS = 8
#: Bytes of a shard's vectors in both precisions, at most on average.
SHARD_BYTES = 256 << 20
#: Bytes of a shard's graph and vectors in a row, at most: Spark's readers and the batches
#: for Python hold some thousands of rows at once.
PART = 16 << 10
#: Parts told at once.
PARTS = 256
#: A beam as wide as this part of the shard costs more than products with all its vectors.
SHARE = 16
QUERY_ROWS = 2048
#: Numbers of the vectors in hand at once, at most, where pairs are verified or links chosen.
NUMBERS = 1 << 20
#: Marks of nodes seen by the walks of one layer, at most.
SEEN = 1 << 25
#: Nodes with so many links in their own shard are compared with all nodes of every shard.
DENSE = 4 * BEAM
#: Nodes inserted at once, at most this share of those already there.
GROWTH = 0.25


class Graph:
    """Layers of neighbour lists over unit vectors; layer ``k`` holds about one node in
    ``NEIGHBOURS**k``.  Searches walk for a whole batch of queries in step."""

    def __init__(self, x: np.ndarray | Units, seed: int = 0):
        n, m = len(x), NEIGHBOURS
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int)
        # Nodes go in by falling level: the upper layers stand before the lower ones.
        self.order = np.argsort(-level, kind="stable")
        self.x = x.single(self.order) if isinstance(x, Units) else x[self.order].astype(np.float32)
        level = level[self.order]
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.beam = BEAM
        self.layers = []
        for k, size in enumerate(self.sizes):
            width = 2 * m if k == 0 else m
            self.layers.append(np.full((size, width), -1, np.int32))
        done = 0
        while done < n:
            step = max(1, min(n - done, int(GROWTH * done), QUERY_ROWS, (1 << 26) // max(1, done)))  # the last bounds memory
            self._insert(done, done + step)
            done += step

    def _insert(self, a: int, b: int) -> None:
        fresh = np.arange(a, b)
        entry = np.zeros(b - a, np.int32)
        for k in reversed(range(len(self.layers))):
            links, old = self.layers[k], min(a, self.sizes[k])
            own = fresh[fresh < self.sizes[k]]
            if old:
                beam, rows = 1 if not len(own) else BEAM, max(1, SEEN // old)
                walked = [self._walk(k, self.x[at : min(b, at + rows)], entry[at - a : at - a + rows, None], beam, old)[0] for at in range(a, b, rows)]  # bounds memory
                found = walked[0] if len(walked) == 1 else np.concatenate(walked)
                entry = found[:, 0]
            if not len(own):
                continue
            # Candidates: what the walk found among older nodes, and the batch itself.
            cand = np.concatenate([found[: len(own)] if old else np.zeros((len(own), 0), np.int32), np.broadcast_to(own, (len(own), len(own))) if len(own) <= 64 else self._batch(own)], axis=1)
            score = np.einsum("qd,qcd->qc", self.x[own], self.x[cand])
            score[(cand < 0) | (cand == own[:, None])] = -np.inf
            self._connect(links, own, cand, score)

    def _batch(self, own: np.ndarray, keep: int = 16) -> np.ndarray:
        """The nearest in the batch of each of its nodes."""
        score = self.x[own] @ self.x[own].T
        return own[np.argpartition(-score, keep, axis=1)[:, : keep + 1]]

    def _diverse(self, cand: np.ndarray, score: np.ndarray, width: int) -> np.ndarray:
        """Of each row of candidates, nearest first, those nearer to the node than to any
        chosen one; then the nearest of the others.  -1 pads."""
        top = np.argsort(-score, axis=1, kind="stable")[:, : 3 * width]
        cand, score = np.take_along_axis(cand, top, 1), np.take_along_axis(score, top, 1)
        v = self.x[cand]
        between = np.einsum("qcd,qed->qce", v, v)
        chosen = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            chosen[:, j] = (np.where(chosen, between[:, j], -np.inf).max(axis=1) < score[:, j]) & np.isfinite(score[:, j])
        rank = np.argsort(np.where(np.isfinite(score), ~chosen, 2), axis=1, kind="stable")[:, :width]
        out = np.where(np.isfinite(np.take_along_axis(score, rank, 1)), np.take_along_axis(cand, rank, 1), -1)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)

    def _connect(self, links: np.ndarray, own: np.ndarray, cand: np.ndarray, score: np.ndarray) -> None:
        half = links.shape[1] // 2
        out = self._diverse(cand, score, half)
        links[own, :half] = out
        # Links back; a full list is chosen anew.
        to, of = out.ravel(), np.repeat(own, half)
        to, of = to[to >= 0], of[out.ravel() >= 0]
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        node, first, count = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(node), int(count.max(initial=0))), -1, np.int32)
        more[np.repeat(np.arange(len(node)), count), np.arange(len(to)) - np.repeat(first, count)] = of
        rows = max(1, min(256, 4 * NUMBERS // ((links.shape[1] + more.shape[1]) * self.x.shape[1])))  # bounds memory
        for a in range(0, len(node), rows):
            some = node[a : a + rows]
            cand = np.concatenate([links[some], more[a : a + rows]], axis=1)
            score = np.einsum("qd,qcd->qc", self.x[some], self.x[cand])
            ordered = np.sort(cand, axis=1)
            twice = np.zeros(cand.shape, bool)
            twice[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
            score = np.take_along_axis(score, np.argsort(cand, axis=1, kind="stable"), 1)
            score[twice | (ordered < 0)] = -np.inf
            links[some] = self._diverse(ordered, score, links.shape[1])

    def _walk(self, k: int, q: np.ndarray, entry: np.ndarray, beam: int, limit: int):
        """Best-first search on layer ``k`` below node ``limit`` for all ``q`` in step:
        ``(nodes, cosines)``, the ``beam`` best of each, best first, -1 padded."""
        links, n = self.layers[k], len(q)
        rows = np.arange(n)
        seen = np.zeros((n, limit), bool)
        node = np.full((n, beam), -1, np.int32)
        near = np.full((n, beam), -np.inf, np.float32)
        node[:, : entry.shape[1]] = entry[:, :beam]
        near[:, : entry.shape[1]] = np.einsum("qd,qcd->qc", q, self.x[entry[:, :beam]])
        seen[rows[:, None], entry] = True
        open_ = node >= 0
        live = rows
        while len(live):
            best = np.where(open_[live], near[live], -np.inf).argmax(axis=1)
            go = open_[live, best]
            live, best = live[go], best[go]
            if not len(live):
                break
            open_[live, best] = False
            step = links[node[live, best]]
            fresh = (step >= 0) & (step < limit)
            safe = np.where(fresh, step, 0)
            fresh &= ~seen[live[:, None], safe]
            seen[live[:, None], np.where(fresh, step, entry[live, :1])] = True
            score = np.where(fresh, np.einsum("qd,qcd->qc", q[live], self.x[safe]), -np.inf)
            all_near = np.concatenate([near[live], score], axis=1)
            top = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            near[live] = np.take_along_axis(all_near, top, 1)
            node[live] = np.take_along_axis(np.concatenate([node[live], np.where(fresh, step, -1)], axis=1), top, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), top, 1)
        return node, near

    def _upper_rows(self) -> int:
        """Queries that walk the upper layers at once."""
        return max(1, min(QUERY_ROWS, (1 << 26) // self.sizes[min(1, len(self.sizes) - 1)]))

    def near(self, q: np.ndarray, least: float, whole: np.ndarray | None = None):
        """Yields blocks of ``(query, node)`` index pairs with cosine of about ``least`` or
        more, nodes as numbered by the caller.  A query whose whole beam is that near
        is asked again with a beam four times as wide, and if that is full too, of all nodes in
        blocked products; so are those in the mask ``whole``, and all queries whose beam would
        be a ``SHARE``-th of the shard.
        """
        q = q.astype(np.float32)
        at_once = np.zeros(len(q), bool) if whole is None else whole
        entry = np.zeros((len(q), 1), np.int32)
        for a in range(0, len(q), rows := self._upper_rows()):  # bounds memory
            for k in reversed(range(1, len(self.layers))):
                entry[a : a + rows] = self._walk(k, q[a : a + rows], entry[a : a + rows], 1, self.sizes[k])[0][:, :1]
        todo, n = np.flatnonzero(~at_once), len(self.x)
        for beam in (self.beam, 4 * self.beam):
            if beam * SHARE >= n:
                break
            wide, rows = [np.zeros(0, np.int64)], max(1, SEEN // max(n, 32 * beam))
            for a in range(0, len(todo), rows):  # bounds memory
                some = todo[a : a + rows]
                node, near = self._walk(0, q[some], entry[some], beam, n)
                full = near[:, -1] >= least
                wide.append(some[full])
                i, j = np.nonzero((near >= least) & ~full[:, None])
                yield some[i], self.order[node[i, j]]
            todo = np.concatenate(wide)
        todo, rows = np.concatenate([todo, np.flatnonzero(at_once)]), max(1, (1 << 20) // n)
        for a in range(0, len(todo), rows):
            i, j = np.nonzero(q[todo[a : a + rows]] @ self.x.T >= least)
            yield todo[a + i], self.order[j]

    def audit(self, least: float, probes: int = PROBES, recall: float = RECALL, seed: int = 1) -> None:
        """Widen the beam until probes that lie at cosine ``least`` to a node find it, or products
        take over."""
        rng = np.random.default_rng(seed)
        own = rng.choice(len(self.x), min(probes, len(self.x)), replace=False)
        side = rng.normal(size=(len(own), self.x.shape[1]))
        side -= (side * self.x[own]).sum(axis=1, keepdims=True) * self.x[own]
        length = np.linalg.norm(side, axis=1, keepdims=True)
        side = np.divide(side, length, out=np.zeros_like(side), where=length > 1e-9)
        q = least * self.x[own] + np.sqrt(1 - least**2) * side
        while self.beam * SHARE < len(self.x):
            hit = [i[j == self.order[own[i]]] for i, j in self.near(q, least - 1e-3)]
            if len(np.unique(np.concatenate(hit))) >= recall * len(own):
                break
            self.beam *= 2


class Units:
    """Rows of ``v``, usable vectors, at length one in double precision, made when they are asked for."""

    def __init__(self, v: np.ndarray):
        self.v = v

    def __len__(self) -> int:
        return len(self.v)

    def __getitem__(self, at) -> np.ndarray:
        return to_length_one(self.v[at].astype(np.float64))

    def single(self, order: np.ndarray) -> np.ndarray:
        """All rows in single precision, as ``order`` says."""
        x = np.empty(self.v.shape, np.float32)
        for a in range(0, len(x), QUERY_ROWS):
            x[a : a + QUERY_ROWS] = self[order[a : a + QUERY_ROWS]]
        return x


def linked(graph: Graph, x: np.ndarray | Units, q: np.ndarray, cosine: float, whole: np.ndarray | None = None):
    """Yields ``(i, j)`` with ``q[i] . x[j] >= cosine`` in double precision, of what the graph finds."""
    rows = max(1, min(1 << 17, NUMBERS // q.shape[1]))  # bounds memory
    for i, j in graph.near(q, cosine - 1e-3, whole):
        for a in range(0, len(i), rows):
            u, v = i[a : a + rows], j[a : a + rows]
            ok = np.einsum("id,id->i", q[u], x[v]) >= cosine
            yield u[ok], v[ok]


def units(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """``(usable, unit vectors in double precision)``; of other than the usable ones' length
    zero, null or non-finite components make a vector unusable."""
    rows = [None if v is None or any(c is None for c in v) else np.asarray(v, np.float64) for v in vectors]
    usable = np.array([r is not None and len(r) > 0 and bool(np.isfinite(r).all()) and bool(r.any()) for r in rows], bool)
    if not usable.any():
        return usable, np.zeros((0, 0))
    return usable, to_length_one(np.stack([r for r, ok in zip(rows, usable) if ok]))


def to_length_one(x: np.ndarray) -> np.ndarray:
    """Rows of ``x``, usable vectors, at length one; scaled first, so no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(value):
    """``value`` pickled, in pieces of at most ``PART`` bytes; its arrays are not copied as a whole."""
    buffers: list = []
    head = pickle.dumps(value, 5, buffer_callback=buffers.append)
    parts = [memoryview(head), *(b.raw() for b in buffers)]
    yield np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    for p in parts:
        for a in range(0, len(p), PART):
            yield bytes(p[a : a + PART])


class Unpacked:
    """The value of ``packed``, from its pieces in turn; its arrays are views of one buffer."""

    def __init__(self):
        self.sizes, self.whole, self.at = None, None, 0

    def add(self, piece) -> None:
        if self.sizes is None:
            self.sizes = np.frombuffer(piece, np.int64)[1:].tolist()
            self.whole = memoryview(bytearray(sum(self.sizes)))
            return
        self.whole[self.at : self.at + len(piece)] = memoryview(piece).cast("B")
        self.at += len(piece)

    def value(self):
        ends = np.cumsum([0, *self.sizes]).tolist()
        parts = [self.whole[a:b] for a, b in zip(ends, ends[1:])]
        return pickle.loads(parts[0], buffers=parts[1:])


def shard_count(vectors: int, numbers: int, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards for so many vectors of ``numbers`` components in all, 12 bytes each (both precisions)."""
    return max(LEAST_SHARDS, -(-vectors // shard_rows), -(-12 * numbers // shard_bytes))


def vector_links(vectors: DataFrame, id_col="vec_id", vec_col="embedding", cosine: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors of different lengths never link.  Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing.  ``n_links`` counts
    all rows linked directly, repeated ids too; ``component_id`` is the least id in
    reach, the row's own included; null ids count as largest.  Other columns are
    ignored; an empty table gives an empty result.
    """
    # Single precision stays so: half the bytes wherever vectors lie or travel.
    number = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(f"array<{number}>").alias("v"))
    bad = "v is null or size(v) = 0 or exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity')) or forall(v, c -> c = 0)"
    rows = rows.withColumn("ok", ~F.expr(f"coalesce({bad}, true)")).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda c: c + F.lit(0.0).cast(number))))
    nodes = rows.where("ok").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    nodes = nodes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("v")})
    nodes = written(nodes, "nodes")
    total, numbers = nodes.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = shard_count(total, numbers, shard_rows)
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))

    def cells(batches, *keys):
        """Runs of rows with equal keys within a batch, as ``(keys, rows)``."""
        for b in batches:
            k = np.stack([b[c].to_numpy() for c in keys], axis=1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)] if len(k) else []
            for at, end in zip(cuts, cuts[1:]):
                yield tuple(k[at].tolist()), b.slice(at, end - at)

    def matrix(part, dim):
        return part["v"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)

    def built(dim, shard, v, ids, n):
        x = Units(v)
        graph = Graph(x)
        graph.audit(cosine)
        label, near = np.arange(len(x)), np.zeros(len(x), np.int64)
        for a in range(0, len(x), QUERY_ROWS):
            for i, j in linked(graph, x, x[a : a + QUERY_ROWS], cosine):
                label = join_labels(label, i + a, j)
                near += np.bincount(i + a, minlength=len(x))
        dense, graph.x = near >= DENSE, None
        many, pieces, part = ids[dense].tolist(), [], 0

        def told():
            first = part - len(pieces)
            told_of = [many if first + k == 0 else [] for k in range(len(pieces))]
            cols = [pa.array([c] * len(pieces), pa.int32()) for c in (dim, shard)]
            cols += [pa.array(range(first, part), pa.int32()), pa.array(pieces, pa.binary()), pa.array(told_of, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["dim", "shard", "part", "index", "many"])

        for piece in packed((graph, v, ids, ids[label], n, dense)):
            pieces.append(piece)
            part += 1
            if len(pieces) == PARTS:
                yield told()
                pieces = []
        if pieces:
            yield told()

    def build(batches):
        last, held = None, []
        whole = lambda: [np.concatenate(c) for c in zip(*held)]
        for cell, part in cells(batches, "dim", "shard"):
            if held and cell != last:
                own, held = whole(), []
                yield from built(*last, *own)
                del own
            last = cell
            held.append((matrix(part, cell[0]), part["node"].to_numpy(), part["n"].to_numpy()))
        if held:
            own, held = whole(), []
            yield from built(*last, *own)

    # A task holds one shard at a time; more partitions than shards, so that few tasks have two.
    dealt = nodes.select("dim", "shard", "node", "n", "v").repartition(4 * shards, "dim", "shard").sortWithinPartitions("dim", "shard", "node")
    index = dealt.mapInArrow(build, "dim int, shard int, part int, index binary, many array<bigint>")
    index = written(index, "index")
    dense = index.select(F.explode("many").alias("node"), F.lit(True).alias("dense"))
    # Tasks: each index against each block of queries; a block's rows follow the index.  Every block
    # has a copy of the index, so there are no more of them than keep the cores busy.
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(16, -(-total // (8 * QUERY_ROWS)), -(-4 * cores // shards)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    as_index = index.withColumn("block", every(blocks)).select("dim", "shard", "block", F.lit(0).alias("turn"), "index", F.col("part").cast("bigint").alias("node"), null(f"array<{number}>", "v"), null("bigint", "n"), null("boolean", "dense"))
    as_query = nodes.join(dense, "node", "left").withColumns({"block": F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int"), "shard": every(shards)})
    as_query = as_query.select("dim", "shard", "block", F.lit(1).alias("turn"), null("binary", "index"), "node", "v", "n", F.coalesce("dense", F.lit(False)).alias("dense"))
    work = as_index.unionByName(as_query).repartition(4 * shards * blocks, "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "turn", "node")

    def ask(batches):
        def told(u, v, at_u, at_v):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (u, v, at_u, at_v)], ["u", "v", "at_u", "at_v"])

        def answered(current, mine, q, own_n, own_dense):
            graph, x, ids, label, n, dense = current
            found, roots = np.zeros(len(mine), np.int64), np.zeros((0, 2), np.int64)
            for i, j in linked(graph, x, q, cosine, own_dense):
                other = mine[i] != ids[j]
                i, j = i[other], j[other]
                # A dense node has found all its links itself; at other ends the pair counts, once.
                found += np.bincount(i, n[j] * own_dense[i], len(mine)).astype(np.int64)
                # One link to each local component.
                roots = np.unique(np.concatenate([roots, np.stack([mine[i], label[j]], axis=1)]), axis=0)
                pair = ~(own_dense[i] & dense[j])
                i, j = i[pair], j[pair]
                u, v, at_u, at_v = mine[i], ids[j], np.where(own_dense[i], 0, n[j]), np.where(dense[j], 0, own_n[i])
                swap = u > v
                yield told(np.where(swap, v, u), np.where(swap, u, v), np.where(swap, at_v, at_u), np.where(swap, at_u, at_v))
            yield told(mine, [None] * len(mine), found, [0] * len(mine))
            # A count of null: no link to count, only one of components.
            yield told(roots[:, 0], roots[:, 1], [None] * len(roots), [None] * len(roots))

        def opened(pieces):
            graph, v, ids, label, n, dense = pieces.value()
            x = Units(v)
            graph.x = x.single(graph.order)
            return graph, x, ids, label, n, dense

        def united(cell, current):
            """What the shard's own search united, whichever end found it; told in one block."""
            ids, label = current[2:4]
            moved = np.flatnonzero(ids != label) if cell[2] == 0 else []
            if len(moved):
                yield told(ids[moved], label[moved], [None] * len(moved), [None] * len(moved))

        last, pieces, current = None, None, None
        for (*cell, turn), part in cells(batches, "dim", "shard", "block", "turn"):
            if pieces is not None and (turn or cell != last):
                current, pieces = opened(pieces), None
                yield from united(last, current)
            if cell != last:
                last, current = cell, None  # a shard may hold no vectors of this length
            if turn == 0:
                pieces = pieces or Unpacked()
                for piece in part["index"]:
                    pieces.add(piece.as_buffer())
            elif current is not None:
                for a in range(0, part.num_rows, QUERY_ROWS):
                    some = part.slice(a, QUERY_ROWS)
                    q, own_dense = to_length_one(matrix(some, cell[0]).astype(np.float64)), some["dense"].to_numpy(zero_copy_only=False)
                    yield from answered(current, some["node"].to_numpy(), q, some["n"].to_numpy(), own_dense)
        if pieces is not None:
            yield from united(last, opened(pieces))

    found = written(work.mapInArrow(ask, "u bigint, v bigint, at_u bigint, at_v bigint"), "found")
    # A pair comes from either end or both; both give it the same counts.
    pairs = found.where("v is not null and at_u is not null").groupBy("u", "v").agg(F.first("at_u").alias("at_u"), F.first("at_v").alias("at_v"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("at_u").alias("links")), F.struct(F.col("v").alias("node"), F.col("at_v").alias("links")))).alias("x")).select("x.*")
    counts = ends.unionByName(found.where("v is null").select(F.col("u").alias("node"), F.col("at_u").alias("links"))).groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("at_u is null").select("u", "v"))
    nodes = nodes.drop("shard", "dim").join(counts, "node", "left").join(joined, "node", "left")
    nodes = written(nodes.withColumn("component", F.coalesce("component", "node")), "classes")
    least = written(nodes.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    nodes = nodes.join(least, "component").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    told = rows.where("ok").join(written(nodes, "told"), "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
