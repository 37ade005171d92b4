"""SimHash near-dedup by anchor-point covering.

Two fingerprints at most ``max_bits`` apart differ in at most one bit of one of
``max_bits // 2 + 1`` equal parts.  On each part a Hamming code, with the bits
beyond its length left free, covers all words within radius 1; its codewords
are the anchors.  A fingerprint is at home at the anchor within the radius and
is copied to every anchor within radius plus 1, about half a part's width of
them.  For a pair that is close on the part, the home of either holds a copy of
the other; there the whole fingerprints are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import components, row_key, rows_of, written

BITS = 64
SHINGLE = 3
MAX_BITS = 3
#: Rows of one anchor that one task compares; larger ones are split into a grid.
CELL_ROWS = 20_000
#: Pairs compared at once.
PAIRS = 1 << 19


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text over its ``shingle``-word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(shingle, len(words))
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    first, last = start[: len(words) - k + 1].tolist(), (start + size)[k - 1 :].tolist()
    ones, n = np.zeros(BITS, np.int64), len(first)
    for a in range(0, n, 1 << 15):  # bounds memory on long texts
        h = np.array([xxhash.xxh64_intdigest(line[s:e], 42) for s, e in zip(first[a : a + (1 << 15)], last[a : a + (1 << 15)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, doc_id, fp)`` per row; ``fp`` is the fingerprint as a signed bigint."""
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([b["key"], b["doc_id"], pa.array(fp.view(np.int64))], ["key", "doc_id", "fp"])

    return rows.mapInArrow(run, rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema)


def anchors(fp: np.ndarray, max_bits: int = MAX_BITS):
    """Yields ``(part, anchor, index into fp, at home)`` arrays for every anchor within
    radius plus 1 of each fingerprint."""
    parts = max_bits // 2 + 1
    width = BITS // parts
    for part in range(parts):
        low, high = part * width, BITS if part == parts - 1 else (part + 1) * width
        x = (fp >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        n = (1 << int(np.log2(high - low + 1))) - 1  # length of the Hamming code
        bit = [np.uint64(0)] + [np.uint64(1 << i) for i in range(high - low)]
        fault = np.zeros(len(x), np.int64)
        for i in range(1, n + 1):
            fault ^= np.where(x & bit[i], i, 0)
        at = np.array(bit)[fault]
        every, home = np.arange(len(x)), x ^ at
        yield part, home, every, True
        free = bit[n + 1 :]
        for i, b in enumerate(free):  # a free bit costs 1; the code's bit costs 1 unless fault is 0
            yield part, home ^ b, every, False
            for c in free[i + 1 :]:
                own = np.flatnonzero(fault == 0)
                yield part, home[own] ^ b ^ c, own, False
        for i in range(1, n + 1):
            own = np.flatnonzero((fault != 0) & ((fault ^ i) > i))
            yield part, x[own] ^ bit[i] ^ np.array(bit)[fault[own] ^ i], own, False


def join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Merge the classes of ``u[i]`` and ``v[i]``; a class is labelled by its least index."""
    while True:
        a, b = label[u], label[v]
        if not (other := a != b).any():
            return label
        np.minimum.at(label, np.maximum(a, b)[other], np.minimum(a, b)[other])
        while (label != (up := label[label])).any():
            label = up


def _links(batches, max_bits: int):
    """Rows of whole cells, in order, to ``(u, v)``: in each run of cells a tree for each class of links."""
    held, rows = [], 0

    def compare(t: pa.Table):
        part, anchor, cell = (t[c].to_numpy() for c in ("part", "anchor", "cell"))
        fp, home = t["fp"].to_numpy().view(np.uint64), t["home"].to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (np.diff(part) != 0) | (np.diff(anchor) != 0) | (np.diff(cell) != 0)]))
        size = np.diff(np.append(new, len(fp)))
        group = np.repeat(np.arange(len(new)), size)
        h = np.flatnonzero(home & (size[group] > 2))  # more than a home and its own copy
        if not len(h):
            return
        name, index = np.unique(fp, return_inverse=True)
        label, count = np.arange(len(name)), size[group[h]]
        end = np.cumsum(count)
        for a in range(0, int(end[-1]), PAIRS):
            k = np.arange(a, min(a + PAIRS, int(end[-1])))
            i = np.searchsorted(end, k, side="right")
            u, v = h[i], new[group[h[i]]] + k - (end[i] - count[i])
            near = np.bitwise_count(fp[u] ^ fp[v]) <= max_bits
            label = join_labels(label, index[u[near]], index[v[near]])
        moved = np.flatnonzero(label != np.arange(len(name)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(name[moved].view(np.int64)), pa.array(name[label[moved]].view(np.int64))], ["u", "v"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < 200_000:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        keys = [t[c].to_numpy() for c in ("part", "anchor", "cell")]
        whole = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        cut = int(whole[-1]) + 1 if len(whole) else 0  # the last cell may go on in the next batch
        if cut:
            yield from compare(t.slice(0, cut))
        held = t.slice(cut).to_batches()
        rows = t.num_rows - cut
    if rows:
        yield from compare(pa.Table.from_batches(held).combine_chunks())


def links(fps: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``fps(fp)``, distinct, to ``(u, v)``: pairs at most ``max_bits`` apart, of which those
    that others imply are left out, so classes of links stay whole.

    An anchor with more than ``cell_rows`` rows is split into a grid of home blocks
    against copy blocks: no task holds it whole and every pair meets in one cell.
    """

    def spread(batches):
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for part, anchor, own, home in anchors(fp, max_bits):
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(anchor.view(np.int64)), pa.array(np.full(n, home)), pa.array(fp[own].view(np.int64))], ["part", "anchor", "home", "fp"])

    rows = written(fps.select("fp").mapInArrow(spread, "part int, anchor bigint, home boolean, fp bigint"), "anchors")
    # Cells of the grid; at most (rows / cell_rows) anchors are in this list.
    hot = rows.groupBy("part", "anchor").count().where(F.col("count") > cell_rows)
    hot = written(hot.select("part", "anchor", F.ceil(F.col("count") / cell_rows).cast("int").alias("k")), "hot", rows.count())
    rows = rows.join(hot, ["part", "anchor"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    block, others = F.pmod(F.xxhash64("fp"), F.col("k")), F.sequence(F.lit(0), F.col("k") - 1)
    # A home meets every copy block, its own copy included; a copy meets every home block.
    as_home = rows.where("home").withColumn("cell", F.explode(F.transform(others, lambda o: block * F.col("k") + o)))
    as_copy = rows.withColumn("cell", F.explode(F.transform(others, lambda o: o * F.col("k") + block))).withColumn("home", F.lit(False))
    cells = as_home.unionByName(as_copy).select("part", "anchor", "cell", "home", "fp")
    cells = cells.repartition("part", "anchor", "cell").sortWithinPartitions("part", "anchor", "cell")
    return cells.mapInArrow(lambda batches: _links(batches, max_bits), "u bigint, v bigint")


def simhash_groups(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``, ``root``, the least
    fingerprint of the component as a bigint, and ``key`` to join by.

    A-Z are lower-cased, words are runs without white space; a text of fewer words
    than a shingle is one shingle, one without words (null too) has fingerprint
    zero.  Fingerprints at most ``max_bits`` apart are linked; ``component_id`` is
    the least id reachable by links (null only where no document in reach has an
    id), a label that components may share; ``root`` is the component's own.  Equal
    fingerprints are one node, so copies cost one row.  Other columns
    are ignored; an empty table gives an empty result.
    """
    told = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    n = told.count()
    nodes = written(told.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes", n)
    found = components(written(links(nodes, max_bits), "links"))
    nodes = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    nodes = written(nodes, "roots", n)
    least = written(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "least", n)
    nodes = written(nodes.join(least, "root").select("fp", "component_id", "root"), "classes", n)
    hexed = F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint")
    return told.join(nodes, "fp").select("doc_id", hexed, "component_id", "root", "key")


def drop_near_copies(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component, that of the least id; all columns kept.

    In a component, of rows without id or with the same id the least fingerprint stays.
    Components that share their least id, or have none, each keep their row.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fingerprint", "key"))
    kept = groups.groupBy("root").agg(first.alias("first")).select("first.key")
    return rows_of(docs, kept, id_col, text_col).select("row.*")
