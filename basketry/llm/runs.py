"""Periodic runs of words, found on suffix trees.

A text's words become integers.  Ukkonen's algorithm builds the suffix tree of a
stretch and of its reversal; an Euler tour of each tree answers the longest common
extension of two positions in constant time, as the string depth of the lowest
common ancestor of two leaves.  For both orders of the alphabet the longest Lyndon
word at each position is the candidate root of a run (Bannai et al., 2015):
extended in both directions it is a run if it fits twice.

Every word of a run occurs twice in it, so a word that a stretch holds once ends
every run there.  Texts are cut at such words first; trees are built of what is left.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 12
#: Rounds of cutting at words that occur once; cutting is a saving only, so a bound is safe.
CUT_ROUNDS = 8
#: Rows returned at once.
BATCH = 256


class SuffixTree:
    """Suffix tree of ``word``, integers from 1 on; a closing 0 makes every suffix a leaf.

    Node ``v`` has the text ``first[v]:last[v]`` on the edge to it; ``edge`` maps
    node * width + symbol to a child.
    """

    def __init__(self, word: list[int]):
        self.text = text = [*word, 0]
        self.width = width = max(text) + 1
        n = len(text)
        first, last, link = [0], [0], [0]
        edge: dict[int, int] = {}
        node = at = length = pending = 0
        for i, c in enumerate(text):
            pending += 1
            fresh = 0  # the inner node that still lacks its suffix link
            while pending:
                if length == 0:
                    at = i
                key = node * width + text[at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(first)
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    a = first[child]
                    span = min(last[child], i + 1) - a
                    if length >= span:  # walk down
                        node, at, length = child, at + span, length - span
                        continue
                    if text[a + length] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    split = len(first)
                    first += (a, i)
                    last += (a + length, n)
                    link += (0, 0)
                    edge[key] = split
                    edge[split * width + c] = split + 1
                    edge[split * width + text[a + length]] = child
                    first[child] = a + length
                    if fresh:
                        link[fresh] = split
                    fresh = split
                pending -= 1
                if node == 0 and length:
                    length -= 1
                    at = i - pending + 1
                else:
                    node = link[node]
        self.first, self.last, self.edge = first, last, edge

    def tour(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the suffixes in order, and the string depth of the shallowest node the
        Euler tour passes on its way to each leaf from the one before.

        With ``descending`` symbols sort from high to low; the closing 0 comes first in both.
        """
        n, width = len(self.text), self.width
        keys = np.fromiter(self.edge.keys(), np.int64, len(self.edge))
        child = np.fromiter(self.edge.values(), np.int64, len(self.edge))
        parent, symbol = np.divmod(keys, width)
        if descending:
            symbol = np.where(symbol > 0, width - symbol, 0)
        order = np.lexsort((-symbol, parent))  # the stack gives back the last one first
        bounds = np.searchsorted(parent[order], np.arange(len(self.first) + 1)).tolist()
        child = child[order].tolist()
        first, last = self.first, self.last
        leaves, shallow, after_leaf, low = [], [], True, 0
        stack, above = [0], [0]
        while stack:
            v, d = stack.pop(), above.pop()
            if after_leaf:  # v's parent is where the tour turned
                low, after_leaf = d, False
            a, b = bounds[v], bounds[v + 1]
            if a == b:
                leaves.append(first[v] - d)
                shallow.append(low)
                after_leaf = True
            else:
                d += last[v] - first[v]
                stack += child[a:b]
                above += [d] * (b - a)
        return np.array(leaves), np.array(shallow)


class Extensions:
    """Longest common extension of two different positions, in constant time: the least depth
    between their leaves, from a table of the least values of 2^k neighbours."""

    def __init__(self, leaves: np.ndarray, shallow: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.least = [shallow.astype(np.int32)]
        while 2 ** len(self.least) <= len(leaves):
            half, low = 2 ** (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(low[:-half], low[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j]) + 1
        level = np.frexp(b - a)[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.least[k][a[of]], self.least[k][b[of] - 2**k])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """Next position of a smaller suffix, where the longest Lyndon word of each position ends."""
    n = len(rank) - 1
    out, stack = [n] * n, [n]
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while rank[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out)


def stretch_runs(word: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """Rows ``start, length, period`` of the runs of at least ``least`` symbols in ``word``."""
    n = len(word)
    word = (np.unique(word, return_inverse=True)[1] + 1).tolist()
    tree = SuffixTree(word)
    leaves, shallow = tree.tour()
    ahead = Extensions(leaves, shallow)
    ranks = [ahead.rank, np.empty(n + 1, np.int64)]
    ranks[1][tree.tour(descending=True)[0]] = np.arange(n + 1)
    del tree
    behind = Extensions(*SuffixTree(word[::-1]).tour())
    start = np.tile(np.arange(n), 2)
    stop = np.concatenate([_next_smaller(r.tolist()) for r in ranks])
    period = stop - start
    left = start - behind(n - start, n - stop)
    length = stop + ahead(start, stop) - left
    found = np.stack([left, length, period], axis=1)[length >= np.maximum(least, 2 * period)]
    return np.unique(found, axis=0)


def cut(word: np.ndarray, least: int = LEAST_LENGTH) -> list[tuple[int, int]]:
    """Stretches of ``word`` that hold all its runs: without words that occur once in them."""
    keep = np.bincount(word, minlength=1)[word] > 1 if len(word) else np.zeros(0, bool)
    for _ in range(CUT_ROUNDS):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], keep, [0]])))
        a, b = edges[::2], edges[1::2]
        long = b - a >= least
        a, b = a[long], b[long]
        now = np.zeros(len(word) + 1, np.int64)
        np.add.at(now, a, 1)
        np.add.at(now, b, -1)
        inside = np.flatnonzero(np.cumsum(now[:-1]))
        if not len(inside):
            return []
        key = np.repeat(np.arange(len(a)), b - a) * (int(word.max()) + 1) + word[inside]
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        keep = np.zeros(len(word), bool)
        keep[inside] = n[back] > 1
        if keep[inside].all():
            break
    return list(zip(a.tolist(), b.tolist()))


def word_runs(words: list[bytes], least: int = LEAST_LENGTH) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, by start, then period."""
    code = defaultdict(count().__next__)
    word = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    found = [np.zeros((0, 3), np.int64)]
    for a, b in cut(word, least):
        found.append(stretch_runs(word[a:b], least) + [a, 0, 0])
    found = np.concatenate(found)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, of every run only its first period."""
    if not len(runs):
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's periodic ending of every tenth document; a null id has no decimal
    form and leaves its words as they are."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    a, g = (h // 10) % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(docs: DataFrame, id_col="doc_id", text_col="text", least: int = LEAST_LENGTH, rewrite: Callable | None = None) -> DataFrame:
    """One row ``doc_id, runs, collapsed`` per row of ``docs``, repeated rows included.

    ``runs`` lists structs ``start, length, period`` by start, then period; ``collapsed``
    is the text's words, of every run only the first period.  Words are parted by
    space and U+0009 to U+000D.  A null text is empty: no runs, nothing left.  Nulls in
    the id stay null.  ``rewrite(doc_id, words)`` may replace the words first.  Texts are
    read whole, a batch of rows at a time; memory follows the longest stretch of repeated
    words (some 600 bytes a word).  Equal lengths, starts and periods cannot tie: a start
    and a period name one run.  An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def find(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                some = batch.slice(a, BATCH)
                every, left = [], []
                for doc_id, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist()):
                    words = (text or "").encode().split()
                    words = rewrite(doc_id, words) if rewrite else words
                    runs = word_runs(words, least)
                    every.append(runs)
                    left.append(collapsed(words, runs).decode())
                flat = np.concatenate(every)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run))
                offsets = pa.array(np.cumsum([0, *map(len, every)]), pa.int32())
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.ListArray.from_arrays(offsets, structs), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``periodic_runs``."""
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct(-r["length"], r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    length, period = F.col("best.length"), F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
