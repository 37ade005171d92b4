"""Hierarchical multi-length packing of token sequences.

Every task packs the documents it reads, in one streaming pass: no token is
shuffled.  Of a document, whole windows of the longest context go out as they
are; the rest is routed to the shortest context tier that holds it.  Tiers are
packed from the longest: a window takes one rest of its own tier, then whole
rests of shorter tiers, the longest that fit; a gap that none fits is filled by
cutting one.  Sequences are dealt to step groups of equal tokens and, as far
as possible, equal attention work.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from basketry.llm.tokens import encoder, vocabulary_path

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Sequences of a step group, in longest contexts.
STEP_WINDOWS = 32
#: Rests held before they are packed.
POOL_DOCS = 8192
#: Tokens of an output batch, about: 1 MB.
BATCH_TOKENS = 1 << 18


class Packer:
    """Packs rests, each no longer than the longest tier, into full windows.

    A piece is ``(doc_id, document's tokens, start, ids)``.
    """

    def __init__(self, tiers=TIERS):
        self.tiers = sorted(tiers, reverse=True)
        self.rests: list[tuple] = []  # (length, serial, piece); ascending while packing
        self.tokens = self.serial = 0

    def add(self, piece: tuple) -> None:
        self.serial += 1
        self.tokens += len(piece[3])
        self.rests.append((len(piece[3]), self.serial, piece))

    def _take(self, room: int) -> list[tuple]:
        """Pieces that fill ``room``: whole rests, longest first, then a cut one."""
        got = []
        while room > 0:
            i = bisect_right(self.rests, (room, self.serial + 1)) - 1
            if i >= 0:
                piece = self.rests.pop(i)[2]
            else:  # every rest is longer: cut the shortest and route its remainder anew
                _, serial, (doc, n, start, ids) = self.rests.pop(0)
                piece = (doc, n, start, ids[:room])
                insort(self.rests, (len(ids) - room, serial, (doc, n, start + room, ids[room:])))
            got.append(piece)
            room -= len(piece[3])
        return got

    def pack(self, last: bool) -> list[tuple[int, list[tuple]]]:
        """Full sequences ``(tier, pieces)``.  Rests too few to fill a window wait; at the
        ``last`` call they are cut to windows of ever shorter tiers, and what is
        less than the shortest is one short sequence."""
        self.rests.sort()
        out = []
        for tier, shorter in zip(self.tiers, [*self.tiers[1:], 0]):
            while self.tokens >= tier and self.rests[-1][0] > shorter:  # routed to this tier
                piece = self.rests.pop()[2]
                out.append((tier, [piece, *self._take(tier - len(piece[3]))]))
                self.tokens -= tier
            if self.rests and self.rests[-1][0] > shorter:
                break  # too few tokens for a window of this tier
        if last:
            for tier in self.tiers:
                while self.tokens >= tier:
                    out.append((tier, self._take(tier)))
                    self.tokens -= tier
            if self.rests:
                out.append((self.tiers[0], [r[2] for r in reversed(self.rests)]))
                self.rests, self.tokens = [], 0
        return out


def step_groups(work: list[tuple[int, int]], step_tokens: int) -> list[int]:
    """Group of each ``(tier, attention work)``: largest first, to the group with the
    fewest tokens, then the least work."""
    n = max(1, round(sum(t for t, _ in work) / step_tokens))
    heap, group = [(0, 0, g) for g in range(n)], [0] * len(work)
    for i in sorted(range(len(work)), key=lambda i: (-work[i][0], -work[i][1], i)):
        tokens, cost, g = heap[0]
        heapq.heapreplace(heap, (tokens + work[i][0], cost + work[i][1], g))
        group[i] = g
    return group


def pack_documents(docs: DataFrame, id_col="doc_id", text_col="text", tokenizer: str | None = None, tiers=TIERS, end_id: int = END_ID, step_windows: int = STEP_WINDOWS, pool_docs: int = POOL_DOCS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, tier,
    step_group, ids`` (binary, little-endian unsigned 32-bit).

    A document's ids are those of its whole text (null: empty) and ``end_id``, so every
    document has a piece.  ``sequence_id`` and ``step_group`` number the sequences
    and groups of each task, the task's partition in the upper bits: they agree
    between runs over the same input splits.  Full sequences have exactly their
    tier's length; each task leaves one shorter sequence at most, to be padded to the
    longest.  A task holds ``pool_docs`` rests of documents, each below the longest
    tier, and one input batch.  Rows that repeat an id are separate documents; other
    columns are ignored; an empty table gives an empty result.
    """
    path = tokenizer or vocabulary_path()
    top = max(tiers)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.select("doc_id", *[F.lit(0).cast(t).alias(c) for c, t in (("start", "long"), ("length", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("tier", "int"), ("step_group", "long"))], F.lit(b"").alias("ids")).schema

    def run(batches):
        encode, out = encoder(path), to_arrow_schema(schema)
        base = TaskContext.get().partitionId() << 33
        packer, ready = Packer(tiers), []
        n_sequences = n_steps = 0

        def dealt(last):
            """The sequences ready, in whole step groups but for the last ones, a batch at a time."""
            nonlocal ready, n_sequences, n_steps
            if not ready or not last and sum(t for t, _ in ready) < 8 * step_windows * top:
                return
            group = step_groups([(t, sum(len(p[3]) ** 2 for p in pieces)) for t, pieces in ready], step_windows * top)
            table, tokens = [], 0
            batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*table), out)], schema=out)
            ready.reverse()
            for g in group:
                tier, pieces = ready.pop()  # its ids go once they are out
                offset = 0
                for doc, n, start, ids in pieces:
                    table.append((doc, start, len(ids), n, base + n_sequences, offset, tier, base + n_steps + g, ids.astype("<u4").tobytes()))
                    offset += len(ids)
                n_sequences += 1
                tokens += offset
                if tokens >= BATCH_TOKENS:
                    yield batch()
                    table, tokens = [], 0
            n_steps += max(group) + 1
            if table:
                yield batch()

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                whole = len(ids) - len(ids) % top
                ready += [(top, [(doc, len(ids), s, ids[s : s + top])]) for s in range(0, whole, top)]
                if len(ids) > whole:
                    packer.add((doc, len(ids), whole, ids[whole:].copy()))
                if len(packer.rests) >= pool_docs:
                    ready += packer.pack(False)
                yield from dealt(False)
        ready += packer.pack(True)
        yield from dealt(True)

    return rows.mapInArrow(run, schema)


def with_crc(pieces: DataFrame) -> DataFrame:
    """The digest of the packing contract: ``ids_crc32`` for ``ids``."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
