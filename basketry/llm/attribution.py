"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole, since cutting it first would change the
tokens at every cut.  Each token's span is joined with the sections' spans, and a
token that crosses a boundary goes by rule to the section that holds most of its
bytes, the earlier one of equal shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from basketry.llm.tokens import byte_lengths, encoder, vocabulary_path

#: Sections given out at once; bounds memory on texts of very many lines.
ROWS = 50_000


def allocate(ends: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Section of each token.  ``ends``: where tokens end, ascending from the start of the
    first at 0; ``edges``: section starts, from 0, and the end of the last; in bytes.

    The interval join of two sorted partitions of one line: a token overlaps the
    sections from the one of its first byte to the one of its last.
    """
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, ends, "left") - 1
    owner = first.copy()
    for i in np.flatnonzero(last > first):
        parts = np.arange(first[i], last[i] + 1)
        held = np.minimum(ends[i], edges[parts + 1]) - np.maximum(starts[i], edges[parts])
        owner[i] = parts[held.argmax()]
    return owner


def line_edges(data: bytes) -> np.ndarray:
    """Edges of the lines, each with the line feed that ends it; empty text: one empty line."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    edges = np.concatenate([[0], breaks])
    return edges if len(data) and edges[-1] == len(data) else np.append(edges, len(data))


def section_tokens(docs: DataFrame, id_col="doc_id", text_col="text", tokenizer: str | None = None) -> DataFrame:
    """One row per line of each document: ``doc_id, section, start, end, n_tokens, n_crossing``.

    ``start`` and ``end`` are code points; ``n_tokens`` the tokens allocated to the line,
    ``n_crossing`` those of them that also hold bytes of another line.  Tokens are
    those of the whole text, so a document's lines sum to its count.  A null or
    empty text is one empty line without tokens.  Rows that repeat an id are
    separate documents; other columns are ignored.
    """
    path = tokenizer or vocabulary_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("section", "start", "end", "n_tokens", "n_crossing")]).schema

    def run(batches):
        encode, size, out = encoder(path), byte_lengths(path), to_arrow_schema(schema)

        def table(names, parts):
            counts = [len(p[0]) for p in parts]
            who = pa.array(names, out.field(0).type).take(pa.array(np.repeat(np.arange(len(names)), counts)))
            cols = [np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(5)]
            return pa.RecordBatch.from_arrays([who, *map(pa.array, cols)], schema=out)

        for b in batches:
            names, parts, n = [], [], 0
            for name, text in zip(b["doc_id"].to_pylist(), b["text"]):
                text = text.as_py() or ""
                data = text.encode()
                edges, ends = line_edges(data), np.cumsum(size[encode(text)])
                owner = allocate(ends, edges) if len(ends) else np.zeros(0, np.int64)
                inside = (np.concatenate([[0], ends[:-1]]) >= edges[owner]) & (ends <= edges[owner + 1]) if len(ends) else np.zeros(0, bool)
                lines = len(edges) - 1
                # Code points before each edge: bytes that do not continue a character.
                points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[edges]
                names.append(name)
                parts.append((np.arange(lines), points[:-1], points[1:], np.bincount(owner, minlength=lines), np.bincount(owner[~inside], minlength=lines)))
                n += lines
                if n >= ROWS:
                    yield table(names, parts)
                    names, parts, n = [], [], 0
            if n:
                yield table(names, parts)

    return rows.mapInArrow(run, schema)
