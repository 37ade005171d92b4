"""Quality by a convolutional network over bytes, trained in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Learned
filters slide over each chunk; each gives its largest value there (max pooling).  A
layer of hidden units reads the pooled values of a chunk, and a logistic unit the
units' means over the chunks: one probability for the document, at any length.

A filter is a product of byte embeddings and weights, so its response is a sum of
table rows, one for each byte under it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import labelled_texts
from basketry.llm.toxicity import best_threshold

CHUNK = 256
OVERLAP = 32
WIDTH = 6
FILTERS = 24
DIM = 8
HIDDEN = 12
THRESHOLD = 0.3
#: Bounds of the fit: texts of each label, and chunks of each text, evenly spread.
TRAIN_ROWS = 2500
TRAIN_CHUNKS = 24
EPOCHS = 10
#: Chunks scored at once.
BATCH = 256


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover ``n`` bytes, neighbours sharing ``OVERLAP`` at least."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    count = -(-(n - OVERLAP) // (CHUNK - OVERLAP))
    return np.arange(count) * (n - CHUNK) // (count - 1)


def chunks(text: str | None, most: int | None = None) -> np.ndarray:
    """One row of ``CHUNK`` bytes per chunk; a short text is followed by zeros.  ``most``
    keeps that many, evenly spread."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if len(data) < CHUNK:
        data = np.concatenate([data, np.zeros(CHUNK - len(data), np.uint8)])
    starts = chunk_starts(len(data))
    if most and len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).astype(np.int64)]
    return data[starts[:, None] + np.arange(CHUNK)]


@dataclass
class Model:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH x DIM x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    base: np.ndarray
    threshold: float = 0.0

    @classmethod
    def new(cls, rng) -> Model:
        draw = lambda scale, *shape: (rng.normal(size=shape) * scale).astype(np.float32)
        return cls(draw(0.5, 256, DIM), draw(0.3, WIDTH, DIM, FILTERS), draw(0, FILTERS), draw(0.2, FILTERS, HIDDEN), draw(0, HIDDEN), draw(0.3, HIDDEN), draw(0, 1))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.base]

    def tables(self) -> list[np.ndarray]:
        return [self.embed @ w for w in self.filters]

    def responses(self, data: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """chunks x positions x FILTERS."""
        n = CHUNK - WIDTH + 1
        z = tables[0][data[:, :n]]
        for j in range(1, WIDTH):
            z += tables[j][data[:, j : j + n]]
        return z

    def units(self, data: np.ndarray) -> np.ndarray:
        """Hidden units of each chunk."""
        tables, found = self.tables(), np.zeros((len(data), HIDDEN), np.float32)
        for a in range(0, len(data), BATCH):
            top = self.responses(data[a : a + BATCH], tables).max(axis=1)
            found[a : a + BATCH] = np.tanh(np.maximum(top + self.bias, 0) @ self.hidden + self.hidden_bias)
        return found

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        """Value of the logistic unit for the chunks of each text, before calibration."""
        if not texts:
            return np.zeros(0)
        starts = np.cumsum([0, *(len(t) for t in texts[:-1])])
        sums = np.add.reduceat(self.units(np.concatenate(texts)).astype(np.float64), starts)
        return sums / np.array([[len(t)] for t in texts]) @ self.out + float(self.base[0])

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """From 0 to 1, ``THRESHOLD`` where the calibrated threshold lies."""
        z = self.raw(texts) - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_filters(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 0) -> Model:
    """Fit by Adam on log loss, both classes weighing alike.  Through the pooling only the
    bytes under each filter's largest value get a gradient."""
    rng = np.random.default_rng(seed)
    m = Model.new(rng)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    first, second, step = [np.zeros_like(p) for p in m.parts()], [np.zeros_like(p) for p in m.parts()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            data = np.concatenate([texts[i] for i in some])
            of = np.repeat(np.arange(len(some)), [len(texts[i]) for i in some])
            size = np.bincount(of)
            tables = m.tables()
            z = m.responses(data, tables)
            at = z.argmax(axis=1)  # chunks x FILTERS
            top = np.take_along_axis(z, at[:, None], axis=1)[:, 0] + m.bias
            pooled = np.maximum(top, 0)
            unit = np.tanh(pooled @ m.hidden + m.hidden_bias)
            mean = np.zeros((len(some), HIDDEN), np.float32)
            np.add.at(mean, of, unit)
            mean /= size[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ m.out + m.base[0], -30, 30)))
            err = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
            g_unit = (err / size)[of, None] * m.out * (1 - unit**2)
            g_top = g_unit @ m.hidden.T * (top > 0)
            g_embed, g_filters = np.zeros_like(m.embed), np.zeros_like(m.filters)
            column = np.broadcast_to(np.arange(FILTERS), at.shape)
            for j in range(WIDTH):
                g_table = np.zeros((256, FILTERS), np.float32)
                np.add.at(g_table, (np.take_along_axis(data, at + j, axis=1), column), g_top)
                g_filters[j] = m.embed.T @ g_table
                g_embed += g_table @ m.filters[j].T
            grads = [g_embed, g_filters, g_top.sum(axis=0), pooled.T @ g_unit, g_unit.sum(axis=0), mean.T @ err, err.sum(keepdims=True)]
            step += 1
            now = rate * (0.5 ** (2 * epoch // max(1, epochs)))
            for q, g, u, v in zip(m.parts(), grads, first, second):
                u += 0.1 * (g - u)
                v += 0.01 * (g * g - v)
                q -= now * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return m


def train(docs: DataFrame, labels: DataFrame, allowed=None, id_col="doc_id", text_col="text", label_col="quality", rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``rows`` labelled texts of each label, those of the lowest hash, of which
    every fourth only sets the threshold; None unless both labels occur.

    A text counts once, whatever ids and rows repeat it; an id or text labelled twice counts
    as good if any label is 1.  The driver gets ``TRAIN_CHUNKS`` chunks of each at most.
    """
    found, counts = labelled_texts(docs, labels, label_col, {1: rows, 0: rows}, "quality", allowed, id_col, text_col)
    if len(counts) < 2:
        return None

    def run(batches):
        for b in batches:
            data = [chunks(t, TRAIN_CHUNKS).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["place"], b["y"], pa.array(data, pa.binary())], ["place", "y", "data"])

    found = found.select("place", "y", "text").mapInArrow(run, "place long, y int, data binary").collect()
    found.sort(key=lambda r: (r["y"], r["place"]))
    texts = [np.frombuffer(r["data"], np.uint8).reshape(-1, CHUNK) for r in found]
    y = np.array([r["y"] for r in found])
    aside = np.arange(len(found)) % 4 == 3
    if len({*y[aside]}) < 2 or len({*y[~aside]}) < 2:
        aside = np.ones(len(found), bool)
    fitted = ~aside if not aside.all() else aside
    model = train_filters([t for t, f in zip(texts, fitted) if f], y[fitted])
    raw, y = model.raw([t for t, a in zip(texts, aside) if a]), y[aside]
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    model.threshold = best_threshold(raw, y, weight)
    return model


def score_quality(docs: DataFrame, model: Model | None, text_col="text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 from ``THRESHOLD``
    on) of whole texts.

    Only the text is read, all of its bytes.  A null text is empty; an empty one is one
    chunk of zeros.  Without a model every score is 1: nothing is known to be bad.  Columns
    of these names are replaced; rows stay as they are, repeats included; an empty
    table stays empty.
    """
    rows = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: filters and weights
    at = rows.columns.index(text_col)

    def run(batches):
        model = shared.value
        for b in batches:
            score, texts, n, a = np.ones(b.num_rows), [], 0, 0
            for i, text in enumerate(b.column(at).to_pylist() if model else []):
                texts.append(chunks(text))
                n += len(texts[-1])
                if n >= BATCH or i + 1 == b.num_rows:
                    score[a : i + 1] = model.score(texts)
                    texts, n, a = [], 0, i + 1
            arrays = [*b.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, rows.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)
