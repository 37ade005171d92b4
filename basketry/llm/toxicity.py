"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed to embeddings; filters one to three words wide slide over the
whole text, each gives its largest value, and a logistic unit weighs these.
Thresholds are calibrated for each language on training rows set aside, the
language being told from the text alone; the score is shifted so that every
language's threshold lies at ``THRESHOLD``.
"""

from __future__ import annotations

import copy
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import langid
from basketry.llm.common import discard, every_labelled_text, written

BUCKETS = 1 << 19
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
THRESHOLD = 0.3
#: Texts that one task of a pass steps through, and of one step.
PART_ROWS = 8192
BATCH = 64
#: Bins of raw values in a unit.
BINS = 1000.0
#: Words of ``train_words``, from evenly spread stretches of a longer text.
TRAIN_WORDS = 8192
STRETCH = 256
EPOCHS = 4
#: Words scored at once.
CHUNK = 1 << 17
#: Labelled rows of a class that a language needs for a threshold of its own.
LEAST_ROWS = 15
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class _Words(dict):
    """Bucket of a word, lower-cased and without marks at its ends; 0 is padding."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = b = 1 + zlib.crc32(word.lower().strip(_MARKS).encode()) % (BUCKETS - 1)
        return b


def word_ids(text: str | None, words: _Words) -> np.ndarray:
    """Buckets of all words, then padding to the widest filter."""
    found = (text or "").split()
    ids = np.zeros(len(found) + max(WIDTHS), np.int32)
    ids[: len(found)] = [words[w] for w in found]
    return ids


def train_words(ids: np.ndarray) -> np.ndarray:
    """At most ``TRAIN_WORDS`` of ``ids``, in evenly spread stretches, and the padding."""
    n, own = TRAIN_WORDS // STRETCH, ids[: len(ids) - max(WIDTHS)]
    if len(own) <= TRAIN_WORDS:
        return ids
    starts = np.linspace(0, len(own) - STRETCH, n).astype(np.int64)
    return np.concatenate([*(own[a : a + STRETCH] for a in starts), ids[len(own) :]])


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)  # of the raw value; "" for other languages

    def pooled(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Largest filter values, one row per text; ``starts`` of the texts in ``ids``."""
        x = self.table[ids]
        stop = np.append(starts[1:], len(ids))
        got = []
        for k, w in zip(WIDTHS, self.filters):
            z = x @ w[0]
            for j in range(1, k):
                z[: len(z) - j] += x[j:] @ w[j]
            for j in range(1, k):  # windows must not reach into the next text
                z[stop - j] = -np.inf
            got.append(np.maximum.reduceat(z, starts))
        return np.maximum(np.concatenate(got, axis=1) + self.bias, 0)

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        """Value of the logistic unit for each text, before calibration."""
        value, a = np.zeros(len(texts)), 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and (b == a or n + len(texts[b]) <= CHUNK):
                n += len(texts[b])
                b += 1
            value[a:b] = self._raw_of(texts[a:b])
            a = b
        return value

    def _raw_of(self, texts: list[np.ndarray]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > CHUNK:  # a very long text: overlapping stretches
            ids, step = texts[0], CHUNK - max(WIDTHS)
            parts = [self.pooled(ids[a : a + CHUNK], np.zeros(1, np.int64)) for a in range(0, len(ids) - max(WIDTHS) + 1, step)]
            return np.max(parts, axis=0) @ self.out + self.base
        starts = np.cumsum([0, *map(len, texts[:-1])])
        return self.pooled(np.concatenate(texts), starts) @ self.out + self.base

    def score(self, texts: list[np.ndarray], langs: list[str]) -> np.ndarray:
        """From 0 to 1, ``THRESHOLD`` at the language's threshold."""
        at = np.array([self.thresholds.get(lang, self.thresholds.get("", 0.0)) for lang in langs])
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        z = np.clip(self.raw(texts) - at + shift, -30, 30) if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-z))


def started(seen: np.ndarray, sizes: np.ndarray, seed: int = 0) -> tuple[Model, Model]:
    """The model before any step and its sums of squared gradients; ``seen`` (2 x BUCKETS) counts
    the texts of each label with a word, ``sizes`` all texts of it."""
    rng = np.random.default_rng(seed)
    m = Model(
        (rng.normal(size=(BUCKETS, DIM)) * 0.1).astype(np.float32),
        [(rng.normal(size=(k, DIM, FILTERS)) * 0.3).astype(np.float32) for k in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        (rng.normal(size=len(WIDTHS) * FILTERS) * 0.3).astype(np.float32),
        0.0,
    )
    # Start from the words' log odds (presence, smoothed) in the first dimension, which
    # every filter sees; maxima over random embeddings alone drown rare cues.
    sizes = np.reshape(sizes, (2, 1)).astype(float)
    seen = seen + 5 * sizes / sizes.sum()  # an unseen word has log odds 0
    seen /= sizes
    m.table[:, 0] = np.clip(np.log(seen[1] / seen[0]), -6, 6)
    for w in m.filters:
        w[:, 0] = 1 / len(w) + np.abs(w[:, 0])
    m.out = np.abs(m.out)
    m.table[0] = 0
    squares = Model(*(np.full(m.table.shape, 1e-6, np.float32), [np.full(w.shape, 1e-6, np.float32) for w in m.filters]), np.full(m.bias.shape, 1e-6, np.float32), np.full(m.out.shape, 1e-6, np.float32), 1e-6)
    return m, squares


def class_weights(labels: np.ndarray, sizes) -> np.ndarray:
    """Weights of texts by label under which both labels weigh alike."""
    return np.where(labels == 1, 0.5 / max(1, sizes[1]), 0.5 / max(1, sizes[0])) * (sizes[0] + sizes[1])


def step(m: Model, s: Model, own: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rate: float = 0.02) -> np.ndarray:
    """One Adagrad step on log loss; gives the buckets it changed.  Through the pooling only the words
    under each filter's largest value get a gradient."""
    ids = np.concatenate(own)
    starts = np.cumsum([0, *map(len, own[:-1])])
    stop = np.append(starts[1:], len(ids))
    x = m.table[ids]
    top, at = [], []
    for k, w in zip(WIDTHS, m.filters):
        z = x @ w[0]
        for j in range(1, k):
            z[: len(z) - j] += x[j:] @ w[j]
        where = np.array([s + z[s : e - k + 1].argmax(axis=0) for s, e in zip(starts, stop)])
        top.append(np.take_along_axis(z, where, axis=0))
        at.append(where)
    pre = np.concatenate(top, axis=1) + m.bias
    h = np.maximum(pre, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.base, -30, 30)))
    err = ((p - labels) * weight / len(own)).astype(np.float32)
    g_h = err[:, None] * m.out * (pre > 0)
    g_out, g_bias, g_base = h.T @ err, g_h.sum(axis=0), float(err.sum())
    g_filters, rows, g_rows = [], [], []
    for n, (k, w) in enumerate(zip(WIDTHS, m.filters)):
        g = g_h[:, n * FILTERS : (n + 1) * FILTERS]
        gw = np.zeros_like(w)
        for j in range(k):
            under = x[at[n] + j]  # texts x filters x DIM
            gw[j] = np.einsum("tfd,tf->df", under, g)
            rows.append(ids[at[n] + j].ravel())
            g_rows.append((g[:, :, None] * w[j].T[None]).reshape(-1, DIM))
        g_filters.append(gw)
    touched, back = np.unique(np.concatenate(rows), return_inverse=True)
    g_table = np.zeros((len(touched), DIM), np.float32)
    np.add.at(g_table, back, np.concatenate(g_rows))
    s.table[touched] += g_table**2
    m.table[touched] -= rate * 5 * g_table / np.sqrt(s.table[touched])
    m.table[0] = 0
    for p_, g_, s_ in zip((*m.filters, m.bias, m.out), (*g_filters, g_bias, g_out), (*s.filters, s.bias, s.out)):
        s_ += g_**2
        p_ -= rate * g_ / np.sqrt(s_)
    s.base += g_base**2
    m.base -= rate * g_base / s.base**0.5
    return touched


def train_filters(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02, seed: int = 0) -> Model:
    """Fit on texts at hand, both classes weighing alike."""
    sizes = [(labels == 0).sum(), (labels == 1).sum()]
    seen = np.zeros((2, BUCKETS))
    for ids, y in zip(texts, labels):
        seen[int(y), np.unique(ids)] += 1
    m, squares = started(seen, np.array(sizes), seed)
    rng, weight = np.random.default_rng(seed), class_weights(labels, sizes)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            step(m, squares, [texts[i] for i in some], labels[some], weight[some], rate)
    return m


def _word_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts of each label with a word, and all of them, counted over ``rows(y, ids)`` in Spark."""

    def run(batches):
        seen = np.zeros((2, BUCKETS + 1), np.int64)  # the last place counts the texts
        for b in batches:
            for ids, y in zip(b["ids"].to_pylist(), b["y"].to_pylist()):
                seen[y, np.unique(np.frombuffer(ids, np.int32))] += 1
                seen[y, BUCKETS] += 1
        y, at = np.nonzero(seen)
        for a in range(0, len(y), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(y[part]), pa.array(at[part]), pa.array(seen[y[part], at[part]])], ["y", "bucket", "n"])

    counts = rows.select("y", "ids").mapInArrow(run, "y long, bucket long, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((2, BUCKETS + 1))
    seen[counts["y"].to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return seen[:, :BUCKETS], seen[:, BUCKETS]


def _packed(m: Model) -> np.ndarray:
    """All parameters but the table, in rows of DIM."""
    flat = np.concatenate([*(w.ravel() for w in m.filters), m.bias, m.out, [m.base]])
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM).astype(np.float64)


def _unpack(m: Model, rows: np.ndarray) -> None:
    flat, a = rows.ravel().astype(np.float32), 0
    for q in (*m.filters, m.bias, m.out):
        q[...] = flat[a : a + q.size].reshape(q.shape)
        a += q.size
    m.base = float(flat[a])


def _epoch(rows: DataFrame, m: Model, s: Model, sizes: np.ndarray) -> None:
    """One pass over all ``rows(y, ids)``: every task steps through its own from the same model, and a
    parameter becomes its mean over the tasks that changed it.  The driver gets one row a bucket."""
    shared = rows.sparkSession.sparkContext.broadcast((m, s))  # fixed size

    def run(batches):
        m, s = shared.value
        m, s = copy.deepcopy(m), copy.deepcopy(s)
        touched, own, labels = np.zeros(BUCKETS, bool), [], []

        def learn():
            y = np.array(labels)
            touched[step(m, s, own, y, class_weights(y, sizes))] = True
            own.clear(), labels.clear()

        for b in batches:
            for ids, y in zip(b["ids"].to_pylist(), b["y"].to_pylist()):
                own.append(np.frombuffer(ids, np.int32))
                labels.append(y)
                if len(own) == BATCH:
                    learn()
        if own:
            learn()
        if touched.any():
            at = np.flatnonzero(touched)
            rest = np.concatenate([_packed(m), _packed(s)], axis=1)
            values = np.concatenate([np.concatenate([m.table[at], s.table[at]], axis=1), rest])
            keys = np.concatenate([at, BUCKETS + np.arange(len(rest))])
            for a in range(0, len(keys), 1 << 14):
                some = slice(a, a + (1 << 14))
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), *(pa.array(v.astype(np.float64)) for v in values[some].T)], names)

    names = ["key", *(f"v{i}" for i in range(2 * DIM))]
    got = rows.select("y", "ids").mapInArrow(run, ", ".join([f"{names[0]} long", *(f"{n} double" for n in names[1:])]))
    got = got.groupBy("key").agg(*(F.avg(n).alias(n) for n in names[1:])).toArrow()
    shared.unpersist()
    key, values = got["key"].to_numpy(), np.stack([got[n].to_numpy() for n in names[1:]], axis=1)
    at = key < BUCKETS
    m.table[key[at]], s.table[key[at]] = values[at, :DIM], values[at, DIM:]
    rest = values[~at][np.argsort(key[~at])]
    if len(rest):
        _unpack(m, rest[:, :DIM])
        _unpack(s, rest[:, DIM:])


def _bins(rows: DataFrame, model: Model) -> list:
    """Raw values of all ``rows(y, lang, ids)`` counted in bins of ``1 / BINS``: the driver gets at most
    one row a bin and language, with its counts by label and its least and greatest value."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = [np.frombuffer(x, np.int32) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["lang"], b["y"], pa.array(shared.value.raw(texts))], ["lang", "y", "raw"])

    told = rows.select("lang", "y", "ids").mapInArrow(run, "lang string, y int, raw double")
    at = F.floor(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("raw"))) * BINS).alias("bin")
    return told.groupBy("lang", at).agg(
        F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")
    ).collect()


def binned_threshold(bins: list) -> float:
    """Raw value with the best F1 over all counted texts, in the middle of the gap below its bin."""
    by: dict = {}
    for r in bins:
        hits, n, low, high = by.get(r["bin"], (0, 0, np.inf, -np.inf))
        by[r["bin"]] = (hits + r["hits"], n + r["n"], min(low, r["low"]), max(high, r["high"]))
    rows = [by[k] for k in sorted(by, reverse=True)]
    tp, n = np.cumsum([r[0] for r in rows]), np.cumsum([r[1] for r in rows])
    k = int((2 * tp / (n + tp[-1] + 1e-12)).argmax())
    return float((rows[k][2] + rows[k + 1][3]) / 2) if k + 1 < len(rows) else float(rows[k][2] - 1)


def best_threshold(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """Raw value with the best weighted F1, in the middle of the gap below it."""
    order = np.argsort(-raw, kind="stable")
    r, hit, w = raw[order], labels[order] == 1, weight[order]
    tp, n = np.cumsum(w * hit), np.cumsum(w)
    f1 = 2 * tp / (n + w[hit].sum() + 1e-12)
    f1[:-1][r[:-1] == r[1:]] = -1  # a threshold cannot part equal values
    k = int(f1.argmax())
    return float((r[k] + r[k + 1]) / 2) if k + 1 < len(r) else float(r[k] - 1)


def train(docs: DataFrame, labels: DataFrame, allowed=None, id_col="doc_id", text_col="text", label_col="toxic", langs: langid.Model | None = None) -> Model | None:
    """Fit on all labelled texts, whole; None unless both labels occur.

    The quarter of each label with the lowest hashes sets the thresholds, all others are fitted.  A text counts
    once, whatever ids and rows repeat it; an id or text labelled twice counts as toxic if any
    label is 1.  Word counts, passes and thresholds are Spark jobs over all of them; the driver
    gets the parameters and counts by bin, bounded whatever the number of texts.
    """
    rows, counts = every_labelled_text(docs, labels, label_col, (0, 1), "toxicity", allowed, id_col, text_col)
    if len(counts) < 2:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(langs)

    def run(batches):
        words = _Words()
        for b in batches:
            texts = b["text"].to_pylist()
            lang, _ = langid.told(shared.value, texts)
            ids = [word_ids(t, words).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b["place"], b["y"], pa.array(lang, pa.string()), pa.array(ids, pa.binary())], ["place", "y", "lang", "ids"])

    found = rows.select("place", "y", "text").mapInArrow(run, "place long, y int, lang string, ids binary")
    # Texts are dealt, and ordered in each pass, by their hash, so reruns agree.
    found = written(found.repartition(-(-sum(counts.values()) // PART_ROWS), "place"), "words")
    aside, place = F.lit(False), F.shiftright("place", 48)
    bins = sorted(tuple(r) for r in found.groupBy("y", place).count().collect())  # at most 65,536 for a label
    for y in (0, 1):
        of = np.array([r[1:] for r in bins if r[0] == y])
        cut = int(of[np.searchsorted(np.cumsum(of[:, 1]), of[:, 1].sum() / 4), 0])
        aside = aside | ((F.col("y") == y) & (place <= cut))
    parts = {(r["aside"], r["y"]) for r in found.select(aside.alias("aside"), "y").distinct().collect()}
    fitted, calibrated = (found.where(~aside), found.where(aside)) if len(parts) == 4 else (found, found)
    seen, sizes = _word_counts(fitted)
    model, squares = started(seen, sizes)
    for k in range(EPOCHS):
        _epoch(fitted.sortWithinPartitions(F.xxhash64("place", F.lit(k))), model, squares, sizes)
    bins = _bins(calibrated, model)
    discard(found)
    model.thresholds[""] = binned_threshold(bins)
    for name in sorted({r["lang"] for r in bins}):
        of = [r for r in bins if r["lang"] == name]
        hits, n = sum(r["hits"] for r in of), sum(r["n"] for r in of)
        if min(hits, n - hits) >= LEAST_ROWS:
            model.thresholds[name] = binned_threshold(of)
    return model


def score_toxicity(docs: DataFrame, model: Model | None, langs: langid.Model | None, text_col="text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on) of whole texts.

    Only the text is read: its language comes from ``langs``.  A null text is empty;
    an empty one scores as no word found.  Without a model every score is 0.
    Long texts are scored in overlapping stretches.  Columns of these names are replaced;
    rows stay as they are, repeats included; an empty table stays empty.
    """
    rows = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast((model, langs))  # fixed size: table, filters, landmarks
    at = rows.columns.index(text_col)

    def run(batches):
        model, langs = shared.value
        words = _Words()
        for b in batches:
            texts = b.column(at).to_pylist()
            score = np.zeros(len(texts))
            for a in range(0, len(texts) if model else 0, 256):
                some = texts[a : a + 256]
                score[a : a + 256] = model.score([word_ids(t, words) for t in some], langid.told(langs, some)[0])
            arrays = [*b.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, rows.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)
