"""Language identification by string kernels.

The kernel of two texts counts the n-grams of one to ``MAX_GRAM`` characters
that both hold (blended spectrum, presence), normalised to 1 for equal sets.
Some training texts are Nystrom landmarks: a text's features are its kernels
with the landmarks times the inverse root of the landmarks' own kernel matrix.
One ridge regression per language against all others is solved on them, and
texts are scored in batches: presence matrix times landmark matrix times weights.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from basketry.llm.common import written

MAX_GRAM = 3
#: N-grams are hashed to this many bits, a bit set per text.
HASH_BITS = 16
#: Bounds of the fit: texts and landmarks of each language, and of all languages; with more
#: languages than that each still has one text.
TRAIN_ROWS = 600
LANDMARKS = 32
ALL_ROWS = 38_400
ALL_LANDMARKS = 2_048
#: N-grams of a training text, those of least hash.
TRAIN_GRAMS = 8_192
RIDGE = 1e-3
#: A text is of none of the languages if its share of known n-grams is below this share of the
#: least among the training texts.
REJECT = 0.5
BATCH = 64
#: Characters hashed at once; bounds memory on long texts.
CHUNK = 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_STEPS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def grams(text: str) -> np.ndarray:
    """Ascending hashes of the n-grams in the whole lower-cased text."""
    seen = np.zeros(1 << HASH_BITS, bool)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    for a in range(0, len(points), CHUNK):
        c = points[a : a + CHUNK + MAX_GRAM - 1]
        h = np.zeros(len(c), np.uint32)
        for n in range(min(MAX_GRAM, len(c))):
            h = (h[: len(c) - n] + c[n:] + np.uint32(n + 1)) * _STEPS[n]
            h ^= h >> np.uint32(15)
            seen[(h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - HASH_BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """``column`` maps a gram to its row of ``grams x landmarks`` or -1; ``weights`` are
    ``landmarks x languages`` with the inverse root and the norms folded in."""

    langs: list[str]
    column: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    reject: float = 0.0  # a text with a smaller share of known n-grams is of no learned language

    def known(self, text: np.ndarray) -> float:
        """Share of a gram set that the landmarks hold."""
        return float((self.column[text] >= 0).mean()) if len(text) else 0.0

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """One row per gram set, one regression value per language; about 1 and -1."""
        out = np.zeros((len(texts), len(self.langs)), np.float32)
        for a in range(0, len(texts), BATCH):
            some = texts[a : a + BATCH]
            present = np.zeros((len(some), len(self.landmarks)), np.float32)
            for row, g in zip(present, some):
                c = self.column[g]
                row[c[c >= 0]] = 1 / np.sqrt(len(g))
            out[a : a + BATCH] = present @ self.landmarks @ self.weights
        return out


def fit(examples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Model from ``(language, grams)`` in a fixed order; None without examples."""
    examples = [(lang, g) for lang, g in examples if len(g)]
    langs = sorted({lang for lang, _ in examples})
    if not langs:
        return None
    chosen: list[np.ndarray] = []
    for lang in langs:
        chosen += [g for of, g in examples if of == lang][:landmarks]
    names = np.unique(np.concatenate(chosen))
    column = np.full(1 << HASH_BITS, -1, np.int32)
    column[names] = np.arange(len(names))
    marks = np.zeros((len(names), len(chosen)), np.float32)
    for j, g in enumerate(chosen):
        marks[column[g], j] = 1 / np.sqrt(len(g))
    own = (marks.T @ marks).astype(np.float64)
    value, vector = np.linalg.eigh(own)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    plain = Model(langs, column, marks, np.eye(len(chosen), dtype=np.float32))
    plain.langs = [""] * len(chosen)
    x = plain.scores([g for _, g in examples]).astype(np.float64) @ root
    y = np.array([[1.0 if lang == of else -1.0 for of in langs] for lang, _ in examples])
    # Languages weigh alike, however many examples each has.
    share = np.array([1 / sum(of == lang for of, _ in examples) for lang, _ in examples])
    share *= len(examples) / share.sum()
    w = np.linalg.solve(x.T @ (x * share[:, None]) + ridge * len(examples) * np.eye(x.shape[1]), x.T @ (y * share[:, None]))
    model = Model(langs, column, marks, (root @ w).astype(np.float32))
    model.reject = REJECT * min(model.known(g) for _, g in examples)
    return model


def held_out(id_col, modulus: int, remainder: int):
    """crc32 of the id as text, mod ``modulus``, is ``remainder``; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col="doc_id", text_col="text", lang_col="lang", allowed=None) -> Model | None:
    """Fit on ``train_rows`` texts of each language among ``allowed`` rows, those of least hash,
    every language with its share; None if no row has a language and a text.

    A text counts once for a language, however many rows repeat it, and ids play no part:
    null, repeated and hot ids change nothing.  The driver gets at most
    ``TRAIN_GRAMS`` hashed n-grams of at most ``ALL_ROWS`` texts (or one for each language).
    """
    rows = docs if allowed is None else docs.where(allowed)
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col, F.lit("train")).alias("place"))
    texts = written(rows.select("lang", "place").distinct(), "labelled")
    langs = texts.agg(F.count_distinct("lang")).first()[0]
    if not langs:
        return None
    # A limit by group: each task hands on its least rows of a language only.
    place = F.row_number().over(W.partitionBy("lang").orderBy("place"))
    picks = texts.withColumn("n", place).where(F.col("n") <= max(1, min(train_rows, ALL_ROWS // langs))).drop("n")
    rows = rows.join(F.broadcast(picks), ["lang", "place"]).dropDuplicates(["lang", "place"])

    def run(batches):
        for b in batches:
            found = [grams(t.as_py())[:TRAIN_GRAMS].tobytes() for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["lang"], b["place"], pa.array(found, pa.binary())], ["lang", "place", "grams"])

    found = rows.mapInArrow(run, "lang string, place long, grams binary").collect()
    found.sort(key=lambda r: (r["lang"], r["place"]))
    return fit([(r["lang"], np.frombuffer(r["grams"], np.int32)) for r in found], landmarks=max(1, min(LANDMARKS, ALL_LANDMARKS // langs)))


def told(model: Model | None, texts: Iterable[str | None], rejecting: bool = False) -> tuple[list[str], list[float]]:
    """Language and score of each whole text; ``und`` and 0 for null or letterless texts,
    and for all if there is no model.  ``rejecting`` gives ``und`` to texts of none
    of the languages too.  One text is held at a time."""
    lang, score, own = [], [], []

    def tell():
        for (i, g), row in zip(own, model.scores([g for _, g in own])):
            k = int(row.argmax())
            if not rejecting or model.known(g) >= model.reject:
                lang[i] = model.langs[k]
            score[i] = float(min(1.0, max(0.0, (row[k] + 1) / 2)))
        own.clear()

    for i, t in enumerate(texts):
        lang.append(UNKNOWN)
        score.append(0.0)
        if model and t and _LETTER.search(t):
            own.append((i, grams(t)))
            if len(own) == BATCH:
                tell()
    if own:
        tell()
    return lang, score


def identify(docs: DataFrame, model: Model | None, text_col="text", lang_name="lang_pred", score_name="score", rejecting: bool = False) -> DataFrame:
    """``docs`` with the predicted language and its score from 0 to 1 (0.5: on the border of
    its one-versus-rest machine).  Only the text is read, whole: long texts are hashed a stretch
    at a time.  ``rejecting`` also gives ``und`` to texts of none of the languages.  Equal scores go to the first language by name.  Columns of these names
    are replaced; rows are otherwise kept as they are, nulls and repeats included; an
    empty table stays empty.
    """
    rows = docs.drop(lang_name, score_name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: n-grams of the landmarks
    at = rows.columns.index(text_col)

    def run(batches):
        for b in batches:
            lang, score = told(shared.value, (t.as_py() for t in b.column(at)), rejecting)
            names = [*b.schema.names, lang_name, score_name]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names)

    schema = rows.withColumns({lang_name: F.lit(""), score_name: F.lit(0.0)}).schema
    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, text_col="text", lang_col="lang", id_col="doc_id") -> DataFrame:
    """``docs`` without the rows of which no language can be told: texts that are null or without
    a letter, and texts of none of the learned languages, the landmarks holding less of their
    n-grams than half of the least share among the training texts.

    A missing language becomes the one told; columns and other values are kept as they are.
    If nothing is labelled nothing can be told apart: then rows with a letter stay."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if model is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    told_lang, told_score = "__lang_told", "__score_told"
    rows = identify(docs, model, text_col, told_lang, told_score, rejecting=True).where(F.col(told_lang) != UNKNOWN)
    return rows.withColumn(lang_col, F.coalesce(lang_col, told_lang)).drop(told_lang, told_score)
