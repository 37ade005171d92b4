"""Packing: every id in exactly one piece, gapless sequences, little padding, even steps."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm import packing
from basketry.llm.packing import Packer, pack_documents
from basketry.llm.tokens import byte_lengths, encoder, vocabulary_path
from tests.conftest import SF001, SF01


@pytest.fixture(scope="module")
def slow():
    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_same_ids_as_tokenizers(spark, slow):
    encode, size = encoder(vocabulary_path()), byte_lengths(vocabulary_path())
    odd = ["", " ", "<|endoftext|> x", "a" * 5000, "\n\n \t é ñ 漢字 😀 \x00", " " * 3000, "don't DON'T 123456 x_y"]
    for text in odd + [r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").select("text").collect()]:
        assert encode(text).tolist() == slow(text)
        assert size[encode(text)].sum() == len(text.encode())


def holds(pieces, docs, slow, top=2048):
    """Checks pieces against documents; returns padding over all tokens."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    want = {}
    for d, t in docs:
        want.setdefault(d, []).append([*slow(t), 1])
    assert set(by_doc) == set(want)
    for d, texts in want.items():
        if len(texts) > 1:
            assert sum(p["length"] for p in by_doc[d]) == sum(map(len, texts))
            continue
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(texts[0])
            assert p["ids"] == np.array(texts[0][at : at + p["length"]], "<u4").tobytes()
            at += p["length"]
        assert at == len(texts[0])
    pad = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= top and len({(p["tier"], p["step_group"]) for p in ps}) == 1
        pad += 0 if at & (at - 1) == 0 else top - at
    return pad / sum(p["length"] for p in pieces)


def test_documents(spark, slow):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    pieces = [r.asDict() for r in pack_documents(df).collect()]
    assert holds(pieces, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], slow) < 0.02
    steps = {}
    for p in pieces:
        steps[p["step_group"]] = steps.get(p["step_group"], 0) + p["length"]
    assert max(steps.values()) - min(steps.values()) <= 2048


def test_digest(spark):
    from basketry.llm.queries import op1_packing

    rows = op1_packing(spark, SF001).collect()
    pieces = {(r.doc_id, r.start): r for r in rows}
    assert len(pieces) == len(rows)
    for r in pack_documents(spark.read.parquet(f"{SF001}/documents.parquet")).collect():
        assert pieces[r.doc_id, r.start].ids_crc32 == zlib.crc32(r.ids)


def test_edge_rows(spark, slow):
    rows = [(1, None, 5), (2, "", 5), (3, "x " * 40_000, 5), (None, "a b", 5), (5, "hello there", None), (5, "hello there", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int").withColumns({"ids": F.lit("x"), "tier": F.lit(1)})
    pieces = [r.asDict() for r in pack_documents(df, pool_docs=2).collect()]
    holds(pieces, [r[:2] for r in rows], slow)
    assert pack_documents(df.limit(0)).count() == 0


def test_output_batches_are_bounded(spark, monkeypatch):
    """A task hands on about a megabyte of ids at once, however much it has packed."""
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    monkeypatch.setattr(packing, "TaskContext", type("Context", (), {"get": classmethod(lambda cls: cls), "partitionId": staticmethod(lambda: 3)}))
    run = pack_documents(docs)
    rows = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([f"{i} " + "word " * (i % 700) for i in range(4000)])], ["doc_id", "text"])
    got = [b.to_pylist() for b in run([rows])]
    assert sum(p["length"] for b in got for p in b) > 4 * packing.BATCH_TOKENS
    assert max(sum(p["length"] for p in b) for b in got) < packing.BATCH_TOKENS + 2048
    numbers = [p["sequence_id"] - (3 << 33) for b in got for p in b]
    assert numbers == sorted(numbers) and set(numbers) == set(range(numbers[-1] + 1))


def test_tokenizers_is_loaded_when_needed(monkeypatch):
    """Texts that ``tiktoken`` handles leave the second vocabulary out of the worker."""
    loaded = []
    monkeypatch.setattr(Tokenizer, "from_file", staticmethod(lambda path: loaded.append(path)))
    encoder.cache_clear()
    assert len(encoder(vocabulary_path())("hello there")) and not loaded


def test_packer_fills_windows():
    rng = np.random.default_rng(3)
    packer, out, total = Packer((4, 8, 16)), [], 0
    for d in range(300):
        n = int(rng.integers(1, 17))
        total += n
        packer.add((d, n, 0, np.arange(n)))
        if len(packer.rests) > 40:
            out += packer.pack(False)
    out += packer.pack(True)
    assert [sum(len(p[3]) for p in ps) for _, ps in out[:-1]] == [t for t, _ in out[:-1]]
    assert sum(len(p[3]) for _, ps in out for p in ps) == total
    assert {t for t, _ in out} == {4, 8, 16}
