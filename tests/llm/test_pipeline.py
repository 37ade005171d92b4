"""Mixing, exact dedup and the pipeline: SQL, brute force, edge rows."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basketry.llm import common, exact_dedup, mixing
from basketry.llm.common import components, discard, row_key, rows_of, written
from basketry.llm.queries import REGISTRY
from basketry.llm.simhash import fingerprint
from basketry.llm.tokens import vocabulary_path
from tests.conftest import SF001

PLAIN = re.compile(r"[\x20\x09-\x0D]")


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_against_sql(spark, name):
    fn, sql = REGISTRY[name]
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF001}/{table}.parquet'")
    df, want = fn(spark, SF001), con.sql(sql)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


ROWS = [(1, None, "b"), (2, " \n", None), (3, "one two", "b"), (4, "onetwo", "a"), (4, "onetwo", "a"), (5, "one  two", "a"), (None, "three", "z"), (7, "w " * 20_000, "b"), (8, ("w" * 20_000), "b"), (9, "w " * 19_999 + "v", "b")]


def test_exact_edge_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").withColumns({"name": F.lit(1), "sig": F.lit("s"), "row": F.lit(0)})
    for block in (8192, 7):  # one block, and many levels of names
        got = exact_dedup.exact_dedup(df, block_bytes=block).drop("key").collect()
        assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == sorted(
            [(1, 2, 2, False), (2, 2, 2, True), (3, 5, 4, False), (4, 5, 4, False), (4, 5, 4, False), (5, 5, 4, True), (0, 0, 1, True), (7, 7, 2, True), (8, 7, 2, False), (9, 9, 1, True)]
        )
        assert all(r.text_sha256 == hashlib.sha256(PLAIN.sub("", dict((i, t or "") for i, t, _ in ROWS)[r.doc_id]).encode()).hexdigest() for r in got)
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 5, 7, 9]
    assert exact_dedup.drop_exact_copies(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "x y", "a")] * 3, df.schema.names[:3])
    assert sum(r.kept for r in exact_dedup.exact_dedup(same).collect()) == 1 == exact_dedup.drop_exact_copies(same).count()


def test_mixing_edge_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").withColumns({"size": F.lit(1), "part": F.lit("s"), "n_chars": F.lit(0)})
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sources(df).collect()))
    by = {}
    for r in got:
        by.setdefault((r.source, r.target), []).append(r)
    for (source, target), rows in by.items():
        assert sum(r.taken for r in rows) == int(target) and target <= 2 * sum(r.size for r in rows) == 2 * rows[0].source_size
    assert abs(sum(t for _, t in by) - 1.5 * sum(r.size for r in got)) < 1e-6
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len([w for w in PLAIN.split(r.text) if w])
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert words == +want
    assert mixing.mixed_documents(df.limit(0)).count() == 0 == mixing.mix_sources(df.limit(0)).count()


def test_hot_ids_and_repeated_rows_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 64)
    n = 6000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"),  # no id on two thirds
        F.when(F.col("id") % 3 == 1, F.lit("one two three")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"),  # a third repeated
        (F.col("id") % 2).cast("string").alias("source"),
    )
    got = mixing.mix_sources(df)
    rows = got.collect()
    assert len(rows) == n and all(0 <= r.taken <= 2 * r.size for r in rows)
    for source in "01":
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target) and sum(r.size for r in own) == own[0].source_size
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix_sources(df.repartition(5)).collect()))
    keys = got.select("row_key").distinct().count()
    assert keys == 2 * n // 3 + 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = [r["count"] for r in got.where("size = 3").groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == n // 3 and len(tasks) > 1 and max(tasks) < n // 6 + 1


def test_rows_of_repeats_agree(spark):
    df = spark.createDataFrame([(1, "t", s) for s in "abcdefgh"], "doc_id bigint, text string, source string")
    keys = df.select(row_key("doc_id", "text").alias("key")).distinct()
    assert len({rows_of(df.orderBy(F.rand()).repartition(k), keys, "doc_id", "text").first().row.source for k in (1, 2, 3, 5)}) == 1


def test_written_tables_are_discarded(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_dir}")
    a, b = written(spark.range(5), "a"), written(spark.range(7), "b")
    assert len(os.listdir(tmp_dir)) == 2
    discard(a, spark.range(3))
    assert len(os.listdir(tmp_dir)) == 1 and b.count() == 7
    found = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u bigint, v bigint"))
    assert found.select("component").distinct().count() == 1 and len(os.listdir(tmp_dir)) == 2


PIPELINE_ROWS = [
    (None, "the and of that thing is one of them in the house", "en", "a"), (None, "der und die einlich das ist ein haus am see", "de", None),
    (None, None, None, None), (4, "", "en", "a"), (4, " 12 !! ", "en", "a"), (5, "the and of  that thing is one of them in the house", None, "a"),
    (6, "le chat et la vie que nous avons dans le monde", "fr", "b"), (6, "le chat et la vie que nous avons dans le monde", "fr", "b"),
    (7, "the wide road of the city is in the north of the land", "en", "c"), (8, "wort " * 30_000, "de", "c"),
]


def test_pipeline_of_edge_rows(spark, tmp_dir):
    kind = "doc_id bigint, text string, lang string, source string"
    df = spark.createDataFrame(PIPELINE_ROWS, kind).withColumn("n_chars", F.char_length("text").cast("long"))
    extra = {"key": F.lit("s"), "place": F.lit(1), "row": F.lit(0), "size": F.lit(2), "score": F.lit("x")}
    for name, rows in (("plain", df), ("clashing", df.withColumns(extra)), ("empty", df.limit(0))):
        rows.write.parquet(f"{tmp_dir}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_dir}/{name}").collect()
        ids = {r.doc_id for r in out}
        if name == "empty":
            assert not out
            continue
        assert ids <= {None, 5, 6, 7, 8} and 4 not in ids and {6, 8} & ids
        if name == "plain":
            plain = Counter((r.doc_id, r.doc_tokens) for r in out)
        assert Counter((r.doc_id, r.doc_tokens) for r in out) == plain


def test_small_tables_are_written_by_few_tasks(spark):
    few = spark.sparkContext.defaultParallelism
    rows = spark.range(1000, numPartitions=100).selectExpr("id AS u", "id + 1 AS v")
    assert len(written(rows, "t").inputFiles()) == 100
    assert len(written(rows, "t", 1000).inputFiles()) == few
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "101")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = []
        keep = common.written
        with pytest.MonkeyPatch.context() as m:
            m.setattr(common, "written", lambda *a: files.append(keep(*a)) or files[-1])
            m.setattr(common, "discard", lambda *a: None)
            assert components(rows.limit(50)).count() == 51
        assert files and all(len(f.inputFiles()) <= few for f in files)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 7)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (250, 2))]
    label = {n: n for p in pairs for n in p}
    for _ in range(len(label)):
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    got = components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_pipeline_by_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    docs = [d for d in docs if any(c.isalpha() for c in d["text"] or "")]
    best = {}
    for d in docs:
        k = PLAIN.sub("", d["text"])
        best[k] = min(best.get(k, d), d, key=lambda x: (-len(x["text"]), x["doc_id"]))
    docs = sorted(best.values(), key=lambda d: d["doc_id"])
    fps = [fingerprint(d["text"]) for d in docs]
    label = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            label[i] = min(label[j] for j in range(len(docs)) if (fps[i] ^ fps[j]).bit_count() <= 3)
    docs = [d for i, d in enumerate(docs) if label[i] == i]
    size = {d["doc_id"]: len([w for w in PLAIN.split(d["text"]) if w]) for d in docs}
    sources = sorted({d["source"] for d in docs})
    own = {s: sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:  # reshare until none is above twice its size
        left = 1.5 * sum(own.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * own[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * own[s] for s in over}
        open_ -= over
    slow = Tokenizer.from_file(vocabulary_path())
    slow.encode_special_tokens = True
    want = Counter()
    for s in sources:
        left = int(target[s] + 1e-6)
        order = sorted((d for d in docs if d["source"] == s), key=lambda d: (int(hashlib.md5(f"mix{d['doc_id']}:{hashlib.md5(d['text'].encode()).hexdigest()}".encode()).hexdigest()[:15], 16), d["doc_id"]))
        while left and order:
            for d in order:
                n = min(left, size[d["doc_id"]])
                text = d["text"] if n == size[d["doc_id"]] else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", d["text"])[:n])
                left -= n
                if n:
                    want[d["doc_id"], len(slow.encode(text, add_special_tokens=False).ids) + 1] += 1
    got = Counter()
    for r in corpus_pipeline.run(spark, SF001).collect():
        got[r.doc_id, r.doc_tokens] += r.length
        assert len(r.ids) == 4 * r.length
    assert got == Counter({k: n * k[1] for k, n in want.items()})
