"""Driver queries of the operators: ``REGISTRY[name] = (spark_fn, oracle_sql_or_None)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import attribution as op3
from basketry.llm import exact_dedup as op6
from basketry.llm import hnsw as op5
from basketry.llm import langid as op2
from basketry.llm import mixing as op10
from basketry.llm import packing as op1
from basketry.llm import pii as op9
from basketry.llm import prefix_trie as op12
from basketry.llm import quality as op11
from basketry.llm import runs as op13
from basketry.llm import simhash as op7
from basketry.llm import suffix_dedup as op4
from basketry.llm import toxicity as op8


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.with_crc(op1.pack_documents(_documents(spark, sf_dir)))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _documents(spark, sf_dir), op2.held_out("doc_id", 3, 1)
    model = op2.train(docs, allowed=~held)
    return op2.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.section_tokens(_documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.digest(op4.remove_repeats(_documents(spark, sf_dir)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.exact_dedup(_documents(spark, sf_dir)).drop("key")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.simhash_groups(_documents(spark, sf_dir)).drop("root", "key")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _documents(spark, sf_dir), op2.held_out("doc_id", 4, 2)
    langs = op2.train(docs, allowed=~held)
    model = op8.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held, langs=langs)
    told = op8.score_toxicity(docs.select("doc_id", "text"), model, langs)
    return told.select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.digest(op9.pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), op9.production_key(spark)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = op10.mix_sources(_documents(spark, sf_dir))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _documents(spark, sf_dir), op2.held_out("doc_id", 5, 0)
    model = op11.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return op11.score_quality(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.digest(op13.periodic_runs(_documents(spark, sf_dir), rewrite=op13.planted_period))


REGISTRY = {
    "op1_packing": (op1_packing, None),
    "op2_langid": (op2_langid, None),
    "op3_token_counts": (op3_token_counts, None),
    "op4_suffix_dedup": (op4_suffix_dedup, None),
    "op5_embedding_dedup": (op5_embedding_dedup, None),
    "op6_exact_dedup": (op6_exact_dedup, op6.ORACLE),
    "op7_simhash": (op7_simhash, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_pii": (op9_pii, None),
    "op10_mixing": (op10_mixing, op10.ORACLE),
    "op11_quality": (op11_quality, None),
    "op12_prefix_trie": (op12_prefix_trie, op12.ORACLE),
    "op13_periodic_runs": (op13_periodic_runs, None),
}
