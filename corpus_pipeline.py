"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows the
one before kept.  ``run`` writes every stage's rows as Parquet to the shared
folder and reads them back for the next, and removes them when that one is written; all
but the last have the columns of ``documents``.  Null texts, texts without a letter and
texts of no learned language go in the first stage, which also fills in missing languages;
a document of equal or near-equal text leaves one row, the longest copy or the
least id; the mix repeats and cuts documents to meet its sources' budgets; the
last stage returns the packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm.common import discard, written
from basketry.llm.exact_dedup import drop_exact_copies
from basketry.llm.langid import keep_identified
from basketry.llm.mixing import mixed_documents
from basketry.llm.packing import pack_documents
from basketry.llm.simhash import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: XXH64 and the tokenizer are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept = written(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return docs
