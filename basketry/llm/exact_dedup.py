"""Exact dedup by deterministic block naming, DataFrame functions only.

A text without white space is cut into fixed-size blocks.  The distinct blocks
are sorted and numbered; then adjacent names are paired, and the distinct pairs
sorted and numbered, until one name is left per document.  Two documents are
equal exactly when block count and last name agree: no hash decides equality.

Documents whose (length, hash) no other document shares are equal to none and
are set aside before naming; equal texts always share both.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import SPACE, row_key, rows_of, written

BLOCK_BYTES = 8192


def _named(keys: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Distinct ``keys`` with an integer ``name`` each: their place in sorted order
    within the hash partition that ``distinct`` put them in, so no range sort."""
    ranked = keys.select(*cols).distinct().sortWithinPartitions(*cols)
    return written(ranked.withColumn("name", F.monotonically_increasing_id()), name)


def block_names(texts: DataFrame, max_bytes: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``texts(rid, body binary)`` to ``(rid, n_blocks, name)``: equal bodies share
    ``(n_blocks, name)``, different ones never do.  ``max_bytes`` bounds the
    length of a body and so the number of levels.  An empty body is one empty block.
    """
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(block_bytes)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring("body", i * block_bytes + 1, F.lit(block_bytes)))
    blocks = texts.withColumn("n_blocks", n).select("rid", "n_blocks", F.posexplode(cut).alias("idx", "block"))
    rows = blocks.join(_named(blocks, ["block"], "blocks"), "block").select("rid", "n_blocks", "idx", "name")
    rows = written(rows, "level")
    done = rows.where("n_blocks = 1")
    for level in range(1, 1 + math.ceil(math.log2(max(1, math.ceil(max_bytes / block_bytes))))):
        half = [F.max(F.when(F.col("idx") % 2 == side, F.col("name"))).alias(c) for side, c in enumerate(("l", "r"))]
        pairs = rows.where(F.col("n_blocks") > 2 ** (level - 1)).groupBy("rid", "n_blocks", F.shiftright("idx", 1).alias("idx")).agg(*half)
        pairs = pairs.withColumn("r", F.coalesce("r", F.lit(-1)))
        rows = written(pairs.join(_named(pairs, ["l", "r"], "pairs"), ["l", "r"]).select("rid", "n_blocks", "idx", "name"), "level")
        done = done.unionByName(rows.where(F.col("n_blocks") <= 2**level))
    return done.select("rid", "n_blocks", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``,
    and ``key`` to join by.

    Texts are equal when identical without white space; a null text is empty.
    Of equal texts the row with the most code points stays, then the smallest id
    (null ids last), then one of the fully repeated rows: exactly one row of each
    group has ``kept``.  Other columns are ignored, so their names cannot clash;
    an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = F.regexp_replace(text, SPACE + "+", "").cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.char_length(text).alias("n_chars"), body.alias("body"))
    rows = rows.withColumns({"n_bytes": F.octet_length("body"), "sig": F.xxhash64("body")})
    slim = written(rows.withColumn("text_sha256", F.sha2("body", 256)).drop("body"), "slim")
    shared = written(slim.groupBy("sig", "n_bytes").count().where("count > 1").drop("count"), "shared", slim.count())
    alone = slim.join(shared, ["sig", "n_bytes"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "key")
    cand = rows.join(shared, ["sig", "n_bytes"], "left_semi").drop("sig").withColumn("rid", F.monotonically_increasing_id())
    cand = written(cand, "candidates")
    max_bytes, n = cand.agg(F.coalesce(F.max("n_bytes"), F.lit(0)), F.count("*")).first()
    named = block_names(cand.select("rid", "body"), max_bytes, block_bytes)
    meta = cand.select("rid", "doc_id", "key", "n_chars", F.sha2("body", 256).alias("text_sha256"))
    named = written(named.join(meta, "rid"), "named")
    first = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    groups = written(named.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), first.alias("first")), "groups", n)
    told = named.join(groups, ["n_blocks", "name"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256", "key")
    return alone.unionByName(told)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, all columns kept."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select("key").distinct()
    return rows_of(docs, kept, id_col, text_col).select("row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS c,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents),
g AS (
  SELECT t, count(*) AS group_size, arg_min(doc_id, (-c, doc_id)) AS keep_id
  FROM (SELECT t, doc_id, c FROM n) GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
