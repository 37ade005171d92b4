"""Mixing sources to target weights, DataFrame functions only.

Every document gets a hash-random key.  Keys are uniform, so equal key ranges
are the range sort's splitters: sums per range, prefix sums of those, and a
window inside each range give every document's place in its source.  The mix takes
whole epochs of a source and then its documents in key order up to the exact budget.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from basketry.llm.common import SPACE, WORD, row_key, rows_of, written

KEY_BITS = 60
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Documents per key range, on average, and repeats of a row that one task numbers.
RANGE_ROWS = 4096


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``totals(source, source_size)`` with ``target``.

    Weights cycle over the sources in code-point order, null last.  The targets
    are ``least(cap, weight * level)`` at the one level where they sum to ``share``
    of all sizes: resharing the excess by weight until none is above its cap ends
    there.  One row per source, so the windows hold the list of sources only.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    at = F.element_at(F.lit(list(weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumns({"weight": at, "cap": F.col("source_size") * max_epochs})
    t = t.withColumn("full_at", F.col("cap") / F.col("weight"))
    by_full = W.orderBy("full_at", F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(by_full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_full.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    t = t.withColumn("level", (total - below) / rest).withColumn("rank", F.row_number().over(by_full))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("rank", "level"))).over(W.partitionBy())
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * first["level"]), F.col("cap").cast("double"))
    return t.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``, and
    ``source`` and ``row_key`` to join by.

    ``size`` counts words; a null text has none.  ``taken`` sums to the floor of the
    target in each source: the document at the cut gives only the words that are
    left.  It never exceeds ``max_epochs`` sizes.  The order is that of md5 over
    seed, id and text, then id, then size, so reruns agree and one id on any share of
    the rows spreads over all ranges.  Rows that repeat id, text and source are one row
    with a count until the end, and are taken one after the other.  Sources without
    words get target 0.  Null ids and sources are values like others; texts of any length
    are read once, whole; an empty table gives an empty result.
    """
    text = F.col(text_col)
    told = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    key = F.conv(F.substring(F.md5(told.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_key(id_col, text_col).alias("row_key"),
        key.alias("key"),
    )
    slim = written(slim.groupBy("doc_id", "source", "size", "row_key", "key").agg(F.count("*").alias("copies")), "sizes")
    n = slim.count()
    bits = max(0, math.ceil(math.log2(max(1, n / RANGE_ROWS))))
    slim = slim.withColumn("part", F.shiftright("key", KEY_BITS - bits)).withColumn("zone", F.shiftright("part", bits // 2))
    targets = source_targets(slim.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, max_epochs)
    targets = targets.select(F.col("source").alias("s"), "source_size", "target", F.floor("target").alias("budget"))
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    # Prefix sums of the ranges in two steps, zones and the ranges inside a zone.
    before = lambda c, *by: F.coalesce(F.sum(c).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = written(slim.groupBy("source", "zone", "part").agg(F.sum(F.col("size") * F.col("copies")).alias("words")), "ranges", n)
    zones = parts.groupBy("source", "zone").agg(F.sum("words").alias("words"))
    zones = zones.select(F.col("source").alias("zs"), F.col("zone").alias("z"), before("words", "source", "zone").alias("zone_start"))
    parts = parts.withColumn("in_zone", before("words", "source", "zone", "part"))
    parts = parts.join(zones, F.col("source").eqNullSafe(F.col("zs")) & (F.col("zone") == F.col("z")))
    parts = parts.join(targets, F.col("source").eqNullSafe(F.col("s")))
    parts = written(parts.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.col("zone_start") + F.col("in_zone")).alias("start"), "source_size", "target", "epochs", "rest"), "starts", n)
    place = before(F.col("size") * F.col("copies"), "source", "part", F.struct("key", "doc_id", "size", "row_key"))
    rows = slim.withColumn("place", place).join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    # Each copy in its place; of a row with very many, every task numbers a stretch.
    rows = rows.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RANGE_ROWS).cast("long"))))
    if (slim.agg(F.max("copies")).first()[0] or 0) > RANGE_ROWS:
        rows = rows.repartition("row_key", "stretch")
    end = F.least(F.col("stretch") + RANGE_ROWS, F.col("copies")) - 1
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("stretch"), end)))
    rows = rows.withColumn("place", F.col("place") + F.col("copy") * F.col("size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("place")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).alias("taken"), "source", "row_key")


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **policy) -> DataFrame:
    """The mix itself: rows of ``docs``, one per epoch that takes them, all columns kept.

    A document cut at its source's budget is repeated once more with its first
    words only; ``n_chars``, if present, follows the cut text.  Documents of which
    nothing is taken go.  Rows that repeat id and text are one document of their
    common ``taken``.
    """
    mix = mix_sources(docs, id_col, text_col, source_col, **policy)
    mix = mix.groupBy(F.col("row_key").alias("key")).agg(F.max("size").alias("size"), F.sum("taken").alias("taken")).where("taken > 0")
    rows = rows_of(docs, mix, id_col, text_col)
    rows = rows.withColumn("words", F.explode(F.concat(F.array_repeat(F.col("size"), F.expr("cast(taken div size as int)")), F.filter(F.array(F.col("taken") % F.col("size")), lambda w: w > 0))))
    whole = F.col("row")[text_col]
    start = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(f"{SPACE}*{WORD}"), F.lit(0)), 1, F.col("words").cast("int")), "")
    text = F.when(F.col("words") == F.col("size"), whole).otherwise(start)
    new = {text_col: text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (2 * source_size)::DOUBLE / w AS full_at,
         row_number() OVER (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST) AS r
  FROM s),
f AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(2 * source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM l),
t AS (
  SELECT source, source_size,
         coalesce(least((2 * source_size)::DOUBLE, w::DOUBLE * (SELECT arg_min(level, r) FROM f WHERE level <= full_at)), (2 * source_size)::DOUBLE) AS target
  FROM f),
b AS (
  SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS e FROM t),
p AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS place FROM d)
SELECT p.doc_id, p.size, b.source_size, b.target,
       (e * size + greatest(0, least(size, budget - e * source_size - place)))::BIGINT AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""
