"""Prefix trie of conversations that share heads, on composable fingerprints.

A sequence of turns has the fingerprint ``(length, value)``: an element of a monoid
whose product is ``(m + n, x * B^n + y)`` modulo a prime.  Running products of a
conversation's own turns are made once; a rebuilt conversation, the head of one and
the rest of another, is the product of the head's element and the rest's, which is
its own running product with the first turns divided out.  No rebuilt text is made.

A trie node is a depth and a fingerprint.  Equality is verified, not assumed: turns of one
hash must be one role and text, and members of one node must refer to one last turn
(the turns before it are verified a depth higher).  If either fails, all is done again
with another seed.

Sums over subtrees need no walk.  The members of a node are those of its subtree; a
node belongs to its smallest member, and a conversation that owns a node owns all
below it on its path.  So the first owned depth of each conversation is enough to
turn every subtree sum into a sum over members.
"""

from __future__ import annotations

import hashlib
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import WORD, written

PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D1234567890ABCDEF1357
INVERSE = pow(BASE, -1, PRIME)
HALF = 60
#: Conversation ids are joined in stretches of this many before they are hashed in order.
END_BITS = 12


def product(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """Fingerprint of two sequences one after the other; ``(0, 0)`` is the empty one."""
    return a[0] + b[0], (a[1] * pow(BASE, b[0], PRIME) + b[1]) % PRIME


def without(head: tuple[int, int], whole: tuple[int, int]) -> tuple[int, int]:
    """The ``b`` of ``product(head, b) == whole``."""
    n = whole[0] - head[0]
    return n, (whole[1] - head[1] * pow(BASE, n, PRIME)) % PRIME


def parent(value: int, turn: int) -> int:
    """Value of a sequence without its last turn."""
    return (value - turn) * INVERSE % PRIME


def turn_hash(seed: int, role: Column, text: Column) -> Column:
    """md5 of seed, role and text, its first 30 digits as two numbers of 60 bits."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.char_length(role).cast("string"), F.lit(":"), role, text))
    half = lambda a: F.conv(F.substring(digest, a, HALF // 4), 16, 10).cast("long")
    return F.struct(half(1).alias("high"), half(1 + HALF // 4).alias("low"))


def _bytes(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _value(some: bytes | None) -> int:
    return int.from_bytes(some, "big") if some else 0


def _turns(batch) -> list[int]:
    return [(a << HALF) + b for a, b in zip(batch["high"].to_pylist(), batch["low"].to_pylist())]


def _running(batches):
    """Running products and word sums of each conversation in one sorted partition."""
    conv, k, value, words = None, 0, 0, 0
    for b in batches:
        ks, values, sums = [], [], []
        for c, turn, w in zip(b["conv_id"].to_pylist(), _turns(b), b["words"].to_pylist()):
            if c != conv:
                conv, k, value, words = c, 0, 0, 0
            k, value, words = k + 1, (value * BASE + turn) % PRIME, words + w
            ks.append(k), values.append(_bytes(value)), sums.append(words)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ks, pa.int64()), pa.array(values, pa.binary()), pa.array(sums, pa.int64())], [*b.schema.names, "k", "value", "sum"])


def _offsets(key, parts):
    """Product of a conversation's parts before each one; at most as many rows as sorted partitions."""
    import pandas as pd

    out, so_far, words = [], (0, 0), 0
    for r in parts.sort_values("part").itertuples():
        out.append((r.conv_id, r.part, so_far[0], _bytes(so_far[1]), words))
        so_far, words = product(so_far, (r.n, _value(r.value))), words + r.sum
    return pd.DataFrame(out, columns=["conv_id", "part", "n0", "value0", "sum0"])


def _own_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, m, value, sum, words, high, low)`` of every own turn, the product of the
    first ``m``, and ``(conv_id, turns, sum)`` of every conversation.

    A range sort by conversation and turn cuts long conversations over partitions;
    products inside a partition are joined with those of the parts before it.
    """
    key = ["conv_id", F.col("turn").asc_nulls_first(), "high", "low", "tie"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *key).sortWithinPartitions(*key)
    placed = placed.select("conv_id", "high", "low", "words", F.spark_partition_id().alias("part"))
    schema = "conv_id long, high long, low long, words long, part int, k long, value binary, sum long"
    local = written(placed.mapInArrow(_running, schema), "running")
    parts = local.groupBy("conv_id", "part").agg(F.max("k").alias("n"), F.max(F.struct("k", "value"))["value"].alias("value"), F.max("sum").alias("sum"))
    parts = written(parts, "parts")
    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("turns"), F.sum("sum").alias("sum"), F.count("*").alias("parts"))
    # Only the conversations at the edges of partitions: two of each at most.
    cut = parts.join(sizes.where("parts > 1").select("conv_id"), "conv_id").select("conv_id", "part", "n", "value", "sum")
    before = cut.groupBy("conv_id").applyInPandas(_offsets, "conv_id long, part int, n0 long, value0 binary, sum0 long")
    rows = local.join(F.broadcast(before), ["conv_id", "part"], "left")

    def whole(batches):
        for b in batches:
            m, values = [], []
            for k, v, n0, v0 in zip(*(b[c].to_pylist() for c in ("k", "value", "n0", "value0"))):
                m.append(k + (n0 or 0))
                values.append(_bytes(product((n0, _value(v0)), (k, _value(v)))[1]) if n0 else v)
            yield pa.RecordBatch.from_arrays([b["conv_id"], pa.array(m, pa.int64()), pa.array(values, pa.binary()), b["sum"], b["words"], b["high"], b["low"]], ["conv_id", "m", "value", "sum", "words", "high", "low"])

    rows = rows.withColumn("sum", F.col("sum") + F.coalesce("sum0", F.lit(0)))
    return rows.mapInArrow(whole, "conv_id long, m long, value binary, sum long, words long, high long, low long"), sizes.drop("parts")


MEMBER = "conv_id long, turns long, total long, depth long, fp binary, above binary, sum long, words long, high long, low long"


def _members(own: DataFrame, sizes: DataFrame, base: Column, head: Column, max_head: int) -> DataFrame:
    """One row for each conversation and depth of its rebuilt form, root included.

    ``fp`` and ``above`` are the fingerprints of the first ``depth`` turns and of one less,
    ``sum`` their words, ``words``, ``high`` and ``low`` the last turn's; ``turns`` and
    ``total`` are the rebuilt conversation's turns and words.
    """
    heads = written(own.where(F.col("m") <= max_head), "heads")
    convs = sizes.withColumns({"base": base, "h": head.cast("long")})
    first = heads.select(F.col("conv_id").alias("base"), F.struct("m", "value", "sum", "words", "high", "low").alias("head"))
    # At most ``max_head`` rows of a base meet a conversation.
    found = convs.select("conv_id", "base", "h").join(first, "base").where("head.m <= h").groupBy("conv_id").agg(F.sort_array(F.collect_list("head")).alias("heads"))
    skipped = heads.select("conv_id", F.col("m").alias("h"), F.struct("value", "sum").alias("skip"))
    convs = convs.drop("base").join(found, "conv_id", "left").join(skipped, ["conv_id", "h"], "left")
    convs = convs.withColumns({"heads": F.coalesce("heads", F.array().cast(found.schema["heads"].dataType)), "last": F.try_element_at("heads", F.lit(-1))})
    rest = F.greatest(F.lit(0), F.col("turns") - F.col("h"))
    total = F.coalesce("last.sum", F.lit(0)) + F.when(rest > 0, F.col("sum") - F.coalesce("skip.sum", F.lit(0))).otherwise(0)
    convs = convs.withColumns({"turns": F.size("heads") + rest, "total": total.cast("long")})
    convs = written(convs.select("conv_id", "h", "turns", "total", "heads", "last", "skip"), "convs")

    root = convs.select("conv_id", "turns", "total", F.lit(0).cast("long").alias("depth"), F.lit(_bytes(0)).alias("fp"), F.lit(_bytes(0)).alias("above"), *[F.lit(0).cast("long").alias(c) for c in ("sum", "words", "high", "low")])
    shared = convs.select("conv_id", "turns", "total", F.explode("heads").alias("x")).select("conv_id", "turns", "total", F.col("x.m").alias("depth"), F.col("x.value").alias("fp"), "x.sum", "x.words", "x.high", "x.low")
    state = convs.select("conv_id", "h", "turns", "total", F.coalesce("last.m", F.lit(0)).alias("n"), F.col("last.value").alias("head"), F.coalesce("last.sum", F.lit(0)).alias("head_sum"), F.col("skip.value").alias("skip"), F.coalesce("skip.sum", F.lit(0)).alias("skip_sum"))
    later = own.join(state, "conv_id").where("m > h").select("conv_id", "turns", "total", "m", "value", (F.col("sum") - F.col("skip_sum") + F.col("head_sum")).alias("sum"), "words", "high", "low", "h", "n", "head", "skip")

    def rebuilt(batches):
        for b in batches:
            depth, fp, above = [], [], []
            for m, v, h, n, top, skip, turn in zip(*(b[c].to_pylist() for c in ("m", "value", "h", "n", "head", "skip")), _turns(b)):
                d, x = product((n, _value(top)), without((h, _value(skip)), (m, _value(v))))
                depth.append(d), fp.append(_bytes(x)), above.append(_bytes(parent(x, turn)))
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turns"], b["total"], pa.array(depth, pa.int64()), pa.array(fp, pa.binary()), pa.array(above, pa.binary()), b["sum"], b["words"], b["high"], b["low"]], [f.split()[0] for f in MEMBER.split(", ")])

    def lifted(batches):
        for b in batches:
            above = [_bytes(parent(_value(x), turn)) for x, turn in zip(b["fp"].to_pylist(), _turns(b))]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("conv_id", "turns", "total", "depth", "fp")), pa.array(above, pa.binary()), *(b[c] for c in ("sum", "words", "high", "low"))], [f.split()[0] for f in MEMBER.split(", ")])

    return root.unionByName(shared.mapInArrow(lifted, MEMBER)).unionByName(later.mapInArrow(rebuilt, MEMBER))


def _ends(members: DataFrame) -> DataFrame:
    """``(depth, fp, ends_sha256)`` of the nodes where a conversation ends.

    Ids are joined in stretches of ``2**END_BITS`` consecutive numbers; a node's stretches
    are hashed one after the other in their order, in memory of a batch.
    """
    ended = members.where(F.col("depth") == F.col("turns")).select("depth", "fp", "conv_id", F.shiftright("conv_id", END_BITS).alias("stretch"))
    some = ended.groupBy("depth", "fp", "stretch").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    some = some.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "stretch")

    def hashed(batches):
        node, sha = None, None
        for b in batches:
            out = []
            for d, fp, ids in zip(*(b[c].to_pylist() for c in ("depth", "fp", "ids"))):
                if (d, fp) == node:
                    sha.update(b",")
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (d, fp), hashlib.sha256()
                sha.update(ids.encode())
            yield _end_rows(out)
        if node:
            yield _end_rows([(*node, sha.hexdigest())])

    return some.mapInArrow(hashed, "depth long, fp binary, ends_sha256 string")


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["depth", "fp", "ends_sha256"])


def shared_base(conv_id: Column) -> Column:
    """The contract's head: that of the conversation whose id is the next lower multiple of 20."""
    return conv_id - conv_id % 20


def shared_turns(conv_id: Column) -> Column:
    """The contract's length of the head, 0 to 3."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def prefix_trie(convs: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", base=shared_base, head=shared_turns, max_head: int = 3) -> DataFrame:
    """One row per trie node of the rebuilt conversations: ``conv_id`` (its smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    and ``ends_sha256``.

    ``base(conv_id)`` and ``head(conv_id)``, at most ``max_head``, give each conversation the
    first turns of another in place of its own first turns.  Turns sort by number,
    null first; equal numbers by a hash of role and text, so any order of the rows gives one
    result; repeated rows are repeated turns.  Null role or text is empty.  Rows
    without a conversation id belong to none and are not counted.  A
    conversation may hold any share of the turns, and texts any length: they are hashed
    and compared where they lie, once.  An empty table has no members and so no node, not
    even a root.
    """
    slim = convs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    for seed in count():
        hashed = slim.select("*", turn_hash(seed, F.col("role"), F.col("text")).alias("h"))
        said = F.struct("role", "text")
        unequal = hashed.groupBy("h").agg(F.min(said).alias("a"), F.max(said).alias("b")).where("a <> b")
        if unequal.limit(1).count():
            continue
        turns = hashed.select("conv_id", "turn", "h.high", "h.low", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
        own, sizes = _own_prefixes(turns)
        members = written(_members(own, sizes, base(F.col("conv_id")), head(F.col("conv_id")), max_head), "members")
        nodes = members.groupBy("depth", "fp", "above").agg(
            F.min("conv_id").alias("owner"), F.max("turns").alias("deepest"), F.max(F.col("sum") - F.col("words")).alias("sum_above"),
            (F.min("high") < F.max("high")).alias("x"), (F.min("low") < F.max("low")).alias("y"),
        )
        nodes = written(nodes, "nodes")
        if not nodes.where("x or y").limit(1).count():
            break
    # What each conversation owns: its first depth, the parent there, and whether a leaf.
    own = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min(F.struct("depth", "sum_above", "above")).alias("first"), F.max(F.col("deepest") == F.col("depth")).alias("leaf"))
    own = written(own.select("conv_id", F.col("first.depth").alias("first"), "first.sum_above", "first.above", "leaf"), "owned")
    up = nodes.select((F.col("depth") + 1).alias("first"), F.col("fp").alias("above"), F.col("owner").alias("up"))
    own = own.join(up, ["first", "above"], "left").select("conv_id", "first", "sum_above", "leaf", "up")
    rows = members.join(written(own, "owners"), "conv_id", "left")
    saved = F.when(F.col("first").isNull() | (F.col("depth") < F.col("first")), F.coalesce("sum_above", "total") - F.col("sum") + F.col("words")).otherwise(0)
    below = F.col("depth") + 1
    found = rows.groupBy("depth", "fp").agg(
        F.min(F.struct("conv_id", F.when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("conv_id")).alias("up"))).alias("least"),
        F.count("*").alias("n_convs"),
        F.sum(F.when((F.col("first") <= below) & (below <= F.col("turns")), 1).otherwise(0)).alias("n_children"),
        F.sum(F.when(F.col("leaf"), 1).otherwise(0)).alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"),
    )
    found = found.join(_ends(members), ["depth", "fp"], "left")
    return found.select(
        F.col("least.conv_id").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("least.up")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


ORACLE = r"""
WITH RECURSIVE
crc_table AS (
  SELECT range AS b, list_reduce(list_prepend(range::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
  FROM range(256)),
crc_list AS (SELECT list(v ORDER BY b) AS t FROM crc_table),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT c, c - c % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
                         lambda a, s: xor(a >> 8, t[xor(a & 255, s) + 1])), 4294967295::BIGINT) % 4 AS h
  FROM ids, crc_list),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS m,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list(x ORDER BY m) AS xs FROM turns GROUP BY c),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.xs[1:h], []), coalesce(o.xs[h + 1:], [])) AS xs
  FROM heads a LEFT JOIN lists b ON b.c = a.base LEFT JOIN lists o ON o.c = a.c),
members AS (SELECT c, xs, d, md5(xs[1:d]::VARCHAR) || len(xs[1:d]::VARCHAR) AS fp, CASE WHEN d > 0 THEN md5(xs[1:d - 1]::VARCHAR) || len(xs[1:d - 1]::VARCHAR) END AS up,
                   CASE WHEN d > 0 THEN len(regexp_extract_all(xs[d]['text'], '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
            FROM (SELECT c, xs, unnest(range(len(xs) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, fp, min(up) AS up, min(c) AS c, count(*) AS n, max(words) AS words,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(xs) = d), '')) AS ends
  FROM members GROUP BY d, fp),
family AS (SELECT u.d, u.fp, u.c, u.n, u.words, u.ends, p.c AS parent, (SELECT count(*) FROM nodes k WHERE k.d = u.d + 1 AND k.up = u.fp) AS n_children
           FROM nodes u LEFT JOIN nodes p ON p.d = u.d - 1 AND p.fp = u.up),
owned AS (SELECT m.d, m.fp, f.d AS below, f.fp AS below_fp FROM (SELECT c, d, fp FROM members) m
          JOIN (SELECT c, d, fp FROM members) o ON o.c = m.c AND o.d >= m.d JOIN family f ON f.d = o.d AND f.fp = o.fp AND f.c = o.c),
sums AS (SELECT o.d, o.fp, sum((f.n - 1) * f.words) AS saved, count(*) FILTER (WHERE f.n_children = 0) AS leaves
         FROM (SELECT DISTINCT * FROM owned) o JOIN family f ON f.d = o.below AND f.fp = o.below_fp GROUP BY o.d, o.fp)
SELECT f.c AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM family f JOIN sums s ON s.d = f.d AND s.fp = f.fp
"""
