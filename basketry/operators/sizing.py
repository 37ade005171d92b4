"""Size-checked broadcast and reuse of intermediate frames."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Fixed value: default byte bound of a broadcast side.
BROADCAST_MAX_BYTES = 256 * 1024 * 1024


def _row_bytes(df: DataFrame):
    """Approximate bytes of a row: UTF-8 length of text / binary columns, 8
    for every other column."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)))
        else:
            parts.append(F.lit(8))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("long")


def bounded_broadcast(
    df: DataFrame, max_rows: int, holds: list | None = None, max_bytes: int = BROADCAST_MAX_BYTES
) -> tuple[DataFrame, bool]:
    """Return ``(broadcast(df), True)`` when ``df`` has at most ``max_rows``
    rows and about ``max_bytes`` bytes.

    The bound is proven by one partially aggregated count and sum of row
    bytes (a row from each task), so the broadcast side is never larger than
    that.  Beyond either bound the frame
    is returned unhinted and the join falls back to a shuffle (sort-merge,
    with AQE skew splitting).  With ``holds`` the computed frame stays
    persisted for the join that reads it and is appended to ``holds``, so the
    caller releases it at its scope edge; without ``holds`` nothing is
    persisted.  ``max_rows <= 0`` disables the broadcast and the check,
    so a plan that uses it stays fully lazy.
    """
    if max_rows <= 0:
        # Broadcasts disabled: no eager check, an ordinary (shuffle) join.
        return df, False
    held = df
    if holds is not None:
        held = df.persist(StorageLevel.MEMORY_AND_DISK)
        holds.append(held)
    size = held.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(held)).alias("b")).first()
    if size.n <= max_rows and (size.b or 0) <= max_bytes:
        return F.broadcast(held), True
    return held, False


#: Rows above which a join key is heavy: fewer of one key are no burden to a task.
HEAVY_ROWS = 1_000_000
#: The list of heavy keys is broadcast, so it is bounded: the heaviest this many.  A key
#: beyond it holds less than one ten-thousandth of all rows.
HEAVY_KEYS = 10_000


def heavy_keys(counted: DataFrame, key: str, n: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Keys with more than ``heavy_rows`` rows and the tasks their rows are to be spread over.

    ``counted`` has one row per key with its count ``n``, from an aggregate that sums
    partial counts, so a heavy key costs a row of each task.  Gives ``(_heavy, _salts)``, the
    salts following the key's share.
    """
    top = counted.where(F.col(n) > heavy_rows).orderBy(F.desc(n), F.col(key)).limit(HEAVY_KEYS)
    return top.select(F.col(key).alias("_heavy"), F.ceil(F.col(n) / F.lit(float(heavy_rows))).cast("int").alias("_salts"))


def spread_join(df: DataFrame, side: DataFrame, key: str, by: str, n: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``df`` joined with ``side``, which has one row per ``key`` and its count ``n`` of rows of ``df``.

    Rows of ordinary keys meet on the key, their side's row once.  A heavy key's rows are
    spread over as many tasks as its share asks for, by their ``by`` column, and only its row of
    ``side`` is copied to these.  Adaptive execution does not split such joins: their sides
    come from aggregates on the same key, whose partitioning they reuse.
    """
    heavy = F.broadcast(heavy_keys(side, key, n, heavy_rows))
    salts = F.coalesce(F.col("_salts"), F.lit(1))

    def marked(rows: DataFrame, salt) -> DataFrame:
        met = rows.join(heavy, F.col(key) == F.col("_heavy"), "left")
        return met.withColumn("_salt", salt).drop("_heavy", "_salts")

    spread = marked(df, F.pmod(F.xxhash64(by), salts).cast("int"))
    copies = marked(side, F.explode(F.sequence(F.lit(0), salts - 1)))
    # Pinned to a shuffle: a broadcast would leave a heavy key's rows in the one task they come in.
    return spread.hint("merge").join(copies, on=[key, "_salt"], how="inner").drop("_salt")


#: Input rows of a task that joins, groups and sorts them all in one stage.
TASK_ROWS = 250_000


def task_count(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks for about ``rows`` rows of ``df`` each, at least one a core; of a Parquet table the
    count reads the files' footers only.

    A stage that keeps the partitioning of a join holds the memory of the join, the groups and the
    window at once.  With a fixed number of partitions that grows with the input.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder.

    Read from ``spark.checkpoint.dir`` (the cluster's shared folder); no
    folder is invented where none is set.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        raise ValueError('set spark.checkpoint.dir to a shared folder before using reuse="checkpoint"')
    sc.setCheckpointDir(configured)
    return configured


def keep(df: DataFrame, how: str) -> DataFrame:
    """Hold a frame that is read more than once."""
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df
