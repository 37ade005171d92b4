"""Result tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_patterns(df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet", partition_by=None) -> None:
    """Write a result frame (singles, pairs, combined, comparison) to ``path``.

    The reference only prints results; here they are a table any engine can
    read.  Output files are written by the executors; nothing passes through
    the driver.
    """
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)


def write_uo_list(uo: DataFrame, table: str, buckets: int, mode: str = "errorifexists") -> DataFrame:
    """The UO-list as a table bucketed and sorted by tid; returns it read back.

    Later sessions pair its transactions without an exchange: every task reads its own
    bucket.  ``buckets`` sizes the files (data bytes / 200 MB is a good start).
    """
    uo.write.mode(mode).bucketBy(buckets, "tid").sortBy("tid").format("parquet").saveAsTable(table)
    return uo.sparkSession.table(table)
