"""Text basket formats: S3 (one basket per line), S4 (utility lines), S8.

Both parsers take a DataFrame with a ``value`` string column (what
``spark.read.text`` returns) plus an optional key column, so the same code
parses files and lines built from tables.  Tokens are exploded with their
position (``posexplode``); nothing is collected per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.columns import hash_price, numeric_token
from basketry.operators.sizing import bounded_broadcast

# Token separators of the two formats.
WHITESPACE = r"\s+"
FIELD_SEP = ":"


def with_tid(df: DataFrame, key: str | None = None) -> DataFrame:
    """A transaction id for inputs without one.

    With ``key`` the existing column is the id (its own type).  Otherwise
    ``monotonically_increasing_id`` is taken before any explode: a bigint,
    unique, and increasing in file order within a single file, but not
    stable across file layouts, so tests never compare it.  ``line_no`` keeps
    the id for ordering (first-seen prices).  Ids stay numeric so they
    shuffle as 8 bytes; outputs cast them to text where needed.
    """
    if key is not None:
        out = df.withColumn("tid", F.col(key))
        if "line_no" not in df.columns:
            out = out.withColumn("line_no", F.col(key))
        return out
    mid = F.monotonically_increasing_id()
    if "line_no" in df.columns:
        return df.withColumn("tid", mid)
    return df.withColumn("line_no", mid).withColumn("tid", F.col("line_no"))


def with_stable_ids(df: DataFrame, name: str = "tid", max_rows: int = 1_000_000) -> DataFrame:
    """Rows of files numbered 0, 1, ... by file name, then place in the file.

    ``df`` is an unfiltered read of files (text, CSV, Parquet).  Two passes: rows per split
    of a file with their prefix sums, first inside a file, then over the files (one row
    each), and the place of a row in its split.  Ids are the same under any split size,
    core count and partitioning.  The splits' table is broadcast only when a
    count proves it small (``max_rows``; 0 never).
    """
    own = F.monotonically_increasing_id()  # consecutive inside a split
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), own.alias("_at"))
    splits = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_n"))
    files = files.select("_file", before(Window.orderBy("_file")).alias("_of_file"))
    splits = splits.withColumn("_of_split", before(Window.partitionBy("_file").orderBy("_start"))).join(files, "_file")
    offsets = splits.select("_file", "_start", (F.col("_of_file") + F.col("_of_split") - F.col("_first")).alias("_offset"))
    side, _ = bounded_broadcast(offsets, max_rows)
    return rows.join(side, ["_file", "_start"]).withColumn(name, F.col("_at") + F.col("_offset")).drop("_file", "_start", "_at", "_offset")


def read_lines(spark, path: str, stable_ids: bool = False) -> DataFrame:
    """Lines of one or several text files as ``value``, with a ``line_no`` that orders them by
    file name, then place in the file (scans order splits by size, not name).

    With ``stable_ids`` ``line_no`` is the line's number over all files, the same under any
    file splitting (``with_stable_ids``; pass ``key="line_no"`` to the parsers).
    """
    if stable_ids:
        return with_stable_ids(spark.read.text(path), "line_no")
    at = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    return spark.read.text(path).select("value", at.alias("line_no"))


def _tokens(text) -> F.Column:
    """Split on runs of whitespace, dropping empty tokens (doubled spaces,
    leading or trailing blanks)."""
    return F.filter(F.split(F.trim(text), WHITESPACE), lambda t: F.length(t) > 0)


def parse_line_baskets(
    lines: DataFrame,
    key: str | None = None,
    numeric_only: bool = True,
    price: str = "constant",
    constant_price: float = 1.0,
) -> DataFrame:
    """S3: ``"1 2 3"`` per line -> basket lines (quantity 1 per token).

    Blank lines yield no rows (F9); non-numeric tokens are dropped when
    ``numeric_only`` (F3).  ``price`` is ``"constant"`` or ``"hash"`` (D3,
    D4); the reference's random price is replaced by the hash price.
    """
    df = with_tid(lines, key)
    df = df.select("tid", "line_no", F.posexplode(_tokens(F.col("value"))).alias("pos", "item"))
    if numeric_only:
        df = df.where(numeric_token(F.col("item")))
    unit = hash_price(F.col("item")) if price == "hash" else F.lit(float(constant_price))
    return df.select(
        "tid",
        "item",
        F.lit(1.0).alias("quantity"),
        unit.alias("unit_price"),
        F.struct("line_no", "pos").alias("seq"),
    )


def read_line_baskets(spark, path: str, stable_ids: bool = False, **kw) -> DataFrame:
    """S3 from files: one transaction per line, its id the line's number with ``stable_ids``."""
    return parse_line_baskets(read_lines(spark, path, stable_ids), key="line_no" if stable_ids else None, **kw)


def parse_utility_lines(
    lines: DataFrame,
    key: str | None = None,
    utilities: str = "zip",
    numeric_only: bool = True,
    floor: float | None = None,
    default_price: float | None = None,
) -> DataFrame:
    """``"items:TU:utilities"`` -> basket lines with a given ``tu``.

    utilities="zip"      item k gets utility k (quantity 1, unit_price = the
                         utility); ``tu`` is field 2.  A token with no
                         utility (short list) or a non-numeric utility gets
                         ``default_price`` when given, else the hash price.
                         ``floor`` lifts utilities below it (first-seen
                         parity: 0.01).
    utilities="as_items" the utility numbers are appended to the items, as the
                         Spark scripts do (quantity 1, unit_price 1).  As
                         there, a line without a third field yields nothing
                         (the concatenation with a missing field is null).

    Lines with fewer than two fields are skipped (F9); a non-numeric TU is
    null and the cleaning step drops it.  Positions are counted before the
    numeric filter.
    """
    df = with_tid(lines, key)
    parts = F.split(F.col("value"), FIELD_SEP)
    df = df.where(F.size(parts) >= 2).select(
        "tid",
        "line_no",
        F.size(parts).alias("n_fields"),
        _tokens(parts.getItem(0)).alias("items"),
        F.trim(parts.getItem(1)).try_cast("double").alias("tu"),
        _tokens(F.coalesce(F.get(parts, 2), F.lit(""))).alias("utils"),
    )
    if utilities == "as_items":
        df = df.where(F.col("n_fields") >= 3).select(
            "tid",
            "line_no",
            "tu",
            F.posexplode(F.concat(F.col("items"), F.col("utils"))).alias("pos", "item"),
        )
        if numeric_only:
            df = df.where(numeric_token(F.col("item")))
        return df.select(
            "tid",
            "item",
            F.lit(1.0).alias("quantity"),
            F.lit(1.0).alias("unit_price"),
            "tu",
            F.struct("line_no", "pos").alias("seq"),
        )
    if utilities != "zip":
        raise ValueError('utilities must be "zip" or "as_items"')
    df = df.select(
        "tid",
        "line_no",
        "tu",
        "utils",
        F.posexplode("items").alias("pos", "item"),
    )
    if numeric_only:
        df = df.where(numeric_token(F.col("item")))
    raw = F.get(F.col("utils"), F.col("pos"))
    u = raw.try_cast("double")
    if floor is not None:
        u = F.greatest(u, F.lit(float(floor)))
    synthetic = hash_price(F.col("item"))
    bad = F.lit(float(default_price)) if default_price is not None else synthetic
    price = F.when(raw.isNull(), synthetic).when(u.isNull(), bad).otherwise(u)
    return df.select(
        "tid",
        "item",
        F.lit(1.0).alias("quantity"),
        price.alias("unit_price"),
        "tu",
        F.struct("line_no", "pos").alias("seq"),
    )


def read_utility_lines(spark, path: str, stable_ids: bool = False, **kw) -> DataFrame:
    """S4 from files; the line's number is its transaction's id with ``stable_ids``."""
    return parse_utility_lines(read_lines(spark, path, stable_ids), key="line_no" if stable_ids else None, **kw)
