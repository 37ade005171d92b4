"""CSV basket formats: S1 (retail lines), S2 (member-day baskets)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import hash_price
from basketry.schema import require_columns

# Column names of the two CSV layouts.
RETAIL_COLUMNS = ("InvoiceNo", "StockCode", "Quantity", "UnitPrice", "CustomerID")
MEMBER_DAY_COLUMNS = ("Member_number", "Date", "itemDescription")


def _read_csv(spark, path: str, encoding: str) -> DataFrame:
    """Header read with every column typed string: no inference pass over the
    data, and codes like ``85123A`` stay text.  Numbers are cast with
    ``try_cast`` by the parsers."""
    return (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("inferSchema", False)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def parse_retail(df: DataFrame, required=RETAIL_COLUMNS, mapping: dict | None = None) -> DataFrame:
    """S1 mapping: InvoiceNo, StockCode, Quantity, UnitPrice, CustomerID.

    ``mapping`` names the source column of any of the five that the file
    calls otherwise, as ``{"InvoiceNo": "order_id", ...}``.

    ``required`` are the columns whose null drops the row (the Spark scripts
    require all five, the Python version only CustomerID).
    """
    mapping = mapping or {}
    strange = [c for c in mapping if c not in RETAIL_COLUMNS]
    if strange:
        raise ValueError(f"mapping keys must be among {RETAIL_COLUMNS}: {strange}")
    source = {c: mapping.get(c, c) for c in RETAIL_COLUMNS}
    require_columns(df, source.values(), "retail CSV")
    unknown = [c for c in required if c not in RETAIL_COLUMNS]
    if unknown:
        raise ValueError(f"required columns must be among {RETAIL_COLUMNS}: {unknown}")
    out = df.select(
        F.col(source["InvoiceNo"]).cast("string").alias("tid"),
        F.col(source["StockCode"]).cast("string").alias("item"),
        F.col(source["Quantity"]).try_cast("double").alias("quantity"),
        F.col(source["UnitPrice"]).try_cast("double").alias("unit_price"),
        F.col(source["CustomerID"]).cast("string").alias("customer_id"),
    )
    rename = {"InvoiceNo": "tid", "StockCode": "item", "Quantity": "quantity", "UnitPrice": "unit_price", "CustomerID": "customer_id"}
    return out.dropna(subset=[rename[c] for c in required])


def rejected_lines(df: DataFrame, columns=RETAIL_COLUMNS, numbers=("Quantity", "UnitPrice")) -> DataFrame:
    """the rows of a retail table that loading and cleaning drop, with the first ``reason``.

    ``missing X`` for a null or blank field, ``bad X`` for a number that does not parse or is
    not finite, ``not positive X``.  The other columns are kept, so a reject table can be
    written beside the result, and counted by reason.
    """
    require_columns(df, columns, "retail CSV")
    reason = F.lit(None).cast("string")
    for c in reversed(list(columns)):
        text = F.col(c).cast("string")
        if c in numbers:
            x = F.col(c).try_cast("double")
            bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
            reason = F.when(bad, F.lit(f"bad {c}")).when(x <= 0, F.lit(f"not positive {c}")).otherwise(reason)
        reason = F.when(text.isNull() | (F.trim(text) == ""), F.lit(f"missing {c}")).otherwise(reason)
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def read_csv_baskets(
    spark, path: str, encoding: str = "UTF-8", required=RETAIL_COLUMNS, mapping: dict | None = None
) -> DataFrame:
    """Retail invoice lines.  Use ``encoding="ISO-8859-1"`` for the
    latin-1 export the Python reader expects."""
    return parse_retail(_read_csv(spark, path, encoding), required, mapping)


def parse_member_day(
    df: DataFrame,
    price: str = "constant",
    constant_price: float = 1.0,
    trim_items: bool = True,
    order_key: bool = False,
    date_format: str | None = None,
) -> DataFrame:
    """tid = ``member_date``, quantity 1, price a policy (constant or hash).

    ``customer_id`` is the member.  Items are trimmed (the Python reader
    does; the Spark script does not, so pass ``trim_items=False`` for it).

    ``order_key`` adds ``order_key``, a struct (member as a number, date) for
    ``sample_first(lines, n, by="order_key")``: member 10 comes after member 2.  The date is
    parsed with ``date_format``; without one its text orders it, as a plain reader of
    the file would.  A member that is no number comes first, by its text.
    """
    require_columns(df, MEMBER_DAY_COLUMNS, "member-day CSV")
    item = F.col("itemDescription").cast("string")
    if trim_items:
        item = F.trim(item)
    unit = hash_price(item) if price == "hash" else F.lit(float(constant_price))
    columns = [
        F.concat(F.col("Member_number").cast("string"), F.lit("_"), F.col("Date").cast("string")).alias("tid"),
        item.alias("item"),
        F.lit(1.0).alias("quantity"),
        unit.alias("unit_price"),
        F.col("Member_number").cast("string").alias("customer_id"),
    ]
    if order_key:
        day = F.col("Date").cast("string")
        if date_format is not None:
            day = F.try_to_timestamp(day, F.lit(date_format)).cast("date")
        member = F.col("Member_number")
        key = F.struct(member.try_cast("long").alias("number"), member.cast("string").alias("member"), day.alias("day"))
        columns.append(key.alias("order_key"))
    return df.select(*columns).dropna(subset=["tid", "item"])


def read_member_day_baskets(spark, path: str, encoding: str = "UTF-8", **kw) -> DataFrame:
    """S2 from a CSV file."""
    return parse_member_day(_read_csv(spark, path, encoding), **kw)
