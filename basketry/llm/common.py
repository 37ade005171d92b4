"""Helpers shared by the operators: shared folder, written tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the marks of labelled texts, 8 MB, and of one bitmap.
MARKS = 1 << 26
BITMAP = 1 << 15
#: Rows of a table of a few numbers a row that one task writes.
WRITE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a session whose executors run in the driver's
    own process gets a temporary folder; any other session must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="basketry-llm-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation, and row ids
    and ranks made by ``df`` stay fixed for every later reader.  The folder is
    removed by ``discard``, or when the session's file system closes.

    Every task writes a file, for which a local file system starts a process.  ``rows``, about as
    many as ``df`` has, sets the tasks: one for ``WRITE_ROWS`` rows and one a core at least,
    instead of one for each shuffle partition, however many these are.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // WRITE_ROWS)))
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p.getParent())
    back = spark.read.schema(df.schema).parquet(path)
    back._written = p.getParent()
    return back


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path is not None:
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u bigint, v bigint)`` as ``(node, component)``.

    ``component`` is the smallest node of the component; self loops add their
    node.  Large-star and small-star rounds (Kiveris et al. 2014), each written
    to the shared folder, until the edge set no longer changes.  A hub is pre-
    aggregated (``min``) and joined as a written table, so its rows can be split.
    """
    rows = edges.count()  # no round has many more
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    # Edges point from the larger to the smaller node.
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges", rows)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low", rows)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large", rows)
        discard(e, low)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low", rows)
        e = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = written(e.select("x.*").where("u <> v").distinct(), "small", rows)
        discard(large, low)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return nodes.join(e, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))


def row_key(id_col: str, text_col: str):
    """Key of a row by id and text; a struct, so that null ids match too."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))


def rows_of(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``keys(key, ...)`` joined with ``row``, one of the rows of ``docs`` with that key.

    Rows that repeat id and text count once; of those that differ in other columns the one of
    least hash stays, so reruns agree.  One shuffle of the documents.
    """
    known = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    place = F.xxhash64(*[F.col(f"`{c}`") for c in known])
    rows = docs.select(row_key(id_col, text_col).alias("key"), place.alias("place"), F.struct("*").alias("row"))
    return rows.groupBy("key").agg(F.min_by("row", "place").alias("row")).join(keys, "key")


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, bounds: dict[int, int], seed: str, allowed=None, id_col="doc_id", text_col="text") -> tuple[DataFrame, dict[int, int]]:
    """``(place, y, text)``: for each label in ``bounds`` the texts of lowest hash, at most that
    many, and how many different texts carry each label.

    A text counts once, however many rows and ids repeat it; ids that are labelled twice and
    texts of several ids take the greatest label.  Null texts are empty; null ids have no
    label.  The texts are chosen by their hashes in Spark, so what a caller collects is
    bounded in rows whatever share of the rows one id or one text holds.
    """
    rows, texts, counts = _labelled(docs, labels, label_col, list(bounds), seed, allowed, id_col, text_col)
    chosen = [texts.where(F.col("y") == y).orderBy("place").limit(n) for y, n in bounds.items()]
    picks = chosen[0]
    for more in chosen[1:]:
        picks = picks.unionByName(more)
    # The limits bound what is broadcast.
    return rows.drop("id").join(F.broadcast(picks), "place").dropDuplicates(["place"]), counts


def every_labelled_text(docs: DataFrame, labels: DataFrame, label_col: str, values, seed: str, allowed=None, id_col="doc_id", text_col="text") -> tuple[DataFrame, dict[int, int]]:
    """As ``labelled_texts``, but all texts that carry a label of ``values``.

    Rows whose hash no labelled text can have, by a bitmap of fixed size, stay out of the shuffle.
    """
    rows, texts, counts = _labelled(docs, labels, label_col, list(values), seed, allowed, id_col, text_col)
    bit = F.pmod("place", F.lit(MARKS))
    part, at = F.floor(bit / BITMAP).cast("int").alias("_part"), bit % BITMAP
    marks = texts.select(part, at.alias("_at")).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = rows.drop("id").withColumn("_part", part).join(F.broadcast(marks), "_part")  # at most MARKS bits
    rows = rows.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).select("place", "text")
    return rows.join(texts, "place").dropDuplicates(["place"]), counts


def _labelled(docs, labels, label_col, values, seed, allowed, id_col, text_col):
    own = labels if allowed is None else labels.where(allowed)
    own = own.where(F.col(id_col).isNotNull() & F.col(label_col).isin(values)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text, F.lit(seed)).alias("place"))
    texts = rows.select("id", "place").distinct().join(own, "id").groupBy("place").agg(F.max("y").alias("y"))
    texts = written(texts, "labelled")
    counts = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    return rows, texts, counts
