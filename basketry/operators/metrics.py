"""Run metrics from Spark event logs.

The reference polls a history server over HTTP.  Event logs hold the same
numbers, so this reads them with Spark and rolls them up per application (or
per job group) with ordinary aggregates:

* ``run_time_sec``      sum of task executor run time
* ``shuffle_read_mb``   sum of remote + local shuffle bytes read
* ``shuffle_write_mb``  sum of shuffle bytes written
* ``max_executor_mb``   peak JVM heap + off-heap of any executor, falling back
                        to the largest block-manager memory when no peak is
                        logged (local mode reports the driver as executor)
* ``succeeded``         an application-end event exists and no job failed

Logs may be single files or rolled (one ``eventlog_v2_*`` folder per
application), written with ``spark.eventLog.compress=false``.  They are read
as text and parsed with ``from_json`` against the fields used below, so no
schema-inference pass is made.  The driver is no executor: its memory counts only
where it runs the tasks itself, in local mode.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MB = 1024.0 * 1024.0


def _mem() -> T.StructType:
    return T.StructType([T.StructField("JVMHeapMemory", T.LongType()), T.StructField("JVMOffHeapMemory", T.LongType())])


# The event-log fields read here (Spark listener JSON names).
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("Event", T.StringType()),
        T.StructField("App ID", T.StringType()),
        T.StructField("Job ID", T.LongType()),
        T.StructField("Stage IDs", T.ArrayType(T.LongType())),
        T.StructField("Properties", T.StructType([T.StructField("spark.jobGroup.id", T.StringType())])),
        T.StructField("Stage ID", T.LongType()),
        T.StructField(
            "Task Metrics",
            T.StructType(
                [
                    T.StructField("Executor Run Time", T.LongType()),
                    T.StructField(
                        "Shuffle Read Metrics",
                        T.StructType(
                            [
                                T.StructField("Remote Bytes Read", T.LongType()),
                                T.StructField("Local Bytes Read", T.LongType()),
                            ]
                        ),
                    ),
                    T.StructField(
                        "Shuffle Write Metrics",
                        T.StructType([T.StructField("Shuffle Bytes Written", T.LongType())]),
                    ),
                ]
            ),
        ),
        T.StructField("Executor ID", T.StringType()),
        T.StructField("Task Info", T.StructType([T.StructField("Executor ID", T.StringType())])),
        T.StructField("Block Manager ID", T.StructType([T.StructField("Executor ID", T.StringType())])),
        T.StructField("Task Executor Metrics", _mem()),
        T.StructField("Executor Metrics", _mem()),
        T.StructField("Maximum Memory", T.LongType()),
        T.StructField("Job Result", T.StructType([T.StructField("Result", T.StringType())])),
    ]
)

def _has(schema: T.StructType, path: list[str]) -> bool:
    cur = schema
    for name in path:
        if not isinstance(cur, T.StructType) or name not in cur.fieldNames():
            return False
        cur = cur[name].dataType
    return True


def _field(df: DataFrame, *path: str, dtype: str = "double") -> Column:
    if _has(df.schema, list(path)):
        return F.col(".".join(f"`{p}`" for p in path)).cast(dtype)
    return F.lit(None).cast(dtype)


# File name endings of Spark's event-log codecs.
PACKED_NAMES = r"\.(zstd|lz4|lzf|snappy)(\.inprogress)?$"
NOT_PLAIN = "not a plain event log (write it with spark.eventLog.compress=false): "


def packed_logs(spark, path: str) -> DataFrame:
    """``file`` of every log under ``path`` that one of Spark's codecs wrote.

    Readers may see such a file as empty, so its name decides; only names are listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file")).where(F.col("file").rlike(PACKED_NAMES))


def read_event_log(spark, path: str) -> DataFrame:
    """Event-log events (EVENT_SCHEMA columns) with an ``app_key`` per
    application: the file, or the ``eventlog_v2_*`` folder of rolled logs.

    Every file under ``path`` is read, whatever its name; a packed one is a
    ``ValueError`` at once.  ``unreadable`` names the file of a line that is no
    JSON object, whose events are null; ``run_metrics`` makes it an error.
    """
    packed = packed_logs(spark, path).first()
    if packed is not None:
        raise ValueError(NOT_PLAIN + packed.file)
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    bad = F.when(~F.col("value").startswith("{"), F.col("file"))
    ev = raw.select("file", bad.alias("unreadable"), F.from_json("value", EVENT_SCHEMA).alias("e"))
    key = F.regexp_replace(F.col("file"), r"/events_[0-9]+_[^/]*$", "")
    return ev.select("file", "unreadable", "e.*").withColumn("app_key", key)


def _readable(app_id: str = "app_id") -> Column:
    """``app_id``, or an error where the application's log has an unreadable line.

    Stands in the last projection, above every filter: Spark may evaluate an
    error below a filter for rows that the filter would have dropped.
    """
    bad = F.raise_error(F.concat(F.lit(NOT_PLAIN), F.col("unreadable")))
    return F.when(F.col("unreadable").isNotNull(), bad).otherwise(F.col(app_id)).alias("app_id")


def _app_metrics(ev: DataFrame) -> DataFrame:
    """One pass over the events: every figure is a conditional aggregate of
    one ``groupBy(app_key)``."""
    e = F.col("Event")
    task = e == "SparkListenerTaskEnd"
    zero = F.lit(0.0)

    def mem(field):
        return F.coalesce(_field(ev, field, "JVMHeapMemory"), zero) + F.coalesce(
            _field(ev, field, "JVMOffHeapMemory"), zero
        )

    task_peak = F.when(task, mem("Task Executor Metrics"))
    stage_peak = F.when(
        e.isin("SparkListenerStageExecutorMetrics", "SparkListenerExecutorMetricsUpdate"), mem("Executor Metrics")
    )
    limit = F.when(e == "SparkListenerBlockManagerAdded", _field(ev, "Maximum Memory"))
    peak = F.greatest(F.coalesce(task_peak, zero), F.coalesce(stage_peak, zero))
    runner = F.coalesce(
        _field(ev, "Task Info", "Executor ID", dtype="string"),
        _field(ev, "Executor ID", dtype="string"),
        _field(ev, "Block Manager ID", "Executor ID", dtype="string"),
    )
    executor = runner.isNotNull() & (runner != "driver")

    agg = ev.groupBy("app_key").agg(
        F.max("unreadable").alias("unreadable"),
        F.max(F.when(e == "SparkListenerApplicationStart", _field(ev, "App ID", dtype="string"))).alias("app_id"),
        F.sum(F.when(task, _field(ev, "Task Metrics", "Executor Run Time"))).alias("run_ms"),
        F.sum(
            F.when(
                task,
                F.coalesce(_field(ev, "Task Metrics", "Shuffle Read Metrics", "Remote Bytes Read"), zero)
                + F.coalesce(_field(ev, "Task Metrics", "Shuffle Read Metrics", "Local Bytes Read"), zero),
            )
        ).alias("read_b"),
        F.sum(F.when(task, _field(ev, "Task Metrics", "Shuffle Write Metrics", "Shuffle Bytes Written"))).alias(
            "write_b"
        ),
        F.max(F.when(executor, 1).otherwise(0)).alias("executors"),
        F.max(F.when(executor, peak)).alias("executor_peak_b"),
        F.max(peak).alias("any_peak_b"),
        F.max(F.when(executor, limit)).alias("executor_limit_b"),
        F.max(limit).alias("any_limit_b"),
        F.max(F.when(e == "SparkListenerApplicationEnd", 1).otherwise(0)).alias("ended"),
        F.sum(
            F.when(
                (e == "SparkListenerJobEnd") & (_field(ev, "Job Result", "Result", dtype="string") != "JobSucceeded"), 1
            ).otherwise(0)
        ).alias("failed_jobs"),
    )
    own = F.col("executors") == 1
    peak = F.when(own, F.col("executor_peak_b")).otherwise(F.col("any_peak_b"))
    limit = F.when(own, F.col("executor_limit_b")).otherwise(F.col("any_limit_b"))
    peak = F.when(peak > 0, peak).otherwise(limit)
    return agg.where(F.col("app_id").isNotNull() | F.col("unreadable").isNotNull()).select(
        _readable(),
        (F.coalesce(F.col("run_ms"), zero) / 1000.0).alias("run_time_sec"),
        (F.coalesce(F.col("read_b"), zero) / MB).alias("shuffle_read_mb"),
        (F.coalesce(F.col("write_b"), zero) / MB).alias("shuffle_write_mb"),
        (F.coalesce(peak, zero) / MB).alias("max_executor_mb"),
        ((F.col("ended") == 1) & (F.col("failed_jobs") == 0)).alias("succeeded"),
    )


@contextmanager
def tagged(spark, name: str):
    """Tag every Spark job started inside the block with job group ``name``,
    so ``run_metrics(..., by="job_group")`` can report it as one run."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)


def run_metrics(spark, path: str, by: str = "app") -> DataFrame:
    """Run metrics from the event logs under ``path``.

    ``by="app"``: one row per application (RUN_METRICS schema).
    ``by="job_group"``: one row per (application, job group), with a ``run``
    column; tasks are attributed to the job group of the first job that ran
    their stage.
    """
    if by not in ("app", "job_group"):
        raise ValueError('by must be "app" or "job_group"')
    ev = read_event_log(spark, path)
    if by == "app":
        return _app_metrics(ev)
    return _run_metrics_by_group(ev)


def _run_metrics_by_group(ev: DataFrame) -> DataFrame:
    """One row per (application, job group); tasks are attributed to the job
    group of the first job that ran their stage."""
    e = F.col("Event")
    zero = F.lit(0.0)
    jobs = ev.where(e == "SparkListenerJobStart").select(
        "app_key",
        _field(ev, "Job ID", dtype="long").alias("job_id"),
        F.explode(F.col("`Stage IDs`")).alias("stage_id"),
        F.coalesce(_field(ev, "Properties", "spark.jobGroup.id", dtype="string"), F.lit("")).alias("run"),
    )
    stage_run = jobs.groupBy("app_key", "stage_id").agg(F.min_by("run", "job_id").alias("run"))
    job_run = jobs.select("app_key", "job_id", "run").distinct()
    tasks = (
        ev.where(e == "SparkListenerTaskEnd")
        .withColumn("stage_id", _field(ev, "Stage ID", dtype="long"))
        .join(stage_run, ["app_key", "stage_id"], "inner")
        .groupBy("app_key", "run")
        .agg(
            F.sum(_field(ev, "Task Metrics", "Executor Run Time")).alias("run_ms"),
            F.sum(
                F.coalesce(_field(ev, "Task Metrics", "Shuffle Read Metrics", "Remote Bytes Read"), zero)
                + F.coalesce(_field(ev, "Task Metrics", "Shuffle Read Metrics", "Local Bytes Read"), zero)
            ).alias("read_b"),
            F.sum(_field(ev, "Task Metrics", "Shuffle Write Metrics", "Shuffle Bytes Written")).alias("write_b"),
            F.max(
                F.coalesce(_field(ev, "Task Executor Metrics", "JVMHeapMemory"), zero)
                + F.coalesce(_field(ev, "Task Executor Metrics", "JVMOffHeapMemory"), zero)
            ).alias("task_peak_b"),
        )
    )
    per_app = ev.groupBy("app_key").agg(
        F.max("unreadable").alias("unreadable"),
        F.max(F.when(e == "SparkListenerApplicationStart", _field(ev, "App ID", dtype="string"))).alias("app_id"),
        F.max(F.when(e == "SparkListenerApplicationEnd", 1).otherwise(0)).alias("ended"),
    )
    failures = (
        ev.where(e == "SparkListenerJobEnd")
        .select(
            "app_key",
            _field(ev, "Job ID", dtype="long").alias("job_id"),
            (_field(ev, "Job Result", "Result", dtype="string") != "JobSucceeded").alias("failed"),
        )
        .join(job_run, ["app_key", "job_id"], "inner")
        .groupBy("app_key", "run")
        .agg(F.sum(F.col("failed").cast("int")).alias("failed_jobs"))
    )
    out = per_app.join(tasks, "app_key", "left").join(failures, ["app_key", "run"], "left")
    out = out.where(F.col("run").isNotNull() | F.col("unreadable").isNotNull())
    # A run reports only peaks logged for its own tasks (null when none).
    peak = F.when(F.col("task_peak_b") > 0, F.col("task_peak_b"))
    return out.select(
        _readable(),
        "run",
        (F.coalesce(F.col("run_ms"), zero) / 1000.0).alias("run_time_sec"),
        (F.coalesce(F.col("read_b"), zero) / MB).alias("shuffle_read_mb"),
        (F.coalesce(F.col("write_b"), zero) / MB).alias("shuffle_write_mb"),
        (peak / MB).alias("max_executor_mb"),
        ((F.col("ended") == 1) & (F.coalesce(F.col("failed_jobs"), F.lit(0)) == 0)).alias("succeeded"),
    )
