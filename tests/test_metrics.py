"""E1 on an event log written by a separate, finished Spark application."""

import json
import os
import subprocess
import sys
import textwrap

import pytest

from basketry import run_metrics
from tests.conftest import ROOT

APP = textwrap.dedent(
    """
    import sys
    sys.path.insert(0, {root!r})
    from pyspark.sql import SparkSession
    from basketry import MineSpec, mine
    import driver_queries as Q
    spark = (SparkSession.builder.master("local[2]").appName("metrics-app")
             .config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", {logdir!r})
             .config("spark.eventLog.compress", "false")
             .config("spark.eventLog.rolling.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4")
             .getOrCreate())
    from basketry.operators.metrics import tagged
    with tagged(spark, "mean_gated"):
        r = mine(Q.lines_l(spark, "/root/testdata/sf0.001"), MineSpec(price="mean", prune="winners", **Q.L_T))
        r.singles.count()
        r.pairs.count()
    with tagged(spark, "actual_ungated"):
        r = mine(Q.lines_l(spark, "/root/testdata/sf0.001"), MineSpec(**Q.L_T))
        r.singles.count()
        r.pairs.count()
    spark.stop()
    """
)


def test_run_metrics_from_event_log(spark, tmp_dir):
    logdir = os.path.join(tmp_dir, "events")
    os.makedirs(logdir)
    script = os.path.join(tmp_dir, "app.py")
    with open(script, "w") as f:
        f.write(APP.format(root=ROOT, logdir="file://" + logdir))
    subprocess.run([sys.executable, script], check=True, timeout=600, capture_output=True)
    rows = run_metrics(spark, logdir).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.app_id.startswith("local-")
    assert r.run_time_sec > 0
    assert r.shuffle_read_mb > 0 and r.shuffle_write_mb > 0
    assert r.max_executor_mb > 0
    assert r.succeeded is True


def test_run_metrics_by_job_group(spark, tmp_dir):
    logdir = os.path.join(tmp_dir, "events")
    os.makedirs(logdir)
    script = os.path.join(tmp_dir, "app.py")
    with open(script, "w") as f:
        f.write(APP.format(root=ROOT, logdir="file://" + logdir))
    subprocess.run([sys.executable, script], check=True, timeout=600, capture_output=True)
    rows = {r.run: r for r in run_metrics(spark, logdir, by="job_group").collect()}
    assert {"mean_gated", "actual_ungated"} <= set(rows)
    for name in ("mean_gated", "actual_ungated"):
        r = rows[name]
        assert r.run_time_sec > 0 and r.shuffle_write_mb > 0 and r.succeeded is True
    whole = run_metrics(spark, logdir).first()
    assert whole.run_time_sec >= rows["mean_gated"].run_time_sec + rows["actual_ungated"].run_time_sec - 1e-6


def test_run_metrics_reads_rolled_logs(spark, tmp_dir):
    logdir = os.path.join(tmp_dir, "events")
    os.makedirs(logdir)
    script = os.path.join(tmp_dir, "app.py")
    app = APP.replace('.config("spark.eventLog.rolling.enabled", "false")',
                      '.config("spark.eventLog.rolling.enabled", "true")')
    assert app != APP
    with open(script, "w") as f:
        f.write(app.format(root=ROOT, logdir="file://" + logdir))
    subprocess.run([sys.executable, script], check=True, timeout=600, capture_output=True)
    assert any(n.startswith("eventlog_v2_") for n in os.listdir(logdir))
    rows = run_metrics(spark, logdir).collect()
    assert len(rows) == 1 and rows[0].run_time_sec > 0 and rows[0].succeeded is True


def _log(path, app, *events):
    with open(path, "w") as f:
        for e in ({"Event": "SparkListenerApplicationStart", "App ID": app}, *events, {"Event": "SparkListenerApplicationEnd"}):
            f.write(json.dumps(e) + "\n")


def _peak(executor, mb):
    return {"Event": "SparkListenerStageExecutorMetrics", "Executor ID": executor,
            "Executor Metrics": {"JVMHeapMemory": mb << 20, "JVMOffHeapMemory": 0}}


def test_driver_memory_is_not_an_executors(spark, tmp_dir):
    added = {"Event": "SparkListenerBlockManagerAdded", "Maximum Memory": 9000 << 20, "Block Manager ID": {"Executor ID": "driver"}}
    _log(os.path.join(tmp_dir, "app-1"), "app-1", _peak("driver", 4000), _peak("0", 700), added)
    _log(os.path.join(tmp_dir, "app-2"), "app-2", {**added, "Maximum Memory": 500 << 20, "Block Manager ID": {"Executor ID": "1"}}, added)
    _log(os.path.join(tmp_dir, "local-3"), "local-3", _peak("driver", 4000))
    got = {r.app_id: r.max_executor_mb for r in run_metrics(spark, tmp_dir).collect()}
    assert got == {"app-1": 700, "app-2": 500, "local-3": 4000}


def test_every_file_name_is_read(spark, tmp_dir):
    for name in ("spark-00ac", "spark-00ad", "x.zstd.d"):
        _log(os.path.join(tmp_dir, name), name)
    assert {r.app_id for r in run_metrics(spark, tmp_dir).collect()} == {"spark-00ac", "spark-00ad", "x.zstd.d"}


@pytest.mark.parametrize("codec", ["lz4", "zstd", "snappy"])
def test_unreadable_log_is_an_error(spark, tmp_dir, codec):
    _log(os.path.join(tmp_dir, "plain"), "plain")
    with open(os.path.join(tmp_dir, f"app.{codec}"), "wb") as f:
        f.write(b"LZ4Block\x16\x00\x01 binary \xff\xfe")
    for by in ("app", "job_group"):
        with pytest.raises(Exception, match="not a plain event log|FAILED_READ_FILE"):
            run_metrics(spark, tmp_dir, by=by).collect()


def _task(stage, ms, written):
    return {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task Info": {"Executor ID": "1"},
            "Task Metrics": {"Executor Run Time": ms, "Shuffle Write Metrics": {"Shuffle Bytes Written": written}}}


def _job(job, stages, group):
    return {"Event": "SparkListenerJobStart", "Job ID": job, "Stage IDs": stages, "Properties": {"spark.jobGroup.id": group}}


def _end(job, result="JobSucceeded"):
    return {"Event": "SparkListenerJobEnd", "Job ID": job, "Job Result": {"Result": result}}


def test_hand_made_log_in_both_forms(spark, tmp_dir):
    _log(os.path.join(tmp_dir, "app-1"), "app-1",
         _job(0, [0, 1], "mine"), _task(0, 1500, 2 << 20), _task(1, 500, 0), _end(0),
         _job(1, [1, 2], "other"), _task(2, 250, 1 << 20), _end(1, "JobFailed"))
    with open(os.path.join(tmp_dir, "app-1"), "a") as f:
        f.write("\n  \n")  # blank lines are no events and no error
    (app,) = run_metrics(spark, tmp_dir).collect()
    assert (app.app_id, app.run_time_sec, app.shuffle_write_mb, app.succeeded) == ("app-1", 2.25, 3.0, False)
    runs = {r.run: r for r in run_metrics(spark, tmp_dir, by="job_group").collect()}
    assert {n: (r.run_time_sec, r.shuffle_write_mb, r.succeeded) for n, r in runs.items()} == {
        "mine": (2.0, 2.0, True), "other": (0.25, 1.0, False)}


@pytest.mark.parametrize("by", ["app", "job_group"])
def test_line_that_is_no_event_is_an_error(spark, tmp_dir, by):
    _log(os.path.join(tmp_dir, "app-1"), "app-1", _job(0, [0], "mine"), _task(0, 1, 1))
    with open(os.path.join(tmp_dir, "other"), "w") as f:
        f.write("no event\n")
    with pytest.raises(Exception, match="not a plain event log.*other"):
        run_metrics(spark, tmp_dir, by=by).collect()
