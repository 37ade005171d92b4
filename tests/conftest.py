import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="basketry-tests-")
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("basketry-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.local.dir", os.path.join(scratch, "local"))
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
    )
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # Tests set their own checkpoint folder only when none is configured.
    if s.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        s.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="basketry-t-")


# Worked example (FIXTURES.md §3).
EXAMPLE = [
    ("T1", "A", 2.0, 3.0),
    ("T1", "B", 1.0, 4.0),
    ("T1", "C", 1.0, 10.0),
    ("T2", "A", 1.0, 5.0),
    ("T2", "B", 3.0, 4.0),
    ("T3", "B", 1.0, 4.0),
    ("T3", "C", 2.0, 8.0),
    ("T3", "C", 1.0, 8.0),
    ("T4", "A", 1.0, 4.0),
    ("T4", "POST", 1.0, 16.0),
]


@pytest.fixture()
def example(spark):
    return spark.createDataFrame(EXAMPLE, "tid string, item string, quantity double, unit_price double")
