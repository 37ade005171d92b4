"""Building a run starts no job, and released runs leave nothing cached."""

from pyspark.sql import functions as F

import driver_queries as Q
from basketry import MineSpec, mine, mine_many, remaining_occupancy, sample_first, uo_list
from basketry.operators.clean import exclude_items
from tests.conftest import SF001


def _jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def _cached(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_no_job_while_building(spark):
    lines = Q.lines_l(spark, SF001)
    before = _jobs(spark)
    r = mine(lines, MineSpec(prune="winners", **Q.L_T))
    r.singles, mine(lines, MineSpec(**Q.L_T)).pairs
    assert _jobs(spark) == before
    r.release()


def test_released_runs_leave_nothing_cached(spark):
    spark.catalog.clearCache()
    before = _cached(spark)
    lines, kept = Q.lines_l(spark, SF001), []
    out = mine_many([("a", lines, MineSpec(price="mean", prune="winners", **Q.L_T)), ("b", lines, MineSpec(**Q.L_T))], kept)
    assert out.count() > 0 and len(kept) == 2
    for r in kept:
        r.release()
    mine_many([("a", lines, MineSpec(price="mean", prune="winners", **Q.L_T))]).count()
    sample_first(lines, 3).count()
    exclude_items(lines, lines.select("item").limit(2)).count()
    assert _cached(spark) == before


def test_remaining_occupancy_of_a_long_basket(spark):
    rows = spark.range(40_000).select(F.lit("t").alias("tid"), F.lpad(F.col("id").cast("string"), 6, "0").alias("item"), F.lit(1.0).alias("quantity"), F.lit(2.0).alias("unit_price"))
    got = remaining_occupancy(uo_list(rows, MineSpec(0, 0))).agg(F.sum("ruo"), F.max("ruo"), F.min("ruo")).first()
    assert abs(got[0] - 39_999 / 2) < 1e-3 and abs(got[1] - 39_999 / 40_000) < 1e-9 and got[2] == 0
