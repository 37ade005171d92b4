"""The per-dataset workflow, Spark-first: profile, two mining runs, compare.

    python examples/reference_workflow.py KIND PATH OUT_DIR \
        --min-util 500 --min-uo-single 0.075 --min-uo-pair 0.075

KIND is a source kind for ``load_baskets`` (retail, member_day, lines,
utility_lines, or a dataset alias such as online_retail, grocery, kosarak,
chess, mushroom).  Writes Parquet tables under OUT_DIR:

* ``profile``      one row: transactions, entries, items, TU summary
* ``mean_gated``   size-1 and size-2 patterns, mean price, pairs gated by
                   size-1 winners (M1)
* ``actual``       the same with actual prices, ungated (M2) or gated (M3)
* ``comparison``   counts and Jaccard of the two pair sets (C1)
* ``metrics``      per-run executor time and shuffle, when the session writes
                   an event log (``spark.eventLog.enabled``)

Each run is a Spark job group, so one application serves both runs.
Nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketry import (  # noqa: E402
    MineSpec,
    compare,
    load_baskets,
    mine,
    profile,
    run_metrics,
    tagged,
    uo_list,
    write_patterns,
)


def run(spark, kind, path, out, min_util, min_uo_single, min_uo_pair, gated_actual=False, **load_opts):
    lines = load_baskets(spark, kind, path, **load_opts)
    write_patterns(profile(uo_list(lines, MineSpec(0, 0))), os.path.join(out, "profile"))
    specs = {
        "mean_gated": MineSpec(min_util, min_uo_single, min_uo_pair, price="mean", prune="winners"),
        "actual": MineSpec(min_util, min_uo_pair, min_uo_pair, price="actual",
                           prune="winners" if gated_actual else "none"),
    }
    pairs = {}
    for name, spec in specs.items():
        with tagged(spark, name):
            result = mine(lines, spec)
            write_patterns(result.combined(), os.path.join(out, name))
            # Re-read the written table: the comparison then runs on stored
            # results, not on a second evaluation of the run.
            pairs[name] = spark.read.parquet(os.path.join(out, name)).where("size = 2")
            result.release()
    write_patterns(compare(pairs["mean_gated"], pairs["actual"]), os.path.join(out, "comparison"))
    log_dir = spark.conf.get("spark.eventLog.dir", None)
    if spark.conf.get("spark.eventLog.enabled", "false") == "true" and log_dir:
        write_patterns(run_metrics(spark, log_dir, by="job_group"), os.path.join(out, "metrics"))


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("kind")
    ap.add_argument("path")
    ap.add_argument("out")
    ap.add_argument("--min-util", type=float, required=True)
    ap.add_argument("--min-uo-single", type=float, required=True)
    ap.add_argument("--min-uo-pair", type=float, default=None)
    ap.add_argument("--gated-actual", action="store_true")
    args = ap.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("basket-utility-workflow").getOrCreate()
    pair_uo = args.min_uo_single if args.min_uo_pair is None else args.min_uo_pair
    run(spark, args.kind, args.path, args.out, args.min_util, args.min_uo_single, pair_uo, args.gated_actual)


if __name__ == "__main__":
    main()
