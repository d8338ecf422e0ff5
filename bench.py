"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "hist_bin_avg",
    "cadence_fill",
    "quality_mask",
    "mean_depth",
    "ffa",
    "search_ffa",
    "search_clipped",
    "search_bls",
    "bls_spectrum",
    "label_transit",
    "local_detrend",
    "bin_phasefold",
    "autocorr",
    "fit_modes",
    "detrend_spline",
    "inject",
    "occult_small",
]


def bin_average(spark):
    """1,000,000 rows into 100,000 bins."""
    from pyspark.sql import functions as F

    from starfold.operators import validate

    rows = spark.range(1_000_000).select(F.lit("a").alias("star"), F.rand(1).alias("x"), F.randn(2).alias("y"))
    return validate.hist_bin_avg(rows, "x", "y", 0.0, 1.0, 100_000)


def fast_fold(spark):
    """10,000 cadences at all base periods 250 to 2499."""
    from pyspark.sql import functions as F

    from starfold.operators import fold

    rows = spark.range(10_000).select(
        F.lit("a").alias("star"), F.col("id").alias("cad"), F.col("id").cast("double").alias("t"), F.randn(3).alias("f")
    )
    return fold.fold_ffa(fold.with_index(rows), 250, 2500, {"s": F.col("f")}, ["star"])


def main() -> None:
    from starfold.catalog import all_queries
    from starfold.session import get_spark

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    n = int(cpus) if cpus.isdigit() else 8
    spark = get_spark(f"local[{cpus}]", n)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    q, times = all_queries(), {}
    if names[0] == "--baseline":
        for workload in [w for w in (bin_average, fast_fold) if w.__name__ in (names[1:] or w.__name__)]:
            for run in ("first", "warm"):
                t0 = time.perf_counter()
                workload(spark).write.format("noop").mode("overwrite").save()
                times[f"{workload.__name__}_{run}"] = round(time.perf_counter() - t0, 3)
                print(json.dumps(times), file=sys.stderr, flush=True)
        return
    # One small query first, so that the timings leave out the start of the JVM.
    q["hist_bin_avg"](spark, sf).write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.perf_counter()
        q[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
