"""Injecting dips, joining results back and summarising recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.functions import models, scalars
from starfold.functions.scalars import CADENCE_DAYS

PARAMS = ("P", "epoch", "phase", "df", "s2n", "tdur")


def inject(lc: DataFrame, params: DataFrame, cadence: float = CADENCE_DAYS) -> DataFrame:
    """Add box dips; every (star, id) of ``params`` gives its own copy of the star's series.

    Exactly one of epoch/phase and one of df (ppm) / s2n must be set. With s2n the depth follows from
    the scatter and the number of points in transit. The duration defaults to the Keplerian one.
    """
    p = params
    for c in PARAMS[1:]:
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast("double"))
    one_of = (F.col("epoch").isNull() != F.col("phase").isNull()) & (F.col("df").isNull() != F.col("s2n").isNull())
    p = p.where(F.assert_true(one_of & F.col("P").isNotNull(), F.lit("give P, epoch xor phase, s2n xor df")).isNull())
    p = p.withColumns(
        {
            "tdur": F.coalesce("tdur", scalars.duration_of_period(F.col("P"))),
            "epoch": F.coalesce("epoch", F.col("phase") * F.col("P")),
        }
    )
    per = lc.groupBy("star").agg(
        F.stddev_pop(F.when(~F.col("fmask"), F.col("f"))).alias("_std"), (F.max("t") - F.min("t")).alias("_tb")
    )
    npts = scalars.points_in_transit(F.col("P"), F.col("tdur"), F.col("_tb"), cadence)
    p = p.join(per, "star").withColumn("depth", F.coalesce(F.col("df") * 1e-6, F.col("s2n") * F.col("_std") / F.sqrt(npts)))
    x = lc.join(p.select("star", "id", "P", "epoch", "tdur", "depth"), "star")
    dip = models.box(F.col("t"), F.col("P"), F.col("epoch"), F.col("depth"), F.col("tdur"), cadence)
    return x.withColumns({"finj": dip, "f": F.col("f") + dip}).select(*lc.columns, "id", "finj")


def inject_single(lc: DataFrame, params: DataFrame, cadence: float = CADENCE_DAYS) -> DataFrame:
    """One plain dip per (star, id): transit number ``num`` starting at P*(phase+num), of depth
    s2n x scatter / sqrt(points in transit). Nothing is added outside the series."""
    per = lc.groupBy("star").agg(
        F.stddev_pop(F.when(~F.col("fmask"), F.col("f"))).alias("_std"), (F.max("t") - F.min("t")).alias("_tb")
    )
    p = params.join(per, "star").withColumn("_d", scalars.duration_of_period(F.col("P")))
    npts = scalars.points_in_transit(F.col("P"), F.col("_d"), F.col("_tb"), cadence)
    p = p.select(
        "star", "id", "_d", (F.col("P") * (F.col("phase") + F.col("num"))).alias("_ti"),
        (F.col("s2n") * F.col("_std") / F.sqrt(npts)).alias("_dep"),
    )
    x = lc.join(p, "star")
    inside = (F.col("t") > F.col("_ti")) & (F.col("t") < F.col("_ti") + F.col("_d"))
    dip = F.when(inside, -F.col("_dep")).otherwise(0.0)
    return x.withColumns({"finj": dip, "f": F.col("f") + dip}).select(*lc.columns, "id", "finj")


def inject_model(lc: DataFrame, params: DataFrame, usamp: int = 11, cadence: float = CADENCE_DAYS) -> DataFrame:
    """Add limb-darkened dips; ``params`` has star, id, P, phase, rp, tau, b, a1..a4."""
    first = lc.groupBy("star").agg(F.min("t").alias("_t1"))
    x = lc.join(params.select("star", "id", "P", "phase", "rp", "tau", "b", "a1", "a2", "a3", "a4").join(first, "star"), "star")
    epoch = F.col("phase") * F.col("P")
    ts = F.col("t") - epoch - F.ceil((F.col("_t1") - epoch) / F.col("P")) * F.col("P")
    tpf = F.pmod(ts + F.col("P") / 2, F.col("P")) - F.col("P") / 2
    dip = models.transit(
        tpf, F.col("rp"), F.col("tau"), F.col("b"), tuple(F.col(f"a{i}") for i in range(1, 5)), usamp, cadence
    )
    return x.withColumns({"finj": dip, "f": F.col("f") + dip}).select(*lc.columns, "id", "finj")


def merge_results(params: DataFrame, results: DataFrame, on: str = "id") -> DataFrame:
    """Every injection with its result, NULL where it failed; shared names get _inp and _out."""
    both = [c for c in params.columns if c in results.columns and c != on]
    a = params.withColumnsRenamed({c: f"{c}_inp" for c in both})
    b = results.withColumnsRenamed({c: f"{c}_out" for c in both})
    return a.join(b, on, "left")


def detection_efficiency(results: DataFrame) -> DataFrame:
    """Found over all by star, period block and depth; error 1/sqrt(n)."""
    return results.groupBy("star", "Pblock", "df").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bg").alias("n_good"),
        (F.count_if("bg") / F.count(F.lit(1))).alias("eta"), (F.lit(1.0) / F.sqrt(F.count(F.lit(1)))).alias("err"),
    )


def s2n_histogram(results: DataFrame) -> DataFrame:
    """Counts in unit bins of s2n from 0, as many as the data need, by depth and success."""
    return results.where("os2n >= 0").groupBy("df", "bg", F.floor("os2n").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
