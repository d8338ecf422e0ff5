"""Smooth trends: Gaussian-process mean and cubic least-squares spline."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import linalg, stats
from starfold.operators.clean import mean_of_valid, segment_labels, valid

# A Gaussian is below 1e-16 beyond this many correlation lengths.
GP_REACH = 8.6
GP_NOISE = 0.005


def detrend_gp(df: DataFrame, corrlen: float = 5.0, keys: Sequence[str] = ("star", "quarter"), nbin: int = 8) -> DataFrame:
    """Adds ``ftnd`` (posterior mean of a squared-exponential process) and ``fdt`` = f - ftnd.

    Trained per quarter on means of ``nbin`` valid points: a quarter bounds the dense solve, which is
    the only step in Python. The mean is evaluated natively from the weights near each time bucket.
    """
    k = list(keys)
    span = df.groupBy(*k).agg(F.min("cad").alias("_a"))
    v = df.where(valid()).join(span, k)
    one = F.concat_ws("|", *[F.col(c).cast("string") for c in k])
    bins = mean_of_valid(v.withColumn("_star", F.col("star")).withColumn("star", one), nbin)
    names = v.select(*k).distinct().withColumn("_g", one)
    bins = bins.withColumnRenamed("star", "_g").join(names, "_g").select(*k, "x", "y")

    def weights(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        kern = np.exp(-0.5 * (x[:, None] - x[None, :]) ** 2 / corrlen**2)
        return pdf[k].assign(x=x, alpha=np.linalg.solve(kern + GP_NOISE * np.eye(len(x)), y))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in k)
    alpha = bins.groupBy(*k).applyInPandas(weights, f"{schema}, x double, alpha double")
    width = corrlen
    reach = math.ceil(GP_REACH * corrlen / width)
    own = F.floor(F.col("x") / width)
    near = alpha.withColumn("_b", F.explode(F.sequence(own - reach, own + reach)))
    near = near.groupBy(*k, "_b").agg(F.collect_list(F.struct("x", "alpha")).alias("_w"))
    t = F.col("t")
    mean = F.aggregate(
        "_w", F.lit(0.0), lambda s, r: s + r["alpha"] * F.exp((t - r["x"]) * (t - r["x"]) * (-0.5 / corrlen**2))
    )
    x = df.withColumn("_b", F.floor(t / width)).join(near, [*k, "_b"], "left")
    x = x.withColumn("ftnd", F.when(F.col("_w").isNotNull(), mean))
    return x.withColumn("fdt", F.col("f") - F.col("ftnd")).drop("_w", "_b")


def _cell_basis(x: Column) -> list[Column]:
    """The four cubic B-spline pieces of a cell at local position x in [0, 1]."""
    x2, x3 = x * x, x * x * x
    r = F.lit(1.0) - x
    return [r * r * r / 6, (x3 * 3 - x2 * 6 + 4) / 6, (x3 * -3 + x2 * 3 + x * 3 + 1) / 6, x3 / 6]


def spline_trend(
    df: DataFrame, value: str = "f", out: str = "ftnd", lendt: float = 10.0, keys: Sequence[str] = ("star", "segment"),
    ok: Column | None = None,
) -> DataFrame:
    """Least-squares cubic spline with floor(base/lendt)+1 even knots per group, ends left out.

    Any basis on the same knots gives the same curve. Uniform B-splines touch four coefficients per
    point, so the normal equations are plain sums per knot cell; the solve along their band is per group, its memory four numbers a
    knot.
    """
    k = list(keys)
    good = F.col(value).isNotNull() if ok is None else ok
    g = df.where(good).groupBy(*k).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    cells = F.greatest(F.floor((F.col("_t1") - F.col("_t0")) / lendt), F.lit(1)).cast("int")
    g = g.withColumn("_m", cells)
    x = df.join(g, k, "left")
    u = stats.safe_div((F.col("t") - F.col("_t0")) * F.col("_m"), F.col("_t1") - F.col("_t0"))
    x = x.withColumn("_u", F.coalesce(u, F.lit(0.0)))
    x = x.withColumn("_cell", F.least(F.greatest(F.floor("_u"), F.lit(0)), F.col("_m") - 1).cast("int"))
    x = x.withColumn("_x", F.col("_u") - F.col("_cell"))
    basis = _cell_basis(F.col("_x"))
    up, rhs = linalg.normal_sums(basis, F.col(value))
    sums = x.where(good).groupBy(*k, "_m", "_cell").agg(*up, *rhs)
    names = [f"_a{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"_b{i}" for i in range(4)]

    solve_band = linalg.band_solver()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf["_m"].iloc[0])
        band, b, c = np.zeros((m + 3, 4)), np.zeros(m + 3), pdf["_cell"].to_numpy()
        for i in range(4):
            b[c + i] += pdf[f"_b{i}"].to_numpy()
            for j in range(i, 4):
                band[c + i, j - i] += pdf[f"_a{i}_{j}"].to_numpy()
        coef = solve_band(band, b)
        head = {c: [pdf[c].iloc[0]] * m for c in k}
        return pd.DataFrame({**head, "_cell": range(m), **{f"_k{i}": coef[i : i + m] for i in range(4)}})

    kt = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kt[c]}" for c in k) + ", _cell int, " + ", ".join(f"_k{i} double" for i in range(4))
    coefs = sums.select(*k, "_m", "_cell", *names).groupBy(*k).applyInPandas(solve, schema)
    y = x.join(coefs, [*k, "_cell"], "left")
    trend = basis[0] * F.col("_k0")
    for i in range(1, 4):
        trend = trend + basis[i] * F.col(f"_k{i}")
    return y.withColumn(out, F.when(good, trend)).select(*[c for c in df.columns if c != out], out)


def detrend_spline(df: DataFrame, nsep: float, lendt: float = 10.0) -> DataFrame:
    """Spline trend per island of valid data: ``ftnd`` and ``fdt``; NULL under the mask."""
    x = segment_labels(df, nsep)
    x = spline_trend(x, "f", "ftnd", lendt, ok=valid() & F.col("segment").isNotNull())
    return x.withColumn("fdt", F.when(valid(), F.col("f") - F.col("ftnd")))


def running_mean_scatter(df: DataFrame, widths: Sequence[int] = (1, 6, 12), value: str = "f") -> DataFrame:
    """Standard deviation of the k-cadence running mean per star, median over stars, per k."""
    from starfold.functions.frames import with_frames

    def make(w):
        out = {}
        for n in widths:
            fr = w.rangeBetween(0, n - 1)
            full = F.count(F.lit(1)).over(fr) == n
            out[f"_m{n}"] = F.when(full, F.avg(F.when(valid(), F.col(value))).over(fr))
        return out

    x = with_frames(df, 0, max(widths), make)
    per = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"_m{n}").alias("m")) for n in widths]))
    s = x.select("star", per.alias("_e")).groupBy("star", F.col("_e.k").alias("k")).agg(F.stddev_pop("_e.m").alias("rms"))
    return stats.group_medians(s, ["k"], {"rms": F.col("rms")})
