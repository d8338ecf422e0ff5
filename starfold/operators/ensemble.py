"""Ensemble cotrending: common modes of many stars, their fit and removal.

Light curves stay long (star, cad, f, fmask); modes are wide, one row per cadence with an array
``u`` of components. Iterations exchange per-star coefficients only.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.functions import linalg, stats
from starfold.functions.frames import STRETCH
from starfold.operators.clean import valid
from starfold.operators.detrend import spline_trend
from starfold.session import cut_lineage, release

# Fixed values of the published method.
N_MODES = 8
SIG_OUT = 10.0
MAX_ITER = 10


# ---- fitting modes ----------------------------------------------------------------------------


def _join_modes(lc: DataFrame, modes: DataFrame) -> DataFrame:
    return lc.join(modes.select("cad", "u"), "cad")


def _basis(k: int) -> list[Column]:
    return [F.col("u")[i] for i in range(k)]


def mode_coefficients(lc: DataFrame, modes: DataFrame, k: int, value: str = "f", weight: Column | None = None) -> DataFrame:
    """Least-squares coefficients per star over its unmasked cadences: (star, a array)."""
    x = _join_modes(lc.where(valid() & F.col(value).isNotNull()), modes)
    up, rhs = linalg.normal_sums(_basis(k), F.col(value), weight)
    g = x.groupBy("star").agg(*up, *rhs)
    if k == 1:
        return g.select("star", F.array(stats.safe_div(F.col("_b0"), F.col("_a0_0"))).alias("a"))
    return g.select("star", linalg.solve_normal(*linalg.symmetric(k)).alias("a"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def with_fit(lc: DataFrame, modes: DataFrame, coef: DataFrame, out: str = "fit") -> DataFrame:
    x = lc.join(modes.select("cad", "u"), "cad", "left").join(coef.select("star", "a"), "star", "left")
    return x.withColumn(out, dot(F.col("a"), F.col("u"))).drop("u", "a")


def fit_modes(lc: DataFrame, modes: DataFrame, k: int, value: str = "f") -> tuple[DataFrame, DataFrame]:
    """Coefficients and the light curves with the fitted combination."""
    coef = mode_coefficients(lc, modes, k, value)
    return coef, with_fit(lc, modes, coef)


def fit_modes_l1(
    lc: DataFrame, modes: DataFrame, k: int, rounds: int = 8, eps: float = 1e-6, value: str = "f"
) -> tuple[DataFrame, DataFrame]:
    """Minimise sum |f - fit|/ferr by reweighted least squares."""
    coef = cut_lineage(mode_coefficients(lc, modes, k, value))
    for _ in range(rounds):
        r = with_fit(lc, modes, coef)
        w = F.lit(1.0) / (F.col("ferr") * F.greatest(F.abs(F.col(value) - F.col("fit")), F.lit(eps)))
        coef = cut_lineage(mode_coefficients(r, modes, k, value, w))
    return coef, with_fit(lc, modes, coef)


def detrend_then_fit(lc: DataFrame, modes: DataFrame, k: int, lendt: float) -> tuple[DataFrame, DataFrame]:
    """Detrend flux and modes with the same spline on the star's own mask, then fit."""
    x = _join_modes(lc, modes)
    parts = F.array(F.col("f"), *_basis(k))
    y = x.select("*", F.posexplode(parts).alias("part", "v"))
    y = spline_trend(y, "v", "_tnd", lendt, ("star", "part"), valid())
    y = y.withColumn("_d", F.when(valid(), F.col("v") - F.col("_tnd")))
    wide = y.groupBy("star", "cad").agg(
        F.max(F.when(F.col("part") == 0, F.col("_d"))).alias("fdt"),
        F.array(*[F.max(F.when(F.col("part") == i + 1, F.col("_d"))) for i in range(k)]).alias("u"),
    )
    x = lc.drop("u").join(wide, ["star", "cad"])
    up, rhs = linalg.normal_sums(_basis(k), F.col("fdt"))
    g = x.where(F.col("fdt").isNotNull()).groupBy("star").agg(*up, *rhs)
    coef = g.select("star", linalg.solve_normal(*linalg.symmetric(k)).alias("a"))
    out = x.join(coef, "star").withColumn("fit", dot(F.col("a"), F.col("u"))).drop("a", "u")
    return coef, out


def align(lc: DataFrame) -> DataFrame:
    """All stars on the ensemble's common, gap-free cadence axis; what a star lacks is masked."""
    a, b = lc.agg(F.min("cad"), F.max("cad")).first()
    stars = lc.select("star").distinct()
    first = stars.withColumn("_s", F.explode(F.sequence(F.lit(a // STRETCH), F.lit(b // STRETCH))))
    lo, hi = F.greatest(F.col("_s") * STRETCH, F.lit(a)), F.least((F.col("_s") + 1) * STRETCH - 1, F.lit(b))
    spine = first.select("star", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("cad"))
    x = spine.join(lc, ["star", "cad"], "left")
    return x.withColumn("fmask", F.coalesce("fmask", F.lit(True)))


# ---- training set and statistics --------------------------------------------------------------


def training_set(lc: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Cadences unmasked in some star, masked values as 0, flux over 1.48 x median|f| as ``z``.

    Expects aligned light curves. Fails where a star is masked throughout; with a catalogue (star, ...) also where a star is not in
    it.
    """
    ok = valid()
    if catalogue is not None:
        lc = join_sky(lc, catalogue)
    good = lc.groupBy("cad").agg(F.count_if(ok).alias("_n")).where("_n > 0").select("cad")
    stars = lc.groupBy("star").agg(F.count_if(ok).alias("_k"))
    x = lc.join(good, "cad", "left_semi").join(stars, "star")
    x = x.where(F.assert_true(F.col("_k") > 0, F.lit("a light curve is masked throughout")).isNull()).drop("_k")
    x = x.withColumn("f", F.when(ok, F.col("f")).otherwise(0.0))
    x = stats.with_medians(x, ["star"], {"_mad": F.abs("f")})
    return x.withColumn("z", stats.safe_div(F.col("f"), F.col("_mad") * 1.48)).drop("_mad")


def join_sky(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Attach catalogue columns; duplicates are dropped, a star without entry is an error."""
    cat = catalogue.dropDuplicates(["star"]).withColumn("_in", F.lit(True))
    x = df.join(cat, "star", "left")
    return x.where(F.assert_true(F.coalesce("_in", F.lit(False)), F.lit("star is not in the catalogue")).isNull()).drop("_in")


def explode_coef(coef: DataFrame) -> DataFrame:
    return coef.select("star", F.posexplode("a").alias("k", "a"))


def moments(coef: DataFrame) -> DataFrame:
    """Median, median deviation, mean, max and min per component of (star, k, a)."""
    med = stats.group_medians(coef, ["k"], {"med": F.col("a")})
    mad = stats.group_medians(coef.join(med, "k"), ["k"], {"mad": F.abs(F.col("a") - F.col("med"))})
    g = coef.groupBy("k").agg(F.avg("a").alias("mean"), F.max("a").alias("max"), F.min("a").alias("min"))
    return g.join(med, "k").join(mad, "k")


def coef_stats(coef: DataFrame, nsig: float = 5.0) -> DataFrame:
    """Median, 1.48 x MAD and the limits nsig away, per component."""
    m = moments(coef).select("k", "med", (F.col("mad") * 1.48).alias("sig"))
    return m.withColumns({"outlo": F.col("med") - F.col("sig") * nsig, "outhi": F.col("med") + F.col("sig") * nsig})


def inliers(coef: DataFrame, limits: DataFrame) -> DataFrame:
    """Per star whether every coefficient lies strictly inside its limits."""
    x = coef.join(limits, "k")
    return x.groupBy("star").agg(F.bool_and((F.col("a") > F.col("outlo")) & (F.col("a") < F.col("outhi"))).alias("inlier"))


def calibrate(lc: DataFrame, modes: DataFrame, limits: DataFrame, k: int, value: str = "f") -> DataFrame:
    """Remove the fitted modes where all coefficients are inliers: ``fit``, ``fcal``, ``inlier``."""
    coef, x = fit_modes(lc, modes, k, value)
    x = x.join(inliers(explode_coef(coef), limits), "star", "left")
    fit = F.when(F.col("inlier"), F.col("fit")).otherwise(0.0)
    return x.withColumn("fit", fit).withColumn("fcal", F.col(value) - F.col("fit"))


# ---- decompositions ---------------------------------------------------------------------------


def _gram(df: DataFrame, left: str, right: str) -> np.ndarray:
    """Sum over the rows of the outer products of two array columns: a partial matrix per task, added
    up in Spark; only the sum comes back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                part = np.array(b["l"].tolist()).T @ np.array(b["r"].tolist())
                total = part if total is None else total + part
        if total is not None and total.size:
            yield pd.DataFrame({"at": np.arange(total.size), "columns": total.shape[1], "x": total.ravel()})

    parts = df.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInPandas(run, "at int, columns int, x double")
    rows = parts.groupBy("at", "columns").agg(F.sum("x").alias("x")).orderBy("at").collect()
    return np.array([r["x"] for r in rows]).reshape(-1, rows[0]["columns"] if rows else 0)


def _combine(df: DataFrame, cols: Sequence[str], m: np.ndarray, out: str) -> DataFrame:
    """``out`` is the row of all ``cols`` (arrays, laid end to end) times the matrix ``m``."""
    fields = [f for f in df.schema if f.name != out]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.hstack([np.array(b[c].tolist()).reshape(len(b), -1) for c in cols])
                yield b.assign(**{out: list(x @ m)})[[f.name for f in schema]]

    return df.mapInPandas(run, schema)


def _apply(z: DataFrame, x: DataFrame, by: str, to: str, width: int, value: str) -> DataFrame:
    """The matrix ``z`` (or its transpose) times the columns of ``x`` (by, y array): (to, y array)."""
    v = F.col(value)
    g = z.join(x, by).groupBy(to).agg(*[F.sum(v * F.col("y")[i]).alias(f"_y{i}") for i in range(width)])
    return g.select(to, F.array(*[F.col(f"_y{i}") for i in range(width)]).alias("y"))


def _start(cads: DataFrame, start: DataFrame | None, k: int, width: int) -> DataFrame:
    """(cad, y): the columns to begin with, those of ``start`` and others that look random."""
    noise = [F.xxhash64("cad", F.lit(i)).bitwiseAND((1 << 53) - 1) / float(1 << 53) - 0.5 for i in range(width)]
    if start is None:
        return cads.select("cad", F.array(*noise).alias("y"))
    x = cads.join(start.select("cad", "u"), "cad", "left")
    return x.select("cad", F.array(*[F.coalesce(F.col("u")[i], F.lit(0.0)) for i in range(k)], *noise[k:]).alias("y"))


def svd_modes(
    z: DataFrame, k: int, value: str = "z", start: DataFrame | None = None, extra: int = 4, tol: float = 1e-9, most: int = 96,
) -> tuple[DataFrame, list[float]]:
    """First ``k`` right singular vectors of the star x cadence matrix, as modes (cad, u), and the
    singular values. The sign makes each mode's largest element positive.

    Block Krylov iteration on the long table: a round multiplies a block of k + ``extra`` columns by
    the matrix and its transpose (an aggregate per star and one per cadence) and makes what is new
    orthogonal to the blocks before. Only products of columns, small square matrices, come to the
    driver. It ends when the remainder of every wanted vector is below ``tol`` of the largest value,
    or nothing new is left; after ``most`` columns it starts again from the best ones. Vectors
    of a matrix of lower rank (singular values below 1e-7 of the first), and values, are 0. ``start``:
    modes to begin with, such as those of a matrix alike.
    """
    x = z.where(F.col(value).isNotNull()).select("star", "cad", value)
    cads = cut_lineage(x.select("cad").distinct())
    width, n = k + extra, cads.count()
    used: list[DataFrame] = [cads]

    def orthonormal(new: DataFrame, size: int) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
        """``new`` (cad, q, y) with y made orthogonal to q and of unit columns, twice because the first
        pass leaves rounding: the table (cad, q longer by y, y), the first products q'y, those of what
        was left of y, and the number of new columns."""
        both = _combine(new, ("q", "y"), np.eye(size + width), "b")
        first = _gram(both, "b", "y")
        left = np.vstack([-first[:size], np.eye(width)])
        less = cut_lineage(_combine(new, ("q", "y"), left, "y"))
        used.append(less)
        second = _gram(_combine(less, ("q", "y"), np.eye(size + width), "b"), "b", "y")
        rest = second[size:] - second[:size].T @ second[:size]
        d, u = np.linalg.eigh((rest + rest.T) / 2)
        good = d > max(1e-20 * float(np.trace(first[size:])), 1e-290)
        turn = u[:, good] / np.sqrt(d[good])
        made = _combine(less, ("q", "y"), np.vstack([-second[:size] @ turn, turn]), "y")
        out = made.select("cad", F.concat("q", "y").alias("q"), "y")
        return out, first[:size], rest, int(good.sum())

    empty = F.array().cast("array<double>")
    block, _, _, size = orthonormal(_start(cads, start, k, width).withColumn("q", empty), 0)
    block = cut_lineage(block)
    used.append(block)
    ritz = np.zeros((0, 0))
    width, total = size, size
    while True:
        w = _apply(x, block.select("cad", "y"), "cad", "star", width, value)
        y = _apply(x, w, "star", "cad", width, value)
        zero = F.array(*[F.lit(0.0)] * width)
        new = cut_lineage(block.select("cad", "q").join(y, "cad", "left").select("cad", "q", F.coalesce("y", zero).alias("y")))
        used.append(new)
        following, products, rest, size = orthonormal(new, total)
        grown = np.zeros((total, total))
        grown[: len(ritz), : len(ritz)] = ritz
        grown[:, total - width :] = products
        grown[total - width :, :] = products.T
        ritz = grown
        value2, vector = np.linalg.eigh(ritz)
        value2, vector = value2[::-1], vector[:, ::-1]
        last = vector[total - width :, :k]
        remainder = np.sqrt(np.maximum(np.einsum("ij,il,lj->j", last, rest, last), 0))
        done = size == 0 or total >= n or remainder.max(initial=0) <= tol * max(value2[0], 1e-290)
        if done:
            break
        if total + size > most:
            best = vector[:, : k + extra]
            block, _, _, size = orthonormal(_combine(new, ("q",), best, "y").withColumn("q", empty), 0)
            ritz, total = np.zeros((0, 0)), 0
        else:
            block = following
        block = cut_lineage(block)
        used.append(block)
        width, total = size, total + size
    s = np.sqrt(np.maximum(np.pad(value2[:k], (0, max(0, k - len(value2)))), 0))
    s[s <= 1e-7 * s[0]] = 0
    chosen = np.pad(vector[:, :k], ((0, 0), (0, max(0, k - vector.shape[1])))) * (s > 0)
    modes = cut_lineage(_combine(new.select("cad", "q"), ("q",), chosen, "u").select("cad", "u"))
    top = modes.agg(*[F.max(F.struct(F.abs(F.col("u")[i]).alias("a"), (-F.col("cad")).alias("c"), F.col("u")[i].alias("u"))).alias(f"t{i}") for i in range(k)]).first()
    sign = F.array(*[F.lit(-1.0 if top[i]["u"] < 0 else 1.0) for i in range(k)])
    release(*used)
    return modes.select("cad", F.zip_with("u", sign, lambda a, b: a * b + 0.0).alias("u")), s.tolist()


def projections(z: DataFrame, modes: DataFrame, k: int, value: str = "z") -> DataFrame:
    """Coefficients of every star on orthonormal modes and the mean squared remainder ``x2``."""
    x = _join_modes(z, modes)
    u, v = _basis(k), F.col(value)
    g = x.groupBy("star").agg(
        *[F.sum(v * u[i]).alias(f"_p{i}") for i in range(k)], F.sum(v * v).alias("_vv"), F.count(F.lit(1)).alias("_n")
    )
    rest = F.col("_vv")
    for i in range(k):
        rest = rest - F.col(f"_p{i}") * F.col(f"_p{i}")
    return g.select("star", F.array(*[F.col(f"_p{i}") for i in range(k)]).alias("a"), (rest / F.col("_n")).alias("x2"))


def robust_svd(
    z: DataFrame, k: int = N_MODES, sig_out: float = SIG_OUT, max_iter: int = MAX_ITER,
    x2_limits: tuple[float, float] = (0.5, 3.0), value: str = "z",
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Repeat the decomposition without stars whose remainder or any coefficient is an outlier.

    ``z`` is written once, and each round writes the list of stars it keeps.
    Returns modes, coefficients (star, a, x2) of the stars kept, and singular values.
    """
    z = cut_lineage(z)
    keep = cut_lineage(z.select("star").distinct())
    modes = None
    for it in range(max_iter + 1):
        cur = z.join(keep, "star", "left_semi")
        modes, s = svd_modes(cur, k, value, modes)
        p = cut_lineage(projections(cur, modes, k, value))
        long = explode_coef(p)
        dev = long.join(moments(long).select("k", "med", "mad"), "k").groupBy("star").agg(
            F.max(F.abs(F.col("a") - F.col("med")) - F.col("mad") * sig_out).alias("_over")
        )
        ok = p.join(dev, "star").where(
            (F.col("_over") <= 0) & (F.col("x2") <= x2_limits[1]) & (F.col("x2") >= x2_limits[0])
        )
        good = cut_lineage(ok.select("star"))
        if it == max_iter or good.count() in (p.count(), 0):
            release(z, keep, good)
            return modes, p, s
        release(keep, p)
        keep = good


def _centred(z: DataFrame, value: str) -> DataFrame:
    m = z.groupBy("star").agg(F.avg(value).alias("_m"))
    return z.join(m, "star").withColumn(value, F.col(value) - F.col("_m")).drop("_m")


def robust_components(
    z: DataFrame, k: int = 4, algo: str = "PCA", value: str = "z", nsig: float = 5.0
) -> tuple[DataFrame, DataFrame]:
    """Components over cadences of the star-centred matrix; stars whose weight exceeds ``nsig`` times
    the typical one in any component are dropped and the decomposition repeated until none is left;
    every round but the last drops a star, so it ends.

    Returns modes (cad, u) and weights (star, a) of the stars kept.
    """
    z = cut_lineage(_centred(z, value))
    keep = cut_lineage(z.select("star").distinct())
    found = None
    while True:
        cur = z.join(keep, "star", "left_semi")
        found, s = svd_modes(cur, k, value, found)
        modes, p = found, projections(cur, found, k, value)
        if algo == "PCA":
            scale = F.array(*[F.lit(v) for v in s])
            modes = modes.withColumn("u", F.zip_with("u", scale, lambda a, b: a * b))
            w = p.withColumn("a", F.zip_with("a", scale, lambda a, b: F.coalesce(stats.safe_div(a, b), F.lit(0.0))))
        elif algo == "ICA":
            modes, w = fast_ica(modes, p, k, s)
        else:
            raise ValueError(algo)
        w = cut_lineage(w.select("star", "a"))
        long = explode_coef(w)
        sig = stats.group_medians(long, ["k"], {"_s": F.abs("a")})
        bad = long.join(sig, "k").where(F.abs("a") > F.col("_s") * 1.48 * nsig).select("star").distinct()
        good = cut_lineage(keep.join(bad, "star", "left_anti"))
        if good.count() in (keep.count(), 0):
            release(z, keep, good)
            return modes, w
        release(keep, w)
        keep = good


def fast_ica(modes: DataFrame, p: DataFrame, k: int, s: Sequence[float], rounds: int = 600, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Rotate whitened modes to independent ones (log cosh contrast, all components together).

    A round is one aggregate over the cadences; k x k numbers come back.
    """
    n = modes.count()
    white = cut_lineage(modes.withColumn("u", F.transform("u", lambda v: v * float(np.sqrt(n)))))
    rot = np.linalg.qr(np.random.default_rng(0).normal(size=(k, k)))[0]
    for _ in range(rounds):
        aggs = []
        for i in range(k):
            y = sum((F.col("u")[j] * float(rot[i, j]) for j in range(k)), F.lit(0.0))
            g = F.tanh(y)
            aggs += [F.avg(F.col("u")[j] * g).alias(f"e{i}_{j}") for j in range(k)] + [F.avg(F.lit(1.0) - g * g).alias(f"d{i}")]
        r = white.agg(*aggs).first()
        new = np.array([[r[f"e{i}_{j}"] for j in range(k)] for i in range(k)]) - np.diag([r[f"d{i}"] for i in range(k)]) @ rot
        a, _, b = np.linalg.svd(new)
        new = a @ b
        done = np.max(np.abs(np.abs(np.sum(new * rot, axis=1)) - 1)) < tol
        rot = new
        if done:
            break
    else:
        warnings.warn(f"independent components not converged after {rounds} rounds", stacklevel=2)
    scale = np.diag([v / np.sqrt(n) for v in np.ones(k)])
    mix = scale @ rot.T

    def turn(col: str, m) -> Column:
        return F.array(*[sum((F.col(col)[j] * float(m[j, i]) for j in range(k)), F.lit(0.0)) for i in range(k)])

    return white.select("cad", turn("u", rot.T).alias("u")), p.select("star", turn("a", mix).alias("a"))


def make_modes(lc: DataFrame, k: int = N_MODES, **robust) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Modes of a set of light curves: stars and cadences masked throughout left out, masked values 0,
    flux over its median deviation, robust decomposition; cadences left out come back as 0.

    Returns modes, coefficients and the rescaled fit (star, cad, fit).
    """
    ok = valid()
    cads = lc.groupBy("cad").agg(F.count_if(ok).alias("_n"))
    stars = lc.groupBy("star").agg(F.count_if(ok).alias("_n")).where("_n > 0").select("star")
    x = lc.join(cads.where("_n > 0").select("cad"), "cad", "left_semi").join(stars, "star", "left_semi")
    x = x.withColumn("f", F.when(ok, F.col("f")).otherwise(0.0))
    mad = stats.group_medians(x.where("NOT fmask"), ["star"], {"mad": F.abs("f")})
    z = x.join(mad, "star").withColumn("z", stats.safe_div(F.col("f"), F.col("mad"))).select("star", "cad", "z", "mad")
    modes, p, _ = robust_svd(z, k, **robust)
    full = cads.select("cad").join(modes, "cad", "left")
    full = full.withColumn("u", F.coalesce("u", F.array(*[F.lit(0.0)] * k)))
    fit = lc.select("star", "cad").join(p.select("star", "a"), "star").join(full, "cad").join(mad, "star")
    return full, p, fit.select("star", "cad", (dot(F.col("a"), F.col("u")) * F.col("mad")).alias("fit"))
