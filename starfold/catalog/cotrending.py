"""Queries: trends and ensemble cotrending."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.catalog.base import ENSEMBLE, daily_dense, dense_sql, r6, s6
from starfold.operators import clean, detrend, ensemble
from starfold.sources import fixtures

QUERIES, SQL = {}, {}
C = F.col
DIVISOR = 7_123_457.0


def relative(spark, sf):
    """The ensemble with flux relative to each star's median, gap-free, every 13th cadence masked."""
    e = fixtures.ensemble(spark, sf)
    d = ensemble.align(e).withColumns({"t": C("cad").cast("double"), "quarter": F.lit(0)})
    x = clean.normalize_quarter(d).withColumn("quarter", F.floor(C("cad") / 50).cast("int"))
    return x.withColumn("fmask", C("fmask") | (F.pmod("cad", F.lit(13)) == 5))


_ALIGNED = dense_sql("ensemble", "ed", 1).replace(
    "SELECT star, min(cad) AS a, max(cad) AS b FROM ensemble GROUP BY star",
    "SELECT DISTINCT star, (SELECT min(cad) FROM ensemble) AS a, (SELECT max(cad) FROM ensemble) AS b FROM ensemble",
)
_REL = ENSEMBLE + ",\n" + _ALIGNED + """,
rel AS (SELECT star, cad, t, f / median(f) OVER (PARTITION BY star) - 1 AS f, ferr / median(f) OVER (PARTITION BY star) AS ferr,
        fmask OR cad % 13 = 5 AS fmask FROM ed)"""


def modes_of(lc, k=1):
    """Simple fixed modes over the cadences of the data: powers of scaled time."""
    c = lc.select("cad").distinct()
    return c.select("cad", F.array(*[F.pow(C("cad") / 500.0, F.lit(float(i))) for i in range(k)]).alias("u"))


def fit_one(spark, sf):
    r = relative(spark, sf)
    coef, x = ensemble.fit_modes(r, modes_of(r), 1)
    return x.join(coef, "star").select("star", "cad", r6(C("a")[0]).alias("a"), r6("fit").alias("fit"))


QUERIES["fit_modes_single"] = fit_one
SQL["fit_modes_single"] = f"""WITH {_REL}, c AS (SELECT star, avg(f) AS a FROM rel WHERE NOT fmask GROUP BY star)
SELECT star, cad, {s6('a')} AS a, {s6('a')} AS fit FROM rel JOIN c USING (star)"""


def fit_two(spark, sf):
    r = relative(spark, sf)
    coef, _ = ensemble.fit_modes(r, modes_of(r, 2), 2)
    return coef.select("star", r6(C("a")[0]).alias("a0"), r6(C("a")[1]).alias("a1"))


QUERIES["fit_modes"] = fit_two
SQL["fit_modes"] = f"""WITH {_REL} SELECT star, {s6('regr_intercept(f, cad / 500::DOUBLE)')} AS a0, {s6('regr_slope(f, cad / 500::DOUBLE)')} AS a1 FROM rel WHERE NOT fmask GROUP BY star"""


def fit_l1(spark, sf):
    r = relative(spark, sf)
    coef, _ = ensemble.fit_modes_l1(r, modes_of(r, 2), 2)
    return coef.select("star", r6(C("a")[0], 4).alias("a0"), r6(C("a")[1], 4).alias("a1"))


QUERIES["fit_modes_l1"] = fit_l1


def detrend_fit(spark, sf):
    r = relative(spark, sf)
    m = r.select("cad").distinct().select("cad", F.array(F.sin(C("cad") / 3.0), F.cos(C("cad") / 5.0)).alias("u"))
    coef, _ = ensemble.detrend_then_fit(r, m, 2, 100.0)
    return coef.select("star", r6(C("a")[0]).alias("a0"), r6(C("a")[1]).alias("a1"))


QUERIES["detrend_then_fit"] = detrend_fit


def moments(spark, sf):
    r = relative(spark, sf)
    coef, _ = ensemble.fit_modes(r, modes_of(r, 2), 2)
    m = ensemble.moments(ensemble.explode_coef(coef))
    return m.select("k", *[r6(c).alias(c) for c in ("med", "mad", "mean", "max", "min")])


_COEF = f"""{_REL}, cf AS (SELECT star, regr_intercept(f, cad / 500::DOUBLE) AS a0, regr_slope(f, cad / 500::DOUBLE) AS a1 FROM rel WHERE NOT fmask GROUP BY star),
co AS (SELECT star, 0 AS k, a0 AS a FROM cf UNION ALL SELECT star, 1, a1 FROM cf),
md AS (SELECT *, median(a) OVER (PARTITION BY k) AS med FROM co)"""
QUERIES["moments"] = moments
SQL["moments"] = f"""WITH {_COEF} SELECT k, {s6('any_value(med)')} AS med, {s6('median(abs(a - med))')} AS mad, {s6('avg(a)')} AS mean, {s6('max(a)')} AS max, {s6('min(a)')} AS min FROM md GROUP BY k"""


def training(spark, sf):
    cat = fixtures.read(spark, sf, "nation").select(F.lpad(C("n_nationkey").cast("string"), 2, "0").alias("star"), "n_regionkey")
    t = ensemble.training_set(relative(spark, sf), cat)
    return t.select("star", "cad", "n_regionkey", r6("z").alias("z"))


QUERIES["training_set"] = training
SQL["training_set"] = f"""WITH {_REL}, g AS (SELECT cad FROM rel GROUP BY cad HAVING count(*) FILTER (NOT fmask) > 0),
z AS (SELECT star, cad, CASE WHEN NOT fmask THEN f ELSE 0 END AS f FROM rel WHERE cad IN (SELECT cad FROM g))
SELECT star, cad, n_regionkey, {s6('f / (median(abs(f)) OVER (PARTITION BY star) * 1.48::DOUBLE)')} AS z FROM z JOIN nation ON lpad(CAST(n_nationkey AS VARCHAR), 2, '0') = star"""


def coef_stats(spark, sf):
    r = relative(spark, sf)
    coef, _ = ensemble.fit_modes(r, modes_of(r, 2), 2)
    long = ensemble.explode_coef(coef)
    st = ensemble.coef_stats(long, 1.0)
    i = ensemble.inliers(long, st)
    return long.join(st, "k").join(i, "star").select(
        "star", "k", r6("a").alias("a"), r6("outlo").alias("outlo"), r6("outhi").alias("outhi"), "inlier"
    )


QUERIES["coef_stats"] = coef_stats
SQL["coef_stats"] = f"""WITH {_COEF}, s AS (SELECT *, median(abs(a - med)) OVER (PARTITION BY k) * 1.48::DOUBLE AS sig FROM md)
SELECT star, k, {s6('a')} AS a, {s6('med - sig')} AS outlo, {s6('med + sig')} AS outhi, bool_and(a > med - sig AND a < med + sig) OVER (PARTITION BY star) AS inlier FROM s"""


def calibrated(spark, sf):
    r = relative(spark, sf)
    m = modes_of(r, 2)
    coef, _ = ensemble.fit_modes(r, m, 2)
    st = ensemble.coef_stats(ensemble.explode_coef(coef), 1.0)
    x = ensemble.calibrate(r, m, st, 2)
    return clean.mask_outliers(x.withColumn("f", C("fcal")), (-1000.0, 5.0), "linear", "cr").withColumn("fmask", C("fmask") | C("cr"))


QUERIES["calibrate"] = lambda spark, sf: calibrated(spark, sf).select(
    "star", "cad", "inlier", "fmask", r6("fit").alias("fit"), r6("fcal").alias("fcal")
)
from starfold.catalog.cleaning import outlier_sql  # noqa: E402

SQL["calibrate"] = f"""WITH {_COEF}, s AS (SELECT *, median(abs(a - med)) OVER (PARTITION BY k) * 1.48::DOUBLE AS sig FROM md),
i AS (SELECT star, bool_and(a > med - sig AND a < med + sig) AS inlier FROM s GROUP BY star),
x AS (SELECT star, cad, rel.fmask, inlier, CASE WHEN inlier THEN a0 + a1 * (cad / 500::DOUBLE) ELSE 0 END AS fit, rel.f - CASE WHEN inlier THEN a0 + a1 * (cad / 500::DOUBLE) ELSE 0 END AS f
   FROM rel JOIN cf USING (star) JOIN i USING (star)), {outlier_sql('x', 'o', (-1000.0, 5.0), 'linear')}
SELECT star, cad, inlier, fmask OR is_outlier AS fmask, {s6('fit')} AS fit, {s6('f')} AS fcal FROM o"""


def sky(spark, sf):
    coef = fixtures.ensemble(spark, sf).groupBy("star").agg(F.sum("f").alias("a"))
    cat = fixtures.read(spark, sf, "nation").select(F.lpad(C("n_nationkey").cast("string"), 2, "0").alias("star"), "n_name", "n_regionkey")
    return ensemble.join_sky(coef, cat.unionByName(cat))


QUERIES["join_sky"] = sky
SQL["join_sky"] = f"""WITH {ENSEMBLE} SELECT e.star, a, n_name, n_regionkey FROM (SELECT star, sum(f) AS a FROM ensemble GROUP BY star) e JOIN nation ON lpad(CAST(n_nationkey AS VARCHAR), 2, '0') = e.star"""

QUERIES["scatter_summary"] = lambda spark, sf: detrend.running_mean_scatter(relative(spark, sf)).select("k", r6("rms").alias("rms"))
SQL["scatter_summary"] = f"""WITH {_REL}, m AS ({' UNION ALL '.join(f"SELECT star, {k} AS k, CASE WHEN count(*) OVER w = {k} THEN avg(CASE WHEN NOT fmask THEN f END) OVER w END AS m FROM rel WINDOW w AS (PARTITION BY star ORDER BY cad ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)" for k in (1, 6, 12))}),
s AS (SELECT star, k, stddev_pop(m) AS rms FROM m GROUP BY star, k)
SELECT k, {s6('median(rms)')} AS rms FROM s GROUP BY k"""


def gp(spark, sf):
    d = clean.normalize_quarter(clean.cadence_fill(fixtures.daily(spark, sf), 1, unique=True).withColumn("quarter", F.floor(C("cad") / 250).cast("int")))
    return detrend.detrend_gp(d).select("star", "cad", r6("ftnd").alias("ftnd"), r6("fdt").alias("fdt"))


QUERIES["detrend_gp"] = gp


def spline(spark, sf):
    d = daily_dense(spark, sf).withColumn("f", C("f") / DIVISOR)
    d = d.withColumn("fmask", C("fmask") | (F.pmod("cad", F.lit(400)) < 30))
    return detrend.detrend_spline(d, 20, 40.0).select("star", "cad", r6("ftnd").alias("ftnd"), r6("fdt").alias("fdt"))


QUERIES["detrend_spline"] = spline


def robust_svd(spark, sf):
    t = ensemble.training_set(relative(spark, sf))
    _, p, s = ensemble.robust_svd(t.select("star", "cad", "z"), 3)
    return p.select("star", r6("x2").alias("x2"), *[r6(C("a")[i]).alias(f"a{i}") for i in range(3)])


QUERIES["robust_svd"] = robust_svd


def robust(algo):
    def run(spark, sf):
        t = ensemble.training_set(relative(spark, sf))
        _, w = ensemble.robust_components(t.select("star", "cad", "z"), 3, algo)
        return w.select("star", *[r6(C("a")[i]).alias(f"a{i}") for i in range(3)])

    return run


QUERIES["robust_pca"] = robust("PCA")
QUERIES["robust_ica"] = robust("ICA")


def make_modes(spark, sf):
    _, p, fit = ensemble.make_modes(relative(spark, sf), 3)
    return fit.groupBy("star").agg(F.count(F.lit(1)).alias("n"), r6(F.stddev_pop("fit")).alias("sd")).join(p.select("star", r6("x2").alias("x2")), "star")


QUERIES["make_modes"] = make_modes
