"""Queries: whole stages and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.catalog.base import DAILY_INJECTED, INJECTED_DEPTH, daily_dense, daily_injected, hourly_dense, r6, s6
from starfold.catalog.cotrending import modes_of, relative
from starfold.catalog.searching import D1, D2, DTW, clipped_limits_sql, clipped_sql, peak_sql
from starfold.catalog.validation import detrend_sql, label_sql, phase_sql, pmod_sql
from starfold.operators import clean, ensemble, fit, search, validate
from starfold.plans import stages
from starfold.session import cut_lineage
from starfold.sources import fixtures

QUERIES, SQL = {}, {}
C = F.col

def peaks(spark, sf, lc=None):
    """What the search finds in the injected series: the start of everything that follows a search."""
    p = search.peak(search.search_clipped(small(spark, sf) if lc is None else lc, D1, D2, DTW))
    return cut_lineage(p.select("star", C("grid_P").alias("P"), C("grid_t0").alias("t0"), C("grid_tdur").alias("tdur"), C("grid_mean").alias("mean")))


def small(spark, sf):
    """The injected series scaled to a dip of one percent."""
    return daily_injected(spark, sf).withColumn("f", C("f") / (INJECTED_DEPTH * 100))


def injected(spark, sf):
    """The injected series, and what the search finds in it."""
    d = cut_lineage(daily_injected(spark, sf).select("star", "cad", "t", "f", "fmask"))
    return d, peaks(spark, sf, d)


_FOUND = f"{DAILY_INJECTED}, {clipped_sql(None, 'di', 'pg', D1, D2, DTW)}, {peak_sql('pg', 'cand')}"
_NEAR = """lim AS (SELECT star, 0 AS seg, P / dt - 1 AS p1, P / dt + 1 AS p2, [greatest(round_even(tdur / dt, 0), 1)::INT] AS twdg
   FROM cand JOIN (SELECT star, (max(t) - min(t)) / (max(cad) - min(cad)) AS dt FROM di GROUP BY star) USING (star))"""


def grid_search(spark, sf):
    pg, peak = stages.grid_search(clean.preprocess(hourly_dense(spark, sf)))
    n = pg.groupBy("star").agg(F.count(F.lit(1)).alias("rows"))
    return peak.join(n, "star").select("star", "rows", r6("grid_P").alias("grid_P"), r6("grid_s2n").alias("grid_s2n"), r6("grid_t0").alias("grid_t0"), r6("grid_tdur").alias("grid_tdur"))


# Its parts have SQL (segments, clipped search, binning, peak); the whole grid at once is more than DuckDB's
# aggregate holds in memory.
QUERIES["grid_search"] = grid_search


def two_signals(spark, sf):
    """The scaled injected series with a second, shallower dip every 41 days."""
    d = small(spark, sf).select("star", "cad", "t", "f", "fmask")
    dip = F.when(F.pmod(C("cad") - 5, F.lit(41)) < 2, 0.009).otherwise(0.0)
    return d.withColumn("f", F.when(~C("fmask"), C("f") - dip).otherwise(0.0))


PAIR = [{"Pcad1": 25, "Pcad2": 29, "twdG": [2, 3]}, {"Pcad1": 39, "Pcad2": 43, "twdG": [2, 3]}]


def multi_search(spark, sf):
    once = lambda lc: search.peak(search.periodogram(stages.centre(lc), PAIR))
    fit_once = lambda lc, peaks: stages.fit_and_validate(lc, peaks, 2, MODEL)
    c = stages.multi_search(two_signals(spark, sf), once, 8.0, 5, fit_once)
    return c.select("star", "candidate", *[r6(x).alias(x) for x in ("s2n", "P", "t0", "tdur", "rp", "rchisq", "num_trans", "clip_snr")])


QUERIES["multi_search"] = multi_search


def secondary(spark, sf):
    d, p = injected(spark, sf)
    return stages.secondary_eclipse_search(d, p).select("star", *[r6(c).alias(c) for c in ("se_s2n", "se_t0", "se_phase")])


QUERIES["secondary_eclipse_search"] = secondary
SQL["secondary_eclipse_search"] = f"""WITH {_FOUND}, {phase_sql('di', 'ph', -0.5)},
sm AS (SELECT star, cad, t, fmask OR abs(tpf / P) < 0.1 AS fmask, CASE WHEN NOT (fmask OR abs(tpf / P) < 0.1) THEN f ELSE 0 END AS f FROM ph),
{_NEAR}, {clipped_limits_sql('sm', 'se', 'lim', DTW)}, {peak_sql('se', 'pk')}
SELECT c.star, {s6('coalesce(k.s2n, 0)')} AS se_s2n, {s6('k.t0')} AS se_t0, {s6('(k.t0 - c.t0) / c.P')} AS se_phase FROM cand c LEFT JOIN pk k ON k.star = c.star"""


def cut(spark, sf):
    d, p = injected(spark, sf)
    return stages.cut_search(d, p, 3).select("star", r6("s2ncut").alias("s2ncut"), r6("s2ncut_t0").alias("s2ncut_t0"))


_CUT = f"""{_FOUND}, {label_sql('di', 'lb', 0.5, 3.0)},
gm AS (SELECT *, max(transit) OVER (PARTITION BY star ORDER BY cad ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS cut FROM lb),
cm AS (SELECT star, cad, t, fmask OR cut > 0 AS fmask, CASE WHEN NOT (fmask OR cut > 0) THEN f ELSE 0 END AS f FROM gm),
{_NEAR}, {clipped_limits_sql('cm', 'cs', 'lim', DTW)}, {peak_sql('cs', 'ct')}"""
QUERIES["cut_search"] = cut
SQL["cut_search"] = f"""WITH {_CUT}
SELECT c.star, {s6('coalesce(k.s2n, 0)')} AS s2ncut, {s6('k.t0')} AS s2ncut_t0 FROM cand c LEFT JOIN ct k ON k.star = c.star"""


def secondary_fold(spark, sf):
    """Every star: one whose cut search left nothing keeps its row, without points."""
    d, p = injected(spark, sf)
    curve, off = stages.secondary_fold(d, p, cut_lineage(stages.cut_search(d, p, 3)), cadence=1.0)
    n = curve.groupBy("star").agg(F.count(F.lit(1)).alias("n"), F.min("tPF").alias("first"))
    x = off.join(n, "star", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.select("star", "n", r6("first").alias("first"), r6("t0shft_se").alias("t0shft_se"), r6("ph_se").alias("ph_se"))


QUERIES["secondary_fold"] = secondary_fold
SQL["secondary_fold"] = f"""WITH {_CUT}, seen AS (SELECT c.star, c.P, k.t0, c.tdur FROM cand c JOIN ct k ON k.star = c.star),
{detrend_sql('di', 'dt', 1.0, 3.0, 4).replace('JOIN cand ON cand.star', 'JOIN seen ON seen.star')},
sf AS (SELECT star, count(*) AS n, min({pmod_sql('t - t0 + P / 2', 'P')} - P / 2 + 1) AS first FROM dt WHERE f IS NOT NULL GROUP BY star)
SELECT c.star, coalesce(n, 0) AS n, {s6('first')} AS first, {s6('c.t0 - k.t0')} AS t0shft_se, {s6('(c.t0 - k.t0) / c.P * 360')} AS ph_se
FROM cand c LEFT JOIN ct k ON k.star = c.star LEFT JOIN sf ON sf.star = c.star"""

MODEL = fit.ephemeris_model(4, 1.0)


def _fits(spark, sf, rounds=2):
    return fit.fit_constant_ephemeris(small(spark, sf), peaks(spark, sf), rounds, MODEL)


def constant_ephemeris(spark, sf):
    f, _ = _fits(spark, sf, 3)
    return f.select("star", *[r6(c).alias(c) for c in ("P", "uP", "t0", "ut0", "rp", "urp", "tdur", "utdur", "b", "ub", "rchisq")])


QUERIES["fit_constant_ephemeris"] = constant_ephemeris


def each_transit(spark, sf):
    f, dt = _fits(spark, sf)
    return fit.fit_each_transit(dt, f, 2, MODEL).select("star", "transit_id", *[r6(c).alias(c) for c in ("t0", "ut0", "rp", "urp", "omc")])


QUERIES["fit_each_transit"] = each_transit


def curve(spark, sf):
    f, _ = _fits(spark, sf)
    return fit.best_fit_curve(small(spark, sf), f, 4, MODEL).select("star", r6("t").alias("t"), r6("f", 9).alias("f"), r6("phase").alias("phase"), "cycle")


QUERIES["best_fit_curve"] = curve


def _folded(spark, sf):
    d = cut_lineage(small(spark, sf).select("star", "cad", "t", "f", "fmask"))
    p = peaks(spark, sf, d)
    x = validate.phase_fold_detrended(d, p, cadence=0.0)
    return fit.choose_fit_input(x, p, minutes=720.0).withColumns({"t": C("t") / 10}), p.select(
        "star", F.lit(0.1).alias("p"), F.lit(0.15).alias("tau"), F.lit(0.3).alias("b"), F.lit(0.0).alias("dt")
    )


SHAPE = fit.shape_model(usamp=5, cadence=0.1)


def register(spark, sf):
    d, p = _folded(spark, sf)
    return fit.register(d, p, 0.1, 3, SHAPE).select("star", r6("dt").alias("dt"), r6("chi2").alias("chi2"))


QUERIES["register"] = register


def shape(spark, sf):
    d, p = _folded(spark, sf)
    return fit.fit_shape(d, p, 2, model=SHAPE).select("star", *[r6(c).alias(c) for c in ("p", "tau", "b", "chi2")], "n")


QUERIES["fit_shape"] = shape


def percentiles(spark, sf):
    d, p = _folded(spark, sf)
    d = cut_lineage(d)
    q, bands = fit.posterior_percentiles(d, cut_lineage(fit.fit_shape(d, p, 2, model=SHAPE)), 7, model=SHAPE)
    n = bands.groupBy("star").agg(F.count(F.lit(1)).alias("n_band"), r6(F.avg(C("hi") - C("lo")), 9).alias("band"))
    t = fit.report_units(q)
    return q.join(t, ["star", "par"]).join(n, "star").select("star", "par", *[r6(c).alias(c) for c in ("q15", "q50", "q85", "med", "sig")], "value", "error", "n_band", "band")


QUERIES["posterior_percentiles"] = percentiles


def inject_recover(spark, sf):
    """Two dips per star in the quarters of its series, calibrated with two modes whose limits come from
    the quarters without dips, searched within 10 cadences and spliced over the star's own periodogram."""
    d = cut_lineage(clean.normalize_quarter(fixtures.daily(spark, sf)).select("star", "cad", "t", "f", "fmask", "quarter"))
    parts = cut_lineage(stages.quarter_series(d, 100.0, 100.0))
    modes = cut_lineage(modes_of(d, 2))
    limits = cut_lineage(ensemble.coef_stats(ensemble.explode_coef(ensemble.mode_coefficients(parts, modes, 2))))
    full = search.search_clipped(cut_lineage(stages.centre(stages.calibrate_quarters(parts, modes, limits, 2))), 20, 42, (2, 3))
    p = d.select("star").distinct()
    p = p.select("star", F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(P).alias("P"), F.lit(df).alias("df")) for i, (P, df) in enumerate([(27.1, 1.2e6), (33.7, 0.8e6)])])).alias("_e"))
    p = p.select("star", F.concat_ws("-", "star", C("_e.n").cast("string")).alias("id"), C("_e.P").alias("P"), F.lit(0.4).alias("phase"), C("_e.df").alias("df"), F.lit(3.0).alias("tdur"))
    r = stages.recovered(stages.inject_recover(d, p, (2, 3), 10.0, 1.0, full, 100.0, modes, limits, 2))
    return r.select(
        "star", "id", "P", *[r6(c).alias(c) for c in ("grid_P", "grid_s2n")], "num_trans", *[r6(c).alias(c) for c in ("clip_snr", "harm", "s2ncut", "autor")], "bg"
    )


QUERIES["inject_recover"] = inject_recover


def splice(spark, sf):
    d = daily_injected(spark, sf)
    full = search.search_clipped(d, 24, 29, (3,))
    narrow = search.search_clipped(d, 26, 27, (2, 3))
    x = stages.splice_periodogram(full, narrow)
    return x.groupBy("star", "twd").agg(F.count(F.lit(1)).alias("n"), r6(F.max("s2n")).alias("s2n"))


QUERIES["splice_periodogram"] = splice
SQL["splice_periodogram"] = f"""WITH {DAILY_INJECTED}, {clipped_sql(None, 'di', 'a', 24, 29, (3,))}, {clipped_sql(None, 'di', 'b', 26, 27, (2, 3))},
l AS (SELECT star, min(pcad) AS lo, max(pcad) AS hi FROM b GROUP BY star),
u AS (SELECT a.* FROM a LEFT JOIN l USING (star) WHERE lo IS NULL OR pcad < lo OR pcad > hi UNION ALL SELECT * FROM b)
SELECT star, twd, count(*) AS n, {s6('max(s2n)')} AS s2n FROM u GROUP BY star, twd"""


def calibrate_stage(spark, sf):
    cal, _ = stages.calibrate_ensemble(relative(spark, sf).drop("quarter", "quality"), 2, "PCA", 20, 200.0)
    return cal.groupBy("star").agg(F.count_if("inlier").alias("n_inlier"), F.count_if("cr").alias("n_cr"), r6(F.stddev_pop("fcal")).alias("sd"))


QUERIES["calibrate_ensemble"] = calibrate_stage
