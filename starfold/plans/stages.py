"""The stages of a search, each for all stars at once.

Loops run over whole tables with a bounded number of rounds and write a stage table per round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.functions import scalars, stats
from starfold.operators import clean, detrend, ensemble, fit, fold, inject, search, validate, windows
from starfold.session import cut_lineage, staged

PGRAM_BINS = 2000


def centre(lc: DataFrame) -> DataFrame:
    """Flux minus the median of the unmasked points; 0 under the mask."""
    x = stats.with_medians(lc, ["star"], {"_m": clean.flux()})
    ok = clean.valid()
    return x.withColumn("f", F.when(ok, F.col("f") - F.col("_m")).otherwise(0.0)).drop("_m")


def grid_search(
    lc: DataFrame, p_min: float = 0.5, p_max: float | None = None, nseg: int = 10, nbins: int = PGRAM_BINS,
    rstar: float = 1.0, mode: str = "max",
) -> tuple[DataFrame, DataFrame]:
    """Periodogram over log-spaced segments up to 0.49 of the baseline, binned, and its peaks.

    Period limits and durations follow from each star's own baseline and cadence.
    """
    if mode != "max":
        raise ValueError("other modes run over explicit segments: search.periodogram")
    # Written once: the search reads it for boxes, noise, cadence and length.
    lc = x = cut_lineage(centre(lc))
    base = search.cadence(lc).join(lc.groupBy("star").agg((F.max("t") - F.min("t")).alias("tbase")), "star")
    base = cut_lineage(base)
    top = F.lit(p_max).cast("double") if p_max is not None else F.col("tbase") * 0.49
    seg = fold.search_segments(base, F.lit(float(p_min)), top, nseg, rstar=rstar, cadence=F.col("dt"))
    seg = seg.select(
        "star", "seg", F.greatest("Pcad1", F.lit(1)).cast("double").alias("p1"), F.col("Pcad2").cast("double").alias("p2"),
        F.array_distinct(F.filter("twdG", lambda k: k >= 1)).alias("twdG"),
    ).where((F.col("p2") > F.col("p1")) & (F.size("twdG") > 0))
    seg = cut_lineage(seg)
    # Durations are a few dozen integers in all.
    twds = [r[0] for r in seg.select(F.explode("twdG")).distinct().orderBy("col").collect()]
    pgram = search.search_clipped(x, None, None, twds, seg)
    pgram = cut_lineage(search.bin_periodogram(pgram.where("P > 0"), nbins))
    return pgram, search.peak(pgram)


def search_near(lc: DataFrame, candidates: DataFrame, dt: DataFrame, width: float = 1.0) -> DataFrame:
    """Outlier-proof search within ``width`` cadences of each candidate's period at its own duration."""
    near = candidates.join(dt.select("star", "dt"), "star").select(
        "star", F.lit(0).alias("seg"), (F.col("P") / F.col("dt") - width).alias("p1"), (F.col("P") / F.col("dt") + width).alias("p2"),
        F.array(F.greatest(F.rint(F.col("tdur") / F.col("dt")).cast("int"), F.lit(1))).alias("twdG"),
    )
    near = cut_lineage(near)
    twds = [r[0] for r in near.select(F.explode("twdG")).distinct().orderBy("col").collect()]
    return search.search_clipped(lc, None, None, twds, near)


def secondary_eclipse_search(lc: DataFrame, candidates: DataFrame, phase_limit: float = 0.1) -> DataFrame:
    """Best remaining dip at the candidate's period with the transit masked: se_s2n, se_t0, se_phase."""
    x = validate.fold_on(centre(lc), candidates)
    x = x.withColumn("fmask", F.col("fmask") | (F.abs("phase") < phase_limit)).withColumn("f", F.when(~F.col("fmask"), F.col("f")).otherwise(0.0))
    p = search.peak(search_near(x.select(*lc.columns), candidates, search.cadence(lc)))
    # A star whose search leaves no row stays, without significance or epoch.
    y = candidates.select("star", "P", "t0").join(p, "star", "left")
    return y.select(
        "star", F.coalesce("grid_s2n", F.lit(0.0)).alias("se_s2n"), F.col("grid_t0").alias("se_t0"),
        ((F.col("grid_t0") - F.col("t0")) / F.col("P")).alias("se_phase"),
    )


def cut_search(lc: DataFrame, candidates: DataFrame, tdurcad: int) -> DataFrame:
    """Best dip near the candidate's period with its transits, widened by two durations, cut out."""
    x = validate.label_transit(centre(lc), candidates).select(*lc.columns, "transit")
    x = clean.grow_mask(x, "transit", tdurcad, tdurcad - 1, "_cut")
    x = x.withColumn("fmask", F.col("fmask") | (F.col("_cut") > 0)).withColumn("f", F.when(~F.col("fmask"), F.col("f")).otherwise(0.0))
    p = search.peak(search_near(x.select(*lc.columns), candidates, search.cadence(lc)))
    p = candidates.select("star").join(p, "star", "left")
    return p.select("star", F.coalesce("grid_s2n", F.lit(0.0)).alias("s2ncut"), F.col("grid_t0").alias("s2ncut_t0"), F.col("grid_mean").alias("s2ncut_mean"))


def secondary_fold(lc: DataFrame, candidates: DataFrame, cut: DataFrame, **fold_args) -> tuple[DataFrame, DataFrame]:
    """Folded, locally detrended curve around the cut-search epoch, and its offset in time and degrees."""
    c = candidates.join(cut.select("star", "s2ncut_t0"), "star")
    at = c.select("star", "P", F.col("s2ncut_t0").alias("t0"), "tdur")
    off = F.col("t0") - F.col("s2ncut_t0")
    return (
        validate.phase_fold_detrended(lc, at, **fold_args),
        c.select("star", off.alias("t0shft_se"), (off / F.col("P") * 360.0).alias("ph_se")),
    )


def mask_candidates(lc: DataFrame, candidates: DataFrame, pad: float = 1.0) -> DataFrame:
    """Mask everything within (0.5 + pad) durations of any transit of the star's candidates."""
    per = candidates.groupBy("star").agg(F.collect_list(F.struct("P", "t0", "tdur")).alias("_c"))
    t = F.col("t")
    hit = F.exists(
        "_c", lambda c: F.abs(F.pmod(t - c["t0"] + c["P"] / 2, c["P"]) - c["P"] / 2) < c["tdur"] * (0.5 + pad)
    )
    x = lc.join(per, "star", "left")
    return x.withColumn("fmask", F.col("fmask") | F.coalesce(hit, F.lit(False))).drop("_c")


def fit_and_validate(lc: DataFrame, peaks: DataFrame, rounds: int = 4, model: fit.Model | None = None, twd: int = 3) -> DataFrame:
    """Constant-ephemeris fit of each peak (star, grid_P, grid_t0, grid_tdur, grid_mean) and the numbers
    that judge it: fitted P, t0, tdur, rp, b and rchisq, events seen (num_trans), median depths of even
    and odd ones, and the s2n without the three deepest (clip_snr). Flux is relative to 1, less 1."""
    start = peaks.select(
        "star", F.col("grid_P").alias("P"), F.col("grid_t0").alias("t0"), F.col("grid_tdur").alias("tdur"), F.col("grid_mean").alias("mean")
    )
    fits, _ = fit.fit_constant_ephemeris(lc, start, rounds, model)
    fits = cut_lineage(fits.select("star", "P", "t0", "tdur", "rp", "b", "rchisq"))
    ses, head = validate.single_event_table(lc, fits.select("star", "P", "t0", "tdur"), twd)
    noise = windows.noise_per_duration(windows.mean_depth(lc, (twd,))).select("star", "noise")
    out = fits.join(head.select("star", "num_trans", "ses_even", "ses_odd"), "star", "left")
    return out.join(validate.robust_snr(ses, noise).select("star", "clip_snr"), "star", "left")


FITTED = ("P", "t0", "tdur", "rp", "b", "rchisq", "num_trans", "ses_even", "ses_odd", "clip_snr")


def multi_search(
    lc: DataFrame, search_once: Callable[[DataFrame], DataFrame], min_s2n: float = 8.0, max_passes: int = 5,
    fit_once: Callable[[DataFrame, DataFrame], DataFrame] | None = fit_and_validate,
) -> DataFrame:
    """Search, fit and validate the peak, mask its transits, and again while s2n is high enough.

    ``search_once`` maps light curves to peaks (star, grid_s2n, grid_P, grid_t0, grid_tdur, grid_mean);
    ``fit_once`` maps light curves and the peaks worth it to fitted candidates with the columns FITTED
    (None: the peak stands for itself). A pass handles all stars still active and records what it
    finds, the next one masks within 1.5 fitted durations of it; the peak of a star's last pass, too low
    to go on with, is among its candidates, without a fit.
    """
    lc = cut_lineage(lc)
    found, active = [], lc
    for n in range(1, max_passes + 1):
        peaks = cut_lineage(search_once(active))
        strong = peaks.where(F.col("grid_s2n") >= min_s2n)
        named = peaks.select("star", F.lit(n).alias("candidate"), F.col("grid_s2n").alias("s2n"), F.col("grid_P"), F.col("grid_t0"), F.col("grid_tdur"))
        if fit_once is None or strong.isEmpty():
            fits = peaks.select("star", F.col("grid_P").alias("P"), F.col("grid_t0").alias("t0"), F.col("grid_tdur").alias("tdur"))
            fits = fits if fit_once is None else fits.where("false")
        else:
            fits = fit_once(active.join(strong.select("star"), "star", "left_semi"), strong)
        rows = named.join(fits, "star", "left")
        own = {"P": "grid_P", "t0": "grid_t0", "tdur": "grid_tdur"}
        cols = [F.coalesce(F.col(c), F.col(own[c])).alias(c) if c in own else (F.col(c) if c in rows.columns else F.lit(None)).cast("double").alias(c) for c in FITTED]
        found.append(cut_lineage(rows.select("star", "candidate", "s2n", *cols)))
        if strong.isEmpty():
            break
        so_far = reduce(DataFrame.unionByName, found)
        masked = mask_candidates(lc.join(strong.select("star"), "star", "left_semi"), so_far.where(F.col("s2n") >= min_s2n))
        active = cut_lineage(masked)
    if not found:
        shape = ", ".join(f"{c} DOUBLE" for c in FITTED)
        return lc.sparkSession.createDataFrame([], f"star STRING, candidate INT, s2n DOUBLE, {shape}")
    return reduce(DataFrame.unionByName, found)


def calibrate_ensemble(
    lc: DataFrame, k: int = ensemble.N_MODES, algo: str = "PCA", nsep: float = 24.0, lendt: float = 10.0, detrended: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Detrend, find common modes on the training matrix, fit and remove them, mask cosmic rays.

    Returns calibrated light curves and the coefficient limits.
    """
    x = lc if detrended else detrend.detrend_spline(lc, nsep, lendt).withColumn("f", F.col("fdt")).drop("segment", "ftnd", "fdt")
    x = cut_lineage(ensemble.align(x))
    t = ensemble.training_set(x)
    modes, weights = ensemble.robust_components(t.select("star", "cad", "z"), k, algo)
    modes = cut_lineage(modes)
    train = x.join(weights.select("star"), "star", "left_semi")
    coef = ensemble.mode_coefficients(train, modes, k)
    limits = cut_lineage(ensemble.coef_stats(ensemble.explode_coef(coef)))
    cal = ensemble.calibrate(x, modes, limits, k)
    cal = cal.withColumn("_f", F.col("f")).withColumn("f", F.col("fcal"))
    cal = clean.mask_outliers(cal, (-1e3, 10.0), "linear", "cr")
    return cal.withColumns({"fmask": F.col("fmask") | F.col("cr"), "f": F.col("_f")}).drop("_f"), limits


def splice_periodogram(full: DataFrame, narrow: DataFrame) -> DataFrame:
    """Replace the rows of ``full`` inside the period range of ``narrow`` (per star)."""
    lim = narrow.groupBy("star").agg(F.min("Pcad").alias("_a"), F.max("Pcad").alias("_b"))
    x = full.join(lim, "star", "left")
    outside = F.col("_a").isNull() | (F.col("Pcad") < F.col("_a")) | (F.col("Pcad") > F.col("_b"))
    return x.where(outside).select(*full.columns).unionByName(narrow.select(*full.columns))


def quarter_series(lc: DataFrame, lendt: float = 10.0, nsep: float = 24.0) -> DataFrame:
    """Every quarter of every star as a series of its own (``star`` is star#quarter): gap-free, outliers
    masked, spline trend removed. Rows without a quarter are left out."""
    part = F.concat_ws("#", F.col("star").cast("string"), F.col("quarter").cast("string"))
    x = lc.where("quarter IS NOT NULL").select(part.alias("star"), "cad", "t", "f", "fmask")
    x = clean.preprocess(clean.cadence_fill(x)).drop("is_outlier")
    x = detrend.detrend_spline(x, nsep, lendt)
    return x.select("star", "cad", "t", F.col("fdt").alias("f"), (F.col("fmask") | F.col("fdt").isNull()).alias("fmask"))


def calibrate_quarters(
    parts: DataFrame, modes: DataFrame | None = None, limits: DataFrame | None = None, k: int = ensemble.N_MODES
) -> DataFrame:
    """The quarters of ``quarter_series`` less the stored modes fitted to each, cosmic rays masked, on
    one gap-free axis per star. Without modes they are only stitched."""
    x = parts
    if modes is not None:
        x = ensemble.calibrate(staged(x), modes, limits, k).withColumn("f", F.col("fcal"))
        x = clean.mask_outliers(x, (-1e3, 10.0), "linear", "cr").withColumn("fmask", F.col("fmask") | F.col("cr"))
    of = F.regexp_replace("star", "#[^#]*$", "")
    return clean.stitch_quarters(x.select(of.alias("star"), "cad", "t", "f", (F.col("fmask") | F.col("f").isNull()).alias("fmask")))


def inject_recover(
    lc: DataFrame, params: DataFrame, twds: Sequence[int], delta: float = 10.0, cadence: float | None = None,
    full: DataFrame | None = None, lendt: float = 100.0, modes: DataFrame | None = None, limits: DataFrame | None = None,
    k: int = ensemble.N_MODES, fit_once: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Inject, clean, detrend, calibrate, search around the injected period, validate; one row per id.

    Every injection is its own series (star/id), so all run together. The dips go into the raw quarters
    (column ``quarter``; without it a star is one quarter, else flux is relative to each quarter's
    level), which are cleaned and detrended one by one, and calibrated with ``k`` stored ``modes``
    (cad, u) under the coefficient ``limits`` where those are given. With ``full``, a periodogram keyed
    by star, the search stays inside its periods, and replaces its rows there before the peak is taken.

    ``harm`` is the multiple of the period with the highest s2n, ``s2ncut`` what is left with the
    transits cut out, ``autor`` the ratio of autocorrelation. ``fit_once`` (as in ``multi_search``) adds
    the fitted columns as ``fit_...``.
    """
    step = scalars.CADENCE_DAYS if cadence is None else cadence
    key = F.concat_ws("/", F.col("star"), F.col("id").cast("string"))
    dt = search.cadence(lc)
    raw = lc if "quarter" in lc.columns else lc.withColumn("quarter", F.lit(0))
    x = inject.inject(raw, params, step).withColumn("star", key)
    x = cut_lineage(centre(calibrate_quarters(quarter_series(x, lendt, lendt), modes, limits, k)))
    ids = params.join(dt, "star").select(key.alias("star"), "id", F.col("star").alias("of"), (F.col("P") / F.col("dt")).alias("pc"))
    p1, p2 = F.greatest(F.floor(F.col("pc") - delta), F.lit(1)).cast("double"), F.floor(F.col("pc") + delta).cast("double")
    if full is not None:
        full = staged(full)
        span = full.groupBy(F.col("star").alias("of")).agg(F.min("Pcad").alias("_p1"), F.max("Pcad").alias("_p2"))
        ids = ids.join(span, "of", "left")
        p1, p2 = F.greatest(p1, F.floor("_p1").cast("double")), F.least(p2, F.ceil("_p2").cast("double"))
    ids = cut_lineage(ids.withColumns({"p1": p1, "p2": p2}))
    near = ids.where("p1 < p2").select("star", F.lit(0).alias("seg"), "p1", "p2", F.array(*[F.lit(int(w)) for w in twds]).alias("twdG"))
    pg = search.search_clipped(x, None, None, list(twds), near).drop("seg")
    if full is not None:
        keyed = ids.select("star", "of").join(full.withColumnRenamed("star", "of"), "of").drop("of")
        pg = splice_periodogram(keyed.select(*pg.columns), cut_lineage(pg))
    peak = cut_lineage(search.peak(pg))
    cand = peak.select("star", F.col("grid_P").alias("P"), F.col("grid_t0").alias("t0"), F.col("grid_tdur").alias("tdur"))
    mid = int(sorted(twds)[len(twds) // 2])
    ses, head = validate.single_event_table(x, cand, mid)
    depths = cut_lineage(windows.mean_depth(x, (mid,)))
    out = peak.join(head.select("star", "num_trans", "ses_even", "ses_odd"), "star", "left")
    out = out.join(validate.robust_snr(ses, windows.noise_per_duration(depths).select("star", "noise")), "star", "left")
    out = out.join(validate.check_harmonics(depths, cand).where("best").select("star", "harm"), "star", "left")
    out = out.join(cut_search(x, cand, mid).select("star", "s2ncut"), "star", "left")
    _, ratio = validate.autocorr(validate.bin_phasefold(validate.fold_on(x, cand), validate.phase_bin_spans(cand, step)), cand)
    out = out.join(ratio, "star", "left")
    if fit_once is not None:
        fits = fit_once(x, peak)
        out = out.join(fits.select("star", *[F.col(c).alias(f"fit_{c}") for c in fits.columns if c != "star"]), "star", "left")
    out = out.join(ids.select("star", "id", F.col("of")), "star").drop("star").withColumnRenamed("of", "star")
    return inject.merge_results(params, out.drop("star"))


def recovered(results: DataFrame, tol: Column | float = 0.01) -> DataFrame:
    """Mark injections whose period came back within a relative tolerance."""
    good = F.abs(F.col("grid_P") / F.col("P") - 1) < tol
    return results.withColumn("bg", F.coalesce(good, F.lit(False)))
