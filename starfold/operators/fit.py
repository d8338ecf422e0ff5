"""Model fits by coarse-to-fine grids: parameter grids meet the data in one aggregate per round.

All stars (or transits) of a round are one job; only one row of parameters per key passes from round
to round.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import models, stats
from starfold.functions.frames import scan
from starfold.functions.scalars import CADENCE_DAYS
from starfold.operators import validate
from starfold.operators.fold import shuffle_width
from starfold.session import cut_lineage, staged

Model = Callable[[Column, Mapping[str, Column]], Column]

# Fixed value: linear limb darkening 0.66, as the second non-linear coefficient.
LINEAR_LIMB = (0.0, 0.66, 0.0, 0.0)


def ephemeris_model(usamp: int = 4, cadence: float = 1.0 / 48.0) -> Model:
    """Limb-darkened transit with parameters P, t0, rp, tdur, b, minus 1."""

    def model(t: Column, p: Mapping[str, Column]) -> Column:
        tau = models.crossing_time(p["tdur"], p["rp"], p["b"])
        return models.transit(models.fold_time(t, p["P"], p["t0"]), p["rp"], tau, p["b"], LINEAR_LIMB, usamp, cadence)

    return model


def shape_model(climb: Sequence[float] = models.SOLAR_LIMB, usamp: int = 5, cadence: float = CADENCE_DAYS) -> Model:
    """Folded transit with parameters p, tau, b, dt."""

    def model(t: Column, p: Mapping[str, Column]) -> Column:
        return models.transit(t - p["dt"], p["p"], p["tau"], p["b"], climb, usamp, cadence)

    return model


def chi2_of(
    data: DataFrame, trials: DataFrame, names: Sequence[str], model: Model, keys: Sequence[str]
) -> DataFrame:
    """Chi-square and number of points per trial.

    ``trials`` has one row per key with an array ``_g`` of parameter structs. Every data row is
    multiplied by its trials and summed on the map side.
    """
    x = data.join(trials.select(*keys, "_g"), list(keys))
    x = x.select(*keys, "t", "f", "ferr", F.explode("_g").alias("_p"))
    p = {n: F.col(f"_p.{n}") for n in names}
    r = (F.col("f") - model(F.col("t"), p)) / F.col("ferr")
    return x.withColumn("_r2", F.pow(r, F.lit(2.0))).groupBy(*keys, *[F.col(f"_p.{n}").alias(n) for n in names], F.col("_p._id").alias("_id")).agg(
        F.sum("_r2").alias("chi2"), F.count("_r2").alias("n")
    )


def _trials(state: DataFrame, names, axes, points, keys) -> DataFrame:
    offsets = [points if n in axes else (0.0,) for n in names]
    items = []
    for k, combo in enumerate(itertools.product(*offsets)):
        fields = [F.lit(k).alias("_id")]
        for n, o in zip(names, combo):
            v = F.col(n) + F.col(f"{n}_step") * o
            v = F.greatest(F.least(v, F.col(f"{n}_max")), F.col(f"{n}_min"))
            fields.append(v.alias(n))
        items.append(F.struct(*fields))
    return state.withColumn("_g", F.array(*items)).select(*keys, "_g")


def grid_fit(
    data: DataFrame, start: DataFrame, names: Sequence[str], axes: Sequence[Sequence[str]], model: Model,
    keys: Sequence[str] = ("star",), rounds: int = 4, points: Sequence[float] = (-1.0, -0.5, 0.0, 0.5, 1.0), shrink: float = 0.5,
) -> DataFrame:
    """Minimise chi-square per key.

    ``start`` has, for every parameter, its value and ``_step``, ``_min``, ``_max``. Each round tries
    the grid of every axis group in turn around the best values so far; steps shrink after a round.
    Returns parameters, ``chi2``, ``n`` and errors (``u`` + name) from a rise of chi-square by 1.
    """
    # Written once for all rounds, and spread by row: each row is multiplied by its trials.
    x = data.where(F.col("f").isNotNull() & (F.col("ferr") > 0) & F.col("t").isNotNull())
    x = cut_lineage(x.select(*keys, "t", "f", "ferr").repartition(shuffle_width(data), *keys, "t"))
    meta = [f"{n}_{s}" for n in names for s in ("step", "min", "max")]
    state = cut_lineage(start.select(*keys, *names, *meta))
    for r in range(rounds):
        for group in axes:
            c = chi2_of(x, _trials(state, names, group, points, keys), names, model, keys)
            best = stats.top_row(c, keys, [-F.col("chi2"), -F.col("_id")], [*names])
            state = cut_lineage(best.join(state.select(*keys, *meta), list(keys)))
        if r < rounds - 1:
            state = state.withColumns({f"{n}_step": F.col(f"{n}_step") * shrink for n in {a for g in axes for a in g}})
    free = [n for n in names if any(n in g for g in axes)]
    items = [F.struct(F.lit(0).alias("_id"), *[F.col(n).alias(n) for n in names])]
    for k, (n, s) in enumerate(itertools.product(free, (-1.0, 1.0)), 1):
        items.append(
            F.struct(F.lit(k).alias("_id"), *[(F.col(m) + F.col(f"{m}_step") * s if m == n else F.col(m)).alias(m) for m in names])
        )
    c = chi2_of(x, state.withColumn("_g", F.array(*items)), names, model, keys)
    at = lambda k: F.max(F.when(F.col("_id") == k, F.col("chi2")))
    around = c.groupBy(*keys).agg(
        at(0).alias("chi2"), F.max("n").alias("n"), *[at(k).alias(f"_k{k}") for k in range(1, 2 * len(free) + 1)]
    )
    out = state.join(around, list(keys))
    errs = {}
    for i, n in enumerate(free):
        bend = (F.col(f"_k{2 * i + 1}") + F.col(f"_k{2 * i + 2}")) / 2 - F.col("chi2")
        errs[f"u{n}"] = stats.safe_div(F.col(f"{n}_step"), F.sqrt(F.when(bend > 0, bend)))
    return out.withColumns(errs).select(*keys, *names, *errs, "chi2", "n")


def _limits(df: DataFrame, lims: Mapping[str, tuple[Column, Column, Column]]) -> DataFrame:
    cols = {}
    for n, (step, lo, hi) in lims.items():
        cols |= {f"{n}_step": step.cast("double"), f"{n}_min": lo.cast("double"), f"{n}_max": hi.cast("double")}
    return df.withColumns(cols)


EPHEMERIS = ("P", "t0", "rp", "tdur", "b")


def fit_constant_ephemeris(
    lc: DataFrame, peaks: DataFrame, rounds: int = 4, model: Model | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fit one ephemeris per star, starting from its search peak (star, P, t0, tdur, mean).

    Data are locally detrended with a line over twice the duration; their error is the scatter of the
    continuum. Returns the fits and the detrended data.
    """
    model = model or ephemeris_model()
    dt = validate.local_detrend(lc, peaks.select("star", "P", "t0", "tdur"), 1, 2, 0.0, 2.0, widen=2.0)
    sig = dt.groupBy("star").agg(
        F.stddev_samp(F.when(F.col("continuum") == 1, F.col("f"))).alias("_sig"), F.max("t").alias("_b"), F.min("t").alias("_a")
    )
    dt = (
        dt.join(sig.select("star", "_sig"), "star").withColumn("ferr", F.col("_sig")).select("star", "cad", "t", "f", "ferr", "transit_id", "transit", "continuum")
    )
    dt = cut_lineage(dt.repartition(shuffle_width(lc), "star", "cad"))
    p = peaks.join(sig, "star").withColumns(
        {"rp": F.sqrt(F.greatest("mean", F.lit(1e-12))), "b": F.lit(0.5), "_nt": stats.safe_div(F.col("_b") - F.col("_a"), F.col("P"))}
    )
    td, P, t0, rp = F.col("tdur"), F.col("P"), F.col("t0"), F.col("rp")
    span = td / F.greatest(F.col("_nt"), F.lit(1.0))
    zero = F.lit(0.0)
    p = _limits(
        p,
        {
            "P": (span, P - span, P + span), "t0": (td, t0 - td, t0 + td), "rp": (rp * 0.8, zero, rp * 2),
            "tdur": (td * 0.8, td * 0.05, td * 4), "b": (F.lit(0.5), zero, F.lit(1.0)),
        },
    )
    axes = (("P", "t0"), ("rp", "tdur"), ("b", "tdur"))
    best = grid_fit(dt, p, EPHEMERIS, axes, model, rounds=rounds)
    return best.withColumn("rchisq", stats.safe_div(F.col("chi2"), F.col("n") - 5)), dt


def fit_each_transit(dt: DataFrame, fits: DataFrame, rounds: int = 4, model: Model | None = None) -> DataFrame:
    """Per transit the time with the other parameters fixed, then the radius ratio likewise.

    ``omc`` is the time against the constant ephemeris, ``t0`` the reported transit time.
    """
    model = model or ephemeris_model()
    ids = dt.select("star", "transit_id").distinct().join(fits.select("star", *EPHEMERIS), "star")
    td, t0, rp = F.col("tdur"), F.col("t0"), F.col("rp")
    still = F.lit(0.0)
    fixed = {n: (still, F.col(n), F.col(n)) for n in EPHEMERIS}
    k = ("star", "transit_id")
    a = grid_fit(dt, _limits(ids, fixed | {"t0": (td, t0 - td, t0 + td)}), EPHEMERIS, (("t0",),), model, k, rounds)
    b = grid_fit(dt, _limits(ids, fixed | {"rp": (rp, still, rp * 4)}), EPHEMERIS, (("rp",),), model, k, rounds)
    x = a.select(*k, F.col("t0").alias("_t"), "ut0").join(b.select(*k, "rp", "urp"), list(k)).join(
        fits.select("star", F.col("P").alias("_P"), F.col("t0").alias("_t0")), "star"
    )
    omc = F.col("_t") - F.col("_t0")
    return x.select(
        *k, (F.col("_t0") + F.col("transit_id") * F.col("_P") + omc).alias("t0"), "ut0", "rp", "urp", omc.alias("omc")
    )


def best_fit_curve(lc: DataFrame, fits: DataFrame, oversample: int = 4, model: Model | None = None) -> DataFrame:
    """The fitted model on evenly spaced times, ``oversample`` times as many as cadences, folded.

    The times are laid out from the rows of the series: each brings its own share.
    """
    model = model or ephemeris_model()
    from starfold.operators import fold

    last = lc.groupBy("star").agg(F.max("t").alias("t_last"))
    x = fold.with_index(lc).join(last, "star").select("star", "i", "ncad", "t_first", "t_last")
    j = F.explode(F.sequence(F.lit(0), F.lit(oversample - 1)))
    x = x.withColumn("_j", j).withColumn("_k", F.col("i") * oversample + F.col("_j"))
    step = stats.safe_div(F.col("t_last") - F.col("t_first"), F.col("ncad") * oversample - 1)
    x = x.withColumn("t", F.col("t_first") + F.col("_k") * step).join(fits.select("star", *EPHEMERIS), "star")
    x = x.withColumn("f", model(F.col("t"), {n: F.col(n) for n in EPHEMERIS}))
    return validate.phasefold(x, F.col("P"), F.col("t0")).select("star", "t", "f", "t_phasefold", "phase", "cycle")


SHAPE = ("p", "tau", "b", "dt")


def _shape_start(pars: DataFrame, free: Sequence[str]) -> DataFrame:
    still = F.lit(0.0)
    lims = {
        "p": (F.col("p") * 0.8, F.lit(1e-6), F.lit(1.0)), "tau": (F.col("tau") * 0.8, F.lit(1e-4), F.lit(2.0)),
        "b": (F.lit(0.5), still, F.lit(1.0)), "dt": (still, F.col("dt"), F.col("dt")),
    }
    for n in SHAPE:
        if n not in free:
            lims[n] = (still, F.col(n), F.col(n))
    return _limits(pars, lims)


def fit_shape(data: DataFrame, pars: DataFrame, rounds: int = 4, free: Sequence[str] = ("p", "tau", "b"), model: Model | None = None) -> DataFrame:
    """Fit p, tau, b (0 < tau < 2, 0 <= b <= 1) to a folded curve (star, t, f, ferr) at fixed dt."""
    groups = [tuple(free[:2]), tuple(free[1:])] if len(free) > 2 else [tuple(free)]
    return grid_fit(data, _shape_start(pars, free), SHAPE, groups, model or shape_model(), rounds=rounds)


def register(data: DataFrame, pars: DataFrame, cadence: float = CADENCE_DAYS, per_cadence: int = 3, model: Model | None = None) -> DataFrame:
    """Best displacement dt over plus and minus 2 tau, ``per_cadence`` trials per cadence; the radius
    ratio of each trial is scaled to the data."""
    model = model or shape_model(cadence=cadence)
    n = F.floor(F.col("tau") * 4 / cadence * per_cadence).cast("int")
    p = pars.select("star", "p", "tau", "b").withColumn("_n", n)
    trial = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    p = p.withColumn("_k", trial).withColumn("dt", -F.col("tau") * 2 + F.col("tau") * 4 * stats.safe_div(F.col("_k"), F.col("_n") - 1))
    x = data.where(F.col("f").isNotNull() & (F.col("ferr") > 0)).join(p, "star")
    m = model(F.col("t"), {c: F.col(c) for c in SHAPE})
    w = F.lit(1.0) / (F.col("ferr") * F.col("ferr"))
    g = x.withColumns({"_m": m, "_w": w}).groupBy("star", "dt").agg(
        F.sum(F.col("_w") * F.col("f") * F.col("f")).alias("ff"), F.sum(F.col("_w") * F.col("f") * F.col("_m")).alias("fm"),
        F.sum(F.col("_w") * F.col("_m") * F.col("_m")).alias("mm"),
    )
    # Depth scales the model: the best scale leaves ff - fm^2/mm.
    gain = F.when(F.col("fm") > 0, stats.safe_div(F.col("fm") * F.col("fm"), F.col("mm")))
    g = g.withColumn("chi2", F.col("ff") - F.coalesce(gain, F.lit(0.0)))
    return stats.top_row(g, ["star"], [-F.col("chi2"), -F.abs("dt"), -F.col("dt")], ["dt", "chi2"])


def posterior_percentiles(
    data: DataFrame, fits: DataFrame, points: int = 9, width: float = 4.0, quantiles: Sequence[float] = (0.15, 0.5, 0.85),
    model: Model | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Percentiles of p, tau, b from weights exp(-chi2/2) on a grid around the best fit, with med, sig
    and an upper limit for b where it is one-sided; and bands of the model over the data times."""
    model = model or shape_model()
    lo, hi = {}, {}
    for n in ("p", "tau", "b"):
        u = F.coalesce(F.col(f"u{n}"), F.abs(F.col(n)) * 0.1 + 0.01) * width
        lo[n], hi[n] = F.col(n) - u, F.col(n) + u
    floor, top = {"p": 1e-6, "tau": 1e-4, "b": 0.0}, {"p": 1.0, "tau": 2.0, "b": 1.0}
    axis = lambda n: F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda k: F.greatest(F.lit(floor[n]), lo[n]) + (F.least(F.lit(top[n]), hi[n]) - F.greatest(F.lit(floor[n]), lo[n])) * k / (points - 1),
    )
    g = fits.select("star", "dt", *[F.col(f"u{n}") for n in ("p", "tau", "b")], "p", "tau", "b")
    g = g.withColumns({f"_x{n}": axis(n) for n in ("p", "tau", "b")})
    g = g.select("star", "dt", "_xp", "_xtau", "_xb")
    g = g.select("star", "dt", "_xtau", "_xb", F.explode("_xp").alias("p"))
    g = g.select("star", "dt", "_xb", "p", F.explode("_xtau").alias("tau"))
    grid = g.select("star", "dt", "p", "tau", F.explode("_xb").alias("b"))
    x = data.where(F.col("f").isNotNull() & (F.col("ferr") > 0)).select("star", "t", "f", "ferr").join(grid, "star")
    r = (F.col("f") - model(F.col("t"), {c: F.col(c) for c in SHAPE})) / F.col("ferr")
    chi = x.withColumn("_r2", F.pow(r, F.lit(2.0))).groupBy("star", *SHAPE).agg(F.sum("_r2").alias("chi2"))
    w = Window.partitionBy("star")
    wt = cut_lineage(chi.withColumn("w", F.exp((F.min("chi2").over(w) - F.col("chi2")) * 0.5)))
    long = wt.select("star", F.explode(F.array(*[F.struct(F.lit(n).alias("par"), F.col(n).alias("v")) for n in ("p", "tau", "b")])).alias("_e"), "w")
    marg = long.groupBy("star", F.col("_e.par").alias("par"), F.col("_e.v").alias("v")).agg(F.sum("w").alias("w"))
    run = Window.partitionBy("star", "par").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    marg = marg.withColumns({"_c": F.sum("w").over(run), "_t": F.sum("w").over(Window.partitionBy("star", "par"))})
    qs = {f"q{int(q * 100)}": F.min(F.when(F.col("_c") >= F.col("_t") * q, F.col("v"))) for q in quantiles}
    q = marg.groupBy("star", "par").agg(*[c.alias(n) for n, c in qs.items()])
    a, m, b = (f"q{int(v * 100)}" for v in quantiles)
    one_sided = (F.col("par") == "b") & (F.col(b) - F.col(m) > F.col(a))
    q = q.withColumns(
        {
            "med": F.when(one_sided, F.col(b)).otherwise(F.col(m)),
            "sig": F.when(~one_sided, (F.col(b) - F.col(a)) / 2),
        }
    )
    heavy = wt.where("w > 1e-6")
    y = data.select("star", "t").distinct().join(heavy, "star")
    y = y.withColumn("m", model(F.col("t"), {c: F.col(c) for c in SHAPE}))
    s = y.groupBy("star", "t").agg(
        stats.safe_div(F.sum(F.col("w") * F.col("m")), F.sum("w")).alias("mean"),
        stats.safe_div(F.sum(F.col("w") * F.col("m") * F.col("m")), F.sum("w")).alias("_m2"),
    )
    sd = F.sqrt(F.greatest(F.col("_m2") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return q, s.select("star", "t", (F.col("mean") - sd).alias("lo"), "mean", (F.col("mean") + sd).alias("hi"))


def report_units(q: DataFrame) -> DataFrame:
    """Radius ratio in percent, times in hours, as text; an upper limit reads ``<value``."""
    k = F.when(F.col("par") == "p", 100.0).when(F.col("par") == "tau", 24.0).otherwise(1.0)
    med, sig = F.format_string("%.2f", F.col("med") * k), F.format_string("%.2f", F.col("sig") * k)
    return q.select(
        "star", "par", F.when(F.col("sig").isNull(), F.concat(F.lit("<"), med)).otherwise(med).alias("value"),
        F.when(F.col("sig").isNull(), F.lit("")).otherwise(sig).alias("error"),
    )


def choose_fit_input(folded: DataFrame, periods: DataFrame, short: float = 50.0, minutes: float = 10.0) -> DataFrame:
    """Fit data (t, f, ferr) from a folded curve (``tPF, f, t``): bins with the error of the mean for
    periods under ``short``, else single points with an error from successive differences. The curve and
    its bins are written once, as both kinds, the medians and the errors read them."""
    x = staged(folded).join(periods.select("star", F.col("P").alias("_P")), "star")
    b = validate.bin_folded(x.where(F.col("_P") < short).select("star", "tPF", "f"), minutes)
    binned = b.select("star", F.col("tb").alias("t"), F.col("med").alias("f"), F.col("std"), "count")
    binned = cut_lineage(binned)
    typ = stats.group_medians(binned, ["star"], {"_typ": F.col("std")})
    err = F.when(F.col("count") == 1, F.col("_typ")).otherwise(F.col("std") / F.sqrt("count"))
    binned = binned.join(typ, "star").select("star", "t", "f", err.alias("ferr"))
    y = x.where(F.col("_P") >= short).withColumn("_at", F.round("tPF", 9))
    y = scan(y, {"_p": ("last", F.col("f"))}, order="_at", strict=True, stretch=1.0, then=("t",))
    y = y.withColumn("_d", (F.col("f") - F.col("_p")) * F.sqrt(F.lit(2.0)))
    sig = y.groupBy("star").agg(F.stddev_pop("_d").alias("ferr"))
    return binned.unionByName(y.join(sig, "star").select("star", F.col("tPF").alias("t"), "f", "ferr"))


