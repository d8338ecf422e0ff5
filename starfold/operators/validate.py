"""Folding on candidate ephemerides, labelling transits and validating candidates.

Candidates are rows (star, P, t0, tdur); light-curve rows meet theirs by an equi-join on star.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import linalg, stats
from starfold.functions.scalars import CADENCE_DAYS
from starfold.operators import fold, windows
from starfold.operators.clean import flux, median_filter, valid
from starfold.session import cut_lineage, staged


def with_time_span(df: DataFrame) -> DataFrame:
    """First and last time of the series on every row."""
    return df.join(df.groupBy("star").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last")), "star")


def t0_shift(t_first: Column, P: Column, t0: Column) -> Column:
    """Constant that moves the first transit at or after ``t_first`` to 0."""
    return -t0 - F.ceil((t_first - t0) / P) * P


def phasefold(df: DataFrame, P: Column, t0: Column, start: float = -0.5) -> DataFrame:
    """Adds t_phasefold, phase and cycle. Needs ``t`` and ``t_first``."""
    ts = F.col("t") + t0_shift(F.col("t_first"), P, t0)
    tf = F.pmod(ts - P * start, P) + P * start
    return df.withColumns(
        {"t_phasefold": tf, "phase": tf / P, "cycle": F.floor(ts / P - start)}
    )


def fold_on(df: DataFrame, candidates: DataFrame, start: float = -0.5) -> DataFrame:
    x = with_time_span(df).join(candidates.select("star", "P", "t0", "tdur"), "star")
    return phasefold(x, F.col("P"), F.col("t0"), start)


def bin_index(x: Column, lo: Column, hi: Column, nbins: Column) -> Column:
    """0-based index of right-closed even bins over (lo, hi]; NULL outside."""
    k = F.ceil(F.round((x - lo) / (hi - lo) * nbins, 9)) - 1
    return F.when((k >= 0) & (k < nbins), k)


def bin_phasefold(df: DataFrame, spans: DataFrame) -> DataFrame:
    """Count, mean, median, scatter and error of the mean per right-closed phase bin; empty bins stay.

    ``df`` has star, t_phasefold, f; ``spans`` has star, lo, hi, nbins.
    """
    x = df.where(valid()).join(spans, "star")
    x = x.withColumn("bin", bin_index(F.col("t_phasefold"), F.col("lo"), F.col("hi"), F.col("nbins"))).where("bin IS NOT NULL")
    g = stats.agg_with_medians(
        x, ["star", "bin"],
        [F.count("f").alias("fcount"), F.avg("f").alias("fmean"), F.stddev_samp("f").alias("fstd")],
        {"fmed": F.col("f")},
    )
    spine = spans.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nbins").cast("long") - 1)))
    step = (F.col("hi") - F.col("lo")) / F.col("nbins")
    spine = spine.select("star", "bin", (F.col("lo") + (F.col("bin") + 0.5) * step).alias("t_phasefold"))
    out = spine.join(g, ["star", "bin"], "left")
    return out.withColumns(
        {
            "fcount": F.coalesce("fcount", F.lit(0)),
            "ferr": stats.safe_div(F.col("fstd"), F.sqrt("fcount")),
        }
    )


def phase_bin_spans(candidates: DataFrame, dt: float, start: float = -0.5) -> DataFrame:
    """One bin less than round(P/dt) edges over one period."""
    return candidates.select(
        "star", (F.col("P") * start).alias("lo"), (F.col("P") * (start + 1)).alias("hi"),
        (F.rint(F.col("P") / dt) - 1).cast("long").alias("nbins"),
    )


# ---- labels and local detrending --------------------------------------------------------------


def label_transit(
    df: DataFrame, candidates: DataFrame, cpad: float = 0.5, cfrac: float = 3.0, widen: float = 1.0
) -> DataFrame:
    """Transit number (-1 outside) and flags transit, continuum, continuum_before, continuum_after.

    Which transits reach a point follows from its time alone; where several do, the latest gives the
    number. ``u`` is the time from that transit's middle in durations.
    """
    x = with_time_span(df).join(candidates.select("star", "P", "t0", "tdur"), "star")
    shift = t0_shift(F.col("t_first"), F.col("P"), F.col("t0"))
    P, D = F.col("P"), F.col("tdur") * widen
    reach = 0.5 + cpad + cfrac
    x = x.withColumns({"_ts": F.col("t") + shift, "_last": F.ceil((F.col("t_last") + shift) / P) - 1})
    ts = F.col("_ts")
    a = F.greatest(F.floor((ts - D * reach) / P), F.lit(0))
    b = F.least(F.ceil((ts + D * reach) / P), F.col("_last"))
    ids = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    x = x.withColumn("_u", F.transform(ids, lambda k: F.struct(k.alias("k"), ((ts - k * P) / D).alias("u"))))
    near = F.filter("_u", lambda r: F.abs(r["u"]) < reach)
    before = F.exists("_u", lambda r: (r["u"] > -0.5 - cpad - cfrac) & (r["u"] < -0.5 - cpad))
    after = F.exists("_u", lambda r: (r["u"] > 0.5 + cpad) & (r["u"] < 0.5 + cpad + cfrac))
    last = F.try_element_at(near, F.lit(-1))
    return x.withColumns(
        {
            "transit_id": F.coalesce(last["k"], F.lit(-1)),
            "u": last["u"],
            "transit": F.exists("_u", lambda r: F.abs(r["u"]) < 0.5).cast("int"),
            "continuum_before": before.cast("int"),
            "continuum_after": after.cast("int"),
            "continuum": (before | after).cast("int"),
        }
    ).drop("_ts", "_last", "_u", "t_first", "t_last")


def local_detrend(
    df: DataFrame, candidates: DataFrame, poly_degree: int = 3, min_continuum: int = 2,
    cpad: float = 0.5, cfrac: float = 3.0, widen: float = 1.0,
) -> DataFrame:
    """Subtract from each transit section the polynomial through its continuum.

    Sections with too few continuum points on either side are dropped. The fit uses the time from
    the transit middle; another origin gives the same curve.
    """
    x = label_transit(df.where(valid()), candidates, cpad, cfrac, widen).where("transit_id >= 0")
    basis = [F.when(F.col("continuum") == 1, F.pow("u", F.lit(float(j)))) for j in range(poly_degree + 1)]
    up, rhs = linalg.normal_sums(basis, F.col("f"))
    counts = {"_nb": F.sum("continuum_before"), "_na": F.sum("continuum_after")}
    enough = (F.col("_nb") > min_continuum) & (F.col("_na") > min_continuum)
    trend = F.aggregate(F.reverse("_c"), F.lit(0.0), lambda acc, c: acc * F.col("u") + c)
    n, s1, s2, t0, t1 = (F.col(c) for c in ("_a0_0", "_a0_1", "_a1_1", "_b0", "_b1"))
    slope = stats.safe_div(n * t1 - s1 * t0, n * s2 - s1 * s1)
    line = F.array((t0 - slope * s1) / n, slope)
    g = x.groupBy("star", "transit_id").agg(*[c.alias(k) for k, c in counts.items()], *up, *rhs).where(enough)
    if poly_degree == 1:
        g = g.withColumn("_c", line)
    else:
        g = g.withColumn("_c", linalg.solve_normal(*linalg.symmetric(poly_degree + 1)))
    x = x.join(g.select("star", "transit_id", "_c"), ["star", "transit_id"])
    return x.withColumn("f", F.col("f") - trend).drop("_c")


def phase_fold_detrended(
    df: DataFrame, candidates: DataFrame, phase_deg: float = 0.0, cfrac: float = 3.0, cpad: float = 1.0,
    degree: int = 1, min_continuum: int = 4, cadence: float = CADENCE_DAYS,
) -> DataFrame:
    """Locally detrended points by time from mid-transit (``tPF``, one cadence added), at any phase."""
    cand = candidates.withColumn("t0", F.col("t0") + F.col("P") * (phase_deg / 360.0))
    x = local_detrend(df, cand, degree, min_continuum, cpad, cfrac)
    tpf = F.pmod(F.col("t") - F.col("t0") + F.col("P") / 2, F.col("P")) - F.col("P") / 2
    return x.where("f IS NOT NULL").select("star", (tpf + cadence).alias("tPF"), "f", "t")


# ---- statistics of candidates -----------------------------------------------------------------


def single_event_table(df: DataFrame, candidates: DataFrame, twd: int) -> tuple[DataFrame, DataFrame]:
    """Depth at the cadence nearest to each transit middle, and per star the medians of even and odd
    transits with their number. There are no seasons; their medians are -99."""
    d = windows.mean_depth(df, (twd,))
    x = label_transit(d.withColumn("fmask", F.lit(False)).withColumn("f", F.col("d")), candidates).where("transit_id >= 0")
    near = stats.top_row(
        x, ["star", "transit_id"], [-F.abs("u"), -F.col("t")], ["d", "t"]
    ).withColumnsRenamed({"d": "ses", "transit_id": "tnum"})
    good = near.where("ses IS NOT NULL")
    med = stats.group_medians(
        good, ["star"],
        {"ses_even": F.when(F.col("tnum") % 2 == 0, F.col("ses")), "ses_odd": F.when(F.col("tnum") % 2 == 1, F.col("ses"))},
    )
    n = near.groupBy("star").agg(F.count(F.lit(1)).alias("num_trans"))
    seasons = {f"ses_{i}": F.lit(-99.0) for i in range(4)}
    return near, n.join(med, "star", "left").withColumns(seasons)


def robust_snr(ses: DataFrame, noise: DataFrame) -> DataFrame:
    """s2n from the mean without the three largest events (clip_snr) and from the median (med_snr)."""
    w = Window.partitionBy("star").orderBy(F.col("ses").desc(), "tnum")
    x = ses.where("ses IS NOT NULL").withColumn("_rn", F.row_number().over(w))
    g = x.groupBy("star").agg(
        F.avg(F.when(F.col("_rn") > 3, F.col("ses"))).alias("_mean"), F.count("ses").alias("n")
    )
    m = stats.group_medians(x, ["star"], {"_med": F.col("ses")})
    y = g.join(m, "star").join(noise, "star")
    rt = F.sqrt("n")
    return y.select(
        "star", (stats.safe_div(F.col("_mean"), F.col("noise")) * rt).alias("clip_snr"),
        (stats.safe_div(F.col("_med"), F.col("noise")) * rt).alias("med_snr"),
    )


def bin_folded(folded: DataFrame, minutes: float) -> DataFrame:
    """Fixed-width bins of a folded curve (``tPF``, ``f``): count, mean, std, med and centre ``tb``.
    Bins with fewer than two points are dropped."""
    lims = {"_lo": F.min("tPF"), "hi": F.max("tPF"), "_n": F.count(F.lit(1))}
    x = folded.join(folded.groupBy("star").agg(*[c.alias(n) for n, c in lims.items()]), "star")
    nb = F.greatest(F.rint((F.col("hi") - F.col("_lo")) / (minutes / 1440.0)), F.lit(1.0))
    x = x.where("_n >= 2").withColumns({"nb": nb, "lo": F.col("_lo") - 0.001})
    x = x.withColumn("bin", bin_index(F.col("tPF"), F.col("lo"), F.col("hi"), F.col("nb"))).where("bin IS NOT NULL")
    centre = F.first(F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / F.col("nb"))
    g = stats.agg_with_medians(
        x, ["star", "bin"],
        [F.count("f").alias("count"), F.avg("f").alias("mean"), F.stddev_samp("f").alias("std"), centre.alias("tb")],
        {"med": F.col("f")},
    )
    return g.where("std IS NOT NULL")


def norm_by_median_filter(df: DataFrame, candidates: DataFrame, tdurcad: int, per_tdur: Sequence[int] = (1, 5)) -> DataFrame:
    """f minus its running median over three durations, folded and averaged with the given numbers of
    bins per duration."""
    x = df.withColumn("_fi", F.coalesce(F.col("f"), F.lit(0.0)))
    x = median_filter(x, "_fi", tdurcad * 3, "_fm").withColumn("fmed", F.when(valid(), F.col("f") - F.col("_fm")))
    x = with_time_span(x).join(candidates.select("star", "P", "t0", "tdur"), "star")
    ts = F.col("t") + t0_shift(F.col("t_first"), F.col("P"), F.col("t0"))
    x = x.withColumn("tPF", F.pmod(ts + F.col("P") * 0.25, F.col("P")) - F.col("P") * 0.25)
    lim = x.groupBy("star").agg(F.min("tPF").alias("lo"), F.max("tPF").alias("hi"), F.first("tdur").alias("_td"))
    lim = lim.withColumn("nbpt", F.explode(F.array(*[F.lit(k) for k in per_tdur])))
    lim = lim.withColumn("nb", F.rint((F.col("hi") - F.col("lo")) / F.col("_td") * F.col("nbpt")).cast("long"))
    y = x.where("fmed IS NOT NULL").select("star", "tPF", "fmed").join(lim, "star")
    bins = histogram_bin(F.col("tPF"), F.col("lo"), F.col("hi"), F.col("nb"))
    y = y.withColumn("bin", bins)
    step = (F.col("hi") - F.col("lo")) / F.col("nb")
    return y.groupBy("star", "nbpt", "bin").agg(
        F.first(F.col("lo") + (F.col("bin") + 0.5) * step).alias("t"), F.avg("fmed").alias("f"), F.count("fmed").alias("n")
    )


def histogram_bin(x: Column, lo: Column, hi: Column, nbins: Column) -> Column:
    """0-based index of even bins [edge k, edge k+1), the last one closed; NULL outside."""
    k = F.floor(F.round((x - lo) / (hi - lo) * nbins, 9))
    return F.when((x >= lo) & (x <= hi), F.least(k, nbins - 1))


def hist_bin_avg(
    df: DataFrame, x: str, y: str, lo: float, hi: float, nbins: int, keys: Sequence[str] = ("star",), **hows
) -> DataFrame:
    """Mean of y per even x bin and the bin centre ``x``; ``hows`` adds further aggregates of y by name."""
    b = histogram_bin(F.col(x), F.lit(float(lo)), F.lit(float(hi)), F.lit(nbins))
    g = df.withColumn("bin", b).where("bin IS NOT NULL").groupBy(*keys, "bin").agg(
        F.avg(y).alias("y"), *[how(y).alias(n) for n, how in hows.items()]
    )
    return g.withColumn("x", F.lit(float(lo)) + (F.col("bin") + 0.5) * ((hi - lo) / nbins))


# Bins of a folded curve in one block of its autocorrelation.
LAG_BLOCK = 2048


def autocorr(binned: DataFrame, candidates: DataFrame, clip: float = 1.0, block: int = LAG_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Circular autocorrelation of a binned folded curve (NULL as 0), lags centred on 0, and per star
    the ratio of its maximum beyond ``clip`` durations to the overall one.

    ``binned`` has every bin from 0 on. A curve is cut into blocks of ``block`` bins. Each block meets
    each other one by an equi-join on its number; a task correlates the two and the products are
    added up per lag, so no row or task holds a whole curve.
    """
    x = binned.select("star", F.col("bin").cast("long").alias("bin"), F.coalesce("fmed", F.lit(0.0)).alias("f"), "t_phasefold")
    time_of = lambda k: F.max(F.when(F.col("bin") == k, F.col("t_phasefold")))
    blocks = x.groupBy("star", F.floor(F.col("bin") / block).alias("_i")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bin", "f"))), lambda r: r["f"]).alias("_f"),
        (F.max("bin") + 1).alias("_end"), time_of(0).alias("_t0"), time_of(1).alias("_t1"),
    )
    blocks = cut_lineage(blocks)
    size = blocks.groupBy("star").agg(F.max("_end").alias("_n"), (F.max("_t1") - F.max("_t0")).alias("dt"))
    part = blocks.select("star", "_i", "_f").join(size, "star").withColumn("_nb", F.ceil(F.col("_n") / block))
    left = part.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    right = part.select("star", F.col("_i").alias("_j"), F.col("_f").alias("_g"))
    pairs = left.join(right, ["star", "_j"]).select("star", "_i", "_j", "_f", "_g")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            first, sums = [], []
            for i, j, f, g in zip(b["_i"], b["_j"], b["_f"], b["_g"]):
                sums.append(np.correlate(g, f, "full"))
                first.append((j - i) * block - (len(f) - 1))
            yield pd.DataFrame({"star": b["star"], "first": first, "sums": sums})

    found = pairs.mapInPandas(run, "star string, first long, sums array<double>")
    found = found.select("star", "first", F.posexplode("sums").alias("_p", "_s")).join(size, "star")
    n, k = F.col("_n"), F.col("_lag")
    auto = found.groupBy("star", F.pmod(F.col("first") + F.col("_p"), n).alias("_lag"), "_n", "dt").agg(F.sum("_s").alias("autocorr"))
    auto = cut_lineage(auto)
    # Lags run from -n/2; the fold keeps its start at half a period.
    i = F.pmod(k + n / 2.0, n.cast("double")) - n / 2.0
    auto = auto.select("star", i.alias("i_shift"), (i * F.col("dt")).alias("t_shift"), "autocorr")
    lim = candidates.select("star", (F.col("tdur") * clip).alias("_w"))
    g = auto.join(lim, "star").groupBy("star").agg(
        F.max("autocorr").alias("_all"),
        F.max(F.when(F.abs("t_shift") > F.col("_w"), F.col("autocorr"))).alias("_out"),
    )
    return auto, g.select("star", stats.safe_div(F.col("_out"), F.col("_all")).alias("autor"))


# Points of a strip of the plane, and strips of one star at most.
STRIP_POINTS, STRIPS = 4096, 1024


def _nearest_in(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, best: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """Distance from each query to the nearest point nearer than ``best``, walking outwards from its
    place in the order of y until the step in y alone is as far; ``own`` are places to leave out."""
    order = np.argsort(y, kind="stable")
    x, y = x[order], y[order]
    at = np.searchsorted(y, qy)
    if own is not None:
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, skip = place[own], place[own]
    best = best.copy()
    for step in (1, -1):
        k = at + (0 if own is None else step) if step > 0 else at - 1
        live = np.arange(len(qx))
        while len(live):
            inside = (k >= 0) & (k < len(y))
            live, k = live[inside], k[inside]
            dy = np.abs(y[k] - qy[live])
            near = dy < best[live]
            live, k, dy = live[near], k[near], dy[near]
            best[live] = np.minimum(best[live], np.hypot(x[k] - qx[live], dy))
            k = k + step
    return best


def scar(pgram: DataFrame, top: float = 0.9) -> DataFrame:
    """90th percentile of the nearest-neighbour distance among the points of the highest s2n, in the
    plane of scaled period and epoch phase (needs ``Pcad, t0cad, s2n``).

    Points in the same place are each other's neighbours at distance 0; a lone point has none and does
    not count. The plane of a star is cut into strips of about STRIP_POINTS points by quantiles of the
    period. A strip finds the neighbours among its own points; a point goes on only to strips that lie
    nearer than the neighbour it has, so the distances are exact and few points move twice.
    """
    cut = stats.group_quantiles(pgram, ["star"], {"_c": F.col("s2n")}, top)
    p = pgram.join(cut, "star").where("s2n > _c").select("star", "Pcad", (F.col("t0cad") / F.col("Pcad")).alias("y"))
    p = cut_lineage(p.withColumn("_id", F.monotonically_increasing_id()))
    lim = p.groupBy("star").agg(
        F.min("Pcad").alias("_lo"), F.max("Pcad").alias("_hi"), F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("Pcad", [k / STRIPS for k in range(1, STRIPS)], 10 * STRIPS).alias("_q"),
    )
    # Of the quantiles every so many are edges; equal ones are one.
    every = F.greatest(F.floor(F.lit(STRIPS) * STRIP_POINTS / F.col("_n")), F.lit(1)).cast("int")
    edges = F.array_distinct(F.filter("_q", lambda v, k: (k + 1) % every == 0))
    scaled = lambda v: F.coalesce(stats.safe_div(v - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    lim = lim.withColumn("_e", edges).select("star", "_lo", "_hi", F.transform("_e", scaled).alias("_e"))
    p = p.join(lim, "star").select("star", "_id", scaled(F.col("Pcad")).alias("x"), "y", "_e")
    p = cut_lineage(p.withColumn("_k", F.size(F.filter("_e", lambda v: v < F.col("x")))))

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group["x"].to_numpy(), group["y"].to_numpy()
        d = _nearest_in(x, y, x, y, np.full(len(x), np.inf), np.arange(len(x)))
        return pd.DataFrame({"star": group["star"], "_id": group["_id"], "d": d})

    def beyond(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        d = _nearest_in(*(f[c].to_numpy() for f in (points, asked) for c in ("x", "y")), asked["d"].to_numpy(), None)
        return pd.DataFrame({"star": asked["star"], "_id": asked["_id"], "d": d})

    shape = "star string, _id long, d double"
    own = cut_lineage(p.select("star", "_id", "x", "y", "_k").groupBy("star", "_k").applyInPandas(inside, shape))
    # Strip k lies between edges k - 1 and k.
    low = F.size(F.filter("_e", lambda v: v < F.col("x") - F.col("d")))
    high = F.size(F.filter("_e", lambda v: v < F.col("x") + F.col("d")))
    ask = p.join(own, ["star", "_id"]).withColumn("_to", F.explode(F.sequence(low, high))).where("_to <> _k")
    ask = cut_lineage(ask.select("star", "_id", "x", "y", "d", F.col("_to").alias("_k")))
    more = p.select("star", "_id", "x", "y", "_k").groupBy("star", "_k").cogroup(ask.groupBy("star", "_k")).applyInPandas(beyond, shape)
    least = own.unionByName(more).groupBy("star", "_id").agg(F.min("d").alias("d")).where("d < double('infinity')")
    return stats.group_quantiles(least, ["star"], {"scar": F.col("d")}, 0.9)


# Fixed values.
HARMONICS = (1.0, 1 / 2, 1 / 3, 2.0, 3.0)


def check_harmonics(depths: DataFrame, candidates: DataFrame, harmonics: Sequence[float] = HARMONICS) -> DataFrame:
    """MES on multiples of the period (below a third of the baseline) relative to that of the first,
    and whether another one is larger. ``depths`` is the single-event table of one duration."""
    x = fold.with_index(depths)
    span = x.groupBy("star").agg(
        (F.max("t") - F.min("t")).alias("_tb"), (F.max("i") - F.min("i")).alias("_ni")
    ).withColumn("_dt", stats.safe_div(F.col("_tb"), F.col("_ni")))
    h = candidates.select("star", "P").join(span, "star").withColumn("harm", F.explode(F.array(*[F.lit(v) for v in harmonics])))
    h = h.where(F.col("P") * F.col("harm") < F.col("_tb") / 3.0).withColumn("_pc", F.col("P") * F.col("harm") / F.col("_dt"))
    y = fold.wrap_shifted(x.join(h.select("star", "harm", "_pc"), "star"), F.col("_pc"))
    g = y.groupBy("star", "harm", "col").agg(F.avg("d").alias("m"), F.count("d").alias("c"))
    mes = g.groupBy("star", "harm").agg(F.max(F.col("m") * F.sqrt("c")).alias("mes"))
    w = Window.partitionBy("star")
    first = F.max(F.when(F.col("harm") == harmonics[0], F.col("mes"))).over(w)
    mes = mes.withColumn("ratio", stats.safe_div(F.col("mes"), first))
    order = F.array_position(F.array(*[F.lit(v) for v in harmonics]), F.col("harm"))
    best = F.max(F.struct(F.col("ratio"), (-order).alias("o"), F.col("harm"))).over(w)
    return mes.select("star", "harm", "mes", "ratio", (best["harm"] == F.col("harm")).alias("best"))


def s2n_known(
    df: DataFrame, known: DataFrame, twds: Sequence[int], p_limits: tuple[int, int]
) -> DataFrame:
    """s2n at the grid point nearest to a known signal (``star, P, phase, tdur``).

    Nearest duration, then the fast fold at floor(P) cadences, the only base period that is folded, and
    its nearest fractional period, then the epoch of the nearest phase (the shorter way round). Signals
    with floor(P) outside ``p_limits`` give no row.
    """
    df = staged(df)
    d = windows.mean_depth(df, twds)
    noise = windows.noise_per_duration(d)
    x = fold.with_index(d)
    base = x.groupBy("star").agg(
        F.min("t").alias("t_first"), stats.safe_div(F.max("t") - F.min("t"), F.max("i")).alias("dt")
    )
    k = known.join(base, "star")
    want = F.col("tdur") / F.col("dt")
    choice = F.array_min(
        F.array(*[F.struct(F.abs(F.lit(float(w)) - want).alias("d"), F.lit(w).cast("int").alias("w")) for w in twds])
    )
    k = k.withColumns({"twd": choice["w"], "P0": F.floor(F.col("P") / F.col("dt"))})
    k = k.where((F.col("P0") >= p_limits[0]) & (F.col("P0") < p_limits[1]))
    y = x.where("d IS NOT NULL").join(k.select("star", "twd", "P0").distinct(), ["star", "twd"])
    sums = {"s": F.col("d"), "n": F.lit(1).cast("long")}
    f = fold.fold_ffa(y, F.col("P0"), F.col("P0") + 1, sums, ("star", "twd"), p_limits[0])
    j = f.join(k, ["star", "twd", "P0"])
    dp = F.abs(F.col("Pcad") - F.col("P") / F.col("dt"))
    near = j.groupBy("star").agg(F.min(F.struct(dp.alias("d"), F.col("row").alias("row"))).alias("_m")).select("star", F.col("_m.row").alias("row"))
    z = j.join(near, ["star", "row"]).join(noise, ["star", "twd"])
    Pc = F.col("Pcad") * F.col("dt")
    phase = F.pmod(F.col("t_first") + F.col("col") * F.col("dt"), Pc) / Pc
    away = F.abs(phase - F.col("phase"))
    z = z.withColumns(
        {
            "_ph": phase,
            "_away": F.least(away, F.lit(1.0) - away),
            "s2n": stats.safe_div(stats.safe_div(F.col("s"), F.col("n")), F.col("noise")) * F.sqrt("n"),
        }
    )
    best = stats.top_row(z, ["star"], [-F.col("_away"), -F.col("col")], ["twd", "Pcad", "dt", "_ph", "s2n"])
    return best.select(
        "star", F.col("twd").alias("twd_close"), (F.col("Pcad") * F.col("dt")).alias("P_close"),
        F.col("_ph").alias("phase_close"), F.col("s2n").alias("s2n_close"),
    )


def expected_transits(df: DataFrame, ephemerides: DataFrame, near: float = 0.3) -> DataFrame:
    """For each expected transit whether the nearest point lies within ``near`` days and is unmasked.

    The transit numbers run from floor((epoch - t_first)/P) to floor((t_last - epoch)/P).
    """
    span = df.groupBy("star").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    e = ephemerides.join(span, "star")
    lo, hi = F.floor((F.col("epoch") - F.col("_a")) / F.col("P")), F.floor((F.col("_b") - F.col("epoch")) / F.col("P"))
    want = e.where(lo <= hi).select("star", F.explode(F.sequence(lo, hi)).alias("k"))
    x = df.join(ephemerides.select("star", "P", "epoch"), "star")
    u = (F.col("t") - F.col("epoch"))
    k = F.sequence(F.ceil((u - near) / F.col("P")), F.floor((u + near) / F.col("P")))
    some = F.ceil((u - near) / F.col("P")) <= F.floor((u + near) / F.col("P"))
    x = x.where(some).withColumn("k", F.explode(k))
    dt = F.abs(F.col("t") - (F.col("epoch") + F.col("k") * F.col("P")))
    hit = x.withColumn("_dt", dt).where(F.col("_dt") < near).groupBy("star", "k").agg(
        F.min(F.struct("_dt", "t", "fmask")).alias("_m")
    )
    return want.join(hit, ["star", "k"], "left").select(
        "star", "k", F.coalesce(~F.col("_m.fmask"), F.lit(False)).alias("seen")
    )


def ses_stack(df: DataFrame, candidates: DataFrame, twd: int) -> DataFrame:
    """Single-event depth by cycle and phase, the cycle starting at phase -0.25."""
    d = windows.mean_depth(df, (twd,))
    return fold_on(d, candidates, -0.25).select("star", "cycle", "phase", "t_phasefold", "d")


def phasefold_shifted(df: DataFrame, candidates: DataFrame, shift: float, dt: float) -> DataFrame:
    """Binned fold with the reference phase moved by ``shift``; empty bins are left out."""
    cand = candidates.withColumn("t0", F.col("t0") + F.col("P") * shift)
    x = fold_on(df, cand, -0.25)
    return bin_phasefold(x, phase_bin_spans(candidates, dt, -0.25)).where("fcount > 0")


def robust_limits(df: DataFrame, col: str, p: float, fac: float, keys: Sequence[str] = ("star",)) -> DataFrame:
    """p-th and (100-p)-th percentile, widened by ``fac`` times their span."""
    lo = stats.group_quantiles(df, keys, {"_lo": F.col(col)}, p / 100.0)
    hi = stats.group_quantiles(df, keys, {"_hi": F.col(col)}, 1 - p / 100.0)
    span = F.col("_hi") - F.col("_lo")
    return lo.join(hi, list(keys)).select(*keys, (F.col("_lo") - span * fac).alias("lo"), (F.col("_hi") + span * fac).alias("hi"))


def rebin_transits(sections: DataFrame, bfac: int, cadence: float) -> DataFrame:
    """Average ``bfac`` consecutive transits in bins one cadence wide (``transit_id, x, y``).

    The last group is left out when no transit follows it.
    """
    w = Window.partitionBy("star")
    ids = sections.select("star", "transit_id").distinct()
    rank = F.row_number().over(Window.partitionBy("star").orderBy("transit_id")) - 1
    ids = ids.withColumn("_k", rank).withColumn("_n", F.max("_k").over(w) + 1)
    ids = ids.withColumn("grp", F.floor(F.col("_k") / bfac)).where((F.col("grp") + 1) * bfac < F.col("_n"))
    x = sections.join(ids.select("star", "transit_id", "grp"), ["star", "transit_id"])
    lim = x.groupBy("star", "grp").agg(F.min("x").alias("lo"), F.max("x").alias("_hi"))
    lim = lim.withColumns({"hi": F.col("_hi") + 0.0001, "nb": F.floor(F.round((F.col("_hi") - F.col("lo")) / cadence, 9))}).where("nb >= 1")
    x = x.join(lim.drop("_hi"), ["star", "grp"])
    x = x.withColumn("bin", histogram_bin(F.col("x"), F.col("lo"), F.col("hi"), F.col("nb")))
    step = (F.col("hi") - F.col("lo")) / F.col("nb")
    return x.groupBy("star", "grp", "bin").agg(
        F.first(F.col("lo") + (F.col("bin") + 0.5) * step).alias("x"), F.avg("y").alias("y"), F.count("y").alias("n")
    )
