"""Cleaning, masking and gap handling.

A light curve is one row per (star, cad) with ``t, f, ferr, fmask`` and optional ``quality,
quarter``; ``fmask`` true means excluded.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import stats
from starfold.functions.frames import STRETCH, partition_sql, scan, with_ends, with_frames
from starfold.session import cut_lineage

VALID = "NOT fmask AND f IS NOT NULL"


def valid() -> Column:
    return F.expr(VALID)


def flux() -> Column:
    """Flux where valid, else NULL."""
    return F.when(valid(), F.col("f"))


# ---- quarters -------------------------------------------------------------------------------


def normalize_quarter(df: DataFrame, pairs=(("f", "ferr"),), out=(("f", "ferr"),)) -> DataFrame:
    """value/median - 1 and error/median, medians per (star, quarter)."""
    clean = df.withColumns({c: stats.nan_to_null(F.col(c)) for p in pairs for c in p})
    meds = {f"_m{i}": F.col(v) for i, (v, _) in enumerate(pairs)}
    df = stats.with_medians(clean, ["star", "quarter"], meds)
    new = {}
    for i, ((v, e), (ov, oe)) in enumerate(zip(pairs, out)):
        new[ov] = stats.safe_div(F.col(v), F.col(f"_m{i}")) - 1
        new[oe] = stats.safe_div(F.col(e), F.col(f"_m{i}"))
    return df.withColumns(new).drop(*meds)


def stitch_levels(df: DataFrame, width: float = 0.5) -> DataFrame:
    """Scale each quarter so that its first ``width`` days match the last ones before it."""
    k = ["star", "quarter"]
    spans = df.groupBy(*k).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    x = df.join(spans, k)
    edges = stats.group_medians(
        x,
        k,
        {
            "head": F.when(F.col("t") < F.col("_a") + width, flux()),
            "tail": F.when(F.col("t") > F.col("_b") - width, flux()),
        },
    )
    w = Window.partitionBy("star").orderBy("quarter")
    step = stats.safe_div(F.lag("tail").over(w), F.col("head"))
    chain = edges.withColumn("_r", F.coalesce(step, F.lit(1.0)))
    chain = chain.withColumn("_l", F.sum(F.ln(F.abs("_r"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chain = chain.withColumn(
        "_neg", F.sum((F.col("_r") < 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    factor = F.exp("_l") * F.when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    return df.join(chain.select(*k, factor.alias("factor")), k).withColumn("f", F.col("f") * F.col("factor"))


# ---- gaps -----------------------------------------------------------------------------------


def cadence_spine(df: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Every cadence from first to last; long series are laid out stretch by stretch."""
    span = df.groupBy("star").agg(F.min("cad").alias("_a"), F.max("cad").alias("_b"))
    parts = span.withColumn(
        "_s", F.explode(F.sequence(F.floor(F.col("_a") / stretch), F.floor(F.col("_b") / stretch)))
    )
    first = F.greatest("_a", F.col("_s") * stretch)
    last = F.least("_b", (F.col("_s") + 1) * stretch - 1)
    return parts.select("star", F.explode(F.sequence(first, last)).alias("cad"))


def cadence_fill(df: DataFrame, per_day: float | None = None, unique: bool = False) -> DataFrame:
    """Gap-free cadences; a cadence seen more than once counts as missing. New rows are masked.

    ``unique`` says that cadences do not repeat, which saves the grouping.
    """
    once = df if unique else drop_repeated_cadences(df)
    out = cadence_spine(df).join(once, ["star", "cad"], "left")
    out = out.withColumn("fmask", F.coalesce("fmask", F.lit(True)))
    if per_day is not None:
        out = out.withColumn("t", F.col("cad") / F.lit(float(per_day)))
    return out


def drop_repeated_cadences(df: DataFrame) -> DataFrame:
    """Only the cadences present exactly once."""
    agg = [F.first(c).alias(c) for c in df.columns if c not in ("star", "cad")]
    return df.groupBy("star", "cad").agg(F.count(F.lit(1)).alias("_n"), *agg).where("_n = 1").select(*df.columns)


def interp_masked(
    df: DataFrame,
    y: str,
    ok: Column,
    out: str | None = None,
    x: str = "cad",
    n_contig: int | None = None,
    edge: str = "extrapolate",
) -> DataFrame:
    """Linear interpolation of ``y`` over the rows where ``ok`` is false.

    Beyond the outermost good points the line through the nearest two is extended
    (``edge='extrapolate'``) or the nearest value held (``'hold'``). Runs longer than ``n_contig``
    rows are left as they are.
    """
    out = out or y
    yv, xv = F.col(y).cast("double"), F.col(x).cast("double")
    pt = F.when(ok, F.struct(xv.alias("x"), yv.alias("y")))
    a = scan(df, {"_p": ("last", pt), "_n": ("next", pt)}, strict=True)
    here = F.when(
        ok,
        F.struct(
            xv.alias("x"), yv.alias("y"),
            F.col("_p.x").alias("px"), F.col("_p.y").alias("py"),
            F.col("_n.x").alias("nx"), F.col("_n.y").alias("ny"),
        ),
    )
    b = scan(a, {"_L": ("last", here), "_R": ("next", here)})

    def line(x0, y0, x1, y1):
        return F.col(y0) + (F.col(y1) - F.col(y0)) * stats.safe_div(xv - F.col(x0), F.col(x1) - F.col(x0))

    inside = line("_L.x", "_L.y", "_R.x", "_R.y")
    if edge == "extrapolate":
        right = F.coalesce(line("_L.px", "_L.py", "_L.x", "_L.y"), F.col("_L.y"))
        left = F.coalesce(line("_R.x", "_R.y", "_R.nx", "_R.ny"), F.col("_R.y"))
    else:
        right, left = F.col("_L.y"), F.col("_R.y")
    value = (
        F.when(F.col("_L").isNotNull() & F.col("_R").isNotNull(), inside)
        .when(F.col("_L").isNotNull(), right)
        .when(F.col("_R").isNotNull(), left)
    )
    fill = ~F.coalesce(ok, F.lit(False))
    if n_contig is not None:
        b = with_ends(b)
        run = F.coalesce(F.col("_R.x"), F.col("_b") + 1) - F.coalesce(F.col("_L.x"), F.col("_a") - 1) - 1
        fill = fill & (run <= n_contig)
    cols = [c for c in df.columns if c != out]
    return b.select(*cols, F.when(fill, value).otherwise(yv).alias(out))


def stitch_quarters(df: DataFrame) -> DataFrame:
    """All quarters of a star on one gap-free cadence axis: floats NULL, masks true, t interpolated."""
    return interp_masked(cadence_fill(drop_repeated_cadences(df)), "t", F.col("t").isNotNull())


# ---- masks ----------------------------------------------------------------------------------


def parse_quality(df: DataFrame, bits: Mapping[int, str], col: str = "quality") -> DataFrame:
    """One boolean per named bit; bit numbers start at 1."""
    q = F.coalesce(F.col(col), F.lit(0))
    return df.withColumns({k: F.getbit(q, F.lit(b - 1)) == 1 for b, k in bits.items()})


def mask_regions(
    df: DataFrame, regions: DataFrame, out: str = "is_bad_region", width: float = 64.0
) -> DataFrame:
    """True where t lies in any [start, stop].

    Regions are cut into time buckets of ``width`` and merged per bucket to one row, so the join is
    an equi-join that cannot multiply light-curve rows.
    """
    cut = regions.select(
        "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("_b")
    )
    w = Window.partitionBy("_b").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    isle = cut.withColumn("_new", F.when(reach >= F.col("start"), 0).otherwise(1))
    isle = isle.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = isle.groupBy("_b", "_i").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    per = merged.groupBy("_b").agg(F.collect_list(F.struct("start", "stop")).alias("_r"))
    t = F.col("t")
    hit = F.exists("_r", lambda r: (t >= r["start"]) & (t <= r["stop"]))
    return (
        df.withColumn("_b", F.floor(t / width))
        .join(per, "_b", "left")
        .withColumn(out, F.coalesce(hit, F.lit(False)))
        .drop("_b", "_r")
    )


def grow_mask(df: DataFrame, flag: str, before: int, after: int, out: str | None = None) -> DataFrame:
    """A row is set when any row from ``before`` back to ``after`` ahead is."""
    return with_frames(
        df, before, after, lambda w: {out or flag: F.max(F.col(flag)).over(w.rangeBetween(-before, after))}
    )


def mask_discontinuity(df: DataFrame, flag: str, out: str = "is_dis") -> DataFrame:
    """From 4 cadences before a flagged one to 50 after it."""
    return grow_mask(df, flag, 50, 4, out)


def sorted_frame_element(values: Column, rank: int) -> Column:
    return F.get(F.sort_array(values), F.lit(rank))


def median_filter(df: DataFrame, col: str, size: int, out: str) -> DataFrame:
    """Running element of rank size//2 over ``size`` cadences, ends mirrored.

    Expects a gap-free series without NULLs in ``col``.
    """
    back, ahead = size // 2, size - 1 - size // 2
    c = F.col("cad")
    mirrored = F.array(
        c,
        F.when(c < F.col("_a") + back, 2 * F.col("_a") - 1 - c),
        F.when(c > F.col("_b") - ahead, 2 * F.col("_b") + 1 - c),
    )
    padded = (
        with_ends(df)
        .withColumn("_at", F.explode(mirrored))
        .where(F.col("_at").isNotNull())
    )
    done = with_frames(
        padded,
        back,
        ahead,
        lambda w: {out: sorted_frame_element(F.collect_list(col).over(w.rangeBetween(-back, ahead)), size // 2)},
        order="_at",
    )
    return done.where(F.col("_at") == c).drop("_at", "_a", "_b")


def masked_median_filter(df: DataFrame, size: int, out: str = "fmed") -> DataFrame:
    """Masked flux interpolated (ends held), then the running median."""
    filled = interp_masked(df, "f", valid(), out="_fi", edge="hold")
    return median_filter(filled, "_fi", size, out).drop("_fi")


def mask_outliers(
    df: DataFrame, lims: tuple[float, float] = (-10.0, 10.0), interp: str = "linear", out: str = "is_outlier"
) -> DataFrame:
    """Single-point outliers of f minus its 4-point running median, in units of 1.48 x median|.|."""
    if interp == "linear":
        x = interp_masked(df, "f", valid(), out="_fi", edge="hold")
    elif interp == "constant":
        x = df.withColumn("_fi", F.coalesce(flux(), F.lit(0.0)))
    else:
        raise ValueError(interp)
    # Written before the median, which reads it three times.
    x = cut_lineage(median_filter(x, "_fi", 4, "_fm").withColumn("_hp", F.col("_fi") - F.col("_fm")))
    x = stats.with_medians(x, ["star"], {"_mad": F.abs("_hp")})
    sig = F.col("_mad") * 1.48
    bad = (F.col("_hp") < sig * lims[0]) | (F.col("_hp") > sig * lims[1])
    return x.withColumn(out, bad).drop("_fi", "_fm", "_hp", "_mad")


def mask_steps(
    df: DataFrame, size: int = 50, scale: int = 20, nsig: float = 7.0, back: float = 0.5, ahead: float = 2.0,
    min_valid: int = 20, out: str = "is_step",
) -> DataFrame:
    """Level steps: running median over ``size`` cadences, compared ``scale`` cadences later.

    Everything from ``back`` days before to ``ahead`` days after a hit is masked. The hit is placed
    at the middle of the compared stretch.
    """
    ok = flux()
    w1 = with_frames(
        df,
        0,
        size - 1,
        lambda w: {
            "_n": F.count(ok).over(w.rangeBetween(0, size - 1)),
            "_md": F.percentile(ok, 0.5).over(w.rangeBetween(0, size - 1)),
            "_full": F.count(F.lit(1)).over(w.rangeBetween(0, size - 1)),
        },
    ).withColumn("_md", F.when((F.col("_n") >= min_valid) & (F.col("_full") == size), F.col("_md")))
    w2 = with_ends(
        with_frames(w1, 0, scale, lambda w: {"_later": F.first("_md").over(w.rangeBetween(scale, scale))})
    )
    inside = F.col("cad") + size + scale <= F.col("_b")
    w2 = cut_lineage(w2.withColumn("_step", F.when(inside, F.col("_md") - F.col("_later"))))
    w2 = stats.with_medians(w2, ["star"], {"_ms": F.abs("_step")})
    w2 = w2.withColumn("_hit", F.coalesce(F.abs("_step") > F.col("_ms") * nsig, F.lit(False)))
    mid = (size + scale) // 2
    w3 = with_frames(
        w2, mid, 0, lambda w: {"_at": F.max("_hit").over(w.rangeBetween(-mid, -mid))}
    ).withColumn("_at", F.coalesce("_at", F.lit(False)))
    near = F.expr(
        f"max(_at) OVER (PARTITION BY {partition_sql()} ORDER BY t "
        f"RANGE BETWEEN {float(ahead)!r}D PRECEDING AND {float(back)!r}D FOLLOWING)"
    )
    w4 = with_frames(w3, ahead, back, lambda w: {out: near}, order="t")
    return w4.select(*df.columns, out)


def quality_mask(
    df: DataFrame, regions: DataFrame, bits: Mapping[int, str],
    lims: tuple[float, float] = (-10.0, 10.0), grow: Mapping[str, int] | None = None,
) -> DataFrame:
    """Combined exclusion mask ``fmask`` and segment-end flag ``seg_end``.

    ``bits`` is the archive's table of flags (bit number to name) and must name ``desat`` and
    ``at_tweak``; each is grown by the given cadences both ways.
    """
    grow = grow or {"desat": 1, "at_tweak": 4}
    x = df.withColumn("fmask", F.col("fmask") | F.col("f").isNull())
    x = mask_regions(x, regions)
    x = mask_outliers(x, lims)
    x = x.withColumn("fmask", F.col("fmask") | F.col("is_bad_region") | F.col("is_outlier"))
    x = mask_steps(x)
    x = parse_quality(x, bits)
    most = max(grow.values(), default=0)
    x = with_frames(x, most, most, lambda w: {k: F.max(F.col(k)).over(w.rangeBetween(-n, n)) for k, n in grow.items()})
    return x.withColumns(
        {
            "fmask": F.col("fmask") | F.col("is_step") | F.col("desat") | F.col("at_tweak"),
            "seg_end": F.col("is_bad_region") | F.col("at_tweak") | F.col("is_step"),
        }
    )


def segment_labels(df: DataFrame, nsep: float, ok: Column | None = None, out: str = "segment") -> DataFrame:
    """Islands of valid rows; gaps shorter than ``nsep`` cadences are bridged and belong to the
    island. Rows in longer gaps get NULL."""
    ok = valid() if ok is None else ok
    x = df.withColumn("_ok", ok)
    pt = F.when(F.col("_ok"), F.col("cad"))
    x = scan(x, {"_p": ("last", pt), "_n": ("next", pt)}, strict=True)
    x = with_ends(x)
    left = F.coalesce("_p", F.col("_a") - 1)
    right = F.coalesce("_n", F.col("_b") + 1)
    member = F.col("_ok") | (right - left - 1 < nsep)
    # A new island starts at a valid row after a long gap, or at the first member row of all.
    gap = F.col("cad") - left - 1
    start = (F.col("_ok") & (gap >= nsep) & (gap > 0)) | (
        (F.col("cad") == F.col("_a")) & member
    )
    x = x.withColumns({"_m": member, "_st": start.cast("long")})
    x = scan(x, {"_k": ("sum", F.col("_st"))})
    return x.select(*df.columns, F.when(F.col("_m"), F.col("_k") - 1).alias(out))


def join_segments(df: DataFrame, a: str, b: str, out: str = "segment") -> DataFrame:
    """A new label whenever the pair of labels changes between labelled rows."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    pair = F.when(both, F.struct(F.col(a).alias("a"), F.col(b).alias("b")))
    x = scan(df.withColumn("_pair", pair), {"_prev": ("last", F.col("_pair"))}, strict=True)
    change = F.when(F.col("_prev").isNull(), 0).otherwise((F.col("_pair") != F.col("_prev")).cast("int"))
    x = x.withColumn("_chg", F.when(F.col("_pair").isNotNull(), change).otherwise(0).cast("long"))
    x = scan(x, {"_k": ("sum", F.col("_chg"))})
    return x.select(*df.columns, F.when(F.col("_pair").isNotNull(), F.col("_k")).alias(out))


# Time buckets over which cut ranges are numbered: so many rows come to the driver at most.
RANK_BUCKETS = 4096


def numbered_spans(regions: DataFrame) -> DataFrame:
    """(_i, _lo, _hi): the spans between the end of each cut and the start of the next, numbered in
    order of starts.

    Cuts are ranked inside time buckets; one summary row per bucket (its number of cuts and its first
    start) carries rank and next start over to the others.
    """
    cuts = regions.select(F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    ends = cuts.agg(F.min("start").alias("a"), F.max("start").alias("b")).first()
    low, span = ends["a"] or 0.0, (ends["b"] or 0.0) - (ends["a"] or 0.0)
    step = span / RANK_BUCKETS or 1.0
    bucket = F.least(F.floor((F.col("start") - low) / step), F.lit(RANK_BUCKETS - 1)).cast("long")
    cuts = cuts.withColumn("_k", bucket)
    rows = cuts.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first")).where("_k IS NOT NULL").orderBy("_k").collect()
    carry, before = [], 0
    for r, after in zip(rows, [*rows[1:], None]):
        carry.append((r["_k"], before, after and after["first"]))
        before += r["n"]
    carried = regions.sparkSession.createDataFrame(carry, "_k LONG, _before LONG, _next DOUBLE")
    w = Window.partitionBy("_k").orderBy("start", "stop")
    x = cuts.withColumns({"_r": F.row_number().over(w) - 1, "_lead": F.lead("start").over(w)}).join(F.broadcast(carried), "_k")
    x = x.select((F.col("_r") + F.col("_before")).alias("_i"), F.col("stop").alias("_lo"), F.coalesce("_lead", "_next").alias("_hi"))
    return x.where("_hi IS NOT NULL")


def region_segments(df: DataFrame, regions: DataFrame, out: str = "segment", width: float = 64.0) -> DataFrame:
    """Label i between the end of cut i and the start of cut i+1 (strict); -1 elsewhere."""
    found = _range_lookup(df, numbered_spans(regions), "_i", width)
    return found.withColumn(out, F.coalesce("_i", F.lit(-1))).drop("_i")


def _range_lookup(df: DataFrame, spans: DataFrame, label: str, width: float) -> DataFrame:
    """The label of the open span (_lo, _hi) around t, as an equi-join on time buckets; NULL where
    none; the last span in label order where several."""
    cut = spans.withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width)))
    )
    per = cut.groupBy("_b").agg(
        F.sort_array(F.collect_list(F.struct(F.col(label).alias("k"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")))).alias("_r")
    )
    t = F.col("t")
    hits = F.filter("_r", lambda r: (t > r["lo"]) & (t < r["hi"]))
    return (
        df.withColumn("_b", F.floor(t / width))
        .join(per, "_b", "left")
        .withColumn(label, F.try_element_at(hits, F.lit(-1))["k"])
        .drop("_b", "_r")
    )


def assign_quarter(df: DataFrame, ranges: DataFrame, out: str = "q", width: float = 64.0) -> DataFrame:
    """Quarter with tstart < t < tstop, else -1."""
    spans = ranges.select(F.col("q").alias("_q"), F.col("tstart").alias("_lo"), F.col("tstop").alias("_hi"))
    return _range_lookup(df, spans, "_q", width).withColumn(out, F.coalesce("_q", F.lit(-1))).drop("_q")


def lookup_module(stars: DataFrame, modules: DataFrame, keys: Sequence[str] = ("star", "q")) -> DataFrame:
    """Attach the module row; fails where a key has several."""
    n = F.count(F.lit(1))
    one = modules.groupBy(*keys).agg(
        n.alias("_n"), *[F.min(c).alias(c) for c in modules.columns if c not in keys]
    )
    out = stars.join(one, list(keys), "left")
    ok = F.coalesce(F.col("_n"), F.lit(0)) == 1
    return out.where(F.assert_true(ok, F.lit("module lookup is not unique")).isNull()).drop("_n")


def mask_before_quarter(df: DataFrame, first: int, col: str = "quarter") -> DataFrame:
    return df.withColumn("fmask", F.col("fmask") | F.coalesce(F.col(col) < first, F.lit(False)))


def check_even(df: DataFrame, cadence: float, rtol: float = 1e-3) -> DataFrame:
    """Per star: spread of the time steps under cadence/100, and every step close to the median."""
    x = scan(df, {"_p": ("last", F.col("t"))}, strict=True)
    x = x.select("star", (F.col("t") - F.col("_p")).alias("_d")).where("_d IS NOT NULL")
    x = stats.with_medians(x, ["star"], {"dt": F.col("_d")})
    return x.groupBy("star").agg(
        F.first("dt").alias("dt"),
        (F.max("_d") - F.min("_d") < cadence / 100.0).alias("even_span"),
        F.bool_and(F.abs(F.col("_d") - F.col("dt")) <= 1e-8 + rtol * F.abs("dt")).alias("even_steps"),
    )


def preprocess(df: DataFrame, lims: tuple[float, float] = (-1e3, 10.0)) -> DataFrame:
    """Outlier mask of the median-subtracted flux; the stored flux is unchanged."""
    x = stats.with_medians(df, ["star"], {"_m": flux()})
    x = x.withColumns({"_raw": F.col("f"), "f": F.col("f") - F.col("_m")})
    x = mask_outliers(x, lims, "constant")
    return x.withColumns(
        {"fmask": F.col("fmask") | F.col("is_outlier") | F.col("_raw").isNull(), "f": F.col("_raw")}
    ).drop("_raw", "_m")


def mask_noisy_segments(df: DataFrame, stat: str, nsep: float, thresh: float = 2.0, out: str = "is_noisy") -> DataFrame:
    """Segments whose median |stat| is above ``thresh`` times the median of all segments'."""
    x = segment_labels(df, nsep, F.col(stat).isNotNull(), "_seg")
    seg = stats.group_medians(x.where("_seg IS NOT NULL"), ["star", "_seg"], {"_mad": F.abs(stat)})
    typ = stats.group_medians(seg, ["star"], {"_typ": F.col("_mad")})
    bad = seg.join(typ, "star").select("star", "_seg", (F.col("_mad") > F.col("_typ") * thresh).alias(out))
    return x.join(bad, ["star", "_seg"], "left").withColumn(out, F.coalesce(out, F.lit(False))).drop("_seg")


def mean_of_bins(df: DataFrame, nbin: int = 8) -> DataFrame:
    """Mean of every ``nbin`` consecutive rows of a gap-free series; time of the first row; bins
    without valid points are dropped."""
    return (
        with_ends(df)
        .groupBy("star", F.floor((F.col("cad") - F.col("_a")) / nbin).alias("bin"))
        .agg(F.min("t").alias("x"), F.avg(flux()).alias("y"))
        .where("y IS NOT NULL")
    )


def mean_of_valid(df: DataFrame, nbin: int = 8) -> DataFrame:
    """As ``mean_of_bins`` but counting valid rows only, as the detrending stage feeds it."""
    x = scan(df.where(valid()), {"_i": ("sum", F.lit(1))})
    return x.groupBy("star", F.floor((F.col("_i") - 1) / nbin).alias("bin")).agg(
        F.min("t").alias("x"), F.avg("f").alias("y")
    )


def map_per_quarter(
    df: DataFrame, fn: Callable[..., pd.DataFrame], schema: str, other: DataFrame | None = None, in_place: bool = False,
    keys: Sequence[str] = ("star", "quarter"),
) -> DataFrame:
    """Apply ``fn`` to the rows of every quarter.

    ``fn`` takes a quarter's rows and, with ``other``, the rows of that table for the same quarter (two
    tables need not have the same rows; a quarter that only one has comes with an empty other one). It
    returns rows of ``schema``, which are the result, a new group; with ``in_place`` they hold ``cad``
    and their other columns replace those of ``df``, whose remaining rows and columns stay.
    Each quarter is one task's work, a few thousand rows, sent and returned as Arrow.
    """
    keyed = df.groupBy(*keys)
    if other is None:
        out = keyed.applyInPandas(lambda q: fn(q), schema)
    else:
        out = keyed.cogroup(other.groupBy(*keys)).applyInPandas(lambda q, o: fn(q, o), schema)
    if not in_place:
        return out
    at = [*keys, "cad"]
    new = [c for c in out.columns if c not in at]
    made = out.select(*at, *[F.col(c).alias(f"_new_{c}") for c in new], F.lit(True).alias("_has"))
    x = df.join(made, at, "left")
    for c in new:
        x = x.withColumn(c, F.when(F.col("_has"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in df.columns else F.col(f"_new_{c}"))
    return x.drop("_has", *[f"_new_{c}" for c in new])
