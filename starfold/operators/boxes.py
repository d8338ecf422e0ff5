"""Box searches on folded tables: one plan, exchangeable scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import stats
from starfold.operators import fold


def running_sums(folded: DataFrame, keys: Sequence[str], n: Column, carry: Sequence[str] = ()) -> DataFrame:
    """One row per folded period: ``_r``, the running (c, s, ss) before each column and behind the last,
    ``_n`` columns, and the total count ``N``. Columns must be gap-free from 0 on.

    ``keys`` must hold the columns by which ``folded`` is partitioned. A period's array is as long as
    the period; the rows that boxes make of it only point into it.
    """
    run = Window.partitionBy(*keys).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    x = folded.withColumn("_n", n.cast("int")).withColumns({f"_r{c}": F.sum(c).over(run) for c in ("c", "s", "ss")})
    at = F.struct(F.col("col").cast("long").alias("at"), *[F.col(f"_r{c}").alias(c) for c in ("c", "s", "ss")])
    g = x.groupBy(*keys).agg(
        F.sort_array(F.collect_list(at)).alias("_a"), F.max("_n").alias("_n"), F.sum("c").alias("N"), *[F.first(c).alias(c) for c in carry]
    )
    zero = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"))
    a = F.transform("_a", lambda r: F.struct(r["at"], r["c"].cast("long").alias("c"), r["s"].cast("double").alias("s"), r["ss"].cast("double").alias("ss")))
    return g.withColumn("_r", F.concat(F.array(zero), a)).drop("_a")


def box_of(start: Column, width: Column, wrap: bool = True) -> dict[str, Column]:
    """Sums over ``width`` columns from ``start`` (0 to ``_n`` - 1) on, as differences of ``_r``."""
    r, n = F.col("_r"), F.col("_n")
    end = start + width
    last = F.least(end, n)
    out = {c: F.get(r, last)[c] - F.get(r, start)[c] for c in ("c", "s", "ss")}
    if wrap:
        out = {c: v + F.get(r, end - last)[c] for c, v in out.items()}
    return out


def box_sums(
    folded: DataFrame, keys: Sequence[str], n: Column, widths: Column | Sequence[int], wrap: bool = True, carry: Sequence[str] = ()
) -> DataFrame:
    """Count and sums of every box (start ``col``, ``width``) of a folded table, and the total count N.

    A box is a difference of running sums, wherever its width comes from: ``widths`` are integers or an
    array column of the folded rows (the plan is the same for any number), no wider than the period.
    Without ``wrap`` boxes end within it. ``carry`` columns are constant per period.
    """
    x = running_sums(folded, keys, n, carry)
    w = widths if isinstance(widths, Column) else F.array(*[F.lit(int(k)) for k in widths])
    x = x.withColumn("width", F.explode(F.filter(w.cast("array<int>"), lambda k: (k > 0) & (k <= F.col("_n")))))
    last = F.col("_n") - 1 if wrap else F.col("_n") - F.col("width")
    x = x.withColumn("col", F.explode(F.sequence(F.lit(0), last)))
    sums = box_of(F.col("col"), F.col("width"), wrap)
    return x.select(*keys, F.col("col").cast("long").alias("col"), "width", *[v.alias(c) for c, v in sums.items()], "N", "_n", *carry)


def scores() -> dict[str, Column]:
    """Box scores by name; NULL where undefined."""
    c, s, ss, N = F.col("c"), F.col("s"), F.col("ss"), F.col("N")
    rest = ss - stats.safe_div(s * s, c)
    return {
        "sr": stats.safe_div(s * s, c * (N - c)),
        "sr_pos": F.when(s < 0, stats.safe_div(s * s, c * (N - c))),
        "snr": F.when(rest > 0, stats.safe_div(-s * N, (N - c) * F.sqrt(rest))),
        "snr2": F.when((s < 0) & (rest > 0), stats.safe_div(s * s, rest)),
        "depth_snr": F.when(rest > 0, stats.safe_div(-s, F.sqrt(rest))),
    }


def box_stat(folded: DataFrame, keys: Sequence[str], n: Column, w1: int, w2: int, stat: str = "sr") -> DataFrame:
    """Best wrapping box per folded period for widths w1..w2: ``power`` (the root for the squared
    scores), ``width`` and start ``col``; the first of equals."""
    b = box_sums(folded, keys, n, F.sequence(F.lit(w1), F.lit(w2)))
    b = b.withColumn("power", scores()[stat]).where("power > 0")
    best = stats.top_row(b, keys, [F.col("power"), -F.col("col"), -F.col("width")], ["power", "col", "width"])
    return best if stat == "snr" else best.withColumn("power", F.sqrt("power"))


def box_stat_fractional(folded: DataFrame, keys: Sequence[str], n: Column, qmi: float, qmax: float) -> DataFrame:
    """``sr`` with widths between fractions of each period's number of columns."""
    n = n.cast("int")
    lo, hi = F.greatest(F.floor(n * qmi), F.lit(1)).cast("int"), F.floor(n * qmax).cast("int")
    widths = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    b = box_sums(folded.withColumn("_w", widths), keys, n, F.col("_w"), carry=["_w"]).drop("_w")
    b = b.withColumn("power", scores()["sr"]).where("power > 0")
    best = stats.top_row(b, keys, [F.col("power"), -F.col("col"), -F.col("width")], ["power", "col", "width"])
    return best.withColumn("power", F.sqrt("power"))


def search_bls(
    df: DataFrame, p1: float | None, p2: float | None, w1: int | None, w2: int | None, min_count: int | None = None,
    periods: DataFrame | None = None,
) -> DataFrame:
    """Fold on fractional periods, then the box whose mean is deepest in units of its error.

    A box needs more points than columns, or more than ``min_count`` where that is given. With
    ``periods`` (star, seg, p1, p2, twdG) limits differ per star and segment, and a segment's
    boxes are as wide as the first to the last of its durations.
    """
    x = fold.with_index(df)
    if periods is None:
        seg, y = [], x.withColumns({"p1": F.lit(float(p1)), "p2": F.lit(float(p2)), "_w": F.sequence(F.lit(w1), F.lit(w2))})
    else:
        seg = ["seg"]
        lim = periods.select("star", "seg", "p1", "p2", F.sequence(F.element_at("twdG", 1), F.element_at("twdG", -1)).alias("_w"))
        y = x.join(lim, "star")
    folded, by = fold.fold_columns(
        y, F.col("p1"), F.col("p2"), "f", F.expr("NOT fmask AND f IS NOT NULL"),
        lambda P: fold.frac_periods(P, F.col("ncad")), ("star", *seg), ["_w"],
    )
    keys = [*by, "Pcad"]
    ncol = F.max("col").over(Window.partitionBy(*keys)) + 1
    b = box_sums(folded, keys, ncol, F.col("_w"), carry=["_w"])
    c, s = F.col("c"), F.col("s")
    floor = F.col("width") if min_count is None else F.lit(min_count)
    var = stats.safe_div(c * F.col("ss") - s * s, c * (c - 1))
    b = b.where((c > floor) & (c > 1)).withColumn("noise", F.sqrt(F.when(var > 0, var)) / F.sqrt("c"))
    b = b.withColumn("s2n", stats.safe_div(-s, c * F.col("noise"))).where("s2n > -1")
    best = stats.top_row(
        b, keys, [F.col("s2n"), -F.col("col"), -F.col("width")], ["s2n", "width", "col", "noise", "s", "c"]
    )
    dt = x.groupBy("star").agg(
        F.first("t_first").alias("t_first"),
        stats.safe_div(F.max("t") - F.min("t"), F.max("i") - F.min("i")).alias("_dt"),
    )
    return best.join(dt, "star").select(
        "star", *seg, "Pcad", F.col("width").alias("twd"), "col", "s2n", "noise",
        (-F.col("s") / F.col("c")).alias("mean"),
        (F.col("t_first") + (F.col("col") + F.floor(F.col("width") / 2)) * F.col("_dt")).alias("t0"),
    )


def binned_snr(
    df: DataFrame, period: Callable[[Column], Column], n: int | Column, nb: int, qmi: float, qma: float, min_points: int = 40
) -> DataFrame:
    """sqrt(max s^2/(ss - s^2/n)) over dimming boxes with at least ``min_points`` points, per period;
    0 where there is none. ``period`` gives the period of an index from 0 to ``n`` - 1."""
    x = fold.with_index(df)
    folded, by = fold.fold_phase_bins(x, lambda j: F.lit(1.0) / period(j), n, nb, "f", F.expr("NOT fmask AND f IS NOT NULL"))
    keys = [*by, "jf", "freq"]
    b = box_sums(folded, keys, F.lit(nb), F.sequence(F.lit(max(1, int(nb * qmi))), F.lit(max(1, int(nb * qmi), int(nb * qma)))))
    score = F.when(F.col("c") >= min_points, scores()["snr2"])
    out = b.groupBy(*keys).agg(F.sqrt(F.coalesce(F.max(score), F.lit(0.0))).alias("snr"))
    return out.select("star", "jf", (F.lit(1.0) / F.col("freq")).alias("P"), "snr")


def bls_spectrum(
    df: DataFrame, nf: int, fmin: float, dfreq: float, nb: int, qmi: float, qma: float, snr: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Box power per frequency, and the best box per star.

    ``snr=False``: score s^2/(n(N-n)) without wrapping; ``snr=True``: -s/sqrt(ss - s^2/n) with boxes
    that wrap. The last of equal maxima wins. Requires fmin of at least one over the baseline.
    """
    x = fold.with_index(df)
    w = Window.partitionBy("star")
    ok = F.expr("NOT fmask AND f IS NOT NULL")
    base = x.where(ok).groupBy("star").agg(
        F.avg("f").alias("_mean"), F.count("f").alias("rn"), F.min("t").alias("_t1"), F.max("t").alias("_t2")
    )
    base = base.where(
        F.assert_true(F.lit(fmin) * (F.col("_t2") - F.col("_t1")) >= 1.0, F.lit("fmin is below 1/T")).isNull()
    )
    x = x.join(base, "star").withColumns({"_dev": F.when(ok, F.col("f") - F.col("_mean")), "t_first": F.col("_t1")})
    x = x.where(F.col("t") >= F.col("_t1"))
    # The first good row carries the empty bins.
    x = x.withColumn("i", F.when(F.col("t") == F.col("_t1"), 0).otherwise(F.col("i") + 1).cast("long"))
    folded, by = fold.fold_phase_bins(x, lambda j: F.lit(fmin) + j * dfreq, nf, nb, "_dev")
    keys = [*by, "jf", "freq"]
    kmi = max(1, int(qmi * nb))
    kma = int(qma * nb) + 1
    b = box_sums(folded, keys, F.lit(nb), F.sequence(F.lit(kmi), F.lit(kma + 1)), wrap=snr)
    b = b.join(base.select("star", "rn"), "star")
    kkmi = F.greatest(F.floor(F.col("rn") * qmi), F.lit(5))
    score = scores()["depth_snr"] if snr else scores()["sr"]
    b = b.withColumn("pow", F.when(F.col("c") >= kkmi, score))
    ok_box = F.col("pow") >= 0
    best = b.groupBy(*keys).agg(
        F.max(
            F.when(ok_box, F.struct("pow", F.col("col").alias("i1"), F.col("width").alias("k"), "c", "s"))
        ).alias("_m"),
        F.first("rn").alias("rn"),
    )
    power = F.coalesce(F.col("_m.pow"), F.lit(0.0))
    best = best.withColumn("p", power if snr else F.sqrt(power))
    spectrum = best.select("star", "jf", "freq", "p")
    top = stats.top_row(best.where("_m IS NOT NULL"), ["star"], [F.col("p"), F.col("jf")], ["jf", "freq", "p", "_m", "rn"])
    c, s, rn = F.col("_m.c"), F.col("_m.s"), F.col("rn")
    in2 = F.col("_m.i1") + F.col("_m.k")
    peak = top.select(
        "star", "jf", (F.lit(1.0) / F.col("freq")).alias("bper"), F.col("p").alias("bpow"),
        stats.safe_div(-s * rn, c * (rn - c)).alias("depth"),
        stats.safe_div(c, rn).alias("qtran"),
        (F.col("_m.i1") + 1).alias("in1"),
        F.when(in2 > nb, in2 - nb).otherwise(in2).alias("in2"),
    )
    return spectrum, peak


def local_continuum(folded: DataFrame, keys: Sequence[str], n: Column, widths: Column | Sequence[int]) -> DataFrame:
    """Per folded period the (width, epoch) with the largest depth below its two neighbouring boxes,
    in units of the scatter inside: depth/sigma*sqrt(n)."""
    x = running_sums(folded, keys, n)
    w = widths if isinstance(widths, Column) else F.array(*[F.lit(int(k)) for k in widths])
    x = x.withColumn("width", F.explode(F.filter(w, lambda k: (k > 0) & (k <= F.col("_n")))))
    x = x.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    n, k = F.col("_n"), F.col("width")
    mean = lambda d: stats.safe_div(d["s"], d["c"])
    here = box_of(F.col("col"), k)
    around = (mean(box_of(F.pmod(F.col("col") - k, n), k)) + mean(box_of(F.pmod(F.col("col") + k, n), k))) * 0.5
    x = x.select(*keys, F.col("col").cast("long").alias("col"), "width", here["c"].alias("c"), here["s"].alias("s"), here["ss"].alias("ss"), around.alias("_o"))
    m = stats.safe_div(F.col("s"), F.col("c"))
    var = stats.safe_div(F.col("ss"), F.col("c")) - m * m
    x = x.withColumn("s2n", stats.safe_div(F.col("_o") - m, F.sqrt(F.when(var > 0, var))) * F.sqrt("c")).where("s2n > 0")
    return stats.top_row(x, keys, [F.col("s2n"), -F.col("width"), -F.col("col")], ["s2n", "width", "col"])
