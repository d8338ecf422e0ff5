"""Period searches: score every (period, epoch, duration), keep the best."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import stats
from starfold.operators import fold, windows
from starfold.session import cut_lineage, staged


def best_epoch(folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per period the column with the largest mean (the first of equals)."""
    x = folded.withColumn("mean", stats.safe_div(F.col("s"), F.col("n"))).where("mean IS NOT NULL")
    return stats.top_row(x, keys, [F.col("mean"), -F.col("col")], ["mean", "col", "n"]).withColumnsRenamed(
        {"col": "t0cad", "n": "count"}
    )


def duration_period_epoch(
    df: DataFrame, p1: int | None, p2: int | None, twds: Sequence[int], periods: DataFrame | None = None
) -> DataFrame:
    """Single-event depths folded by the fast method, best epoch per (twd, period).

    With ``periods`` (star, seg, p1, p2, twdG) limits in cadences differ per star and segment, and a
    segment takes only its own durations out of ``twds``.
    """
    df = staged(df)
    d = windows.mean_depth(df, twds)
    noise = windows.noise_per_duration(d)
    x = fold.with_index(d).select("star", "twd", "i", "ncad", "d").where("d IS NOT NULL")
    sums = {"s": F.col("d"), "n": F.lit(1).cast("long")}
    seg = []
    if periods is None:
        folded = fold.fold_ffa(x, p1, p2, sums, ("star", "twd"))
    else:
        seg = ["seg"]
        lim = periods.select("star", "seg", F.greatest(F.floor("p1"), F.lit(1)).alias("p1"), F.ceil("p2").alias("p2"), F.explode("twdG").alias("twd"))
        least = int(lim.agg(F.min("p1")).first()[0] or 1)
        folded = fold.fold_ffa(x.join(lim.distinct(), ["star", "twd"]), F.col("p1"), F.col("p2"), sums, ("star", "seg", "twd"), least)
    best = best_epoch(folded, ["star", *seg, "twd", "P0", "Pcad"])
    cad = cadence(df)
    return (
        best.join(noise, ["star", "twd"])
        .join(cad, "star")
        .withColumns(
            {
                "s2n": stats.safe_div(F.col("mean"), F.col("noise")) * F.sqrt("count"),
                "t0": F.col("t0cad") * F.col("dt") + F.col("t_first"),
            }
        )
        .drop("t_first", "dt")
    )


def cadence(df: DataFrame) -> DataFrame:
    """Spacing ``dt`` and first time per star of a gap-free series."""
    span = df.groupBy("star").agg(
        F.min("t").alias("t_first"), F.max("t").alias("_tl"), (F.max("cad") - F.min("cad")).alias("_n")
    )
    return span.select("star", "t_first", stats.safe_div(F.col("_tl") - F.col("t_first"), F.col("_n")).alias("dt"))


def best_duration(pgram: DataFrame, keys: Sequence[str] = ("star", "Pcad")) -> DataFrame:
    """Per period the duration with the largest s2n (the first of equals)."""
    keep = [c for c in pgram.columns if c not in keys]
    return stats.top_row(pgram.where("s2n IS NOT NULL"), keys, [F.col("s2n"), -F.col("twd")], keep)


def search_ffa(df: DataFrame, p1: int, p2: int, twds: Sequence[int]) -> DataFrame:
    return best_duration(duration_period_epoch(df, p1, p2, twds), ("star", "P0", "Pcad")).drop("P0")


def search_clipped(
    df: DataFrame, p1: float | None, p2: float | None, twds: Sequence[int], periods: DataFrame | None = None
) -> DataFrame:
    """Direct fold that survives outliers: a column counts only with three or more events whose mean
    stays above half without the deepest and without the two deepest.

    ``p1``/``p2`` are trial-period limits in cadences. With ``periods`` (star, seg, p1, p2, twdG)
    they differ per star; each row is one segment and folds only its own durations out of ``twds``.
    The series is written once, as boxes, noise, cadence and length all read it.
    """
    df = staged(df)
    boxes = windows.box_depth_arrays(df, twds)
    events = F.transform(
        F.filter("e", lambda r: r["good"] & r["depth"].isNotNull()),
        lambda r: F.struct(r["twd"].alias("twd"), r["depth"].alias("d")),
    )
    x = fold.with_index(boxes.withColumn("e", events))
    flat = x.select("star", "cad", F.explode("e").alias("_e")).select("star", "cad", "_e.*")
    noise = windows.noise_per_duration(flat, 1.5)
    seg = ["seg"] if periods is not None else []
    if periods is None:
        least = float(p1)
        x = x.withColumns({"p1": F.lit(float(p1)), "p2": F.lit(float(p2))})
    else:
        least = periods.agg(F.min("p1")).first()[0]
        x = x.join(periods.select("star", "seg", "p1", "p2", "twdG"), "star")
        x = x.withColumn("e", F.filter("e", lambda r: F.array_contains("twdG", r["twd"])))
    n = fold.longest(df)
    y, by = fold.spread_periods(
        x.where(F.size("e") > 0).select("star", *seg, "i", "ncad", "e", "p1", "p2"), F.col("p1"), F.col("p2"),
        lambda P: fold.frac_periods(P, F.col("ncad")), ("star", *seg), cadences=n,
    )
    row, col = fold.wrap(F.col("i"), F.col("Pcad"))
    y = y.withColumns({"row": row, "col": col}).select(*by, "Pcad", "row", "col", F.explode("e").alias("_e"))
    y = y.select(*by, "Pcad", "row", "col", "_e.twd", "_e.d")
    g, by = fold.cumsum_top(y, by, ["twd", "Pcad", "col"], F.col("d"), F.col("row"), int(n / max(least, 1.0)) + 1)
    g = g.withColumn("mean", stats.safe_div(F.col("s0"), F.col("c0"))).where(
        (F.col("c0") >= 3)
        & (stats.safe_div(F.col("s1"), F.col("c1")) > F.col("mean") * 0.5)
        & (stats.safe_div(F.col("s2"), F.col("c2")) > F.col("mean") * 0.5)
    )
    # Within one duration s2n is a common factor away from sum/sqrt(count).
    g = g.withColumn("_q", F.col("s0") / F.sqrt("c0"))
    best = stats.top_row(g, [*by, "Pcad", "twd"], [F.col("_q"), -F.col("col")], ["_q", "mean", "c0", "col"])
    best = best.join(noise, ["star", "twd"]).join(cadence(df), "star")
    best = best.withColumns(
        {
            "s2n": stats.safe_div(F.col("_q"), F.col("noise")),
            "c": F.col("c0"),
            "t0": (F.col("col") + F.col("twd") / 2.0) * F.col("dt") + F.col("t_first"),
        }
    ).select("star", *seg, "Pcad", "twd", "s2n", "c", "mean", "t0", "noise", "dt")
    out = best_duration(best, ("star", *seg, "Pcad"))
    return out.withColumns({"P": F.col("Pcad") * F.col("dt"), "tdur": F.col("twd") * F.col("dt")}).drop("dt")


def search_likelihood(
    df: DataFrame, p1: int | None, p2: int | None, twds: Sequence[int], alpha: float = 1200.0, periods: DataFrame | None = None
) -> DataFrame:
    """One common depth against one depth per event, by penalised likelihood.

    The penalty is ours after the published method: same = sum(dll) - sum(ivar (d-D)^2)/2 - ln(alpha)/2
    and variable = sum(dll) - nind ln(alpha)/2. ``periods`` as for ``search_clipped``.
    """
    df = staged(df)
    good = F.filter("e", lambda r: r["good"] & r["depth"].isNotNull() & r["ivar"].isNotNull())
    x = fold.with_index(windows.box_depth_arrays(df, twds).withColumn("e", good))
    seg = ["seg"] if periods is not None else []
    if periods is None:
        x = x.withColumns({"p1": F.lit(p1), "p2": F.lit(p2)})
    else:
        x = x.join(periods.select("star", "seg", F.floor("p1").alias("p1"), F.ceil("p2").alias("p2"), "twdG"), "star")
        x = x.withColumn("e", F.filter("e", lambda r: F.array_contains("twdG", r["twd"])))
    y, by = fold.spread_periods(
        x.where(F.size("e") > 0).select("star", *seg, "i", "ncad", "e", "p1", "p2"), F.col("p1"), F.col("p2"),
        lambda P: fold.frac_periods(P, F.col("ncad")), ("star", *seg), cadences=fold.longest(df),
    )
    _, col = fold.wrap(F.col("i"), F.col("Pcad"))
    y = y.withColumn("col", col).select(*by, "Pcad", "col", F.explode("e").alias("_e")).select(*by, "Pcad", "col", "_e.*")
    g, by = fold.merged_aggregate(
        y, by, ["Pcad", "twd", "col"],
        {
            "w": ("sum", F.col("ivar")), "wd": ("sum", F.col("ivar") * F.col("depth")),
            "wdd": ("sum", F.col("ivar") * F.col("depth") * F.col("depth")), "dll": ("sum", F.col("dll")),
            "nind": ("count", F.col("dll")),
        },
    )
    half = 0.5 * math.log(alpha)
    depth = stats.safe_div(F.col("wd"), F.col("w"))
    g = g.withColumn("depth_2d", depth).withColumns(
        {
            "phic_same": F.col("dll") - (F.col("wdd") - F.col("depth_2d") * F.col("wd")) * 0.5 - half,
            "phic_variable": F.col("dll") - F.col("nind") * half,
        }
    )
    g = g.where("depth_2d > 0 AND phic_same > phic_variable AND nind >= 2")
    best = stats.top_row(
        g, [*by, "Pcad"], [F.col("phic_same"), -F.col("twd"), -F.col("col")],
        ["phic_same", "phic_variable", "depth_2d", "w", "nind", "col", "twd"],
    )
    return best.join(cadence(df), "star").select(
        "star", *seg, "Pcad", "twd", "col", "nind", "phic_same", "phic_variable",
        F.col("depth_2d").alias("mean"),
        F.col("w").alias("depth_ivar"),
        (F.col("depth_2d") * F.sqrt("w")).alias("s2n"),
        stats.safe_div(F.lit(1.0), F.sqrt("w")).alias("noise"),
        (F.col("t_first") + (F.col("col") + F.floor(F.col("twd") / 2)) * F.col("dt")).alias("t0"),
        (F.col("Pcad") * F.col("dt")).alias("P"),
        (F.col("twd") * F.col("dt")).alias("tdur"),
    )


def segment_limits(df: DataFrame, segments: Sequence[dict]) -> DataFrame:
    """(star, seg, p1, p2, twdG): segments in cadences of each star; those given in time units are
    divided by its own cadence."""
    edge = lambda s, k: F.lit(float(s[f"Pcad{k}"])) if "Pcad1" in s else F.lit(float(s[f"P{k}"])) / F.col("dt")
    rows = [
        F.struct(
            F.lit(n).alias("seg"), edge(s, 1).alias("p1"), edge(s, 2).alias("p2"),
            F.array(*[F.lit(int(k)) for k in s["twdG"]]).alias("twdG"),
        )
        for n, s in enumerate(segments)
    ]
    return cadence(df).select("star", F.explode(F.array(*rows)).alias("_s")).select("star", "_s.*")


def periodogram(df: DataFrame, segments: Sequence[dict], mode: str = "max") -> DataFrame:
    """Run one search mode over segments and stack them.

    A segment has ``twdG`` and either ``Pcad1, Pcad2`` (cadences) or ``P1, P2`` (time units), which
    every star reads in its own cadence. Output has P and tdur in time units.
    """
    from starfold.operators import boxes

    df = staged(df)
    limits = cut_lineage(segment_limits(df, segments))
    # All segments of all stars in one plan, whatever the mode.
    twds = sorted({int(k) for s in segments for k in s["twdG"]})
    if mode == "max":
        return search_clipped(df, None, None, twds, limits).drop("seg")
    if mode == "ffa":
        p = best_duration(duration_period_epoch(df, None, None, twds, limits), ("star", "seg", "P0", "Pcad"))
        return _in_time_units(p.drop("seg", "P0"), df)
    if mode == "bls":
        return _in_time_units(boxes.search_bls(df, None, None, None, None, periods=limits).drop("seg"), df)
    if mode == "fm":
        return search_likelihood(df, None, None, twds, periods=limits).drop("seg")
    raise ValueError(mode)


def _in_time_units(p: DataFrame, df: DataFrame) -> DataFrame:
    x = p.join(cadence(df).select("star", "dt"), "star")
    return x.withColumns({"P": F.col("Pcad") * F.col("dt"), "tdur": F.col("twd") * F.col("dt")}).drop("dt")


def bin_periodogram(pgram: DataFrame, nbins: int = 2000) -> DataFrame:
    """The largest-s2n row per log-spaced period bin, for stars with more than ``nbins`` rows; all rows
    of the others."""
    lim = pgram.groupBy("star").agg(
        F.min("P").alias("_lo"), F.max("P").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    x = pgram.join(lim, "star")
    lo, hi = F.log10("_lo"), F.log10("_hi")
    # nbins edges make nbins-1 right-closed bins; the first edge is included.
    u = stats.safe_div(F.log10("P") - lo, hi - lo) * (nbins - 1)
    x = x.withColumn("Pbin", F.least(F.greatest(F.ceil(F.round(u, 9)) - 1, F.lit(0)), F.lit(nbins - 2)).cast("int"))
    columns = [*pgram.columns, "Pbin"]
    keep = [c for c in columns if c not in ("star", "Pbin")]
    best = stats.top_row(x.where(F.col("_n") > nbins), ["star", "Pbin"], [F.col("s2n"), -F.col("P")], keep)
    return best.select(*columns).unionByName(x.where(F.col("_n") <= nbins).select(*columns))


def peak(pgram: DataFrame, keys: Sequence[str] = ("star",)) -> DataFrame:
    """The row with the largest s2n as header scalars."""
    best = stats.top_row(
        pgram.where("s2n IS NOT NULL"), keys, [F.col("s2n"), -F.col("P")], ["s2n", "P", "t0", "tdur", "mean"]
    )
    return best.select(
        *keys, F.col("s2n").alias("grid_s2n"), F.col("P").alias("grid_P"), F.col("t0").alias("grid_t0"),
        F.col("tdur").alias("grid_tdur"), F.col("mean").alias("grid_mean"),
    )


def find_peaks(df: DataFrame, x: str, y: str, edges: Sequence[float], keys: Sequence[str] = ("star",)) -> DataFrame:
    """Largest y and its x per bin [edge k, edge k+1); the first and last occupied bins are dropped."""
    b = F.lit(0)
    for e in edges:
        b = b + (F.col(x) >= e).cast("int")
    z = df.withColumn("bin", b)
    best = stats.top_row(z, [*keys, "bin"], [F.col(y), -F.col(x)], [x, y])
    w = Window.partitionBy(*keys)
    best = best.withColumns({"_lo": F.min("bin").over(w), "_hi": F.max("bin").over(w)})
    return best.where((F.col("bin") > F.col("_lo")) & (F.col("bin") < F.col("_hi"))).drop("_lo", "_hi")
