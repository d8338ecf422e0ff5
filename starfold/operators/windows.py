"""Single-event statistics: box means along the series and around a folded one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import stats
from starfold.functions.frames import scan, with_frames
from starfold.operators.clean import flux, valid


def mean_depth(df: DataFrame, twds: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Half the means before and after minus the mean during, one row per (star, cad, twd).

    The boxes are ``twd`` cadences wide and centred like a same-size convolution. ``d`` is NULL
    where a box is empty or has fewer than twd//2 good points. All durations share one window pass.
    """
    one, v = F.when(valid(), 1), flux()

    def make(w):
        cols = {}
        for k in twds:
            h = k // 2
            for name, shift in (("b", -k), ("d", 0), ("a", k)):
                frame = w.rangeBetween(shift - h, shift + k - h - 1)
                cols[f"_n{name}{k}"] = F.count(one).over(frame)
                cols[f"_s{name}{k}"] = F.sum(v).over(frame)
        return cols

    def depth(k):
        mean = lambda x: stats.safe_div(F.col(f"_s{x}{k}"), F.col(f"_n{x}{k}"))
        enough = F.lit(True)
        for x in "bda":
            enough = enough & (F.col(f"_n{x}{k}") >= k // 2)
        return F.when(enough, (mean("b") + mean("a")) * 0.5 - mean("d"))

    widest = max(twds)
    reach = widest + widest // 2 + 1
    x = with_frames(df, reach, reach, make)
    per = F.array(*[F.struct(F.lit(k).cast("int").alias("twd"), depth(k).alias("d")) for k in twds])
    return x.select("star", "cad", "t", *keep, F.explode(per).alias("_e")).select("star", "cad", "t", *keep, "_e.*")


def box_depth(df: DataFrame, twds: Sequence[int]) -> DataFrame:
    """Forward boxes of ``twd`` cadences, one row per (star, cad, twd); see ``box_depth_arrays``."""
    x = box_depth_arrays(df, twds)
    return x.select("star", "cad", "t", F.explode("e").alias("_e")).select("star", "cad", "t", "_e.*")


def box_depth_arrays(df: DataFrame, twds: Sequence[int]) -> DataFrame:
    """Forward boxes per cadence as an array ``e`` over durations: depth, inverse variance,
    likelihood gain and whether more than half the points are good. Expects a gap-free series
    centred on 0."""
    v = F.when(valid(), F.col("f")).otherwise(0.0)

    def make(w):
        cols = {}
        for k in twds:
            frame = w.rangeBetween(0, k - 1)
            cols[f"_r{k}"] = F.count(F.lit(1)).over(frame)
            cols[f"_c{k}"] = F.count(F.when(valid(), 1)).over(frame)
            cols[f"_s{k}"] = F.sum(v).over(frame)
        return cols

    x = scan(df, {"_prev": ("last", flux())}, strict=True)
    x = stats.with_medians(x, ["star"], {"_md2": F.pow(flux() - F.col("_prev"), F.lit(2.0))})
    x = with_frames(x, 0, max(twds), make)
    ivar = stats.safe_div(F.lit(1.0), F.col("_md2"))

    def item(k):
        m = stats.safe_div(F.col(f"_s{k}"), F.col(f"_c{k}"))
        gain = ivar * -0.5 * (m * m * F.col(f"_r{k}") - m * F.col(f"_s{k}") * 2)
        return F.struct(
            F.lit(k).cast("int").alias("twd"),
            (-m).alias("depth"),
            (ivar * F.col(f"_c{k}")).alias("ivar"),
            gain.alias("dll"),
            (F.col(f"_c{k}") > k // 2).alias("good"),
        )

    return x.select("star", "cad", "t", F.array(*[item(k) for k in twds]).alias("e"))


def circular_box(
    df: DataFrame, keys: Sequence[str], n: Column, width: int, cols: Sequence[str], col: str = "col"
) -> DataFrame:
    """Running sums over ``width`` columns of a folded table, wrapping at ``n``."""
    w = Window.partitionBy(*keys).orderBy("_at").rangeBetween(0, width - 1)
    twice = df.withColumn("_n", n).withColumn("_at", F.explode(F.array(F.col(col), F.col(col) + F.col("_n"))))
    out = twice.withColumns({f"box_{c}": F.sum(c).over(w) for c in cols})
    return out.where(F.col("_at") < F.col("_n")).drop("_at", "_n")


def circular_hat(df: DataFrame, keys: Sequence[str], n: Column, width: int, value: str, col: str = "col", out: str = "hat") -> DataFrame:
    """Mean of the two values ``width`` columns away minus the value here, wrapping at ``n``."""
    w = Window.partitionBy(*keys).orderBy("_at")
    thrice = df.withColumn("_n", n).withColumn(
        "_at", F.explode(F.array(F.col(col) - F.col("_n"), F.col(col), F.col(col) + F.col("_n")))
    )
    near = lambda d: F.max(value).over(w.rangeBetween(d, d))
    x = thrice.withColumn(out, (near(-width) + near(width)) * 0.5 - F.col(value))
    return x.where((F.col("_at") >= 0) & (F.col("_at") < F.col("_n"))).drop("_at", "_n")


def noise_per_duration(depths: DataFrame, factor: float = 1.0, value: str = "d") -> DataFrame:
    """factor x median|value| per (star, twd)."""
    m = stats.group_medians(depths, ["star", "twd"], {"_m": F.abs(F.col(value))})
    return m.select("star", "twd", (F.col("_m") * factor).alias("noise"))
