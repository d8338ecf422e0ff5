"""Exact order statistics and masked aggregates per group.

``percentile`` keeps every distinct value of a group in one task. The functions here bracket the
wanted rank with a bounded sketch first, so that only the few values near the rank of a very large
group meet in one task; the result is exact either way.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Groups up to this many rows are ranked directly; larger ones only inside the bracket.
DIRECT_ROWS = 50_000
SKETCH_ACCURACY = 10_000
# Bracket half-width in rank fraction: three sketch errors.
MARGIN = 3.0 / SKETCH_ACCURACY


def safe_div(num: Column, den: Column) -> Column:
    """num/den, NULL where den is 0 (ANSI mode raises otherwise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def group_quantiles(
    df: DataFrame, keys: Sequence[str], cols: Mapping[str, Column], q: float = 0.5
) -> DataFrame:
    """Exact quantile ``q`` (linear interpolation) of each column per group; NULLs are ignored.

    The first pass takes a mergeable sketch, the second counts distinct values inside the bracket
    (everything below it collapses to one counted row on the map side) and walks the counts.
    """
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("_n"), c.cast("double").alias("_x")) for n, c in cols.items()])
        ).alias("_s"),
    ).select(*keys, "_s._n", nan_to_null(F.col("_s._x")).alias("_x"))
    gk = [*keys, "_n"]
    lo_q, hi_q = max(0.0, q - MARGIN), min(1.0, q + MARGIN)
    sketch = long.groupBy(*gk).agg(
        F.percentile_approx("_x", [lo_q, hi_q], SKETCH_ACCURACY).alias("_b"),
        F.count("_x").alias("_total"),
    )
    sketch = sketch.select(
        *gk,
        "_total",
        F.when(F.col("_total") > DIRECT_ROWS, F.col("_b")[0]).otherwise(F.lit(-math.inf)).alias("_lo"),
        F.when(F.col("_total") > DIRECT_ROWS, F.col("_b")[1]).otherwise(F.lit(math.inf)).alias("_hi"),
    )
    counts = (
        long.join(sketch, gk)
        # A group without values stays, with a NULL quantile.
        .where((F.col("_x") <= F.col("_hi")) | (F.col("_total") == 0))
        .select(*gk, "_total", F.when(F.col("_x") < F.col("_lo"), F.lit(-math.inf)).otherwise(F.col("_x")).alias("_x"))
        .groupBy(*gk, "_total", "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    w = Window.partitionBy(*gk).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.lit(q) * (F.col("_total") - 1)
    walked = counts.withColumn("_cum", F.sum("_c").over(w))
    picked = walked.groupBy(*gk).agg(
        F.min(F.when(F.col("_cum") > F.floor(pos), F.col("_x"))).alias("_v0"),
        F.min(F.when(F.col("_cum") > F.ceil(pos), F.col("_x"))).alias("_v1"),
        F.first(pos - F.floor(pos)).alias("_frac"),
    )
    value = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_frac")
    if len(cols) == 1:
        (name,) = cols
        return picked.select(*keys, value.alias(name))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_n") == n, value)).alias(n) for n in cols]
    )


def group_medians(
    df: DataFrame, keys: Sequence[str], cols: Mapping[str, Column]
) -> DataFrame:
    return group_quantiles(df, keys, cols, 0.5)


def with_medians(
    df: DataFrame, keys: Sequence[str], cols: Mapping[str, Column]
) -> DataFrame:
    """Attach the exact group medians to every row."""
    return df.join(group_medians(df, keys, cols), list(keys), "left")


def agg_with_medians(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], cols: Mapping[str, Column]
) -> DataFrame:
    """Ordinary aggregates together with exact medians per group."""
    return df.groupBy(*keys).agg(*aggs).join(group_medians(df, keys, cols), list(keys), "left")


def top_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` tuple per group, by a mergeable struct maximum."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = df.groupBy(*keys).agg(
        F.max(F.struct(rank.alias("r"), F.struct(*[F.col(k) for k in keep]).alias("v"))).alias("_m")
    )
    return best.select(*keys, *[F.col(f"_m.v.{k}").alias(k) for k in keep])
