"""Window frames and scans over a series, split into stretches of cadence.

A series is never ordered as a whole in one task. Bounded frames work on stretches that carry a halo
of their neighbours' rows; unbounded scans work inside a stretch and receive what came before from a
one-row-per-stretch summary. A series shorter than a stretch is simply one stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

STRETCH = 32_768
_C = "_stretch"


def partition_sql(keys: Sequence[str] = ("star",)) -> str:
    """PARTITION BY list matching the window handed out by ``with_frames``."""
    return ", ".join([*keys, _C])


def with_ends(df: DataFrame, keys: Sequence[str] = ("star",), a: str = "_a", b: str = "_b") -> DataFrame:
    """First and last cadence of the series on every row."""
    return df.join(df.groupBy(*keys).agg(F.min("cad").alias(a), F.max("cad").alias(b)), list(keys))


def with_frames(
    df: DataFrame,
    before: float,
    after: float,
    make: Callable[[WindowSpec], Mapping[str, Column]],
    keys: Sequence[str] = ("star",),
    order: str = "cad",
    stretch: float = STRETCH,
) -> DataFrame:
    """Add columns computed over frames that reach at most ``before`` back and ``after`` ahead.

    ``make`` receives the ordered window and returns the new columns. Units are those of ``order``,
    so frames should be range frames or, on a gap-free series, row frames.
    """
    o = F.col(order)
    own = F.floor(o / stretch)
    spread = df.withColumn(
        _C, F.explode(F.sequence(F.floor((o - after) / stretch), F.floor((o + before) / stretch)))
    )
    w = Window.partitionBy(*keys, _C).orderBy(order)
    out = spread.withColumns(dict(make(w)))
    return out.where(F.col(_C) == own).drop(_C)


def scan(
    df: DataFrame,
    specs: Mapping[str, tuple[str, Column]],
    keys: Sequence[str] = ("star",),
    order: str = "cad",
    strict: bool = False,
    stretch: float = STRETCH,
    then: Sequence[str] = (),
) -> DataFrame:
    """Unbounded scans along ``order``, ties by ``then``.

    ``specs`` maps an output name to ("last", c) - latest non-NULL c so far, ("next", c) - nearest
    non-NULL c from here on, or ("sum", c) - running sum. ``strict`` leaves the current row out of
    last/next.
    """
    o = F.col(order)
    edge = -1 if strict else 0
    up = Window.partitionBy(*keys, _C).orderBy(order, *then)
    down = Window.partitionBy(*keys, _C).orderBy(*[F.col(c).desc() for c in (order, *then)])
    cup = Window.partitionBy(*keys).orderBy(_C).rowsBetween(Window.unboundedPreceding, -1)
    cdown = Window.partitionBy(*keys).orderBy(F.col(_C).desc()).rowsBetween(Window.unboundedPreceding, -1)

    base = df.withColumn(_C, F.floor(o / stretch))
    base = base.withColumns({f"_in_{n}": c for n, (_, c) in specs.items()})
    local, totals, carries, merged = {}, [], {}, {}
    for n, (kind, _) in specs.items():
        c = F.col(f"_in_{n}")
        at = F.when(c.isNotNull(), F.struct(order, *then) if then else o)
        if kind == "last":
            local[f"_l_{n}"] = F.last(c, True).over(up.rowsBetween(Window.unboundedPreceding, edge))
            totals.append(F.max_by(c, at).alias(f"_t_{n}"))
            carries[f"_c_{n}"] = F.last(f"_t_{n}", True).over(cup)
            merged[n] = F.coalesce(f"_l_{n}", f"_c_{n}")
        elif kind == "next":
            local[f"_l_{n}"] = F.last(c, True).over(down.rowsBetween(Window.unboundedPreceding, edge))
            totals.append(F.min_by(c, at).alias(f"_t_{n}"))
            carries[f"_c_{n}"] = F.last(f"_t_{n}", True).over(cdown)
            merged[n] = F.coalesce(f"_l_{n}", f"_c_{n}")
        elif kind == "sum":
            local[f"_l_{n}"] = F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, 0))
            totals.append(F.sum(c).alias(f"_t_{n}"))
            carries[f"_c_{n}"] = F.sum(f"_t_{n}").over(cup)
            merged[n] = F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))
        else:
            raise ValueError(kind)
    summary = base.groupBy(*keys, _C).agg(*totals).withColumns(carries)
    summary = summary.select(*keys, _C, *carries)
    inside = base.withColumns(local)
    out = inside.join(summary, [*keys, _C], "left").withColumns(merged)
    return out.select(*df.columns, *[n for n in specs if n not in df.columns])
