"""Period grids and folding.

A fold multiplies every cadence by the number of trial periods. Rows therefore go to their
(star, period chunk) task first and are multiplied there, so that the blown-up rows meet their hash
aggregate in the same stage and nothing but the chunked series is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from starfold.functions import scalars

# Tasks per series for the trial periods of one fold, and cadences of one series in one task.
CHUNKS_PER_SERIES = 32
CADENCES_PER_BLOCK = 131_072
# Periods of a grid made in one array.
STEPS = 256


def shuffle_width(df: DataFrame) -> int:
    """Number of partitions for rows that are multiplied after the exchange. Given explicitly, since
    their size before it would make AQE merge them into too few tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def longest(df: DataFrame) -> int:
    """Cadences from the first to the last of the longest series; 1 if there is none."""
    if "ncad" in df.columns:
        return df.agg(F.max("ncad")).first()[0] or 1
    span = df.groupBy("star").agg((F.max("cad") - F.min("cad") + 1).alias("n"))
    return span.agg(F.max("n")).first()[0] or 1


def with_index(df: DataFrame) -> DataFrame:
    """Position ``i`` from 0, series length ``ncad`` and first time ``t_first``."""
    ends = df.groupBy("star").agg(F.min("cad").alias("_a"), F.max("cad").alias("_b"), F.min("t").alias("t_first"))
    x = df.join(ends, "star")
    return x.withColumns({"i": F.col("cad") - F.col("_a"), "ncad": F.col("_b") - F.col("_a") + 1}).drop("_a", "_b")


def wrap(i: Column, P: Column) -> tuple[Column, Column]:
    """Row and column of position ``i`` folded on period ``P``."""
    return F.floor(i / P), F.floor(F.pmod(i.cast("double"), P.cast("double")))


# ---- grids ----------------------------------------------------------------------------------


def period_grid(stars: DataFrame, ftdurmi: float, p_min: float = 100.0, p_max: float | None = None) -> DataFrame:
    """Trial periods whose spacing keeps the last transit within ``ftdurmi`` of a duration.

    ``stars`` has (star, tbase). The step is P <- P + ftdurmi * tdur(P)/tbase * P until P_max
    (default tbase/2); with tdur growing as the cube root of P the step count is bounded. The
    recurrence runs in chunks of STEPS periods, as an array that is appended to is copied each time.
    """
    unit = scalars.duration_of_period(F.lit(1.0))
    top = F.lit(p_max) if p_max is not None else F.col("tbase") / 2.0
    x = stars.withColumns({"_top": top.cast("double"), "_u": unit * ftdurmi / F.col("tbase")})
    # The relative step grows with P, so it is at least that of P_min.
    steps = F.ceil(F.ln(F.greatest(F.col("_top") / p_min, F.lit(1.0))) / F.ln(F.col("_u") * p_min ** (1 / 3) + 1.0)) + 1
    x = x.withColumn("_chunks", F.floor(steps / STEPS))
    after = "element_at(a, -1) + element_at(a, -1) * _u * power(element_at(a, -1), 1d / 3d)"
    chunk = f"""aggregate(sequence(1, {STEPS}), array(q.p),
        (a, i) -> if(element_at(a, -1) < _top, array_append(a, {after}), a))"""
    grid = F.expr(
        f"""flatten(aggregate(sequence(0L, _chunks), struct({float(p_min)!r}d AS p, cast(array() AS array<array<double>>) AS out),
            (q, j) -> transform(array({chunk}), c -> struct(element_at(c, -1) AS p, array_append(q.out, slice(c, 2, {STEPS})) AS out))[0],
            q -> q.out))"""
    )
    return x.select("star", F.posexplode(grid).alias("k", "P"))


def search_segments(
    stars: DataFrame, p1: Column, p2: Column, nseg: int, rstar: float = 1.0, mstar: float | None = None,
    ftdur: tuple[float, float] = (0.5, 1.5), cadence: float = scalars.CADENCE_DAYS,
) -> DataFrame:
    """Log-spaced period segments with their durations, per star (needs ``tbase``).

    The stellar mass defaults to the radius, as the duration limits have always been computed. The
    duration grid grows by 1.33 from the shorter limit and ends with the longer one.
    """
    m = rstar if mstar is None else mstar
    x = stars.withColumns({"_l1": F.log10(p1), "_l2": F.log10(p2)})
    x = x.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(nseg - 1))))
    edge = lambda k: F.pow(F.lit(10.0), F.col("_l1") + (F.col("_l2") - F.col("_l1")) * k / nseg)
    x = x.withColumns({"P1": edge(F.col("seg")), "P2": edge(F.col("seg") + 1)})
    x = x.withColumns(
        {
            "_d1": scalars.duration_of_period(F.col("P1"), rstar, m) * ftdur[0],
            "_d2": scalars.duration_of_period(F.col("P2"), rstar, m) * ftdur[1],
        }
    )
    q1, q2 = F.col("_d1") / F.col("P1"), F.col("_d2") / F.col("P2")
    x = x.withColumns(
        {
            "qmi": F.least(q1, q2) * min(ftdur),
            "qma": F.greatest(q1, q2) * max(ftdur),
            "fmi": F.lit(1.0) / F.col("P2"),
            "delT1": F.rint(F.col("_d1") / cadence).cast("int"),
            "delT2": F.rint(F.col("_d2") / cadence).cast("int"),
            "nb": F.floor(F.sqrt(F.col("P1") * F.col("P2")) / cadence).cast("int"),
            "Pcad1": F.floor(F.col("P1") / cadence).cast("int"),
            "Pcad2": F.floor(F.col("P2") / cadence).cast("int"),
        }
    )
    x = x.withColumn("df", F.col("fmi") * 0.25 * F.least("_d1", "_d2") / F.col("tbase"))
    x = x.withColumn("nf", F.floor((F.lit(1.0) / F.col("P1") - F.lit(1.0) / F.col("P2")) / F.col("df")).cast("long"))
    lo = F.greatest(F.col("delT1"), F.lit(1))
    k = F.ceil(F.ln(F.greatest(F.col("delT2") / lo, F.lit(1.0))) / math.log(1.33)) + 1
    # F.round is half-away-from-zero like the rounding this grid was defined with.
    grown = F.transform(F.sequence(F.lit(0), k.cast("int")), lambda j: lo * F.pow(F.lit(1.33), j.cast("double")))
    below = F.filter(grown, lambda d: d < F.col("delT2"))
    grid = F.concat(F.transform(below, lambda d: F.round(d).cast("int")), F.array(F.col("delT2")))
    return x.withColumn("twdG", grid).drop("_l1", "_l2", "_d1", "_d2")


def frac_periods(P: Column, ncad: Column) -> Column:
    """Trial periods from P up to P+1, one per ncad-th of P."""
    step = P / ncad
    return F.transform(
        F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(1.0) / step) - 1), lambda j: P + j.cast("double") * step
    )


def unit_periods(P: Column) -> Column:
    """Trial periods from P up to P+1 in steps of 1/P."""
    step = F.lit(1.0) / P
    return F.transform(
        F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(1.0) / step) - 1), lambda j: P + j.cast("double") * step
    )


# ---- direct folding -------------------------------------------------------------------------


def spread_periods(
    df: DataFrame, p1: Column, p2: Column, expand: Callable[[Column], Column] | None = None,
    keys: Sequence[str] = ("star",), chunks: int = CHUNKS_PER_SERIES, cadences: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """Every row once per trial period in [p1, p2), with columns ``Pbase`` and ``Pcad``.

    Returns the rows and the key columns by which they are already partitioned. If the longest series
    (``cadences``, measured if not given) is longer than a block, series are split by block as well;
    aggregates then need a second exchange to merge them. The results are the same.
    """
    n = F.ceil(p2.cast("double") - p1.cast("double"))
    x = df.withColumns({"_p1": p1.cast("double"), "_np": n}).where("_np > 0")
    x = x.withColumn("_chunk", F.greatest(F.ceil(F.col("_np") / chunks), F.lit(1)))
    chunk = F.col("_chunk")
    x = x.withColumn("pchunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_np") - 1) / chunk))))
    by = [*keys, "pchunk"]
    if (longest(df) if cadences is None else cadences) > CADENCES_PER_BLOCK:
        x = x.withColumn("pblock", F.floor(F.col("i") / CADENCES_PER_BLOCK))
        by.append("pblock")
    x = x.repartition(shuffle_width(df), *by)
    bases = F.transform(
        F.sequence(F.col("pchunk") * chunk, F.least(F.col("_np"), (F.col("pchunk") + 1) * chunk) - 1),
        lambda j: F.col("_p1") + j,
    )
    if expand is None:
        x = x.withColumn("Pcad", F.explode(bases)).withColumn("Pbase", F.col("Pcad"))
    else:
        x = x.withColumn("Pbase", F.explode(bases)).withColumn("Pcad", F.explode(expand(F.col("Pbase"))))
    return x.drop("_p1", "_np", "_chunk"), by


MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "first": F.first}


def merged_aggregate(
    x: DataFrame, by: Sequence[str], keys: Sequence[str], aggs: Mapping[str, tuple[str, Column]]
) -> tuple[DataFrame, list[str]]:
    """Aggregate by (partitioning keys + keys); merge the blocks of long series afterwards.

    ``aggs`` maps a name to (kind, input); kind ``topK`` keeps the K largest. Returns the result and the keys it is partitioned by.
    """
    single = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "first": F.first}

    def own(kind: str, c: Column) -> Column:
        return InternalFunction.collect_top_k(c, int(kind[3:]), False) if kind.startswith("top") else single[kind](c)

    def merge(kind: str, c: Column) -> Column:
        if not kind.startswith("top"):
            return MERGE[kind](c)
        return F.slice(F.sort_array(F.flatten(F.collect_list(c)), False), 1, int(kind[3:]))  # a few per block

    group = [*by, *[k for k in keys if k not in by]]
    out = x.groupBy(*group).agg(*[own(kind, c).alias(n) for n, (kind, c) in aggs.items()])
    if "pblock" not in by:
        return out, list(by)
    rest = [k for k in group if k != "pblock"]
    out = out.groupBy(*rest).agg(*[merge(kind, F.col(n)).alias(n) for n, (kind, _) in aggs.items()])
    return out, [k for k in by if k != "pblock"]


def fold_columns(
    df: DataFrame, p1: Column, p2: Column, value: str = "f", ok: Column | None = None, expand=None,
    keys: Sequence[str] = ("star",), carry: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """Count, sum and sum of squares of the good points per (period, column).

    Expects an indexed gap-free series (``with_index``): masked rows keep empty columns present.
    """
    good = F.col(value).isNotNull() if ok is None else ok
    v = F.when(good, F.col(value))
    x = df.withColumns({"_v": v})
    x, by = spread_periods(x, p1, p2, expand, keys)
    _, col = wrap(F.col("i"), F.col("Pcad"))
    x = x.withColumn("col", col)
    out, by = merged_aggregate(
        x, by, ["Pbase", "Pcad", "col"],
        {"c": ("count", F.col("_v")), "s": ("sum", F.col("_v")), "ss": ("sum", F.col("_v") * F.col("_v")),
         **{k: ("first", F.col(k)) for k in carry}},
    )
    return out.fillna(0.0, ["s", "ss"]), by


def cumsum_top(
    x: DataFrame, by: Sequence[str], keys: Sequence[str], value: Column, row: Column, max_rows: int,
    extra: Mapping[str, tuple[str, Column]] | None = None, k: int = 2,
) -> tuple[DataFrame, list[str]]:
    """Sum and count per group without its 0, 1, ..., ``k`` largest values (s0, c0 to sk, ck), NULLs ignored.

    Up to two come from plain maxima: for every bit of the row number the maximum is kept for either
    value of the bit. A second-largest row differs from the largest in some bit, so it is the largest
    of the smaller ones of these pairs. Nothing is collected or sorted. More are kept in Spark's
    bounded queue of the k largest, which is merged like a sum.
    """
    aggs = {"s0": ("sum", value), "c0": ("count", value)}
    bits = max(1, math.ceil(math.log2(max(2, max_rows + 1)))) if k == 2 else 0
    if k > 2:
        aggs["_top"] = (f"top{k}", value)
    elif k:
        aggs["_m1"] = ("max", value)
    for b in range(bits):
        bit = F.getbit(row, F.lit(b))
        aggs[f"_z{b}"] = ("max", F.when(bit == 0, value))
        aggs[f"_o{b}"] = ("max", F.when(bit == 1, value))
    aggs.update(extra or {})
    out, by = merged_aggregate(x, by, keys, aggs)
    if k > 2:
        top = [F.get("_top", F.lit(j)) for j in range(k)]
    else:
        second = [
            F.when(F.col(f"_z{b}").isNotNull() & F.col(f"_o{b}").isNotNull(), F.least(f"_z{b}", f"_o{b}")) for b in range(bits)
        ]
        top = ([F.col("_m1")] + ([F.greatest(*second) if bits > 1 else second[0]] if k == 2 else [])) if k else []
    z = lambda c: F.coalesce(c, F.lit(0.0))
    cols, rest = {"s0": z(F.col("s0"))}, z(F.col("s0"))
    for j, t in enumerate(top, 1):
        rest = rest - z(t)
        cols |= {f"s{j}": rest, f"c{j}": F.greatest(F.col("c0") - j, F.lit(0))}
    return out.withColumns(cols).drop("_m1", "_top", *[f"_{x}{b}" for b in range(bits) for x in "zo"]), by


def fold_phase_bins(
    df: DataFrame, freq: Callable[[Column], Column], nf: int | Column, nb: int, value: str = "f", ok: Column | None = None,
    keys: Sequence[str] = ("star",),
) -> tuple[DataFrame, list[str]]:
    """Count, sum and sum of squares per (frequency, phase bin) for the frequencies of the indices
    0 to ``nf`` - 1; ``freq`` gives that of an index.

    Needs ``i`` and ``t_first``; phases are those of t - t_first. Every bin is present.
    """
    good = F.col(value).isNotNull() if ok is None else ok
    count = nf if isinstance(nf, Column) else F.lit(nf)
    x = df.withColumn("_v", F.when(good, F.col(value))).withColumn("_nf", count.cast("long")).where("_nf > 0")
    x = x.withColumn("_n", F.greatest(F.ceil(F.col("_nf") / CHUNKS_PER_SERIES), F.lit(1)).cast("long"))
    chunk = F.col("_n")
    x = x.withColumn("pchunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_nf") - 1) / chunk))))
    by = [*keys, "pchunk"]
    if longest(df) > CADENCES_PER_BLOCK:
        x = x.withColumn("pblock", F.floor(F.col("i") / CADENCES_PER_BLOCK))
        by.append("pblock")
    # The frequencies of a chunk, and only those, are made after the exchange.
    own = F.sequence(F.col("pchunk") * chunk, F.least((F.col("pchunk") + 1) * chunk, F.col("_nf")) - 1)
    x = x.repartition(shuffle_width(df), *by).withColumn("jf", F.explode(own)).withColumn("freq", freq(F.col("jf")))
    # The first row of a series also brings one empty entry per bin.
    slot = F.explode(F.when(F.col("i") == 0, F.sequence(F.lit(-1), F.lit(nb - 1))).otherwise(F.array(F.lit(-1))))
    x = x.drop("_n", "_nf").withColumn("_z", slot)
    ph = (F.col("t") - F.col("t_first")) * F.col("freq")
    ph = ph - F.floor(ph)
    own = F.floor(ph * nb).cast("int")
    x = x.withColumn("col", F.when(F.col("_z") >= 0, F.col("_z")).otherwise(own))
    v = F.when(F.col("_z") < 0, F.col("_v"))
    x = x.withColumn("_v", v)
    out, by = merged_aggregate(
        x, by, ["jf", "freq", "col"],
        {"c": ("count", F.col("_v")), "s": ("sum", F.col("_v")), "ss": ("sum", F.col("_v") * F.col("_v"))},
    )
    return out.fillna(0.0, ["s", "ss"]), by


# ---- wrapped rows and fast folding ----------------------------------------------------------


def wrap_shifted(df: DataFrame, P: Column) -> DataFrame:
    """Row and column of an indexed series on a fractional period: the rows of the integer base
    period shifted so that the last one lags by the remainder. Adds ``nrow, row, col``."""
    base = F.floor(P)
    nrow = F.floor(F.col("ncad") / base) + 1
    rem = F.rint(base * (P - base))
    row = F.floor(F.col("i") / base)
    shift = F.rint(row * F.try_divide(rem, nrow - 1))
    return df.withColumns(
        {"nrow": nrow, "row": row, "col": F.pmod(F.col("i") % base - F.coalesce(shift, F.lit(0)).cast("long"), base)}
    )


def wrap_padded(df: DataFrame, P0: Column) -> DataFrame:
    """Row and column on an integer period; ``nrow`` as is, ``k`` and ``m`` = 2^k padded rows."""
    nrow = F.floor(F.col("ncad") / P0) + 1
    k = F.ceil(F.log2(nrow.cast("double"))).cast("int")
    return df.withColumns(
        {
            "nrow": nrow,
            "k": k,
            "m": F.pow(F.lit(2.0), k).cast("long"),
            "row": F.floor(F.col("i") / P0),
            "col": F.col("i") % P0,
        }
    )


def ffa_stage(x: DataFrame, stage: int, keys: Sequence[str], P0: str, sums: Sequence[str], k: str = "k") -> DataFrame:
    """One doubling step on rows (keys, row, col): each row is added into two rows of the doubled
    block, the second half shifted. Rows whose ``k`` is reached already stay as they are."""
    half = 1 << (stage - 1)
    blk = F.floor(F.col("row") / half)
    b = F.col("row") - blk * half
    new = F.floor(blk / 2) * (half * 2) + b * 2
    lag = F.when(blk % 2 == 1, b).otherwise(F.lit(0))
    lag1 = F.when(blk % 2 == 1, b + 1).otherwise(F.lit(0))
    at = lambda r, s: F.struct(r.cast("long").alias("row"), F.pmod(F.col("col") - s, F.col(P0)).cast("long").alias("col"))
    go = F.when(F.col(k) >= stage, F.array(at(new, lag), at(new + 1, lag1))).otherwise(
        F.array(F.struct(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")))
    )
    y = x.select(*keys, k, *sums, F.explode(go).alias("_to"))
    y = y.select(*keys, k, F.col("_to.row").alias("row"), F.col("_to.col").alias("col"), *sums)
    return y.groupBy(*keys, k, "row", "col").agg(*[F.sum(c).alias(c) for c in sums])


# Rows of one folded period handled inside one task; taller folds exchange for the last stages.
FFA_ROWS = 4096


def fold_ffa(
    df: DataFrame, p1: int | Column, p2: int | Column, sums: Mapping[str, Column], keys: Sequence[str] = ("star",),
    least: int | None = None,
) -> DataFrame:
    """Fast folding of an indexed series on all integer periods in [p1, p2).

    Gives ``Pcad`` = P0 + row/(m-1) for every row of the padded power of two and the sums per
    column. All stages run after one exchange on (star, chunk of periods), or for folds of more than
    FFA_ROWS rows on (star, P0, row block). Limits that differ per row (columns, constant per key) need
    the ``least`` of them, which bounds the number of stages.
    """
    n = df.agg(F.max("ncad")).first()[0] or 1
    least = p1 if least is None else least
    stages = math.ceil(math.log2(n // max(least, 1) + 1))
    at = lambda p: (p if isinstance(p, Column) else F.lit(p)).cast("long")
    x = df.withColumns({f"_{s}": c for s, c in sums.items()}).withColumns({"_lo": at(p1), "_hi": at(p2)})
    x = x.select(*keys, "i", "ncad", "_lo", "_hi", *[f"_{s}" for s in sums]).where("_hi > _lo")
    block = [] if (1 << stages) <= FFA_ROWS else ["_blk"]
    if not block:
        # The rows meet their periods after the exchange, a bounded number of chunks per series.
        x = x.withColumn("_c", F.ceil((F.col("_hi") - F.col("_lo")) / CHUNKS_PER_SERIES))
        x = x.withColumn("pchunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_hi") - F.col("_lo") - 1) / F.col("_c")))))
        x = x.repartition(shuffle_width(df), "star", "pchunk")
        first = F.col("_lo") + F.col("pchunk") * F.col("_c")
        bases = F.sequence(first, F.least(first + F.col("_c"), F.col("_hi")) - 1)
        x = wrap_padded(x.withColumn("P0", F.explode(bases)), F.col("P0"))
    else:
        # A fold too tall for one task is dealt by its rows, which differ from period to period.
        x = wrap_padded(x.withColumn("P0", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1))), F.col("P0"))
        x = x.withColumn("_blk", F.floor(F.col("row") / FFA_ROWS)).repartition(shuffle_width(df), "star", "P0", "_blk")
    keys = [*keys, *([] if block else ["pchunk"])]
    x = x.select(*keys, "P0", *block, "k", "row", "col", *[F.col(f"_{s}").alias(s) for s in sums])
    names = list(sums)
    for s in range(1, stages + 1):
        inside = block if (1 << s) <= FFA_ROWS else []
        x = ffa_stage(x, s, [*keys, "P0", *inside], "P0", names)
    m = F.pow(F.lit(2.0), F.col("k"))
    return x.withColumn("Pcad", F.col("P0") + stats_div(F.col("row"), m - 1)).select(
        *[k for k in keys if k != "pchunk"], "P0", "row", "Pcad", "col", *names
    )


def stats_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
