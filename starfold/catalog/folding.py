"""Queries: period grids and folding."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from starfold.catalog.base import (
    DAILY,
    HOURLY,
    HOURLY_CENTRED,
    HOURLY_DENSE,
    hourly_centred,
    hourly_dense,
    r6,
    s6,
)
from starfold.catalog.windows import mean_depth_sql
from starfold.functions import scalars
from starfold.operators import fold, windows
from starfold.sources import fixtures

QUERIES, SQL = {}, {}

P1, P2 = 20, 28
_FRAC = "unnest(list_transform(range(CAST(ceil(1 / ({P} / ncad)) AS BIGINT)), lambda j: {P} + j * ({P} / ncad)))"


def indexed_sql(src, out, keep="f, fmask, t"):
    return f"""{out} AS (SELECT star, cad, {keep}, cad - min(cad) OVER (PARTITION BY star) AS i,
   max(cad) OVER (PARTITION BY star) - min(cad) OVER (PARTITION BY star) + 1 AS ncad, min(t) OVER (PARTITION BY star) AS t_first FROM {src})"""


def frac_sql(p1, p2, out="pg", src="ix"):
    P = "pb::DOUBLE"
    return f"""{out} AS (SELECT star, pb, {_FRAC.format(P=P)} AS pcad
   FROM (SELECT star, ncad, unnest(range({p1}, {p2})) AS pb FROM (SELECT DISTINCT star, ncad FROM {src})))"""


# Kepler's third law and the central-transit duration, as plain SQL.
_K = f"({scalars.G!r}::DOUBLE * {scalars.MSUN!r}::DOUBLE)"


def axis_sql(P, m="1"):
    return f"(pow({m} * ({_K} / (4 * pi() * pi())) * pow({P} * 86400, 2), 1 / 3::DOUBLE) / {scalars.AU!r}::DOUBLE)"


def tdur_sql(P, r="1", m="1"):
    a = f"({axis_sql(P, m)} * {scalars.AU!r}::DOUBLE)"
    return f"({r} * {scalars.RSUN!r}::DOUBLE * (sqrt(pow({a}, 3) * 4 * pi() * pi() / {_K} / {m}) / 86400) / pi() / {a})"


def period_grid(spark, sf):
    stars = fixtures.daily(spark, sf).groupBy("star").agg((F.max("t") - F.min("t")).alias("tbase"))
    return fold.period_grid(stars, 5.0, 100.0).select("star", "k", r6("P").alias("P"))


QUERIES["period_grid"] = period_grid
SQL["period_grid"] = f"""WITH RECURSIVE {DAILY}, b AS (SELECT star, max(t) - min(t) AS tbase FROM daily GROUP BY star),
g AS (SELECT star, tbase, -1 AS k, 100::DOUBLE AS P FROM b UNION ALL
  SELECT star, tbase, k + 1, P + 5::DOUBLE * {tdur_sql('P')} / tbase * P FROM g WHERE P < tbase / 2)
SELECT star, k, {s6('P')} AS P FROM g WHERE k >= 0"""


def search_segments(spark, sf):
    stars = fixtures.daily(spark, sf).groupBy("star").agg((F.max("t") - F.min("t")).alias("tbase"))
    s = fold.search_segments(stars, F.lit(0.5), F.col("tbase") * 0.49, 10)
    return s.select(
        "star", "seg", r6("P1").alias("P1"), r6("P2").alias("P2"), r6("qmi", 9).alias("qmi"), r6("qma", 9).alias("qma"),
        r6("fmi", 9).alias("fmi"), r6(F.col("df") * 1e6).alias("df"), "nf", "nb", "Pcad1", "Pcad2", "delT1", "delT2",
        F.array_join(F.transform("twdG", lambda k: k.cast("string")), ",").alias("twdG"),
    )


_LC = f"{scalars.CADENCE_DAYS!r}::DOUBLE"
QUERIES["search_segments"] = search_segments
SQL["search_segments"] = f"""WITH RECURSIVE {DAILY}, b AS (SELECT star, max(t) - min(t) AS tbase FROM daily GROUP BY star),
s AS (SELECT star, tbase, seg, pow(10, log10(0.5) + (log10(tbase * 0.49::DOUBLE) - log10(0.5)) * seg / 10::DOUBLE) AS P1,
  pow(10, log10(0.5) + (log10(tbase * 0.49::DOUBLE) - log10(0.5)) * (seg + 1) / 10::DOUBLE) AS P2 FROM b, range(10) r(seg)),
d AS (SELECT *, {tdur_sql('P1')} * 0.5 AS d1, {tdur_sql('P2')} * 1.5 AS d2 FROM s),
e AS (SELECT *, CAST(round_even(d1 / {_LC}, 0) AS INT) AS delT1, CAST(round_even(d2 / {_LC}, 0) AS INT) AS delT2,
  (1 / P2) * 0.25 * least(d1, d2) / tbase AS df FROM d),
w AS (SELECT star, seg, delT2, greatest(delT1, 1)::DOUBLE AS x, 0 AS j FROM e UNION ALL SELECT star, seg, delT2, x * 1.33::DOUBLE, j + 1 FROM w WHERE x * 1.33::DOUBLE < delT2),
l AS (SELECT star, seg, string_agg(CAST(CAST(round(x, 0) AS INT) AS VARCHAR), ',' ORDER BY j) AS g FROM w WHERE x < delT2 GROUP BY star, seg)
SELECT star, seg::INT AS seg, {s6('P1')} AS P1, {s6('P2')} AS P2, {s6('least(d1 / P1, d2 / P2) * 0.5', 9)} AS qmi, {s6('greatest(d1 / P1, d2 / P2) * 1.5', 9)} AS qma,
 {s6('1 / P2', 9)} AS fmi, {s6('df * 1e6')} AS df, CAST(floor((1 / P1 - 1 / P2) / df) AS BIGINT) AS nf, CAST(floor(sqrt(P1 * P2) / {_LC}) AS INT) AS nb,
 CAST(floor(P1 / {_LC}) AS INT) AS Pcad1, CAST(floor(P2 / {_LC}) AS INT) AS Pcad2, delT1, delT2,
 concat_ws(',', g, CAST(delT2 AS VARCHAR)) AS twdG FROM e LEFT JOIN l USING (star, seg)"""


def frac_periods(spark, sf):
    s = fixtures.hourly(spark, sf).groupBy("star").agg((F.max("cad") - F.min("cad") + 1).alias("ncad"))
    s = s.select(
        "star", "ncad", F.explode(F.transform(F.sequence(F.lit(P1), F.lit(P2 - 1)), lambda p: p.cast("double"))).alias("P")
    )
    a = s.select("star", F.lit("search").alias("kind"), F.explode(fold.frac_periods(F.col("P"), F.col("ncad"))).alias("Pcad"))
    b = s.select("star", F.lit("unit").alias("kind"), F.explode(fold.unit_periods(F.col("P"))).alias("Pcad"))
    return a.unionByName(b).withColumn("Pcad", r6("Pcad"))


QUERIES["frac_periods"] = frac_periods
SQL["frac_periods"] = f"""WITH {HOURLY}, s AS (SELECT star, max(cad) - min(cad) + 1 AS ncad FROM hourly GROUP BY star),
p AS (SELECT star, ncad, unnest(range({P1}, {P2}))::DOUBLE AS P FROM s)
SELECT star, 'search' AS kind, {s6('x')} AS Pcad FROM (SELECT star, {_FRAC.format(P='P')} AS x FROM p)
UNION ALL SELECT star, 'unit', {s6('x')} FROM (SELECT star, unnest(list_transform(range(CAST(ceil(1 / (1 / P)) AS BIGINT)), lambda j: P + j * (1 / P))) AS x FROM p)"""


def wrap(spark, sf):
    x = fold.with_index(hourly_dense(spark, sf))
    row, col = fold.wrap(F.col("i"), F.lit(23.7))
    return x.select("star", "cad", row.alias("row"), col.alias("col"))


QUERIES["wrap"] = wrap
SQL["wrap"] = f"""WITH {HOURLY_DENSE}, {indexed_sql('hd', 'ix')} SELECT star, cad, CAST(floor(i / 23.7::DOUBLE) AS BIGINT) AS row,
 CAST(floor(i % 23.7::DOUBLE) AS BIGINT) AS col FROM ix"""


def wrap_array(spark, sf):
    x = fold.with_index(hourly_dense(spark, sf)).select("star", "cad", "i", "ncad")
    a = fold.wrap_shifted(x, F.lit(23.7)).select("star", "cad", "nrow", "row", "col")
    b = fold.wrap_padded(x, F.lit(23).cast("long")).select("star", "cad", F.col("m").alias("padded_rows"), F.col("row").alias("row0"), F.col("col").alias("col0"))
    return a.join(b, ["star", "cad"])


QUERIES["wrap_array"] = wrap_array
SQL["wrap_array"] = f"""WITH {HOURLY_DENSE}, {indexed_sql('hd', 'ix')},
n AS (SELECT star, cad, i, CAST(floor(ncad / 23) AS BIGINT) + 1 AS nrow, i // 23 AS row, i % 23 AS c0 FROM ix)
SELECT star, cad, nrow, row, CAST((c0 - round_even(row * (round_even(23 * 0.7::DOUBLE, 0) / (nrow - 1)), 0) + 230) % 23 AS BIGINT) AS col,
 CAST(pow(2, ceil(log2(nrow))) AS BIGINT) AS padded_rows, row AS row0, c0 AS col0 FROM n"""


def ffa_sql(src, out, p1, p2, n_stages, keys="star", extra=""):
    """SQL of the doubling recurrence; ``src`` has (keys, P0, k, row, col, s, n)."""
    parts = [f"{out}_0 AS (SELECT {keys}, P0, k, row, col, sum(s) AS s, sum(n) AS n FROM {src} GROUP BY ALL)"]
    for st in range(1, n_stages + 1):
        h = 1 << (st - 1)
        prev = f"{out}_{st - 1}"
        blk, b = f"(row // {h})", f"(row % {h})"
        step = lambda d: (
            f"SELECT {keys}, P0, k, ({blk} // 2) * {2 * h} + 2 * {b} + {d} AS row, "
            f"(col + P0 - CASE WHEN {blk} % 2 = 1 THEN {b} + {d} ELSE 0 END % P0) % P0 AS col, s, n FROM {prev} WHERE k >= {st}"
        )
        parts.append(
            f"{out}_{st} AS (SELECT {keys}, P0, k, row, col, sum(s) AS s, sum(n) AS n FROM ("
            f"{step(0)} UNION ALL {step(1)} UNION ALL SELECT {keys}, P0, k, row, col, s, n FROM {prev} WHERE k < {st}) GROUP BY ALL)"
        )
    parts.append(f"{out} AS (SELECT *, P0 + row / (pow(2, k) - 1) AS pcad FROM {out}_{n_stages})")
    return ",\n".join(parts)


def padded_sql(src, out, p1, p2, value, ok, keys="star"):
    return f"""{out} AS (SELECT {keys}, P0, CAST(ceil(log2(floor(ncad / P0) + 1)) AS INT) AS k, i // P0 AS row, i % P0 AS col, {value} AS s, 1 AS n
   FROM {src}, (SELECT unnest(range({p1}, {p2})) AS P0) WHERE {ok})"""


N_STAGES = math.ceil(math.log2(721 // P1 + 1))


def ffa(spark, sf):
    x = fold.with_index(hourly_dense(spark, sf)).where("f IS NOT NULL")
    f = fold.fold_ffa(x, P1, P2, {"s": F.col("f"), "n": F.lit(1).cast("long")})
    return f.select("star", "P0", "row", "col", "s", "n", r6("Pcad").alias("Pcad"))


QUERIES["ffa"] = ffa
SQL["ffa"] = f"""WITH {HOURLY_DENSE}, {indexed_sql('hd', 'ix')}, {padded_sql('ix', 'pd', P1, P2, 'f', 'f IS NOT NULL')},
{ffa_sql('pd', 'ff', P1, P2, N_STAGES)}
SELECT star, P0, row, col, s, CAST(n AS BIGINT) AS n, {s6('pcad')} AS Pcad FROM ff"""


def fold_ffa(spark, sf):
    d = windows.mean_depth(hourly_centred(spark, sf), (3,))
    x = fold.with_index(d).where("d IS NOT NULL")
    f = fold.fold_ffa(x, P1, P2, {"s": F.col("d"), "n": F.lit(1).cast("long")})
    return f.select("star", "P0", "row", "col", "n", r6(F.try_divide("s", "n") / 7).alias("mean_7th"))


QUERIES["fold_ffa"] = fold_ffa
SQL["fold_ffa"] = f"""WITH {HOURLY_CENTRED}, {mean_depth_sql('hc', 'md', (3,))}, {indexed_sql('md', 'ix', 't, d')},
{padded_sql('ix', 'pd', P1, P2, 'd', 'd IS NOT NULL')}, {ffa_sql('pd', 'ff', P1, P2, N_STAGES)}
SELECT star, P0, row, col, CAST(n AS BIGINT) AS n, {s6('s / n / 7')} AS mean_7th FROM ff"""


def fold_columns(spark, sf):
    x = fold.with_index(hourly_dense(spark, sf))
    f, _ = fold.fold_columns(x, F.lit(P1), F.lit(P2), expand=lambda P: fold.frac_periods(P, F.col("ncad")))
    return f.select("star", r6("Pcad").alias("Pcad"), "col", "c", "s", "ss")


def fold_sql(src, out, p1, p2, ok="f IS NOT NULL", v="f"):
    return f"""{frac_sql(p1, p2, out + '_p', src)},
{out} AS (SELECT star, pb, pcad, CAST(floor(i % pcad) AS BIGINT) AS col, count(CASE WHEN {ok} THEN 1 END) AS c,
   coalesce(sum(CASE WHEN {ok} THEN {v} END), 0) AS s, coalesce(sum(CASE WHEN {ok} THEN {v} * {v} END), 0) AS ss
   FROM {src} JOIN {out}_p USING (star) GROUP BY ALL)"""


QUERIES["fold_columns"] = fold_columns
SQL["fold_columns"] = f"""WITH {HOURLY_DENSE}, {indexed_sql('hd', 'ix')}, {fold_sql('ix', 'fc', P1, P2)}
SELECT star, {s6('pcad')} AS Pcad, col, c, s, ss FROM fc"""


def fold_phase_bins(spark, sf):
    x = fold.with_index(hourly_dense(spark, sf))
    f, _ = fold.fold_phase_bins(x, lambda j: F.lit(0.8) + j * 0.01, 30, 16)
    return f.select("star", "jf", r6("freq").alias("freq"), F.col("col").alias("bin"), "c", "s", "ss")


def phase_bins_sql(src, out, nf, fmin, df, nb, v="f", ok="f IS NOT NULL"):
    return f"""{out}_f AS (SELECT jf, {fmin}::DOUBLE + jf * {df}::DOUBLE AS freq FROM range({nf}) r(jf)),
{out}_b AS (SELECT star, jf, freq, CAST(floor({nb} * (u - floor(u))) AS INT) AS col, {v} AS v
   FROM (SELECT *, (t - t_first) * freq AS u FROM {src}, {out}_f WHERE {ok})),
{out} AS (SELECT star, jf, freq, col, coalesce(c, 0) AS c, coalesce(s, 0) AS s, coalesce(ss, 0) AS ss
   FROM (SELECT star, jf, freq, col FROM (SELECT DISTINCT star FROM {src}), {out}_f, (SELECT unnest(range({nb}))::INT AS col))
   LEFT JOIN (SELECT star, jf, col, count(*) AS c, sum(v) AS s, sum(v * v) AS ss FROM {out}_b GROUP BY ALL) USING (star, jf, col))"""


QUERIES["fold_phase_bins"] = fold_phase_bins
SQL["fold_phase_bins"] = f"""WITH {HOURLY_DENSE}, {indexed_sql('hd', 'ix')}, {phase_bins_sql('ix', 'pb', 30, 0.8, 0.01, 16)}
SELECT star, jf, {s6('freq')} AS freq, col AS bin, c, s, ss FROM pb"""


def cumsum_top(k):
    def run(spark, sf):
        x = fold.with_index(hourly_dense(spark, sf)).select("star", "i", "ncad", "f")
        y, by = fold.spread_periods(x, F.lit(P1), F.lit(P2))
        row, col = fold.wrap(F.col("i"), F.col("Pcad"))
        y = y.withColumns({"row": row, "col": col})
        g, _ = fold.cumsum_top(y, by, ["Pcad", "col"], F.col("f"), F.col("row"), 721 // P1 + 1, k=k)
        return g.select("star", F.col("Pcad").cast("int").alias("Pcad"), "col", *[f"{n}{j}" for n in "sc" for j in range(k + 1)])

    return run


for _k, _name in ((2, "cumsum_top"), (1, "cumsum_top_one"), (3, "cumsum_top_three")):
    QUERIES[_name] = cumsum_top(_k)
    SQL[_name] = f"""WITH {HOURLY_DENSE}, {indexed_sql('hd', 'ix')},
p AS (SELECT star, pc AS Pcad, i % pc AS col, f FROM ix, (SELECT unnest(range({P1}, {P2})) AS pc)),
r AS (SELECT *, row_number() OVER (PARTITION BY star, Pcad, col ORDER BY f DESC NULLS LAST) AS rn FROM p)
SELECT star, Pcad::INT AS Pcad, col, {', '.join(f'coalesce(sum(f) FILTER (rn > {j}), 0) AS s{j}, count(f) FILTER (rn > {j}) AS c{j}' for j in range(_k + 1))} FROM r GROUP BY ALL"""
