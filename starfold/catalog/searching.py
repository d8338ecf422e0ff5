"""Queries: period searches, ranking and peaks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from starfold.catalog.base import (
    DAILY_INJECTED,
    HOURLY_CENTRED,
    daily_injected,
    hourly_centred,
    r6,
    s6,
)
from starfold.catalog.folding import N_STAGES, P1, P2, ffa_sql, frac_sql, indexed_sql, padded_sql
from starfold.catalog.windows import box_depth_sql, mean_depth_sql
from starfold.functions import stats
from starfold.operators import fold, search, windows

QUERIES, SQL = {}, {}
TWDS = (2, 3, 5)
D1, D2, DTW = 25, 30, (2, 3, 5)


def best_epoch(spark, sf):
    d = windows.mean_depth(hourly_centred(spark, sf), (3,))
    x = fold.with_index(d).where("d IS NOT NULL")
    f = fold.fold_ffa(x, P1, P2, {"s": F.col("d"), "n": F.lit(1).cast("long")})
    return search.best_epoch(f, ["star", "P0", "Pcad"]).select(
        "star", "P0", r6("Pcad").alias("Pcad"), r6(F.col("mean") / 7).alias("mean_7th"), "count"
    )


_FOLDED = f"""{HOURLY_CENTRED}, {mean_depth_sql('hc', 'md', TWDS)}, {indexed_sql('md', 'ix0', 't, d, twd')},
ix AS (SELECT * FROM ix0), {padded_sql('ix', 'pd', P1, P2, 'd', 'd IS NOT NULL', 'star, twd')},
{ffa_sql('pd', 'ff', P1, P2, N_STAGES, 'star, twd')}"""
_CAD = "cad AS (SELECT star, min(t) AS t_first, (max(t) - min(t)) / (max(cad) - min(cad)) AS dt FROM {src} GROUP BY star)"
_TDPEP = f"""{_FOLDED}, {_CAD.format(src='hd')},
ns AS (SELECT star, twd, median(abs(d)) AS noise FROM md GROUP BY star, twd),
be AS (SELECT star, twd, P0, pcad, s / n AS mean, col, n FROM ff QUALIFY row_number() OVER (PARTITION BY star, twd, P0, pcad ORDER BY s / n DESC, col) = 1),
dpe AS (SELECT be.*, noise, mean / nullif(noise, 0) * sqrt(n) AS s2n, col * dt + t_first AS t0 FROM be JOIN ns USING (star, twd) JOIN cad USING (star))"""

QUERIES["best_epoch"] = best_epoch
SQL["best_epoch"] = f"""WITH {_FOLDED} SELECT star, P0, {s6('pcad')} AS Pcad, {s6('s / n / 7')} AS mean_7th, CAST(n AS BIGINT) AS count FROM ff WHERE twd = 3
QUALIFY row_number() OVER (PARTITION BY star, P0, pcad ORDER BY s / n DESC, col) = 1"""

QUERIES["duration_period_epoch"] = lambda spark, sf: search.duration_period_epoch(hourly_centred(spark, sf), P1, P2, TWDS).select(
    "star", "twd", r6("Pcad").alias("Pcad"), r6(F.col("mean") / 7).alias("mean_7th"), "count", r6("s2n").alias("s2n"), r6("noise").alias("noise")
)
SQL["duration_period_epoch"] = f"""WITH {_TDPEP} SELECT star, twd, {s6('pcad')} AS Pcad, {s6('mean / 7')} AS mean_7th, CAST(n AS BIGINT) AS count,
 {s6('s2n')} AS s2n, {s6('noise')} AS noise FROM dpe"""


def best_duration(spark, sf):
    p = search.duration_period_epoch(hourly_centred(spark, sf), P1, P2, TWDS)
    return search.best_duration(p, ("star", "P0", "Pcad")).select("star", "P0", r6("Pcad").alias("Pcad"), "twd", r6("s2n").alias("s2n"))


QUERIES["best_duration"] = best_duration
SQL["best_duration"] = f"""WITH {_TDPEP} SELECT star, P0, {s6('pcad')} AS Pcad, twd, {s6('s2n')} AS s2n FROM dpe
QUALIFY row_number() OVER (PARTITION BY star, P0, pcad ORDER BY s2n DESC, twd) = 1"""

QUERIES["search_ffa"] = lambda spark, sf: search.search_ffa(hourly_centred(spark, sf), P1, P2, TWDS).select(
    "star", r6("Pcad").alias("Pcad"), "twd", r6("s2n").alias("s2n"), r6("t0").alias("t0"), r6(F.col("mean") / 7).alias("mean_7th"), "count"
)
SQL["search_ffa"] = f"""WITH {_TDPEP} SELECT star, {s6('pcad')} AS Pcad, twd, {s6('s2n')} AS s2n, {s6('t0')} AS t0, {s6('mean / 7')} AS mean_7th, CAST(n AS BIGINT) AS count FROM dpe
QUALIFY row_number() OVER (PARTITION BY star, P0, pcad ORDER BY s2n DESC, twd) = 1"""


def clipped_sql(centred, src, out, p1, p2, twds):
    """SQL of the outlier-proof search over integer limits."""
    return f"""{box_depth_sql(src, out + '_d', twds)},
{indexed_sql(src, out + '_x', 'f')}, {frac_sql(p1, p2, out + '_p', out + '_x')}, {_CAD.format(src=src).replace('cad AS (', out + '_c AS (', 1)},
{out}_n AS (SELECT star, twd, median(abs(depth)) * 1.5::DOUBLE AS noise FROM {out}_d WHERE good GROUP BY star, twd),
{out}_r AS (SELECT star, twd, pcad, CAST(floor(i % pcad) AS BIGINT) AS col, depth AS d,
   row_number() OVER (PARTITION BY star, twd, pcad, floor(i % pcad) ORDER BY depth DESC) AS rn
   FROM {out}_d d JOIN {out}_x USING (star, cad) JOIN {out}_p USING (star) WHERE good),
{out}_g AS (SELECT star, twd, pcad, col, sum(d) AS s0, count(*) AS c0, sum(d) - max(d) AS s1, sum(d) - max(d) - max(d) FILTER (rn = 2) AS s2
   FROM {out}_r GROUP BY ALL HAVING count(*) >= 3),
{out}_b AS (SELECT *, s0 / c0 AS mean, s0 / sqrt(c0) AS q FROM {out}_g WHERE s1 / (c0 - 1) > s0 / c0 * 0.5::DOUBLE AND s2 / (c0 - 2) > s0 / c0 * 0.5::DOUBLE
   QUALIFY row_number() OVER (PARTITION BY star, twd, pcad ORDER BY s0 / sqrt(c0) DESC, col) = 1),
{out} AS (SELECT star, pcad, twd, q / noise AS s2n, c0 AS c, mean, (col + twd / 2::DOUBLE) * dt + t_first AS t0, noise, pcad * dt AS P, twd * dt AS tdur
   FROM {out}_b JOIN {out}_n USING (star, twd) JOIN {out}_c USING (star) QUALIFY row_number() OVER (PARTITION BY star, pcad ORDER BY q / noise DESC, twd) = 1)"""


def clipped_limits_sql(src, out, lim, twds):
    """SQL of the outlier-proof search over limits per star and segment: ``lim`` has (star, seg, p1, p2,
    twdg), all its durations among ``twds``."""
    return f"""{box_depth_sql(src, out + '_d', twds)}, {indexed_sql(src, out + '_x', 'f')}, {_CAD.format(src=src).replace('cad AS (', out + '_c AS (', 1)},
{out}_n AS (SELECT star, twd, median(abs(depth)) * 1.5::DOUBLE AS noise FROM {out}_d WHERE good GROUP BY star, twd),
{out}_pb AS (SELECT star, seg, twdg, ncad, p1 + unnest(range(CAST(ceil(p2 - p1) AS BIGINT))) AS pb FROM {lim} JOIN (SELECT DISTINCT star, ncad FROM {out}_x) USING (star)),
{out}_p AS (SELECT star, seg, twdg, unnest(list_transform(range(CAST(ceil(1 / (pb / ncad)) AS BIGINT)), lambda j: pb + j * (pb / ncad))) AS pcad FROM {out}_pb),
{out}_g AS (SELECT star, seg, twd, pcad, CAST(floor(i % pcad) AS BIGINT) AS col, sum(depth) AS s0, count(*) AS c0, max(depth, 2) AS m
   FROM {out}_d d JOIN {out}_x USING (star, cad) JOIN {out}_p p USING (star) WHERE good AND list_contains(twdg, twd) GROUP BY ALL HAVING count(*) >= 3),
{out}_b AS (SELECT *, s0 / c0 AS mean, s0 / sqrt(c0) AS q FROM {out}_g
   WHERE (s0 - m[1]) / (c0 - 1) > s0 / c0 * 0.5::DOUBLE AND (s0 - m[1] - m[2]) / (c0 - 2) > s0 / c0 * 0.5::DOUBLE
   QUALIFY row_number() OVER (PARTITION BY star, seg, twd, pcad ORDER BY s0 / sqrt(c0) DESC, col) = 1),
{out} AS (SELECT star, pcad, twd, q / noise AS s2n, c0 AS c, mean, (col + twd / 2::DOUBLE) * dt + t_first AS t0, noise, pcad * dt AS P, twd * dt AS tdur
   FROM {out}_b JOIN {out}_n USING (star, twd) JOIN {out}_c USING (star) QUALIFY row_number() OVER (PARTITION BY star, seg, pcad ORDER BY q / noise DESC, twd) = 1)"""


def peak_sql(src, out):
    return f"{out} AS (SELECT star, s2n, P, t0, tdur, mean FROM {src} QUALIFY row_number() OVER (PARTITION BY star ORDER BY s2n DESC, P) = 1)"


_CLIPPED = f"{DAILY_INJECTED}, {clipped_sql(None, 'di', 'pg', D1, D2, DTW)}"


def clipped(spark, sf):
    return search.search_clipped(daily_injected(spark, sf), D1, D2, DTW)


def _pgram(df):
    return df.select(
        "star", r6("Pcad").alias("Pcad"), "twd", r6("s2n").alias("s2n"), "c", r6(F.col("mean") / F.col("noise")).alias("depth"),
        r6("t0").alias("t0"), r6("noise").alias("noise"), r6("P").alias("P"), r6("tdur").alias("tdur"),
    )


_PG_COLS = f"""star, {s6('pcad')} AS Pcad, twd, {s6('s2n')} AS s2n, c, {s6('mean / noise')} AS depth, {s6('t0')} AS t0, {s6('noise')} AS noise,
 {s6('P')} AS P, {s6('tdur')} AS tdur"""
QUERIES["search_clipped"] = lambda spark, sf: _pgram(clipped(spark, sf))
SQL["search_clipped"] = f"WITH {_CLIPPED} SELECT {_PG_COLS} FROM pg"


def periodogram(spark, sf):
    d = daily_injected(spark, sf)
    segs = [{"P1": 20.0, "P2": 22.0, "twdG": [2, 3]}, {"Pcad1": 26, "Pcad2": 28, "twdG": [3, 5]}]
    return _pgram(search.periodogram(d, segs, "max"))


QUERIES["periodogram"] = periodogram
SQL["periodogram"] = f"""WITH {DAILY_INJECTED}, {clipped_sql(None, 'di', 'a', 20, 22, (2, 3))}, {clipped_sql(None, 'di', 'b', 26, 28, (3, 5))}
SELECT {_PG_COLS} FROM a UNION ALL SELECT {_PG_COLS} FROM b"""



def _halved(df):
    """The first series of the three on a time scale of half a day per cadence."""
    return df.withColumn("t", F.when(F.col("star") == "A", F.col("t") / 2).otherwise(F.col("t")))


def periodogram_mixed(spark, sf):
    segs = [{"P1": 20.0, "P2": 21.0, "twdG": [2, 3]}]
    return _pgram(search.periodogram(_halved(daily_injected(spark, sf)), segs, "max"))


# In cadences the same limits are twice as far up for the series with the half-day cadence.
QUERIES["periodogram_mixed_cadence"] = periodogram_mixed
SQL["periodogram_mixed_cadence"] = f"""WITH {DAILY_INJECTED}, dm AS (SELECT * REPLACE (CASE WHEN star = 'A' THEN t / 2 ELSE t END AS t) FROM di),
da AS (SELECT * FROM dm WHERE star = 'A'), db AS (SELECT * FROM dm WHERE star <> 'A'),
{clipped_sql(None, 'da', 'a', 40, 42, (2, 3))}, {clipped_sql(None, 'db', 'b', 20, 21, (2, 3))}
SELECT {_PG_COLS} FROM a UNION ALL SELECT {_PG_COLS} FROM b"""


MIXED = [{"P1": 20.0, "P2": 21.0, "twdG": [2, 3]}, {"P1": 26.0, "P2": 27.0, "twdG": [3, 4, 5]}]


def periodogram_mode(mode):
    """Two segments in time units over series of two cadences, all in one plan."""

    def run(spark, sf):
        p = search.periodogram(_halved(daily_injected(spark, sf)), MIXED, mode)
        return p.select("star", r6("Pcad").alias("Pcad"), "twd", r6("s2n").alias("s2n"), r6("t0").alias("t0"), r6("P").alias("P"), r6("tdur").alias("tdur"))

    return run


def _mixed_sql(part):
    """The segments of both groups of series one by one: ``part`` gives (relations, select) for a source,
    its dense source, a prefix, limits in cadences and durations."""
    rel, out = [], []
    for src, name, per in (("da", "a", 2), ("db", "b", 1)):
        for n, s in enumerate(MIXED):
            r, o = part(src, f"{name}{n}", int(s["P1"] * per), int(s["P2"] * per), tuple(s["twdG"]))
            rel.append(r)
            out.append(o)
    return f"""WITH {DAILY_INJECTED}, dm AS (SELECT * REPLACE (CASE WHEN star = 'A' THEN t / 2 ELSE t END AS t) FROM di),
da AS (SELECT * FROM dm WHERE star = 'A'), db AS (SELECT * FROM dm WHERE star <> 'A'),
{', '.join(rel)} {' UNION ALL '.join(out)}"""


def _mode_cols(s2n, t0, twd="twd"):
    return f"star, {s6('pcad')} AS Pcad, {twd}::INT AS twd, {s6(s2n)} AS s2n, {s6(t0)} AS t0, {s6('pcad * dt')} AS P, {s6(f'{twd} * dt')} AS tdur"


def _ffa_part(src, o, p1, p2, twds):
    stages = math.ceil(math.log2(DAYS // p1 + 1))
    rel = f"""{mean_depth_sql(src, o + '_m', twds)}, {indexed_sql(o + '_m', o + '_x', 't, d, twd')}, {padded_sql(o + '_x', o + '_p', p1, p2, 'd', 'd IS NOT NULL', 'star, twd')},
{ffa_sql(o + '_p', o + '_f', p1, p2, stages, 'star, twd')}, {_CAD.format(src=src).replace('cad AS (', o + '_c AS (', 1)},
{o}_n AS (SELECT star, twd, median(abs(d)) AS noise FROM {o}_m GROUP BY star, twd),
{o}_b AS (SELECT star, twd, P0, pcad, s / n AS mean, col, n FROM {o}_f QUALIFY row_number() OVER (PARTITION BY star, twd, P0, pcad ORDER BY s / n DESC, col) = 1),
{o} AS (SELECT *, mean / nullif(noise, 0) * sqrt(n) AS q FROM {o}_b JOIN {o}_n USING (star, twd) JOIN {o}_c USING (star)
   QUALIFY row_number() OVER (PARTITION BY star, P0, pcad ORDER BY mean / nullif(noise, 0) * sqrt(n) DESC, twd) = 1)"""
    return rel, f"SELECT {_mode_cols('q', 'col * dt + t_first')} FROM {o}"


def _bls_part(src, o, p1, p2, twds):
    from starfold.catalog.boxes import box_sql
    from starfold.catalog.folding import fold_sql

    rel = f"""{indexed_sql(src, o + '_x')}, {fold_sql(o + '_x', o + '_f', p1, p2, 'NOT fmask')}, {box_sql(o + '_f', o + '_bx', 'star, pcad', (twds[0], twds[-1]))},
{_CAD.format(src=src).replace('cad AS (', o + '_c AS (', 1)},
{o}_v AS (SELECT *, sqrt((c * ss - s * s) / nullif(c * (c - 1), 0)) / sqrt(c) AS noise FROM {o}_bx WHERE c > width AND c > 1 AND c * ss - s * s > 0),
{o} AS (SELECT *, -s / (c * noise) AS q FROM {o}_v JOIN {o}_c USING (star) WHERE -s / (c * noise) > -1
   QUALIFY row_number() OVER (PARTITION BY star, pcad ORDER BY -s / (c * noise) DESC, col, width) = 1)"""
    return rel, f"SELECT {_mode_cols('q', 't_first + (col + width // 2) * dt', 'width')} FROM {o}"


def _fm_part(src, o, p1, p2, twds):
    rel = f"""{box_depth_sql(src, o + '_d', twds)}, {indexed_sql(src, o + '_x', 'f')}, {frac_sql(p1, p2, o + '_p', o + '_x')},
{_CAD.format(src=src).replace('cad AS (', o + '_c AS (', 1)},
{o}_g AS (SELECT star, pcad, twd, CAST(floor(i % pcad) AS BIGINT) AS col, sum(ivar) AS w, sum(ivar * depth) AS wd, sum(ivar * depth * depth) AS wdd, sum(dll) AS dll, count(*) AS nind
   FROM {o}_d JOIN {o}_x USING (star, cad) JOIN {o}_p USING (star) WHERE good GROUP BY ALL),
{o}_h AS (SELECT *, wd / w AS d2, dll - (wdd - wd / w * wd) * 0.5::DOUBLE - 0.5::DOUBLE * ln(1200) AS same, dll - nind * 0.5::DOUBLE * ln(1200) AS var FROM {o}_g),
{o} AS (SELECT * FROM {o}_h JOIN {o}_c USING (star) WHERE d2 > 0 AND same > var AND nind >= 2 QUALIFY row_number() OVER (PARTITION BY star, pcad ORDER BY same DESC, twd, col) = 1)"""
    return rel, f"SELECT {_mode_cols('d2 * sqrt(w)', 't_first + (col + twd // 2) * dt')} FROM {o}"


#: Days that the daily series may span.
DAYS = 2499
for _mode, _part in (("ffa", _ffa_part), ("bls", _bls_part), ("fm", _fm_part)):
    QUERIES[f"periodogram_{_mode}"] = periodogram_mode(_mode)
    SQL[f"periodogram_{_mode}"] = _mixed_sql(_part)


QUERIES["bin_periodogram"] = lambda spark, sf: search.bin_periodogram(clipped(spark, sf), 40).select(
    "star", "Pbin", r6("P").alias("P"), r6("s2n").alias("s2n"), "twd"
)
SQL["bin_periodogram"] = f"""WITH {_CLIPPED}, l AS (SELECT *, log10(min(P) OVER w) AS lo, log10(max(P) OVER w) AS hi FROM pg WINDOW w AS (PARTITION BY star)),
b AS (SELECT *, CAST(least(greatest(ceil(round((log10(P) - lo) / (hi - lo) * 39, 9)) - 1, 0), 38) AS INT) AS Pbin FROM l)
SELECT star, Pbin, {s6('P')} AS P, {s6('s2n')} AS s2n, twd FROM b QUALIFY row_number() OVER (PARTITION BY star, Pbin ORDER BY s2n DESC, P) = 1"""

QUERIES["peak"] = lambda spark, sf: search.peak(clipped(spark, sf)).select(
    "star", r6("grid_s2n").alias("grid_s2n"), r6("grid_P").alias("grid_P"), r6("grid_t0").alias("grid_t0"), r6("grid_tdur").alias("grid_tdur")
)
SQL["peak"] = f"""WITH {_CLIPPED} SELECT star, {s6('s2n')} AS grid_s2n, {s6('P')} AS grid_P, {s6('t0')} AS grid_t0, {s6('tdur')} AS grid_tdur FROM pg
QUALIFY row_number() OVER (PARTITION BY star ORDER BY s2n DESC, P) = 1"""

EDGES = [25.5, 26.0, 26.5, 27.0, 27.5, 28.0, 29.0]
QUERIES["find_peaks"] = lambda spark, sf: search.find_peaks(clipped(spark, sf), "Pcad", "s2n", EDGES).select(
    "star", "bin", r6("Pcad").alias("Pcad"), r6("s2n").alias("s2n")
)
SQL["find_peaks"] = f"""WITH {_CLIPPED}, b AS (SELECT *, {' + '.join(f'(pcad >= {e})::INT' for e in EDGES)} AS bin FROM pg),
m AS (SELECT *, min(bin) OVER (PARTITION BY star) AS lo, max(bin) OVER (PARTITION BY star) AS hi FROM b)
SELECT star, bin, {s6('pcad')} AS Pcad, {s6('s2n')} AS s2n FROM m WHERE bin > lo AND bin < hi QUALIFY row_number() OVER (PARTITION BY star, bin ORDER BY s2n DESC, pcad) = 1"""


def likelihood(spark, sf):
    p = search.search_likelihood(daily_injected(spark, sf), D1, D2, DTW)
    return p.select(
        "star", r6("Pcad").alias("Pcad"), "twd", "col", "nind", r6("s2n").alias("s2n"), r6("phic_same").alias("phic_same"), r6("t0").alias("t0")
    )


QUERIES["search_likelihood"] = likelihood
SQL["search_likelihood"] = f"""WITH {DAILY_INJECTED}, {box_depth_sql('di', 'bd', DTW)}, {indexed_sql('di', 'ix', 'f')}, {frac_sql(D1, D2, 'p', 'ix')},
{_CAD.format(src='di')},
g AS (SELECT star, pcad, twd, CAST(floor(i % pcad) AS BIGINT) AS col, sum(ivar) AS w, sum(ivar * depth) AS wd, sum(ivar * depth * depth) AS wdd, sum(dll) AS dll, count(*) AS nind
   FROM bd JOIN ix USING (star, cad) JOIN p USING (star) WHERE good GROUP BY ALL),
h AS (SELECT *, wd / w AS d2, dll - (wdd - wd / w * wd) * 0.5::DOUBLE - 0.5::DOUBLE * ln(1200) AS same, dll - nind * 0.5::DOUBLE * ln(1200) AS var FROM g),
b AS (SELECT * FROM h WHERE d2 > 0 AND same > var AND nind >= 2 QUALIFY row_number() OVER (PARTITION BY star, pcad ORDER BY same DESC, twd, col) = 1)
SELECT star, {s6('pcad')} AS Pcad, twd, col, nind, {s6('d2 * sqrt(w)')} AS s2n, {s6('same')} AS phic_same,
 {s6('t_first + (col + twd // 2) * dt')} AS t0 FROM b JOIN cad USING (star)"""
