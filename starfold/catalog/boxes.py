"""Queries: the box-search family."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.catalog.base import HOURLY_CENTRED, hourly_centred, r6, s6
from starfold.catalog.folding import P1, P2, fold_sql, indexed_sql, phase_bins_sql
from starfold.operators import boxes, fold

QUERIES, SQL = {}, {}
OK = "NOT fmask"


def box_sql(src, out, keys, widths, wrap=True):
    """SQL of all boxes by direct summation; ``src`` has (keys, col, c, s, ss)."""
    n = f"(max(col) OVER (PARTITION BY {keys}) + 1)"
    dup = f"SELECT {keys}, col + n AS col, c, s, ss FROM {out}_n" if wrap else f"SELECT {keys}, col, c, s, ss FROM {out}_n WHERE false"
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    lim = "" if wrap else " AND a.col + w.width <= a.n"
    return f"""{out}_n AS (SELECT *, {n} AS n, sum(c) OVER (PARTITION BY {keys}) AS tot FROM {src}),
{out}_2 AS (SELECT {keys}, col, c, s, ss FROM {out}_n UNION ALL {dup}),
{out} AS (SELECT {ks}, a.col, w.width, any_value(a.tot)::BIGINT AS tot, any_value(a.n) AS n, sum(b.c) AS c, sum(b.s) AS s, sum(b.ss) AS ss
   FROM {out}_n a JOIN (SELECT unnest(range({widths[0]}, {widths[1] + 1})) AS width) w ON true JOIN {out}_2 b
   ON {on} AND b.col >= a.col AND b.col < a.col + w.width WHERE true{lim} GROUP BY {ks}, a.col, w.width)"""


_BASE = f"{HOURLY_CENTRED}, {indexed_sql('hc', 'ix')}"
_INT = f"""{_BASE}, fi AS (SELECT star, pc::DOUBLE AS pcad, i % pc AS col, count(CASE WHEN {OK} THEN 1 END) AS c, coalesce(sum(CASE WHEN {OK} THEN f END), 0) AS s,
  coalesce(sum(CASE WHEN {OK} THEN f * f END), 0) AS ss FROM ix, (SELECT unnest(range({P1}, {P2})) AS pc) GROUP BY ALL)"""


def integer_fold(spark, sf):
    x = fold.with_index(hourly_centred(spark, sf))
    f, by = fold.fold_columns(x, F.lit(P1), F.lit(P2), "f", F.expr("NOT fmask"))
    return f, [*by, "Pcad"]


def bls(min_count):
    def run(spark, sf):
        p = boxes.search_bls(hourly_centred(spark, sf), P1, P2, 2, 6, min_count)
        return p.select(
            "star", r6("Pcad").alias("Pcad"), "twd", "col", r6("s2n").alias("s2n"), r6("noise").alias("noise"), r6(F.col("mean") / 7).alias("mean_7th"), r6("t0").alias("t0")
        )

    return run


def _bls_sql(floor):
    return f"""WITH {_BASE}, {fold_sql('ix', 'fc', P1, P2, OK)}, {box_sql('fc', 'bx', 'star, pcad', (2, 6))},
v AS (SELECT *, sqrt((c * ss - s * s) / nullif(c * (c - 1), 0)) / sqrt(c) AS noise FROM bx WHERE c > {floor} AND c > 1 AND c * ss - s * s > 0),
b AS (SELECT *, -s / (c * noise) AS s2n FROM v WHERE -s / (c * noise) > -1 QUALIFY row_number() OVER (PARTITION BY star, pcad ORDER BY -s / (c * noise) DESC, col, width) = 1),
cad AS (SELECT star, min(t) AS t_first, (max(t) - min(t)) / (max(cad) - min(cad)) AS dt FROM hd GROUP BY star)
SELECT star, {s6('pcad')} AS Pcad, width::INT AS twd, col, {s6('s2n')} AS s2n, {s6('noise')} AS noise, {s6('-s / c / 7')} AS mean_7th,
 {s6('t_first + (col + width // 2) * dt')} AS t0 FROM b JOIN cad USING (star)"""


QUERIES["search_bls"] = bls(None)
SQL["search_bls"] = _bls_sql("width")
QUERIES["search_bls_points"] = bls(1)
SQL["search_bls_points"] = _bls_sql("1")

_SCORE = {
    "sr": ("s * s / nullif(c * (tot - c), 0)", "sqrt({})"),
    "sr_pos": ("CASE WHEN s < 0 THEN s * s / nullif(c * (tot - c), 0) END", "sqrt({})"),
    "snr": ("CASE WHEN ss - s * s / nullif(c, 0) > 0 THEN -s * tot / nullif((tot - c) * sqrt(ss - s * s / c), 0) END", "{}"),
}


def box_stat(stat):
    def run(spark, sf):
        f, keys = integer_fold(spark, sf)
        b = boxes.box_stat(f, keys, F.col("Pcad"), 2, 6, stat)
        return b.select("star", F.col("Pcad").cast("int").alias("Pcad"), r6("power").alias("power"), "width", "col")

    return run


for _s, (_e, _r) in _SCORE.items():
    QUERIES[f"box_stat_{_s}"] = box_stat(_s)
    SQL[f"box_stat_{_s}"] = f"""WITH {_INT}, {box_sql('fi', 'bx', 'star, pcad', (2, 6))},
p AS (SELECT *, {_e} AS power FROM bx)
SELECT star, pcad::INT AS Pcad, {s6(_r.format('power'))} AS power, width::INT AS width, col FROM p WHERE power > 0
QUALIFY row_number() OVER (PARTITION BY star, pcad ORDER BY power DESC, col, width) = 1"""


def box_fractional(spark, sf):
    f, keys = integer_fold(spark, sf)
    b = boxes.box_stat_fractional(f, keys, F.col("Pcad"), 0.1, 0.3)
    return b.select("star", F.col("Pcad").cast("int").alias("Pcad"), r6("power").alias("power"), "width", "col")


QUERIES["box_stat_fractional"] = box_fractional
SQL["box_stat_fractional"] = f"""WITH {_INT}, {box_sql('fi', 'bx', 'star, pcad', (1, 9))},
p AS (SELECT *, {_SCORE['sr'][0]} AS power FROM bx WHERE width BETWEEN floor(pcad * 0.1::DOUBLE) AND floor(pcad * 0.3::DOUBLE))
SELECT star, pcad::INT AS Pcad, {s6('sqrt(power)')} AS power, width::INT AS width, col FROM p WHERE power > 0
QUALIFY row_number() OVER (PARTITION BY star, pcad ORDER BY power DESC, col, width) = 1"""


def binned_snr(spark, sf):
    return boxes.binned_snr(hourly_centred(spark, sf), lambda j: F.lit(0.8) + j * 0.02, 40, 16, 0.05, 0.3).select(
        "star", "jf", r6("P").alias("P"), r6("snr").alias("snr")
    )


QUERIES["bls_binned_snr"] = binned_snr
_PB = phase_bins_sql("ix", "pb", 40, 0.8, 0.02, 16, "f", OK).replace("0.8::DOUBLE + jf * 0.02::DOUBLE AS freq", "1 / (0.8::DOUBLE + jf * 0.02::DOUBLE) AS freq")
SQL["bls_binned_snr"] = f"""WITH {_BASE}, {_PB}, {box_sql('pb', 'bx', 'star, jf, freq', (1, 4))}
SELECT star, jf, {s6('1 / freq')} AS P, {s6('sqrt(coalesce(max(s * s / (ss - s * s / c)) FILTER (c >= 40 AND s < 0 AND ss - s * s / nullif(c, 0) > 0), 0))')} AS snr
FROM bx GROUP BY star, jf, freq"""

NF, FMIN, DF, NB, QMI, QMA = 40, 0.6, 0.015, 16, 0.08, 0.3


def spectrum(snr):
    def run(spark, sf):
        s, p = boxes.bls_spectrum(hourly_centred(spark, sf), NF, FMIN, DF, NB, QMI, QMA, snr)
        top = p.select("star", "jf", "bper", "depth", "qtran", "in1", "in2")
        return s.join(top, ["star", "jf"], "left").select(
            "star", "jf", r6("freq").alias("freq"), r6("p").alias("p"), r6("bper").alias("bper"), r6("depth").alias("depth"), r6("qtran").alias("qtran"), "in1", "in2"
        )

    return run


def _spectrum_sql(snr):
    kmi, kma = max(1, int(QMI * NB)), int(QMA * NB) + 1
    score = "CASE WHEN ss - s * s / nullif(c, 0) > 0 THEN -s / sqrt(ss - s * s / c) END" if snr else "s * s / nullif(c * (tot - c), 0)"
    return f"""WITH {_BASE}, m AS (SELECT star, avg(f) AS m, count(*) AS rn, min(t) AS t1 FROM ix WHERE {OK} GROUP BY star),
iy AS (SELECT star, t, t1 AS t_first, f - m AS f, fmask FROM ix JOIN m USING (star) WHERE {OK}),
{phase_bins_sql('iy', 'pb', NF, FMIN, DF, NB, 'f', 'true')}, {box_sql('pb', 'bx', 'star, jf, freq', (kmi, kma + 1), snr)},
p AS (SELECT bx.*, rn, {score} AS pow FROM bx JOIN m USING (star) WHERE c >= greatest(floor(rn * {QMI}::DOUBLE), 5)),
b AS (SELECT * FROM p WHERE pow >= 0 QUALIFY row_number() OVER (PARTITION BY star, jf ORDER BY pow DESC, col DESC, width DESC) = 1),
a AS (SELECT f.star, f.jf, f.freq, {'coalesce(pow, 0)' if snr else 'sqrt(coalesce(pow, 0))'} AS p, b.col, b.width, b.c, b.s, b.rn
   FROM (SELECT DISTINCT star, jf, freq FROM pb) f LEFT JOIN b USING (star, jf)),
r AS (SELECT *, row_number() OVER (PARTITION BY star ORDER BY p DESC, jf DESC) AS rk FROM a)
SELECT star, jf, {s6('freq')} AS freq, {s6('p')} AS p, CASE WHEN rk = 1 THEN {s6('1 / freq')} END AS bper,
 CASE WHEN rk = 1 THEN {s6('-s * rn / (c * (rn - c))')} END AS depth, CASE WHEN rk = 1 THEN {s6('c / rn')} END AS qtran,
 CASE WHEN rk = 1 THEN col + 1 END AS in1, CASE WHEN rk = 1 THEN col + width - CASE WHEN col + width > {NB} THEN {NB} ELSE 0 END END AS in2 FROM r"""


QUERIES["bls_spectrum"] = spectrum(False)
SQL["bls_spectrum"] = _spectrum_sql(False)
QUERIES["bls_spectrum_snr"] = spectrum(True)
SQL["bls_spectrum_snr"] = _spectrum_sql(True)


def local_continuum(spark, sf):
    f, keys = integer_fold(spark, sf)
    return boxes.local_continuum(f, keys, F.col("Pcad"), (2, 3, 4, 5)).select(
        "star", F.col("Pcad").cast("int").alias("Pcad"), r6("s2n").alias("s2n"), "width", "col"
    )


QUERIES["local_continuum"] = local_continuum
SQL["local_continuum"] = f"""WITH {_INT}, {box_sql('fi', 'bx', 'star, pcad', (2, 5))},
m AS (SELECT *, s / nullif(c, 0) AS m FROM bx),
d AS (SELECT a.*, (b.m + e.m) * 0.5::DOUBLE - a.m AS depth, a.ss / nullif(a.c, 0) - a.m * a.m AS var FROM m a
  JOIN m b ON a.star = b.star AND a.pcad = b.pcad AND a.width = b.width AND b.col = (a.col - a.width + a.n) % a.n
  JOIN m e ON a.star = e.star AND a.pcad = e.pcad AND a.width = e.width AND e.col = (a.col + a.width) % a.n),
q AS (SELECT *, depth / sqrt(var) * sqrt(c) AS s2n FROM d WHERE var > 0)
SELECT star, pcad::INT AS Pcad, {s6('s2n')} AS s2n, width::INT AS width, col FROM q WHERE s2n > 0
QUALIFY row_number() OVER (PARTITION BY star, pcad ORDER BY s2n DESC, width, col) = 1"""
