"""Queries: scalar functions and model shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.catalog.base import DAILY, DAILY_INJECTED, daily_injected, r6, s6
from starfold.catalog.folding import axis_sql, tdur_sql
from starfold.catalog.validation import SCALE, _BASE, _pfd, cands
from starfold.functions import models, scalars
from starfold.operators import fit, validate
from starfold.sources import fixtures

QUERIES, SQL = {}, {}
C = F.col


def orbit_scalars(spark, sf):
    o = fixtures.read(spark, sf, "orders").select("o_orderkey", (C("o_totalprice") / 5000 + 0.5).alias("P"))
    a = scalars.semi_major_axis(C("P"))
    return o.select(
        "o_orderkey", r6(a, 9).alias("a"), r6(scalars.transit_duration(a), 9).alias("tdur"),
        r6(scalars.incident_flux(1.0, 5770.0, a) / 1e6).alias("flux"),
        r6(scalars.points_in_transit(C("P"), 0.2, 90.0, scalars.CADENCE_DAYS)).alias("npts"),
        scalars.number_of_transits(90.0, C("P"), 0.3).cast("long").alias("ntrans"),
    )


QUERIES["orbit_scalars"] = orbit_scalars
_A = axis_sql("P")
SQL["orbit_scalars"] = f"""WITH o AS (SELECT o_orderkey, o_totalprice / 5000 + 0.5::DOUBLE AS P FROM orders)
SELECT o_orderkey, {s6(_A, 9)} AS a, {s6(tdur_sql('P'), 9)} AS tdur,
 {s6(f'pow({scalars.RSUN!r}::DOUBLE, 2) * {scalars.STEFAN_BOLTZMANN!r}::DOUBLE * pow(5770, 4) / pow({_A} * {scalars.AU!r}::DOUBLE, 2) / 1e6')} AS flux,
 {s6(f'90 / P * (0.2::DOUBLE / {scalars.CADENCE_DAYS!r}::DOUBLE)')} AS npts, CAST(floor(90 / P) + (0.3 < (90 % P) / P)::INT AS BIGINT) AS ntrans FROM o"""


def unit_scalars(spark, sf):
    o = fixtures.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C("l_discount").alias("p"), C("l_tax").alias("tau"))
    return o.select(
        "l_orderkey", "l_linenumber", r6(scalars.to_percent("p")).alias("percent"), r6(scalars.to_hours("tau")).alias("hours"),
        r6(scalars.to_ppm("p"), 3).alias("ppm"), scalars.season("l_linenumber").cast("int").alias("season"),
        F.floor((C("l_linenumber") - scalars.season("l_linenumber")) / 4).cast("int").alias("year"),
    )


QUERIES["unit_scalars"] = unit_scalars
SQL["unit_scalars"] = f"""SELECT l_orderkey, l_linenumber, {s6('l_discount * 100')} AS percent, {s6('l_tax * 24')} AS hours, {s6('l_discount * 1e6', 3)} AS ppm,
 (l_linenumber + 1) % 4 AS season, CAST(floor((l_linenumber - (l_linenumber + 1) % 4) / 4) AS INT) AS year FROM lineitem"""


def shapes(spark, sf):
    d = fixtures.daily(spark, sf).select("star", "cad", "t")
    return d.select(
        "star", "cad",
        r6(models.box(C("t"), 27.1, 12.33, 5.0, 3.2, 1.0)).alias("box"),
        r6(models.trapezoid(models.fold_time(C("t"), 27.1, 12.33), 5.0, 2.0, 1.5)).alias("trap"),
        r6(models.tanh_box(C("t"), 27.1, 12.33, 5.0, 3.2, 3.0)).alias("smooth"),
        r6(models.tanh_single(C("t") / 50, 12.33, 5.0, 3.2)).alias("single"),
        r6(models.legendre(C("t"), 0.0, 2500.0, [1.0, 2.0, -3.0, 0.5])).alias("trend"),
    )


_FT = "((t - 12.33::DOUBLE + 13.55::DOUBLE) - floor((t - 12.33::DOUBLE + 13.55::DOUBLE) / 27.1::DOUBLE) * 27.1::DOUBLE - 13.55::DOUBLE)"
_TP = "(27.1::DOUBLE * sin(pi() * (t - 12.33::DOUBLE) / 27.1::DOUBLE) / (pi() * 3.2::DOUBLE))"
_TS = "(100 * sin(pi() * (t / 50 - 12.33::DOUBLE) / 100) / (pi() * 3.2::DOUBLE))"
QUERIES["model_shapes"] = shapes
SQL["model_shapes"] = f"""WITH {DAILY}, m AS (SELECT *, abs(t % 27.1::DOUBLE - 12.33::DOUBLE) AS tm, abs({_FT}) AS a, t / 2500 * 2 - 1 AS x FROM daily)
SELECT star, cad, {s6('CASE WHEN tm < 1.1 THEN -5 WHEN tm > 1.1 AND tm < 2.1 THEN -5 * (1 - (tm - 1.1::DOUBLE)) ELSE 0 END::DOUBLE')} AS box,
 {s6('CASE WHEN a > 1 AND a < 2.5 THEN 5 / 1.5::DOUBLE * (a - 1) - 5 WHEN a < 1 THEN -5 ELSE 0 END')} AS trap,
 {s6(f'5 * (0.5::DOUBLE * (2 - tanh(3 * ({_TP} + 0.5)) + tanh(3 * ({_TP} - 0.5))) - 1)')} AS smooth,
 {s6(f'5 * (0.5::DOUBLE * (2 - tanh(100 * ({_TS} + 0.5)) + tanh(100 * ({_TS} - 0.5))) - 1)')} AS single,
 {s6('1 + 2 * x - 3 * (1.5::DOUBLE * x * x - 0.5::DOUBLE) + 0.5::DOUBLE * (2.5::DOUBLE * x * x * x - 1.5::DOUBLE * x)')} AS trend FROM m"""


def occult_sql(z, p, climb=models.SOLAR_LIMB):
    c1, c2, c3, c4 = climb
    norm = f"(pi() * {1 - c1 / 5 - c2 / 3 - 3 * c3 / 7 - c4 / 2!r}::DOUBLE)"
    x = f"(1 - pow({z} - {p}, 2))"
    dark = (
        f"(1 - {c1}::DOUBLE * (1 - 0.8::DOUBLE * pow({x}, 0.25)) - {c2}::DOUBLE * (1 - pow({x}, 0.5) * 2 / 3::DOUBLE) "
        f"- {c3}::DOUBLE * (1 - pow({x}, 0.75) * 4 / 7::DOUBLE) - {c4}::DOUBLE * (1 - {x} * 0.5::DOUBLE))"
    )
    edge = f"1 - {dark} * ({p} * {p} * acos(({z} - 1) / {p}) - ({z} - 1) * sqrt({p} * {p} - pow({z} - 1, 2))) / {norm}"
    s1, s2 = f"pow(1 - pow({z} - {p}, 2), 0.25)", f"pow(1 - pow({z} + {p}, 2), 0.25)"
    shade = (
        f"(1 - {c1}::DOUBLE * (1 + (pow({s2}, 5) - pow({s1}, 5)) / 5 / {p} / {z}) - {c2}::DOUBLE * (1 + (pow({s2}, 6) - pow({s1}, 6)) / 6 / {p} / {z}) "
        f"- {c3}::DOUBLE * (1 + (pow({s2}, 7) - pow({s1}, 7)) / 7 / {p} / {z}) - {c4}::DOUBLE * ({p} * {p} + {z} * {z}))"
    )
    return (
        f"CASE WHEN {z} = 0 THEN 1 - pi() * {p} * {p} / {norm} WHEN {z} > 1 - {p} AND {z} < 1 + {p} THEN {edge} "
        f"WHEN {z} < 1 - {p} THEN 1 - pi() * {p} * {p} * {shade} / {norm} ELSE 1 END"
    )


def occult(spark, sf):
    li = fixtures.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (C("l_extendedprice") / 60000).alias("z"))
    return li.select("l_orderkey", "l_linenumber", r6(models.occult_small(C("z"), 0.1), 9).alias("flux"))


QUERIES["occult_small"] = occult
SQL["occult_small"] = f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 60000 AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, {s6(occult_sql('z', '0.1::DOUBLE'), 9)} AS flux FROM l"""


def transit_model(spark, sf):
    d = fixtures.daily(spark, sf).select("star", "cad", models.fold_time(C("t"), 27.1, 12.33).alias("u"))
    return d.select("star", "cad", r6(models.transit(C("u"), 0.1, 3.0, 0.4, usamp=5, cadence=1.0), 9).alias("flux"))


QUERIES["transit_model"] = transit_model
SQL["transit_model"] = f"""WITH {DAILY}, d AS (SELECT star, cad, {_FT} AS u FROM daily),
z AS (SELECT star, cad, sqrt(pow((u - 0.5 + j * 0.25::DOUBLE) / 3, 2) + 0.16::DOUBLE) AS z FROM d, (SELECT unnest(range(5)) AS j))
SELECT star, cad, {s6('avg(' + occult_sql('z', '0.1::DOUBLE') + ') - 1', 9)} AS flux FROM z GROUP BY star, cad"""


def transit_geometry(spark, sf):
    li = fixtures.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (C("l_quantity") + 1).alias("P"), (C("l_discount") + 0.1).alias("t14"), (C("l_tax") + 0.01).alias("rp")
    )
    return li.select(
        "l_orderkey", "l_linenumber", r6(models.scaled_axis(C("P"), C("t14"), C("rp"), 0.5)).alias("a"),
        r6(models.scaled_axis(C("P"), C("t14"), C("rp"), 0.5, True)).alias("a_squared"),
        r6(models.inclination(C("P"), C("t14"), C("rp"), 0.5)).alias("inc"),
    )


QUERIES["transit_geometry"] = transit_geometry
SQL["transit_geometry"] = f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS P, l_discount + 0.1::DOUBLE AS t14, l_tax + 0.01::DOUBLE AS rp FROM lineitem),
a AS (SELECT *, P / pi() / t14 * sqrt(pow(1 + rp, 2) - 0.5::DOUBLE) AS a, P / pi() / t14 * sqrt(pow(1 + rp, 2) - 0.25::DOUBLE) AS a2 FROM l)
SELECT l_orderkey, l_linenumber, {s6('a')} AS a, {s6('a2')} AS a_squared, {s6('degrees(acos(0.5::DOUBLE / a))')} AS inc FROM a"""


def model_duration(spark, sf):
    s = fixtures.read(spark, sf, "supplier").select("s_suppkey", (C("s_acctbal") / 20000 + 1).alias("tau"))
    return s.select("s_suppkey", r6(models.model_duration(0.1, C("tau"), 0.3, 60.0, 0.0, usamp=1)).alias("tdur"))


QUERIES["model_duration"] = model_duration
SQL["model_duration"] = f"""WITH s AS (SELECT s_suppkey, s_acctbal / 20000 + 1 AS tau FROM supplier),
g AS (SELECT s_suppkey, -2 + j * (4 / 199::DOUBLE) AS t, sqrt(pow((-2 + j * (4 / 199::DOUBLE)) / tau, 2) + 0.09::DOUBLE) AS z FROM s, (SELECT unnest(range(200)) AS j))
SELECT s_suppkey, {s6('max(t) - min(t)')} AS tdur FROM g WHERE {occult_sql('z', '0.1::DOUBLE')} < 1 GROUP BY s_suppkey"""


def choose_fit_input(spark, sf):
    d, c = daily_injected(spark, sf), cands(spark, sf)
    f = validate.phase_fold_detrended(d, c, cadence=1.0)
    # One series is treated as long-period.
    p = c.select("star", F.when(C("star") == "R", 60.0).otherwise(C("P")).alias("P"))
    return fit.choose_fit_input(f, p, minutes=720.0).select(
        "star", r6("t").alias("t"), r6(C("f") / SCALE).alias("f"), r6(C("ferr") / SCALE).alias("ferr")
    )


QUERIES["choose_fit_input"] = choose_fit_input
SQL["choose_fit_input"] = f"""WITH {_BASE}, {_pfd('x0', 0)},
m AS (SELECT *, min(tPF) OVER w - 0.001::DOUBLE AS lo, max(tPF) OVER w AS hi, greatest(round_even((max(tPF) OVER w - min(tPF) OVER w) / 0.5, 0), 1) AS nb FROM x0_f WINDOW w AS (PARTITION BY star)),
b AS (SELECT *, CAST(ceil(round((tPF - lo) / (hi - lo) * nb, 9)) - 1 AS BIGINT) AS bin FROM m),
s AS (SELECT star, any_value(lo + (bin + 0.5) * (hi - lo) / nb) AS t, median(f) AS f, stddev_samp(f) / sqrt(count(f)) AS ferr FROM b WHERE star <> 'R' GROUP BY star, bin HAVING stddev_samp(f) IS NOT NULL),
l AS (SELECT star, tPF AS t, f, (f - lag(f) OVER (PARTITION BY star ORDER BY round(tPF, 9), t)) * sqrt(2) AS df FROM x0_f WHERE star = 'R'),
u AS (SELECT * FROM s UNION ALL SELECT star, t, f, stddev_pop(df) OVER (PARTITION BY star) FROM l)
SELECT star, {s6('t')} AS t, {s6('f / 7123457e0')} AS f, {s6('ferr / 7123457e0')} AS ferr FROM u"""
