"""Queries: cleaning, masking, gap handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.catalog.base import (
    DAILY,
    DAILY_DENSE,
    ENSEMBLE,
    HOURLY,
    HOURLY_CENTRED,
    HOURLY_DENSE,
    daily_dense,
    hourly_centred,
    hourly_dense,
    r6,
    s6,
)
from starfold.operators import clean
from starfold.sources import fixtures

QUERIES, SQL = {}, {}

REGIONS = [(2.0, 3.5), (3.0, 4.25), (10.0, 10.5), (20.0, 22.0)]
_REGIONS = "regions AS (SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in REGIONS) + ") v(start, stop))"
BITS = {1: "cosmic", 3: "desat", 4: "at_tweak"}


def regions(spark):
    return spark.createDataFrame(REGIONS, "start DOUBLE, stop DOUBLE")


def interp_sql(src, out, y, ok, edge):
    """SQL of a linear interpolation over rows where ``ok`` fails, into column yi."""
    if edge == "hold":
        right, left = "yl", "yr"
    else:
        right = "d[1].y + (d[1].y - d[2].y) * (cad - d[1].x) / (d[1].x - d[2].x)"
        left = "l[1].y + (l[2].y - l[1].y) * (cad - l[1].x) / (l[2].x - l[1].x)"
    return f"""{out}_g AS (SELECT star, list(struct_pack(x := cad::DOUBLE, y := {y}::DOUBLE) ORDER BY cad) AS l,
   list(struct_pack(x := cad::DOUBLE, y := {y}::DOUBLE) ORDER BY cad DESC) AS d FROM {src} WHERE {ok} GROUP BY star),
{out}_b AS (SELECT *, max(CASE WHEN {ok} THEN cad END) OVER up AS xl, last_value(CASE WHEN {ok} THEN {y} END IGNORE NULLS) OVER up AS yl,
   first_value(CASE WHEN {ok} THEN {y} END IGNORE NULLS) OVER dn AS yr, min(CASE WHEN {ok} THEN cad END) OVER dn AS xr,
   min(cad) OVER (PARTITION BY star) AS ca, max(cad) OVER (PARTITION BY star) AS cb
   FROM {src} WINDOW up AS (PARTITION BY star ORDER BY cad ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     dn AS (PARTITION BY star ORDER BY cad ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{out} AS (SELECT b.*, CASE WHEN {ok} THEN {y}
   WHEN yl IS NOT NULL AND yr IS NOT NULL THEN yl + (yr - yl) * (cad - xl) / (xr - xl)
   WHEN yl IS NOT NULL THEN {right} ELSE {left} END AS yi,
   coalesce(xr, cb + 1) - coalesce(xl, ca - 1) - 1 AS run
   FROM {out}_b b JOIN {out}_g USING (star))"""


def medfilt_sql(src, out, col, size):
    """SQL of a mirrored running median into column mf (rank size//2)."""
    back, ahead = size // 2, size - 1 - size // 2
    return f"""{out}_p AS (SELECT star, cad AS pos, cad, {col} AS v FROM {src}
   UNION ALL SELECT star, 2 * a - 1 - cad, NULL, {col} FROM (SELECT *, min(cad) OVER (PARTITION BY star) AS a FROM {src}) WHERE cad < a + {back}
   UNION ALL SELECT star, 2 * b + 1 - cad, NULL, {col} FROM (SELECT *, max(cad) OVER (PARTITION BY star) AS b FROM {src}) WHERE cad > b - {ahead}),
{out} AS (SELECT s.*, mf FROM {src} s JOIN (SELECT star, cad, list_sort(list(v) OVER (PARTITION BY star ORDER BY pos ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING))[{size // 2 + 1}] AS mf
   FROM {out}_p) p ON p.star = s.star AND p.cad = s.cad)"""


def outlier_sql(src, out, lims, interp):
    """SQL of the outlier flag into column is_outlier, value in yi."""
    pre = (
        interp_sql(src, out + "_i", "f", "NOT fmask AND f IS NOT NULL", "hold")
        if interp == "linear"
        else f"{out}_i AS (SELECT *, CASE WHEN NOT fmask AND f IS NOT NULL THEN f ELSE 0 END AS yi FROM {src})"
    )
    return f"""{pre},
{medfilt_sql(out + "_i", out + "_m", "yi", 4)},
{out}_h AS (SELECT *, yi - mf AS hp, median(abs(yi - mf)) OVER (PARTITION BY star) AS mad FROM {out}_m),
{out} AS (SELECT *, hp < mad * 1.48::DOUBLE * {lims[0]} OR hp > mad * 1.48::DOUBLE * {lims[1]} AS is_outlier FROM {out}_h)"""


QUERIES["normalize_quarter"] = lambda spark, sf: clean.normalize_quarter(fixtures.hourly(spark, sf)).select(
    "star", "cad", "quarter", r6("f").alias("f"), r6("ferr").alias("ferr")
)
SQL["normalize_quarter"] = f"""WITH {HOURLY}, m AS (SELECT *, median(f) OVER (PARTITION BY star, quarter) AS m FROM hourly)
SELECT star, cad, quarter, {s6('f / nullif(m, 0) - 1')} AS f, {s6('ferr / nullif(m, 0)')} AS ferr FROM m"""

QUERIES["cadence_fill"] = lambda spark, sf: clean.cadence_fill(fixtures.hourly(spark, sf)).select("star", "cad", "f", "fmask")
SQL["cadence_fill"] = f"WITH {HOURLY_DENSE} SELECT star, cad, f, fmask FROM hd"


def interp_masked(spark, sf):
    d = hourly_dense(spark, sf)
    a = clean.interp_masked(d, "f", clean.valid(), out="fi")
    b = clean.interp_masked(a, "f", clean.valid(), out="f1", n_contig=1)
    return b.select("star", "cad", r6("fi").alias("fi"), r6("f1").alias("f1"))


QUERIES["interp_masked"] = interp_masked
SQL["interp_masked"] = f"""WITH {HOURLY_DENSE}, {interp_sql('hd', 'i', 'f', 'NOT fmask AND f IS NOT NULL', 'extrapolate')}
SELECT star, cad, {s6('yi')} AS fi, {s6('CASE WHEN f IS NOT NULL OR run <= 1 THEN yi END')} AS f1 FROM i"""

QUERIES["stitch_quarters"] = lambda spark, sf: clean.stitch_quarters(fixtures.hourly(spark, sf)).select(
    "star", "cad", "f", "fmask", "quarter", r6("t").alias("t")
)
SQL["stitch_quarters"] = f"""WITH {HOURLY}, g AS (SELECT star, unnest(range(a, b + 1)) AS cad FROM (SELECT star, min(cad) AS a, max(cad) AS b FROM hourly GROUP BY star)),
s AS (SELECT g.star, g.cad, h.t, h.f, h.quarter, coalesce(h.fmask, true) AS fmask FROM g LEFT JOIN hourly h ON h.star = g.star AND h.cad = g.cad),
{interp_sql('s', 'i', 't', 't IS NOT NULL', 'extrapolate')}
SELECT star, cad, f, fmask, quarter, {s6('yi')} AS t FROM i"""

QUERIES["stitch_levels"] = lambda spark, sf: clean.stitch_levels(fixtures.hourly(spark, sf)).select(
    "star", "cad", r6("f", 4).alias("f"), r6("factor").alias("factor")
)
SQL["stitch_levels"] = f"""WITH {HOURLY}, s AS (SELECT *, min(t) OVER q AS a, max(t) OVER q AS b FROM hourly WINDOW q AS (PARTITION BY star, quarter)),
e AS (SELECT star, quarter, median(f) FILTER (t < a + 0.5::DOUBLE) AS head, median(f) FILTER (t > b - 0.5::DOUBLE) AS tail FROM s GROUP BY star, quarter),
r AS (SELECT star, quarter, coalesce(lag(tail) OVER (PARTITION BY star ORDER BY quarter) / nullif(head, 0), 1) AS r FROM e),
c AS (SELECT star, quarter, product(r) OVER (PARTITION BY star ORDER BY quarter) AS factor FROM r)
SELECT star, cad, {s6('f * factor', 4)} AS f, {s6('factor')} AS factor FROM hourly JOIN c USING (star, quarter)"""

QUERIES["parse_quality"] = lambda spark, sf: clean.parse_quality(fixtures.hourly(spark, sf), BITS).select(
    "star", "cad", *BITS.values()
)
SQL["parse_quality"] = f"""WITH {HOURLY} SELECT star, cad, (quality & 1) <> 0 AS cosmic, (quality & 4) <> 0 AS desat, (quality & 8) <> 0 AS at_tweak FROM hourly"""

QUERIES["mask_regions"] = lambda spark, sf: clean.mask_regions(hourly_dense(spark, sf), regions(spark), width=4.0).select(
    "star", "cad", "is_bad_region"
)
SQL["mask_regions"] = f"""WITH {HOURLY_DENSE}, {_REGIONS}
SELECT star, cad, EXISTS (SELECT 1 FROM regions WHERE t BETWEEN start AND stop) AS is_bad_region FROM hd"""


def steps_sql(src, out, mask="fmask OR f IS NULL"):
    return f"""{out}_1 AS (SELECT *, median(CASE WHEN NOT ({mask}) THEN f END) OVER w AS md, count(CASE WHEN NOT ({mask}) THEN f END) OVER w AS nv, max(cad) OVER (PARTITION BY star) AS cb
   FROM {src} WINDOW w AS (PARTITION BY star ORDER BY cad ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
{out}_2 AS (SELECT *, CASE WHEN cad + 70 <= cb AND nv >= 20 AND lead(nv, 20) OVER (PARTITION BY star ORDER BY cad) >= 20 THEN md - lead(md, 20) OVER (PARTITION BY star ORDER BY cad) END AS step FROM {out}_1),
{out}_3 AS (SELECT *, coalesce(abs(step) > 7 * median(abs(step)) OVER (PARTITION BY star), false) AS hit FROM {out}_2),
{out}_4 AS (SELECT *, coalesce(lag(hit, 35) OVER (PARTITION BY star ORDER BY cad), false) AS hit_at FROM {out}_3),
{out} AS (SELECT *, bool_or(hit_at) OVER (PARTITION BY star ORDER BY t RANGE BETWEEN 2::DOUBLE PRECEDING AND 0.5::DOUBLE FOLLOWING) AS is_step FROM {out}_4)"""


def stepped(spark, sf):
    """The hourly series with a level change at cadence 400."""
    return hourly_dense(spark, sf).withColumn("f", F.col("f") + F.when(F.col("cad") >= 400, 90000.0).otherwise(0.0))


_STEPPED = HOURLY_DENSE + ", st AS (SELECT * REPLACE (f + CASE WHEN cad >= 400 THEN 90000 ELSE 0 END AS f) FROM hd)"
QUERIES["mask_steps"] = lambda spark, sf: clean.mask_steps(stepped(spark, sf)).select("star", "cad", "is_step")
SQL["mask_steps"] = f"WITH {_STEPPED}, {steps_sql('st', 'ms')} SELECT star, cad, is_step FROM ms"


def mask_outliers(spark, sf):
    d = hourly_dense(spark, sf)
    a = clean.mask_outliers(d, (-5.0, 5.0), "linear", "linear")
    b = clean.mask_outliers(a, (-5.0, 5.0), "constant", "constant")
    return b.select("star", "cad", "linear", "constant")


QUERIES["mask_outliers"] = mask_outliers
SQL["mask_outliers"] = f"""WITH {HOURLY_DENSE}, {outlier_sql('hd', 'a', (-5.0, 5.0), 'linear')}, {outlier_sql('hd', 'b', (-5.0, 5.0), 'constant')}
SELECT a.star, a.cad, a.is_outlier AS linear, b.is_outlier AS constant FROM a JOIN b ON a.star = b.star AND a.cad = b.cad"""


def grow_mask(spark, sf):
    d = clean.parse_quality(hourly_dense(spark, sf), BITS)
    d = clean.grow_mask(d, "desat", 1, 1, "desat_grown")
    d = clean.grow_mask(d, "at_tweak", 4, 4, "tweak_grown")
    return clean.mask_discontinuity(d, "at_tweak").select("star", "cad", "desat_grown", "tweak_grown", "is_dis")


def _grow(expr, before, after):
    return f"bool_or({expr}) OVER (PARTITION BY star ORDER BY cad ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"


_Q = "coalesce(quality, 0)"
QUERIES["grow_mask"] = grow_mask
SQL["grow_mask"] = f"""WITH {HOURLY_DENSE} SELECT star, cad, {_grow(f'({_Q} & 4) <> 0', 1, 1)} AS desat_grown,
 {_grow(f'({_Q} & 8) <> 0', 4, 4)} AS tweak_grown, {_grow(f'({_Q} & 8) <> 0', 50, 4)} AS is_dis FROM hd"""

QUERIES["quality_mask"] = lambda spark, sf: clean.quality_mask(stepped(spark, sf), regions(spark), BITS, (-5.0, 5.0)).select(
    "star", "cad", "fmask", "seg_end", "is_step", "is_outlier", "is_bad_region", "desat", "at_tweak"
)
SQL["quality_mask"] = f"""WITH {_STEPPED}, {_REGIONS}, {outlier_sql('st', 'o', (-5.0, 5.0), 'linear')},
m AS (SELECT * REPLACE (fmask OR f IS NULL OR is_outlier OR EXISTS (SELECT 1 FROM regions WHERE t BETWEEN start AND stop) AS fmask),
   EXISTS (SELECT 1 FROM regions WHERE t BETWEEN start AND stop) AS is_bad_region FROM o),
{steps_sql('(SELECT star, cad, t, f, fmask, is_outlier, is_bad_region, quality FROM m)', 'ms')},
q AS (SELECT *, {_grow(f'({_Q} & 4) <> 0', 1, 1)} AS desat, {_grow(f'({_Q} & 8) <> 0', 4, 4)} AS at_tweak FROM ms)
SELECT star, cad, fmask OR is_step OR desat OR at_tweak AS fmask, is_bad_region OR at_tweak OR is_step AS seg_end,
 is_step, is_outlier, is_bad_region, desat, at_tweak FROM q"""


def segment_sql(src, out, ok, nsep):
    return f"""{out}_1 AS (SELECT *, max(CASE WHEN {ok} THEN cad END) OVER (PARTITION BY star ORDER BY cad ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
   min(CASE WHEN {ok} THEN cad END) OVER (PARTITION BY star ORDER BY cad ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx,
   min(cad) OVER (PARTITION BY star) AS ca, max(cad) OVER (PARTITION BY star) AS cb FROM {src}),
{out}_2 AS (SELECT *, ({ok}) OR coalesce(nx, cb + 1) - coalesce(p, ca - 1) - 1 < {nsep} AS m FROM {out}_1),
{out}_3 AS (SELECT *, m AND NOT coalesce(lag(m) OVER (PARTITION BY star ORDER BY cad), false) AS st FROM {out}_2),
{out} AS (SELECT *, CASE WHEN m THEN sum(st::INT) OVER (PARTITION BY star ORDER BY cad) - 1 END AS segment FROM {out}_3)"""


def gappy(spark, sf):
    """The hourly series with long masked stretches."""
    d = hourly_dense(spark, sf)
    return d.withColumn("fmask", F.col("fmask") | (F.pmod(F.col("cad"), F.lit(120)) < 30))


_GAPPY = HOURLY_DENSE + ", gp AS (SELECT * REPLACE (fmask OR cad % 120 < 30 AS fmask) FROM hd)"
_OK = "NOT fmask AND f IS NOT NULL"
QUERIES["segment_labels"] = lambda spark, sf: clean.segment_labels(gappy(spark, sf), 24).select("star", "cad", "segment")
SQL["segment_labels"] = f"WITH {_GAPPY}, {segment_sql('gp', 'sl', _OK, 24)} SELECT star, cad, CAST(segment AS BIGINT) AS segment FROM sl"


def join_segments(spark, sf):
    d = clean.segment_labels(gappy(spark, sf), 24, out="a")
    return clean.join_segments(d.withColumn("b", F.floor(F.col("cad") / 100)), "a", "b").select("star", "cad", "segment")


QUERIES["join_segments"] = join_segments
SQL["join_segments"] = f"""WITH {_GAPPY}, {segment_sql('gp', 'sl', _OK, 24)},
j AS (SELECT star, cad, segment AS a, floor(cad / 100) AS b FROM sl WHERE segment IS NOT NULL),
k AS (SELECT *, coalesce((a, b) <> lag((a, b)) OVER (PARTITION BY star ORDER BY cad), false) AS chg FROM j),
l AS (SELECT star, cad, sum(chg::INT) OVER (PARTITION BY star ORDER BY cad) AS segment FROM k)
SELECT s.star, s.cad, CAST(l.segment AS BIGINT) AS segment FROM sl s LEFT JOIN l ON l.star = s.star AND l.cad = s.cad"""

QUERIES["region_segments"] = lambda spark, sf: clean.region_segments(hourly_dense(spark, sf), regions(spark), width=4.0).select(
    "star", "cad", "segment"
)
SQL["region_segments"] = f"""WITH {HOURLY_DENSE}, {_REGIONS},
s AS (SELECT row_number() OVER (ORDER BY start) - 1 AS i, stop AS lo, lead(start) OVER (ORDER BY start) AS hi FROM regions)
SELECT star, cad, CAST(coalesce((SELECT max(i) FROM s WHERE t > lo AND t < hi), -1) AS BIGINT) AS segment FROM hd"""

QUARTERS = [(1, 0.5, 9.75), (2, 10.25, 19.5), (3, 20.0, 28.0)]


def assign_quarter(spark, sf):
    q = spark.createDataFrame(QUARTERS, "q INT, tstart DOUBLE, tstop DOUBLE")
    d = clean.assign_quarter(hourly_dense(spark, sf), q, width=4.0)
    mods = d.where("q > 0").groupBy("star", "q").agg(F.min("cad").alias("module"))
    looked = clean.lookup_module(d.where("q > 0").select("star", "cad", "q"), mods)
    return d.select("star", "cad", "q").join(looked.select("star", "cad", "module"), ["star", "cad"], "left")


QUERIES["assign_quarter"] = assign_quarter
SQL["assign_quarter"] = f"""WITH {HOURLY_DENSE}, v AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b}::DOUBLE, {c}::DOUBLE)' for a, b, c in QUARTERS)}) v(q, a, b)),
j AS (SELECT star, cad, coalesce(q, -1) AS q FROM hd LEFT JOIN v ON t > a AND t < b)
SELECT star, cad, q, CASE WHEN q > 0 THEN min(cad) OVER (PARTITION BY star, q) END AS module FROM j"""

QUERIES["mask_before_quarter"] = lambda spark, sf: clean.mask_before_quarter(fixtures.daily(spark, sf), 3).groupBy(
    "star", "quarter", "fmask"
).agg(F.count(F.lit(1)).alias("n"))
SQL["mask_before_quarter"] = f"WITH {DAILY} SELECT star, quarter, quarter < 3 AS fmask, COUNT(*) AS n FROM daily GROUP BY ALL"


def check_even(spark, sf):
    a = clean.check_even(hourly_dense(spark, sf), 1 / 24).withColumn("filled", F.lit(True))
    b = clean.check_even(fixtures.hourly(spark, sf), 1 / 24).withColumn("filled", F.lit(False))
    return a.unionByName(b).withColumn("dt", r6("dt"))


def _even(src, flag):
    return f"""SELECT star, {flag} AS filled, {s6('median(d)')} AS dt, max(d) - min(d) < {1/24/100.0!r}::DOUBLE AS even_span,
 bool_and(abs(d - m) <= 1e-8 + 1e-3 * abs(m)) AS even_steps FROM (SELECT *, median(d) OVER (PARTITION BY star) AS m FROM
 (SELECT star, t - lag(t) OVER (PARTITION BY star ORDER BY cad) AS d FROM {src}) WHERE d IS NOT NULL) GROUP BY star"""


QUERIES["check_even"] = check_even
SQL["check_even"] = f"WITH {HOURLY_DENSE} {_even('hd', 'true')} UNION ALL {_even('hourly', 'false')}"

QUERIES["masked_median_filter"] = lambda spark, sf: clean.masked_median_filter(hourly_dense(spark, sf), 7).select(
    "star", "cad", r6("fmed").alias("fmed")
)
SQL["masked_median_filter"] = f"""WITH {HOURLY_DENSE}, {interp_sql('hd', 'i', 'f', _OK, 'hold')}, {medfilt_sql('i', 'm', 'yi', 7)}
SELECT star, cad, {s6('mf')} AS fmed FROM m"""

QUERIES["preprocess"] = lambda spark, sf: clean.preprocess(hourly_dense(spark, sf), (-1000.0, 5.0)).select(
    "star", "cad", "f", "fmask", "is_outlier"
)
SQL["preprocess"] = f"""WITH {HOURLY_CENTRED}, {outlier_sql('hc', 'o', (-1000.0, 5.0), 'constant')}
SELECT o.star, o.cad, hd.f, o.fmask OR o.is_outlier OR hd.f IS NULL AS fmask, o.is_outlier FROM o JOIN hd ON hd.star = o.star AND hd.cad = o.cad"""



def noisy(spark, sf):
    """Single-event depths of the gappy series, every third stretch of 120 cadences amplified."""
    from starfold.operators import windows

    g = gappy(spark, sf).withColumn("f", F.when(~F.col("fmask"), F.col("f") * F.when(F.floor(F.col("cad") / 120) % 3 == 1, 5.0).otherwise(1.0)))
    return clean.mask_noisy_segments(windows.mean_depth(g, (3,)), "d", 24).select("star", "cad", "is_noisy")


QUERIES["mask_noisy_segments"] = noisy
from starfold.catalog.windows import mean_depth_sql  # noqa: E402

SQL["mask_noisy_segments"] = f"""WITH {_GAPPY}, gn AS (SELECT * REPLACE (CASE WHEN NOT fmask THEN f * CASE WHEN floor(cad / 120) % 3 = 1 THEN 5 ELSE 1 END END AS f) FROM gp),
{mean_depth_sql('(SELECT * REPLACE (fmask OR f IS NULL AS fmask) FROM gn)', 'md', (3,))}, {segment_sql('md', 'sl', 'd IS NOT NULL', 24)},
m AS (SELECT star, segment, median(abs(d)) AS mad FROM sl WHERE segment IS NOT NULL GROUP BY star, segment),
b AS (SELECT star, segment, mad > 2 * median(mad) OVER (PARTITION BY star) AS bad FROM m)
SELECT sl.star, sl.cad, coalesce(bad, false) AS is_noisy FROM sl LEFT JOIN b ON b.star = sl.star AND b.segment = sl.segment"""

QUERIES["mean_of_bins"] = lambda spark, sf: clean.mean_of_bins(hourly_dense(spark, sf), 8).select("star", "bin", r6("x").alias("x"), r6("y").alias("y"))
SQL["mean_of_bins"] = f"""WITH {HOURLY_DENSE} SELECT star, CAST(floor((cad - a) / 8) AS BIGINT) AS bin, {s6('min(t)')} AS x, {s6('avg(f)')} AS y
FROM (SELECT *, min(cad) OVER (PARTITION BY star) AS a FROM hd) GROUP BY 1, 2 HAVING avg(f) IS NOT NULL"""


def _less_level(q, o):
    """A quarter's flux less the mean of the other table's, a new group."""
    level = o["level"].mean() if len(o) else 0.0
    return q.assign(g=q["f"] - level, n_other=len(o))[["star", "quarter", "cad", "g", "n_other"]]


def per_quarter(spark, sf):
    """Two inputs with rows of their own: a series, and levels of some of its quarters every 7 days."""
    d = fixtures.daily(spark, sf)
    other = d.where("cad % 7 = 3 AND quarter % 3 <> 1").select("star", "quarter", F.round(F.col("f") / 1000).alias("level"))
    return clean.map_per_quarter(d, _less_level, "star string, quarter int, cad long, g double, n_other long", other).select(
        "star", "quarter", "cad", r6("g", 3).alias("g"), "n_other"
    )


QUERIES["map_per_quarter"] = per_quarter
SQL["map_per_quarter"] = f"""WITH {DAILY}, o AS (SELECT star, quarter, avg(round(f / 1000)) AS level, count(*) AS n FROM daily WHERE cad % 7 = 3 AND quarter % 3 <> 1 GROUP BY star, quarter)
SELECT star, quarter, cad, {s6('f - coalesce(level, 0)', 3)} AS g, coalesce(n, 0) AS n_other FROM daily LEFT JOIN o USING (star, quarter)"""


def per_quarter_in_place(spark, sf):
    """The first ten days of a quarter scaled in place; other rows and columns stay."""

    def scale(q):
        early = q[q["cad"] < q["cad"].min() + 10]
        return early.assign(f=early["f"] / 4)[["star", "quarter", "cad", "f"]]

    d = fixtures.daily(spark, sf)
    x = clean.map_per_quarter(d, scale, "star string, quarter int, cad long, f double", in_place=True)
    return x.select("star", "cad", "f", r6("ferr").alias("ferr"), "quarter")


QUERIES["map_per_quarter_in_place"] = per_quarter_in_place
SQL["map_per_quarter_in_place"] = f"""WITH {DAILY} SELECT star, cad, CASE WHEN cad < min(cad) OVER (PARTITION BY star, quarter) + 10 THEN f / 4 ELSE f END AS f,
 {s6('ferr')} AS ferr, quarter FROM daily"""

# Which series each query runs on; their length is measured before planning.
