"""Queries: single-event statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.catalog.base import HOURLY_CENTRED, HOURLY_DENSE, hourly_centred, hourly_dense, r6, s6
from starfold.operators import fold, windows

QUERIES, SQL = {}, {}
TWDS = (3, 4, 7)


def mean_depth_sql(src, out, twds, keep=""):
    def one(k):
        h = k // 2
        ok = "CASE WHEN NOT fmask THEN f END"
        parts = {}
        for x, sh in (("b", -k), ("d", 0), ("a", k)):
            lo, hi = sh - h, sh + k - h - 1
            edge = lambda v: f"{-v} PRECEDING" if v < 0 else f"{v} FOLLOWING"
            fr = f"OVER (PARTITION BY star ORDER BY cad ROWS BETWEEN {edge(lo)} AND {edge(hi)})"
            parts[x] = f"sum({ok}) {fr} AS s{x}, count({ok}) {fr} AS n{x}"
        return f"""SELECT star, cad, t, {k}::INT AS twd{keep}, CASE WHEN nb >= {k // 2} AND nd >= {k // 2} AND na >= {k // 2}
   THEN (sb / nullif(nb, 0) + sa / nullif(na, 0)) * 0.5::DOUBLE - sd / nullif(nd, 0) END AS d FROM (SELECT *, {', '.join(parts.values())} FROM {src})"""

    return f"{out} AS ({' UNION ALL '.join(one(k) for k in twds)})"


def box_depth_sql(src, out, twds):
    def one(k):
        fr = f"OVER (PARTITION BY star ORDER BY cad ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
        return f"""SELECT star, cad, t, {k}::INT AS twd, -m AS depth, ivar * c AS ivar, ivar * -0.5::DOUBLE * (m * m * r - m * s * 2) AS dll, c > {k // 2} AS good
   FROM (SELECT *, s / nullif(c, 0) AS m FROM (SELECT star, cad, t, 1 / nullif(md2, 0) AS ivar, count(*) {fr} AS r, count(CASE WHEN NOT fmask THEN f END) {fr} AS c,
     sum(CASE WHEN NOT fmask THEN f ELSE 0 END) {fr} AS s FROM {out}_v))"""

    return f"""{out}_v AS (SELECT v.*, md2 FROM {src} v JOIN (SELECT star, median(dd * dd) AS md2 FROM
   (SELECT star, f - lag(f) OVER (PARTITION BY star ORDER BY cad) AS dd FROM {src} WHERE NOT fmask) GROUP BY star) USING (star)),
{out} AS ({' UNION ALL '.join(one(k) for k in twds)})"""


QUERIES["mean_depth"] = lambda spark, sf: windows.mean_depth(hourly_centred(spark, sf), TWDS).select(
    "star", "cad", "twd", r6("d").alias("d")
)
SQL["mean_depth"] = f"WITH {HOURLY_CENTRED}, {mean_depth_sql('hc', 'md', TWDS)} SELECT star, cad, twd, {s6('d')} AS d FROM md"

QUERIES["box_depth"] = lambda spark, sf: windows.box_depth(hourly_centred(spark, sf), TWDS).select(
    "star", "cad", "twd", "good", r6("depth").alias("depth"), r6(F.col("ivar") * 1e9).alias("ivar"), r6("dll").alias("dll")
)
SQL["box_depth"] = f"""WITH {HOURLY_CENTRED}, {box_depth_sql('hc', 'bd', TWDS)}
SELECT star, cad, twd, good, {s6('depth')} AS depth, {s6('ivar * 1e9')} AS ivar, {s6('dll')} AS dll FROM bd"""


def _folded24(spark, sf):
    x = fold.with_index(hourly_dense(spark, sf))
    return x.groupBy("star", (F.col("i") % 24).alias("col")).agg(
        F.coalesce(F.sum("f"), F.lit(0.0)).alias("s"), F.count("f").alias("c")
    )


_F24 = HOURLY_DENSE + """, f24 AS (SELECT star, (cad - a) % 24 AS col, coalesce(sum(f), 0) AS s, count(f) AS c
 FROM (SELECT *, min(cad) OVER (PARTITION BY star) AS a FROM hd) GROUP BY 1, 2)"""


QUERIES["circular_box"] = lambda spark, sf: windows.circular_box(_folded24(spark, sf), ["star"], F.lit(24), 5, ["s", "c"]).select(
    "star", "col", "box_s", "box_c", r6(F.try_divide("box_s", "box_c")).alias("box_mean")
)
SQL["circular_box"] = f"""WITH {_F24}, b AS (SELECT a.star, a.col, sum(b.s) AS box_s, sum(b.c) AS box_c FROM f24 a JOIN f24 b
 ON a.star = b.star AND (b.col - a.col + 24) % 24 < 5 GROUP BY 1, 2)
SELECT star, col, box_s, CAST(box_c AS BIGINT) AS box_c, {s6('box_s / nullif(box_c, 0)')} AS box_mean FROM b"""

QUERIES["circular_hat"] = lambda spark, sf: windows.circular_hat(_folded24(spark, sf), ["star"], F.lit(24), 5, "s").select(
    "star", "col", "hat"
)
SQL["circular_hat"] = f"""WITH {_F24} SELECT a.star, a.col, (b.s + c.s) * 0.5::DOUBLE - a.s AS hat FROM f24 a
JOIN f24 b ON a.star = b.star AND b.col = (a.col + 19) % 24 JOIN f24 c ON a.star = c.star AND c.col = (a.col + 5) % 24"""

QUERIES["noise_per_duration"] = lambda spark, sf: windows.noise_per_duration(
    windows.mean_depth(hourly_centred(spark, sf), TWDS), 1.5
).select("star", "twd", r6("noise").alias("noise"))
SQL["noise_per_duration"] = f"""WITH {HOURLY_CENTRED}, {mean_depth_sql('hc', 'md', TWDS)}
SELECT star, twd, {s6('median(abs(d)) * 1.5::DOUBLE')} AS noise FROM md GROUP BY star, twd"""
