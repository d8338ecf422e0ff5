"""Shared series and SQL fragments of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.functions import stats
from starfold.operators import clean
from starfold.sources import fixtures


def r6(c: Column | str, n: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def s6(expr: str, n: int = 6) -> str:
    return f"(round({expr}, {n}) + 0e0)"


def hourly_dense(spark, sf) -> DataFrame:
    return clean.cadence_fill(fixtures.hourly(spark, sf), per_day=24, unique=True)


def daily_dense(spark, sf) -> DataFrame:
    return clean.cadence_fill(fixtures.daily(spark, sf), per_day=1, unique=True)


def centred(df: DataFrame) -> DataFrame:
    """Flux minus the median of the unmasked points, 0 under the mask."""
    m = stats.with_medians(df, ["star"], {"_m": F.when(~F.col("fmask"), F.col("f"))})
    return m.withColumn("f", F.when(~F.col("fmask"), F.col("f") - F.col("_m")).otherwise(0.0)).drop("_m")


def hourly_centred(spark, sf) -> DataFrame:
    return centred(hourly_dense(spark, sf))


def daily_centred(spark, sf) -> DataFrame:
    return centred(daily_dense(spark, sf))


def daily_injected(spark, sf) -> DataFrame:
    """The daily series with an integer dip every 27 days, centred."""
    d = daily_dense(spark, sf)
    dip = F.when(F.pmod(F.col("cad") - 11, F.lit(27)) < 3, INJECTED_DEPTH).otherwise(0.0)
    return centred(d.withColumn("f", F.col("f") - dip))


INJECTED_DEPTH = 30_000_000.0


def _series_sql(name, star, cad, value, frm, per_day, quarter):
    return f"""{name} AS (
  SELECT star, cad, cad / {float(per_day)}::DOUBLE AS t, s::DOUBLE AS f, sqrt(n) AS ferr, false AS fmask,
         n AS quality, CAST(floor(cad / {quarter}) AS INT) AS quarter
  FROM (SELECT {star} AS star, CAST({cad} AS BIGINT) AS cad,
               CAST(SUM(CAST(round({value} * 100) AS BIGINT)) AS BIGINT) AS s, COUNT(*) AS n
        FROM {frm} GROUP BY 1, 2))"""


_DAYS = "date_diff('day', DATE '1995-01-02', l_shipdate::DATE)"
HOURLY = _series_sql(
    "hourly", "event_type", "date_diff('day', DATE '2024-01-01', ts::DATE) * 24 + hour(ts)", "value", "events", 24, 240
)
DAILY = _series_sql("daily", "l_returnflag", _DAYS, "l_extendedprice", "lineitem", 1, 250)
ENSEMBLE = _series_sql(
    "ensemble", "lpad(CAST(s_nationkey AS VARCHAR), 2, '0')", f"floor({_DAYS} / 5)", "l_extendedprice",
    "lineitem JOIN supplier ON l_suppkey = s_suppkey", 1, 50,
)


def dense_sql(src: str, out: str, per_day: int) -> str:
    return f"""{out} AS (
  SELECT g.star, g.cad, g.cad / {float(per_day)}::DOUBLE AS t, l.f, l.ferr, coalesce(l.fmask, true) AS fmask,
         l.quality, l.quarter
  FROM (SELECT star, unnest(range(a, b + 1)) AS cad
        FROM (SELECT star, min(cad) AS a, max(cad) AS b FROM {src} GROUP BY star)) g
  LEFT JOIN {src} l ON l.star = g.star AND l.cad = g.cad)"""


def centred_sql(src: str, out: str) -> str:
    return f"""{out} AS (
  SELECT * REPLACE (CASE WHEN NOT fmask THEN f - m ELSE 0 END AS f)
  FROM (SELECT *, median(CASE WHEN NOT fmask THEN f END) OVER (PARTITION BY star) AS m FROM {src}))"""


HOURLY_DENSE = HOURLY + ",\n" + dense_sql("hourly", "hd", 24)
DAILY_DENSE = DAILY + ",\n" + dense_sql("daily", "dd", 1)
HOURLY_CENTRED = HOURLY_DENSE + ",\n" + centred_sql("hd", "hc")
DAILY_CENTRED = DAILY_DENSE + ",\n" + centred_sql("dd", "dc")
DAILY_INJECTED = (
    DAILY_DENSE
    + f""",
di0 AS (SELECT * REPLACE (f - CASE WHEN (cad - 11) - floor((cad - 11) / 27) * 27 < 3 THEN {INJECTED_DEPTH} ELSE 0 END AS f)
        FROM dd),
"""
    + centred_sql("di0", "di")
)
