"""Light curves derived from the shared tables.

Flux is an exact integer, so sums do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _series(df: DataFrame, star: Column, cad: Column, value: Column, per_day: int, quarter: int) -> DataFrame:
    cents = F.round(value * 100).cast("long")
    return (
        df.select(star.cast("string").alias("star"), cad.cast("long").alias("cad"), cents.alias("v"))
        .groupBy("star", "cad")
        .agg(F.sum("v").alias("s"), F.count("v").alias("n"))
        .select(
            "star",
            "cad",
            (F.col("cad") / F.lit(float(per_day))).alias("t"),
            F.col("s").cast("double").alias("f"),
            F.sqrt("n").alias("ferr"),
            F.lit(False).alias("fmask"),
            F.col("n").alias("quality"),
            F.floor(F.col("cad") / quarter).cast("int").alias("quarter"),
        )
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per event type, hourly; quarters of ten days."""
    ts = F.col("ts")
    cad = F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour(ts)
    return _series(read(spark, sf_dir, "events"), F.col("event_type"), cad, F.col("value"), 24, 240)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per return flag, daily; quarters of 250 days."""
    cad = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date"))
    return _series(
        read(spark, sf_dir, "lineitem"), F.col("l_returnflag"), cad, F.col("l_extendedprice"), 1, 250
    )


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per supplier nation, five-day cadence."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    su = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    df = li.join(su, li.l_suppkey == su.s_suppkey)
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date"))
    return _series(
        df, F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.floor(days / 5), F.col("l_extendedprice"), 1, 50
    )
