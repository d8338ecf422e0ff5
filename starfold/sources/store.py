"""Result store: stage tables and per-star scalars as append-only Parquet.

Every write is a new batch with a sequence number; reading keeps each star's newest. A failed or
repeated write never damages what is there.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.functions import stats


def header_rows(df: DataFrame, values: Mapping[str, tuple[Column, str]], seq: int) -> DataFrame:
    """Long form (star, name, value, description, seq) of per-star scalars."""
    items = F.array(
        *[
            F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), F.lit(d).alias("description"))
            for n, (v, d) in values.items()
        ]
    )
    return df.select("star", F.explode(items).alias("_h"), F.lit(seq).alias("seq")).select("star", "_h.*", "seq")


def upsert_header(*batches: DataFrame) -> DataFrame:
    """The newest value per (star, name)."""
    rows = batches[0]
    for b in batches[1:]:
        rows = rows.unionByName(b)
    return stats.top_row(rows, ["star", "name"], [F.col("seq")], ["value", "description", "seq"])


def wide_header(header: DataFrame, names: Sequence[str], keys: Sequence[str] = ("star",), prefix: str = "") -> DataFrame:
    """One row per key with the wanted scalars; missing ones are NULL."""
    cells = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(prefix + n) for n in names]
    return header.groupBy(*keys).agg(*cells)


def candidate_rows(first: DataFrame, second: DataFrame, names: Sequence[str], fit_names: Sequence[str]) -> DataFrame:
    """One row per (star, candidate): scalars of the search stage, then of the fit stage with the
    prefix ``fit_``; what is missing is NULL."""
    keys = ["star", "candidate"]
    return wide_header(first, names, keys).join(wide_header(second, fit_names, keys, "fit_"), keys, "left")


def append_candidates(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def scrape(stars: DataFrame, header: DataFrame, names: Sequence[str]) -> DataFrame:
    """Chosen scalars for a list of stars, NULL where a star has no result."""
    return stars.select("star").join(wide_header(header, names), "star", "left")


def scrape_csv(stars: DataFrame, header: DataFrame, names: Sequence[str], path: str) -> None:
    scrape(stars, header, names).write.option("header", "true").csv(path)


class ResultStore:
    """Named stage tables under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def update_table(self, name: str, df: DataFrame, seq: int | None = None) -> None:
        """Append a batch; for its stars it replaces what was stored before."""
        seq = time.time_ns() if seq is None else seq
        df.withColumn("seq", F.lit(seq).cast("long")).write.mode("append").parquet(f"{self.path}/{name}")

    def update_header(self, df: DataFrame, values: Mapping[str, tuple[Column, str]], seq: int | None = None) -> None:
        seq = time.time_ns() if seq is None else seq
        header_rows(df, values, seq).withColumn("seq", F.lit(seq).cast("long")).write.mode("append").parquet(
            f"{self.path}/header"
        )

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        newest = rows.groupBy("star").agg(F.max("seq").alias("seq"))
        return rows.join(newest, ["star", "seq"], "left_semi").drop("seq")

    def header(self) -> DataFrame:
        return upsert_header(self.spark.read.parquet(f"{self.path}/header"))

    def shapes(self, names: Sequence[str]) -> DataFrame:
        """Row and column count of each stored table."""
        out = None
        for n in names:
            t = self.table(n)
            row = t.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(n).alias("name"), "rows", F.lit(len(t.columns)).alias("columns")
            )
            out = row if out is None else out.unionByName(row)
        return out


def stage(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """The stage table at ``path``; built and written first if absent, unfinished or ``force``.

    A write that ended leaves the file ``_SUCCESS``; a folder without it is of a run that broke off.
    """
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if force or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
