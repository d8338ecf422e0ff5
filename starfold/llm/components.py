"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.session import cut_lineage, release


def _checksum(edges: DataFrame) -> tuple:
    # Order does not matter to a sum; decimals keep it from overflowing.
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``, for every node that has one.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edge set stays
    as it is. A neighbourhood is only ever reduced to its minimum (combined on the map side) and
    joined back, so a hub of any degree is neither collected nor held by one task; AQE splits its
    rows in the join. Each round is written to the checkpoint folder and the one before is removed.
    Edges with a null end and loops are ignored; an empty table gives an empty result.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = cut_lineage(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct())
    seen = _checksum(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut_lineage(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        release(now)
        now, before, seen = new, seen, _checksum(new)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
