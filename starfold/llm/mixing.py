"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starfold.llm.common import table, whole_row, word_count
from starfold.session import cut_lineage

#: Bits of the hash that rank a document, and bits of it that one histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12


def rank_hash(id_col: str, seed: int) -> Column:
    """60 bits of the id's MD5, which other engines compute alike."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(key, source_size, target): weights repeat over the sources in code point order, null last;
    a target stops at ``most`` times its source's size and the excess goes to the others by weight.

    One row per source: the windows below have no partition, but see only these sums.
    """
    per = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy("key")) - 1) % len(weights) + 1)
    per = per.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    # In the order of cap / weight, a source is capped if its equal share of what is left reaches its
    # cap; what the capped ones leave is divided by the weight of the rest.
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "total": share * F.sum("source_size").over(every),
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest_w": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    capped = F.col("cap") / F.col("w") <= (F.col("total") - F.col("before")) / F.col("rest_w")
    per = per.withColumn("capped", capped)
    per = per.withColumns(
        {
            "left": F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0.0)),
            "open_w": F.sum(F.when(~F.col("capped"), F.col("w"))).over(every),
        }
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("left") / F.col("open_w"))
    return per.select("key", "source_size", target.alias("target"))


def hash_thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, threshold): documents with a hash below it hold nearly ``rest`` words of their source.

    Nested histograms: sizes are summed by source and the hash's leading bits; the bucket where the
    running sum passes the budget is the only one whose documents are looked at again, by their next
    bits. The last level resolves single hash values; one that straddles the budget is taken if at
    least half of it fits.
    """
    rows = sized.select("key", "hash", "size")
    # prefix: hash of the boundary so far; done: sources that fit whole.
    state = budgets.select("key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("whole"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        step = Window.partitionBy("key").orderBy("bucket")
        hist = (
            rows.groupBy("key", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("n"))
            .withColumn("end", F.sum("n").over(step))
            .join(state.where("NOT whole").select("key", "rest"), "key")
            .where(F.col("end") > F.col("rest"))
        )
        edge = hist.groupBy("key").agg(F.min_by(F.struct("bucket", F.col("end") - F.col("n"), "n"), "bucket").alias("e"))
        edge = edge.select("key", F.col("e.bucket").alias("bucket"), F.col("e.col2").alias("begin"), F.col("e.n").alias("n"))
        state = state.drop("n").join(edge, "key", "left").select(
            "key",
            (F.col("rest") - F.coalesce("begin", F.lit(0))).alias("rest"),
            F.coalesce(F.shiftleft("bucket", shift), "prefix").alias("prefix"),
            (F.col("whole") | F.col("bucket").isNull()).alias("whole"),
            "n",
        )
        state = cut_lineage(state)
        if shift:
            inside = F.shiftright("hash", shift) == F.shiftright("prefix", shift)
            rows = cut_lineage(
                rows.join(state.where("NOT whole").select("key", "prefix"), "key").where(inside).select("key", "hash", "size")
            )
    last = F.col("prefix") + (F.col("n") / 2 <= F.col("rest")).cast("long")
    return state.select("key", F.when(F.col("whole"), F.lit(1 << HASH_BITS)).otherwise(last).alias("threshold"))


def source_key(source_col: str) -> Column:
    """Orders sources by code point, null last."""
    return F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))


def plan(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], share: float, most: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """(sized, plan): every document's (id, key, size, hash), and per source its size, target, whole
    copies and the hash threshold of one copy more."""
    sized = cut_lineage(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            source_key(source_col).alias("key"),
            word_count(F.col(text_col)).alias("size"),
            rank_hash(id_col, seed).alias("hash"),
        )
    )
    targets = source_targets(sized, weights, share, float(most))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most)))
    targets = cut_lineage(
        targets.withColumn("copies", F.coalesce(whole, F.lit(0)).cast("long")).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    )
    thresholds = hash_thresholds(sized, targets)
    # A source with nothing left to take needs no threshold, nor one without words.
    low = F.when((F.col("copies") < most) & (F.col("source_size") > 0), F.col("threshold")).otherwise(F.lit(0))
    return sized, cut_lineage(targets.join(thresholds, "key").withColumn("threshold", low))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 42,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (whole copies times size).

    A source whose target is k times its size and a rest is taken k times whole, and the rest from
    the documents below a hash threshold. Texts are read once for their word counts; all later passes
    see (source, hash, size), and nothing is sorted but the histogram of a source. Sums are combined
    on the map side, so a hot source costs a task at most one row per bucket.

    A source's taken words differ from its target by at most half a document (half a group of rows
    that share an id). A null text has size 0 and is never taken; a null source is a source of its
    own, last in order; null ids share one hash, repeated rows another. Sources without words have
    target 0. An empty table gives no rows. Other columns are ignored.
    """
    sized, per_source = plan(docs, id_col, text_col, source_col, weights, share, most, seed)
    copies = F.col("copies") + (F.col("hash") < F.col("threshold")).cast("long")
    return sized.join(per_source, "key").select(
        F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken")
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 42,
) -> DataFrame:
    """The mix itself: all columns, a document as many times as it is taken. The texts are filtered
    where they are read, against one row per source; rules and edge cases are those of ``mix``."""
    _, per_source = plan(docs, id_col, text_col, source_col, weights, share, most, seed)
    rows = docs.select(whole_row(docs).alias("_row"), source_key(source_col).alias("key"), rank_hash(id_col, seed).alias("_h"))
    copies = F.col("copies") + (F.col("_h") < F.col("threshold")).cast("long")
    taken = rows.join(per_source.select("key", "copies", "threshold"), "key").withColumn("_n", copies.cast("int")).where("_n > 0")
    return taken.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, 2e0 * CAST(sum(size) AS BIGINT) AS cap FROM d GROUP BY key),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS w,
             1.5e0 * CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
c AS (SELECT *, cap / w <= (total - coalesce(sum(cap) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
                / sum(w) OVER (ORDER BY cap / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM w),
t AS (SELECT key, source_size,
             CASE WHEN capped THEN cap
                  ELSE w * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0e0))
                       / sum(CASE WHEN NOT capped THEN w END) OVER () END AS target FROM c),
k AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS copies FROM t),
g AS (SELECT key, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY key ORDER BY h) AS upto FROM d GROUP BY key, h)
SELECT d.doc_id, d.size, k.source_size, k.target,
       CAST((k.copies + CASE WHEN k.copies < 2 AND g.upto - g.n / 2e0 <= k.target - k.copies * k.source_size THEN 1 ELSE 0 END)
            * d.size AS BIGINT) AS taken
FROM d JOIN k USING (key) JOIN g ON g.key = d.key AND g.h = d.h
"""
