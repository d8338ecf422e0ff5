"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import local_components, table
from starfold.llm.components import connected_components
from starfold.session import cut_lineage

#: Vectors that a bucket is meant to hold, and the side of a block of pairs.
BUCKET, BLOCK = 256, 1024


def hash_shape(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables): buckets of about BUCKET vectors, and as many tables as a pair exactly at the
    threshold needs to meet in one of them with probability ``recall``."""
    bits = max(1, math.ceil(math.log2(max(n, 1) / BUCKET)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _signatures(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # first, so that squares of extreme values stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the two blocks of a bucket (or inside one), each in the first table where its
    two vectors meet: per vector the number of linked copies and the smallest id it reaches here."""
    group = group.sort_values("rep", ignore_index=True)
    x, sigs, copies = _unit(group["embedding"]), np.stack(group["sigs"].to_numpy()), group["copies"].to_numpy()
    t, i_block, j_block = (int(group[c].iloc[0]) for c in ("tab", "bi", "bj"))
    own = group["block"].to_numpy()
    left, right = np.flatnonzero(own == i_block), np.flatnonzero(own == j_block)
    close = x[left] @ x[right].T >= threshold
    if i_block == j_block:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    i, j = left[i], right[j]
    new = np.ones(len(i), dtype=bool)
    for k in range(t):
        new &= sigs[i, k] != sigs[j, k]
    i, j = i[new], j[new]
    n = len(group)
    links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    rep = group["rep"].to_numpy()
    out = pd.DataFrame({"rep": rep, "links": links.astype(np.int64), "root": rep[local_components(n, i, j)]})
    return out[links > 0]


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    recall: float = 0.999,
    seed: int = 42,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Equal vectors become one class with a count first. Classes are hashed by the signs of random
    projections into several tables; inside a bucket all pairs are verified by cosine in double
    precision. A bucket of more than BLOCK classes is cut into blocks and each pair of blocks is a
    group of its own, so no task holds a hot bucket. Pairs never leave the task: what is shuffled is
    a count and a spanning edge per vector.

    Links have cosine >= threshold, exactly. A pair at the threshold is found with probability
    ``recall``, a closer one more likely. Null, zero or empty vectors, vectors with null or
    non-finite components and rows with a null id link with nothing (n_links 0, component_id = id).
    Vectors of different lengths never link. Repeated rows count as copies of each other. Rows that
    share an id are one vertex. Columns other than the two are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    usable = (
        F.col("id").isNotNull()
        & F.coalesce(F.size("embedding") > 0, F.lit(False))
        & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("embedding", lambda c: c != 0)
    )
    rows = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.col("embedding"))).drop("embedding")
    classes = cut_lineage(
        rows.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumnRenamed("key", "embedding")
    )
    bits, tables = hash_shape(classes.count(), threshold, recall)
    kind = classes.schema["embedding"].dataType.simpleString()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for all_rows in batches:
            for _, b in all_rows.groupby(all_rows["embedding"].map(len)):
                sigs = _signatures(_unit(b["embedding"]), bits, tables, seed)
                b = b.assign(sigs=list(sigs))
                for t in range(tables):
                    yield b.assign(tab=t, bucket=sigs[:, t])

    buckets = classes.mapInPandas(
        hashed, f"embedding {kind}, rep long, copies long, sigs array<long>, tab int, bucket long"
    ).withColumn("dim", F.size("embedding"))
    where = ["tab", "dim", "bucket"]
    # The ids alone are hashed a second time to find the buckets that need more than one block.
    hot = (
        buckets.groupBy(*where)
        .count()
        .where(F.col("count") > BLOCK)
        .select(*where, F.ceil(F.col("count") / BLOCK).cast("int").alias("nb"))
    )
    blocks = (
        buckets.join(hot, where, "left")
        .withColumn("nb", F.coalesce("nb", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        .withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
        .drop("other", "nb")
    )
    found = cut_lineage(
        blocks.groupBy(*where, "bi", "bj").applyInPandas(
            lambda g: _links(g, threshold), "rep long, links long, root long"
        )
    )
    label = connected_components(found, "rep", "root").select(F.col("node").alias("rep"), "component")
    per_class = (
        classes.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(label, "rep", "left")
        .select(
            F.col("embedding").alias("key"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = rows.join(per_class, "key", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
