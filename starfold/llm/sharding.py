"""Shuffled shards by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starfold.llm.common import table, whole_row
from starfold.session import as_stage_table, cut_lineage, release, stage_folder

#: Bytes of text that a bucket is meant to hold: one task shuffles it in memory.
BUCKET_BYTES = 16 << 20
ROW_BYTES = 16
#: Buckets numbered together: one task adds up so many, and one the runs of them.
RUN = 4096


def document_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed amount per row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def two_pass_shuffle(rows: DataFrame, n_shards: int, buckets: int, seed: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows``, a stage table of any columns.

    Pass 1 scatters the rows uniformly into ``buckets`` by a seeded hash of a row and its place in the
    table, so that rows alike in all columns, however many, spread like others. Pass 2 gathers a bucket,
    brings it into a fixed order and permutes it (Spark's ``shuffle`` is a Fisher-Yates shuffle). The
    buckets one after another are the shuffled corpus; a shard is an equal run of it, so counts
    differ by at most one. Where a bucket begins comes from one count per bucket, added up in runs of
    RUN buckets and over the runs.
    """
    # A stage table's files, and so the places of its rows, are the same whenever it is read.
    dealt = rows.select(whole_row(rows).alias("row"), F.monotonically_increasing_id().alias("place"))
    dealt = dealt.select(F.pmod(F.xxhash64(F.lit(seed), "row", "place"), F.lit(buckets)).cast("long").alias("bucket"), "row")
    counts = dealt.groupBy("bucket").count().withColumn("run", F.floor(F.col("bucket") / RUN))
    runs = counts.groupBy("run").agg(F.sum("count").alias("n"))
    over = Window.orderBy("run")
    runs = runs.select(
        "run",
        (F.sum("n").over(over) - F.col("n")).alias("before"),
        F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = F.sum("count").over(Window.partitionBy("run").orderBy("bucket")) - F.col("count")
    begins = counts.withColumn("inside", inside).join(runs, "run").select("bucket", (F.col("before") + F.col("inside")).alias("begin"), "total")
    held = dealt.groupBy("bucket").agg(F.array_sort(F.collect_list("row")).alias("held"))
    mixed = held.sortWithinPartitions("bucket").withColumn("held", F.shuffle("held", F.lit(seed)))
    placed = mixed.join(begins, "bucket").select("begin", "total", F.posexplode("held").alias("pos", "row"))
    placed = placed.withColumn("shard", F.expr(f"int(((begin + pos) * {n_shards}) div total)"))
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return placed.select("row.*", "shard", (F.col("begin") + F.col("pos") - first).alias("slot"))


def shard(
    docs: DataFrame,
    n_shards: int = 40,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per document: id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null).

    ``write_shards`` sends the whole documents through both passes and writes them as shards into a
    stage folder; the columns are read from the shards as they lie there, size and checksum from the
    texts that arrived. Null texts have size 16 and checksum 0. An empty table gives no rows. Other
    columns travel with their rows and are not returned.
    """
    path = stage_folder(docs.sparkSession)
    written = as_stage_table(write_shards(docs, path, n_shards, seed, text_col, bucket_bytes), path)
    return written.select(
        F.col(id_col).cast("long").alias(id_col),
        document_size(F.col(text_col)).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame, path: str, n_shards: int = 40, seed: int = 42, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Write whole documents as shuffled shards: folders ``shard=N`` of Parquet (zstd) with a ``slot`` column.
    Returns the written table.

    All columns travel through the two passes, from a stage table that is removed at the end; the
    documents' own columns ``shard`` and ``slot`` become ``shard_`` and ``slot_``. The number of buckets
    comes from the bytes of the texts. Rows spread by a hash of all columns and their place, so neither
    a hot source nor a group of copies nor exact repeats gather. Any order of a bucket is valid, and its
    permutation is drawn in the task that numbers and writes its rows, so a retry cannot tear it. An
    empty table gives an empty one; null and very long texts, ties and repeated rows are written like
    others. A bucket goes into the one or few shards its run falls in; rows of a file are in order of slot.
    """
    for c in ("shard", "slot"):
        if c in docs.columns:
            docs = docs.withColumnRenamed(c, f"{c}_")
    docs = cut_lineage(docs)
    total = docs.agg(F.sum(document_size(F.col(text_col)))).first()[0] or 0
    placed = two_pass_shuffle(docs, n_shards, max(1, -(-total // bucket_bytes)), seed)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    release(docs)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
