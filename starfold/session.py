"""Session settings and stage checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Folder made for a local session without one, and stage tables of the open ``stage_tables`` blocks.
_local_folder: dict[str, str] = {}
_open_blocks: list[list[DataFrame]] = []


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster both come from
    spark-submit and AQE resizes the shuffles.
    """
    b = (
        SparkSession.builder.appName("starfold")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is configured on a
    local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _local_folder:
        _local_folder[context.applicationId] = tempfile.mkdtemp(prefix="starfold-ckpt-")
    return _local_folder[context.applicationId]


@contextmanager
def stage_tables() -> Iterator[None]:
    """Remove at the end of the block the stage tables that were written inside it.

    Lazy results read them, so write or collect those inside: ``with stage_tables(): search(...).write...``.
    """
    _open_blocks.append([])
    try:
        yield
    finally:
        release(*_open_blocks.pop())


def stage_folder(spark: SparkSession) -> str:
    """Path of a new stage table in the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/starfold-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a stage table in the checkpoint folder and read it back."""
    path = stage_folder(df.sparkSession)
    df.write.parquet(path)
    return as_stage_table(df.sparkSession.read.schema(df.schema).parquet(path), path)


def as_stage_table(out: DataFrame, path: str) -> DataFrame:
    """``out``, which reads ``path``, with that path to be removed as a stage table is."""
    out.stage_path = path
    if _open_blocks:
        _open_blocks[-1].append(out)
    return out


def staged(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a stage table, else written as one: for what several steps read."""
    return df if getattr(df, "stage_path", None) else cut_lineage(df)


def release(*tables: DataFrame | None) -> None:
    """Remove stage tables that ``cut_lineage`` wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "stage_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
