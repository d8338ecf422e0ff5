"""Reading, reshaping and selecting light curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.functions import stats
from starfold.operators import clean

REQUIRED = ("t", "f", "ferr", "fmask")

LC = T.StructType(
    [
        T.StructField("star", T.StringType()),
        T.StructField("cad", T.LongType()),
        T.StructField("t", T.DoubleType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("ferr", T.DoubleType()),
        T.StructField("fmask", T.BooleanType()),
        T.StructField("quality", T.LongType()),
        T.StructField("quarter", T.IntegerType()),
    ]
)

# Columns of a raw light-curve table that no stage uses (fixed names of the input format).
UNUSED = (
    "TIMECORR", "SAP_BKG", "SAP_BKG_ERR", "PSF_CENTR1", "PSF_CENTR1_ERR", "PSF_CENTR2", "PSF_CENTR2_ERR",
    "MOM_CENTR1", "MOM_CENTR1_ERR", "MOM_CENTR2", "MOM_CENTR2_ERR", "POS_CORR1", "POS_CORR2",
)


def require_columns(df: DataFrame, needed: Sequence[str] = REQUIRED) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"light curve must contain {', '.join(missing)}")
    return df


def load_lc(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Light curves from parquet, csv, json or orc; NaN flux and time become NULL."""
    reader = spark.read.format(fmt)
    if schema is not None or fmt in ("csv", "json"):
        reader = reader.schema(schema or LC)
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = require_columns(reader.load(path))
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: stats.nan_to_null(F.col(c)) for c in doubles})


def load_params(spark: SparkSession, path: str, table: str, fmt: str = "parquet", **options) -> DataFrame:
    """A stage parameter table (``pp``, ``grid`` or ``dv``), from files or a JDBC source."""
    if table not in ("pp", "grid", "dv"):
        raise ValueError(table)
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(url=path, dbtable=table, **options).load()
    return spark.read.format(fmt).options(**options).load(f"{path}/{table}")


def with_params(df: DataFrame, params: DataFrame, on: str = "star") -> DataFrame:
    return df.join(params, on)


def _normal_path(c: Column) -> Column:
    """File paths as both the listing and the rows give them: one slash behind the scheme."""
    return F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def load_folder(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", schema: T.StructType = LC) -> tuple[DataFrame, DataFrame]:
    """All light curves under a folder, and the files that gave none: (lc, quarantine).

    A file that cannot be read does not stop the others: it is skipped, and ``quarantine`` (file,
    length) lists it by comparing the folder's listing, which opens no file, with the files that rows
    came from. Files without rows are listed as well. ``lc`` has the column ``file``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(_normal_path(F.col("path")).alias("file"), "length")
    reader = spark.read.format(fmt).schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    if fmt == "csv":
        reader = reader.option("header", "true").option("mode", "DROPMALFORMED")
    lc = reader.load(path).withColumn("file", _normal_path(F.col("_metadata.file_path")))
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    lc = lc.withColumns({c: stats.nan_to_null(F.col(c)) for c in doubles})
    return lc, files.join(lc.select("file").distinct(), "file", "left_anti")


def checked_quarters(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Quarters of light curves read from many files; fails if a file holds more than one star, or a
    (star, quarter) comes from more than one ``file``. Keeps the wanted columns."""
    held = df.groupBy("star", "quarter", "file").agg(F.lit(1).alias("_one"))
    dup = held.groupBy("star", "quarter").agg(F.count(F.lit(1)).alias("_n"))
    stars = held.groupBy("file").agg(F.min("star").alias("_s1"), F.max("star").alias("_s2"))
    out = df.join(dup, ["star", "quarter"]).join(stars, "file")
    out = out.where(F.assert_true(F.col("_n") == 1, F.lit("quarter given twice")).isNull())
    out = out.where(F.assert_true(F.col("_s1") == F.col("_s2"), F.lit("file with more than one star")).isNull())
    return out.select(*(columns or [c for c in df.columns if c != "file"]))


def load_quarters(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Light curves of many files, each one star's quarter, checked as ``checked_quarters`` does."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(*paths)
    return checked_quarters(df.withColumn("file", _normal_path(F.col("_metadata.file_path"))), columns)


def clean_columns(raw: DataFrame) -> DataFrame:
    """Raw names to ours, unused columns dropped, flux normalised per quarter, time gaps filled."""
    x = raw.drop(*UNUSED).withColumnsRenamed({"TIME": "t", "CADENCENO": "cad", "SAP_QUALITY": "quality"})
    x = clean.normalize_quarter(
        x,
        pairs=(("SAP_FLUX", "SAP_FLUX_ERR"), ("PDCSAP_FLUX", "PDCSAP_FLUX_ERR")),
        out=(("f", "ef"), ("fpdc", "efpdc")),
    )
    x = x.withColumn("t", stats.nan_to_null(F.col("t")))
    return clean.interp_masked(x, "t", F.col("t").isNotNull())


def stack(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def split_by_star(df: DataFrame, path: str, width: int = 9, files_per_star: int = 1) -> None:
    """One folder per zero-padded star id. Rows are spread by (star, slice), so one star does not
    pile up in one writer when ``files_per_star`` is raised."""
    out = df.withColumn("star_id", F.lpad("star", width, "0"))
    out.repartition("star_id", F.pmod(F.xxhash64("cad"), F.lit(files_per_star))).write.partitionBy("star_id").parquet(path)


def modal_length(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stars with the most common row count (the smaller on ties), and the others with theirs."""
    n = df.groupBy("star").agg(F.count(F.lit(1)).alias("n"))
    votes = n.groupBy("n").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.agg(F.max(F.struct("votes", (-F.col("n")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("expected"))
    mark = n.join(best, F.col("n") == F.col("expected"), "left")
    good = mark.where("expected IS NOT NULL").select("star")
    rest = mark.where("expected IS NULL").select("star", "n")
    return df.join(good, "star", "left_semi"), rest


def subsample_stars(stars: DataFrame, keep: DataFrame | None, n: int, seed: int = 0) -> DataFrame:
    """``n`` stars of the list in a seeded random order, sorted by id."""
    s = stars.select("star").distinct()
    if keep is not None:
        s = s.join(keep.select("star"), "star", "left_semi")
    key = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col("star")))
    return s.orderBy(key).limit(n).orderBy("star")


def attach_keywords(df: DataFrame, meta: DataFrame, on: str = "star") -> DataFrame:
    return df.join(meta, on, "left")
