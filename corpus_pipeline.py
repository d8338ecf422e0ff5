"""From raw documents to packed training sequences: quality, near duplicates, personal data, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import table
from starfold.llm.jaccard_dedup import jaccard_groups
from starfold.llm.mixing import mixed_documents
from starfold.llm.packing import pack, public_byte_bpe
from starfold.llm.pii import redact
from starfold.llm.quality_classifier import keep_good
from starfold.llm.simhash_dedup import first_of_groups
from starfold.session import cut_lineage, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the table ``labels``, does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies: texts linked by a Jaccard
    similarity of 0.8 or more on five-word shingles, among candidates by SimHash and MinHash."""
    return first_of_groups(docs, groups_of=jaccard_groups)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    out = redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return pack(docs, *public_byte_bpe())


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", packing),
]

#: Compression sizes, fingerprints and tokens are not expressible in SQL; the stages are tested
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut_lineage(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
