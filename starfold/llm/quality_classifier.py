"""Quality scores by compression: zstandard dictionaries of good and bad texts, compared and calibrated."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import table

#: Bytes of text compressed at a time: short enough for a dictionary to count, whatever the text's length.
CHUNK = 2048
#: Labelled ids per class for the dictionaries and for the calibration; bytes of a dictionary, of which
#: each text gives an equal share from a place picked by hash, and the least share.
DICT_ROWS, FIT_ROWS, DICT_BYTES, LEAST_SHARE = 3000, 6000, 1 << 18, 64
LEVEL = 3
#: Bytes of a frame's header, the same for every text.
FRAME = len(zstandard.ZstdCompressor(write_content_size=False, write_checksum=False).compress(b"")) - 1
THRESHOLD = 0.3


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the weights of the calibrated score."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def measures(texts: Sequence[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: the normalised difference of its sizes under the two dictionaries (over all chunks,
    and the largest and smallest of a chunk) and its compression ratio. A text without bytes has
    differences of 0 and ratio 1."""
    a, b = _compressor(good), _compressor(bad)
    out = np.zeros((len(texts), 4))
    for k, text in enumerate(texts):
        data = text.encode() if text else b""
        if not data:
            out[k] = 0, 0, 0, 1
            continue
        n = max(1, round(len(data) / CHUNK))
        cuts = [len(data) * i // n for i in range(n + 1)]
        x = [len(a.compress(data[i:j])) - FRAME for i, j in zip(cuts, cuts[1:])]
        y = [len(b.compress(data[i:j])) - FRAME for i, j in zip(cuts, cuts[1:])]
        each = [(p - q) / (p + q) for p, q in zip(x, y)]
        ratio = min(1.0, min(sum(x), sum(y)) / len(data))
        out[k] = (sum(x) - sum(y)) / (sum(x) + sum(y)), max(each), min(each), ratio
    return out


def _design(m: np.ndarray) -> np.ndarray:
    """Columns of the calibration: the differences, the log of the ratio and their squares."""
    z = np.column_stack([10 * m[:, :3], np.log(np.maximum(m[:, 3], 1e-6))])
    return np.column_stack([np.ones(len(z)), z, z**2])


def _calibrate(m: np.ndarray, label: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps, halved until the loss falls; with one class only,
    its smoothed share."""
    x = _design(m)
    w = np.zeros(x.shape[1])
    if not len(label) or label.min() == label.max():
        w[0] = math.log((label.sum() + 1) / (len(label) - label.sum() + 1))
        return tuple(w.tolist())

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - label @ z + ridge / 2 * w @ w)

    at = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (label - p) - ridge * w
        )
        while (new := loss(w + step)) > at and np.abs(step).max() > 1e-10:
            step /= 2
        w, gain, at = w + step, at - new, new
        if gain < 1e-9:
            break
    return tuple(w.tolist())


def score_texts(texts: Sequence[str | None], model: CompressionModel) -> np.ndarray:
    z = _design(measures(texts, model.good, model.bad)) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(id_col: str) -> Column:
    """Rows that a model never learns from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _chosen(labels: DataFrame, for_dictionary: bool, rows: int) -> DataFrame:
    """(doc_id, quality): at most ``rows`` labelled ids of each class in hash order. A third of all ids
    is for the dictionaries, the others for the calibration, which so sees texts that are new to it."""
    use = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(3)) == 0
    labels = labels.where(use if for_dictionary else ~use)
    parts = [
        labels.where(F.col("quality") == q).orderBy(F.xxhash64(F.lit(42), "doc_id"), "doc_id").limit(rows) for q in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> CompressionModel:
    """Fit on labelled rows that are not held out.

    The sample is bounded by DICT_ROWS + FIT_ROWS ids of each class, picked in hash order; their ids
    are broadcast to the text, so no text is shuffled. Dictionaries are built on the driver: of n
    texts of a class each gives DICT_BYTES / n bytes (LEAST_SHARE at least) from a place picked by the
    hash of its id, a shorter one the whole of it, so that a dictionary holds all kinds and languages.
    The calibration sees only four numbers of each whole text, measured in the tasks. Of an id that
    repeats, one text counts. Conflicting labels all count; null labels, ids and texts are left out.
    Without labels every score is 0.5.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out("doc_id"))
        .distinct()
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    for_dictionary = _chosen(known, True, DICT_ROWS)
    count = {r["quality"]: r["count"] for r in for_dictionary.groupBy("quality").count().collect()}
    share = F.lit(LEAST_SHARE)
    for q, n in count.items():
        share = F.when(F.col("quality") == q, max(LEAST_SHARE, DICT_BYTES // n)).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - share + 1, F.lit(1))) + 1
    rows = (
        texts.join(F.broadcast(for_dictionary), "doc_id")
        .select("doc_id", "quality", F.substring("text", place.cast("int"), share).alias("part"))
        .groupBy("quality", "doc_id")
        .agg(F.min("part").alias("part"))
        .orderBy("doc_id")
        .toPandas()
    )
    content = []
    for q in (1, 0):
        room = max(LEAST_SHARE, DICT_BYTES // max(1, count.get(q, 0)))
        parts = [p.encode()[:room] for p in rows.loc[rows["quality"] == q, "part"]]
        content.append(b"\n".join(parts) or b"\n" * 8)
    good, bad = content

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = measures(b["text"].tolist(), good, bad)
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], **{f"m{k}": m[:, k] for k in range(m.shape[1])}})

    sample = (
        texts.join(F.broadcast(_chosen(known, False, FIT_ROWS)), "doc_id")
        .select("doc_id", "quality", "text")
        .mapInPandas(measured, "doc_id long, quality int, m0 double, m1 double, m2 double, m3 double")
        .groupBy("quality", "doc_id")
        .agg(F.min(F.struct("m0", "m1", "m2", "m3")).alias("m"))
        .select("quality", "m.*")
        .toPandas()
    )
    sample = sample.sort_values(list(sample.columns))  # sums in the same order on every run
    m = sample[["m0", "m1", "m2", "m3"]].to_numpy()
    return CompressionModel(good, bad, _calibrate(m, sample["quality"].to_numpy(dtype=float)))


def scorer(model: CompressionModel):
    """The score of a text column, as a vectorised function."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), model))

    return F.pandas_udf(run, "double")


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold; nothing is shuffled. A null or
    empty text has no sign of bad quality and stays as long as such texts score above it."""
    return docs.where(scorer(fit(docs, labels))(F.col(text_col)) >= threshold)


def score(
    docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, held_out, score, predicted) for every row: whole texts, in chunks of about CHUNK bytes.

    A null or empty text gets the score of a text without difference. Rows are independent: repeated
    rows and null ids are scored like others (a null id is not held out). Other columns are ignored.
    """

    return docs.select(
        F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out"), scorer(model)(F.col(text_col)).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
