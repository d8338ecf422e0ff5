"""Table access and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as Java and Python regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"


#: A list joined to the texts is broadcast up to this many bytes, and shuffled beyond.
BROADCAST_BYTES = 32 << 20

#: SQL for DuckDB, which has no crc32: the value of a blob ``b`` over the table ``t`` of ``crc_table``.
CRC_TABLE_SQL = """crc_table AS (
    SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
    FROM range(256) r(i)
)"""
CRC_SQL = """xor(4294967295, list_reduce([4294967295] || list_transform(range(octet_length(b)),
        lambda i: ('0x' || substr(hex(b), (2 * i + 1)::BIGINT, 2))::BIGINT), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(rows: DataFrame) -> Column:
    """All columns in one struct, so that what an operator adds cannot clash with their names."""
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns])


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8. ``bytes.split`` cuts at exactly the six characters that WORD leaves out."""
    return text.encode().split() if text else []


def beside(rows: DataFrame, side: DataFrame, key: str, how: str, row_bytes: int, items: str | None = None) -> DataFrame:
    """Join a stage table to wide rows: broadcast if its measured size is at most BROADCAST_BYTES,
    otherwise by a shuffle. ``items`` names an array column, counted at 16 bytes an item."""
    size = F.count(F.lit(1)) * row_bytes + (F.coalesce(F.sum(F.size(items)), F.lit(0)) * 16 if items else F.lit(0))
    small = (side.agg(size).first()[0] or 0) <= BROADCAST_BYTES
    return rows.join(F.broadcast(side) if small else side, key, how)


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` vertices over the edges (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
