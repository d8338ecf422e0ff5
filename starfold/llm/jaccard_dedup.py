"""Near copies by Jaccard similarity of word shingles: candidates by SimHash and MinHash, exact links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import beside, local_components
from starfold.llm.components import connected_components
from starfold.llm.simhash_dedup import fingerprint_edges, shingle_hashes, simhash
from starfold.session import cut_lineage, release

#: Bands and rows of the MinHash signature: two sets meet in a band with probability
#: 1 - (1 - J**ROWS)**BANDS, which is 1 - 8e-6 at J = 0.8, 0.22 at 0.5 and 0.0005 at 0.2.
BANDS, ROWS = 64, 8
#: Fingerprints this near are candidates too.
REACH = 2
#: Sets that a task compares at a time; cells of the matrices it makes signatures and counts with.
BLOCK, SIGN_CELLS, CELLS = 1024, 1 << 16, 1 << 20
#: Texts taken out of an Arrow batch at a time, and elements of sets that are matched at a time.
TEXTS, ELEMENTS = 512, 1 << 18
#: Keeps rounding from excluding a pair that lies exactly at the threshold.
EPS = 1e-9

_rng = np.random.default_rng(42)
FLIP = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
SPREAD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def set_key(shingles: np.ndarray) -> int:
    """64-bit name of a set, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least of the shingles under each of BANDS * ROWS hash functions; zeros for an empty set."""
    out = np.zeros(BANDS * ROWS, np.uint32)
    if len(shingles):
        h = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        step = max(1, SIGN_CELLS // len(h))
        for a in range(0, len(out), step):
            out[a : a + step] = ((h ^ FLIP[a : a + step, None]) * SPREAD[a : a + step, None]).min(axis=1)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per signature and band; keys of different bands are different."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rows.shape[:2])
    for r in range(ROWS):
        key = (key ^ rows[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
        key = key ^ (key >> np.uint64(32))
    return key.view(np.int64)


def described(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, v, n, fp, keys) per text, in the task that reads it: the name and size of its shingle set,
    its SimHash fingerprint and its band keys."""

    schema = pa.schema([("id", pa.int64()), ("v", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes = [shingle_hashes(t, shingle) for t in b.column("text").to_pylist()]
            sets = [np.unique(h) for h in hashes]
            fp = np.array([simhash(h) for h in hashes], dtype=np.uint64).view(np.int64)
            keys = band_keys(np.array([signature(s) for s in sets]))
            ends = np.arange(0, keys.size + 1, BANDS, dtype=np.int32)
            columns = [b.column("id"), pa.array([set_key(s) for s in sets], pa.int64()), pa.array(fp), pa.ListArray.from_arrays(ends, keys.ravel())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return texts.mapInArrow(run, "id long, v long, fp long, keys array<long>")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows some at a time, so that few texts are Python objects at once."""
    for b in batches:
        for a in range(0, b.num_rows, TEXTS):
            yield b.slice(a, TEXTS)


def candidate_edges(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (v, w) that connect all candidates, a stage table to be released after their use). Sets
    with a band in common are tied to the smallest of them, and so are sets with equal fingerprints;
    near fingerprints come from the vantage-point tree. No group is ever paired with itself."""
    bands = named.select("v", F.explode("keys").alias("key"))
    met = bands.groupBy("key").agg(F.min("v").alias("w"), F.max("v").alias("high")).where("w <> high").select("key", "w")
    by_band = bands.join(met, "key").where("v <> w").select("v", "w").distinct()
    points = cut_lineage(named.groupBy("fp").agg(F.min("v").alias("rep")))
    equal = named.join(points.withColumnRenamed("rep", "w"), "fp").where("v <> w").select("v", "w").distinct()
    near = fingerprint_edges(points, REACH).select(F.col("rep").alias("v"), F.col("root").alias("w"))
    return by_band.unionByName(equal).unionByName(near), points


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections of the sorted sets ``a`` with those of ``b`` (with each other without
    it), by products of 0/1 matrices over some of the shared elements at a time, which come from one
    range of hashes after the other: beside the sets and the result, some ELEMENTS are held."""
    sets = a if b is None else [*a, *b]
    # Whole numbers, exact up to 2**24 and past it in float64.
    out = np.zeros((len(a), len(a) if b is None else len(b)), np.float32 if max(map(len, sets)) < 1 << 24 else np.float64)
    ranges = max(1, -(-sum(map(len, sets)) // ELEMENTS))
    bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    cuts = np.array([[0, *np.searchsorted(s, bounds), len(s)] for s in sets])
    width = max(256, CELLS // len(sets))
    for r in range(ranges):
        row = np.repeat(np.arange(len(sets), dtype=np.int32), cuts[:, r + 1] - cuts[:, r])
        _, column, count = np.unique(np.concatenate([s[x:y] for s, (x, y) in zip(sets, cuts[:, r : r + 2])]), return_inverse=True, return_counts=True)
        shared = count > 1
        number = np.cumsum(shared) - 1
        keep = shared[column]
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total = int(shared.sum())
        at = np.searchsorted(column, np.arange(0, total + width, width))
        for k, (x, y) in enumerate(zip(at, at[1:])):
            held = np.zeros((len(sets), min(width, total - k * width)), np.float32)
            held[row[x:y], column[x:y] - k * width] = 1
            out += held[: len(a)] @ (held if b is None else held[len(a) :]).T
    return out


def _links(names: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> pd.DataFrame:
    """A spanning forest (v, root) of the sets that are similar enough: among all of them, or between
    the two sides. The pairs of a strip go into the forest before those of the next are made."""
    order = np.argsort(names)
    names, sets = names[order], [sets[k] for k in order]
    n = np.array([len(s) for s in sets], dtype=float)
    if side is None:
        p = q = np.arange(len(sets))
        both = overlaps(sets)
    else:
        p, q = np.flatnonzero(~side[order]), np.flatnonzero(side[order])
        both = overlaps([sets[k] for k in p], [sets[k] for k in q])
    every = label = np.arange(len(sets))
    for k in range(0, len(p), 64):  # thresholds in double precision, a strip at a time
        strip = both[k : k + 64].astype(float)
        i, j = np.nonzero(strip >= similarity * (n[p[k : k + 64]][:, None] + n[q] - strip) - EPS)
        label = local_components(len(sets), np.concatenate([every, p[k + i]]), np.concatenate([label, q[j]]))
    apart = names != names[label]
    return pd.DataFrame({"v": names[apart], "root": names[label][apart]})


def exact_edges(loose: DataFrame, named: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (v, root) that connect what is similar enough inside each group of candidates (v, component).

    Only the texts of candidates are read again, one per set. Groups of up to BLOCK sets are dealt to
    tasks together; a larger one is cut into blocks by hash, and each set goes once to each pair of
    blocks that it is in. A task reports a spanning forest, never pairs.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"v": [set_key(s) for s in sets], "items": [s.tobytes() for s in sets]})

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in cell.groupby("component"):
            sets = [np.frombuffer(x, np.uint64) for x in group["items"]]
            two = group["i"].iloc[0] != group["j"].iloc[0]
            side = (group["b"] == group["j"]).to_numpy() if two else None
            found.append(_links(group["v"].to_numpy(), sets, side, similarity))
        return pd.concat(found)

    sizes = loose.groupBy("component").count()
    members = cut_lineage(loose.join(sizes, "component").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")))
    small = members.where("blocks = 1").count()
    bins = max(1, small // BLOCK)
    ids = cut_lineage(named.join(members.select("v"), "v").groupBy("v").agg(F.min("id").alias("id")).select("id").distinct())
    wanted = beside(texts, ids, "id", "left_semi", 8).select("text")
    sets = wanted.mapInArrow(load, "v long, items binary").groupBy("v").agg(F.min("items").alias("items"))
    of = sets.join(members, "v").withColumn("b", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    of = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    alone = F.col("blocks") == 1
    of = of.select(
        "v",
        "component",
        "items",
        "b",
        F.least("b", "other").alias("i"),
        F.greatest("b", "other").alias("j"),
        alone.alias("alone"),
        F.when(alone, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("cell"),
    )
    out = cut_lineage(of.groupBy("alone", "cell", "i", "j").applyInPandas(compare, "v long, root long"))
    release(members, ids)
    return out


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """One row per document that has an id: id, component_id (the smallest id of its group).

    Texts are linked if the Jaccard similarity of their sets of word shingles (compared by 64-bit
    hashes) is ``similarity`` or more. One pass over the texts names their sets and describes them by a
    SimHash fingerprint and the bands of a MinHash signature; equal sets are one point. Sets with near
    fingerprints (a vantage-point tree, ``REACH`` bits) or a band in common are candidates and form
    loose groups, inside which all similarities are computed exactly from the whole sets: no pair is
    linked that is not similar enough, and one at 0.8 is missed with probability 8e-6, above it less.
    The fingerprints alone do not suffice: sets at 0.8 differ in some 10 of 64 bits, where random ones
    differ in 32 give or take 4, too little apart for a tree to prune.

    Null and empty texts and texts without words have the empty set and are equal. A text of fewer
    than ``shingle`` words is one shingle. Repeated rows are one point; rows that share an id but not
    their text link whatever their texts link with; rows with a null id are left out; a very long text
    is one set in its task (8 bytes a word); other columns, also of clashing names, are ignored; an
    empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    named = cut_lineage(described(texts, shingle))
    edges, points = candidate_edges(named)
    loose = connected_components(edges, "v", "w").withColumnRenamed("node", "v")
    links = exact_edges(loose, named, texts, shingle, similarity)
    group = connected_components(links, "v", "root").withColumnRenamed("node", "v")
    # Rows of one id are one document, whatever its texts.
    of = cut_lineage(named.join(group, "v", "left").select("id", F.coalesce("component", "v").alias("c")).distinct())
    release(named, points, loose, links)
    return of.join(of.groupBy("c").agg(F.min("id").alias("component_id")), "c").select(F.col("id").alias(id_col), "component_id")
