"""Near-duplicate texts: SimHash fingerprints, a distributed vantage-point tree, exact pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import beside, local_components, table, whole_row
from starfold.llm.components import connected_components
from starfold.session import cut_lineage

#: Distinct fingerprints a shard of the tree is meant to own; fingerprints the tree is fitted on.
SHARD, SAMPLE = 8192, 1 << 21
#: Below this many fingerprints all pairs are compared at once.
DIRECT = 512


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """64-bit hashes of the word shingles, in order and with repeats; a text with fewer words is one
    shingle, a text without words has none."""
    words = text.encode().lower().split() if text else []  # bytes.lower changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    stops = ends[-n:] if len(words) >= shingle else ends[-1:]
    parts = map(joined.__getitem__, map(slice, starts[:n].tolist(), stops.tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes, repeats counted; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bits unpacked for so many shingles at a time
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats counted; 0 for a text without words."""
    return simhash(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp): one row per document, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "fp": fp})

    # Ids pass through pandas as text, which a null does not turn into floating point.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id string, fp long").withColumn("id", F.col("id").cast("long"))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """Vantage point and radius: inside lies nearer than the radius. Of a few members the one whose
    distances spread most; None if no radius parts the points."""
    best = None
    for v in rng.choice(points, min(8, len(points)), replace=False):
        d = distance(points, v)
        radius = int(np.median(d)) or 1
        inside = int((d < radius).sum())
        if inside == 0:
            radius, inside = radius + 1, int((d < radius + 1).sum())
        if 0 < inside < len(points) and (best is None or d.std() > best[0]):
            best = (d.std(), v, radius)
    return best and (best[1], best[2])


class VantageTree:
    """Vantage-point tree over a sample. Leaves are shards; a fingerprint is sent to its own shard
    and, from the inner side of a boundary within reach of it, to the outer side as well. By the
    triangle bound two fingerprints within reach then share at least one shard: if they lie on two
    sides of a radius, the inner one is less than ``reach`` + 1 away from it."""

    def __init__(self, sample: np.ndarray, leaf: int, reach: int, seed: int):
        rng = np.random.default_rng(seed)
        self.reach, self.nodes, self.shards = reach, [], 0
        # A node is (vantage point, radius, inner child, outer child); a leaf (None, shard, 0, 0).
        todo = [(np.sort(sample), -1, 0)]
        while todo:
            points, parent, side = todo.pop()
            if parent >= 0:
                self.nodes[parent][side] = len(self.nodes)
            found = split(points, rng) if len(points) > leaf else None
            if found is None:
                self.nodes.append([None, self.shards, 0, 0])
                self.shards += 1
                continue
            d = distance(points, found[0])
            self.nodes.append([*found, 0, 0])
            at = len(self.nodes) - 1
            todo += [(points[d >= found[1]], at, 3), (points[d < found[1]], at, 2)]

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, positions of the points that it gets)."""
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            v, radius, inner, outer = self.nodes[at]
            if v is None:
                yield radius, rows
                continue
            d = distance(points[rows], v).astype(np.int64)
            for child, part in ((inner, d < radius), (outer, d >= radius - self.reach)):
                if part.any():
                    todo.append((child, rows[part]))


def near_pairs(points: np.ndarray, reach: int, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions within ``reach``, by a vantage-point tree inside the task; a part that
    no radius thins out is compared in blocks. A pair may come more than once."""
    rng = np.random.default_rng(seed)
    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        p = points[rows]
        found = split(p, rng) if len(rows) > DIRECT else None
        if found is not None:
            d = distance(p, found[0]).astype(np.int64)
            parts = [rows[d < found[1]], rows[d >= found[1] - reach]]
            if max(map(len, parts)) < 0.9 * len(rows):
                todo += parts
                continue
        for a in range(0, len(rows), DIRECT):
            for b in range(a, len(rows), DIRECT):
                near = distance(p[a : a + DIRECT, None], p[None, b : b + DIRECT]) <= reach
                i, j = np.nonzero(np.triu(near, 1) if a == b else near)
                if len(i):
                    yield rows[a + i], rows[b + j]


def _shard_edges(group: pd.DataFrame, reach: int) -> pd.DataFrame:
    group = group.sort_values("rep", ignore_index=True)
    points = group["fp"].to_numpy().view(np.uint64)
    label = np.arange(len(points))
    for i, j in near_pairs(points, reach):
        # Pairs are folded into a forest block by block, so a dense shard never holds all of them.
        known = np.flatnonzero(label != np.arange(len(label)))
        label = local_components(len(points), np.concatenate([known, i]), np.concatenate([label[known], j]))
    rep = group["rep"].to_numpy()
    out = pd.DataFrame({"rep": rep, "root": rep[label]})
    return out[out["rep"] != out["root"]]


def fingerprint_edges(points: DataFrame, reach: int, seed: int = 42) -> DataFrame:
    """Edges (rep, root) that connect all fingerprints within ``reach``, for a stage table (fp, rep) of
    distinct fingerprints: exact and complete, whatever sample the tree is fitted on."""
    n = points.count()
    part = min(1.0, SAMPLE / max(n, 1) / 1.05)
    limit = math.floor(part * (1 << 62))
    sample = (
        points.where((F.xxhash64(F.lit(seed), "fp").bitwiseAND((1 << 62) - 1)) <= limit)
        .select("fp")
        .limit(SAMPLE)
        .toPandas()["fp"]
        .to_numpy(dtype=np.int64)
        .view(np.uint64)
    )
    tree = VantageTree(sample, max(16, math.ceil(SHARD * len(sample) / max(n, 1))), reach, seed)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, rows in tree.route(b["fp"].to_numpy().view(np.uint64)):
                yield b.iloc[rows].assign(shard=shard)

    return cut_lineage(
        points.mapInPandas(routed, "fp long, rep long, shard int")
        .groupBy("shard")
        .applyInPandas(lambda g: _shard_edges(g, reach), "rep long, root long")
    )


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    reach: int = 2,
    seed: int = 42,
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    Texts become fingerprints in the tasks that read them; only (id, fingerprint) is kept. Equal
    fingerprints collapse to their smallest id first, so a group of copies of any size is one point.
    A vantage-point tree fitted on a bounded sample of fingerprints (SAMPLE, picked by hash) cuts the
    space into shards of about SHARD points; every distinct fingerprint goes to its shard and to
    those its ball of radius ``reach`` overlaps. Each shard finds its pairs exactly and reports a
    spanning forest, and distributed components join the forests.

    Links are exact and complete: a pair is linked if and only if ``reach`` or fewer bits differ.
    Null and empty texts and texts without words share fingerprint zero and are linked like others.
    Rows with a null id get a fingerprint and the component of the named rows near it (null if none
    has an equal fingerprint). Rows that share an id are one vertex. Other columns are ignored.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    points = cut_lineage(fps.groupBy("fp").agg(F.min("id").alias("rep")).where("rep IS NOT NULL"))
    edges = fingerprint_edges(points, reach, seed)
    label = connected_components(edges, "rep", "root").withColumnRenamed("node", "rep")
    named = points.join(label, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups_of: Callable[..., DataFrame] = simhash_groups
) -> DataFrame:
    """The documents, all columns, without those that a smaller id of their group stands for.
    ``groups_of`` gives every named document its ``component_id``.

    The ids to drop are joined to the texts; only a list of measured small size is broadcast. Of
    rows that share a kept id one stays. Rows with a null id cannot be told apart by id and stay.
    """
    groups = cut_lineage(groups_of(docs, id_col, text_col).select(F.col(id_col).alias("_id"), "component_id"))
    own = docs.select(whole_row(docs).alias("_row"), F.col(id_col).cast("long").alias("_id"))
    out = beside(own, groups.where("_id <> component_id").select("_id").distinct(), "_id", "left_anti", 16)
    again = cut_lineage(groups.where("_id = component_id").groupBy("_id").count().where("count > 1").select("_id"))
    if not again.isEmpty():
        repeated = beside(out, again, "_id", "left_semi", 16).dropDuplicates(["_id"])
        out = beside(out, again, "_id", "left_anti", 16).unionByName(repeated)
    return out.select("_row.*")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
