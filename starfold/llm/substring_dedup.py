"""Repeated passages: recurring phrases confirmed by hash, located by sharded Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import beside, table, words_of
from starfold.session import cut_lineage, release

#: Words of a window, of a phrase inside it, and phrases that a window holds.
WINDOW, PHRASE = 50, 25
SPREAD = WINDOW - PHRASE
#: Phrases an automaton is meant to hold, and documents that one pass of it takes.
SHARD_PHRASES, SHARD_DOCS = 20_000, 2_000
#: A key with more than this part of a join's rows is met by broadcast; there are fewer such keys.
HOT_KEYS = 4096
#: Odd multipliers of the rolling hashes, and what undoes them modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 2**64) for b in BASES)
MIXER = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; hashing one anew takes less time than looking it up among many."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Rolling:
    """Hashes of any run of words from prefix sums of hash times power, modulo 2**64."""

    _powers: dict[int, np.ndarray] = {}

    @classmethod
    def powers(cls, base: int, n: int) -> np.ndarray:
        known = cls._powers.get(base)
        if known is None or len(known) < n:
            size = 1 << max(12, (n - 1).bit_length())
            step = np.full(size, base & (2**64 - 1), np.uint64)
            step[0] = 1
            known = cls._powers[base] = np.cumprod(step, dtype=np.uint64)
        return known[:n]

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums, self.inverse = [], []
        for b, inverse in zip(BASES, INVERSES):
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(hashes * self.powers(b, n), dtype=np.uint64)]))
            self.inverse.append(self.powers(inverse, n + 1))

    def run(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(64 bits, 32 bits) of the words start .. stop - 1."""
        a, b = ((s[stop] - s[start]) * i[start] for s, i in zip(self.sums, self.inverse))
        return a, (b >> np.uint64(32)).astype(np.uint32)

    def every(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.arange(len(self.sums[0]) - length)
        return self.run(start, start + length)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIXER
    return h ^ (h >> np.uint64(29))


def phrase_places(rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, 64 bits, 32 bits) of the phrases that stand for their windows: of the phrases in a
    window the one with the smallest mixed hash, the first of equals. Equal windows choose alike."""
    a, b = rolling.every(PHRASE)
    near = np.lib.stride_tricks.sliding_window_view(mixed(a), SPREAD + 1)
    at = near.argmin(axis=1) + np.arange(len(near))
    at = at[np.diff(at, prepend=-1) > 0]  # the first smallest never moves back from window to window
    return at, a[at], b[at]


def _signed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return a.view(np.int64), b.view(np.int32)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row in the given order (the last argument) differs from the one before."""
    *columns, order = columns
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return new


def _runs(place: np.ndarray, gap: int, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, first, last): runs of places with equal keys at most ``gap`` apart, and a row of each.

    The gap is so small that what the places reach overlaps or adjoins, so a run stands for exactly
    what its places do. A word or a phrase repeated over and over becomes one row."""
    order = np.lexsort((place, *keys[::-1]))
    p = place[order]
    new = _changes(*keys, order)
    new[1:] |= p[1:] > p[:-1] + gap
    at = np.flatnonzero(new)
    return order[at], p[at].astype(np.int32), p[np.append(at[1:], len(p)) - 1].astype(np.int32)


def _frame(parts: list[dict[str, np.ndarray]], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) if parts else [] for c in columns})


def _phrases(docs: DataFrame) -> DataFrame:
    """(g1, g2, doc_id, pos): the chosen phrases of every document of at least a window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for doc, text in zip(b["doc_id"].to_numpy(), b["text"]):
                words = words_of(text)
                if len(words) >= WINDOW:
                    at, g1, g2 = phrase_places(Rolling(word_hashes(words)))
                    # A phrase that a document repeats, as in a run of one word, is listed once.
                    once = np.flatnonzero(_changes(g1, g2, order := np.lexsort((at, g2, g1))))
                    at, g1, g2 = at[order][once], g1[order][once], g2[order][once]
                    g1, g2 = _signed(g1, g2)
                    parts.append({"g1": g1, "g2": g2, "doc_id": np.full(len(at), doc), "pos": at.astype(np.int32)})
            yield _frame(parts, ["g1", "g2", "doc_id", "pos"])

    return docs.mapInPandas(run, "g1 long, g2 int, doc_id long, pos int")


def _spread_join(rows: DataFrame, side: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``side``, which has one row a key and ``n``, how many of the ``total`` rows it
    meets. Keys with over 1/HOT_KEYS of the rows, fewer than HOT_KEYS of them, are broadcast, so their
    rows stay in the tasks that read them; the rest is shuffled."""
    hot = F.col("n") * HOT_KEYS > total
    many, few = side.where(hot).drop("n"), side.where(~hot).drop("n")
    often = rows.join(F.broadcast(many), keys, how)
    rest = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(few, keys, how)
    return often.unionByName(rest)


def _routed(docs: DataFrame, routes: DataFrame, salts: DataFrame) -> DataFrame:
    """(shard, salt, kind, doc_id, text): phrases (kind 0, to every pass of their shard), then texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shards, kinds, ids, texts = [], [], [], []
            for doc, text, shard, places in zip(b["doc_id"], b["text"], b["shard"], b["places"]):
                words = words_of(text)
                found = {b" ".join(words[p : p + PHRASE]).decode() for p in places}
                shards += [shard] * (len(found) + 1)
                kinds += [0] * len(found) + [1]
                ids += [doc] * (len(found) + 1)
                texts += [*found, text]
            yield pd.DataFrame({"shard": shards, "kind": kinds, "doc_id": ids, "text": texts})

    rows = beside(docs, routes, "doc_id", "inner", 40, "places").select("doc_id", "text", "shard", "places")
    rows = rows.mapInPandas(run, "shard int, kind int, doc_id long, text string").join(salts, "shard")
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    every = F.expr("sequence(0, salts - 1)")
    return rows.select("shard", F.explode(F.when(F.col("kind") == 0, every).otherwise(own)).alias("salt"), "kind", "doc_id", "text")


def _locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every occurrence of a shard's phrases, with a hash of the words around it.

    Rows come sorted by shard and pass, phrases first: those build the automaton, whose symbols are
    numbers of the words that occur in its phrases, and the texts stream through it.
    """
    at_shard, automaton = None, None
    columns = ["g1", "g2", "b1", "b2", "doc_id", "p0", "p1"]
    for batch in batches:
        parts = []
        for shard, salt, kind, doc, text in zip(batch["shard"], batch["salt"], batch["kind"], batch["doc_id"], batch["text"]):
            if (shard, salt) != at_shard:
                at_shard, automaton, vocabulary = (shard, salt), ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE), {}
                built = False
            words = words_of(text)
            if kind == 0:
                automaton.add_word(tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words))
                continue
            if not len(automaton):
                continue
            if not built:
                automaton.make_automaton()
                built = True
            symbols = tuple(map(vocabulary.get, words, repeat(0)))
            p = np.fromiter((end for end, _ in automaton.iter(symbols)), np.int64) - (PHRASE - 1)
            if not len(p):
                continue
            rolling = Rolling(word_hashes(words))
            g1, g2 = _signed(*rolling.run(p, p + PHRASE))
            lo, hi = np.maximum(p - SPREAD, 0), np.minimum(p + WINDOW, len(words))
            b1, b2 = rolling.run(lo, hi)
            # Where the block is cut short by the document's ends is part of its identity.
            b1 = b1 * MIXER + ((p - lo) * 1024 + (hi - lo)).astype(np.uint64)
            b1, b2 = _signed(b1, b2)
            row, p0, p1 = _runs(p, SPREAD + 1, g1, g2, b1, b2)
            parts.append({"g1": g1[row], "g2": g2[row], "b1": b1[row], "b2": b2[row], "doc_id": np.full(len(row), doc), "p0": p0, "p1": p1})
        yield _frame(parts, columns)


def _windows(docs: DataFrame) -> DataFrame:
    """(w1, w2, doc_id, p0, p1): runs of the windows around given places of phrases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for doc, text, places in zip(b["doc_id"], b["text"], b["places"]):
                words = words_of(text)
                edge = np.zeros(len(words) + 2, np.int64)
                np.add.at(edge, [max(0, r["p0"] - SPREAD) for r in places], 1)
                np.add.at(edge, [r["p1"] + 1 for r in places], -1)
                starts = np.flatnonzero(np.cumsum(edge[: max(0, len(words) - WINDOW + 1)]) > 0)
                w1, w2 = _signed(*Rolling(word_hashes(words)).run(starts, starts + WINDOW))
                row, p0, p1 = _runs(starts, WINDOW, w1, w2)
                parts.append({"w1": w1[row], "w2": w2[row], "doc_id": np.full(len(row), doc), "p0": p0, "p1": p1})
            yield _frame(parts, ["w1", "w2", "doc_id", "p0", "p1"])

    return docs.select("doc_id", "text", "places").mapInPandas(run, "w1 long, w2 int, doc_id long, p0 int, p1 int")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, ranges): word ranges of ``docs`` (doc_id, text) that repeat a smaller document's.

    1. Each window chooses one of its phrases; a phrase chosen in two documents recurs. Phrases are
       counted by hash on the map side, so one that a third of all documents share is one row a task.
    2. Recurring phrases are owned by their smallest document. Owners, and with them the phrases, are
       dealt to shards, and a document goes to the shards whose owners it shares a phrase with. A shard
       with many documents is passed several times, each pass with the same automaton.
    3. The automata locate every occurrence exactly. Each comes with a hash of its block: the words
       within a window's reach. A block that a smaller document has too repeats as a whole.
    4. Where the occurrences of a phrase differ in their blocks, one document of each block lists its
       windows, and those found in a smaller document repeat. Two documents with a common window share
       the phrase it chose, so none is missed.
    """
    phrases = cut_lineage(_phrases(docs))
    recurring = phrases.groupBy("g1", "g2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    recurring = cut_lineage(recurring.where("owner < last").drop("last"))
    shards = max(1, -(-recurring.count() // SHARD_PHRASES))
    place = F.when(F.col("doc_id") == F.col("owner"), F.col("pos"))
    routes = cut_lineage(
        _spread_join(phrases, recurring, ["g1", "g2"], phrases.count())
        .groupBy("doc_id", F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int").alias("shard"))
        .agg(F.collect_set(place).alias("places"))
    )
    release(phrases, recurring)
    salts = routes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_DOCS).cast("int").alias("salts"))
    found = cut_lineage(
        _routed(docs, routes, salts)
        .repartition("shard", "salt")
        .sortWithinPartitions("shard", "salt", "kind")
        .mapInPandas(_locate, "g1 long, g2 int, b1 long, b2 int, doc_id long, p0 int, p1 int")
    )
    block, phrase = ["g1", "g2", "b1", "b2"], ["g1", "g2"]
    first = cut_lineage(found.groupBy(*block).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    several = first.groupBy(*phrase).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = found.count()
    found_first = _spread_join(found, first, block, total)
    whole = found_first.where("first < doc_id").select(
        "doc_id", F.greatest(F.col("p0") - SPREAD, F.lit(0)).alias("a"), (F.col("p1") + WINDOW).alias("b")
    )
    # The first document of a block may hold it at several places.
    unclear = _spread_join(found_first.where("first = doc_id"), several, phrase, total, "left_semi")
    places = cut_lineage(unclear.groupBy("doc_id").agg(F.collect_set(F.struct("p0", "p1")).alias("places")))
    windows = cut_lineage(_windows(beside(docs, places, "doc_id", "inner", 32, "places")))
    earliest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    single = (
        _spread_join(windows, earliest, ["w1", "w2"], windows.count())
        .where("first < doc_id")
        .select("doc_id", F.col("p0").alias("a"), (F.col("p1") + WINDOW).alias("b"))
    )
    out = whole.unionByName(single).groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    out = cut_lineage(out)
    release(routes, found, first, places, windows)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (words joined by one space).

    Copies of a whole text are settled by a hash of it first: all but the one with the smallest id
    lose all their words if they have a window, and only that one takes part in the search.

    Windows are judged on the input. Null and empty texts and texts shorter than a window lose
    nothing. Rows with a null id are neither searched nor compared with. Ids are taken to name one
    text; rows that repeat id and text are treated alike, never as copies of each other. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    named = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = cut_lineage(named.select("doc_id", *keys))
    lowest = texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = texts.join(lowest.where("first < last"), ["t1", "t2"]).where("first < doc_id").select("doc_id").distinct()
    copies = cut_lineage(copies)
    ranges = repeated_ranges(beside(named, copies, "doc_id", "left_anti", 16))
    lost = ranges.withColumn("copy", F.lit(False)).unionByName(
        copies.select("doc_id", F.array().cast(ranges.schema["ranges"].dataType).alias("ranges"), F.lit(True).alias("copy"))
    )
    # A document with two texts may be in both lists.
    lost = cut_lineage(lost.groupBy("doc_id").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.max("copy").alias("copy")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, a, z, copy in zip(b["text"], b["a"], b["z"], b["copy"]):
                words = words_of(text)
                n = len(words)
                if copy and n >= WINDOW:
                    words = []
                elif a is not None and len(a):
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.minimum(a, n), 1)
                    np.add.at(edge, np.minimum(z, n), -1)
                    words = [w for w, gone in zip(words, np.cumsum(edge[:n]) > 0) if not gone]
                out.append((n, n - len(words), b" ".join(words).decode()))
            yield pd.DataFrame({"id": b["id"], **dict(zip(("n_words", "n_removed", "kept_text"), zip(*out)))} if out else {"id": [], "n_words": [], "n_removed": [], "kept_text": []})

    joined = beside(rows, lost, "doc_id", "left", 48, "ranges").select(
        # Ids pass through pandas as text, which a null does not turn into floating point.
        F.col("doc_id").cast("string").alias("id"),
        "text",
        F.col("ranges.a").alias("a"),
        F.col("ranges.b").alias("z"),
        F.coalesce("copy", F.lit(False)).alias("copy"),
    )
    out = joined.mapInPandas(run, "id string, n_words long, n_removed long, kept_text string")
    return out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
