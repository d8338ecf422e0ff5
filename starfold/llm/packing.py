"""Packing documents into fixed-length sequences: order-preserving dynamic programming over cut places."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import table

LENGTH, END_ID = 2048, 1
#: Tokens that one dynamic program covers; it holds a few numbers per cut place and 4 bytes per id.
BLOCK = 1 << 20
#: What a cut costs, in tokens of padding: between sentences of a document, and inside a sentence.
SENTENCE_CUT, WORD_CUT = 8.0, 64.0
#: A sentence longer than this may also be cut inside, every so many tokens.
LONG_SENTENCE = 512
#: White space runs that only the slower encoder takes.
LONG_SPACE = re.compile(r"\s{10000}")


class ByteBpe:
    """Ids of a byte-level BPE file of ``tokenizers``.

    Ordinary texts go through tiktoken, built from the file's own vocabulary (its ids are the merge
    ranks) and five times as fast. Texts that hold the name of a special token, which ``tokenizers``
    turns into that token's one id, and texts with extreme runs of white space go through
    ``tokenizers`` itself. So all ids are those of its ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        # The alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the other
        # bytes follow from code point 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        special = {t.content for t in self.full.get_added_tokens_decoder().values()}
        vocabulary = {t: i for t, i in self.full.get_vocab().items() if t not in special}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}
        self.special = sorted(special)
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        # Ids that close a sentence.
        self.stops = np.zeros(self.size + len(special) + 1, dtype=bool)
        for t, i in ranks.items():
            self.stops[i] = t.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n")

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if LONG_SPACE.search(text) or any(t in text for t in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def cut_places(ids: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions inside or at the end of one document where a sequence may end, and what each costs."""
    n = len(ids)
    at = np.flatnonzero(stops[ids[: n - 1]]) + 1 if n > 1 else np.zeros(0, np.int64)
    at = at[at < n]
    edges = np.concatenate([[0], at, [n]])
    cost = np.full(len(at), SENTENCE_CUT)
    long = np.flatnonzero(np.diff(edges) > LONG_SENTENCE)
    if len(long):
        inner = np.concatenate([np.arange(edges[k] + LONG_SENTENCE, edges[k + 1], LONG_SENTENCE) for k in long])
        at, cost = np.concatenate([at, inner]), np.concatenate([cost, np.full(len(inner), WORD_CUT)])
        order = np.argsort(at)
        at, cost = at[order], cost[order]
    return np.append(at, n), np.append(cost, 0.0)


def window_cuts(at: list[int], cost: list[float], length: int = LENGTH) -> list[int]:
    """Indices of the chosen cut places, the last included.

    Minimises padding plus the cost of the cuts. A sequence over (at[i], at[j]] is padded to
    ``length`` unless its own length is a power of two. The padded case is
    best[j] = cost[j] + length - at[j] + min(best[i] + at[i]) over the window at[j] - at[i] <= length:
    a sliding minimum, kept in a monotone queue. The powers of two are looked up by position.
    """
    n = len(at)
    position = {0: 0}
    position.update(zip(at, range(1, n + 1)))
    x = [0, *at]
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    find = position.get
    for j in range(1, n + 1):
        here = x[j]
        while x[queue[0][1]] < here - length:
            queue.popleft()
        low, i = queue[0]
        low += length - here
        for p in powers:
            k = find(here - p)
            if k is not None and best[k] < low:
                low, i = best[k], k
        low += cost[j - 1]
        best[j], back[j] = low, i
        key = low + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], n
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


def pack_block(docs: list[tuple], stops: np.ndarray, first_sequence: int, length: int = LENGTH) -> dict[str, list]:
    """Pieces of a run of documents (id, ids, first position, tokens of the whole document)."""
    at, cost, starts, base = [], [], [], 0
    for _, ids, _, _ in docs:
        places, price = cut_places(ids, stops)
        at += (places + base).tolist()
        cost += price.tolist()
        starts.append(base)
        base += len(ids)
    out: dict[str, list] = {c: [] for c in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    begin, d = 0, 0
    for k, c in enumerate(window_cuts(at, cost, length)):
        end, place = at[c], begin
        while place < end:
            doc, ids, first, tokens = docs[d]
            a = place - starts[d]
            b = min(len(ids), end - starts[d])
            out["id"].append(doc)
            out["start"].append(first + a)
            out["length"].append(b - a)
            out["ids_crc32"].append(zlib.crc32(ids[a:b].astype("<u4").tobytes()))
            out["doc_tokens"].append(tokens)
            out["sequence_id"].append(first_sequence + k)
            out["offset"].append(place - begin)
            place = starts[d] + b
            d += b == len(ids)
        begin = end
    return out


def pack(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every task packs the documents it reads, in their order and in blocks of about BLOCK tokens, so
    nothing is shuffled and memory is bounded whatever the size of a partition; a document longer
    than a block runs through several. Each id lies in exactly one piece and sequences hold at most
    LENGTH ids. A sequence never spans two blocks. Its id is the task's partition in the upper bits
    and a running number in the lower 40; a retried task gives the same rows.

    A null or empty text is the single end id. Repeated rows and ties in the id are packed like any
    other row. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer, pattern)
        sequence = TaskContext.get().partitionId() << 40
        block: list[tuple] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal block, held, sequence
            out = pack_block(block, bpe.stops, sequence)
            sequence = out["sequence_id"][-1] + 1
            block, held = [], 0
            return pd.DataFrame(out)

        for b in batches:
            for doc, text in zip(b["id"].tolist(), b["text"].tolist()):
                ids = np.append(bpe.ids(text), np.uint32(END_ID))
                at = 0
                while at < len(ids):
                    part = ids[at : at + BLOCK - held]
                    block.append((doc, part, at, len(ids)))
                    at, held = at + len(part), held + len(part)
                    if held >= BLOCK:
                        yield flush()
        if block:
            yield flush()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run,
        "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
    # Ids pass through pandas as text, which a null does not turn into floating point.
    return rows.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)


def public_byte_bpe() -> tuple[str, str]:
    """(path, pattern) of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *public_byte_bpe())
