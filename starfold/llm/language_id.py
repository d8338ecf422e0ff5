"""Languages of texts: candidates by script, letter-gram scores per word, Viterbi with a switching penalty."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import table
from starfold.session import cut_lineage, release

# Letter ranges of Unicode, (first, last) code point.
SCRIPTS = [
    ("basic latin", 0x0041, 0x007A),
    ("latin-1 letters", 0x00AA, 0x00FF),
    ("latin extended", 0x0100, 0x02FF),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0531, 0x058F),
    ("hebrew", 0x0591, 0x05FF),
    ("arabic", 0x0600, 0x08FF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("oriya", 0x0B00, 0x0B7F),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF),
    ("tibetan", 0x0F00, 0x0FFF),
    ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul jamo", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x139F),
    ("khmer", 0x1780, 0x17FF),
    ("mongolian", 0x1800, 0x18AF),
    ("latin extended additional", 0x1E00, 0x1EFF),
    ("greek extended", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han supplement", 0x20000, 0x323AF),
]
#: Code points that can be letters.
TOP = 0x323B0
#: Documents a language is learned from, as expected by hash; languages at most.
FIT_ROWS, MAX_LANGUAGES = 5000, 1000
#: Cells per gram length, and the lengths.
CELLS, GRAMS = 1 << 16, (3, 4)
#: A language uses a script if so many of its letters are of it.
USES = 1e-3
#: What a change of language costs, and how far a language without the word's script is put behind
#: the last candidate, in units of log probability.
SWITCH, OUTSIDE = 12.0, 4.0
#: Code points scored at a time, over the number of languages; code points of texts decoded together.
PIECE, TOGETHER = 1 << 21, 1 << 22
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: letter, part of a word (letters and marks), lower case, script number."""
    kind = [unicodedata.category(chr(c))[0] for c in range(TOP)]
    letter = np.array([k == "L" for k in kind])
    part = letter | np.array([k == "M" for k in kind])
    lower = np.arange(TOP, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    script = np.full(TOP, len(SCRIPTS), dtype=np.int16)
    for k, (_, first, last) in enumerate(SCRIPTS):
        script[first : last + 1] = k
    for a in (letter, part, lower, script):
        a.setflags(write=False)
    return letter, part, lower, script


@dataclass
class Words:
    """The words of some texts, one after the other: runs of letters and marks with a letter."""

    low: np.ndarray  # lower-case code points of all texts, 0 where no word is, with zeros around
    start: np.ndarray  # place of each word in ``low``
    size: np.ndarray
    letters: np.ndarray
    script: np.ndarray  # the highest script number of its letters
    text: np.ndarray  # number of the text
    offset: np.ndarray  # place of each text in ``low``


def words_of(texts: Sequence[str | None]) -> Words:
    letter, part, lower, script = _characters()
    points = np.frombuffer("\0\0".join(["", *[t or "" for t in texts], ""]).encode("utf-32-le"), dtype=np.uint32)
    points = np.where(points < TOP, points, 0)
    inside = part[points]
    low = np.where(inside, lower[points], 0).astype(np.uint64)
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    length = np.array([len(t or "") for t in texts], dtype=np.int64)
    offset = 2 + np.concatenate([[0], np.cumsum(length + 2)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(low, none, none, none, none, none, offset)
    count = np.concatenate([[0], np.cumsum(letter[points])])
    letters = count[start + size] - count[start]
    top = np.maximum.reduceat(np.where(letter[points], script[points], -1), start)
    # reduceat runs on to the next word; what lies in between is no letter.
    keep = letters > 0
    start, size, letters, top = start[keep], size[keep], letters[keep], top[keep].astype(np.int64)
    return Words(low, start, size, letters, top, np.searchsorted(offset, start, side="right") - 1, offset)


def gram_cells(low: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Cells of the grams that end one behind each place ``at``: the letter with its neighbours, and
    those with the letter before. What lies before a word's start is always 0."""
    n, c, p = low[at + 1], low[at], low[at - 1]
    pp = np.where(p > 0, low[at - 2], 0)
    three = (p * np.uint64(0x9E3779B97F4A7C15) + c) * np.uint64(0xC2B2AE3D27D4EB4F) + n
    four = (three + pp * np.uint64(0x165667B19E3779F9)) * np.uint64(0x27D4EB2F165667C5)
    three = three * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - (CELLS.bit_length() - 1))
    return [(three >> shift).astype(np.int64), CELLS + (four >> shift).astype(np.int64)]


def _places(w: Words, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the code points of words a to b, and where in them each word starts."""
    size = w.size[a:b]
    first = np.cumsum(size) - size
    return np.repeat(w.start[a:b] - first, size) + np.arange(size.sum()), first


def feature_counts(texts: Sequence[str | None]) -> np.ndarray:
    """Counts of gram cells, followed by counts of letters per script."""
    w = words_of(texts)
    out = np.zeros(len(GRAMS) * CELLS + len(SCRIPTS) + 1, np.int64)
    if len(w.start):
        at, _ = _places(w, 0, len(w.start))
        for cells in gram_cells(w.low, at):
            out += np.bincount(cells, minlength=len(out))
        out += np.bincount(len(GRAMS) * CELLS + w.script, weights=w.letters, minlength=len(out)).astype(np.int64)
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Languages (most learned first), log probability per cell and language, and the scripts they use."""

    languages: tuple[str, ...]
    weight: np.ndarray
    uses: np.ndarray

    @staticmethod
    def of(counts: dict[str, np.ndarray]) -> LanguageModel:
        names = sorted(counts, key=lambda k: (-int(counts[k].sum()), k))
        grams = len(GRAMS) * CELLS
        weight = np.zeros((grams, len(names)), np.float32)
        uses = np.zeros((len(SCRIPTS) + 1, len(names)), dtype=bool)
        for k, name in enumerate(names):
            for g in range(len(GRAMS)):
                part = counts[name][g * CELLS : (g + 1) * CELLS] + 0.05
                weight[g * CELLS : (g + 1) * CELLS, k] = np.log(part / part.sum())
            letters = counts[name][grams:]
            uses[:, k] = letters >= np.maximum(USES * letters.sum(), 1)
        return LanguageModel(tuple(names), weight, uses)


def word_scores(w: Words, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(score per word and language, at most 0; whether the word tells anything). A language that does
    not use the word's script is no candidate: it stays behind all that do. If none does, all are alike."""
    n, k = len(w.start), len(model.languages)
    out = np.zeros((n, k), np.float32)
    known = model.uses[w.script]
    ends = np.cumsum(w.size)
    a = 0
    while a < n:
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + PIECE // k, side="right")))
        at, first = _places(w, a, b)
        score = sum(model.weight[cells] for cells in gram_cells(w.low, at))
        out[a:b] = np.add.reduceat(score, first, axis=0)
        a = b
    told = known.any(axis=1)
    lowest = np.where(known, out, np.inf).min(axis=1, initial=np.inf)
    out = np.where(known, out, np.minimum(out, lowest[:, None] - OUTSIDE))
    out -= out.max(axis=1, initial=-np.inf)[:, None]
    out[~told] = 0
    return out, told


def viterbi(score: np.ndarray, offset: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row, for sequences of ``size`` rows from ``offset`` on, all decoded in step:
    the sum of the scores less ``penalty`` for every change is greatest (ties: no change, lowest label)."""
    n, k = score.shape
    label, back = np.zeros(n, np.int16), np.zeros((n, k), np.int16)
    order = np.argsort(-size, kind="stable")
    offset, size = offset[order], size[order]
    active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    own = np.arange(k, dtype=np.int16)
    total = np.zeros((len(size), k))
    for t, m in enumerate(active.tolist()):
        rows, now = offset[:m] + t, total[:m]
        if t:
            best = now.argmax(axis=1)
            other = now[np.arange(m), best] - penalty
            change = other[:, None] > now
            back[rows] = np.where(change, best[:, None], own)
            now = np.where(change, other[:, None], now)
        total[:m] = now + score[rows]
    state = total.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        rows = offset[: active[t]] + t
        label[rows] = state[: len(rows)]
        state[: len(rows)] = back[rows, state[: len(rows)]]
    return label


def spans_of(texts: Sequence[str | None], model: LanguageModel, penalty: float = SWITCH) -> list[list[tuple[int, int, str, int, int]]]:
    """Per text its spans in order: first code point, end, language, letters, and letters of words that
    tell anything. A span goes from its first word to its last; a text without letters has none."""
    out: list[list[tuple[int, int, str, int, int]]] = [[] for _ in texts]
    w = words_of(texts)
    if not len(w.start) or not model.languages:
        return out
    score, told = word_scores(w, model)
    size = np.bincount(w.text, minlength=len(texts))
    label = viterbi(score, np.cumsum(size) - size, size, penalty)
    new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (w.text[1:] != w.text[:-1])]))
    last = np.append(new[1:], len(label)) - 1
    letters, sure = np.add.reduceat(w.letters, new), np.add.reduceat(w.letters * told, new)
    text = w.text[new]
    start = w.start[new] - w.offset[text]
    end = w.start[last] + w.size[last] - w.offset[text]
    for row in zip(text.tolist(), start.tolist(), end.tolist(), label[new].tolist(), letters.tolist(), sure.tolist()):
        out[row[0]].append((row[1], row[2], model.languages[row[3]], row[4], row[5]))
    return out


def main_language(spans: list[tuple[int, int, str, int, int]]) -> tuple[str, float]:
    """The language of most letters (ties: first by name), and its share of them, words that tell
    nothing not counted for it."""
    if not spans:
        return UNKNOWN, 0.0
    letters: dict[str, int] = {}
    sure: dict[str, int] = {}
    for _, _, name, n, told in spans:
        letters[name] = letters.get(name, 0) + n
        sure[name] = sure.get(name, 0) + told
    best = min(letters, key=lambda k: (-letters[k], k))
    return best, sure[best] / sum(letters.values())


def held_out(id_col: str) -> Column:
    """Rows that a model never learns from: crc32 of the id as text leaves 1 if divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from rows with a language, a text and an id that is not held out.

    Of each language about ``rows`` texts are taken by a hash of id and text (so copies of one text
    count once if any do, at any table size) and counted whole, in the tasks that read them. What comes
    to the driver is one number per language and cell: 131,000 a language at most, MAX_LANGUAGES
    languages at most (more raise an error). An empty table gives a model without languages.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    sizes = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return LanguageModel((), np.zeros((len(GRAMS) * CELLS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), dtype=bool))
    limit = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, rows / r["count"]) * (1 << 62))) for r in sizes], "lang string, lim long")
    chosen = known.join(F.broadcast(limit), "lang").where(F.xxhash64("id", "text").bitwiseAND((1 << 62) - 1) <= F.col("lim"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for lang, count in held.items():
                at = np.flatnonzero(count)
                yield pd.DataFrame({"lang": lang, "cell": at, "n": count[at]})

        for b in batches:
            for lang, part in b.groupby("lang")["text"]:
                texts = part.tolist()
                for some in _together(texts):
                    held[lang] = held.get(lang, 0) + feature_counts([texts[i] for i in some])
            if len(held) > 64:
                yield from rows()
                held.clear()
        yield from rows()

    counted = chosen.select("lang", "text").where("text IS NOT NULL").mapInPandas(run, "lang string, cell long, n long")
    found = cut_lineage(counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")))
    table_ = found.toPandas()
    release(found)
    counts = {}
    for lang, part in table_.groupby("lang"):
        counts[lang] = np.zeros(len(GRAMS) * CELLS + len(SCRIPTS) + 1, np.int64)
        counts[lang][part["cell"].to_numpy()] = part["n"].to_numpy()
    return LanguageModel.of(counts)


def _together(texts: Sequence[str | None]) -> Iterator[list[int]]:
    """Numbers of texts to take at a time: about TOGETHER code points."""
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t or "")
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


SPAN = "array<struct<start: long, end: long, lang: string, letters: long, told: long>>"


def label_languages(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH
) -> DataFrame:
    """(id, lang, score, spans) per row: the language of most letters, its share of them (0 to 1), and
    the spans of each language in code points.

    Words are runs of letters and marks. The script ranges of a word's letters narrow its candidates to
    the languages that use them; a word's score in a language is the sum of the log probabilities of
    its letter grams; Viterbi decoding over the words of the whole text chooses the labels, a change of
    language costing ``penalty``. A null or empty text or one without letters is ``und``, score 0, as is
    every text under a model without languages; where no language uses a text's scripts it gets the
    most learned one with score 0. Rows are independent: repeated rows and null ids are labelled like
    others; a very long text takes some 30 bytes a letter in its task; other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for some in _together(texts):
                spans = spans_of([texts[i] for i in some], known.value, penalty)
                found = [main_language(s) for s in spans]
                names = ("start", "end", "lang", "letters", "told")
                yield pd.DataFrame(
                    {
                        "id": b["id"].iloc[some].to_numpy(),
                        "lang": [f[0] for f in found],
                        "score": [f[1] for f in found],
                        "spans": [[dict(zip(names, s)) for s in row] for row in spans],
                    }
                )

    # Ids pass through pandas as text, which a null does not turn into floating point.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, f"id string, lang string, score double, spans {SPAN}")
    return out.select(F.col("id").cast("long").alias(id_col), "lang", "score", "spans")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = label_languages(docs, fit(docs))
    return found.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("lang").alias("lang_pred"), "score", F.size("spans").cast("long").alias("n_spans")
    )
