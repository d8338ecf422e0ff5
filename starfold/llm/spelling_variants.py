"""Spelling variants: words one edit apart by pivotal grams, and the frequent form each belongs to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import CRC_SQL, CRC_TABLE_SQL, table
from starfold.session import cut_lineage, release

#: What a word is made of, and what stays of it by the query's contract.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, TYPO_EVERY, TIMES = 5, 3, 97, 2
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 18
#: Characters of a gram; grams of a word's prefix, three at least, so that two are always disjoint.
GRAM, PREFIX = 2, 4
#: What one more character of text beside a pivot is taken to leave of its matches.
THINNING = 0.125


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    typo_every: int | None = None,
) -> DataFrame:
    """(word, n): letter runs of whole texts, A-Z lower-cased, with at least ``min_length`` code points
    and ``min_count`` occurrences. With ``typo_every``, one in so many pairs of document and run loses
    a code point, both picked by the checksum of ``<id>:<run>`` (a null id is empty text).

    Tasks count the runs of about HELD distinct words before they hand them to the aggregate.
    """
    long_run = re.compile(f"[{LETTERS}]{{{min_length},}}")  # greedy: a match is a whole run

    def rows(held: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for id_, text in zip(b["id"], b["text"]):
                words = long_run.findall(text.encode().lower().decode())  # bytes.lower changes A-Z only
                held.update(words)
                if typo_every:
                    start = zlib.crc32(f"{id_}:".encode())
                    typos = {w for w in set(words) if zlib.crc32(w.encode(), start) % typo_every == 0}
                    for word, n in Counter(w for w in words if w in typos).items() if typos else ():
                        at = zlib.crc32(word.encode(), start) % len(word)
                        held[word] -= n
                        held[word[:at] + word[at + 1 :]] += n
                if len(held) > HELD:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counts = texts.where("text IS NOT NULL").mapInPandas(run, "word string, n long").where(F.length("word") >= min_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def prefix_grams(word: str, rank: dict[str, int]) -> tuple[list[int], int]:
    """Positions of the word's gram prefix, and the rank it reaches: its PREFIX rarest grams and every
    other place of the last of them."""
    ranks = [rank[word[i : i + GRAM]] for i in range(len(word) - GRAM + 1)]
    last = sorted(ranks)[min(PREFIX, len(ranks)) - 1]
    return [i for i, r in enumerate(ranks) if r <= last], last


def pivots(word: str, places: list[int], count: dict[str, int]) -> tuple[int, int]:
    """Two disjoint grams out of ``places`` of least expected matches, by dynamic programming from left
    to right: the second pivot follows the best first one that ends before it.

    The first is matched together with the text up to the second, the second with the text from the
    first on; matches are the fewer, the rarer the gram and the longer the text beside it.
    """
    best = (float("inf"), 0, 0)
    for at in places:
        behind = count[word[at : at + GRAM]]
        for first in places:
            if at - first < GRAM:
                break
            cost = count[word[first : first + GRAM]] * THINNING ** (at - first) + behind * THINNING ** (at - first)
            cost *= 1 + THINNING**first + THINNING ** (len(word) - GRAM - at)
            best = min(best, (cost, first, at))
    return best[1], best[2]


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): the pairs a < b of ``words`` (word, n; distinct, at least 5 code points) that
    differ by exactly one inserted, deleted or replaced code point. Exact and complete.

    Pivotal grams (Deng et al. 2014): every word has a prefix of its rarest bigrams and, out of it,
    two disjoint pivots; one edit spoils at most one of them. Of two near words, the one whose prefix
    reaches less far has its surviving pivots in the other's prefix, so pivots are looked up in
    prefixes only. Position limits: an edit behind the second pivot's start leaves the text before it,
    first pivot included, at the same places; one before the first pivot's end leaves the text
    behind it, second pivot included, at the same places from the end; one in between leaves both
    pivots and what lies outside them. A word is therefore listed under the texts that begin at its
    start and hold a prefix gram, those that end at its end and hold one, and the outsides of two
    prefix grams; a pivot pair asks for one of each, in words of the lengths an edit allows. Lists meet
    in an equi-join and candidates are verified in the same stage, never written. The table of
    bigrams (at most the square of the alphabet, 8,100 rows) goes to the tasks by value.
    """
    spark = words.sparkSession
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - (GRAM - 1)), lambda i: F.substring("word", i, F.lit(GRAM))))
    counted = words.select(gram.alias("gram")).groupBy("gram").count().toPandas().sort_values(["count", "gram"])
    count = dict(zip(counted["gram"], counted["count"].tolist()))
    known = spark.sparkContext.broadcast((count, {g: k for k, g in enumerate(count)}))

    def lists(word: str, places: list[int]) -> list[str]:
        n = len(word)
        return (
            [f"{n}<{word[:e]}" for e in range(places[0] + GRAM, n + 1)]
            + [f"{n}>{word[b:]}" for b in range(places[-1] + 1)]
            + [f"{n}<{word[: p + GRAM]}>{word[q:]}" for p in places for q in places if q - p >= GRAM]
        )

    def asked(word: str, first: int, second: int) -> list[str]:
        texts = f"<{word[:second]}", f">{word[first + GRAM :]}", f"<{word[: first + GRAM]}>{word[second:]}"
        return [f"{n}{t}" for n in range(len(word) - 1, len(word) + 2) for t in texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, rank = known.value
        for b in batches:
            keys: list[list[int]] = []
            last, n_ask = [], []
            for word in b["word"]:
                places, reach = prefix_grams(word, rank)
                ask = asked(word, *pivots(word, places, count))
                keys.append([int(np.int64(xxhash.xxh64_intdigest(k) - (1 << 63))) for k in ask + lists(word, places)])
                last.append(reach)
                n_ask.append(len(ask))
            yield pd.DataFrame({"word": b["word"], "n": b["n"], "last": last, "n_ask": n_ask, "keys": keys})

    grams = cut_lineage(words.mapInPandas(run, "word string, n long, last int, n_ask int, keys array<long>"))
    ask = grams.select(F.explode(F.slice("keys", F.lit(1), F.col("n_ask"))).alias("key"), F.col("word").alias("a"), F.col("n").alias("na"), F.col("last").alias("la"))
    held = grams.select(
        F.explode(F.slice("keys", F.col("n_ask") + 1, F.size("keys"))).alias("key"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb")
    )
    near = (F.col("la") <= F.col("lb")) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    found = ask.join(held, "key").where(near)
    swap = F.col("a") > F.col("b")

    def pick(x: str, y: str) -> Column:
        return F.when(swap, F.col(y)).otherwise(F.col(x))

    pairs = found.select(pick("a", "b").alias("a"), pick("na", "nb").alias("na"), pick("b", "a").alias("b"), pick("nb", "na").alias("nb"))
    out = cut_lineage(pairs.distinct())
    release(grams)
    return out


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): where the links word -> form end. Each round doubles the reach of every link, so
    a chain of any length takes the logarithm of its length in rounds. Links must not form a cycle."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut_lineage(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(now)
        now = new.drop("moved")
        now.stage_path = new.stage_path
        if new.where("moved").isEmpty():
            return now


def spelling_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the rows (word, n) of distinct words.

    Words are near if they are one edit apart. A word's form is its near word of largest n (ties: the
    smallest in code-point order) if that n is at least ``times`` its own, which must be 2 or more so
    that chains end; root follows forms to the last one. Null words and words of fewer than MIN_LENGTH
    code points are left out, since two disjoint bigrams need the room; an empty table gives no rows. Other columns are
    ignored. A word with any number of near words is only ever reduced to its best one.
    """
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")).where(F.length("word") >= MIN_LENGTH))
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form")).alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("na")).alias("less"), F.col("a").alias("form")).alias("near"))
    )
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    has = -F.col("near.less") >= times * F.col("n")
    rows = cut_lineage(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("near.form")).alias("form"),
            F.when(has, -F.col("near.less")).alias("form_n"),
        )
    )
    release(words, pairs)
    roots = follow(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int | None = None) -> DataFrame:
    """``spelling_groups`` of the words of all texts. Null and empty texts have no words; rows repeat
    their words; a very long text is one array of runs in the task that reads it; other columns, also
    of clashing names, are ignored; an empty table gives no rows."""
    return spelling_groups(word_counts(docs, id_col, text_col, typo_every=typo_every))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), typo_every=TYPO_EVERY)


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL}, runs AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{{MIN_LENGTH},}}')) AS run
    FROM documents
), counted AS (
    SELECT run, count(*) AS n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b FROM runs GROUP BY doc_id, run
), hashed AS (
    SELECT run, n, {CRC_SQL} AS h FROM counted, crc_table
), words AS (
    SELECT word, sum(n)::BIGINT AS n
    FROM (
        SELECT n, CASE WHEN h % {TYPO_EVERY} = 0
            THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM hashed
    )
    WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
), cut AS (
    SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)
), pairs AS (
    SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
), best AS (
    SELECT p.a AS word, count(*) AS n_near, min({{'less': -w.n, 'form': p.b}}) AS near
    FROM pairs p JOIN words w ON w.word = p.b GROUP BY p.a
), forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
        CASE WHEN -b.near.less >= {TIMES} * w.n THEN b.near.form END AS form,
        CASE WHEN -b.near.less >= {TIMES} * w.n THEN -b.near.less END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
    SELECT word, word AS root FROM forms
    UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM forms f
JOIN (SELECT c.word, c.root FROM chain c JOIN forms e ON e.word = c.root WHERE e.form IS NULL) c ON c.word = f.word
"""
