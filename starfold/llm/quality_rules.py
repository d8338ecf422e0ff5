"""Quality rules as a bitmask ledger: measured once, judged by versioned policies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import table

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW = 5

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "longest_word",
)


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one whole text; all 0 for a null or empty one.

    n_lines counts lines with a word, n_dup_lines those equal to an earlier one, n_repeat_words the
    words in windows of five that occur twice or more; n_upper and n_lower count A-Z and a-z.
    """
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode()
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        starts = np.fromiter((seen[x] > 1 for x in windows), bool, len(windows))
        covered = np.zeros(len(words), dtype=bool)
        for k in range(WINDOW):
            covered[k : k + len(starts)] |= starts
        repeated = int(covered.sum())
    letters = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        int(letters[65:91].sum()),
        int(letters[97:123].sum()),
        max(map(len, words), default=0),
    )


def _share(a: str, b: str, most: float) -> Column:
    return F.col(a) > most * F.col(b)


#: Every rule by its bit; a set bit is a failure. Bits are never reused, so stored ledgers stay valid.
RULES: dict[str, Column] = {}


def _rules() -> dict[str, Column]:
    if not RULES:
        RULES.update(
            {
                "few_words": F.col("n_words") < 10,
                "repeated_windows": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
                "many_symbols": _share("n_symbols", "n_words", 0.25),
                "duplicate_lines": _share("n_dup_lines", "n_lines", 0.3),
                "upper_case": 10 * F.col("n_upper") > 6 * (F.col("n_upper") + F.col("n_lower")),
                "short_words": F.col("word_chars") < 2 * F.col("n_words"),
                "long_words": F.col("word_chars") > 15 * F.col("n_words"),
                "huge_word": F.col("longest_word") > 1000,
            }
        )
    return RULES


#: Rules that reject, by policy version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "upper_case", "short_words", "long_words"),
}


def bit(rule: str) -> int:
    return 1 << list(_rules()).index(rule)


def policy_mask(rules: tuple[str, ...]) -> int:
    return sum(map(bit, rules))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, every measure (long) and ``failed``, the bits of the rules it fails.

    All rules are evaluated, whatever a policy later asks for; nothing is shuffled. Null and empty
    texts measure 0 everywhere and so fail only ``few_words``. Repeated rows and null ids get a row
    each; an empty table gives none. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.array([measure(t) for t in b["text"]], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pd.DataFrame({"id": b["id"], **{c: m[:, k] for k, c in enumerate(MEASURES)}})

    # Ids pass through pandas as text, which a null does not turn into floating point.
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"))
    measured = rows.mapInPandas(run, "id string, " + ", ".join(f"{c} long" for c in MEASURES))
    failed = sum((F.when(c, F.lit(bit(r))).otherwise(F.lit(0)) for r, c in _rules().items()), F.lit(0))
    return measured.select(F.col("id").cast("long").alias(id_col), *MEASURES, failed.cast("long").alias("failed"))


def apply_policy(entries: DataFrame, rules: tuple[str, ...], out: str = "kept") -> DataFrame:
    """Add the verdict of a policy to ledger rows: true if none of its bits is set."""
    return entries.withColumn(out, F.col("failed").bitwiseAND(F.lit(policy_mask(rules))) == 0)


def ablations(entries: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """(policy, rule, rejected, by_rule, only_by_rule, kept_without) for every rule of every policy.

    The ledger is first reduced to a count per distinct bit pattern (at most 2 ** rules rows), so any
    number of policies costs one aggregation of the corpus.
    """
    masks = [(p, r, policy_mask(rules), bit(r)) for p, rules in policies.items() for r in rules]
    asked = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("mask"), F.lit(b).alias("bit"))
                for p, r, m, b in masks
            ]
        )
    )
    patterns = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n")).withColumn("a", asked).select("failed", "n", "a.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    other = F.col("failed").bitwiseAND(F.col("mask") - F.col("bit"))

    def count(c: Column, name: str) -> Column:
        return F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)

    return patterns.groupBy("policy", "rule").agg(
        count(hit != 0, "rejected"),
        count(F.col("failed").bitwiseAND(F.col("bit")) != 0, "by_rule"),
        count(hit == F.col("bit"), "only_by_rule"),
        count(other == 0, "kept_without"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(table(spark, sf_dir, "documents"))
    base = apply_policy(entries, POLICIES["base"], "base_kept")
    judged = apply_policy(base, POLICIES["v1"]).withColumn("base_failed", ~F.col("base_kept"))
    return judged.select("doc_id", *MEASURES[:5], "base_failed", "kept", "failed")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT row_number() OVER () AS r, * FROM d),
i AS (SELECT r, unnest(range(1, len(w) - 3)) AS p, w FROM g WHERE len(w) >= 5),
q AS (SELECT r, p, count(*) OVER (PARTITION BY r, array_to_string(w[p:p + 4], ' ')) AS n FROM i),
c AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest(range(p, p + 5)) AS k FROM q WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         len(regexp_replace(text, '[^A-Z]', '', 'g')) AS u, len(regexp_replace(text, '[^a-z]', '', 'g')) AS l,
         coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0) AS longest
  FROM g LEFT JOIN c USING (r)),
f AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (n_symbols > 0.25 * n_words)::INT
         + 8 * (n_dup_lines > 0.3 * n_lines)::INT + 16 * (10 * u > 6 * (u + l))::INT + 32 * (word_chars < 2 * n_words)::INT
         + 64 * (word_chars > 15 * n_words)::INT + 128 * (longest > 1000)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
       failed & 127 = 0 AS kept, failed FROM f
"""
