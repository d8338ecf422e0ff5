"""Spelling variants against brute force and SQL."""

import random
import re
import zlib
from collections import Counter

from starfold.llm import spelling_variants
from starfold.llm.catalog import QUERIES, SQL
from tests.check import DATA, connect, diff


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_groups(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return rows


def brute_counts(docs, typo_every=None):
    lower = {c: c + 32 for c in range(65, 91)}
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_groups_as_brute_force(spark):
    rng = random.Random(7)
    words = {}
    for letters, size, n in (("ab", 5, 90), ("abé", 7, 300), ("aébcdefg", 6, 400), ("ñ", 9, 1), ("a", 30, 1), ("a", 31, 1)):
        for _ in range(n):
            w = "".join(rng.choice(letters) for _ in range(size + rng.randrange(3) * (n > 1)))
            words[w] = rng.choice([3, 3, 4, 6, 7, 13, 40, 1 << 40])
    for k in range(12):  # a chain of forms
        words["chain" + "z" * (k + 5)] = 1 << (k + 2)
    df = spark.createDataFrame([*words.items(), (None, 5), ("abcd", 9)], "word string, n long")
    assert rows_of(spelling_variants.spelling_groups(df)) == sorted(brute_groups(words), key=str)


def test_prefix_reaches_and_pivots_are_disjoint():
    count = {"ab": 5, "bc": 1, "cd": 9, "de": 2, "ef": 3, "fg": 8}
    rank = {g: k for k, g in enumerate(sorted(count, key=count.get))}
    places, last = spelling_variants.prefix_grams("abcdefg", rank)
    assert places == [0, 1, 3, 4] and last == rank["ab"]
    a, b = spelling_variants.pivots("abcdefg", places, count)
    assert b - a >= 2 and {a, b} <= set(places)
    # All places of the last gram belong to the prefix.
    assert spelling_variants.prefix_grams("aaaaaaa", {"aa": 0})[0] == [0, 1, 2, 3, 4, 5]


def test_counts_and_typos(spark, odd_docs, monkeypatch):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    more = [(k, "Vraiment vraiment VRAIMENT ÉTÉ été étés étés étés x×÷y maisons") for k in range(300)]
    df = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(3)
    for every in (None, 3, 97):
        got = {r.word: r.n for r in spelling_variants.word_counts(df, typo_every=every).collect()}
        assert got == brute_counts(docs + more, every)


def test_odd_and_empty_tables(spark, odd_docs, empty_docs):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert rows_of(spelling_variants.spelling_variants(odd_docs, typo_every=2)) == sorted(brute_groups(brute_counts(docs, 2)), key=str)
    assert spelling_variants.spelling_variants(empty_docs).count() == 0


def test_query_as_brute_force_and_sql(spark):
    got = QUERIES["op11_spelling_variants"](spark, str(DATA / "sf0.001"))
    docs = connect("sf0.001").sql("SELECT doc_id, text FROM documents").fetchall()
    assert rows_of(got) == sorted(brute_groups(brute_counts(docs, 97)), key=str)
    assert diff(got.toPandas(), connect("sf0.001").sql(SQL["op11_spelling_variants"]).df()) is None
