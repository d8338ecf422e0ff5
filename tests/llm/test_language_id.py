"""Language spans: parts against brute force, the query by held-out accuracy."""

import itertools
import zlib

import numpy as np
import regex
from pyspark.sql import functions as F

from starfold.llm import language_id
from starfold.llm.catalog import QUERIES
from tests.check import DATA, connect

TEXTS = {
    "aa": "takara nimo takara nimo sato nara takara moni sanaro",
    "bb": "wulf stork wulf brunk storm trund wulf krust grund",
    "ru": "мир труд слово дело мир время слово",
}


def model():
    return language_id.LanguageModel.of({k: language_id.feature_counts([v] * 20) for k, v in TEXTS.items()})


def test_words_as_a_pattern():
    texts = [None, "", "a", "Été naïve, x2y ₂ ²", "éa ́ 9", "日本 語", "\U0001d518 ß", "\0a\0", "x" * 70_000 + " y"]
    w = language_id.words_of(texts)
    got = [[] for _ in texts]
    for t, s, n, letters in zip(w.text, w.start, w.size, w.letters):
        got[t].append((int(s - w.offset[t]), int(n), int(letters)))
    for t, found in zip(texts, got):
        runs = [m for m in regex.finditer(r"[\p{L}\p{M}]+", t or "") if regex.search(r"\p{L}", m.group())]
        assert found == [(m.start(), len(m.group()), len(regex.findall(r"\p{L}", m.group()))) for m in runs]


def test_viterbi_as_brute_force():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3):
        size = np.array([0, 1, 5, 3, 0, 6, 2])
        score = -rng.random((size.sum(), k)) * 4
        offset = np.cumsum(size) - size
        label = language_id.viterbi(score, offset, size, 1.5)
        for o, n in zip(offset, size):

            def total(path):
                return sum(score[o + i, s] for i, s in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))

            best = max((total(p) for p in itertools.product(range(k), repeat=int(n))), default=0)
            assert abs(total(tuple(label[o : o + n])) - best) < 1e-9


def test_spans_of_mixed_text():
    a, b, r = TEXTS["aa"], TEXTS["bb"], TEXTS["ru"]
    text = f"  {a}. {b}! {r}"
    spans = language_id.spans_of([text, None, "123 --", a], model())
    assert [(s[2], text[s[0] : s[1]]) for s in spans[0]] == [("aa", a), ("bb", b), ("ru", r)]
    assert spans[1] == spans[2] == []
    assert [s[2] for s in spans[3]] == ["aa"] and language_id.main_language(spans[3]) == ("aa", 1.0)
    # A single foreign word does not pay for two changes; a word of another script is no candidate.
    assert [s[2] for s in language_id.spans_of([f"{a} wulf {a}"], model(), penalty=200)[0]] == ["aa"]
    assert {s[2] for s in language_id.spans_of(["мимо"], model())[0]} == {"ru"}
    # No language uses the script: the most learned one, with score 0.
    assert language_id.main_language(language_id.spans_of(["日本語"], model())[0])[1] == 0


def test_pieces_do_not_change_scores(monkeypatch):
    words = language_id.words_of([" ".join(TEXTS.values())] * 3)
    whole, _ = language_id.word_scores(words, model())
    monkeypatch.setattr(language_id, "PIECE", 20)
    assert np.allclose(language_id.word_scores(words, model())[0], whole)


def test_odd_and_empty_tables(spark, odd_docs, empty_docs):
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") < 6, "x").when(F.col("doc_id") > 8, "y"))
    m = language_id.fit(docs)
    assert set(m.languages) <= {"x", "y"}
    rows = language_id.label_languages(docs, m).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: (r.lang, r.score) for r in rows if r.doc_id in (1, 2, 3)} == {k: ("und", 0.0) for k in (1, 2, 3)}
    assert all(r.lang in m.languages and 0 <= r.score <= 1 for r in rows if r.doc_id and r.doc_id > 3)
    none = language_id.fit(docs.where("false"))
    assert none.languages == () and language_id.label_languages(empty_docs, none).count() == 0
    assert {r.lang for r in language_id.label_languages(odd_docs, none).collect()} == {"und"}


def test_learns_from_no_held_out_row(spark):
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 == 1]
    df = spark.createDataFrame([(k, "secret words", "zz") for k in ids], "doc_id long, text string, lang string")
    assert language_id.fit(df).languages == ()


def test_query_on_held_out_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op13_language_id"](spark, str(DATA / "sf0.01")).collect()}
    rows = connect("sf0.01").sql("SELECT doc_id, lang, text FROM documents").fetchall()
    assert len(got) == len(rows)
    held = [(got[i], lang) for i, lang, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(r.lang_pred == lang for r, lang in held) >= 0.99 * len(held)
    assert all((r.lang_pred == "und") == (not regex.search(r"\p{L}", text or "")) for (i, _, text), r in ((x, got[x[0]]) for x in rows))
