"""Rules, classifier, personal data and URL rules."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.llm import boosting, pii, quality_classifier, quality_rules, url_filter
from starfold.llm.catalog import QUERIES, SQL
from tests.check import DATA, connect, diff


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    got = QUERIES[name](spark, str(DATA / "sf0.01")).toPandas()
    assert diff(got, connect("sf0.01").sql(SQL[name]).df()) is None


@pytest.mark.parametrize(
    "text, words, chars, symbols, dup, repeat",
    [
        (None, 0, 0, 0, 0, 0),
        ("", 0, 0, 0, 0, 0),
        ("a b\n\na b\n \n#é", 5, 6, 1, 1, 0),
        ("a b c d e x a b c d e", 11, 11, 0, 0, 10),
        ("a a a a a a", 6, 6, 0, 0, 6),
        ("a\x1cb\x85c\u00a0d", 1, 7, 0, 0, 0),
    ],
)
def test_measures(text, words, chars, symbols, dup, repeat):
    assert quality_rules.measure(text)[:5] == (words, chars, symbols, dup, repeat)


def test_ablations_count_what_each_rule_does(odd_docs):
    entries = quality_rules.ledger(odd_docs)
    assert entries.count() == odd_docs.count()
    rows = entries.select("failed").collect()
    for r in quality_rules.ablations(entries).collect():
        rules = quality_rules.POLICIES[r.policy]
        mask, bit = quality_rules.policy_mask(rules), quality_rules.bit(r.rule)
        assert r.rejected == sum(x.failed & mask != 0 for x in rows)
        assert r.only_by_rule == sum(x.failed & mask == bit for x in rows)
        assert r.kept_without == sum(x.failed & (mask - bit) == 0 for x in rows)
        assert r.by_rule == sum(x.failed & bit != 0 for x in rows)
    assert quality_rules.ledger(odd_docs.where("false")).count() == 0


def test_rules_keep_good_documents(spark):
    sf = str(DATA / "sf0.1")
    kept = QUERIES["op4_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    kept = kept.where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r.quality: r.share for r in kept.collect()}
    assert share[1] > 0.98 and share[0] < 0.4


def test_held_out_accuracy(spark):
    sf = str(DATA / "sf0.1")
    got = QUERIES["op10_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = got.where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    order = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None]).mean()
    assert order > 0.95 and (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.7


def test_classifier_on_odd_texts(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(4, 1), (9, 0), (9, 1), (None, 1), (5, None), (77, 0)], "doc_id long, quality int")
    model = quality_classifier.fit(odd_docs, labels)
    rows = quality_classifier.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    kept = quality_classifier.keep_good(odd_docs, labels.where("false"))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert quality_classifier.score(empty_docs, model).count() == 0


def test_calibration_survives_separable_classes():
    m = np.array([[-0.2, -0.1, -0.3, 0.4]] * 20 + [[0.2, 0.3, 0.1, 0.4]] * 20)
    w = np.array(quality_classifier._calibrate(m, np.array([1.0] * 20 + [0.0] * 20)))
    p = 1 / (1 + np.exp(-quality_classifier._design(m) @ w))
    assert np.isfinite(w).all() and p[:20].min() > 0.8 and p[20:].max() < 0.2


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    v = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {
        "email": True,
        "ip": kind != "ip" or all(int(x) <= 255 for x in hit.split(".")),
        "card": 14 <= len(digits) <= 19 and luhn(digits),
        "phone": 10 <= len(digits) <= 15,
    }[kind]


def base_spans(text):
    found = [
        (m.start(), n, m.end())
        for n, (k, p) in enumerate(PATTERNS.items())
        for m in re.finditer(p, text or "")
        if valid(k, m.group())
    ]
    return ",".join(f"{list(PATTERNS)[n]}:{a}:{b}" for a, n, b in sorted(found))


HARD = [
    None, "", "a@b.c%d@e.f x@@y.z a.b@c-.d..e a@b@c.d", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0255 1.2.3", "x\x01y@z.w \x02 é@é.fr peña@x.es",
    "4111 1111 1111 1111-5 4111111111111111 +49 (0)30 123456 +1+2 345 678 9012 +1 ( ) 2", "1 " * 3000, "9" * 3000, "a" * 3000 + "@b.c",
    "u@h.io " * 600, "+1 " + " " * 3000, "1.1.1.1 " * 700, "𝔘 a@b.cd 😀 10.0.0.1", "a@b.cd" * 40, "4111111111111111" * 2,
]


def test_base_spans_of_hard_texts(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r.doc_id: r.b for r in pii.find(df).select("doc_id", pii.joined("base").alias("b")).collect()}
    assert got == {k: base_spans(t) for k, t in enumerate(HARD)}


def test_very_long_texts_take_linear_time(spark):
    rows = [(1, "9" * 300_000), (2, "a" * 300_000), (3, "1.1.1.1 " * 20_000), (4, "1 " * 100_000)]
    got = {r.doc_id: r.n for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "size(base) AS n").collect()}
    assert got == {1: 0, 2: 0, 3: 20_000, 4: 0}


def test_spans_of_the_tables(spark):
    docs = dict(connect("sf0.1").sql("SELECT doc_id, text FROM documents").fetchall())
    got = QUERIES["op5_pii"](spark, str(DATA / "sf0.1")).collect()
    assert len(got) == len(docs)
    added = []
    for r in got:
        base = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(filter(None, base.split(","))) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), list(PATTERNS).index(s.split(":")[0])))
        added += [(docs[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])], s.split(":")[0]) for s in spans if s not in base.split(",")]
    # What the model adds are numbers that the base pattern runs together with a neighbour.
    assert added and all(valid(k, hit) for hit, k in added)


def test_redaction(spark, odd_docs, empty_docs):
    out = pii.redact(odd_docs)
    assert out.columns == odd_docs.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[7] == "é 𝔘 ß mail [email] [ip]" and rows[1] is None and rows[2] == "" and rows[5] == "One two.\x01 three\x02"
    assert pii.redact(empty_docs).count() == pii.find(empty_docs).count() == 0


def test_boosting_learns_an_interaction():
    # Positive only where both features are set; greedy splits need one of them to help on its own.
    cells = [((a, b), 40.0 * (a and b), 40.0 * (not (a and b))) for a in (0, 1) for b in (0, 1)] + [((2, 0), 1.0, 30.0)]
    model = boosting.boost(cells)
    assert model.score((1, 1)) > 1 > -1 > max(model.score((0, 1)), model.score((1, 0)))
    cut = boosting.threshold(model, cells, 0.95)
    assert model.score((0, 1)) < cut <= model.score((1, 1))
    assert boosting.threshold(model, [((0, 0), 3.0, 9.0)], 0.95) == float("inf")
    assert boosting.boost([]).score((0,)) == -5


def test_url_trie_and_joins_agree(spark):
    urls = [
        None, "", "no scheme", "http://", "http://example.org", "HTTP://A.EXAMPLE.ORG/es/x?y#z", "ftp://example.org/en/1", "x://example.org/en/10/2",
        "x://example.org/en/2", "x://org/", "x://borg/", "x://a.com/fr/", "x://a.com/de/?q", "x://com/de", "x://a..com/fr/x", "x://u@a.com:80/fr/",
        "x://example.org/es//", "x://example.org//es/", "a://b.com://org/",
    ]
    rules = [*url_filter.RULES, ("allow", "example.org", "/es/ok/"), ("block", "org", "/")]
    df = spark.createDataFrame([*enumerate(urls), (None, urls[5]), (5, urls[5])], "page_id long, url string").withColumn("rule", F.lit("own"))
    by_trie = sorted(map(str, url_filter.judge(df, rules).collect()))
    assert by_trie == sorted(map(str, url_filter.judge(df, rules, max_bytes=0).collect())) and len(by_trie) == df.count()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[4] == ("example.org", "", None, "allow") and got[5] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[7][2:] == ("example.org/en/1", "block") and got[8][2:] == ("org/", "allow") and got[10][2] is None
    assert got[13][2] is None and got[12][2:] == ("com/de/", "block")
    assert url_filter.judge(df.where("false"), rules).count() == 0


def test_trie_memory_is_bounded():
    """The bound that decides on the broadcast is above what the trie takes."""
    import random
    import tracemalloc

    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    for rules in (
        [("block", f"{word(8)}.{word(3)}", "/") for _ in range(5000)],
        [("allow", f"{word(2)}.{word(6)}.com", f"/{word(4)}/{word(9)}/{word(3)}") for _ in range(5000)],
        [("block", f"{word(5)}.net", f"/{word(200)}") for _ in range(2000)],
        [("block", "one.org", f"/{word(rng.randint(1, 40))}") for _ in range(5000)],
    ):
        tracemalloc.start()
        trie = url_filter.RuleTrie(rules)
        taken = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        assert taken <= url_filter.trie_bytes(rules)
        for verdict, host, path in rules[:50]:
            assert trie.match("x." + host, path + "z") is not None
