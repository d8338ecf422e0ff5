"""Near-duplicate vectors and texts and repeated passages against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from starfold.llm import embedding_dedup, jaccard_dedup, simhash_dedup, substring_dedup
from starfold.llm.catalog import QUERIES
from starfold.llm.common import local_components
from starfold.llm.components import connected_components
from tests.check import DATA, connect

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_reachable(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    random.seed(1)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(1000, k) for k in range(1001, 1200)]
    pairs = chain + star + [(5, 5), (7, 3), (3, 9)] + [(random.randrange(2000, 2300), random.randrange(2000, 2300)) for _ in range(200)]
    edges = spark.createDataFrame([*pairs, (None, 4)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    pairs = [(a, b) for a, b in pairs if a != b]
    assert got == smallest_reachable({x for p in pairs for x in p}, pairs)
    assert connected_components(edges.where("false"), "a", "b").count() == 0


def test_local_components():
    i, j = np.array([0, 2, 5, 4]), np.array([1, 1, 4, 3])
    assert local_components(7, i, j).tolist() == [0, 0, 0, 3, 3, 3, 6]


def brute_links(rows, threshold):
    ok = [(i, np.array(v, float) / max(map(abs, v))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n_links = dict.fromkeys([i for i, _ in rows], 0)
    pairs = []
    for k, (a, x) in enumerate(ok):
        for b, y in ok[:k]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n_links[a] += 1
                n_links[b] += 1
                pairs.append((a, b))
    return n_links, smallest_reachable(list(n_links), pairs)


def test_vectors_as_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    near = [b + 0.05 * rng.standard_normal(16) for b in base[:20] for _ in range(4)]
    hot = [base[0] + 0.02 * rng.standard_normal(16) for _ in range(300)]
    rows = [(int(k), v.tolist()) for k, v in enumerate([*base, *near, *hot])]
    rows += [(9000 + k, rows[5][1]) for k in range(5)]
    rows += [(9100, None), (9101, []), (9102, [0.0] * 16), (9103, [float("nan")] * 16), (9104, [1.0, None]), (9105, [1.0, 2.0]), (9106, [2.0, 4.0]), (9107, [1e308] * 16), (9108, [1e-300] * 16), (9109, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("x", "kept")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    links, comp = brute_links(rows, 0.95)
    assert {k: r.component_id for k, r in got.items()} == comp
    assert {k: r.n_links for k, r in got.items()} == links
    assert all(r.kept == (k == r.component_id) for k, r in got.items())
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(5)
    rows = [(k, (np.ones(8) + 0.05 * rng.standard_normal(8)).tolist()) for k in range(150)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_links(rows, 0.95)[0]


def test_null_ids_link_with_nothing(spark):
    df = spark.createDataFrame([(None, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or -1, r.n_links, r.kept) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [(-1, 0, True), (2, 1, True), (2, 1, True)]


def slow_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \x0b\x0c", "a", "A b", "ÄÖ x\x1cy z", "a b c d e É", "w " * 500])
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text) == slow_fingerprint(text)


def test_near_pairs_are_complete():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**63, 300, dtype=np.uint64)
    points = np.unique(np.concatenate([seeds, *[seeds ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a, b in ((3, 9), (40, 3), (9, 9), (63, 0))]]))
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if int(points[i] ^ points[j]).bit_count() <= 2}
    got = {tuple(sorted(map(int, p))) for i, j in simhash_dedup.near_pairs(points, 2) for p in zip(i, j)}
    assert got == want
    tree = simhash_dedup.VantageTree(points, 40, 2, 0)
    assert tree.shards > 8
    at = [set() for _ in points]
    for shard, rows in tree.route(points):
        for r in rows:
            at[r].add(shard)
    assert all(at[i] & at[j] for i, j in want)


def test_dense_points_that_no_radius_thins_out():
    points = np.array([(1 << a) | (1 << b) for a in range(45) for b in range(a)], dtype=np.uint64)
    want = sum(int(points[i] ^ points[j]).bit_count() <= 2 for i in range(len(points)) for j in range(i))
    assert len({tuple(sorted(map(int, p))) for i, j in simhash_dedup.near_pairs(points, 2) for p in zip(i, j)}) == want


def test_groups_as_brute_force(spark):
    docs = connect("sf0.01").sql("SELECT doc_id, text FROM documents").fetchall()
    fp = {d: slow_fingerprint(t) for d, t in docs}
    ids = list(fp)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= 2]
    want = smallest_reachable(ids, pairs)
    got = QUERIES["op3_simhash_dedup"](spark, str(DATA / "sf0.01")).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {d: (fp[d], want[d]) for d in ids}


def test_odd_texts_have_groups(odd_docs, empty_docs):
    got = simhash_dedup.simhash_groups(odd_docs).collect()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert len(got) == odd_docs.count()
    assert of[1] == of[2] == of[3] == [("0" * 16, 1)]
    assert len(of[4]) == 2 and {c for _, c in of[4]} == {4} and of[9][0] == of[10][0]
    assert sorted(c for _, c in of[None]) == [1, 6]
    kept = simhash_dedup.first_of_groups(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns and ids.count(4) == 1 and ids.count(None) == 2 and 10 not in ids
    assert simhash_dedup.simhash_groups(empty_docs).count() == simhash_dedup.first_of_groups(empty_docs).count() == 0


def jaccard_components(docs):
    """Smallest id of each group of texts with a 5-word Jaccard similarity of 0.8 or more."""
    sets = {}
    for d, t in docs:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return smallest_reachable(list(sets), pairs)


@pytest.mark.parametrize(("block", "broadcast"), [(1024, 1 << 25), (3, 0)])
def test_stage_drops_every_near_copy(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(jaccard_dedup, "BLOCK", block)
    monkeypatch.setattr("starfold.llm.common.BROADCAST_BYTES", broadcast)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    docs, d = [(0, None), (1, " "), (2, "A b"), (3, "a B"), (4, "a b c")], 10
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(20, 150))] + passage * rng.randrange(2)
        for _ in range(rng.randrange(1, 10)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            docs.append((d, " ".join(w)))
            d += 1
    # Exactly at the threshold (8 of 10 shingles) and just below it (7 of 9).
    docs += [(900, "a b c d e f g h i j k l m"), (901, "a b c d e f g h i j k l x y"), (902, "q r s t u v w x y z A1 A2"), (903, "q r s t u v w x y z A1 A3 A4")]
    w = [f"z{k}" for k in range(14)]
    docs += [(910, " ".join(w)), (911, " ".join(w[:12])), (912, " ".join(w[2:]))]
    rng.shuffle(docs)
    want = jaccard_components(docs)
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))
    assert {r.doc_id: r.component_id for r in jaccard_dedup.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want
    assert len(set(want.values())) < len(docs) / 1.3


def test_stage_on_documents_as_brute_force(spark):
    docs = connect("sf0.01").sql("SELECT doc_id, text FROM documents").fetchall()
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet")), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(jaccard_components(docs).values()))


def without_repeats(docs):
    first, out = {}, {}
    for d, t in sorted(docs):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                gone[i : i + 50] = [True] * 50
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, y in zip(w, gone) if not y).encode()).hexdigest())
    return out


def test_passages_as_brute_force(spark):
    want = without_repeats(connect("sf0.01").sql("SELECT doc_id, text FROM documents").fetchall())
    got = QUERIES["op7_substring_dedup"](spark, str(DATA / "sf0.01")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_made_up_passages(spark, monkeypatch, limit):
    monkeypatch.setattr("starfold.llm.common.BROADCAST_BYTES", limit)
    monkeypatch.setattr(substring_dedup, "SHARD_PHRASES", 5)
    monkeypatch.setattr(substring_dedup, "SHARD_DOCS", 3)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(40)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a = rng.randrange(0, 20)
            w += s[a : len(s) - rng.randrange(0, 10)] + [word() for _ in range(rng.randrange(0, 5))]
        docs.append((d, " ".join(w)))
    docs += [(100, "x " * 300), (101, "x " * 120), (102, docs[30][1]), (103, "y " * 49), (104, "y " * 49), (105, "p q " * 100), (106, "p q " * 60 + "z"), (107, "u v w " * 30 + "p q " * 40)]
    rows = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in rows}
    assert got == without_repeats(docs)
    assert any(r[1] for r in got.values())


def test_odd_texts_lose_their_repeats(odd_docs, empty_docs):
    got = {}
    for r in substring_dedup.remove_repeats(odd_docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got[1] == got[2] == got[3] == [(0, 0)] and got[4] == [(200_000, 0)] * 2
    assert got[11] == [(200_001, 200_000)] and got[9] == got[10] == [(30, 0)]
    assert substring_dedup.remove_repeats(empty_docs).count() == 0


def test_links_of_a_large_group_of_near_copies_hold_few_pairs_and_elements():
    """2048 near copies are linked without all their pairs, or all their elements' places, at once."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.append(base, rng.integers(0, 1 << 63, 5).astype(np.uint64))) for _ in range(2048)]
    names = rng.permutation(2048).astype(np.int64)
    for side in (None, names % 2 == 0):
        tracemalloc.start()
        forest = jaccard_dedup._links(names, sets, side, 0.8)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sorted(forest["v"]) == list(range(1, 2048)) and set(forest["root"]) == {0}
        assert peak < 60e6


def test_overlaps_by_ranges_of_hashes_are_whole(monkeypatch):
    monkeypatch.setattr(jaccard_dedup, "ELEMENTS", 100)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 80, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, k, replace=False)) for k in rng.integers(0, 80, 40)] + [np.zeros(0, np.uint64)]
    expected = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    assert (jaccard_dedup.overlaps(sets[:15], sets[15:]) == expected[:15, 15:]).all()
    got = jaccard_dedup.overlaps(sets)
    off = ~np.eye(len(sets), dtype=bool)
    assert (got == expected)[off].all()


def test_phrases_keep_no_words_of_earlier_texts():
    """Words are hashed where they stand: no vocabulary grows with the texts of a task."""

    class Rows:
        def mapInPandas(self, run, schema):
            return run

    run = substring_dedup._phrases(Rows())
    batch = lambda k: pd.DataFrame({"doc_id": [k], "text": [" ".join(f"w{k}x{i}" for i in range(20_000))]})
    list(run(iter([batch(0)])))  # powers of the multipliers are kept
    tracemalloc.start()
    rows = run(map(batch, range(1, 5)))
    sizes = [len(next(rows)) for _ in range(4)]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert min(sizes) > 1000 and held < 4e6
    words = "a \u00e9\u00e8 b".encode().split()
    assert substring_dedup.word_hashes(words).tolist() == [xxhash.xxh64_intdigest(w) for w in words]
