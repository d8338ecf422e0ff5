"""Mixing, sharding, packing and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from starfold.llm import mixing, packing, sharding
from starfold.llm.catalog import QUERIES
from tests.check import DATA, connect

SF = str(DATA / "sf0.01")


def test_mix_meets_its_targets(spark):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").toPandas()
    for _, g in rows.merge(docs, on="doc_id").groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2
        assert g.source_size.iloc[0] == g["size"].sum()


def test_mix_of_odd_documents(odd_docs, empty_docs):
    got = mixing.mix(odd_docs).toPandas()
    assert len(got) == odd_docs.count() and (got.taken <= 2 * got["size"]).all()
    again = mixing.mix(odd_docs.repartition(5)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))
    taken = mixing.mixed_documents(odd_docs)
    assert taken.columns == odd_docs.columns
    assert taken.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == got.taken.sum()
    assert mixing.mix(empty_docs).count() == mixing.mixed_documents(empty_docs).count() == 0


def test_mix_with_a_source_without_words(spark, odd_docs):
    blank = odd_docs.where("doc_id IN (1, 2, 3)").withColumn("source", F.lit("no words"))
    got = mixing.mix(odd_docs.unionByName(blank)).toPandas()
    own = got[got.source_size == 0]
    assert len(got) == odd_docs.count() + 3 and len(own) >= 3 and (own.target == 0).all() and (own.taken == 0).all()
    assert got.taken.sum() > 0 and mixing.mixed_documents(blank).count() == 0


def check_shards(rows, shards):
    counts = rows.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - rows.groupby("shard").size().reindex(range(shards), fill_value=0).min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()


def test_shards(spark):
    rows = QUERIES["op8_sharding"](spark, SF).toPandas()
    check_shards(rows, 40)
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(rows.doc_id) == sorted(texts)
    assert all(r.size_ == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows.rename(columns={"size": "size_"}).itertuples())
    place = rows.sort_values(["shard", "slot"]).doc_id.to_numpy()
    assert abs(np.corrcoef(place, np.arange(len(place)))[0, 1]) < 0.15


def test_shards_of_odd_documents(odd_docs, empty_docs):
    for n in (1, 3, 40):
        rows = sharding.shard(odd_docs, n, bucket_bytes=500).toPandas()
        assert len(rows) == odd_docs.count()
        check_shards(rows, n)
    assert sharding.shard(empty_docs).count() == 0


def test_equal_rows_spread_over_buckets(spark):
    """A third of all rows alike in every column does not gather in one bucket, and slots stay whole."""
    hot = spark.range(0, 900, numPartitions=6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    df = hot.unionByName(spark.range(1800).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")))
    rows = sharding.shard(df, 8, bucket_bytes=1000).toPandas()
    check_shards(rows, 8)
    null = rows[rows["doc_id"].isna()]
    assert len(null) == 900 and null.groupby("shard").size().between(70, 160).all() and null["shard"].nunique() == 8


def test_written_shards_hold_every_document(spark, odd_docs, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(odd_docs, path, n_shards=4, bucket_bytes=2000)
    back = spark.read.parquet(path)
    assert back.count() == odd_docs.count() and {"shard_", "slot_"} <= set(back.columns)
    check_shards(back.toPandas(), 4)
    assert sorted(str(r.text)[:50] for r in back.collect()) == sorted(str(r.text)[:50] for r in odd_docs.collect())


def test_rows_come_from_shards_of_whole_documents(spark, odd_docs):
    """What ``shard`` returns is read from written shards, which hold every column of every document there."""
    got = sharding.shard(odd_docs, 4, bucket_bytes=2000)
    (folder,) = {f.rsplit("/shard=", 1)[0] for f in got.inputFiles()}
    back = spark.read.parquet(folder)
    assert set(back.columns) == set(odd_docs.columns) | {"shard_", "slot_"}
    held = {(r["shard"], r["slot"]): (r["doc_id"], r["text"]) for r in back.collect()}
    rows = got.collect()
    assert len(rows) == len(held) == odd_docs.count()
    for r in rows:
        doc_id, text = held[r["shard"], r["slot"]]
        raw = (text or "").encode()
        assert (r["doc_id"], r["size"], r["text_crc32"]) == (doc_id, len(raw) + 16, zlib.crc32(raw))
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(held.values(), key=key) == sorted(odd_docs.select("doc_id", "text").collect(), key=key)


@pytest.fixture(scope="module")
def bpe():
    return packing.byte_bpe(*packing.public_byte_bpe())


def test_ids_are_those_of_the_tokenizer_file(bpe):
    """As the contract calls it, over literals and all texts of ``documents``."""
    full = Tokenizer.from_file(packing.public_byte_bpe()[0])
    odd = ["", "a", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "é 𝔘 ß\n\n  y", "don't I'LL", " " * 30_000 + "x", "\n" * 1_000_000, "7" * 5000, "\x00\x01 \u200b"]
    texts = [t or "" for (t,) in connect("sf0.01").sql("SELECT text FROM documents").fetchall()]
    for t, e in zip(odd + texts, full.encode_batch(odd + texts, add_special_tokens=False)):
        assert bpe.ids(t).tolist() == e.ids
    assert bpe.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    assert bpe.ids(None).tolist() == []


def slow_cost(at, cost, length):
    best = {0: 0.0}
    for j, (x, c) in enumerate(zip(at, cost), 1):
        places = [0, *at]
        options = []
        for i in range(j):
            n = x - places[i]
            if i in best and n <= length:
                options.append(best[i] + c + (0 if n & (n - 1) == 0 else length - n))
        if options:
            best[j] = min(options)
    return best[len(at)]


def test_window_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        at = np.cumsum(rng.integers(1, 9, 40)).tolist()
        cost = rng.choice([0.0, 2.0, 7.0], 40).tolist()
        cuts = packing.window_cuts(at, cost, 16)
        places = [0, *[at[c] for c in cuts]]
        sizes = np.diff(places)
        assert places[-1] == at[-1] and sizes.max() <= 16
        paid = sum(cost[c] for c in cuts) + sum(0 if n & (n - 1) == 0 else 16 - n for n in sizes.tolist())
        assert paid == slow_cost(at, cost, 16)


def check_pieces(rows, docs, bpe, length=2048):
    """Every id in one piece, sequences gapless and short enough."""
    for _, g in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= length
    for doc, text in docs:
        ids = np.append(bpe.ids(text), 1).astype("<u4")
        g = rows[rows.doc_id == doc].sort_values("start")
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == len(ids)
        assert (g.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(g.start, g.length, g.ids_crc32))


def test_pieces(spark, bpe):
    rows = QUERIES["op9_packing"](spark, SF).toPandas()
    check_pieces(rows, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), bpe)
    sizes = rows.groupby("sequence_id").length.sum().to_numpy()
    padding = np.where(sizes & (sizes - 1) == 0, 0, 2048 - sizes).sum()
    assert padding < 0.02 * sizes.sum()


def test_pieces_of_odd_documents(spark, odd_docs, empty_docs, bpe, monkeypatch):
    rows = packing.pack(odd_docs, *packing.public_byte_bpe()).toPandas()
    once = odd_docs.where("doc_id <> 4 OR doc_id IS NULL")
    check_pieces(rows[rows.doc_id != 4], [], bpe)
    check_pieces(packing.pack(once, *packing.public_byte_bpe()).toPandas(), once.where("doc_id IS NOT NULL").select("doc_id", "text").collect(), bpe)
    assert rows[rows.doc_id.isna()].length.sum() == len(bpe.ids("one two. three")) + 2
    assert packing.pack(empty_docs, *packing.public_byte_bpe()).count() == 0


def test_pipeline_stages(spark):
    sf = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    good = {r.doc_id for r in seen["quality classifier"].collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert np.mean([r.doc_id in good for r in labels if r.quality == 1]) > 0.97
    assert np.mean([r.doc_id in good for r in labels if r.quality == 0]) < 0.4
    groups = QUERIES["op3_simhash_dedup"]
    single = seen["simhash near-dedup"].collect()
    assert len({r.doc_id for r in single}) == len(single) and {r.doc_id for r in single} <= good
    from starfold.llm.simhash_dedup import fingerprint

    first = {}
    for r in sorted(seen["quality classifier"].select("doc_id", "text").collect()):
        first.setdefault(fingerprint(r.text), r.doc_id)
    assert all(first[fingerprint(r.text)] == r.doc_id for r in single) and groups
    assert seen["pii"].where(r"text rlike '[a-z0-9]@[a-z0-9]+[.]example[.]com'").count() == 0
    assert all(len(r.text) == r.n_chars for r in seen["pii"].collect())
    packed = seen["packing"].agg(F.sum("length")).first()[0]
    bpe = packing.byte_bpe(*packing.public_byte_bpe())
    assert packed == sum(len(bpe.ids(r.text)) + 1 for r in seen["mixing"].collect())


def test_pipeline_on_odd_and_empty_documents(spark, odd_docs, empty_docs):
    for start in (odd_docs, empty_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).cache()
        assert docs.count() >= 0 and {"sequence_id", "offset"} <= set(docs.columns)
