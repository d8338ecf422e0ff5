"""Prefix trie of conversations against brute force and SQL."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.llm import prefix_trie
from starfold.llm.catalog import QUERIES, SQL
from tests.check import DATA, connect, diff

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def paths_of(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [t[3] for t in sorted(turns, key=lambda t: t[:3])] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids = dict.fromkeys(nodes, 0)
    for start in nodes:
        if start:
            kids[start[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for start, members in nodes.items():
        own = (len(members) - 1) * len(start[-1][1].encode()) if start else 0
        for d in range(len(start) + 1):
            leaves[start[:d]] += not kids[start]
            saved[start[:d]] += own
    rows = []
    for start, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(start))
        up = min(nodes[start[:-1]]) if start else None
        rows.append((min(members), len(start), up, len(members), kids[start], leaves[start], saved[start], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def random_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 4 * n), n):
        for turn in range(rng.choice([0, 1, 2, 3, 3, 4, 6, 11])):
            rows.append((c, turn, rng.choice(["user", "é", None]), rng.choice(["", "a", "b", "bé", None])))
    rows += [(4 * n + k, t, "user", f"same {t}") for k in range(150) for t in range(3)]  # equal conversations
    rows += [(9 * n, t, "user", "deep" * (t % 3)) for t in range(300)]
    return rows


def test_parentheses_answer_as_a_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 65, 1000, 20_000):
        depth = [0]
        for _ in range(n - 1):
            depth.append(depth[-1] + 1 if rng.random() < 0.45 else int(rng.integers(1, depth[-1] + 2)))
        depth = np.array(depth)
        end, stack = np.full(n, n), []
        for i in range(n):
            while stack and depth[stack[-1]] >= depth[i]:
                end[stack.pop()] = i
            stack.append(i)
        tree = prefix_trie.Parentheses(depth)
        assert (tree.size() == end - np.arange(n)).all()
        leaf = np.concatenate([[0], np.cumsum(np.append(depth[1:] <= depth[:-1], True))])
        assert (tree.leaves() == leaf[end] - leaf[:-1]).all()
        v = rng.integers(0, 99, n)
        assert prefix_trie.range_min(v, np.arange(n), tree.size()).tolist() == [v[i:e].min() for i, e in enumerate(end)]


@pytest.mark.parametrize("shard", [prefix_trie.SHARD, 200, 20])
def test_trie_as_brute_force_in_one_and_many_shards(spark, shard, monkeypatch):
    rows = random_turns(3, 250)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(prefix_trie.conversation_trie(df, shard=shard)) == brute(paths_of(rows))
    assert rows_of(prefix_trie.conversation_trie(df, rebuild=True, shard=shard)) == brute(rebuilt(paths_of(rows)))


def test_shards_inside_a_task():
    """Blocks of one task and of one sorted input give the same nodes as a single shard."""
    rng = np.random.default_rng(2)
    digest = rng.integers(0, 2**62, (40, 2), dtype=np.uint64)
    raw = sorted({tuple(rng.integers(0, 3, rng.integers(0, 6)).tolist()) for _ in range(300)}, key=lambda p: b"".join(digest[k].tobytes() for k in p))
    paths = [prefix_trie.Path.ending(b"".join(digest[k].tobytes() for k in p), [k + 1 for k in p], i % 4 + 1, i, f"e{i}") for i, p in enumerate(raw)]
    cut = [f for f in prefix_trie._shards(iter(paths), False, False, 40)]
    assert sum(len(f) for f in cut if f["spine"].iloc[0]) > 6
    whole, none = prefix_trie.encode(paths, True, False)
    assert len(none) == 0
    done = [f for f in cut if not f["spine"].iloc[0]]
    spines = [r for f in cut if f["spine"].iloc[0] for r in prefix_trie._spine_paths(iter([f]))]
    last, _ = prefix_trie.encode(sorted(spines, key=lambda p: p.turns.tobytes()), True, True)
    columns = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted(map(tuple, [r for f in [*done, last] for r in f[columns].to_numpy().tolist()]))
    assert got == sorted(map(tuple, whole[columns].to_numpy().tolist()))


def test_odd_and_empty_tables(spark):
    rows = [(None, 1, "a", "x"), (3, None, None, None), (3, None, "", ""), (3, 2, "r", "x" * 200_000), (3, 2, "r", "a"), (7, 5, "r", "a"), (7, 5, "r", "a"), (-6, 0, "r", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("path", "sizes", "own", "ids", "c", "h", "base", "depth", "n", "run", "spine"):
        df = df.withColumn(c, F.lit("own"))
    assert rows_of(prefix_trie.conversation_trie(df)) == brute(paths_of(rows))
    assert rows_of(prefix_trie.conversation_trie(df, rebuild=True)) == brute(rebuilt(paths_of(rows)))
    assert prefix_trie.conversation_trie(df.where("false"), rebuild=True).count() == 0


def test_query_as_brute_force_and_sql(spark):
    got = QUERIES["op12_conversation_prefix_trie"](spark, str(DATA / "sf0.01"))
    rows = connect("sf0.01").sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert rows_of(got) == brute(rebuilt(paths_of(rows)))
    assert diff(got.toPandas(), connect("sf0.01").sql(SQL["op12_conversation_prefix_trie"]).df()) is None
