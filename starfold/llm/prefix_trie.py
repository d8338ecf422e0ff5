"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import CRC_SQL, CRC_TABLE_SQL, table
from starfold.session import cut_lineage, release

#: Turns that one shard of the trie covers, and paths it holds at least, so that shards, of which two
#: paths each go on to the next level, always shrink the table.
SHARD, LEAST_PATHS = 1 << 18, 16
#: Conversation ids are listed in runs of so many consecutive numbers (a power of two).
RUN_BITS = 12
#: Places under one entry of the lowest level of the range-min tree, and queries looked up at a time.
CELL, AT_ONCE = 64, 1 << 14
#: Bytes of a turn's digest.
DIGEST = 16
NONE = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Every so many conversations share a start, of at most so many turns less one.
FAMILY, HEADS = 5, 9


class Parentheses:
    """A tree in preorder as balanced parentheses: two bits a node, answered from their excess.

    ``depth`` of the nodes in preorder, the first 0 and the only one. ``open`` and ``close`` are the
    places of a node's parentheses; a subtree is what lies between them.
    """

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.open = 2 * np.arange(n) - depth  # n opened before, of which all but the ancestors closed
        self.bits = np.zeros(2 * n, dtype=bool)
        self.bits[self.open] = True
        self.excess = np.cumsum(np.where(self.bits, 1, -1))
        self._levels = self._min_tree()
        self.close = np.concatenate([self._find_close(self.open[a : a + AT_ONCE]) for a in range(0, n, AT_ONCE)])
        #: Leaf pairs "()" that open at or before a place.
        self.rank_leaves = np.cumsum(self.bits & ~np.append(self.bits[1:], True))

    def _min_tree(self) -> list[np.ndarray]:
        cells = -(-len(self.excess) // CELL)
        padded = np.full(cells * CELL, len(self.excess), dtype=np.int64)
        padded[: len(self.excess)] = self.excess
        self._cells = padded.reshape(cells, CELL)
        levels = [self._cells.min(axis=1)]
        while len(levels[-1]) > 1:
            last = levels[-1]
            if len(last) % 2:
                last = np.append(last, len(self.excess))
                levels[-1] = last
            levels.append(last.reshape(-1, 2).min(axis=1))
        return levels

    def _find_close(self, at: np.ndarray) -> np.ndarray:
        """The first place behind each opening one where the excess is one less than at it."""
        want = self.excess[at] - 1
        cell, out = at // CELL, np.full(len(at), -1)
        low = (self._cells[cell] <= want[:, None]) & (np.arange(CELL) > (at % CELL)[:, None])
        here = low.any(axis=1)
        out[here] = cell[here] * CELL + low[here].argmax(axis=1)
        # Up: to the first entry on the right whose least excess is low enough; and down again into it.
        todo, node, level = np.flatnonzero(~here), cell[~here], 0
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self._levels]
        while len(todo):
            mins = self._levels[level]
            right = (node % 2 == 0) & (node + 1 < len(mins))
            right[right] = mins[node[right] + 1] <= want[todo[right]]
            found[level].append((todo[right], node[right] + 1))
            todo, node, level = todo[~right], node[~right] // 2, level + 1
        for level in range(len(self._levels) - 1, 0, -1):
            mins = self._levels[level - 1]
            for query, node in found[level]:
                left = mins[2 * node] <= want[query]
                found[level - 1].append((query, 2 * node + ~left))
        for query, cell in found[0]:
            out[query] = cell * CELL + (self._cells[cell] <= want[query][:, None]).argmax(axis=1)
        return out

    def size(self) -> np.ndarray:
        return (self.close - self.open + 1) // 2

    def leaves(self) -> np.ndarray:
        return self.rank_leaves[self.close] - self.rank_leaves[self.open] + self.bits[self.open] * ~self.bits[self.open + 1]


def range_min(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least of ``values`` in each [start, start + size), sizes of 1 or more, by a sparse table."""
    power = np.frexp(size)[1] - 1  # floor(log2), exact for integers
    out, now = np.empty(len(start), values.dtype), values
    for k in range(int(power.max()) + 1):
        if k:
            half = 1 << (k - 1)
            now = np.minimum(now[: len(now) - half], now[half:])
        q = power == k
        out[q] = np.minimum(now[start[q]], now[start[q] + size[q] - (1 << k)])
    return out


@dataclass
class Path:
    """A path of the trie: a digest and the bytes of the text per turn and, per depth from 0 on, what
    is known of the node already: conversations that end there or below, the smallest of them,
    children, leaves and savings that lie in finished parts, and the digest of the ids that end there."""

    turns: np.ndarray
    sizes: np.ndarray
    here: np.ndarray
    first: np.ndarray
    kids: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    ends: list[str | None]

    @staticmethod
    def ending(path: bytes, sizes: np.ndarray, n: int, first: int, ends: str) -> Path:
        d = len(path) // DIGEST
        zero = [np.zeros(d + 1, np.int64) for _ in range(4)]
        least = np.full(d + 1, NONE)
        zero[0][d], least[d] = n, first
        return Path(_turns(path), np.asarray(sizes, np.int64), zero[0], least, *zero[1:], [None] * d + [ends])


def _turns(path: bytes) -> np.ndarray:
    return np.frombuffer(path, dtype=np.uint64).reshape(-1, 2)


NODE = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SPINE = "path binary, sizes array<long>, here array<long>, first array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"
PARTS = ("here", "first", "kids", "leaves", "saved")


def encode(paths: list[Path], last: bool, keyed: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(finished nodes, spines) of the trie of sorted ``paths``.

    The nodes on the first and the last path may have more below them in other shards: unless this
    shard is the ``last`` one, they go on as two paths with what their finished children add up to.
    ``keyed``: finished nodes carry a key, because children in other shards may wait for them.
    """
    depth, parent, size, of, on, new = [0], [-1], [0], [], [0], []
    before = np.zeros((0, 2), np.uint64)
    for p in paths:
        m = min(len(before), len(p.turns))
        apart = np.flatnonzero((before[:m] != p.turns[:m]).any(axis=1))
        same = int(apart[0]) if len(apart) else m
        on = on[: same + 1]
        for d in range(same, len(p.turns)):
            on.append(len(depth))
            depth.append(d + 1)
            parent.append(on[d])
            size.append(int(p.sizes[d]))
            new.append(p.turns[d].tobytes())
        of.append(np.array(on))
        before = p.turns
    depth, parent, size = np.array(depth), np.array(parent), np.array(size)
    n = len(depth)
    known = {k: np.full(n, NONE) if k == "first" else np.zeros(n, np.int64) for k in PARTS}
    ends: list[str | None] = [None] * n
    for p, nodes in zip(paths, of):
        for k in PARTS:
            known[k][nodes] = np.minimum(known[k][nodes], p.first) if k == "first" else known[k][nodes] + getattr(p, k)
        for node, e in zip(nodes, p.ends):
            ends[node] = e or ends[node]

    tree = Parentheses(depth)
    count = tree.size()
    at = np.arange(n)

    def below(own: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(own)])
        return total[at + count] - total[at]

    spine = np.zeros(n, dtype=bool)
    if not last:
        spine[of[0]] = spine[of[-1]] = True
    n_convs = below(known["here"])
    conv = range_min(known["first"], at, count)
    kids = known["kids"] + np.bincount(parent[1:], minlength=n)
    # A leaf pair is no leaf if its children are in finished parts, which have counted their leaves.
    n_leaves = tree.leaves() + below(known["leaves"] - ((count == 1) & (known["kids"] > 0)))
    saved = below(np.where(spine, 0, (n_convs - 1) * size) + known["saved"])

    own_key = {0: b""} if not (last and not keyed) else {}
    if own_key:
        for v in range(1, n):
            if keyed or spine[v]:
                own_key[v] = hashlib.blake2b(own_key[parent[v]] + new[v - 1], digest_size=DIGEST).digest()
    done = np.flatnonzero(~spine)
    up = parent[done]
    waits = (up >= 0) & spine[up]
    nodes = pd.DataFrame(
        {
            "key": [own_key[v] if keyed else None for v in done.tolist()],
            "parent_key": [own_key[v] if w else None for v, w in zip(up.tolist(), waits)],
            "conv_id": conv[done],
            "depth": depth[done],
            "parent_conv_id": pd.array(np.where((up >= 0) & ~waits, conv[up], 0), dtype="Int64"),
            "n_convs": n_convs[done],
            "n_children": kids[done],
            "n_leaves": n_leaves[done],
            "saved_tokens": saved[done],
            "ends_sha256": [ends[v] or NO_ENDS for v in done.tolist()],
        }
    )
    nodes.loc[(up < 0) | waits, "parent_conv_id"] = pd.NA
    if last:
        return nodes, pd.DataFrame()
    # What the finished children of a spine node add up to stays with the node.
    top = done[waits]
    for k, v in (("here", n_convs), ("kids", np.ones(n, np.int64)), ("leaves", n_leaves), ("saved", saved)):
        np.add.at(known[k], parent[top], v[top])
    np.minimum.at(known["first"], parent[top], conv[top])
    rows, seen = [], 0
    for p, on in ((paths[0], of[0]), (paths[-1], of[-1]))[: min(2, len(paths))]:
        again = np.isin(on, of[0]) if seen else np.zeros(len(on), dtype=bool)  # nodes of both paths count once
        part = {k: np.where(again, NONE if k == "first" else 0, known[k][on]) for k in PARTS}
        rows.append({"path": p.turns.tobytes(), "sizes": p.sizes, **part, "ends": [None if a else ends[v] for v, a in zip(on, again)]})
        seen += 1
    return nodes, pd.DataFrame(rows)


def _table(nodes: pd.DataFrame, spines: pd.DataFrame) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in f"{NODE}, {SPINE}".split(", ")]
    for part, spine in ((nodes, False), (spines, True)):
        if len(part):
            yield part.assign(**{c: None for c in columns if c not in part.columns})[columns].assign(spine=spine)


def _shards(paths: Iterator[Path], last: bool, keyed: bool, shard: int) -> Iterator[pd.DataFrame]:
    held: list[Path] = []
    turns = 0
    for p in paths:
        held.append(p)
        turns += len(p.turns)
        if not last and turns >= shard and len(held) >= LEAST_PATHS:
            yield from _table(*encode(held, False, keyed))
            held, turns = [], 0
    if held:
        yield from _table(*encode(held, last, keyed))


def _ending_paths(batches: Iterator[pd.DataFrame]) -> Iterator[Path]:
    """Paths out of sorted runs of the ids that end on them; a path's ids are hashed as they come."""
    now = None
    for b in batches:
        for path, sizes, ids, n, first in zip(b["path"], b["sizes"], b["ids"], b["n"], b["first"]):
            if now is not None and now[0] == path:
                now[2].update(b"," + ids.encode())
                now[3] += n
                now[4] = min(now[4], first)
                continue
            if now is not None:
                yield Path.ending(now[0], now[1], now[3], now[4], now[2].hexdigest())
            now = [path, sizes, hashlib.sha256(ids.encode()), n, first]
    if now is not None:
        yield Path.ending(now[0], now[1], now[3], now[4], now[2].hexdigest())


def _spine_paths(batches: Iterator[pd.DataFrame]) -> Iterator[Path]:
    for b in batches:
        for r in b.itertuples():
            yield Path(_turns(r.path), *[np.asarray(getattr(r, k), np.int64) for k in ("sizes", *PARTS)], list(r.ends))


def trie_nodes(ended: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of ``ended``: (path, sizes, run, ids, n, first), one row per path and run
    of ids: 16 bytes of digest and the text's bytes per turn, the ids as text, their number and least.

    Sorted paths are cut into shards of about ``shard`` turns. A shard writes the tree of its paths as
    balanced parentheses: findclose, by a tree of least excesses, delimits subtrees, the rank of leaf
    pairs counts their leaves and cumulative sums in preorder give conversations and savings. Nodes on
    its first and last path are shared with its neighbours: these two spines, with what their finished
    children add up to, are the paths of the next level, until one shard holds them all. Nodes whose
    parent is on a spine get its smallest member by a join on the digest of the parent's path.
    """
    level, made, keyed = ended, [], False
    while True:
        count, turns = level.agg(F.count(F.lit(1)), F.sum(F.length("path") / DIGEST)).first()
        last = not count or turns <= shard or count <= LEAST_PATHS
        parts = max(1, min(-(-int(turns or 0) // shard), count // LEAST_PATHS))
        read = _spine_paths if keyed else _ending_paths

        def run(batches: Iterator[pd.DataFrame], read=read, last=last, keyed=keyed) -> Iterator[pd.DataFrame]:
            return _shards(read(batches), last, keyed, shard)

        # The last shard is bounded, and its rows come to one task whatever partitions a session asks for.
        dealt = level.coalesce(1) if last else level.repartitionByRange(parts, "path")
        order = ["path"] if keyed else ["path", "run"]
        made.append(cut_lineage(dealt.sortWithinPartitions(*order).mapInPandas(run, f"{NODE}, {SPINE}, spine boolean")))
        level, keyed = made[-1].where("spine").select(*[c.split()[0] for c in SPINE.split(", ")]), True
        if last:
            break
    columns = [c.split()[0] for c in NODE.split(", ")]
    nodes = made[0].where("not spine").select(*columns)
    for m in made[1:]:
        nodes = nodes.unionByName(m.where("not spine").select(*columns))
    out = nodes.select(*columns[2:])
    if len(made) > 1:
        named = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
        waiting = nodes.where("parent_key IS NOT NULL").join(named, "parent_key")
        out = nodes.where("parent_key IS NULL").select(*columns[2:]).unionByName(
            waiting.withColumn("parent_conv_id", F.col("up")).select(*columns[2:])
        )
    return out


def shared_start(conv: Column) -> tuple[Column, Column]:
    """(conversation, number of turns) that a conversation's start is taken from by the query's contract."""
    return conv - conv % FAMILY, (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def conversation_trie(turns: DataFrame, rebuild: bool = False, shard: int = SHARD) -> DataFrame:
    """One row per distinct start (the first d turns) of a conversation: conv_id (smallest member),
    depth d, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, turn, role, text. A conversation's turns are ordered by turn (null first), ties
    by a digest of role and text; null roles and texts are empty. Turns are the same if role and text
    are (compared by 128-bit digests). Rows without a conv_id are left out; repeated rows are turns of
    their own; an empty table has no nodes, not even a root. With ``rebuild`` each conversation takes
    its start from the first of its FAMILY. Other columns, also of clashing names, are ignored.

    Texts stay in the task that reads them: a turn is 16 bytes of digest and a size from there on.
    A conversation is a row of these, so one of ten million turns needs half a gigabyte; equal
    conversations, however many, are one path with runs of their ids, hashed in order as they stream by
    (a SHA-256 is sequential: the longest list takes one task as long as its bytes need).
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    item = F.struct(F.col("turn").isNotNull().alias("has"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    own = (
        turns.where("conv_id IS NOT NULL")
        .select(F.col("conv_id").cast("long").alias("c"), item.alias("item"))
        .groupBy("c")
        .agg(F.sort_array(F.collect_list("item")).alias("own"))
    )
    made = None
    if rebuild:
        made = own = cut_lineage(own.select("c", F.transform("own", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("own")))
        base, h = shared_start(F.col("c"))
        heads = own.where(F.col("c") % FAMILY == 0).select(F.col("c").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
        rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
        own = (
            own.withColumn("base", base)
            .withColumn("h", h)
            .join(heads, "base", "left")
            .select("c", F.concat(F.when(F.col("head").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h"))), rest).alias("own"))
        )
    paths = own.select(
        "c",
        F.unhex(F.array_join(F.transform("own", lambda x: x["digest"]), "")).alias("path"),
        F.transform("own", lambda x: x["size"]).alias("sizes"),
    )
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",")
    ended = cut_lineage(
        paths.groupBy("path", F.shiftright("c", RUN_BITS).alias("run")).agg(
            F.first("sizes").alias("sizes"), ids.alias("ids"), F.count(F.lit(1)).alias("n"), F.min("c").alias("first")
        )
    )
    release(made)
    return trie_nodes(ended, shard)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True)


OP12_SQL = f"""
WITH {CRC_TABLE_SQL}, turns AS (
    SELECT conv_id AS c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS item,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT c, list(item ORDER BY p) AS own FROM turns GROUP BY c
), places AS (
    SELECT c, own, c - c % {FAMILY} AS base, {CRC_SQL} % {HEADS} AS h FROM (SELECT *, encode(c::VARCHAR) AS b FROM own), crc_table
), rebuilt AS (
    SELECT p.c, coalesce(b.own[1:p.h], []) || p.own[p.h + 1:] AS path FROM places p LEFT JOIN own b ON b.c = p.base
), starts AS (
    SELECT c, len(path) AS turns, path[1:d] AS start, d FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT start, d, min(c) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(CASE WHEN turns = d THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends
    FROM starts GROUP BY start, d
), children AS (
    SELECT start[1:d - 1] AS start, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), own_nodes AS (
    SELECT n.*, coalesce(k.n_children, 0) AS n_children,
        CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.start[n.d].text)) END AS saved
    FROM nodes n LEFT JOIN children k ON k.start = n.start
), totals AS (
    SELECT start[1:a] AS start, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(d + 1)) AS a FROM own_nodes) GROUP BY 1
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
    t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM own_nodes n
JOIN totals t ON t.start = n.start
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.start = n.start[1:n.d - 1]
"""
