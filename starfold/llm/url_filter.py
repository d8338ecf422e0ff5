"""Allow and block rules for URLs: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import table

#: The trie is broadcast if it takes at most this many bytes in a Python worker; larger ones give way to
#: joins. A node, with its label and its entry in its parent, takes at most NODE_BYTES.
TRIE_BYTES, NODE_BYTES = 256 << 20, 480
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def trie_bytes(rules: Sequence[Rule]) -> int:
    """Upper bound of the trie's memory, without building it: nodes for the labels and segments of every
    rule as if none were shared, four for what ends there, and its characters twice."""
    return sum(NODE_BYTES * (h.count(".") + p.count("/") + 5) + 2 * (len(h) + len(p)) * 4 for _, h, p in rules)


class RuleTrie:
    """Nodes are dicts: host labels from the right, then, under each rule's host, path segments.

    The part of a rule's path after its last slash need not end at a segment, so it is kept at the
    node of the segments before it and compared as a prefix.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(("paths",), {})
            *segments, rest = path.split("/")
            for s in segments:
                node = node.setdefault(s, {})
            ends = node.setdefault(("ends",), {})
            # Of two rules for the same place the blocking one holds.
            if ends.get(rest, (None, ""))[1] != "block":
                ends[rest] = (host + path, verdict)
                lengths = node.get(("lengths",), ())
                if len(rest) not in lengths:
                    node[("lengths",)] = tuple(sorted((*lengths, len(rest)), reverse=True))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest host, and under it the longest path, that fit."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if ("paths",) in node:
                best = self._path(node[("paths",)], path) or best
        return best

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        segments = path.split("/")
        for k, s in enumerate(segments):
            ends = node.get(("ends",))
            for n in node.get(("lengths",), ()):
                if s[:n] in ends:
                    best = ends[s[:n]]
                    break
            node = node.get(s) if k + 1 < len(segments) else None
            if node is None:
                break
        return best


def parsed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, host, path); both are empty for a null URL and for one without ``://``."""
    start = F.instr(url_col, "://")
    rest = F.when(start > 0, F.substr(F.col(url_col), start + 3)).otherwise(F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def _by_join(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The same verdicts for rule lists of any size: each host suffix is joined to the rules' hosts."""
    listed = urls.sparkSession.createDataFrame(list(dict.fromkeys(rules)), "verdict string, on_host string, on_path string")
    distinct = urls.select("host", "path").distinct()
    fits = (
        distinct.withColumn("labels", F.split("host", r"\."))
        .withColumn("on_host", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", -k, k), "."))))
        .join(listed, "on_host")
        .where(F.startswith("path", "on_path"))
    )
    rank = F.struct(F.length("on_host"), F.length("on_path"), F.col("verdict") == "block")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("on_host", "on_path").alias("rule"), "verdict"), rank).alias("b"))
    return urls.join(best, ["host", "path"], "left").select("id", "host", "path", "b.rule", "b.verdict")


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with its own.
    The longest host wins, then the longest path, then block over allow. Without a fitting rule the
    rule is null and the verdict is ``default``. Only the two columns are read. The trie is broadcast
    while it surely takes at most ``max_bytes``; longer lists are joined, with the same result. Null, empty and unparsable URLs have empty host and path and take the default; repeated
    rows are judged alike; an empty table gives no rows.
    """
    urls = parsed(pages, id_col, url_col)
    if trie_bytes(rules) > max_bytes:
        out = _by_join(urls, rules)
    else:
        trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            match = trie.value.match
            for b in batches:
                found = [match(h, p) or (None, None) for h, p in zip(b["host"], b["path"])]
                yield b.assign(rule=[r for r, _ in found], verdict=[v for _, v in found])

        # Ids pass through pandas as text, which a null does not turn into floating point.
        out = urls.withColumn("id", F.col("id").cast("string")).mapInPandas(
            run, "id string, host string, path string, rule string, verdict string"
        )
    return out.select(
        F.col("id").cast("long").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


#: Fixed rules of the registered query.
RULES: list[Rule] = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
x AS (
  SELECT *, (SELECT max_by({'rule': h || q, 'verdict': verdict}, length(h) * 1000 + length(q)) FROM r
             WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)) AS b FROM p)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM x
"""
