"""Personal data: high-recall span candidates, boosted trees and calibrated thresholds, all native."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.boosting import Boosted, Cell, boost, threshold
from starfold.llm.common import table, whole_row
from starfold.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns, rewritten so that Java neither recurses nor rescans a run of characters: the
#: quantifiers are possessive where what follows cannot begin with what they take, and a match only
#: begins where its run does (or where the match before it ended).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What generators propose beside them: accented or written-out addresses, numbers that the base
#: pattern runs together, phone numbers without a plus. Candidates of different kinds may overlap.
WIDE = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++(?:@|\x20?(?:\(at\)|\[at\])\x20?)[\p{L}0-9-]++"
    r"(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[\p{L}0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9])(?:\([0-9]{2,5}\)|[0-9]{1,5})(?:[\x20.-]\(?[0-9]{2,5}\)?){1,4}(?![0-9])",
}
GUARDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
MARK, INSTEAD = "\x01", "\x02"
CONTEXT = 24
#: Words whose presence before a span a model may use.
CUES = r"(?i)(?:mail|contact|phone|tel|call|fax|card|visa|account|ip|host|server|address|key|token|secret|id)\W*$"
FEATURES = ("kind", "digits", "length", "separators", "luhn", "octets", "left", "right", "cue")
PRECISION = 0.95
_SPAN = "array<struct<kind:int,start:int,end:int>>"
_CANDIDATE = "array<struct<kind:int,start:int,end:int,y:int," + ",".join(f"{f}_f:int" for f in FEATURES) + ">>"


def _luhn(digits: str) -> str:
    """SQL: whether a string of 14 to 19 digits passes Luhn's check."""
    v = f"int(substr({digits}, length({digits}) - i + 1, 1))"
    doubled = f"if(i % 2 = 1, {v}, if({v} > 4, 2 * {v} - 9, 2 * {v}))"
    return f"(length({digits}) BETWEEN 14 AND 19 AND aggregate(sequence(1, least(length({digits}), 19)), 0, (s, i) -> s + {doubled}) % 10 = 0)"


_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _valid(kind: str, hit: str) -> str:
    """SQL: whether a match of the base pattern counts."""
    digits = f"regexp_replace({hit}, '[^0-9]', '')"
    if kind == "ip":
        return f"{hit} rlike '^{_OCTET}([.]{_OCTET}){{3}}$'"
    if kind == "card":
        # Long matches are told apart by their length, before any work on them.
        return f"(length({hit}) BETWEEN 14 AND 37 AND {_luhn(digits)})"
    if kind == "phone":
        return f"length({digits}) BETWEEN 10 AND 15"
    return "true"


def _running(values: str, step: str, start: str) -> str:
    """SQL: running ``step`` (over q, the value so far, and x) of an int array that is not empty.

    It goes in chunks of 256, as appending to one array would copy it each time.
    """
    run = (
        "aggregate({0}, struct(" + start + " AS s, cast(array() AS array<int>) AS a), "
        "(t, x) -> struct(" + step.replace("q", "t.s") + " AS s, array_append(t.a, " + step.replace("q", "t.s") + ") AS a), t -> t.a)"
    )
    chunks = f"transform(sequence(0, (size({values}) - 1) div 256), c -> {run.format(f'slice({values}, c * 256 + 1, 256)')})"
    # The chunks' last values, run in turn, carry into the chunks after them.
    carried = run.format("transform(k, c -> element_at(c, -1))")
    joined = (
        "flatten(transform(k, (c, n) -> transform(c, x -> if(n = 0, x, "
        + step.replace("q", "get(o, n - 1)")
        + "))))"
    )
    return f"transform(array({chunks}), k -> transform(array({carried}), o -> {joined})[0])[0]"


def _matches(df: DataFrame, name: str, pattern: str, guard: str) -> DataFrame:
    """Add ``name``: array of (start, end, hit, left, right) for the leftmost non-overlapping matches.

    Matches are set between marks and the text is split at them, so every second piece is a match and
    the running sum of the pieces' lengths gives positions in code points.
    """
    marked = F.regexp_replace("_t", F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    df = df.withColumn("_p", F.when(F.rlike("_t", F.lit(guard)), F.split(marked, MARK, -1)).otherwise(F.array(F.lit(""))))
    df = df.withColumn("_l", F.expr("transform(_p, x -> length(x))"))
    df = df.withColumn("_e", F.expr(f"if(size(_p) < 2, array(0), {_running('_l', 'q + x', '0')})"))
    spans = f"""
        if(size(_p) < 2, cast(array() AS array<struct<start:int,end:int,hit:string,left:string,right:string>>),
           transform(sequence(1, greatest((size(_p) - 1) div 2, 1)), i -> struct(
               get(_e, 2 * i - 2) AS start, get(_e, 2 * i - 1) AS end, get(_p, 2 * i - 1) AS hit,
               right(get(_p, 2 * i - 2), {CONTEXT}) AS left, left(get(_p, 2 * i), 1) AS right)))"""
    return df.withColumn(name, F.expr(spans)).drop("_p", "_l", "_e")


def _class(c: str) -> str:
    """SQL: 0 none, 1 white space, 2 punctuation, 3 quote or equals sign, 4 letter or digit."""
    return (
        f"CASE WHEN {c} = '' THEN 0 WHEN {c} rlike '[\\\\s]' THEN 1 WHEN {c} rlike '[\\\\p{{L}}0-9_]' THEN 4 "
        f"WHEN {c} IN ('\"', '\\'', '=') THEN 3 ELSE 2 END"
    )


def _features(n: int, m: str) -> str:
    """SQL: the feature fields of a match; a plus sign that opens it does not count."""
    hit = f"ltrim('+', {m}.hit)"
    digits = f"regexp_replace({m}.hit, '[^0-9]', '')"
    values = {
        "kind": str(n),
        "digits": f"least(length({digits}), 20)",
        "length": f"least(length({hit}), 40)",
        "separators": f"least(length(regexp_replace({hit}, '[\\\\p{{L}}0-9]', '')), 8)",
        "luhn": f"int({_luhn(digits)})",
        "octets": f"int({_valid('ip', m + '.hit')})",
        "left": _class(f"right({m}.left, 1)"),
        "right": _class(f"{m}.right"),
        "cue": f"int({m}.left rlike r'{CUES}')",
    }
    return ", ".join(f"{v} AS {f}_f" for f, v in values.items())


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``base`` (validated spans of the fixed patterns, by start, then kind), ``candidates`` (the
    generators' spans) and ``examples`` (both with features and a distant label ``y``).

    Examples are the matches of the fixed patterns, 1 if their check holds and else 0, and the
    generators' spans that fail their kind's check or are part of a longer word, 0. The other
    candidates (y = -1) are left to the model."""
    # The mark must not occur in a text; its stand-in is as long and in no pattern either.
    df = docs.withColumn("_t", F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, INSTEAD))
    base, wide, examples = [], [], []
    for n, k in enumerate(KINDS):
        df = _matches(df, f"_b_{k}", BASE[k], GUARDS[k])
        df = _matches(df, f"_w_{k}", WIDE[k], GUARDS[k])
        base.append(F.expr(f"transform(filter(_b_{k}, m -> {_valid(k, 'm.hit')}), m -> struct({n} AS kind, m.start, m.end))"))
        examples.append(
            F.expr(f"transform(_b_{k}, m -> struct({n} AS kind, m.start, m.end, int({_valid(k, 'm.hit')}) AS y, {_features(n, 'm')}))")
        )
        digits = "regexp_replace(m.hit, '[^0-9]', '')"
        check = {"card": _luhn(digits), "phone": f"length({digits}) BETWEEN 10 AND 15"}.get(k, _valid(k, "m.hit"))
        word = f"(({_class('right(m.left, 1)')}) = 4 OR ({_class('m.right')}) = 4)"
        label = f"if({word} OR NOT {check}, 0, -1)"
        wide.append(
            F.expr(f"transform(_w_{k}, m -> struct({n} AS kind, m.start, m.end, {label} AS y, {_features(n, 'm')}))")
        )
    df = df.withColumn("base", F.array_sort(F.concat(*base), _by_start).cast(_SPAN))
    df = df.withColumn("_w", F.concat(*wide).cast(_CANDIDATE))
    df = df.withColumn("examples", F.concat(F.concat(*examples).cast(_CANDIDATE), F.filter("_w", lambda c: c["y"] == 0)))
    df = df.withColumn("candidates", F.filter("_w", lambda c: c["y"] == -1))
    return df.drop("_t", "_w", *[f"_{a}_{k}" for a in "bw" for k in KINDS])


def _by_start(a: Column, b: Column) -> Column:
    def sign(f: str) -> Column:
        return F.signum(a[f] - b[f]).cast("int")

    return F.when(sign("start") != 0, sign("start")).otherwise(sign("kind"))


@dataclass
class SpanModel:
    """Scores of candidate spans and, per kind, the score from which on they count."""

    boosted: Boosted
    thresholds: tuple[float, ...]


def fit(found: DataFrame, id_col: str, precision: float = PRECISION) -> SpanModel:
    """Fit to the examples of all documents.

    They are counted by their features, which are small integers, so what reaches the driver is one
    row per distinct combination, however many spans there are. A fifth of the documents, by hash of
    the id, is kept from the trees and sets the thresholds.
    """
    names = [f"{f}_f" for f in FEATURES]
    rows = found.select((F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(5)) == 0).alias("aside"), F.explode("examples").alias("c"))
    counted = rows.groupBy("aside", *[F.col(f"c.{n}").alias(n) for n in names]).agg(
        F.sum("c.y").alias("pos"), F.sum(1 - F.col("c.y")).alias("neg")
    )
    cells: dict[bool, list[Cell]] = {True: [], False: []}
    for r in counted.collect():
        cells[r["aside"]].append((tuple(r[n] for n in names), float(r["pos"]), float(r["neg"])))
    model = boost(cells[False])
    cuts = [threshold(model, [c for c in cells[True] if c[0][0] == k], precision) for k in range(len(KINDS))]
    return SpanModel(model, tuple(cuts))


def select(found: DataFrame, model: SpanModel) -> DataFrame:
    """Add ``spans``: the base spans and the candidates that the model adds, by start, then kind.

    A candidate is added if its score reaches its kind's threshold, it touches no base span and no
    other candidate that begins before it. Overlaps are found in one sorted array from the running
    maximum of the ends before a span and the nearest base start after it, so a text with very many
    spans costs time in proportion to them.
    """
    cut = F.create_map(*[F.lit(x) for k, t in enumerate(model.thresholds) for x in (k, t if t < math.inf else 1e300)])

    def passes(c: Column) -> Column:
        return model.boosted.column([c[f"{f}_f"] for f in FEATURES]) >= F.element_at(cut, c["kind"])

    def plain(c: Column, added: int) -> Column:
        # Base spans sort before candidates with the same start.
        return F.struct(c["start"].alias("start"), F.lit(added).alias("added"), c["kind"].alias("kind"), c["end"].alias("end"))

    df = found.withColumn("_c", F.transform(F.filter("candidates", passes), lambda c: plain(c, 1)))
    df = df.withColumn("_c", F.array_sort(F.concat(F.transform("base", lambda c: plain(c, 0)), "_c")))
    df = df.withColumn("_end", F.expr("transform(_c, c -> c.end)"))
    df = df.withColumn("_next", F.expr("reverse(transform(_c, c -> if(c.added = 0, c.start, 2147483647)))"))
    some = "if(size(_c) = 0, cast(array() AS array<int>), {0})"
    df = df.withColumn("_end", F.expr(some.format(_running("_end", "greatest(q, x)", "0"))))
    df = df.withColumn("_next", F.expr(some.format(f"reverse({_running('_next', 'least(q, x)', '2147483647')})")))
    # Bound as z, the two arrays are computed once and not for every element.
    free = "coalesce(get(z.a, n - 1), 0) <= c.start AND coalesce(get(z.b, n + 1), 2147483647) >= c.end"
    kept = f"transform(array(struct(_end AS a, _next AS b)), z -> filter(_c, (c, n) -> c.added = 0 OR ({free})))[0]"
    df = df.withColumn("_c", F.expr(kept))
    spans = F.expr("transform(_c, c -> struct(c.kind AS kind, c.start AS start, c.end AS end))").cast(_SPAN)
    return df.withColumn("spans", F.array_sort(spans, _by_start)).drop("_c", "_end", "_next", "candidates", "examples")


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', get(array({names}), s.kind), s.start, s.end)), ',')")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base and spans (arrays of kind, start, end in code points).

    The texts are read once; their candidate spans go to a stage table from which the model is fitted
    and applied, without a shuffle of documents. Base spans always stay. Null and empty texts have
    none. Repeated rows are judged alike, ids may be null, an empty table gives no rows. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = cut_lineage(candidates(rows).select("id", "base", "candidates", "examples"))
    return select(found, fit(found, "id")).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets, like ``[email]``; overlapping
    spans become one, named after the first. A null text stays null. The texts are matched once and
    written with what was found, for the fit and the redaction to read."""
    own = docs.columns
    rows = docs.select(whole_row(docs).alias("_row"), F.col(text_col).alias("_text"), F.col(id_col).alias("_id"))
    found = cut_lineage(candidates(rows, "_text").drop("_text"))
    model = fit(found, "_id")
    names = ", ".join(f"'[{k}]'" for k in KINDS)
    cleaned = F.expr(
        f"""if(size(spans) = 0, _text, aggregate(spans, struct(0 AS at, '' AS out),
            (q, s) -> if(s.start >= q.at,
                struct(s.end AS at, concat(q.out, substr(_text, q.at + 1, s.start - q.at), get(array({names}), s.kind)) AS out),
                struct(greatest(q.at, s.end) AS at, q.out AS out)),
            q -> concat(q.out, substr(_text, q.at + 1))))"""
    )
    out = select(found, model).withColumn("_text", F.col(f"_row.`{text_col}`")).withColumn("_new", cleaned)
    return out.select(*[F.col("_new").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in own])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = {n}))").cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )
