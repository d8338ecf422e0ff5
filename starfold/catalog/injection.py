"""Queries: injection, recovery summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.catalog.base import DAILY, r6, s6
from starfold.catalog.folding import tdur_sql
from starfold.catalog.models import occult_sql
from starfold.functions.models import SOLAR_LIMB
from starfold.operators import inject
from starfold.sources import fixtures

QUERIES, SQL = {}, {}
C = F.col


def injected(spark, sf):
    d = fixtures.daily(spark, sf)
    s = d.select("star").distinct()
    none = F.lit(None).cast("double")
    a = s.select("star", F.lit(1).alias("id"), F.lit(27.1).alias("P"), F.lit(12.33).alias("epoch"), none.alias("phase"), F.lit(3e12).alias("df"), none.alias("s2n"), F.lit(3.2).alias("tdur"))
    b = s.select("star", F.lit(2).alias("id"), F.lit(31.7).alias("P"), none.alias("epoch"), F.lit(0.37).alias("phase"), none.alias("df"), F.lit(12.0).alias("s2n"), none.alias("tdur"))
    return inject.inject(d.select("star", "cad", "t", "f", "fmask"), a.unionByName(b), 0.25)


QUERIES["inject"] = lambda spark, sf: injected(spark, sf).select("star", "cad", "id", r6(C("finj") / 7123457).alias("finj"))
SQL["inject"] = f"""WITH {DAILY}, s AS (SELECT star, stddev_pop(f) AS sd, max(t) - min(t) AS tb FROM daily GROUP BY star),
p AS (SELECT star, 1 AS id, 27.1::DOUBLE AS P, 12.33::DOUBLE AS e, 3.2::DOUBLE AS td, 3e6 AS dep FROM s
  UNION ALL SELECT star, 2, 31.7::DOUBLE, 0.37::DOUBLE * 31.7::DOUBLE, {tdur_sql('31.7::DOUBLE')}, 12 * sd / sqrt(tb / 31.7::DOUBLE * ({tdur_sql('31.7::DOUBLE')} / 0.25)) FROM s),
m AS (SELECT d.star, d.cad, p.id, td, dep, abs(t % P - e % P) AS tm, 0.5 * (td - 0.25) AS ie, 0.5 * (td + 0.25) AS oe FROM daily d JOIN p ON p.star = d.star)
SELECT star, cad, id, {s6('CASE WHEN tm < ie THEN -dep WHEN tm > ie AND tm < oe THEN -dep * (1 - (tm - ie) / 0.25) ELSE 0 END / 7123457')} AS finj FROM m"""


def single(spark, sf):
    d = fixtures.daily(spark, sf).select("star", "cad", "t", "f", "fmask")
    p = d.select("star").distinct().select("star", F.lit(1).alias("id"), F.lit(310.7).alias("P"), F.lit(0.25).alias("phase"), F.lit(2).alias("num"), F.lit(9.0).alias("s2n"))
    return inject.inject_single(d, p, 0.25).select("star", "cad", r6(C("finj") / 7123457).alias("finj"))


QUERIES["inject_single"] = single
SQL["inject_single"] = f"""WITH {DAILY}, s AS (SELECT star, 9 * stddev_pop(f) / sqrt((max(t) - min(t)) / 310.7::DOUBLE * ({tdur_sql('310.7::DOUBLE')} / 0.25)) AS dep FROM daily GROUP BY star)
SELECT star, cad, {s6(f"CASE WHEN t > 310.7::DOUBLE * 2.25 AND t < 310.7::DOUBLE * 2.25 + {tdur_sql('310.7::DOUBLE')} THEN -dep ELSE 0 END / 7123457")} AS finj FROM daily JOIN s USING (star)"""


def model(spark, sf):
    d = fixtures.daily(spark, sf).select("star", "cad", "t", "f", "fmask")
    cols = {"id": 1, "P": 27.1, "phase": 0.455, "rp": 0.1, "tau": 3.0, "b": 0.4} | {f"a{i}": v for i, v in enumerate(SOLAR_LIMB, 1)}
    p = d.select("star").distinct().select("star", *[F.lit(v).alias(k) for k, v in cols.items()])
    return inject.inject_model(d, p, 5, 1.0).select("star", "cad", r6("finj", 9).alias("finj"))


QUERIES["inject_model"] = model
SQL["inject_model"] = f"""WITH {DAILY}, u AS (SELECT star, cad, (t - 0.455::DOUBLE * 27.1::DOUBLE + 13.55::DOUBLE) AS x FROM daily),
d AS (SELECT star, cad, x - floor(x / 27.1::DOUBLE) * 27.1::DOUBLE - 13.55::DOUBLE AS u FROM u),
z AS (SELECT star, cad, sqrt(pow((u - 0.5 + j * 0.25::DOUBLE) / 3, 2) + 0.16::DOUBLE) AS z FROM d, (SELECT unnest(range(5)) AS j))
SELECT star, cad, {s6('avg(' + occult_sql('z', '0.1::DOUBLE') + ') - 1', 9)} AS finj FROM z GROUP BY star, cad"""


def merge(spark, sf):
    o = fixtures.read(spark, sf, "orders").select(C("o_orderkey").alias("id"), C("o_totalprice").alias("P"), "o_orderstatus")
    r = fixtures.read(spark, sf, "lineitem").where("l_quantity > 40").groupBy(C("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("P"), F.count(F.lit(1)).alias("n"))
    return inject.merge_results(o, r)


QUERIES["merge_results"] = merge
SQL["merge_results"] = """WITH r AS (SELECT l_orderkey AS id, sum(l_quantity) AS P, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT o_orderkey AS id, o_totalprice AS P_inp, o_orderstatus, r.P AS P_out, r.n FROM orders LEFT JOIN r ON r.id = o_orderkey"""


def _recovery(spark, sf):
    d = fixtures.read(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    j = d.join(fixtures.read(spark, sf, "labels"), "doc_id")
    return j.select(
        C("source").alias("star"), C("lang").alias("Pblock"), C("toxic").alias("df"), (C("quality") == 1).alias("bg"),
        (C("n_chars") / 97.0).alias("os2n"),
    )


_REC = """r AS (SELECT source AS star, lang AS Pblock, toxic AS df, quality = 1 AS bg, n_chars / 97::DOUBLE AS os2n FROM documents JOIN labels USING (doc_id))"""
QUERIES["detection_efficiency"] = lambda spark, sf: inject.detection_efficiency(_recovery(spark, sf)).select(
    "star", "Pblock", "df", "n", "n_good", r6("eta").alias("eta"), r6("err").alias("err")
)
SQL["detection_efficiency"] = f"""WITH {_REC} SELECT star, Pblock, df, count(*) AS n, count(*) FILTER (bg) AS n_good, {s6('count(*) FILTER (bg) / count(*)')} AS eta,
 {s6('1 / sqrt(count(*))')} AS err FROM r GROUP BY ALL"""
QUERIES["s2n_histogram"] = lambda spark, sf: inject.s2n_histogram(_recovery(spark, sf))
SQL["s2n_histogram"] = f"""WITH {_REC} SELECT df, bg, CAST(floor(os2n) AS BIGINT) AS bin, count(*) AS n FROM r WHERE os2n >= 0 GROUP BY ALL"""
