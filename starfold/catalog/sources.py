"""Queries: sources, sinks and table movement."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from starfold.catalog.base import DAILY, ENSEMBLE, HOURLY, HOURLY_DENSE, hourly_dense, r6, s6
from starfold.functions import stats
from starfold.session import checkpoint_dir
from starfold.sources import fixtures, lightcurves, store

QUERIES, SQL = {}, {}


def _path(spark):
    return f"{checkpoint_dir(spark)}/starfold-{uuid.uuid4().hex}"


def load_lc(spark, sf):
    path = _path(spark)
    fixtures.hourly(spark, sf).write.parquet(path)
    df = lightcurves.load_lc(spark, path)
    return df.select("star", "cad", r6("t").alias("t"), "f", r6("ferr").alias("ferr"), "fmask", "quality", "quarter")


QUERIES["load_lc"] = load_lc
SQL["load_lc"] = f"WITH {HOURLY} SELECT star, cad, {s6('t')} AS t, f, {s6('ferr')} AS ferr, fmask, quality, quarter FROM hourly"


def load_lc_csv(spark, sf):
    path = _path(spark)
    fixtures.daily(spark, sf).select(*[f.name for f in lightcurves.LC]).write.option("header", "true").csv(path)
    return lightcurves.load_lc(spark, path, "csv").groupBy("star").agg(
        F.count("f").alias("n"), F.sum("f").alias("total"), F.max("quarter").alias("last_quarter")
    )


QUERIES["load_lc_csv"] = load_lc_csv
SQL["load_lc_csv"] = f"WITH {DAILY} SELECT star, COUNT(f) AS n, SUM(f) AS total, MAX(quarter) AS last_quarter FROM daily GROUP BY star"


def load_params(spark, sf):
    path = _path(spark)
    h = fixtures.hourly(spark, sf)
    h.groupBy("star").agg((F.max("cad") / 40).alias("P1"), (F.max("cad") / 20).alias("P2")).write.parquet(f"{path}/grid")
    p = lightcurves.load_params(spark, path, "grid")
    return (
        lightcurves.with_params(h, p)
        .where((F.col("cad") >= F.col("P1")) & (F.col("cad") < F.col("P2")))
        .groupBy("star")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("total"), r6(F.min("P1")).alias("P1"))
    )


QUERIES["load_params"] = load_params
SQL["load_params"] = f"""WITH {HOURLY}, p AS (SELECT star, max(cad) / 40::DOUBLE AS P1, max(cad) / 20::DOUBLE AS P2 FROM hourly GROUP BY star)
SELECT star, COUNT(*) AS n, SUM(f) AS total, {s6('min(P1)')} AS P1 FROM hourly JOIN p USING (star)
WHERE cad >= P1 AND cad < P2 GROUP BY star"""


def _quarter_files(spark, sf):
    """The hourly series as one file per star and quarter."""
    path = _path(spark)
    fixtures.hourly(spark, sf).withColumns({"s": F.col("star"), "q": F.col("quarter")}).repartition("s", "q").write.partitionBy("s", "q").parquet(path)
    return path


def load_quarters(spark, sf):
    df = lightcurves.load_quarters(spark, [_quarter_files(spark, sf)], ["star", "quarter", "cad", "f"])
    return df.groupBy("star", "quarter").agg(
        F.count(F.lit(1)).alias("n"), F.min("cad").alias("first_cad"), F.sum("f").alias("total")
    )


QUERIES["load_quarters"] = load_quarters
SQL["load_quarters"] = f"WITH {HOURLY} SELECT star, quarter, COUNT(*) AS n, MIN(cad) AS first_cad, SUM(f) AS total FROM hourly GROUP BY star, quarter"


def clean_columns(spark, sf):
    h = fixtures.hourly(spark, sf)
    raw = h.select(
        "star", "quarter",
        F.when(F.col("cad") % 11 != 5, F.col("t")).otherwise(F.lit(float("nan"))).alias("TIME"),
        F.col("cad").alias("CADENCENO"),
        F.col("f").alias("SAP_FLUX"), F.col("ferr").alias("SAP_FLUX_ERR"),
        (F.col("f") * 2 + 7).alias("PDCSAP_FLUX"), (F.col("ferr") * 2).alias("PDCSAP_FLUX_ERR"),
        F.col("quality").alias("SAP_QUALITY"), F.lit(0.0).alias("TIMECORR"), F.lit(0.0).alias("SAP_BKG"),
    )
    x = lightcurves.clean_columns(raw)
    return x.select("star", "cad", "quarter", "quality", *[r6(c).alias(c) for c in ("t", "f", "ef", "fpdc", "efpdc")])


QUERIES["clean_columns"] = clean_columns
SQL["clean_columns"] = f"""WITH {HOURLY}, m AS (
  SELECT *, median(f) OVER (PARTITION BY star, quarter) AS m1, median(f * 2 + 7) OVER (PARTITION BY star, quarter) AS m2,
         CASE WHEN cad % 11 <> 5 THEN t END AS tt FROM hourly),
b AS (SELECT *, arg_max(cad, cad) FILTER (tt IS NOT NULL) OVER up AS xl, last_value(tt IGNORE NULLS) OVER up AS yl,
         first_value(tt IGNORE NULLS) OVER dn AS yr, min(CASE WHEN tt IS NOT NULL THEN cad END) OVER dn AS xr
      FROM m WINDOW up AS (PARTITION BY star ORDER BY cad ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    dn AS (PARTITION BY star ORDER BY cad ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT star, list(struct_pack(x := cad, y := tt) ORDER BY cad) AS l, list(struct_pack(x := cad, y := tt) ORDER BY cad DESC) AS d
      FROM m WHERE tt IS NOT NULL GROUP BY star)
SELECT star, cad, quarter, quality,
  {s6('''CASE WHEN tt IS NOT NULL THEN tt
       WHEN yl IS NOT NULL AND yr IS NOT NULL THEN yl + (yr - yl) * (cad - xl) / (xr - xl)
       WHEN yl IS NOT NULL THEN d[1].y + (d[1].y - d[2].y) * (cad - d[1].x) / (d[1].x - d[2].x)
       ELSE l[1].y + (l[2].y - l[1].y) * (cad - l[1].x) / (l[2].x - l[1].x) END''')} AS t,
  {s6('f / nullif(m1, 0) - 1')} AS f, {s6('ferr / nullif(m1, 0)')} AS ef,
  {s6('(f * 2 + 7) / nullif(m2, 0) - 1')} AS fpdc, {s6('ferr * 2 / nullif(m2, 0)')} AS efpdc
FROM b JOIN g USING (star)"""


def stack(spark, sf):
    h, d = fixtures.hourly(spark, sf), fixtures.daily(spark, sf)
    return lightcurves.stack(h, d).groupBy("star", "quarter").agg(
        F.count(F.lit(1)).alias("n"), F.sum("f").alias("total")
    )


QUERIES["stack"] = stack
SQL["stack"] = f"""WITH {HOURLY}, {DAILY}
SELECT star, quarter, COUNT(*) AS n, SUM(f) AS total FROM (SELECT * FROM hourly UNION ALL SELECT * FROM daily) GROUP BY star, quarter"""


def split_by_star(spark, sf):
    path = _path(spark)
    lightcurves.split_by_star(fixtures.daily(spark, sf), path, files_per_star=4)
    return spark.read.option("recursiveFileLookup", "false").parquet(path).groupBy(
        F.col("star_id").cast("string").alias("star_id")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("total"))


QUERIES["split_by_star"] = split_by_star
SQL["split_by_star"] = f"WITH {DAILY} SELECT lpad(star, 9, '0') AS star_id, COUNT(*) AS n, SUM(f) AS total FROM daily GROUP BY star"


def modal_length(spark, sf):
    """Over files of which one is broken and one is empty: both are reported, the others load."""
    path = _quarter_files(spark, sf)
    spark.range(1).select(F.lit("not a light curve").alias("value")).coalesce(1).write.text(f"{path}/s=broken")
    fixtures.hourly(spark, sf).where("false").coalesce(1).write.parquet(f"{path}/s=empty")
    lc, bad = lightcurves.load_folder(spark, path)
    good, rest = lightcurves.modal_length(lc)
    a = good.groupBy("star").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(True))
    files = bad.select(F.regexp_extract("file", "/s=([^/]+)/", 1).alias("star"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("kept"))
    return a.unionByName(rest.withColumn("kept", F.lit(False))).unionByName(files)


QUERIES["modal_length_filter"] = modal_length
SQL["modal_length_filter"] = f"""WITH {HOURLY}, c AS (SELECT star, COUNT(*) AS n FROM hourly GROUP BY star),
b AS (SELECT n AS e FROM c GROUP BY n ORDER BY COUNT(*) DESC, n LIMIT 1)
SELECT star, n, n = (SELECT e FROM b) AS kept FROM c UNION ALL SELECT 'broken', 0, false UNION ALL SELECT 'empty', 0, false"""


def _headers(spark, sf):
    per = fixtures.hourly(spark, sf).groupBy("star").agg(
        F.count("f").alias("n"), F.sum("f").alias("s"), F.max("cad").alias("c")
    )
    one = store.header_rows(per, {"n": (F.col("n"), "rows"), "total": (F.col("s"), "sum")}, 1)
    two = store.header_rows(per.where("n % 2 = 0"), {"n": (-F.col("n"), "negated"), "last": (F.col("c"), "last")}, 2)
    return one, two


def result_store(spark, sf):
    one, two = _headers(spark, sf)
    return store.upsert_header(one, two)


QUERIES["result_header_upsert"] = result_store
_HEADERS = HOURLY + """, per AS (SELECT star, COUNT(f) AS n, SUM(f) AS s, MAX(cad) AS c FROM hourly GROUP BY star),
hd0 AS (SELECT star, 'n' AS name, n::DOUBLE AS value, 'rows' AS description, 1 AS seq FROM per
  UNION ALL SELECT star, 'total', s, 'sum', 1 FROM per
  UNION ALL SELECT star, 'n', -n::DOUBLE, 'negated', 2 FROM per WHERE n % 2 = 0
  UNION ALL SELECT star, 'last', c::DOUBLE, 'last', 2 FROM per WHERE n % 2 = 0),
header AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY star, name ORDER BY seq DESC) AS rn FROM hd0) WHERE rn = 1)"""
SQL["result_header_upsert"] = f"WITH {_HEADERS} SELECT star, name, value, description, seq FROM header"


def result_tables(spark, sf):
    h = fixtures.hourly(spark, sf)
    st = store.ResultStore(spark, _path(spark))
    st.update_table("lc", h.select("star", "cad", "f"), 1)
    st.update_table("lc", h.where("star < 'm' AND quarter = 1").select("star", "cad", (-F.col("f")).alias("f")), 2)
    return st.table("lc").groupBy("star").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("total"))


QUERIES["result_table_upsert"] = result_tables
SQL["result_table_upsert"] = f"""WITH {HOURLY}, two AS (SELECT star, cad, -f AS f FROM hourly WHERE star < 'm' AND quarter = 1),
u AS (SELECT star, cad, f FROM hourly WHERE star NOT IN (SELECT star FROM two) UNION ALL SELECT * FROM two)
SELECT star, COUNT(*) AS n, SUM(f) AS total FROM u GROUP BY star"""


def candidate_sink(spark, sf):
    one, two = _headers(spark, sf)
    a = one.withColumn("candidate", F.lit(1))
    b = two.withColumn("candidate", F.lit(1))
    path = _path(spark)
    store.append_candidates(store.candidate_rows(a, b, ["n", "total"], ["n", "last"]), path)
    return spark.read.parquet(path)


QUERIES["candidate_sink"] = candidate_sink
SQL["candidate_sink"] = f"""WITH {_HEADERS}
SELECT star, 1 AS candidate, max(value) FILTER (name = 'n' AND seq = 1) AS n, max(value) FILTER (name = 'total' AND seq = 1) AS total,
 max(value) FILTER (name = 'n' AND seq = 2) AS fit_n, max(value) FILTER (name = 'last' AND seq = 2) AS fit_last FROM hd0 GROUP BY star"""


def scrape(spark, sf):
    one, two = _headers(spark, sf)
    path = _path(spark)
    store.scrape_csv(fixtures.hourly(spark, sf).select("star").distinct(), store.upsert_header(one, two), ["n", "last", "absent"], path)
    return spark.read.schema("star STRING, n DOUBLE, last DOUBLE, absent DOUBLE").option("header", "true").csv(path)


QUERIES["scrape_csv"] = scrape
SQL["scrape_csv"] = f"""WITH {_HEADERS} SELECT star, max(value) FILTER (name = 'n') AS n, max(value) FILTER (name = 'last') AS last,
 CAST(NULL AS DOUBLE) AS absent FROM header GROUP BY star"""


def subsample(spark, sf):
    e = fixtures.ensemble(spark, sf).select("star")
    d = fixtures.read(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("star")
    )
    return lightcurves.subsample_stars(e, d, 7, seed=3)


QUERIES["subsample_stars"] = subsample
SQL["subsample_stars"] = f"""WITH {ENSEMBLE} SELECT star FROM (SELECT DISTINCT star FROM ensemble WHERE star IN
 (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') FROM supplier WHERE s_acctbal > 0)) ORDER BY md5('3:' || star) LIMIT 7"""


def stage_checkpoint(spark, sf):
    path = _path(spark)
    build = lambda: hourly_dense(spark, sf)
    store.stage(spark, path, build)
    return store.stage(spark, path, build).groupBy("star").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("fmask").alias("masked")
    )


QUERIES["stage_checkpoint"] = stage_checkpoint
SQL["stage_checkpoint"] = f"WITH {HOURLY_DENSE} SELECT star, COUNT(*) AS n, COUNT(*) FILTER (fmask) AS masked FROM hd GROUP BY star"


def keywords(spark, sf):
    d = fixtures.ensemble(spark, sf).groupBy("star").agg(F.sum("f").alias("total"))
    meta = fixtures.read(spark, sf, "nation").select(
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("star"), "n_name", "n_regionkey"
    )
    return lightcurves.attach_keywords(d, meta)


QUERIES["attach_keywords"] = keywords
SQL["attach_keywords"] = f"""WITH {ENSEMBLE} SELECT e.star, e.total, n_name, n_regionkey FROM (SELECT star, SUM(f) AS total FROM ensemble GROUP BY star) e
LEFT JOIN nation ON lpad(CAST(n_nationkey AS VARCHAR), 2, '0') = e.star"""


def id_from_name(spark, sf):
    from starfold.functions import scalars

    s = fixtures.read(spark, sf, "supplier")
    return s.select("s_suppkey", scalars.id_from_name("s_name").alias("id"))


QUERIES["id_from_name"] = id_from_name
SQL["id_from_name"] = "SELECT s_suppkey, lpad(regexp_extract(s_name, '(\\d+)', 1), 9, '0') AS id FROM supplier"
