"""Queries: folding on candidates, labelling, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.catalog.base import DAILY_INJECTED, HOURLY_CENTRED, daily_injected, hourly_centred, r6, s6
from starfold.catalog.cleaning import medfilt_sql
from starfold.catalog.folding import N_STAGES, P1, P2, ffa_sql, indexed_sql, padded_sql
from starfold.catalog.searching import _CLIPPED, clipped
from starfold.catalog.windows import mean_depth_sql
from starfold.functions import stats
from starfold.operators import search, validate, windows
from starfold.sources import fixtures

QUERIES, SQL = {}, {}

EPH = (27.1, 12.33, 3.2)
# Flux is reported in this unit; its digits keep rounded values away from ties.
SCALE = 7_123_457.0


def candidates(df, eph=EPH):
    P, t0, tdur = eph
    return df.select("star").distinct().select("star", F.lit(P).alias("P"), F.lit(t0).alias("t0"), F.lit(tdur).alias("tdur"))


def cands(spark, sf):
    return candidates(fixtures.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("star")))


_CAND = f"cand AS (SELECT DISTINCT star, {EPH[0]}::DOUBLE AS P, {EPH[1]}::DOUBLE AS t0, {EPH[2]}::DOUBLE AS tdur FROM di)"
_BASE = f"{DAILY_INJECTED}, {_CAND}"


def shift_sql(first, P="P", t0="t0"):
    return f"(-{t0} - ceil(({first} - {t0}) / {P}) * {P})"


def pmod_sql(x, p):
    return f"(({x}) - floor(({x}) / ({p})) * ({p}))"


def phase_sql(src, out, start, keep="f, fmask"):
    """SQL of a fold on cand; columns tpf, phase, cycle."""
    return f"""{out}_a AS (SELECT s.star, cad, t, {keep}, P, t0, tdur, min(t) OVER (PARTITION BY s.star) AS t_first FROM {src} s JOIN cand ON cand.star = s.star),
{out}_b AS (SELECT *, t + {shift_sql('t_first')} AS ts FROM {out}_a),
{out} AS (SELECT *, {pmod_sql(f'ts - P * {start}', 'P')} + P * {start} AS tpf, floor(ts / P - {start}) AS cycle FROM {out}_b)"""


def label_sql(src, out, cpad, cfrac, keep="f, fmask", widen=1.0):
    """SQL labels by looking at every transit near a point."""
    reach = 0.5 + cpad + cfrac
    return f"""{out}_a AS (SELECT s.star, s.cad, s.t, {keep}, P, t0, tdur * {widen}::DOUBLE AS d, min(t) OVER (PARTITION BY s.star) AS t_first, max(t) OVER (PARTITION BY s.star) AS t_last
   FROM {src} s JOIN cand ON cand.star = s.star),
{out}_b AS (SELECT *, t + {shift_sql('t_first')} AS ts, t_last + {shift_sql('t_first')} AS tl FROM {out}_a),
{out}_k AS (SELECT star, cad, k, (ts - k * P) / d AS u FROM {out}_b, (SELECT unnest(range(2000)) AS k) WHERE k * P < tl AND abs(ts - k * P) <= ({reach} + 1) * d),
{out}_g AS (SELECT star, cad, max(k) FILTER (abs(u) < {reach}) AS id, arg_max(u, k) FILTER (abs(u) < {reach}) AS u, bool_or(abs(u) < 0.5) AS tr,
   bool_or(u > {-0.5 - cpad - cfrac}::DOUBLE AND u < {-0.5 - cpad}::DOUBLE) AS cb, bool_or(u > {0.5 + cpad}::DOUBLE AND u < {0.5 + cpad + cfrac}::DOUBLE) AS ca FROM {out}_k GROUP BY star, cad),
{out} AS (SELECT b.*, g.u, coalesce(g.id, -1) AS transit_id, coalesce(tr, false)::INT AS transit, coalesce(cb, false)::INT AS cb, coalesce(ca, false)::INT AS ca,
   coalesce(cb OR ca, false)::INT AS continuum FROM {out}_b b LEFT JOIN {out}_g g ON g.star = b.star AND g.cad = b.cad)"""


def t0_shift(spark, sf):
    x = validate.with_time_span(daily_injected(spark, sf)).join(cands(spark, sf), "star")
    s = validate.t0_shift(F.col("t_first"), F.col("P"), F.col("t0"))
    return x.select("star", r6(s).alias("shift")).distinct()


QUERIES["t0_shift"] = t0_shift
SQL["t0_shift"] = f"WITH {_BASE}, {phase_sql('di', 'p', -0.5)} SELECT DISTINCT star, {s6(shift_sql('t_first'))} AS shift FROM p"

QUERIES["phasefold"] = lambda spark, sf: validate.fold_on(daily_injected(spark, sf), cands(spark, sf)).select(
    "star", "cad", r6("t_phasefold").alias("t_phasefold"), r6("phase").alias("phase"), "cycle"
)
SQL["phasefold"] = f"WITH {_BASE}, {phase_sql('di', 'p', -0.5)} SELECT star, cad, {s6('tpf')} AS t_phasefold, {s6('tpf / P')} AS phase, cycle::BIGINT AS cycle FROM p"


def bins_sql(src, out, lo, hi, nb, x="tpf", ok="NOT fmask"):
    """SQL of right-closed phase bins; empty bins stay."""
    return f"""{out}_x AS (SELECT star, CAST(ceil(round(({x} - ({lo})) / (({hi}) - ({lo})) * ({nb}), 9)) - 1 AS BIGINT) AS bin, f FROM {src} WHERE {ok}),
{out}_s AS (SELECT star, unnest(range(CAST({nb} AS BIGINT))) AS bin, {lo} AS lo, {hi} AS hi, {nb} AS nb FROM cand),
{out} AS (SELECT s.star, s.bin, any_value(lo + (s.bin + 0.5) * (hi - lo) / nb) AS tb, count(f) AS fcount, avg(f) AS fmean, stddev_samp(f) AS fstd, median(f) AS fmed
   FROM {out}_s s LEFT JOIN {out}_x x ON x.star = s.star AND x.bin = s.bin GROUP BY s.star, s.bin)"""


def _binned(spark, sf):
    c = cands(spark, sf)
    return validate.bin_phasefold(validate.fold_on(daily_injected(spark, sf), c), validate.phase_bin_spans(c, 1.0)), c


def bin_phasefold(spark, sf):
    b, _ = _binned(spark, sf)
    return b.select(
        "star", "bin", r6("t_phasefold").alias("t_phasefold"), "fcount",
        *[r6(F.col(c) / SCALE).alias(c) for c in ("fmean", "fmed", "fstd", "ferr")],
    )


_BIN = bins_sql("p", "bn", "P * -0.5", "P * 0.5", "(round_even(P, 0) - 1)")
QUERIES["bin_phasefold"] = bin_phasefold
SQL["bin_phasefold"] = f"""WITH {_BASE}, {phase_sql('di', 'p', -0.5)}, {_BIN.replace('FROM p WHERE', 'FROM p WHERE')}
SELECT star, bin, {s6('tb')} AS t_phasefold, fcount, {s6('fmean / 7123457e0')} AS fmean, {s6('fmed / 7123457e0')} AS fmed, {s6('fstd / 7123457e0')} AS fstd,
 {s6('fstd / sqrt(nullif(fcount, 0)) / 7123457e0')} AS ferr FROM bn"""


def label_transit(spark, sf):
    x = validate.label_transit(daily_injected(spark, sf), cands(spark, sf))
    return x.select("star", "cad", "transit_id", "transit", "continuum", "continuum_before", "continuum_after")


QUERIES["label_transit"] = label_transit
SQL["label_transit"] = f"""WITH {_BASE}, {label_sql('di', 'l', 0.5, 3.0)}
SELECT star, cad, transit_id, transit, continuum, cb AS continuum_before, ca AS continuum_after FROM l"""


def detrend_sql(src, out, cpad, cfrac, min_continuum):
    return f"""{label_sql(src, out + '_l', cpad, cfrac)},
{out}_v AS (SELECT * FROM {out}_l WHERE transit_id >= 0 AND NOT fmask),
{out}_c AS (SELECT star, transit_id, regr_slope(f, u) FILTER (continuum = 1) AS m, regr_intercept(f, u) FILTER (continuum = 1) AS c FROM {out}_v
   GROUP BY star, transit_id HAVING sum(cb) > {min_continuum} AND sum(ca) > {min_continuum}),
{out} AS (SELECT v.* REPLACE (f - (m * u + c) AS f) FROM {out}_v v JOIN {out}_c USING (star, transit_id))"""


def local_detrend(spark, sf):
    x = validate.local_detrend(daily_injected(spark, sf), cands(spark, sf), 1, 2, 0.0, 2.0)
    return x.select("star", "cad", "transit_id", r6(F.col("f") / SCALE).alias("f"))


QUERIES["local_detrend"] = local_detrend
SQL["local_detrend"] = f"WITH {_BASE}, {detrend_sql('di', 'dt', 0.0, 2.0, 2)} SELECT star, cad, transit_id, {s6('f / 7123457e0')} AS f FROM dt"


def local_detrend_cubic(spark, sf):
    x = validate.local_detrend(daily_injected(spark, sf), cands(spark, sf), 3)
    return x.select("star", "cad", "transit_id", r6(F.col("f") / SCALE).alias("f"))


QUERIES["local_detrend_cubic"] = local_detrend_cubic


def phase_fold_detrended(spark, sf):
    d, c = daily_injected(spark, sf), cands(spark, sf)
    a = validate.phase_fold_detrended(d, c, cadence=1.0).withColumn("ph", F.lit(0))
    b = validate.phase_fold_detrended(d, c, 180.0, cadence=1.0).withColumn("ph", F.lit(180))
    return a.unionByName(b).select("star", "ph", "t", r6("tPF").alias("tPF"), r6(F.col("f") / SCALE).alias("f"))


def _pfd(out, ph, first="di"):
    d = detrend_sql(first, out, 1.0, 3.0, 4).replace("JOIN cand ON", f"JOIN (SELECT star, P, tdur, t0 + P * {ph / 360.0}::DOUBLE AS t0 FROM cand) cand ON")
    return f"""{d},
{out}_f AS (SELECT star, {ph} AS ph, t, {pmod_sql('ts + P / 2', 'P')} - P / 2 + 1 AS tPF, f FROM {out})"""


QUERIES["phase_fold_detrended"] = phase_fold_detrended
SQL["phase_fold_detrended"] = f"""WITH {_BASE}, {_pfd('x0', 0)}, {_pfd('x180', 180)}
SELECT star, ph, t, {s6('tPF')} AS tPF, {s6('f / 7123457e0')} AS f FROM (SELECT * FROM x0_f UNION ALL SELECT * FROM x180_f)"""


def single_events(spark, sf):
    ses, head = validate.single_event_table(daily_injected(spark, sf), cands(spark, sf), 3)
    return ses.join(head, "star").select(
        "star", "tnum", "t", r6(F.col("ses") / SCALE).alias("ses"), "num_trans",
        r6(F.col("ses_even") / SCALE).alias("ses_even"), r6(F.col("ses_odd") / SCALE).alias("ses_odd"), "ses_0",
    )


_SES = f"""{_BASE}, {mean_depth_sql('di', 'md', (3,))}, {label_sql('md', 'l', 0.5, 3.0, 'd AS ses')},
ses AS (SELECT star, transit_id AS tnum, ses, t FROM l WHERE transit_id >= 0 QUALIFY row_number() OVER (PARTITION BY star, transit_id ORDER BY abs(u), t) = 1)"""
QUERIES["single_event_table"] = single_events
SQL["single_event_table"] = f"""WITH {_SES}
SELECT star, tnum, t, {s6('ses / 7123457e0')} AS ses, count(*) OVER (PARTITION BY star) AS num_trans,
 {s6('median(CASE WHEN tnum % 2 = 0 THEN ses END) OVER (PARTITION BY star) / 7123457e0')} AS ses_even,
 {s6('median(CASE WHEN tnum % 2 = 1 THEN ses END) OVER (PARTITION BY star) / 7123457e0')} AS ses_odd, -99::DOUBLE AS ses_0 FROM ses"""


def robust_snr(spark, sf):
    d = daily_injected(spark, sf)
    ses, _ = validate.single_event_table(d, cands(spark, sf), 3)
    noise = windows.noise_per_duration(windows.mean_depth(d, (3,))).select("star", "noise")
    return validate.robust_snr(ses, noise).select("star", r6("clip_snr").alias("clip_snr"), r6("med_snr").alias("med_snr"))


QUERIES["robust_snr"] = robust_snr
SQL["robust_snr"] = f"""WITH {_SES}, n AS (SELECT star, median(abs(d)) AS noise FROM md GROUP BY star),
r AS (SELECT *, row_number() OVER (PARTITION BY star ORDER BY ses DESC, tnum) AS rn FROM ses WHERE ses IS NOT NULL)
SELECT star, {s6('avg(ses) FILTER (rn > 3) / any_value(noise) * sqrt(count(*))')} AS clip_snr, {s6('median(ses) / any_value(noise) * sqrt(count(*))')} AS med_snr
FROM r JOIN n USING (star) GROUP BY star"""


def bin_folded(spark, sf):
    f = validate.phase_fold_detrended(daily_injected(spark, sf), cands(spark, sf), cadence=1.0)
    b = validate.bin_folded(f, 720.0)
    return b.select("star", "bin", "count", r6("tb").alias("tb"), *[r6(F.col(c) / SCALE).alias(c) for c in ("mean", "std", "med")])


QUERIES["bin_folded"] = bin_folded
SQL["bin_folded"] = f"""WITH {_BASE}, {_pfd('x0', 0)},
m AS (SELECT *, min(tPF) OVER w - 0.001::DOUBLE AS lo, max(tPF) OVER w AS hi, greatest(round_even((max(tPF) OVER w - min(tPF) OVER w) / 0.5, 0), 1) AS nb FROM x0_f WINDOW w AS (PARTITION BY star)),
b AS (SELECT *, CAST(ceil(round((tPF - lo) / (hi - lo) * nb, 9)) - 1 AS BIGINT) AS bin FROM m)
SELECT star, bin, count(f) AS count, {s6('any_value(lo + (bin + 0.5) * (hi - lo) / nb)')} AS tb, {s6('avg(f) / 7123457e0')} AS mean, {s6('stddev_samp(f) / 7123457e0')} AS std, {s6('median(f) / 7123457e0')} AS med
FROM b GROUP BY star, bin HAVING stddev_samp(f) IS NOT NULL"""


def norm_by_median(spark, sf):
    x = validate.norm_by_median_filter(daily_injected(spark, sf), cands(spark, sf), 3)
    return x.select("star", "nbpt", "bin", "n", r6("t").alias("t"), r6(F.col("f") / SCALE).alias("f"))


QUERIES["norm_by_median_filter"] = norm_by_median
SQL["norm_by_median_filter"] = f"""WITH {_BASE}, {medfilt_sql('di', 'mf', 'f', 9)}, mm AS (SELECT * REPLACE (CASE WHEN NOT fmask THEN f - mf END AS f) FROM mf),
{phase_sql('mm', 'p', -0.25)},
l AS (SELECT *, min(tpf) OVER w AS lo, max(tpf) OVER w AS hi FROM p WINDOW w AS (PARTITION BY star)),
k AS (SELECT *, round_even((hi - lo) / tdur * nbpt, 0) AS nb FROM l, (SELECT unnest([1, 5]) AS nbpt)),
b AS (SELECT *, CAST(least(floor(round((tpf - lo) / (hi - lo) * nb, 9)), nb - 1) AS BIGINT) AS bin FROM k WHERE f IS NOT NULL)
SELECT star, nbpt, bin, count(f) AS n, {s6('any_value(lo + (bin + 0.5) * ((hi - lo) / nb))')} AS t, {s6('avg(f) / 7123457e0')} AS f FROM b GROUP BY star, nbpt, bin"""


def autocorr(spark, sf):
    b, c = _binned(spark, sf)
    auto, head = validate.autocorr(b, c, 1.0)
    return auto.join(head, "star").select(
        "star", "i_shift", r6("t_shift").alias("t_shift"), r6(F.col("autocorr") / SCALE**2).alias("autocorr"), r6("autor").alias("autor")
    )


QUERIES["autocorr"] = autocorr
SQL["autocorr"] = f"""WITH {_BASE}, {phase_sql('di', 'p', -0.5)}, {_BIN},
n AS (SELECT star, count(*) AS n, arg_min(tb, bin) AS t0, (max(tb) - min(tb)) / (count(*) - 1) AS dt FROM bn GROUP BY star),
a AS (SELECT x.star, (y.bin - x.bin + n) % n AS lag, sum(coalesce(x.fmed, 0) * coalesce(y.fmed, 0)) AS ac, any_value(n) AS n, any_value(dt) AS dt
   FROM bn x JOIN bn y ON x.star = y.star JOIN n ON n.star = x.star GROUP BY 1, 2),
s AS (SELECT star, {pmod_sql('lag + n / 2', 'n')} - n / 2 AS i, ac, dt FROM a),
r AS (SELECT star, max(ac) FILTER (abs(i * dt) > {EPH[2]}) / max(ac) AS autor FROM s GROUP BY star)
SELECT s.star, i AS i_shift, {s6('i * dt')} AS t_shift, {s6('ac / 7123457e0 / 7123457e0')} AS autocorr, {s6('autor')} AS autor FROM s JOIN r USING (star)"""


def hist_bin_avg(spark, sf):
    d = fixtures.read(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", F.round(F.col("l_discount") * 100).alias("y"))
    a = validate.hist_bin_avg(d, "l_extendedprice", "y", 0.0, 110000.0, 1000, ("l_returnflag",), ymax=F.max)
    return a.select("l_returnflag", "bin", r6("x").alias("x"), r6("y").alias("y"), "ymax")


QUERIES["hist_bin_avg"] = hist_bin_avg
SQL["hist_bin_avg"] = f"""WITH b AS (SELECT l_returnflag, CAST(least(floor(round(l_extendedprice / 110000::DOUBLE * 1000, 9)), 999) AS BIGINT) AS bin, round(l_discount * 100) AS y FROM lineitem
 WHERE l_extendedprice BETWEEN 0 AND 110000)
SELECT l_returnflag, bin, {s6('(bin + 0.5) * 110::DOUBLE')} AS x, {s6('avg(y)')} AS y, max(y) AS ymax FROM b GROUP BY l_returnflag, bin"""


def scar(spark, sf):
    p = clipped(spark, sf).withColumn("t0cad", F.col("t0"))
    return validate.scar(p.select("star", "Pcad", "t0cad", "s2n")).select("star", r6("scar").alias("scar"))


QUERIES["scar"] = scar
SQL["scar"] = f"""WITH {_CLIPPED}, c AS (SELECT *, quantile_cont(s2n, 0.9) OVER (PARTITION BY star) AS q FROM pg),
p AS (SELECT star, (pcad - min(pcad) OVER w) / (max(pcad) OVER w - min(pcad) OVER w) AS x, t0 / pcad AS y, row_number() OVER () AS r FROM c WHERE s2n > q WINDOW w AS (PARTITION BY star)),
d AS (SELECT a.star, a.r, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM p a JOIN p b ON a.star = b.star AND a.r <> b.r GROUP BY ALL)
SELECT star, {s6('quantile_cont(d, 0.9)')} AS scar FROM d GROUP BY star"""


def harmonics(spark, sf):
    d = windows.mean_depth(daily_injected(spark, sf), (3,))
    h = validate.check_harmonics(d, cands(spark, sf))
    return h.select("star", r6("harm").alias("harm"), r6(F.col("mes") / SCALE).alias("mes"), r6("ratio").alias("ratio"), "best")


QUERIES["check_harmonics"] = harmonics
SQL["check_harmonics"] = f"""WITH {_BASE}, {mean_depth_sql('di', 'md', (3,))}, {indexed_sql('md', 'ix', 't, d')},
h AS (SELECT DISTINCT c.star, harm, hk, P * harm / ((tb) / ni) AS pc FROM cand c JOIN (SELECT star, max(t) - min(t) AS tb, max(i) - min(i) AS ni FROM ix GROUP BY star) s USING (star),
  (SELECT unnest([1::DOUBLE, 1/2::DOUBLE, 1/3::DOUBLE, 2::DOUBLE, 3::DOUBLE]) AS harm, unnest([1, 2, 3, 4, 5]) AS hk) WHERE P * harm < tb / 3),
w AS (SELECT ix.star, hk, harm, d, floor(pc)::BIGINT AS b, i // floor(pc)::BIGINT AS row, i % floor(pc)::BIGINT AS c0, round_even(floor(pc) * (pc - floor(pc)), 0) AS rem, ncad // floor(pc)::BIGINT AS nr FROM ix JOIN h USING (star)),
g AS (SELECT star, hk, harm, CAST((c0 - round_even(row * (rem / nr), 0) + 1000 * b) % b AS BIGINT) AS col, avg(d) AS m, count(d) AS c FROM w GROUP BY ALL),
e AS (SELECT star, hk, harm, max(m * sqrt(c)) AS mes FROM g GROUP BY ALL),
r AS (SELECT *, mes / max(CASE WHEN hk = 1 THEN mes END) OVER (PARTITION BY star) AS ratio FROM e)
SELECT star, {s6('harm')} AS harm, {s6('mes / 7123457e0')} AS mes, {s6('ratio')} AS ratio, row_number() OVER (PARTITION BY star ORDER BY ratio DESC, hk) = 1 AS best FROM r"""

KTW = (2, 3, 5)
KNOWN = (23.4 / 24, 0.31, 3.3 / 24)


def s2n_known(spark, sf):
    h = hourly_centred(spark, sf)
    k = h.select("star").distinct().select("star", F.lit(KNOWN[0]).alias("P"), F.lit(KNOWN[1]).alias("phase"), F.lit(KNOWN[2]).alias("tdur"))
    return validate.s2n_known(h, k, KTW, (P1, P2)).select(
        "star", "twd_close", r6("P_close").alias("P_close"), r6("phase_close").alias("phase_close"), r6("s2n_close").alias("s2n_close")
    )


QUERIES["s2n_known"] = s2n_known
SQL["s2n_known"] = f"""WITH {HOURLY_CENTRED}, {mean_depth_sql('hc', 'md', (3,))}, {indexed_sql('md', 'ix', 't, d')},
{padded_sql('ix', 'pd', P1, P2, 'd', 'd IS NOT NULL')}, {ffa_sql('pd', 'ff', P1, P2, N_STAGES)},
cad AS (SELECT star, min(t) AS t_first, (max(t) - min(t)) / max(i) AS dt FROM ix GROUP BY star),
n AS (SELECT star, median(abs(d)) AS noise FROM md GROUP BY star),
j AS (SELECT ff.*, dt, t_first, noise FROM ff JOIN cad USING (star) JOIN n USING (star) WHERE P0 = floor({KNOWN[0]!r}::DOUBLE / dt)),
r AS (SELECT star, arg_min(row, abs(pcad - {KNOWN[0]!r}::DOUBLE / dt)) AS row FROM (SELECT * FROM j ORDER BY row) GROUP BY star),
z AS (SELECT j.*, {pmod_sql('t_first + col * dt', 'pcad * dt')} / (pcad * dt) AS ph FROM j JOIN r ON r.star = j.star AND r.row = j.row)
SELECT star, 3 AS twd_close, {s6('pcad * dt')} AS P_close, {s6('ph')} AS phase_close, {s6('s / n / noise * sqrt(n)')} AS s2n_close FROM z
QUALIFY row_number() OVER (PARTITION BY star ORDER BY least(abs(ph - {KNOWN[1]}), 1 - abs(ph - {KNOWN[1]})), col) = 1"""


def expected(spark, sf):
    h = hourly_centred(spark, sf)
    e = h.select("star").distinct().select("star", F.lit(1.37).alias("P"), F.lit(0.77).alias("epoch"))
    return validate.expected_transits(h, e)


QUERIES["expected_transits"] = expected
SQL["expected_transits"] = f"""WITH {HOURLY_CENTRED}, s AS (SELECT star, min(t) AS a, max(t) AS b FROM hc GROUP BY star),
w AS (SELECT star, unnest(range(CAST(floor((0.77::DOUBLE - a) / 1.37::DOUBLE) AS BIGINT), CAST(floor((b - 0.77::DOUBLE) / 1.37::DOUBLE) AS BIGINT) + 1)) AS k FROM s),
n AS (SELECT w.star, k, abs(t - (0.77::DOUBLE + k * 1.37::DOUBLE)) AS dt, fmask FROM w JOIN hc ON hc.star = w.star
   QUALIFY row_number() OVER (PARTITION BY w.star, k ORDER BY abs(t - (0.77::DOUBLE + k * 1.37::DOUBLE)), t) = 1)
SELECT star, k, dt < 0.3 AND NOT fmask AS seen FROM n"""

QUERIES["ses_stack"] = lambda spark, sf: validate.ses_stack(daily_injected(spark, sf), cands(spark, sf), 3).select(
    "star", "cycle", r6("phase").alias("phase"), r6(F.col("d") / SCALE).alias("d")
)
SQL["ses_stack"] = f"""WITH {_BASE}, {mean_depth_sql('di', 'md', (3,))}, {phase_sql('md', 'p', -0.25, 'd')}
SELECT star, cycle::BIGINT AS cycle, {s6('tpf / P')} AS phase, {s6('d / 7123457e0')} AS d FROM p"""

QUERIES["phasefold_shifted"] = lambda spark, sf: validate.phasefold_shifted(daily_injected(spark, sf), cands(spark, sf), 0.3, 1.0).select(
    "star", "bin", r6("t_phasefold").alias("t_phasefold"), "fcount", r6(F.col("fmed") / SCALE).alias("fmed")
)
_SHIFTED = phase_sql("di", "p", -0.25).replace("JOIN cand ON", "JOIN (SELECT star, P, tdur, t0 + P * 0.3::DOUBLE AS t0 FROM cand) cand ON")
SQL["phasefold_shifted"] = f"""WITH {_BASE}, {_SHIFTED}, {bins_sql('p', 'bn', 'P * -0.25', 'P * 0.75', '(round_even(P, 0) - 1)')}
SELECT star, bin, {s6('tb')} AS t_phasefold, fcount, {s6('fmed / 7123457e0')} AS fmed FROM bn WHERE fcount > 0"""

QUERIES["robust_limits"] = lambda spark, sf: validate.robust_limits(hourly_centred(spark, sf).where("NOT fmask"), "f", 5, 0.5).select(
    "star", r6("lo").alias("lo"), r6("hi").alias("hi")
)
SQL["robust_limits"] = f"""WITH {HOURLY_CENTRED}, q AS (SELECT star, quantile_cont(f, 0.05) AS a, quantile_cont(f, 0.95) AS b FROM hc WHERE NOT fmask GROUP BY star)
SELECT star, {s6('a - (b - a) * 0.5::DOUBLE')} AS lo, {s6('b + (b - a) * 0.5::DOUBLE')} AS hi FROM q"""


def rebin(spark, sf):
    x = validate.label_transit(daily_injected(spark, sf).where("NOT fmask"), cands(spark, sf)).where("transit_id >= 0")
    s = x.select("star", "transit_id", (F.col("u") * F.col("tdur")).alias("x"), F.col("f").alias("y"))
    return validate.rebin_transits(s, 5, 1.0).select("star", "grp", "bin", "n", r6("x").alias("x"), r6(F.col("y") / SCALE).alias("y"))


QUERIES["rebin_transits"] = rebin
SQL["rebin_transits"] = f"""WITH {_BASE}, {label_sql('(SELECT * FROM di WHERE NOT fmask)', 'l', 0.5, 3.0)},
x AS (SELECT star, transit_id, u * d AS x, f AS y, dense_rank() OVER (PARTITION BY star ORDER BY transit_id) - 1 AS k FROM l WHERE transit_id >= 0),
g AS (SELECT *, k // 5 AS grp FROM (SELECT *, max(k) OVER (PARTITION BY star) + 1 AS n FROM x) WHERE (k // 5 + 1) * 5 < n),
b AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w + 0.0001::DOUBLE AS hi, floor(round((max(x) OVER w + 0.0001::DOUBLE - min(x) OVER w), 9)) AS nb FROM g WINDOW w AS (PARTITION BY star, grp)),
i AS (SELECT *, CAST(least(floor(round((x - lo) / (hi - lo) * nb, 9)), nb - 1) AS BIGINT) AS bin FROM b)
SELECT star, grp, bin, count(y) AS n, {s6('any_value(lo + (bin + 0.5) * ((hi - lo) / nb))')} AS x, {s6('avg(y) / 7123457e0')} AS y FROM i GROUP BY star, grp, bin"""
