"""Distributed structures against brute force, and what their plans must not hold."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starfold import session
from starfold.functions import models
from starfold.operators import boxes, clean, ensemble, fit, fold, search, validate
from starfold.plans import stages
from starfold.sources import lightcurves


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_of_any_k(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 9, (25, 6)).astype(float)
    v[rng.random(v.shape) < 0.2] = np.nan
    rows = [("a", i, j, None if np.isnan(v[i, j]) else float(v[i, j])) for i in range(25) for j in range(6)]
    df = spark.createDataFrame(rows, "star STRING, row BIGINT, col BIGINT, d DOUBLE")
    for k in range(5):
        g, _ = fold.cumsum_top(df, ["star"], ["col"], F.col("d"), F.col("row"), 25, k=k)
        for r in g.collect():
            x = np.sort(v[:, r["col"]][~np.isnan(v[:, r["col"]])])
            assert [(r[f"s{j}"], r[f"c{j}"]) for j in range(k + 1)] == [(x[: len(x) - j].sum(), len(x) - j) for j in range(k + 1)]


def folded_table(spark, n=24, seed=1):
    rng = np.random.default_rng(seed)
    c, s = rng.integers(0, 5, n), rng.integers(-9, 9, n).astype(float)
    ss = s**2 + rng.integers(0, 5, n)
    df = spark.createDataFrame([("a", 7.0, j, int(c[j]), float(s[j]), float(ss[j])) for j in range(n)], "star STRING, Pcad DOUBLE, col BIGINT, c BIGINT, s DOUBLE, ss DOUBLE")
    return df, c, s, ss


@pytest.mark.parametrize("wrap", [True, False])
def test_boxes_of_all_widths(spark, wrap):
    n = 24
    df, c, s, ss = folded_table(spark, n)
    got = {(r["col"], r["width"]): (r["c"], r["s"], r["ss"], r["N"]) for r in boxes.box_sums(df, ["star", "Pcad"], F.lit(n), range(1, 60), wrap).collect()}
    want = {}
    for w in range(1, n + 1):
        for a in range(n if wrap else n - w + 1):
            at = [(a + j) % n for j in range(w)]
            want[a, w] = (c[at].sum(), s[at].sum(), ss[at].sum(), c.sum())
    assert got == want


def test_plan_of_boxes_does_not_grow_with_widths(spark):
    df, *_ = folded_table(spark)
    few, many = (plan_of(boxes.box_stat(df, ["star", "Pcad"], F.lit(24), 1, k)) for k in (3, 150))
    assert many.count("\n") == few.count("\n") and many.count("get(") == few.count("get(")


def test_widths_per_row(spark):
    df, *_ = folded_table(spark)
    two = df.withColumn("w", F.array(F.lit(2), F.lit(5))).unionByName(df.withColumns({"star": F.lit("b"), "w": F.array(F.lit(3))}))
    b = boxes.box_sums(two, ["star", "Pcad"], F.lit(24), F.col("w"), carry=["w"])
    assert {(r["star"], r["width"]) for r in b.collect()} == {("a", 2), ("a", 5), ("b", 3)}


@pytest.mark.parametrize("mode", ["ffa", "bls", "fm"])
def test_segments_are_one_plan(spark, mode):
    """Two segments and series of two cadences give what each gives alone."""
    rng = np.random.default_rng(5)
    rows = [(star, j, j * dt, float(rng.normal() - 5 * (j % 12 < 2)), 1.0, False) for star, dt in (("a", 1.0), ("b", 0.5)) for j in range(240)]
    lc = spark.createDataFrame(rows, "star STRING, cad BIGINT, t DOUBLE, f DOUBLE, ferr DOUBLE, fmask BOOLEAN")
    segs = [{"P1": 5.0, "P2": 6.0, "twdG": [2]}, {"P1": 11.0, "P2": 13.0, "twdG": [2, 3]}]
    key = lambda r: (r["star"], round(r["Pcad"], 9), r["twd"], round(r["s2n"], 9), round(r["t0"], 9))
    both = sorted(map(key, search.periodogram(lc, segs, mode).collect()))
    alone = [key(r) for s in segs for star in "ab" for r in search.periodogram(lc.where(F.col("star") == star), [s], mode).collect()]
    assert both == sorted(alone) and len({k[0] for k in both}) == 2


def test_known_signal_folds_one_period(spark):
    rows = [("a", j, float(j), float(-5 * (j % 30 < 2)) + 0.01 * (j % 7), False) for j in range(600)]
    lc = spark.createDataFrame(rows, "star STRING, cad BIGINT, t DOUBLE, f DOUBLE, fmask BOOLEAN")
    known = spark.createDataFrame([("a", 30.0, 0.03, 2.0)], "star STRING, P DOUBLE, phase DOUBLE, tdur DOUBLE")
    narrow, wide = (validate.s2n_known(lc, known, (2, 3), lim).first() for lim in ((30, 31), (5, 290)))
    assert narrow["P_close"] == wide["P_close"] and narrow["s2n_close"] == wide["s2n_close"]
    assert validate.s2n_known(lc, known, (2, 3), (31, 40)).count() == 0


def test_spans_are_numbered_without_one_window(spark, monkeypatch):
    rng = np.random.default_rng(2)
    start = np.sort(rng.uniform(-50, 900, 400))
    cuts = [(float(a), float(a + d)) for a, d in zip(start, rng.uniform(0, 4, 400))]
    df = spark.createDataFrame(cuts[::-1], "start DOUBLE, stop DOUBLE")
    want = {(i, cuts[i][1], cuts[i + 1][0]) for i in range(399)}
    for buckets in (4096, 7, 1):
        monkeypatch.setattr(clean, "RANK_BUCKETS", buckets)
        spans = clean.numbered_spans(df)
        assert {(r["_i"], r["_lo"], r["_hi"]) for r in spans.collect()} == want
        assert "SinglePartition" not in plan_of(spans)
    assert clean.numbered_spans(df.where("false")).count() == 0


def test_quarters_of_two_tables(spark):
    df = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 1, 1, 2.0), ("a", 2, 2, 3.0), ("b", 1, 0, 4.0)], "star STRING, quarter INT, cad BIGINT, f DOUBLE")
    other = spark.createDataFrame([("a", 1, 10.0), ("c", 9, 7.0)], "star STRING, quarter INT, g DOUBLE")

    def add(q, o):
        if len(q) == 0:
            return pd.DataFrame({"star": o["star"], "quarter": o["quarter"], "cad": -1, "f": o["g"]})
        return q.assign(f=q["f"] + o["g"].sum())

    shape = "star STRING, quarter INT, cad BIGINT, f DOUBLE"
    got = {tuple(r) for r in clean.map_per_quarter(df, add, shape, other).collect()}
    assert got == {("a", 1, 0, 11.0), ("a", 1, 1, 12.0), ("a", 2, 2, 3.0), ("b", 1, 0, 4.0), ("c", 9, -1, 7.0)}
    first = lambda q: q[q["cad"] == q["cad"].min()].assign(f=0.0, new=1.0)
    got = {tuple(r) for r in clean.map_per_quarter(df, first, shape + ", new DOUBLE", in_place=True).select("star", "cad", "f", "new").collect()}
    assert got == {("a", 0, 0.0, 1.0), ("a", 1, 2.0, None), ("a", 2, 0.0, 1.0), ("b", 0, 0.0, 1.0)}


def test_broken_file_is_reported(spark, tmp_path):
    good = spark.createDataFrame([("a", 1, 0.0, 1.0, 0.1, False, 0, 1)], lightcurves.LC)
    good.coalesce(1).write.parquet(str(tmp_path / "x"))
    (tmp_path / "x" / "broken.parquet").write_bytes(b"PAR1 no such thing PAR1")
    lc, bad = lightcurves.load_folder(spark, str(tmp_path / "x"))
    assert [(r["star"], r["f"]) for r in lc.collect()] == [("a", 1.0)]
    assert [(Path(r["file"]).name, r["length"]) for r in bad.collect()] == [("broken.parquet", 23)]


def test_file_of_two_stars_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "star STRING, quarter INT").coalesce(1)
    rows.write.parquet(str(tmp_path / "x"))
    with pytest.raises(Exception, match="more than one star"):
        lightcurves.load_quarters(spark, [str(tmp_path / "x")]).collect()
    rows.where("star = 'a'").write.parquet(str(tmp_path / "y"))
    assert lightcurves.load_quarters(spark, [str(tmp_path / "y")]).count() == 1


@pytest.mark.parametrize("block", [2048, 64])
def test_autocorrelation_in_blocks(spark, block):
    rng = np.random.default_rng(4)
    n = 1000
    f = rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"star": "a", "bin": np.arange(n), "fmed": f, "t_phasefold": np.arange(n) * 0.5}))
    cand = spark.createDataFrame([("a", 3.0)], "star STRING, tdur DOUBLE")
    auto, head = validate.autocorr(df, cand, 1.0, block)
    got = {int(r["i_shift"]): r["autocorr"] for r in auto.collect()}
    assert len(got) == n and all(abs(got[k] - f @ np.roll(f, -k)) < 1e-9 for k in range(-n // 2, n // 2))
    out = max(v for k, v in got.items() if abs(k * 0.5) > 3.0)
    assert head.first()["autor"] == pytest.approx(out / max(got.values()))


@pytest.mark.parametrize("strip", [4096, 40])
def test_nearest_neighbours_by_strips(spark, monkeypatch, strip):
    monkeypatch.setattr(validate, "STRIP_POINTS", strip)
    rng = np.random.default_rng(6)
    pc = np.concatenate([20 + rng.random(400), 20 + np.repeat(rng.random(50), 3), [200.0, 20.5, 20.5]])
    t0 = np.concatenate([rng.random(550) * pc[:550] * 0.05, [190.0, 1.0, 1.0]])
    s2n = np.full(len(pc), 9.0)
    low = np.zeros(9 * len(pc))
    df = spark.createDataFrame(pd.DataFrame({"star": "a", "Pcad": np.concatenate([low + 30, pc]), "t0cad": np.concatenate([low, t0]), "s2n": np.concatenate([low, s2n])}))
    x, y = (pc - pc.min()) / (pc.max() - pc.min()), t0 / pc
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    np.fill_diagonal(d, np.inf)
    assert validate.scar(df, 0.89).first()["scar"] == pytest.approx(np.percentile(d.min(axis=1), 90), abs=1e-12)


def test_two_signals_in_two_passes(spark):
    rng = np.random.default_rng(7)
    t = np.arange(900)
    f = rng.normal(0, 0.1, 900) - 1.0 * (t % 30 < 2) - 0.6 * ((t - 7) % 41 < 3)
    lc = spark.createDataFrame([("a", int(k), float(k), float(v), False) for k, v in zip(t, f)], "star STRING, cad BIGINT, t DOUBLE, f DOUBLE, fmask BOOLEAN")
    once = lambda x: search.peak(search.periodogram(stages.centre(x), [{"Pcad1": 28, "Pcad2": 43, "twdG": [2, 3]}]))
    widths = []

    def fitted(active, peaks):
        widths.append(active.where("fmask").count())
        return peaks.select("star", F.col("grid_P").alias("P"), F.col("grid_t0").alias("t0"), F.lit(4.0).alias("tdur"), F.lit(0.1).alias("rp"))

    got = sorted((r["candidate"], round(r["P"]), r["tdur"], r["rp"]) for r in stages.multi_search(lc, once, 8.0, 5, fitted).collect())
    assert got[:2] == [(1, 30, 4.0, 0.1), (2, 41, 4.0, 0.1)] and got[2][0] == 3 and got[2][3] is None
    # The second pass runs without 1.5 fitted widths, four cadences each, around the first signal.
    assert widths[0] == 0 and 10 * 30 <= widths[1] <= 14 * 30


def test_stage_tables_of_a_block_are_removed(spark):
    with session.stage_tables():
        kept = session.cut_lineage(spark.range(5))
        gone = session.cut_lineage(spark.range(3))
        session.release(gone)
        assert session.staged(kept) is kept and kept.count() == 5
        path = Path(kept.stage_path)
        assert path.exists()
    assert not path.exists()


def test_decompositions_leave_no_table(spark):
    folder = Path(session.checkpoint_dir(spark))
    rng = np.random.default_rng(8)
    m = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 50)) + 0.01 * rng.normal(size=(30, 50))
    z = spark.createDataFrame([(f"s{i}", j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "star STRING, cad BIGINT, z DOUBLE")
    before = set(folder.glob("starfold-*"))
    modes, s = ensemble.svd_modes(z, 2)
    assert np.allclose(s, np.linalg.svd(m)[1][:2], rtol=1e-9)
    assert len(set(folder.glob("starfold-*")) - before) == 1  # the modes themselves
    # Several decompositions in one session, begun from the modes of another.
    again, s2 = ensemble.svd_modes(z, 2, start=modes)
    assert np.allclose(s2, s, rtol=1e-9)
    x = modes.join(again.withColumnRenamed("u", "w"), "cad").select(F.sum(F.col("u")[0] * F.col("w")[0])).first()[0]
    assert x == pytest.approx(1, abs=1e-8)


def test_injections_in_quarters_come_back(spark):
    """Quarters with levels, drifts and a common mode of their own: the dip is found, the mode is not."""
    rng = np.random.default_rng(11)
    n, rows = 1200, []
    mode = np.sin(np.arange(n) / 2.3)
    for star in "ab":
        for j in range(n):
            q = j // 300
            f = 0.001 * rng.normal() + 0.02 * (q + 1) * mode[j] + 1e-4 * j * (-1) ** q
            rows.append((star, j, float(j), float(f), j % 41 == 7, q))
    lc = spark.createDataFrame(rows, "star STRING, cad BIGINT, t DOUBLE, f DOUBLE, fmask BOOLEAN, quarter INT")
    modes = spark.createDataFrame([(j, [1.0, float(mode[j])]) for j in range(n)], "cad BIGINT, u ARRAY<DOUBLE>")
    limits = spark.createDataFrame([(i, 0.0, 1.0, -1.0, 1.0) for i in range(2)], "k INT, med DOUBLE, sig DOUBLE, outlo DOUBLE, outhi DOUBLE")
    parts = stages.quarter_series(lc, 1e4, 1e4)
    assert parts.select("star").distinct().count() == 8
    cal = stages.calibrate_quarters(parts, modes, limits, 2).where("NOT fmask").collect()
    f = np.array([r["f"] for r in cal])
    assert abs(np.corrcoef(f, mode[[r["cad"] for r in cal]])[0, 1]) < 0.1 and f.std() < 0.002
    params = spark.createDataFrame([("a", "a1", 31.0, 0.3, 1e4, 3.0), ("b", "b1", 24.0, 0.5, 1e4, 3.0), ("b", "b2", 9.0, 0.5, 1e4, 2.0)], "star STRING, id STRING, P DOUBLE, phase DOUBLE, df DOUBLE, tdur DOUBLE")
    quiet = session.cut_lineage(stages.centre(stages.calibrate_quarters(parts, modes, limits, 2)))
    full = search.search_clipped(quiet, 20, 36, (2, 3))
    got = {r["id"]: r for r in stages.recovered(stages.inject_recover(lc, params, (2, 3), 3.0, 1.0, full, 1e4, modes, limits, 2)).collect()}
    assert got["a1"]["bg"] and got["b1"]["bg"]
    for i in ("a1", "b1"):
        assert got[i]["grid_s2n"] > 20 > got[i]["s2ncut"] and got[i]["harm"] is not None and got[i]["autor"] is not None
    # Its period is outside the periodogram: what the star has without a dip stands.
    assert not got["b2"]["bg"] and got["b2"]["grid_P"] >= 20


def test_fit_input_does_not_repeat_the_plan_of_its_curve(spark):
    """However long the curve's plan, the fit data read what was written of it; values of both kinds stay."""
    rng = np.random.default_rng(5)
    rows = [(s, float(x), float(f), float(i)) for s in ("bins", "points") for i, (x, f) in enumerate(zip(rng.uniform(-1, 1, 60), rng.normal(0, 1, 60)))]
    parts = [spark.createDataFrame(rows[i::12], "star STRING, tPF DOUBLE, f DOUBLE, t DOUBLE") for i in range(12)]
    curve = parts[0]
    for p in parts[1:]:
        curve = curve.unionByName(p)
    periods = spark.createDataFrame([("bins", 10.0), ("points", 90.0)], "star STRING, P DOUBLE")
    got = fit.choose_fit_input(curve, periods, minutes=288.0)
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 16
    out = got.toPandas()
    p = pd.DataFrame(rows, columns=["star", "tPF", "f", "t"])
    p = p[p.star == "points"].sort_values("tPF")
    points = out[out.star == "points"].sort_values("t")
    assert np.allclose(points.t, p.tPF) and np.allclose(points.f, p.f)
    assert np.allclose(points.ferr, (np.diff(p.f) * np.sqrt(2)).std())
    b = pd.DataFrame(rows, columns=["star", "tPF", "f", "t"]).query("star == 'bins'")
    lo, hi = b.tPF.min() - 0.001, b.tPF.max()
    n = max(round((b.tPF.max() - b.tPF.min()) / 0.2), 1)
    k = np.ceil(np.round((b.tPF - lo) / (hi - lo) * n, 9)) - 1
    g = b.groupby(k).f.agg(["median", "std", "count"]).query("count > 1")
    bins = out[out.star == "bins"].sort_values("t")
    assert np.allclose(bins.f, g["median"]) and np.allclose(bins.ferr, g["std"] / np.sqrt(g["count"]))


def test_queries_of_fits_do_not_repeat_the_search(spark, tmp_path):
    """The plan of the data of ``fit_shape`` and ``posterior_percentiles`` holds neither series nor search."""
    from starfold.catalog import stages as queries

    day = F.date_add(F.lit("1995-01-02").cast("date"), F.col("id").cast("int"))
    price = F.lit(1000.0) + F.pmod(F.xxhash64("id"), F.lit(90))
    spark.range(500).select(F.lit("A").alias("l_returnflag"), day.alias("l_shipdate"), price.alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    data, pars = queries._folded(spark, str(tmp_path))
    assert data._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 16
    assert pars.count() == 1 and data.where("f IS NOT NULL AND ferr > 0").count() > 10


def test_transit_of_no_duration(spark):
    """``tau`` 0 gives the limit of small ones, at and off mid-transit; other signs and values stay."""
    rows = [(t, tau) for t in (0.0, 0.02, 0.3, -0.4) for tau in (0.0, 1e-9, 0.06, -0.06)]
    d = spark.createDataFrame(rows, "t DOUBLE, tau DOUBLE")
    at = lambda usamp: models.transit(F.col("t"), 0.1, F.col("tau"), 0.3, usamp=usamp, cadence=0.1)
    got = {(r["t"], r["tau"]): (r["a"], r["b"]) for r in d.select("t", "tau", at(1).alias("a"), at(5).alias("b")).collect()}
    for t in (0.0, 0.02, 0.3, -0.4):
        assert got[t, 0.0] == got[t, 1e-9] and got[t, 0.06] == got[t, -0.06]
    assert got[0.0, 0.0][0] < -0.01 and got[0.3, 0.0] == (0.0, 0.0)


CURVE = fit.shape_model(usamp=5, cadence=0.1)
SHORT = {"p": 0.1, "tau": 0.06, "b": 0.3, "dt": 0.0}


def short_transit(spark):
    """A folded curve whose ``tau`` is the last step of a fit of two rounds from 0.15: less a step it is 0."""
    t = spark.range(61).select(F.lit("a").alias("star"), ((F.col("id") - 30) / 40 + 0.003).alias("t"))
    data = t.select("star", "t", CURVE(F.col("t"), {n: F.lit(v) for n, v in SHORT.items()}).alias("f"), F.lit(1e-3).alias("ferr"))
    return data, spark.createDataFrame([("a", 0.1, 0.15, 0.3, 0.0)], "star STRING, p DOUBLE, tau DOUBLE, b DOUBLE, dt DOUBLE")


def test_fit_whose_step_reaches_no_duration(spark):
    data, start = short_transit(spark)
    (got,) = fit.fit_shape(data, start, 2, model=CURVE).collect()
    assert np.allclose([got[n] for n in ("p", "tau", "b", "chi2")], [0.1, 0.06, 0.3, 0.0]) and got["n"] == 61
    r2 = lambda tau: F.sum(F.pow((F.col("f") - CURVE(F.col("t"), {n: F.lit(v) for n, v in (SHORT | {"tau": tau}).items()})) / F.col("ferr"), F.lit(2.0)))
    (low, high) = data.agg(r2(1e-12), r2(0.12)).first()
    assert got["utau"] == pytest.approx(0.06 / ((low + high) / 2) ** 0.5) and got["up"] > 0 and got["ub"] > 0


def test_percentiles_around_a_fit_whose_step_reaches_no_duration(spark):
    """Percentiles equal weighted ones over the same grid around the fit; the bands have every time."""
    data, start = short_transit(spark)
    fits = session.cut_lineage(fit.fit_shape(data, start, 2, model=CURVE))
    q, bands = fit.posterior_percentiles(data, fits, 3, model=CURVE)
    (best,) = fits.collect()
    axes = {}
    for n, low, high in (("p", 1e-6, 1.0), ("tau", 1e-4, 2.0), ("b", 0.0, 1.0)):
        axes[n] = np.linspace(max(low, best[n] - 4 * best[f"u{n}"]), min(high, best[n] + 4 * best[f"u{n}"]), 3)
    grid = pd.DataFrame([(p, tau, b) for p in axes["p"] for tau in axes["tau"] for b in axes["b"]], columns=["p", "tau", "b"])
    x = data.crossJoin(spark.createDataFrame(grid.assign(id=range(len(grid)), dt=0.0)))
    r = (F.col("f") - CURVE(F.col("t"), {n: F.col(n) for n in ("p", "tau", "b", "dt")})) / F.col("ferr")
    chi2 = x.groupBy("id").agg(F.sum(r * r).alias("chi2")).toPandas().set_index("id").chi2
    grid["w"] = np.exp((chi2.min() - chi2.sort_index().to_numpy()) / 2)
    got = {r["par"]: r for r in q.collect()}
    for n, values in axes.items():
        share = grid.groupby(n).w.sum().cumsum() / grid.w.sum()
        want = [values[int((share >= k).to_numpy().argmax())] for k in (0.15, 0.5, 0.85)]
        assert np.allclose([got[n][c] for c in ("q15", "q50", "q85")], want)
    rows = bands.collect()
    assert len(rows) == 61 and all(r["lo"] <= r["mean"] <= r["hi"] for r in rows)
