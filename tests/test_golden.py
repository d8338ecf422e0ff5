"""Small fixtures with known answers, against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.functions import frames, models, stats
from starfold.operators import clean, fold, inject, search, validate, windows

LC = "star STRING, cad BIGINT, t DOUBLE, f DOUBLE, ferr DOUBLE, fmask BOOLEAN"


def series(spark, values, star="a", mask=()):
    rows = [(star, i, float(i), None if v is None else float(v), 1.0, v is None or i in mask) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, LC)


def test_ffa_stage_of_identity(spark):
    rows = [("a", 4, 2, i, i, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "star STRING, P0 BIGINT, k INT, row BIGINT, col BIGINT, s DOUBLE")
    got = fold.ffa_stage(df, 1, ["star", "P0"], "P0", ["s"])
    m = np.zeros((4, 4))
    for r in got.collect():
        m[r["row"], r["col"]] = r["s"]
    assert m.tolist() == [[1, 1, 0, 0], [2, 0, 0, 0], [0, 0, 1, 1], [0, 0, 2, 0]]


def ffa_numpy(x):
    m, p = x.shape
    if m == 1:
        return x
    a, b = ffa_numpy(x[: m // 2]), ffa_numpy(x[m // 2 :])
    j = np.arange(p)
    return np.array([a[i // 2] + b[i // 2][(j + (i + 1) // 2) % p] for i in range(m)])


@pytest.mark.parametrize("n,p", [(24, 6), (101, 11), (260, 17)])
@pytest.mark.parametrize("rows", [4096, 4])
def test_ffa_against_recurrence(spark, monkeypatch, n, p, rows):
    monkeypatch.setattr(fold, "FFA_ROWS", rows)
    x = np.random.default_rng(n).integers(-50, 50, n).astype(float)
    df = fold.with_index(series(spark, x))
    got = fold.fold_ffa(df, p, p + 1, {"s": F.col("f"), "n": F.lit(1).cast("long")})
    nrow = n // p + 1
    m = 2 ** math.ceil(math.log2(nrow))
    full = np.zeros(m * p)
    full[:n] = x
    want = ffa_numpy(full.reshape(m, p))
    have = np.zeros((m, p))
    for r in got.collect():
        have[r["row"], r["col"]] = r["s"]
        assert r["Pcad"] == pytest.approx(p + r["row"] / (m - 1))
    assert np.array_equal(have, want)


def test_box_frame_of_an_impulse(spark):
    d = windows.mean_depth(series(spark, [0] * 10 + [4] + [0] * 15), [4])
    low = [r["cad"] for r in d.where("d < 0").orderBy("cad").collect()]
    assert low == [9, 10, 11, 12]


def test_constant_flux_has_no_depth(spark):
    d = windows.mean_depth(series(spark, [5.0] * 40), [3, 5])
    assert d.where("d <> 0").count() == 0 and d.where("d = 0").count() > 0


def test_top_clipping(spark):
    a = np.ones((4, 10))
    a[0, 2] = np.nan
    a[-1, -3:] = np.nan
    a[:, 3] = 2
    a[1, 5], a[2, 5] = 8, 10
    rows = [("a", int(i), int(j), None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(4) for j in range(10)]
    df = spark.createDataFrame(rows, "star STRING, row BIGINT, col BIGINT, d DOUBLE")
    g, _ = fold.cumsum_top(df, ["star"], ["col"], F.col("d"), F.col("row"), 4)
    got = {r["col"]: [(r["s2"], r["c2"]), (r["s1"], r["c1"]), (r["s0"], r["c0"])] for r in g.collect()}
    assert got[5] == [(2, 2), (10, 3), (20, 4)]
    assert got[0] == [(2, 2), (3, 3), (4, 4)]
    assert got[2] == [(1, 1), (2, 2), (3, 3)]


def test_top_clipping_random_with_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 6, (37, 8)).astype(float)
    rows = [("a", int(i), int(j), float(v[i, j])) for i in range(37) for j in range(8)]
    df = spark.createDataFrame(rows, "star STRING, row BIGINT, col BIGINT, d DOUBLE")
    g, _ = fold.cumsum_top(df, ["star"], ["col"], F.col("d"), F.col("row"), 37)
    for r in g.collect():
        top = np.sort(v[:, r["col"]])
        assert (r["s0"], r["s1"], r["s2"]) == (top.sum(), top[:-1].sum(), top[:-2].sum())


def test_bin_average(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 3.0, 2.0), ("a", 4.0, 4.0)], "star STRING, x DOUBLE, y DOUBLE")
    got = validate.hist_bin_avg(df, "x", "y", 0.0, 5.0, 2).orderBy("bin").collect()
    assert [(r["x"], r["y"]) for r in got] == [(1.25, 2.0), (3.75, 3.0)]


def test_median_filter_mirrors_the_ends(spark):
    x = [5, 1, 4, 9, 2, 7]
    got = [r["m"] for r in clean.median_filter(series(spark, x), "f", 4, "m").orderBy("cad").collect()]
    pad = [x[1], x[0], *x, x[-1]]
    assert got == [sorted(pad[i : i + 4])[2] for i in range(6)]


def test_interpolation_extends_the_outer_line(spark):
    df = series(spark, [None, 1, None, 5, None, None, 11, None])
    got = [r["f"] for r in clean.interp_masked(df, "f", clean.valid()).orderBy("cad").collect()]
    assert got == [-1, 1, 3, 5, 7, 9, 11, 13]
    held = [r["f"] for r in clean.interp_masked(df, "f", clean.valid(), edge="hold").orderBy("cad").collect()]
    assert held == [1, 1, 3, 5, 7, 9, 11, 11]
    some = [r["f"] for r in clean.interp_masked(df, "f", clean.valid(), n_contig=1).orderBy("cad").collect()]
    assert some == [-1, 1, 3, 5, None, None, 11, 13]


def test_exact_quantiles_inside_the_bracket(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_cauchy(60_000), 3)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(x)], "k STRING, x DOUBLE").repartition(8)
    for limit in (50_000, 1000):
        monkeypatch.setattr(stats, "DIRECT_ROWS", limit)
        for q in (0.5, 0.9):
            got = {r["k"]: r["m"] for r in stats.group_quantiles(df, ["k"], {"m": F.col("x")}, q).collect()}
            for k, sel in (("a", np.arange(60_000) % 3 != 0), ("b", np.arange(60_000) % 3 == 0)):
                assert got[k] == pytest.approx(np.quantile(x[sel], q), abs=1e-12)


def test_many_stretches_give_what_one_gives(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vals = [None if rng.random() < 0.3 else float(rng.integers(0, 100)) for _ in range(300)]
    df = series(spark, vals)

    def run():
        x = clean.interp_masked(df, "f", clean.valid(), out="fi", edge="hold")
        x = clean.mask_outliers(x, (-2.0, 2.0), "linear")
        x = clean.segment_labels(x, 3)
        x = clean.grow_mask(x, "is_outlier", 2, 3, "grown")
        x = clean.mask_steps(x, size=20, scale=10, min_valid=5, nsig=2.0)
        return x.orderBy("cad").select("cad", F.round("fi", 9), "is_outlier", "segment", "grown", "is_step").collect()

    whole = run()
    for name in ("with_frames", "scan"):
        f = getattr(clean, name)
        monkeypatch.setattr(clean, name, lambda *a, _f=f, **k: _f(*a, **({"stretch": 37} | k)))
    assert run() == whole


def test_long_fold_merges_blocks(spark, monkeypatch):
    df = clean_centre(series(spark, np.random.default_rng(2).integers(0, 9, 400)))
    a = search.search_clipped(df, 20, 24, (2, 3)).orderBy("Pcad").collect()
    monkeypatch.setattr(fold, "CADENCES_PER_BLOCK", 64)
    b = search.search_clipped(df, 20, 24, (2, 3)).orderBy("Pcad").collect()
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert x["Pcad"] == y["Pcad"]
        assert x["s2n"] == pytest.approx(y["s2n"])


def clean_centre(df):
    from starfold.plans.stages import centre

    return centre(df)


def injected(spark, n=800, P=23, depth=50.0):
    rng = np.random.default_rng(8)
    f = rng.integers(-10, 10, n).astype(float)
    f[(np.arange(n) - 7) % P < 3] -= depth
    return clean_centre(series(spark, f))


def test_injected_signal_is_the_peak(spark):
    df = injected(spark)
    for pgram in (
        search.periodogram(df, [{"Pcad1": 18, "Pcad2": 30, "twdG": [2, 3, 5]}], "max"),
        search.periodogram(df, [{"Pcad1": 18, "Pcad2": 30, "twdG": [2, 3, 5]}], "ffa"),
        search.periodogram(df, [{"Pcad1": 18, "Pcad2": 30, "twdG": [2, 3, 4]}], "bls"),
        search.periodogram(df, [{"Pcad1": 18, "Pcad2": 30, "twdG": [2, 3, 5]}], "fm"),
    ):
        p = search.peak(pgram).first()
        assert abs(p["grid_P"] - 23) < 0.1
        assert abs((p["grid_t0"] - 8 + 11.5) % 23 - 11.5) <= 1.0


def test_two_outliers_do_not_pass(spark):
    f = np.zeros(400)
    f[::3] = 1.0
    f[50], f[90] = -500, -500
    p = search.search_clipped(clean_centre(series(spark, f)), 38, 42, (1,))
    assert p.where("mean > 20").count() == 0


def test_box_shape(spark):
    df = spark.createDataFrame([(float(t),) for t in (0, 1, 2, 2.5, 3, 10)], "t DOUBLE")
    got = [r[0] for r in df.select(models.box("t", 20.0, 0.0, 1.0, 5.0, 1.0)).collect()]
    assert got == [-1, -1, -1.0 if got[2] == -1 else got[2], -0.5, 0, 0]


def test_occultation_limits(spark):
    df = spark.createDataFrame([(z,) for z in (0.0, 0.5, 0.95, 1.0, 1.2)], "z DOUBLE")
    got = [r[0] for r in df.select(models.occult_small("z", 0.1)).collect()]
    assert got[4] == 1.0 and all(0.98 < g < 1 for g in got[:3]) and got[0] < got[1] < got[2] < got[3]


def test_injection_needs_exactly_one_choice(spark):
    lc = series(spark, range(30))
    bad = spark.createDataFrame([("a", 1, 5.0, 1.0, 0.5, 100.0)], "star STRING, id INT, P DOUBLE, epoch DOUBLE, phase DOUBLE, df DOUBLE")
    with pytest.raises(Exception, match="xor"):
        inject.inject(lc, bad).collect()


def test_spline_follows_a_cubic(spark):
    from starfold.operators import detrend

    t = np.arange(120)
    df = series(spark, 2 + 0.3 * t - 0.01 * t**2 + 1e-4 * t**3)
    x = detrend.detrend_spline(df, 20, 30.0).agg(F.max(F.abs("fdt"))).first()[0]
    assert x < 1e-6


def test_gp_mean_against_dense_solution(spark):
    from starfold.operators import detrend

    rng = np.random.default_rng(4)
    f = np.sin(np.arange(160) / 20) + rng.normal(0, 0.05, 160)
    df = series(spark, f).withColumn("quarter", F.lit(1))
    got = np.array([r["ftnd"] for r in detrend.detrend_gp(df).orderBy("cad").collect()])
    t = np.arange(160.0)
    x, y = t[::8], f.reshape(-1, 8).mean(axis=1)
    kern = lambda a, b: np.exp(-0.5 * (a[:, None] - b[None, :]) ** 2 / 25)
    want = kern(t, x) @ np.linalg.solve(kern(x, x) + 0.005 * np.eye(len(x)), y)
    assert np.allclose(got, want, atol=1e-9)


def test_modes_are_recovered(spark):
    from starfold.operators import ensemble

    rng = np.random.default_rng(6)
    u = np.linalg.qr(rng.normal(size=(60, 2)))[0]
    a = rng.normal(size=(12, 2)) * [30, 10]
    m = a @ u.T
    rows = [(f"s{i:02d}", j, float(m[i, j])) for i in range(12) for j in range(60)]
    z = spark.createDataFrame(rows, "star STRING, cad BIGINT, z DOUBLE")
    modes, s = ensemble.svd_modes(z, 2)
    assert np.allclose(s, np.linalg.svd(m)[1][:2])
    p = ensemble.projections(z, modes, 2)
    assert p.agg(F.max(F.abs("x2"))).first()[0] < 1e-9
    # More components than the matrix has rank: the rest is zero.
    modes, s = ensemble.svd_modes(z, 3)
    assert s[2] == 0.0 and modes.agg(F.max(F.abs(F.col("u")[2]))).first()[0] == 0.0


def test_band_solve():
    """Against a dense least-squares fit, with empty cells, and along a long band."""
    from starfold.functions.linalg import band_solver

    solve_band = band_solver()

    rng = np.random.default_rng(5)
    for m, n in ((1, 2), (1, 50), (30, 400), (30, 12)):
        u = np.sort(rng.uniform(0, m, n))
        u = u[(u < 10) | (u > 17)]
        c = np.minimum(u.astype(int), m - 1)
        x = u - c
        design = np.zeros((len(u), m + 3))
        for i, v in enumerate([(1 - x) ** 3 / 6, (3 * x**3 - 6 * x**2 + 4) / 6, (-3 * x**3 + 3 * x**2 + 3 * x + 1) / 6, x**3 / 6]):
            design[np.arange(len(u)), c + i] += v
        y = np.cos(u) + rng.normal(size=len(u))
        a = design.T @ design
        band = np.array([[a[i, i + o] if i + o < m + 3 else 0.0 for o in range(4)] for i in range(m + 3)])
        want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
        assert np.allclose(design @ solve_band(band, design.T @ y), want, atol=1e-5)
    n = 200_000
    band = np.tile([4.0, 1.0, 0.5, 0.25], (n, 1))
    x = solve_band(band, np.ones(n))
    assert np.allclose(x[n // 2], 1 / (4 + 2 * 1.75))
    assert (solve_band(np.zeros((3, 4)), np.zeros(3)) == 0).all()


def test_modes_equal_dense_decomposition(spark):
    """Full rank and two planted outliers, which the robust form drops."""
    from starfold.operators import ensemble

    rng = np.random.default_rng(8)
    u = np.linalg.qr(rng.normal(size=(80, 3)))[0]
    m = rng.normal(size=(40, 3)) * [9, 6, 4] @ u.T + 0.2 * rng.normal(size=(40, 80))
    big = m.copy()
    big[[3, 17]] += np.array([[4000.0], [-2500.0]]) * u[:, 0]
    table = lambda x: spark.createDataFrame(
        [(f"s{i:02d}", j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "star STRING, cad BIGINT, z DOUBLE"
    )
    modes, s = ensemble.svd_modes(table(m), 3)
    _, want, v = np.linalg.svd(m)
    got = np.array([r["u"] for r in modes.orderBy("cad").collect()])
    assert np.allclose(s, want[:3], rtol=1e-9)
    assert np.allclose(np.abs(np.sum(got * v[:3].T, axis=0)), 1, atol=1e-8)
    assert (got[np.abs(got).argmax(axis=0), range(3)] > 0).all()
    _, p, s = ensemble.robust_svd(table(big), 3, x2_limits=(0.0, 3.0))
    assert {r["star"] for r in p.collect()} == {f"s{i:02d}" for i in range(40) if i not in (3, 17)}
    assert np.allclose(s, np.linalg.svd(np.delete(m, [3, 17], axis=0))[1][:3], rtol=1e-8)


def test_quarter_given_twice_is_an_error(spark):
    from starfold.sources import lightcurves

    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y")], "star STRING, quarter INT, file STRING")
    with pytest.raises(Exception, match="twice"):
        lightcurves.checked_quarters(df).collect()
    with pytest.raises(ValueError, match="must contain"):
        lightcurves.require_columns(df)


def test_nearest_neighbour_distance(spark):
    rng = np.random.default_rng(9)
    n = 300
    pc = 20 + np.arange(n) * 0.1
    t0 = rng.random(n) * pc
    s2n = np.concatenate([np.zeros(240), 5 + rng.random(60)])
    df = spark.createDataFrame([("a", float(p), float(t), float(s)) for p, t, s in zip(pc, t0, s2n)], "star STRING, Pcad DOUBLE, t0cad DOUBLE, s2n DOUBLE")
    cut = s2n > np.percentile(s2n, 90)
    x = pc[cut] - pc[cut].min()
    d = np.array([x / x.max(), (t0 / pc)[cut]]).T
    dist = np.sqrt(((d[:, None] - d[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    assert validate.scar(df).first()["scar"] == pytest.approx(np.percentile(dist.min(axis=1), 90))
