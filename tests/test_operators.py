"""Operators against plain NumPy formulas, and properties that they have to keep."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonloom.functions import display, kernels
from photonloom.operators import bayes, calibration, geometry, images, mixture, neighbourhood, solver, stacking, stars, synth, validation
from photonloom.plans.adapters import explode_frames
from photonloom.queries import millionths
from photonloom.sources import fits, store

H = W = 6


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(3).normal(300, 20, (12, H, W))


@pytest.fixture(scope="module")
def px(spark, cube):
    rows = [(k, k, "s", "light", float(60 * (1 + k % 3)), "L", y, x, float(cube[k, y, x])) for k in range(len(cube)) for y in range(H) for x in range(W)]
    return spark.createDataFrame(rows, "frame_id long, seq long, session string, frame_type string, exposure_s double, channel string, y int, x int, adu double").cache()


def grid(df, value, shape=(H, W)):
    out = np.full(shape, np.nan)
    for r in df.select("y", "x", value).collect():
        out[r.y, r.x] = np.nan if r[value] is None else r[value]
    return out


def test_mean_and_regression(px, cube):
    d = calibration.mean_and_deviation(px)
    assert np.allclose(grid(d, "mean"), cube.mean(0)) and np.allclose(grid(d, "std"), cube.std(0, ddof=1))
    fit = calibration.linear_regression(px)
    t = np.array([60.0 * (1 + k % 3) for k in range(len(cube))])
    assert np.allclose(grid(fit, "slope"), np.polyfit(t, cube.reshape(len(t), -1), 1)[0].reshape(H, W))
    one = calibration.linear_regression(px.where("exposure_s = 60"))
    assert np.allclose(grid(one, "slope"), 0) and np.allclose(grid(one, "intercept"), cube[::3].mean(0))


def test_partitions_do_not_matter(px):
    a, b = (grid(stacking.accumulate(px.repartition(n).withColumn("calibrated", F.col("adu")), px.select("frame_id").distinct().withColumns({"transparency": F.lit(0.5), "sky": F.lit(300.0)})), "weighted_sum") for n in (1, 7))
    assert np.allclose(a, b)


def test_ordered_fold_depends_on_order(px, cube):
    def loop(frames):
        p = bayes.Priors().start()
        prec, num = (np.full((H, W), v) for v in p["bias"])
        a, b = (np.full((H, W), float(v)) for v in p["read_noise"])
        for f in frames:
            noise = np.maximum(np.sqrt(b / np.maximum(a - 1, 1e-9)), 1e-6)
            prec, num = prec + 1 / noise**2, num + f / noise**2
            a, b = a + 0.5, b + 0.5 * (f - num / prec) ** 2
        return num / prec, np.sqrt(b / (a - 1))

    d = bayes.ordered_fold(px)
    mean, noise = loop(cube)
    assert np.allclose(grid(d, "bias_mean"), mean, rtol=0, atol=1e-9) and np.allclose(grid(d, "read_noise"), noise, rtol=0, atol=1e-9)
    back = bayes.ordered_fold(px.withColumn("seq", -F.col("seq")))
    assert not np.allclose(grid(back, "read_noise"), noise, atol=1e-6)
    assert np.allclose(grid(bayes.ordered_fold(px.repartition(5)), "read_noise"), noise, atol=1e-9)


def test_posteriors_and_temperature(spark, px, cube):
    d = bayes.bias_posterior(px, 6.0)
    prec = 1e-4 + len(cube) / 36
    assert np.allclose(grid(d, "mean"), (0.03 + cube.sum(0) / 36) / prec)
    warm = spark.range(1).select(bayes.arrhenius(F.lit(1.0), F.lit(-10.0), F.lit(0.0)).alias("v")).first().v
    assert warm == pytest.approx(math.exp(-1.12 / (2 * 8.617333e-5) * (1 / 273.15 - 1 / 263.15)))


def test_store_round_trip(spark, px, tmp_path):
    state = bayes.initial_state(px)
    store.save_state(state, str(tmp_path), "2026-01-01")
    store.save_state(state.withColumn("n", F.lit(4).cast("long")), str(tmp_path), "2026-01-02")
    assert store.load_state(spark, str(tmp_path)).where("n = 4").count() == 4 * H * W
    assert store.load_state(spark, str(tmp_path), "2026-01-01").where("n = 0").count() == 4 * H * W
    assert "adu" in store.summary_text(px, "adu")


def test_filters(px, cube):
    peak = neighbourhood.maximum_filter(px.where("frame_id = 0"), 3)
    wide = np.pad(cube[0], 1, constant_values=-np.inf)
    assert np.allclose(grid(peak, "peak"), np.max([wide[j : j + H, i : i + W] for j in range(3) for i in range(3)], axis=0))
    s = neighbourhood.smooth(px.where("frame_id = 0"), H, W)
    w = np.array(neighbourhood.gaussian_weights(1.0))
    p = np.pad(cube[0], 4, mode="symmetric")
    want = sum(w[j] * w[i] * p[j : j + H, i : i + W] for j in range(9) for i in range(9))
    assert np.allclose(grid(s, "smooth"), want)
    mask = px.where("frame_id = 0 AND y = 0 AND x = 0").select("channel", "y", "x")
    fixed = neighbourhood.replace_masked(px.where("frame_id = 0"), mask, H, W)
    q = np.pad(cube[0], 2, mode="symmetric")
    assert grid(fixed, "adu")[0, 0] == pytest.approx(np.median(q[:5, :5]))


def test_sky_surface_is_exact_for_planes_and_cubics():
    y, x = np.mgrid[:5, :6].astype(float)
    f = lambda y, x: 1 + 2 * y - x + 0.3 * y * x + 0.1 * y**3
    big = kernels.sky_surface(f(y, x), 33, 41)
    yy, xx = np.meshgrid(np.linspace(0, 4, 33), np.linspace(0, 5, 41), indexing="ij")
    assert np.allclose(big, f(yy, xx))


def test_fourier_and_convolution():
    image = np.random.default_rng(0).random((15, 15))
    assert np.allclose(kernels.fourier_shift(kernels.fourier_shift(image, 0.3, -0.7), -0.3, 0.7), image)
    assert np.allclose(kernels.fourier_shift(image, 2, 3), np.roll(image, (2, 3), axis=(0, 1)))
    delta = np.zeros((5, 5))
    delta[2, 2] = 1
    assert np.allclose(kernels.convolve(image, delta), image)
    assert np.allclose(kernels.convolve(np.full((9, 9), 7.0), kernels.gaussian_psf(5, 2.0)), 7)


def test_optics():
    assert kernels.bessel_j1(np.array([0.0, 1.0, 10.0])) == pytest.approx([0, 0.4400505857449335, 0.04347274616886144], abs=1e-12)
    p = kernels.airy_psf(41, 1.0, 100.0, 1000.0, 550.0)
    assert p.sum() == pytest.approx(1) and p.argmax() == p.size // 2
    got = kernels.wiener_deconvolve(kernels.gaussian_psf(25, 5.0), kernels.gaussian_psf(25, 3.0), 1e3)
    assert kernels.fwhm_of_psf(got) == pytest.approx(4.0, abs=0.3)


def test_moffat_fit_and_fallback():
    y, x = np.mgrid[:21, :21].astype(float)
    m = kernels.fit_moffat(kernels.moffat((100.0, 10.3, 9.6, 3.0, 2.8, 5.0), y, x))
    assert m["fitted"] and m["fwhm"] == pytest.approx(2 * 3 * math.sqrt(2 ** (1 / 2.8) - 1), rel=1e-3) and m["y"] == pytest.approx(10.3, abs=1e-3)
    assert not kernels.fit_moffat(np.ones((5, 5)))["fitted"]


def test_similarity_with_outliers():
    g = np.random.default_rng(1)
    src = g.uniform(0, 100, (20, 2))
    z = (src[:, 1] + 1j * src[:, 0]) * 1.02 * np.exp(0.1j) + 3 - 4j
    dst = np.stack([z.imag, z.real], axis=1)
    dst[:5] = g.uniform(0, 100, (5, 2))
    m = kernels.similarity_fit(src, dst, 1.0)
    assert m["inliers"] == 15 and m["rotation"] == pytest.approx(math.degrees(0.1)) and m["scale"] == pytest.approx(1.02)
    assert kernels.similarity_fit(src[:2], dst[:2]) is None


def test_wcs_shift(spark):
    s = 2 / 3600
    rows = [(k, 32.5, 32.5, 180 - dx * s / math.cos(math.radians(20)), 20 + dy * s, -s, 0.0, 0.0, s) for k, (dx, dy) in enumerate([(0, 0), (3.0, -2.0)])]
    d = spark.createDataFrame(rows, "frame_id int, crpix1 double, crpix2 double, crval1 double, crval2 double, cd11 double, cd12 double, cd21 double, cd22 double")
    got = {r.frame_id: r for r in geometry.frame_shift(d, d.where("frame_id = 0"), 64, 64).collect()}
    assert abs(got[0].dx_to_ref) < 1e-9
    assert (got[1].dx_to_ref, got[1].dy_to_ref) == pytest.approx((3, -2), abs=0.05) and got[1].scale_ratio == pytest.approx(1, abs=1e-3)


def test_mixture_finds_hot_pixels(spark):
    g = np.random.default_rng(5)
    rate = g.gamma(5, 0.0004, 20000)
    hot = g.random(20000) < 0.005
    rate[hot] *= g.uniform(20, 50, hot.sum())
    d = spark.createDataFrame([(k, float(v)) for k, v in enumerate(rate)], "k long, rate double")
    m = mixture.fit_mixture(d)
    assert all(b >= a - abs(a) * 1e-9 for a, b in zip(m.history, m.history[1:]))
    found = np.array([r.label == 1 for r in mixture.labels(d, m).orderBy("k").collect()])
    assert (found & hot).sum() >= 0.97 * hot.sum()
    assert mixture.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-7) and mixture.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-8)


@pytest.mark.parametrize("f", [lambda v: solver.total_variation(v), lambda v: solver.total_variation(v, diagonal=False), lambda v: solver.haar_l1(v, 2), lambda v: solver.kl_divergence(v, np.full_like(v, 2.0)), lambda v: solver.poisson_nll(v, np.full_like(v, 3.0))])
def test_gradients(f):
    v = np.random.default_rng(2).uniform(1, 4, (8, 8))
    _, grad = f(v)
    d = np.random.default_rng(4).normal(0, 1, v.shape)
    e = 1e-6
    assert (f(v + e * d)[0] - f(v - e * d)[0]) / (2 * e) == pytest.approx((grad * d).sum(), rel=1e-4)


def test_solver_properties():
    flat = np.full((8, 8), 3.0)
    assert solver.total_variation(flat)[0] == pytest.approx(49 * 1e-4) and solver.haar_l1(flat)[0] == 0
    assert solver.kl_divergence(flat, flat)[0] == pytest.approx(0)
    f = solver.Forward((16, 16), 2, kernels.gaussian_psf(5, 2.0), 0.7, 0.3, -0.2)
    a, b = np.random.default_rng(0).random((16, 16)), np.random.default_rng(1).random((8, 8))
    assert (f(a) * b).sum() == pytest.approx((a * f.transpose(b)).sum())
    assert np.allclose(f(np.full((16, 16), 2.0)), 1.4)
    assert np.allclose(solver.softplus(solver.inverse_softplus(a + 0.1)), a + 0.1)
    scene = np.full((16, 16), 5.0)
    scene[7:9, 7:9] = 60
    frames = [{"t": t, "psf": kernels.gaussian_psf(5, 2.0)} for t in (0.8, 1.0)]
    seen = sum(solver.Forward((16, 16), 2, m["psf"], m["t"] ** 2)(scene) for m in frames)
    s = solver.solve_sum(seen, seen / 1.64, frames, solver.SolverConfig(iterations=300, rate=0.5))
    like = lambda v: np.corrcoef(v.ravel(), scene.ravel())[0, 1]
    assert s.losses[-1] < s.losses[0] and like(s.image) > like(solver.upsampled_prior(seen / 1.64, 2)) + 0.1
    with pytest.raises(ValueError):
        solver.SolverConfig(mode="other").check()


def test_distributed_solver_agrees(spark):
    scene = np.random.default_rng(0).uniform(2, 9, (8, 8))
    psf = kernels.gaussian_psf(5, 2.0)
    seen = solver.Forward((8, 8), 2, psf, 1.0)(scene)
    d = spark.createDataFrame([(0, seen.ravel().tolist(), 1.0, 0.0, 0.0)] * 2, "frame_id int, data array<double>, transparency double, dy double, dx double")
    cfg = solver.SolverConfig(iterations=3, batch=2)
    a = solver.solve_distributed(d, seen, psf, cfg)
    b = solver.solve_frames([seen, seen], seen, [{"t": 1.0, "psf": psf}] * 2, cfg)
    assert np.allclose(a.image, b.image)


@pytest.mark.parametrize("jacobian", [solver.turned(23.0), solver.turned(-140.0, 1.07), solver.turned(0.0, 0.8), (1.0, 0.2, -0.1, 0.9)])
def test_turned_forward_model_and_its_transpose(jacobian):
    """<A x, y> is <x, A' y>, for the turn alone and for the whole model."""
    g = np.random.default_rng(3)
    x, y = g.random((24, 30)), g.random((12, 15))
    turn = solver.Turn((24, 30), jacobian)
    z = g.random((24, 30))
    assert (turn(x) * z).sum() == pytest.approx((x * turn.transpose(z)).sum(), rel=1e-12)
    f = solver.Forward((24, 30), 2, kernels.gaussian_psf(5, 2.0), 0.7, 0.3, -0.2, jacobian)
    assert (f(x) * y).sum() == pytest.approx((x * f.transpose(y)).sum(), rel=1e-10)


def test_turn_by_definition():
    g = np.random.default_rng(5)
    image = g.random((11, 11))
    assert solver.Turn((11, 11), solver.turned(180.0))(image) == pytest.approx(image[::-1, ::-1])
    assert solver.Turn((11, 11), solver.turned(90.0))(image) == pytest.approx(np.rot90(image))
    assert solver.turned(5e-5, 1 + 5e-6) is None
    assert solver.Forward((8, 8), 2, kernels.gaussian_psf(5, 2.0), jacobian=(1.0, 0.0, 0.0, 1.0)).turn is None


def test_seen_from_inverts_the_registration(spark):
    """A scene seen from a turned and moved frame, put back by the same map, is the scene."""
    y, x = np.mgrid[:40, :40]
    scene = np.exp(-((x - 23) ** 2 + (y - 17) ** 2) / 18.0)
    c, s = np.cos(0.2), np.sin(0.2)
    m = dict(zip("abcdef", (c, -s, 6.0, s, c, -3.0)))
    r = spark.range(1).select(*solver.seen_from({k: F.lit(float(v)) for k, v in m.items()}, 40, 40)).first()
    psf = np.zeros((3, 3))
    psf[1, 1] = 1.0
    seen = solver.Forward((40, 40), 1, psf, 1.0, r.dy, r.dx, r.turn)(scene)
    sx, sy = c * x - s * y + 6, s * x + c * y - 3
    want = np.exp(-((sx - 23) ** 2 + (sy - 17) ** 2) / 18.0)
    assert seen[8:32, 8:32] == pytest.approx(want[8:32, 8:32], abs=0.03)


def test_batches_take_each_frame_once(spark):
    """An epoch's batches add up to the gradient of all frames, in another order each time."""
    g = np.random.default_rng(2)
    rows = [(k, g.uniform(1, 9, 16).tolist(), 0.5 + k / 20, 0.1 * k, -0.1, list(solver.turned(float(k)) or (1.0, 0.0, 0.0, 1.0)), 1.5 + k / 10) for k in range(11)]
    df = spark.createDataFrame(rows, "frame_id long, data array<double>, transparency double, dy double, dx double, turn array<double>, fwhm double")
    cfg, image = solver.SolverConfig(batch=3), g.uniform(2, 5, (8, 8))
    batches = solver.Batches(df, cfg.batch, 7)
    assert (batches.n, batches.n_frames) == (4, 11)
    loss, grad, n = solver.gradient(df, image, None, cfg, 7)
    parts = [solver.gradient(batches.at(k), image, None, cfg, 7) for k in range(4)]
    assert sum(p[2] for p in parts) == n == 11
    assert sum(p[0] for p in parts) == pytest.approx(loss, rel=1e-12) and sum(p[1] for p in parts) == pytest.approx(grad, rel=1e-10)
    assert sorted(batches.order(0)) == sorted(batches.order(1)) == [0, 1, 2, 3]
    assert len({tuple(batches.order(e)) for e in range(9)}) > 1 and batches.order(3) == solver.Batches(df, 3, 7).order(3)
    tree = solver.gradient(df.repartition(11), image, None, cfg, 7, fan=2)
    assert tree[0] == pytest.approx(loss) and tree[1] == pytest.approx(grad) and tree[2] == 11
    own = 0.0
    for r in rows:  # each frame with its own width, turn and shift
        f = solver.Forward((8, 8), 2, kernels.gaussian_psf(7, r[6] * 2), r[2], r[3], r[4], r[5])
        own += solver.poisson_nll(f(image), np.reshape(r[1], (4, 4)))[0]
    assert loss == pytest.approx(own)


def test_display(spark, px, cube):
    p = display.auto_params(px.where("frame_id = 0")).first()
    x = (np.median(cube[0]) - p.black) / (p.white - p.black)
    assert math.asinh(p.beta * min(max(x, 1e-6), 0.5)) / math.asinh(p.beta) <= 1
    out = display.to_png(display.stretch_mono(px, display.auto_params(px)), H, W).first()
    assert out.png[:8] == b"\x89PNG\r\n\x1a\n"
    b = spark.range(1).select(display.strength(F.lit(0.01)).alias("b")).first().b
    assert math.asinh(b * 0.01) / math.asinh(b) == pytest.approx(0.18, abs=1e-4)
    with pytest.raises(ValueError):
        display.stretch(F.lit(0.5), "other")


def test_fits_round_trip(spark, tmp_path):
    image = np.arange(12, dtype=np.float32).reshape(3, 4)
    raw = fits.write_fits(image, {"IMAGETYP": "Dark Frame", "EXPTIME": 300.0, "NOTE": "it's"}, [("QUALITY", image * 2)])
    assert len(raw) % 2880 == 0
    header, back = fits.read_fits(raw)
    assert np.array_equal(back, image) and header["NOTE"] == "it's" and np.array_equal(fits.read_fits(raw, 1)[1], image * 2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.FITS").write_bytes(raw)
    (tmp_path / "in" / "bad.fits").write_bytes(b"nothing")
    fits.register(spark)
    d = spark.read.format("fits").load(str(tmp_path / "in"))
    assert d.where("_error IS NULL").count() == 1 and d.where("_error IS NOT NULL").count() == 1
    typed = fits.header_values(fits.discover(d.where("_error IS NULL"))).first()
    assert (typed.frame_type, typed.exposure_s, typed.gain) == ("dark", 300.0, None)
    assert fits.read_shared(spark, str(tmp_path / "in")).where("_error IS NULL").count() == 1
    out = d.where("_error IS NULL").select(F.lit("b").alias("name"), "h", "w", "data", "header")
    out.write.format("fits").mode("append").save(str(tmp_path / "out"))
    assert np.array_equal(fits.read_fits((tmp_path / "out" / "b.fits").read_bytes())[1], image)
    with pytest.raises(FileNotFoundError):
        fits.require_lights(d.limit(0))


def test_plate_solver_failures_are_rows(spark):
    def solve(path):
        if path == "c":
            raise TimeoutError("slow")
        return {"CRVAL1": 1.0} if path == "a" else None

    d = spark.createDataFrame([(k, p) for k, p in enumerate("abc")], "frame_id long, path string")
    assert [r.solve_status for r in fits.solve_plates(d, solve).orderBy("frame_id").collect()] == ["solved", "failed", "error: slow"]


def test_session_end_to_end(spark):
    from photonloom.plans import pipeline

    cfg = synth.Session(48, 48, 12, 3, (120.0, 600.0), 12, n_light=4, n_stars=25)
    frames = synth.generate_session(spark, cfg).cache()
    out = pipeline.run(frames, pipeline.Config(cosmic_sigma=None))  # in so small a field the stars themselves stand out
    true = synth.instrument(48, 48, seed=cfg.seed)
    assert np.abs(grid(out["model"], "bias_mean", (48, 48)) - true["bias_mean"]).mean() / true["bias_mean"].mean() < 0.02
    assert np.abs(grid(out["model"], "flat_gain", (48, 48)) - true["flat_gain"]).mean() < 0.03
    meta = {r.frame_id: r for r in out["frames"].collect()}
    assert len(meta) == 4 and out["stack"].count() > 40 * 40
    first = min(meta)
    for k, dx, dy, *_ in synth.light_truth(cfg):
        m = meta[first + k]
        if m.n_stars and m.n_stars >= 6:
            assert abs(m.dx + dx) < 1.0 and abs(m.dy + dy) < 1.0
    scene = kernels.pool(kernels.convolve(synth.star_scene(cfg)[0], synth.moffat_psf(31, 6.0)), 2)
    stack = grid(out["stack"], "weighted_mean", (48, 48))
    ok = np.isfinite(stack)
    assert np.corrcoef(stack[ok], scene[ok])[0, 1] > 0.9


def test_validation(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "a double, b double")
    r = validation.agreement(d, "a", "b").first()
    assert (r.rmse, r.psnr, r.pearson) == (0.0, math.inf, pytest.approx(1.0))
    m = spark.createDataFrame([("bias_mae_pct", 1.0), ("psd_ratio", 1.0), ("rn_mae_pct", None)], "name string, value double")
    assert {r.name: r.passed for r in validation.verdict(m).collect()} == {"bias_mae_pct": True, "psd_ratio": False, "rn_mae_pct": False}


def test_checks(spark):
    d = spark.createDataFrame([(1, 2, 2, [1.0, 2.0, 3.0, 4.0]), (2, 2, 3, [1.0] * 6)], "frame_id int, h int, w int, data array<double>")
    with pytest.raises(ValueError):
        calibration.check_shape(d)
    assert explode_frames(d.where("frame_id = 1")).count() == 4
    k = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "seq int, gain string")
    assert calibration.first_known(k, ["gain"]).first().gain == "b"
    with pytest.raises(ValueError):
        stacking.select_best(k, 0.5, "size")
    one = spark.createDataFrame([(1, 1, 1, [5.0])], "frame_id int, h int, w int, data array<double>")
    assert images.map_images(one, lambda v, _: v * 2).first().data == [10.0]
    s = spark.createDataFrame([(1, 0, 1.0, 1.0, 9.0), (1, 1, 2.0, 2.0, 8.0)], "frame_id int, k int, y double, x double, peak double")
    assert stars.isolated(s, 5.0, value="peak").count() == 1


def test_exact_median_is_exact(spark):
    g = np.random.default_rng(4)
    for v in (g.normal(0, 1, 5001).tolist(), g.normal(0, 1, 4000).tolist(), [1.0, 1.0, 1.0, 5.0], [3.0], [2.0, 4.0], [float(k % 3) for k in range(999)]):
        df = spark.createDataFrame([(x,) for x in [*v, None]], "v double").repartition(5)
        assert calibration.exact_median(df, "v") == pytest.approx(np.median(v), abs=0)
        assert calibration.exact_median(df, "v", accuracy=20) == np.median(v)
    assert calibration.exact_median(df.limit(0), "v") is None
    assert calibration.hot_pixels(df.limit(0), "v").count() == 0


def test_triangles_are_made_in_many_tasks(spark):
    """However few bytes the stars are; those of one rank, place or none make no triangle."""
    g = np.random.default_rng(8)
    rows = [(f, k, float(y), float(x)) for f in range(40) for k, (y, x) in enumerate(g.random((7, 2)) * 100)]
    odd = [(40, 0, 1.0, 1.0), (40, 0, 5.0, 1.0), (40, 1, 1.0, 4.0), (40, 2, None, 2.0), (40, 3, 1.0, 4.0), (41, 0, 3.0, 3.0), (41, 1, 3.0, 3.0), (41, 2, 3.0, 3.0), (None, 0, 0.0, 0.0), (None, 1, 1.0, 0.0), (None, 2, 0.0, 1.0)]
    t = stars.triangles(spark.createDataFrame(rows + odd, "frame_id int, star_rank int, y double, x double"), 6).withColumn("task", F.spark_partition_id()).collect()
    want = []
    for f in range(42):
        for a, b, c in combinations([r for r in rows + odd if r[0] == f and r[2] is not None and r[1] < 6], 3):
            side = sorted(math.dist(p[2:], q[2:]) for p, q in ((a, b), (a, c), (b, c)))
            if a[1] < b[1] < c[1] and side[2] >= 1e-6:
                want.append((f, a[1], b[1], c[1], pytest.approx(side[0] / side[2]), pytest.approx(side[1] / side[2])))
    assert len(want) == 40 * 20 + 2 and sorted(tuple(r)[:6] for r in t) == want
    assert len({r.task for r in t}) > 4


def test_millionths_round(spark):
    v = [0.0, 1.0, 1 / 128, 3 / 128, 1e-7, 4.999e-7, 5.001e-7, 0.9999996, *np.random.default_rng(1).random(2000).tolist()]
    assert all(a == b for a, b in spark.createDataFrame([(x,) for x in v], "v double").select(millionths("v"), F.round("v", 6)).collect())
