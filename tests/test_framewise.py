"""The run over frames as arrays against the operators over pixels, on sessions with and without colour."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonloom.functions import frame as kernel
from photonloom.functions import kernels
from photonloom.operators import calibration, neighbourhood, solver, stacking, stars, synth
from photonloom.plans import framewise, pipeline
from photonloom.plans.adapters import explode_frames


def grid(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.select("y", "x", column).collect():
        out[r.y, r.x] = np.nan if r[column] is None else r[column]
    return out


@pytest.fixture(scope="module")
def session(spark):
    cfg = synth.Session(40, 44, 8, 3, (120.0, 600.0), 8, n_light=3, n_stars=20)
    return synth.generate_session(spark, cfg).cache()


def test_model_equals_that_of_pixels(spark, session):
    maps = framewise.fit_model(session)
    want = calibration.fit_all(explode_frames(session))
    for c in framewise.MAPS:
        assert maps[c] == pytest.approx(grid(want, c, (40, 44)), rel=1e-8, abs=1e-8)
    back = framewise.maps_of(framewise.model_table(spark, maps, 40), 40, 44)
    assert all(np.array_equal(back[c], maps[c]) for c in maps)
    assert framewise.fit_model(session.where("frame_type = 'light'")) == {}


@pytest.mark.parametrize("pattern", [None, "RGGB"])
def test_bands_give_the_sums_of_tasks(spark, session, pattern, monkeypatch):
    """Moments and stack are the same whether tasks hand on sums or bands of frames."""
    frames = session.repartition(3).cache()
    a, b = (framewise.moments(frames, lambda v, row: v / 2 if row["exposure_s"] else v, least=n) for n in (0.0, 1e9))
    assert all(a[c] == pytest.approx(b[c], rel=1e-9, abs=1e-9) and a[c].shape == (40, 44) for c in framewise.MOMENTS)
    assert framewise.moments(frames.limit(0), lambda v, _: v, least=1e9) is None and framewise.moments(frames, lambda v, _: None, least=1e9) is None
    lights = frames.where("frame_type = 'light'").select("frame_id", "h", "w", "data")
    same = F.struct(*[F.lit(v).alias(c) for c, v in zip(framewise.AFFINE, (1.0, 0.02, -1.3, -0.02, 1.0, 0.6))])
    meta = lights.select("frame_id", F.lit(3.0).alias("sky"), (0.5 + F.col("frame_id") / 100).alias("transparency"), same.alias("to_reference"))
    for canvas in (None, framewise.Canvas(50, 47, 3, 2)):
        x, y = ({(r.channel, r.y, r.x): tuple(r[c] for c in framewise.STACK) for r in framewise.stacked(lights, meta, pattern, canvas, least=n).collect()} for n in (0.0, 1e9))
        assert x.keys() == y.keys() and len(x) > 300
        assert all(x[k] == pytest.approx(y[k], rel=1e-9) for k in x)


def test_moments_of_parts_add_up():
    g = np.random.default_rng(1)
    t, v = g.uniform(1, 9, 30), g.normal(500, 3, 30)
    one = lambda k: (np.ones(1), t[k : k + 1], v[k : k + 1], np.zeros(1), np.zeros(1), np.zeros(1))
    total = one(0)
    for k in range(1, 30):
        total = framewise.merged(total, one(k)) if k % 2 else framewise.merged(one(k), total)
    n, mt, mv, stt, stv, svv = (float(x[0]) for x in total)
    assert (n, mt, mv) == pytest.approx((30, t.mean(), v.mean()))
    assert (stt, stv, svv) == pytest.approx((((t - mt) ** 2).sum(), ((t - mt) * (v - mv)).sum(), ((v - mv) ** 2).sum()))


def test_kernels_equal_operators(spark):
    g = np.random.default_rng(5)
    image = g.normal(100, 5, (32, 36))
    for y, x in ((8, 9), (20, 25), (12, 28), (25, 8)):
        image[y - 2 : y + 3, x - 2 : x + 3] += 4000 * kernels.gaussian_psf(5, 2.5)
    px = spark.createDataFrame([(0, "L", y, x, float(image[y, x])) for y in range(32) for x in range(36)], "frame_id long, channel string, y int, x int, adu double").cache()
    assert kernel.clipped_median(image) == pytest.approx(neighbourhood.sigma_clipped(px, ["frame_id"]).first()["median"])
    assert kernel.noise(image) == pytest.approx(stars.background_noise(px).first().rms)
    assert kernel.maximum_filter(image, 4) == pytest.approx(grid(neighbourhood.maximum_filter(px, 4), "peak", (32, 36)))
    out = {(r.y, r.x) for r in neighbourhood.outlier_mask(px, 10.0).collect()}
    assert out == set(zip(*map(np.ndarray.tolist, np.nonzero(kernel.outliers(image)))))
    mask = spark.createDataFrame([(0, "L", y, x) for y, x in out], "frame_id long, channel string, y int, x int")
    assert kernel.replaced(image, kernel.outliers(image)) == pytest.approx(grid(neighbourhood.replace_masked(px, mask, 32, 36), "adu", (32, 36)))
    net = image - kernel.clipped_median(image)
    found = kernel.find_stars(net, 5.0, 6.0, 50, 4.0)
    assert sorted((round(y), round(x)) for y, x, _ in found) == [(8, 9), (12, 28), (20, 25), (25, 8)]
    sky = px.withColumn("adu", F.col("adu") - kernel.clipped_median(image))
    at = spark.createDataFrame([(0, k, float(y), float(x)) for k, (y, x, _) in enumerate(found)], "frame_id long, star_rank long, y double, x double")
    assert [r.flux for r in stars.aperture_flux(at, sky, 4.0).orderBy("star_rank").collect()] == pytest.approx(found[:, 2])


def bilinear(image, affine, rows, cols, min_cover=0.5):
    """The definition, pixel by pixel."""
    a, b, c, d, e, f = affine
    out = np.full((rows, cols), np.nan)
    for y in range(rows):
        for x in range(cols):
            sx, sy = a * x + b * y + c, d * x + e * y + f
            total = cover = 0.0
            for j in (math.floor(sy), math.floor(sy) + 1):
                for i in (math.floor(sx), math.floor(sx) + 1):
                    w = (1 - abs(sy - j)) * (1 - abs(sx - i))
                    if w > 0 and 0 <= j < image.shape[0] and 0 <= i < image.shape[1]:
                        total, cover = total + w * image[j, i], cover + w
            if cover > min_cover:
                out[y, x] = total / cover
    return out


def test_warp_by_definition(spark):
    image = np.random.default_rng(5).normal(100, 5, (12, 15))
    turns = [(1.0, 0.1, -0.6, -0.1, 1.0, 0.3), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (0.0, 1.0, -2.0, -1.0, 0.0, 11.0), (None, 0.0, 0.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame([(k, 12, 15, image.ravel().tolist(), *t) for k, t in enumerate(turns)], "frame_id long, h int, w int, data array<double>, a double, b double, c double, d double, e double, f double")
    for order in (1, 3):
        got = {r.frame_id: np.array(r.data).reshape(r.h, r.w) for r in stacking.warp(df, 14, 13, order).collect()}
        assert np.isnan(got[3]).all() and got[1][:12, :13] == pytest.approx(image[:, :13])
        for k in range(3):
            if order == 1:
                assert got[k] == pytest.approx(bilinear(image, turns[k], 14, 13), nan_ok=True)
                assert {(r.y, r.x) for r in stacking.covered(stacking.warp(df, 14, 13)).where(F.col("frame_id") == k).collect()} == set(zip(*np.nonzero(np.isfinite(got[k]))))
    with pytest.raises(ValueError):
        kernel.warped(image, turns[0], 3, 3, 2)


def test_cubic_spline(spark):
    """The spline passes through the pixels, is smooth, and follows a cubic exactly away from the edges."""
    g = np.random.default_rng(6)
    image = g.normal(0, 1, (9, 17))
    c = kernel.spline_coefficients(image)
    wide = np.pad(c, 1, mode="reflect")
    back = sum(wy * wx * wide[1 + j : 10 + j, 1 + i : 18 + i] for j, wy in ((-1, 1), (0, 4), (1, 1)) for i, wx in ((-1, 1), (0, 4), (1, 1))) / 36
    assert back == pytest.approx(image)
    y, x = np.mgrid[:40, :40].astype(float)
    curve = lambda y, x: 1e-3 * (x - 20) ** 3 - 2e-3 * (y - 17) ** 3 + 0.05 * x * y + 3
    affine = (0.9, 0.1, 2.3, -0.1, 0.95, 3.7)
    got = kernel.resampled_cubic(curve(y, x), affine, 36, 36, band=7)
    sx, sy = affine[0] * x + affine[1] * y + affine[2], affine[3] * x + affine[4] * y + affine[5]
    middle = (sx[:36, :36] > 12) & (sx[:36, :36] < 27) & (sy[:36, :36] > 12) & (sy[:36, :36] < 27)
    assert middle.sum() > 50 and got[middle] == pytest.approx(curve(sy, sx)[:36, :36][middle], abs=1e-5)
    assert np.isnan(got[(sx[:36, :36] > 39.01) | (sy[:36, :36] > 39.01)]).all()
    assert kernel.resampled_cubic(np.array([[5.0]]), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), 1, 1) == pytest.approx(5.0)
    assert kernel.resampled_cubic(image[:1], (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), 1, 17) == pytest.approx(image[:1])


def test_saturated_stars_are_none():
    image = np.zeros((30, 30))
    image[10, 10] = image[20, 20] = 500.0
    raw = image > 0
    raw[20, 20] = False
    assert [tuple(s[:2]) for s in kernel.find_stars(image, 5.0, 4.0, 9, 2.0, saturated=raw)] == [(20.0, 20.0)]


def test_nearest_shapes_equal_brute_force():
    g = np.random.default_rng(2)
    a, b = g.random((400, 2)), np.round(g.random((300, 2)), 2)
    b[150:200] = b[:50]  # ties
    got = kernel.nearest_shapes(a, b, 0.03)
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    want = np.argmin(np.round(d, 9), axis=1)
    assert np.array_equal(got, np.where(d[np.arange(400), want] <= 0.03, want, -1))
    assert kernel.nearest_shapes(a[:0], b, 0.03).size == 0 and set(kernel.nearest_shapes(a, b[:0], 0.03)) == {-1}


def test_shapes_of_a_lattice_are_few_comparisons():
    """Stars on a lattice make the same shapes again and again, to the last digits: what a frame takes doesn't grow with that (11 s for these before)."""
    lattice = np.stack(np.meshgrid(np.arange(7) * 10.3, np.arange(7) * 10.3), axis=-1).reshape(-1, 2)
    g = np.random.default_rng(5)
    known, frames = kernel.Reference(lattice, 50), [lattice + g.normal(0, 0.01, lattice.shape) for _ in range(20)]
    began = time.perf_counter()
    votes = [known.votes(f) for f in frames]
    assert time.perf_counter() - began < 4
    assert kernel.Reference(lattice, 50).index is known.index  # made once a process
    (_, ref), (_, own) = kernel.triangle_shapes(lattice), kernel.triangle_shapes(frames[0])
    some = own[::97]
    d = np.sqrt((some[:, :1] - ref[:, 0]) ** 2 + (some[:, 1:] - ref[:, 1]) ** 2)
    want = np.argmin(np.where(d <= 0.02, np.rint(d * 1e9), np.inf), axis=1)
    assert np.array_equal(known.index.nearest(some), np.where(d.min(axis=1) <= 0.02, want, -1))
    assert np.array_equal(known.index.nearest(some, block=50), known.index.nearest(some))
    assert np.array_equal(kernel.ShapeIndex(ref, 0.02, most=1000).nearest(some), known.index.nearest(some))
    assert votes[0].shape == (49, 49) and votes[0].sum() == 3 * (known.index.nearest(own) >= 0).sum()


@pytest.mark.parametrize("pattern", [None, "RGGB"])
def test_a_real_frame_size_within_a_minute(spark, pattern):
    cfg = synth.Session(256, 256, 8, 2, (120.0, 600.0), 8, n_light=4, n_stars=60)
    frames = synth.generate_session(spark, cfg)
    frames = frames.withColumn("bayer_pattern", F.lit(pattern)) if pattern else frames
    frames = frames.cache()
    frames.count()
    began = time.time()
    out = pipeline.run(frames)
    meta = {r.frame_id: r for r in out["frames"].collect()}
    n = {r.channel: r["count"] for r in out["stack"].groupBy("channel").count().collect()}
    assert time.time() - began < 60
    size = 128 if pattern else 256
    assert set(n) == ({"R", "G0", "G1", "B"} if pattern else {"L"}) and min(n.values()) > 0.9 * size * size
    assert all(m.n_stars >= 6 for m in meta.values())
    first = min(meta)
    for k, dx, dy, *_ in synth.light_truth(cfg):
        scale = 2 if pattern else 1
        assert abs(meta[first + k].dx + dx / scale) < 0.5 and abs(meta[first + k].dy + dy / scale) < 0.5


def test_a_resumed_run_is_the_whole_run(spark, session, tmp_path):
    last = session.where("frame_type = 'light'").agg(F.max("frame_id")).first()[0]
    first = session.where("frame_type = 'light'").agg(F.min("frame_id")).first()[0]
    whole = pipeline.run(session)
    pipeline.save(pipeline.run(session.where(F.col("frame_id") != last)), str(tmp_path), first)
    again = pipeline.resume(session, str(tmp_path))
    a, b = grid(whole["stack"], "weighted_mean", (40, 44)), grid(again["stack"], "weighted_mean", (40, 44))
    assert a == pytest.approx(b, nan_ok=True, rel=1e-9) and again["frames"].count() == whole["frames"].count()


def test_a_filtered_run_resumes_as_well(spark, session, tmp_path):
    """Frames that the filter leaves out count neither in one run nor in a resumed one."""
    lights = session.where("frame_type = 'light'")
    first, last = lights.agg(F.min("frame_id"), F.max("frame_id")).first()
    clear = sorted(r.transparency for r in pipeline.run(session)["frames"].collect())
    cfg = lambda: pipeline.Config(min_transparency=(clear[0] + clear[1]) / 2)
    whole = pipeline.run(session, cfg())
    assert whole["frames"].where("stacked").count() == 2
    pipeline.save(pipeline.run(session.where(F.col("frame_id") != last), cfg()), str(tmp_path), first)
    again = pipeline.resume(session, str(tmp_path), cfg())
    for c in ("weighted_mean", "sky_mean", "variance"):
        assert grid(whole["stack"], c, (40, 44)) == pytest.approx(grid(again["stack"], c, (40, 44)), nan_ok=True, rel=1e-9)
    assert again["frames"].where("stacked").count() == 2


# registration ------------------------------------------------------------------


def turned_session(spark, turns, size=72, sky=50.0, wcs=False):
    """Lights of one field of stars, each turned about its middle and moved; without noise. turns: degrees, dy, dx."""
    g = np.random.default_rng(8)
    places = g.uniform(-40, 40, (60, 2))
    flux = g.uniform(2000, 9000, 60)
    y, x = np.mgrid[:size, :size].astype(float)
    middle = (size - 1) / 2
    scale = 2.0 / 3600
    rows, images = [], []
    for k, (turn, dy, dx) in enumerate(turns):
        c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
        image = np.full((size, size), sky)
        for (v, u), f in zip(places, flux):  # a star at (u, v) of the field lies at the turned place
            px, py = c * u + s * v + middle + dx, -s * u + c * v + middle + dy
            image += f * np.exp(-((x - px) ** 2 + (y - py) ** 2) / (2 * 1.6**2)) / (2 * np.pi * 1.6**2)
        images.append(image)
        # the field's plane has x to the west: the frame's pixel p is the field's c (px - m) - s (py - m)
        head = tuple(map(float, (middle + 1 + dx, middle + 1 + dy, 180.0, 20.0, -scale * c, scale * s, scale * s, scale * c))) if wcs else ()
        rows.append((k, k, "light", 1.0, size, size, image.ravel().tolist(), *head))
    names = "frame_id long, seq long, frame_type string, exposure_s double, h int, w int, data array<double>"
    names += ", crpix1 double, crpix2 double, crval1 double, crval2 double, cd11 double, cd12 double, cd21 double, cd22 double" if wcs else ""
    return spark.createDataFrame(rows, names), images


TURNS = [(0.0, 0.0, 0.0), (7.0, 3.0, -2.0), (-12.0, -4.0, 5.5), (170.0, 1.0, 2.0)]


def likeness(stack, image, shape, middle=slice(18, 54)):
    got = grid(stack, "weighted_mean", shape)
    return np.corrcoef(got[middle, middle].ravel(), image[middle, middle].ravel())[0, 1]


@pytest.mark.parametrize("order", [1, 3])
def test_a_turned_session_stacks_right_by_stars(spark, order):
    frames, images = turned_session(spark, TURNS[:3])
    plain = pipeline.Config(cosmic_sigma=None, order=order, max_stars=40)
    out = pipeline.run(frames, plain, model=no_model(spark, 72))
    meta = {r.frame_id: r for r in out["frames"].collect()}
    assert [meta[k].registered for k in range(3)] == ["stars"] * 3
    assert abs(meta[1].rotation) == pytest.approx(7, abs=0.2) and abs(meta[2].rotation) == pytest.approx(12, abs=0.2)
    moved = pipeline.run(frames, pipeline.Config(cosmic_sigma=None, max_stars=40, registration="shift"), model=no_model(spark, 72))
    assert likeness(out["stack"], images[0], (72, 72)) > 0.99 > likeness(moved["stack"], images[0], (72, 72)) + 0.1


def test_a_turned_session_stacks_right_by_wcs(spark):
    """A frame with a WCS is put where the sky says, one without by its stars, and the canvas holds them all."""
    frames, images = turned_session(spark, TURNS, wcs=True)
    frames = frames.withColumn("crpix1", F.when(F.col("frame_id") != 1, F.col("crpix1")))
    out = pipeline.run(frames, pipeline.Config(cosmic_sigma=None, order=3, canvas="union", max_stars=40), model=no_model(spark, 72))
    meta = {r.frame_id: r for r in out["frames"].collect()}
    assert [meta[k].registered for k in range(4)] == ["wcs", "stars", "wcs", "wcs"]
    canvas = out["canvas"].first()
    assert canvas.rows > 72 and canvas.cols > 72 and canvas.row0 > 0 and canvas.col0 > 0
    spots = out["stack"].agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    assert min(spots) >= 0 and spots[1] < canvas.rows and spots[3] < canvas.cols and spots[1] > canvas.rows - 4
    got = grid(out["stack"], "weighted_mean", (canvas.rows, canvas.cols))[canvas.row0 : canvas.row0 + 72, canvas.col0 : canvas.col0 + 72]
    assert np.corrcoef(got[18:54, 18:54].ravel(), images[0][18:54, 18:54].ravel())[0, 1] > 0.99
    m = meta[3].to_reference  # half a turn, less ten degrees, about the middle
    assert (m.a, m.d) == pytest.approx((np.cos(np.radians(170)), np.sin(np.radians(170))), abs=1e-4) or (m.a, m.d) == pytest.approx((np.cos(np.radians(170)), -np.sin(np.radians(170))), abs=1e-4)


def test_the_exact_mode_solves_a_turned_session(spark, tmp_path):
    """Frames as they lie, each with its own width, give a sharper scene than the stack's mean; ignoring the turn doesn't."""
    frames, images = turned_session(spark, TURNS[:3], size=48)
    cfg = lambda: pipeline.Config(cosmic_sigma=None, max_stars=40, solve=True, psf_size=9, solver=solver.SolverConfig(scale=1, iterations=40, rate=1.0, mode="exact", batch=2, tv=1e-4))
    out = pipeline.run(frames, cfg(), model=no_model(spark, 48))
    where = pipeline.save(out, str(tmp_path), 0, images=True)
    assert sorted(where) == ["frames", "history", "images", "model", "solution", "stack"]
    assert sorted(p.name for p in (tmp_path / "images").iterdir()) == ["fast_stack.fits", "map_L.fits", "stack_L.fits"]
    log = spark.read.parquet(where["history"]).orderBy("step").collect()
    assert [r.step for r in log] == [0, 10, 20, 30, 39] and log[0].change is None and log[-1].loss < log[0].loss
    assert log[2].change == pytest.approx(abs(log[1].loss - log[2].loss) / abs(log[1].loss)) and not log[1].calm
    got = grid(out["solution"], "flux", (48, 48))[12:36, 12:36]
    sharp = images[0][12:36, 12:36]
    assert np.isfinite(got).all() and np.corrcoef(got.ravel(), sharp.ravel())[0, 1] > 0.9


def no_model(spark, size):
    """An instrument that changes nothing."""
    maps = {"bias_mean": np.zeros((size, size)), "dark_rate": np.zeros((size, size)), "flat_gain": np.ones((size, size))}
    return framewise.model_table(spark, maps, size)


def test_aligned_psf():
    """Stars anywhere between pixels give one kernel about the middle, as wide as they are; too few give none."""
    g = np.random.default_rng(7)
    y, x = np.mgrid[:120, :120].astype(float)
    places = [(20 + 30 * j + g.uniform(-0.5, 0.5), 20 + 30 * i + g.uniform(-0.5, 0.5)) for j in range(4) for i in range(3)]
    net = sum(f * np.exp(-((y - b) ** 2 + (x - a) ** 2) / (2 * 1.7**2)) for (b, a), f in zip(places, g.uniform(50, 900, 12)))
    stars = np.array([(b, a, 1.0) for b, a in places])
    psf = kernel.aligned_psf(net, stars, 15)
    want = kernels.gaussian_psf(15, 1.7 * 2.3548)
    assert psf.sum() == pytest.approx(1) and np.abs(psf - want).max() < 2e-3 * want.max() + 1e-4
    assert kernel.aligned_psf(net, stars[:4], 15) is None and kernel.aligned_psf(net * 0, stars, 15) is None
    fine = kernel.finer_psf(psf, 3)
    assert fine.shape == (43, 43) and fine.sum() == pytest.approx(1) and fine.argmax() == 21 * 43 + 21
    assert kernels.fwhm_of_psf(fine) == pytest.approx(3 * kernels.fwhm_of_psf(psf), rel=0.05)


def test_a_frame_without_stars_takes_the_psf_before_it(spark):
    rows = [(0, 1, False), (1, 1, True), (2, 1, False), (3, 2, False), (4, 1, False), (5, 2, True), (6, 1, True)]
    meta = spark.createDataFrame([(f, p) for f, _, p in rows], "frame_id long, has_psf boolean")
    lights = spark.createDataFrame([(f, s) for f, s, _ in rows], "frame_id long, session int")
    got = {r.frame_id: r.psf_frame for r in framewise.with_psf_frame(meta, lights).collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: None, 4: 1, 5: 5, 6: 6}


def test_tiles_by_definition():
    g = np.random.default_rng(3)
    v = g.normal(10, 1, 200)
    v[:9] = 500.0
    kept = v
    for _ in range(3):
        m = np.median(kept)
        s = 1.4826 * np.median(np.abs(kept - m))
        kept = kept[np.abs(kept - m) <= 3 * s]
    assert kernel.tile_median(v) == pytest.approx(np.median(kept))
    assert kernel.tile_median(np.array([1.0, 2.0, 900.0])) == 2.0 and kernel.tile_median(np.full(9, 4.0)) == 4.0
    image = g.normal(0, 1, (300, 40))
    mesh = kernel.sky_mesh(image, 64)
    spans = kernel.tile_bounds(4, 300, 64)
    assert mesh.shape == (4, 2) and spans[0] == (0, 32) and spans[-1][1] == 300
    assert mesh[1, 0] == pytest.approx(kernel.tile_median(image[slice(*spans[1]), 0:32].ravel()))


def test_a_sloping_sky_is_taken_off(spark):
    """Stars on a bright slope: the level stays, the slope goes, and the stack is flat between the stars."""
    frames, images = turned_session(spark, [(0.0, 0.0, 0.0), (0.0, 1.0, 2.0)], size=160)
    slope = [float(30 * (k % 160) / 160) for k in range(160 * 160)]
    frames = frames.withColumn("data", F.zip_with("data", F.lit(slope), lambda a, b: a + b))
    out = pipeline.run(frames, pipeline.Config(cosmic_sigma=None, max_stars=40, sky_box=40), model=no_model(spark, 160))
    level = {r.frame_id: r.sky for r in out["frames"].collect()}
    assert level[0] == pytest.approx(65, abs=3)
    got = grid(out["stack"], "weighted_mean", (160, 160))
    edge = [np.nanmedian(got[20:140, c : c + 12]) for c in (6, 142)]
    assert abs(edge[0]) < 2.5 and abs(edge[1]) < 2.5
    assert [r.has_psf for r in out["frames"].collect()] == [True, True]


def test_canvas_around_frames(spark):
    rows = [(0, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)), (1, (1.0, 0.0, -2.5, 0.0, 1.0, 3.0)), (2, (0.0, -1.0, 9.0, 1.0, 0.0, 0.0))]
    meta = spark.createDataFrame(rows, "frame_id long, to_reference struct<a: double, b: double, c: double, d: double, e: double, f: double>")
    assert framewise.union_canvas(meta, 10, 12) == framewise.Canvas(13, 15, 0, 3)
    assert framewise.union_canvas(meta.limit(0), 10, 12) == framewise.Canvas(10, 12)
    m = dict(zip(framewise.AFFINE, rows[1][1]))
    assert framewise.from_canvas(m, framewise.Canvas(13, 15, 0, 3)) == pytest.approx((1, 0, -0.5, 0, 1, -3))


def test_one_pattern_only(spark):
    d = spark.createDataFrame([("RGGB",), ("GBRG",)], "bayer_pattern string")
    assert framewise.is_colour(d.limit(1)) in ("RGGB", "GBRG") and framewise.is_colour(d.limit(0)) is None
    with pytest.raises(ValueError):
        framewise.is_colour(d)
