"""Ground-truth measures, stored products, solve modes and small operators."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonloom.functions import kernels
from photonloom.operators import calibration, geometry, mixture, solver, synth, validation
from photonloom.plans import ground_truth, pipeline, posterior
from photonloom.sources import fits, store


@pytest.fixture(scope="module")
def products(spark, tmp_path_factory):
    cfg = synth.Session(32, 36, 8, 3, (120.0, 600.0), 8, n_light=3, n_stars=12)
    frames = synth.generate_session(spark, cfg).cache()
    folder = str(tmp_path_factory.mktemp("run"))
    out = pipeline.run(frames)
    pipeline.save(out, folder, out["frames"].agg(F.min("frame_id")).first()[0])
    return frames, out, folder


def test_all_ten_measures(spark):
    verdict = ground_truth.report(spark, ground_truth.measures(spark, synth.FAST, 60)).cache()
    by = {r["name"]: r for r in verdict.collect()}
    print(ground_truth.report_text(verdict))
    assert len(by) == 10 and all(r.value is not None for r in by.values())
    assert by["bias_mae_pct"].passed and by["flat_mae_pct"].passed and by["shift_error_px"].passed and by["fast_pearson"].passed
    # eight bias frames don't give a pixel's noise to 5 per cent, and short darks not its rate
    assert by["rn_mae_pct"].value > 5 and by["dark_mae_pct"].value > 10
    text = ground_truth.report_text(verdict)
    assert len(text.splitlines()) == 11 and "limit < 2.0" in text
    flat = np.ones((4, 4))
    assert ground_truth.pearson(flat, flat) == 0 and ground_truth.pearson(np.arange(4.0), np.array([1.0, 2.0, np.nan, 4.0])) == pytest.approx(1)


def test_calibration_is_measured_by_pixel():
    """Maps that are right in the middle but wrong pixel by pixel fail."""
    true = synth.instrument(20, 30)
    g = np.random.default_rng(4)
    assert set(ground_truth.calibration_errors(true, true).values()) == {0.0}
    noisy = {c: v * g.choice([0.7, 1.3], v.shape) for c, v in true.items() if c != "hot_pixel"}
    found = ground_truth.calibration_errors(noisy, true)
    assert all(v == pytest.approx(30, rel=0.1) for v in found.values())
    hot = {**true, "dark_rate": np.where(true["hot_pixel"], 99.0, true["dark_rate"])}
    assert ground_truth.calibration_errors(hot, true)["dark_mae_pct"] == 0.0
    assert all(not (v < validation.LIMITS[n][1]) for n, v in found.items())


def test_stored_run(spark, products):
    _, out, folder = products
    assert store.frame_count(spark, folder) == 3 and store.sensor_shape(spark, folder) == (32, 36)
    stack, meta = store.load_stack(spark, folder)
    store.write_products(store.stack_products(stack, meta, 32, 36), f"{folder}/fits")
    files = {r.path.rsplit("/", 1)[-1]: r for r in fits.read_shared(spark, f"{folder}/fits").collect()}
    assert sorted(files) == ["fast_stack.fits", "stack_L.fits"]
    mean = store.image_of(out["stack"], "weighted_mean", 32, 36)
    for r in files.values():
        assert r.header["NFRAMES"] == "3" and float(r.header["MEDTRANS"]) > 0 and np.reshape(r.data, (32, 36)) == pytest.approx(mean, rel=1e-6, nan_ok=True)
    assert files["fast_stack.fits"].header["CHAN1"] == "L"
    quality = fits.read_shared(spark, f"{folder}/fits", hdu=2).where("path LIKE '%stack_L%'").first()
    assert np.nanmax(quality.data) == pytest.approx(1)
    cfg = solver.SolverConfig(iterations=5)
    assert solver.run_from_stack(spark, folder, cfg, 32, 36, 9).count() == 64 * 72


def test_products_of_several_channels(spark, tmp_path):
    """A cube of all planes, a file for each, and a solution with its quality; nothing is left of a job that fails, and once of one that is repeated."""
    rows = [(c, y, x, float(10 * k + y + x / 10), 1.0, 0.5) for k, c in enumerate(("B", "G0", "G1", "R")) for y in range(3) for x in range(4) if (c, y, x) != ("R", 0, 0)]
    stack = spark.createDataFrame(rows, "channel string, y int, x int, weighted_mean double, variance double, quality double")
    meta = spark.createDataFrame([(0.9, 2.0), (0.7, None)], "transparency double, fwhm double")
    for _ in range(2):
        store.write_products(store.stack_products(stack, meta, 3, 4), str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 5
    header, cube = fits.read_fits((tmp_path / "fast_stack.fits").read_bytes())
    assert cube.shape == (4, 3, 4) and [header[f"CHAN{k}"] for k in (1, 2, 3, 4)] == ["B", "G0", "G1", "R"] and float(header["MEDTRANS"]) == pytest.approx(0.8)
    assert np.isnan(cube[3, 0, 0]) and cube[1, 2, 3] == pytest.approx(12.3)
    solution = spark.createDataFrame([("B", y, x, float(y * 8 + x)) for y in range(6) for x in range(8)], "channel string, y int, x int, flux double")
    store.write_products(store.solution_products(solution, stack.withColumn("quality", F.col("y") / 2), 3, 4), str(tmp_path))
    header, image = fits.read_fits((tmp_path / "map_B.fits").read_bytes())
    assert image[5, 7] == 47 and header["SCALE"] == "2" and fits.read_fits((tmp_path / "map_B.fits").read_bytes(), 1)[1][5, 0] == 1.0
    bad = store.stack_products(stack, meta, 3, 4).withColumn("h", F.when(F.col("name") == "stack_R", 7).otherwise(F.col("h")))
    with pytest.raises(Exception):
        store.write_products(bad, str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.fits"))


def test_reading_headers_planes_and_small_images(spark, tmp_path):
    image = np.arange(40.0).reshape(5, 8)
    (tmp_path / "a.fits").write_bytes(fits.write_fits(image, {"BAYERPAT": "GRBG"}))
    (tmp_path / "b.fits").write_bytes(fits.write_fits(image, {}, [("MORE", image * 2)]))
    (tmp_path / "c.fits").write_bytes(fits.write_fits(image, {})[:2880] + b"cut short")
    fits.register(spark)
    read = lambda **o: {r.path[-6]: r for r in spark.read.format("fits").options(**o).load(str(tmp_path)).collect()}
    heads = read(headers_only="true")
    assert all((r.h, r.w, r.planes, r.data, r._error) == (5, 8, 1, None, None) for r in heads.values())  # not even a file without its data is an error
    planes = read(planes="true")
    assert (planes["a"].planes, planes["a"].h, planes["a"].w) == (4, 2, 4) and planes["b"].planes == 1 and planes["c"]._error
    assert np.reshape(planes["a"].data, (4, 2, 4))[0] == pytest.approx(image[0:4:2, 1::2])  # R
    small = read(max_size="4")
    assert (small["b"].h, small["b"].w) == (2, 4) and np.reshape(small["b"].data, (2, 4)) == pytest.approx(image[:4].reshape(2, 2, 4, 2).mean(axis=(1, 3)))
    assert read(hdu="1", headers_only="true")["b"].header["EXTNAME"] == "MORE"
    assert fits.read_shared(spark, str(tmp_path), headers_only=True).where("data IS NULL AND h = 5").count() == 3


def test_plate_solver_process(spark, tmp_path):
    """The program's word, its header, its time limit with all its processes, and its failure are each a row."""
    for name in "abcd":
        (tmp_path / f"{name}.fits").write_bytes(fits.write_fits(np.zeros((4, 4)), {"OBJCTRA": "10 30 00", "OBJCTDEC": "-20:30:00"}))
    solved = tmp_path / "solved.fits"
    solved.write_bytes(fits.write_fits(np.zeros((4, 4)), {"CRVAL1": 157.5, "CRPIX1": 2.0, "CD1_1": -0.001}))
    program = tmp_path / "solver.sh"
    program.write_text(f"""#!/bin/sh
case "$2" in
  *a.fits) cp {solved} "$2"; echo "Solution found: $*" ;;
  *b.fits) echo "nothing" ;;
  *c.fits) (sleep 97 & echo $! > {tmp_path}/pid; wait) ;;
  *) exit 3 ;;
esac
""")
    program.chmod(0o755)
    solver_ = fits.PlateSolver(str(program), seconds=2.0)
    command = solver_.command("x", {"OBJCTRA": "10 30 00", "OBJCTDEC": "-20:30:00"})
    assert command[-4:] == ["-ra", "10.500000", "-spd", "69.500000"] and "-ra" not in solver_.command("x", {})
    d = spark.createDataFrame([(k, str(tmp_path / f"{n}.fits")) for k, n in enumerate("abcd")], "frame_id long, path string")
    got = {r.frame_id: r for r in fits.solve_plates(d, solver_).collect()}
    assert [got[k].solve_status for k in range(4)] == ["solved", "failed", "error: no solution within 2 s", "failed"]
    assert got[0].wcs == {"CRVAL1": 157.5, "CRPIX1": 2.0, "CD1_1": -0.001}
    at = Path("/proc") / (tmp_path / "pid").read_text().strip() / "stat"
    assert not at.exists() or at.read_text().rsplit(")", 1)[1].split()[0] == "Z"  # ended, whether or not anyone has asked after it
    row = fits.with_wcs(fits.solve_plates(d.where("frame_id = 0"), lambda p: {"CRVAL1": 1.5}), "wcs").first()
    assert row.crval1 == 1.5 and row.cd11 is None


def test_solve_modes(spark, products):
    frames, out, _ = products
    meta = [{"t": r.transparency, "psf": kernels.gaussian_psf(9, 6.0)} for r in out["frames"].collect()]
    cfg = solver.SolverConfig(iterations=3, mode="exact")
    with pytest.raises(ValueError):
        solver.solve(cfg, out["stack"], meta, 32, 36)
    lights = frames.where("frame_type = 'light'").select("frame_id", F.lit("L").alias("channel"), "data", F.lit(0.9).alias("transparency"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"))
    got = solver.solve(cfg, out["stack"], meta, 32, 36, lights)
    assert got.count() == 64 * 72 and got.where("flux < 0").count() == 0
    assert solver.solve(solver.SolverConfig(iterations=3), out["stack"], meta, 32, 36).columns == got.columns


def test_mixture_store_and_invalidation(spark, tmp_path):
    m = mixture.Mixture((0.9, 0.06, 0.04), (5.0, 2.0, 2.0), (0.004, 0.0004, 0.02), (-3.0, -2.5), True)
    px = mixture.labels(spark.createDataFrame([(k, 0.001 * 4**k) for k in range(1, 9)], "pixel long, rate double"), m)
    store.save_mixture(m, px, str(tmp_path))
    (tmp_path / "notes.txt").write_text("mine")
    back, pixels = store.load_mixture(spark, str(tmp_path))
    assert back == m and pixels.count() == 8
    assert sum(mixture.label_counts(px).first()) == 8
    assert store.invalidate(spark, str(tmp_path)) == ["mixture"] and (tmp_path / "notes.txt").exists()
    with pytest.raises(ValueError):
        store.invalidate(spark, str(tmp_path), ("notes.txt",))


def test_affine_warp_and_power():
    g = np.random.default_rng(1)
    image = g.random((21, 21))
    assert kernels.affine_warp(image, 5e-5, 0, 0, 1 + 5e-6) is image
    assert kernels.affine_warp(image, 0, 2, -3)[5:-5, 5:-5] == pytest.approx(np.roll(image, (2, -3), (0, 1))[5:-5, 5:-5])
    assert kernels.affine_warp(image, 180, 0, 0) == pytest.approx(image[::-1, ::-1])
    turned = kernels.affine_warp(image, 90, 0, 0)
    assert turned == pytest.approx(np.rot90(image, -1)) or turned == pytest.approx(np.rot90(image))
    p = kernels.radial_power(np.cos(2 * np.pi * np.arange(64) / 8)[:, None] * np.ones(64), 8)
    assert p.argmax() == 2
    assert kernels.power_ratio_above(image * 2, image, 2) == pytest.approx(4)


def test_small_records(spark):
    d = spark.createDataFrame([(1, 2.0), (2, -9999.0)], "frame_id int, dx_px double").selectExpr("*", "0D AS dy_px", "0D AS dx_arcsec", "0D AS dy_arcsec", "0D AS rotation_deg", "1D AS scale_ratio")
    assert [r.shift.dx_px if r.shift else None for r in geometry.shift_record(d).orderBy("frame_id").collect()] == [2.0, None]
    p = spark.createDataFrame([("RGGB",), (None,)], "p string")
    assert [r[0] for r in p.select(calibration.is_colour(F.col("p"))).collect()] == [True, False]
    s = spark.createDataFrame([(-9999.0,), (5.0,)], "v double")
    assert [r.v for r in store.from_sentinel(s, "v").collect()] == [None, 5.0]
    h = spark.createDataFrame([(4.0, -2.0)], "dx_to_ref double, dy_to_ref double")
    assert tuple(geometry.half_resolution(h).first()) == (2.0, -1.0)


def test_masks_of_one_frame_stay_in_it(spark):
    from photonloom.operators import neighbourhood

    rows = [(f, "L", y, x, 100.0 + y) for f in (0, 1) for y in range(6) for x in range(6)]
    px = spark.createDataFrame(rows, "frame_id int, channel string, y int, x int, adu double").withColumn("adu", F.when(F.expr("y = 2 AND x = 2"), F.when(F.col("frame_id") == 0, 9000.0).otherwise(555.0)).otherwise(F.col("adu")))
    mask = neighbourhood.outlier_mask(px.where("frame_id = 0"), 10.0)
    got = {r.frame_id: r.adu for r in neighbourhood.replace_masked(px, mask, 6, 6).where("y = 2 AND x = 2").collect()}
    assert got == {0: 102.0, 1: 555.0}
    both = {r.frame_id: r.adu for r in neighbourhood.replace_masked(px, mask.drop("frame_id"), 6, 6).where("y = 2 AND x = 2").collect()}
    assert both == {0: 102.0, 1: 102.0}


def test_a_folder_of_lights_hides_no_calibration_frames(spark):
    d = spark.createDataFrame([("/a/lights/1.fits", {"IMAGETYP": "x"}), ("/a/n/2.fits", {"IMAGETYP": "Dark Frame"}), ("/a/n/3.fits", {"IMAGETYP": "Bias"})], "path string, header map<string,string>")
    assert [r.frame_type for r in fits.discover(d).orderBy("path").collect()] == ["light", "dark", "bias"]
    e = d.unionByName(spark.createDataFrame([("/a/darks/4.fits", {"IMAGETYP": "Light"})], d.schema))
    assert {r.path[-6]: r.frame_type for r in fits.discover(e).collect()} == {"1": "light", "4": "dark"}


def test_history_on_a_logarithmic_axis(spark):
    """Positive losses as they are; others by what they are above the least."""
    one = lambda name, losses: (name, 1, 1, [0.0], losses, [0.0] * len(losses), 1, len(losses), True)
    d = spark.createDataFrame([one("a", [100.0, 10.0, 1.0]), one("b", [90.0, -10.0])], solver.SOLVED)
    by = {(r.channel, r.step): r.log10_loss for r in solver.history_of(d).collect()}
    assert [by["a", k] for k in range(3)] == pytest.approx([2, 1, 0])
    assert by["b", 0] == pytest.approx(2) and by["b", 1] == pytest.approx(-12, abs=0.01)


def test_a_session_of_an_instrument_drawn_from_posteriors(spark):
    """What is learned from one session makes the next, whose own posteriors agree with the maps that were drawn."""
    cfg = synth.Session(16, 20, 12, 4, (120.0, 600.0), 8, n_light=1, n_stars=3)
    state = posterior.updated(synth.generate_session(spark, cfg), posterior.start(16, 20))
    drawn = synth.instrument_from_posteriors(state, seed=5)
    again = synth.instrument_from_posteriors(state, seed=5)
    assert all(np.array_equal(drawn[k], again[k]) for k in drawn) and drawn["flat_gain"].min() >= 0.05 and drawn["read_noise"].min() >= 0.1
    maps = posterior.maps_of(state)
    z = (drawn["bias_mean"] - maps["bias_mean"]) * np.sqrt(state["bias"][0])
    assert abs(z.mean()) < 0.2 and 0.85 < z.std() < 1.15
    seen = posterior.maps_of(posterior.updated(synth.generate_session(spark, cfg, true=drawn), posterior.start(16, 20)))
    assert np.corrcoef(seen["bias_mean"].ravel(), drawn["bias_mean"].ravel())[0, 1] > 0.9
    assert np.corrcoef(seen["flat_gain"].ravel(), drawn["flat_gain"].ravel())[0, 1] > 0.9


def test_regions_of_an_exposed_scene(spark):
    """Disc, Gaussian and background of a vignetted sky scatter as expected about the truth."""
    px = synth.exposed(synth.sky_scene(spark, 96, 80), 10, 60.0, 5.0).cache()
    assert px.count() == 96 * 80 and px.where("vignetting > 1 or vignetting <= 0").count() == 0
    corner, centre = (px.where(f"y = {y} and x = {x}").first().vignetting for y, x in ((0, 0), (47, 39)))
    assert corner < 0.9 < centre
    got = {r.region: r for r in validation.region_stats(px, "rate", "true_sky", "sigma").collect()}
    assert set(got) == {"disc", "gauss", "background"} and sum(r.n for r in got.values()) == 96 * 80
    for r in got.values():
        assert abs(r.bias_frac) < 0.01 and r.chi2 == pytest.approx(1, abs=5 * (2 / r.n) ** 0.5)
    assert got["disc"].true_mean > 1.3 * got["background"].true_mean


def test_pointings_give_back_the_shifts(spark):
    """Headers of a made session lead through the sky to the shifts that its lights were made with."""
    cfg = synth.Session(32, 36, 2, 1, (120.0,), 2, n_light=4, n_stars=3)
    frames = synth.with_headers(synth.generate_session(spark, cfg), cfg).drop("data")
    d = fits.with_wcs(frames).cache()
    assert d.where("frame_type <> 'light'").where("crval1 IS NOT NULL").count() == 0 and d.where("frame_type = 'light'").count() == 4
    lights = d.where("frame_type = 'light'")
    first = lights.orderBy("frame_id").limit(1)
    got = geometry.frame_shift(lights, first, 32, 36).orderBy("frame_id").collect()
    for r, (_, dx, dy, *_) in zip(got, synth.light_truth(cfg)):
        assert (r.dx_to_ref, r.dy_to_ref) == pytest.approx((-dx, -dy), abs=1e-3)


def test_unmeasured_widths_go_through_the_telescope():
    cfg = pipeline.Config(optics=(3.76, 100.0, 1500.0, 550.0, 0.3))
    plain, seen = pipeline.psf_of(None, pipeline.Config()), pipeline.psf_of(None, cfg)
    y, x = np.mgrid[: cfg.psf_size, : cfg.psf_size] - cfg.psf_size // 2
    spread = lambda p: float((p * (y * y + x * x)).sum())
    assert seen.sum() == pytest.approx(1) and seen.min() >= 0 and spread(seen) > spread(plain)
    assert np.unravel_index(seen.argmax(), seen.shape) == (cfg.psf_size // 2,) * 2
    assert np.array_equal(pipeline.psf_of(2.5, cfg), pipeline.psf_of(2.5, pipeline.Config()))
