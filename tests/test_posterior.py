"""Posteriors in the run: against the operators over pixels, carried over, stored by session."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonloom.operators import bayes, synth
from photonloom.plans import pipeline, posterior
from photonloom.plans.adapters import explode_frames
from photonloom.sources import store

H, W = 20, 24


@pytest.fixture(scope="module")
def session(spark):
    cfg = synth.Session(H, W, 6, 2, (120.0, 600.0), 6, n_light=2, n_stars=6)
    return synth.generate_session(spark, cfg).cache()


def grid(df, column):
    out = np.full((H, W), np.nan)
    for r in df.select("y", "x", column).collect():
        out[r.y, r.x] = r[column]
    return out


def test_posteriors_equal_those_of_pixels(spark, session):
    """The ordered fold of bias and noise, whatever the bands, and the sums of dark and flat."""
    after = posterior.updated(session, posterior.start(H, W))
    px = explode_frames(session)
    fold = bayes.ordered_fold(px.where("frame_type = 'bias'"))
    maps = posterior.maps_of(after)
    assert maps["bias_mean"] == pytest.approx(grid(fold, "bias_mean")) and maps["read_noise"] == pytest.approx(grid(fold, "read_noise"))
    narrow = posterior.ordered_bias(session.where("frame_type = 'bias'"), posterior.start(H, W), H, W, group_bytes=8 * W * 6 * 3)
    assert all(narrow[k][i] == pytest.approx(after[k][i]) for k in ("bias", "read_noise") for i in (0, 1)) and narrow["bias"][2] == 6
    known = fold.select("channel", "y", "x", "bias_mean")
    dark = bayes.dark_posterior(px.where("frame_type = 'dark'").join(known, ["channel", "y", "x"]), "bias_mean")
    assert after["dark"][0] == pytest.approx(grid(dark, "alpha")) and after["dark"][1] == pytest.approx(grid(dark, "beta"))
    rate = dark.select("channel", "y", "x", "rate")
    flats = px.where("frame_type = 'flat'").join(fold, ["channel", "y", "x"]).join(rate, ["channel", "y", "x"]).withColumn("net", F.col("adu") - F.col("bias_mean") - F.col("rate") * F.col("exposure_s"))
    flats = flats.join(flats.groupBy("frame_id").agg(F.median("net").alias("signal")), "frame_id").withColumn("norm", F.col("net") / F.col("signal"))
    flat = bayes.flat_posterior(flats, "norm", "signal", "read_noise")
    assert after["flat"][0] == pytest.approx(grid(flat, "precision")) and after["flat"][1] == pytest.approx(grid(flat, "numerator"))
    assert np.median(maps["flat_gain"]) == pytest.approx(1)


def test_sessions_carry_over(spark, session, tmp_path):
    """The second session starts from the first one's posteriors, at its own temperature; versions stay side by side."""
    folder = str(tmp_path)
    cfg = lambda t: pipeline.Config(bayes=True, temperature=t, cosmic_sigma=None)
    first = pipeline.run(session, cfg(-10.0))
    pipeline.save(first, folder, 0, "s1")
    state = store.load_state(spark, folder)
    assert {r.param: r.n for r in state.groupBy("param").agg(F.max("n").alias("n")).collect()} == {"bias": 6, "read_noise": 6, "dark": 4, "flat": 6}
    lights = session.where("frame_type IN ('light', 'bias')")  # a night without darks and flats
    second = pipeline.run(lights, cfg(-5.0), state=state)
    pipeline.save(second, folder, 0, "s2")
    back = store.load_state(spark, folder)
    assert {r.param for r in store.load_state(spark, folder, seen=True).select("param").distinct().collect()} == {"bias", "read_noise"}
    assert store.load_state(spark, folder, "s1").where("param = 'bias' AND n = 6").count() == H * W
    assert back.agg(F.min("ref_temp_c"), F.max("ref_temp_c")).first() == (-5.0, -5.0)
    a, b = (posterior.state_of(store.load_state(spark, folder, s), H, W) for s in ("s1", "s2"))
    assert (b["bias"][0] > a["bias"][0]).all()  # surer than before
    warm = spark.range(1).select(bayes.arrhenius(F.lit(1.0), F.lit(-10.0), F.lit(-5.0)).alias("k")).first().k
    assert b["dark"][0] == pytest.approx(a["dark"][0] * warm)
    assert second["stack"].count() > 0 and first["model"].where("flat_gain IS NULL").count() == 0


def test_projection_of_moments(spark):
    rows = [("bias", 301.0, 2.0), ("flat", 1.02, 0.1), ("dark", 0.004, 0.001), ("read_noise", 36.0, 6.0), ("bias", 1.0, 0.0), ("dark", 1.0, None)]
    got = {r.param: (r.p1, r.p2) for r in bayes.projected(spark.createDataFrame(rows, "param string, mean double, std double")).collect()}
    assert len(got) == 4
    p, q = got["bias"]
    assert (q / p, 1 / np.sqrt(p)) == pytest.approx((301, 2))
    a, b = got["dark"]
    assert (a / b, np.sqrt(a) / b) == pytest.approx((0.004, 0.001))
    a, b = got["read_noise"]
    assert (b / (a - 1), b / (a - 1) / np.sqrt(a - 2)) == pytest.approx((36, 6))


def test_nothing_seen_leaves_the_priors(spark, session):
    none = posterior.updated(session.where("frame_type = 'light'"), posterior.start(H, W))
    assert all(none[k][2] == 0 for k in none) and "hot_pixel" not in posterior.maps_of(none)
    rows = posterior.table(spark, none, -10.0)
    back = posterior.state_of(rows, H, W)
    assert all((back[k][i] == none[k][i]).all() for k in none for i in (0, 1))
