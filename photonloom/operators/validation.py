"""Measures of how well products agree with the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import radial_power
from . import images


def agreement(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """rmse, psnr (infinite without error, 0 without range) and pearson (0 without spread) of two columns; b is the truth."""
    d = F.col(a) - F.col(b)
    g = pairs.groupBy(*by).agg(F.avg(d * d).alias("mse"), (F.max(b) - F.min(b)).alias("range"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.covar_pop(a, b).alias("cov"))
    psnr = F.when(F.col("range") < 1e-9, 0.0).when(F.col("mse") < 1e-15, F.lit(float("inf"))).otherwise(20 * F.log10(F.col("range") / F.sqrt("mse")))
    flat = (F.col("sa") < 1e-9) | (F.col("sb") < 1e-9)
    return g.select(*by, F.sqrt("mse").alias("rmse"), psnr.alias("psnr"), F.when(flat, 0.0).otherwise(F.col("cov") / F.when(~flat, F.col("sa") * F.col("sb"))).alias("pearson"))


def stack_accuracy(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """agreement of two images less their means: of a stack and the scene that it shows, whatever sky lies under both."""
    m = pairs.groupBy(*by).agg(F.avg(a).alias("__a"), F.avg(b).alias("__b"))  # a row for each image
    d = pairs.join(m, list(by)) if by else pairs.join(F.broadcast(m))
    return agreement(d.withColumns({a: F.col(a) - F.col("__a"), b: F.col(b) - F.col("__b")}), a, b, by)


def relative_error(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """mae_pct: the mean absolute error in per cent of the truth's mean absolute value."""
    return pairs.agg((100 * F.avg(F.abs(F.col(a) - F.col(b))) / F.avg(F.abs(b))).alias("mae_pct"))


def parameter_error(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Medians of both, median and 95th percentile of the absolute error, and its share of the truth's median."""
    e = F.abs(F.col(a) - F.col(b))
    return pairs.agg(F.median(a).alias("median_found"), F.median(b).alias("median_true"), F.median(e).alias("median_error"), F.percentile(e, 0.95).alias("p95_error")).withColumn("share", F.col("median_error") / F.col("median_true"))


def noise_budget(px: DataFrame, model: DataFrame, gain: float = 1.0, by: Sequence[str] = ("channel", "y", "x")) -> DataFrame:
    """chi2 by pixel: the variance over frames against sky * t / g + dark * t / g^2 + rn^2 / g^2. model: sky, dark_rate, read_noise, flat_gain."""
    v = px.groupBy(*by).agg(F.var_samp("calibrated").alias("variance"), F.avg("exposure_s").alias("t"))
    g = F.col("flat_gain") * gain
    expected = F.col("sky") * F.col("t") / g + F.col("dark_rate") * F.col("t") / (g * g) + F.pow("read_noise", F.lit(2.0)) / (g * g)
    return v.join(model, list(by)).select(*by, "variance", expected.alias("expected"), (F.col("variance") / expected).alias("chi2"))


def region_masks(px: DataFrame, disc: tuple[float, float, float], gauss: tuple[float, float, float]) -> DataFrame:
    """px with in_disc, in_gauss (within a radius of a centre: y, x, r) and in_background (in neither)."""
    near = lambda c: F.pow(F.col("y") - c[0], F.lit(2.0)) + F.pow(F.col("x") - c[1], F.lit(2.0)) <= c[2] ** 2
    return px.withColumns({"in_disc": near(disc), "in_gauss": near(gauss), "in_background": ~(near(disc) | near(gauss))})


def region_stats(px: DataFrame, value: str, truth: str, sigma: str) -> DataFrame:
    """mean, std (population), expected sigma, chi2 and bias_frac of each region; a pixel counts in each region it is in."""
    names = ("in_disc", "in_gauss", "in_background")
    regions = F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n[3:])) for n in names])))
    d = px.withColumn("region", regions)
    g = d.groupBy("region").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.avg(sigma).alias("sigma"), F.avg(F.pow((F.col(value) - F.col(truth)) / F.col(sigma), F.lit(2.0))).alias("chi2"), F.avg(truth).alias("true_mean"), F.count("*").alias("n"))
    return g.withColumn("bias_frac", (F.col("mean") - F.col("true_mean")) / F.col("true_mean"))


def radial_profile(px: DataFrame, cy: float, cx: float, bins: int, radius: float, value: str = "adu") -> DataFrame:
    """The mean of value by ring around a centre."""
    r = F.hypot(F.col("y") - cy, F.col("x") - cx)
    b = F.width_bucket(r, F.lit(0.0), F.lit(float(radius)), F.lit(bins))
    return px.withColumn("ring", b).where(F.col("ring").between(1, bins)).groupBy("ring").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def ring_power(frames: DataFrame, bins: int) -> DataFrame:
    """The mean power of each of frames(frame_id, h, w, data) in rings of spatial frequency from 0 to half a cycle a pixel: frame_id, ring, frequency (its middle), power."""

    def work(image, row):
        return [(row["frame_id"], k, (k + 0.5) / (2 * bins), float(p)) for k, p in enumerate(radial_power(image, bins))]

    return images.measure_images(frames, f"frame_id {dict(frames.dtypes)['frame_id']}, ring int, frequency double, power double", work)


#: A session passes if its measures lie on the right side of these (fixed values).
LIMITS = {"bias_mae_pct": ("<", 2.0), "rn_mae_pct": ("<", 5.0), "dark_mae_pct": ("<", 10.0), "flat_mae_pct": ("<", 3.0), "fwhm_error_px": ("<", 0.5), "transparency_error": ("<", 0.05), "shift_error_px": ("<", 0.5), "fast_pearson": (">", 0.90), "map_pearson": (">", 0.90), "psd_ratio": (">", 1.1)}


def verdict(measures: DataFrame) -> DataFrame:
    """measures(name, value) with passed (null values fail) and the number of passes in n_passed."""
    test = F.lit(False)
    for name, (side, limit) in LIMITS.items():
        test = F.when(F.col("name") == name, F.col("value") < limit if side == "<" else F.col("value") > limit).otherwise(test)
    d = measures.withColumn("passed", F.coalesce(test, F.lit(False)))
    return d.join(F.broadcast(d.agg(F.count_if("passed").alias("n_passed"))))
