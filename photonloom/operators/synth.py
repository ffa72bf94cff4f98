"""Synthetic sessions with a known truth: instruments, calibration frames, scenes, star fields.

Random numbers are drawn by (seed, frame) or (seed, stream) in NumPy, so a
frame is the same wherever and however often its task runs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import convolve, fourier_shift, pool
from .bayes import Priors
from .calibration import BAYER
from .validation import region_masks

FRAME = "frame_id long, seq long, session string, frame_type string, exposure_s double, h int, w int, data array<double>"


@dataclass(frozen=True)
class Session:
    """Sizes of a session; the defaults are those of the quick test (fixed values)."""

    height: int = 64
    width: int = 64
    n_bias: int = 20
    n_dark: int = 5
    dark_exposures: tuple[float, ...] = (120.0, 300.0, 600.0)
    n_flat: int = 20
    flat_level: float = 30_000.0
    n_light: int = 8
    light_exposure: float = 300.0
    n_stars: int = 30
    scale: int = 2
    sky_rate: float = 1.0
    fwhm: float = 3.0
    seed: int = 42


FAST, DEFAULT, FULL = Session(), Session(128, 128, n_light=15, n_stars=80), Session(256, 256, n_light=30, n_stars=150)


def rng(seed: int, *stream: int) -> np.random.Generator:
    return np.random.default_rng([seed, *stream])


def instrument(height: int, width: int, priors: Priors = Priors(), seed: int = 42, pattern: str | None = None, hot: float = 0.005, cold: float = 0.001) -> dict[str, np.ndarray]:
    """True maps: bias with a slow wave, read noise that grows to the corners, log-normal dark rates with planted hot and cold pixels, gain of median 1."""
    g = rng(seed, 0)
    y, x = np.mgrid[:height, :width]
    r = np.hypot(y / max(height - 1, 1) - 0.5, x / max(width - 1, 1) - 0.5)
    bias = priors.bias_mean + 5 * np.sin(2 * np.pi * x / width) + 3 * np.cos(2 * np.pi * y / height) + g.normal(0, 1, (height, width))
    noise = priors.read_noise * (1 + 0.1 * r) * np.exp(g.normal(0, 0.02, (height, width)))
    rate = priors.dark_rate * np.exp(g.normal(0, 0.3, (height, width)))
    u = g.random((height, width))
    is_hot, is_cold = u < hot, (u >= hot) & (u < hot + cold)
    rate = np.where(is_hot, rate * g.uniform(20, 50, u.shape), np.where(is_cold, rate * g.uniform(0.05, 0.2, u.shape), rate))
    gain = 1 + g.normal(0, 0.03, (height, width))
    if pattern:
        response = {"R": 0.97, "G0": 1.0, "G1": 1.0, "B": 0.96}
        for (j, i), c in BAYER[pattern].items():
            gain[j::2, i::2] *= response[c]
    return {"bias_mean": bias, "read_noise": noise, "dark_rate": rate, "hot_pixel": is_hot, "flat_gain": gain / np.median(gain), "amp_glow": np.zeros_like(bias)}


def instrument_from_posteriors(state: dict[str, tuple], seed: int = 42) -> dict[str, np.ndarray]:
    """Maps drawn from posteriors: bias and flat (precision, numerator), read_noise (alpha, beta), dark (alpha, beta); what follows in a tuple is passed over."""
    g = rng(seed, 1)
    p, n = state["bias"][:2]
    a, b = state["read_noise"][:2]
    c, d = state["dark"][:2]
    q, m = state["flat"][:2]
    rate = g.gamma(c, 1 / d)
    middle = np.median(rate)
    spread = 1.4826 * np.median(np.abs(rate - middle))
    return {"bias_mean": g.normal(n / p, 1 / np.sqrt(p)), "read_noise": np.sqrt(np.maximum(b / g.gamma(a, 1.0), 0.01)), "dark_rate": rate, "hot_pixel": rate > middle + 5 * spread, "flat_gain": np.maximum(g.normal(m / q, 1 / np.sqrt(q)), 0.05), "amp_glow": np.zeros_like(rate)}


def expose(true: dict[str, np.ndarray], kind: str, t: float, signal: np.ndarray | float, g: np.random.Generator) -> np.ndarray:
    """One raw frame: bias, counted signal and dark current, read noise; flats count gain times light alone."""
    shape = true["bias_mean"].shape
    out = true["bias_mean"] + g.normal(0, 1, shape) * true["read_noise"]
    if kind == "flat":
        return out + g.poisson(np.maximum(true["flat_gain"] * signal, 0))
    if kind == "light":
        out = out + g.poisson(np.maximum(true["flat_gain"] * signal * t, 0))
    if kind in ("dark", "light", "dark_flat"):
        out = out + g.poisson(true["dark_rate"] * t)
    return out


def moffat_psf(size: int, fwhm: float, beta: float = 2.5) -> np.ndarray:
    y, x = np.mgrid[:size, :size] - size // 2
    a = fwhm / (2 * math.sqrt(2 ** (1 / beta) - 1))
    p = (1 + (y * y + x * x) / (a * a)) ** -beta
    return p / p.sum()


def power_law(u: np.ndarray, low: float, high: float, slope: float) -> np.ndarray:
    """Fluxes with a power law of density exponent -slope, from uniform numbers."""
    k = 1 - slope
    return low * (high / low) ** u if abs(k) < 1e-9 else (low**k + u * (high**k - low**k)) ** (1 / k)


def star_scene(cfg: Session) -> tuple[np.ndarray, np.ndarray]:
    """A scene on the fine grid (flux a second and pixel) and its stars (y, x, flux)."""
    g = rng(cfg.seed, 2)
    h, w = cfg.height * cfg.scale, cfg.width * cfg.scale
    y, x = g.uniform(8, h - 8, cfg.n_stars), g.uniform(8, w - 8, cfg.n_stars)
    flux = power_law(g.random(cfg.n_stars), 50.0, 5000.0, 2.0)
    scene = np.full((h, w), cfg.sky_rate)
    np.add.at(scene, (np.round(y).astype(int), np.round(x).astype(int)), flux)
    return scene, np.stack([y, x, flux], axis=1)


def light_truth(cfg: Session) -> list[tuple[int, float, float, float, float]]:
    """frame, dx, dy (pixels), fwhm (1.5 to 8), transparency (0.3 to 1); the first frame doesn't move."""
    g = rng(cfg.seed, 3)
    rows = []
    for k in range(cfg.n_light):
        dx, dy, f, t = g.normal(0, 1.5), g.normal(0, 1.5), g.normal(cfg.fwhm, 0.4), g.normal(0.85, 0.1)
        rows.append((k, 0.0 if k == 0 else float(dx), 0.0 if k == 0 else float(dy), float(np.clip(f, 1.5, 8)), float(np.clip(t, 0.3, 1))))
    return rows


def render_light(scene: np.ndarray, cfg: Session, dx: float, dy: float, fwhm: float, t: float) -> np.ndarray:
    """The scene as one frame's sensor sees it, a second long."""
    fine = convolve(scene, moffat_psf(31, fwhm * cfg.scale))
    return t * np.maximum(pool(fourier_shift(fine, dy * cfg.scale, dx * cfg.scale), cfg.scale), 0)


def generate_session(spark: SparkSession, cfg: Session = FAST, session: str = "s0", pattern: str | None = None, true: dict[str, np.ndarray] | None = None) -> DataFrame:
    """All frames of a session, each drawn in its own task from the configuration alone, or from the maps of a given instrument (of the sensor's size)."""
    plan = [("bias", 0.0)] * cfg.n_bias + [("dark", t) for t in cfg.dark_exposures for _ in range(cfg.n_dark)] + [("flat", 2.0)] * cfg.n_flat + [("dark_flat", 2.0)] * max(cfg.n_flat // 2, 5) + [("light", cfg.light_exposure)] * cfg.n_light
    first = len(plan) - cfg.n_light
    rows = spark.createDataFrame([(k, kind, t) for k, (kind, t) in enumerate(plan)], "k long, kind string, t double").repartition(min(len(plan), 2 * spark.sparkContext.defaultParallelism))

    given = spark.sparkContext.broadcast(true)

    def draw(batches):
        import pandas as pd

        true = given.value or instrument(cfg.height, cfg.width, seed=cfg.seed, pattern=pattern)
        scene, truth = star_scene(cfg)[0], light_truth(cfg)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                signal = cfg.flat_level
                if r.kind == "light":
                    signal = render_light(scene, cfg, *truth[r.k - first][1:])
                raw = expose(true, r.kind, r.t, signal, rng(cfg.seed, 10, int(r.k)))
                out.append((r.k, r.k, session, r.kind, r.t, cfg.height, cfg.width, raw.ravel()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FRAME.split(", ")])

    return rows.mapInPandas(draw, FRAME)


def sky_scene(spark: SparkSession, height: int, width: int, sky: float = 100.0) -> DataFrame:
    """y, x, vignetting (the fourth power of a cosine), sky_bg with a slope, disc, gauss, true_sky and the regions."""
    d = spark.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    cy, cx, reach = (height - 1) / 2, (width - 1) / 2, max(height, width)
    r2 = lambda a, b: F.pow(F.col("y") - a, F.lit(2.0)) + F.pow(F.col("x") - b, F.lit(2.0))
    d = d.withColumns({"vignetting": F.pow(F.cos(F.atan(F.sqrt(r2(cy, cx)) / reach * 0.5)), F.lit(4.0)), "sky_bg": sky * (1 + 0.1 * F.col("x") / width)})
    d = region_masks(d, (height * 0.35, width * 0.35, height * 0.1), (height * 0.65, width * 0.65, height * 0.12))
    d = d.withColumns({"disc": F.when(F.col("in_disc"), 0.5 * sky).otherwise(0.0), "gauss": sky * F.exp(-r2(height * 0.65, width * 0.65) / (2 * (height * 0.06) ** 2))})
    return d.withColumns({"true_sky": F.col("vignetting") * (F.col("sky_bg") + F.col("disc") + F.col("gauss"))})


def exposed(scene: DataFrame, n: int, t: float, read_noise: float, seed: int = 42) -> DataFrame:
    """scene with rate, the mean of n exposures of t seconds in flux a second, and sigma, what it is expected to scatter by; large counts, so of normal noise."""
    sigma = F.sqrt(F.col("true_sky") * t + read_noise**2) / (t * n**0.5)
    return scene.withColumn("sigma", sigma).withColumn("rate", F.col("true_sky") + F.randn(seed) * F.col("sigma"))


def wcs_header(cfg: Session, dx: float, dy: float, scale_arcsec: float = 2.0, ra: float = 180.0, dec: float = 20.0) -> dict[str, float | int | str]:
    """Header keywords of a frame moved by dx, dy pixels."""
    s = scale_arcsec / 3600
    return {"NAXIS1": cfg.width, "NAXIS2": cfg.height, "CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRPIX1": cfg.width / 2 + 0.5, "CRPIX2": cfg.height / 2 + 0.5, "CRVAL1": ra + dx * s / math.cos(math.radians(dec)), "CRVAL2": dec - dy * s, "CD1_1": -s, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": s}


def with_headers(frames: DataFrame, cfg: Session, scale_arcsec: float = 2.0) -> DataFrame:
    """A session's frames with header, the keywords of where a light was pointed (no keywords for others)."""
    first = cfg.n_bias + len(cfg.dark_exposures) * cfg.n_dark + cfg.n_flat + max(cfg.n_flat // 2, 5)
    rows = [(first + k, {n: str(v) for n, v in wcs_header(cfg, dx, dy, scale_arcsec).items()}) for k, dx, dy, *_ in light_truth(cfg)]
    heads = frames.sparkSession.createDataFrame(rows, "frame_id long, header map<string,string>")  # a configured number of lights
    return frames.join(F.broadcast(heads), "frame_id", "left")
