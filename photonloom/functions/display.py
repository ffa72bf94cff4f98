"""Display stretches as column expressions, their parameters as aggregates, histograms and a PNG encoder."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.neighbourhood import sigma_clipped

#: Shares of red, green and blue in luminance (fixed values).
LUMINANCE = (0.299, 0.587, 0.114)


def normalised(v: Column, black: Column, white: Column) -> Column:
    """v between black and white as 0 to 1; 0 where they coincide."""
    span = white - black
    return F.when(span < 1e-12, 0.0).otherwise((F.least(F.greatest(v, black), white) - black) / F.when(span >= 1e-12, span))


def asinh_stretch(x: Column, beta: Column) -> Column:
    return F.asinh(beta * x) / F.asinh(beta)


def log_stretch(x: Column, p: Column) -> Column:
    return F.log1p(p * x) / F.log1p(p)


def midtone_stretch(x: Column, m: Column) -> Column:
    """The rational curve through (0, 0), (m, 1/2) and (1, 1)."""
    m = F.least(F.greatest(m, F.lit(1e-6)), F.lit(1 - 1e-6))
    den = (2 * m - 1) * x - m
    return F.when(F.abs(den) < 1e-12, 0.0).otherwise((m - 1) * x / F.when(F.abs(den) >= 1e-12, den))


def stretch(x: Column, mode: str, beta: Column | float = 1.0, midtone: Column | float = 0.18) -> Column:
    """A normalised value through a mode's curve, clipped to 0..1."""
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    curves = {"asinh": lambda: asinh_stretch(x, c(beta)), "linear": lambda: x, "log": lambda: log_stretch(x, c(beta)), "midtone": lambda: midtone_stretch(x, c(midtone))}
    if mode not in curves:
        raise ValueError(f"a stretch is one of {sorted(curves)}, not {mode}")
    return F.least(F.greatest(curves[mode](), F.lit(0.0)), F.lit(1.0))


def strength(background: Column, target: float = 0.18, lo: float = 1.0, hi: float = 1e6, rounds: int = 60, tol: float = 1e-4) -> Column:
    """The beta whose asinh curve takes background to target, by bisection in one expression."""
    start = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(None).cast("double").alias("hit"))

    def step(s, _):
        mid = (s.lo + s.hi) * 0.5
        v = F.asinh(mid * background) / F.asinh(mid)
        hit = F.coalesce(s.hit, F.when(F.abs(v - target) < tol, mid))
        low = v < target
        return F.struct(F.when(low, mid).otherwise(s.lo).alias("lo"), F.when(low, s.hi).otherwise(mid).alias("hi"), hit.alias("hit"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.coalesce(s.hit, (s.lo + s.hi) * 0.5))


def auto_params(px: DataFrame, by: Sequence[str] = ("frame_id", "channel"), value: str = "adu", target: float = 0.18, black_sigma: float = -2.8, white_percentile: float = 99.9) -> DataFrame:
    """black, white, beta and midtone by group: black is 2.8 clipped deviations below the sky, white a high percentile."""
    keys = list(by)
    sky = sigma_clipped(px, keys, value)
    top = px.groupBy(*keys).agg(F.percentile(value, white_percentile / 100).alias("top"))
    d = (sky.join(top, keys) if keys else sky.join(top)).withColumn("black", F.col("median") + black_sigma * F.col("spread"))
    d = d.withColumn("white", F.greatest("top", F.col("black") + 1.0))
    level = F.least(F.greatest((F.col("median") - F.col("black")) / (F.col("white") - F.col("black")), F.lit(1e-6)), F.lit(0.5))
    return d.select(*keys, "black", "white", strength(level, target).alias("beta"), F.lit(target).alias("midtone"))


def stretch_mono(px: DataFrame, params: DataFrame, mode: str = "asinh", by: Sequence[str] = ("frame_id", "channel"), value: str = "adu") -> DataFrame:
    """px with display, by the parameters of its group."""
    d = px.join(params, list(by)) if by else px.join(F.broadcast(params))
    x = normalised(F.col(value), F.col("black"), F.col("white"))
    return d.withColumn("display", stretch(x, mode, F.col("beta"), F.col("midtone"))).drop("black", "white", "beta", "midtone")


def luminance(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return sum((w * F.col(c) for w, c in zip(LUMINANCE, (r, g, b))), F.lit(0.0))


def stretch_rgb(rgb: DataFrame, mode: str = "asinh", linked: bool = True, params: DataFrame | None = None) -> DataFrame:
    """rgb(frame_id, y, x, r, g, b) stretched: linked by the luminance's parameters, else each colour by its own.

    params: frame_id[, channel], black, white, beta, midtone instead of the estimated ones.
    """
    if linked:
        p = params if params is not None else auto_params(rgb.withColumn("lum", luminance()), ("frame_id",), "lum")
        d = rgb.join(p, "frame_id")
        f = lambda c: stretch(normalised(F.col(c), F.col("black"), F.col("white")), mode, F.col("beta"), F.col("midtone")).alias(c)
        return d.select("frame_id", "y", "x", f("r"), f("g"), f("b"))
    long = rgb.select("frame_id", "y", "x", F.explode(F.create_map(F.lit("r"), "r", F.lit("g"), "g", F.lit("b"), "b")).alias("channel", "adu"))
    out = stretch_mono(long, params if params is not None else auto_params(long), mode)
    return out.groupBy("frame_id", "y", "x").agg(*[F.max(F.when(F.col("channel") == c, F.col("display"))).alias(c) for c in "rgb"])


def to_uint8(v: Column) -> Column:
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("smallint")


def histogram(df: DataFrame, value: str, bins: int = 256, by: Sequence[str] = (), log: bool = False) -> DataFrame:
    """Counts of values from 0 to 1 in equal bins, empty ones too; 1 belongs to the last bin, values outside to none."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    c = df.where((F.col(value) >= 0) & (F.col(value) <= 1)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return grid.join(c, [*by, "bin"], "left").select(*by, "bin", ((F.col("bin") + 0.5) / bins).alias("centre"), (F.log10(n + 1.0) if log else n).alias("count"))


def rgb_histograms(rgb: DataFrame, bins: int = 256, log: bool = False) -> DataFrame:
    """Histograms of r, g, b and lum."""
    long = rgb.withColumn("lum", luminance()).select(F.explode(F.create_map(*[v for c in ("r", "g", "b", "lum") for v in (F.lit(c), F.col(c))])).alias("channel", "value"))
    return histogram(long, "value", bins, ("channel",), log)


def png_bytes(image: np.ndarray) -> bytes:
    """An image of bytes, [h, w] or [h, w, 3], as PNG."""
    image = np.ascontiguousarray(image, dtype=np.uint8)
    h, w = image.shape[:2]
    rows = image.reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def to_png(px: DataFrame, height: int, width: int, value: str = "display") -> DataFrame:
    """frame_id, png of grey images; a frame is one group of pixels."""

    def encode(key, pdf):
        import pandas as pd

        out = np.zeros((height, width), np.uint8)
        out[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf.v.to_numpy()
        return pd.DataFrame({"frame_id": [key[0]], "png": [png_bytes(out)]})

    d = px.select("frame_id", "y", "x", to_uint8(F.col(value)).alias("v"))
    return d.groupBy("frame_id").applyInPandas(encode, f"frame_id {dict(px.dtypes)['frame_id']}, png binary")
