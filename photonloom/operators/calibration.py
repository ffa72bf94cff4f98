"""Detector calibration as grouped aggregates over pixels, and its application as joins and projections.

Every aggregate merges partial states before the shuffle (a state is a few
numbers per pixel), whatever the number of frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import cut

PIXEL = ("channel", "y", "x")
MAD = 1.4826  # of a normal distribution: standard deviation over median absolute deviation

#: Positions (row, column) of the four planes of a two by two cell (fixed values).
BAYER = {
    "RGGB": {(0, 0): "R", (0, 1): "G0", (1, 0): "G1", (1, 1): "B"},
    "BGGR": {(0, 0): "B", (0, 1): "G0", (1, 0): "G1", (1, 1): "R"},
    "GRBG": {(0, 0): "G0", (0, 1): "R", (1, 0): "B", (1, 1): "G1"},
    "GBRG": {(0, 0): "G0", (0, 1): "B", (1, 0): "R", (1, 1): "G1"},
}


def mean_and_deviation(px: DataFrame, by: Sequence[str] = PIXEL, value: str = "adu") -> DataFrame:
    """mean, std (of a sample; null for one frame) and n by pixel."""
    return px.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def linear_regression(px: DataFrame, by: Sequence[str] = PIXEL, t: str = "exposure_s", value: str = "adu") -> DataFrame:
    """slope, intercept, residual_std and n of value over t by pixel; one exposure alone gives slope 0 and the mean."""
    g = px.groupBy(*by).agg(F.avg(t).alias("mt"), F.avg(value).alias("mv"), F.regr_sxx(value, t).alias("stt"), F.regr_sxy(value, t).alias("stx"), F.regr_syy(value, t).alias("sxx"), F.count(value).alias("n"))
    flat = F.abs("stt") < 1e-12
    slope = F.when(flat, 0.0).otherwise(F.col("stx") / F.when(~flat, F.col("stt")))
    g = g.withColumn("slope", slope)
    rest = F.greatest(F.col("sxx") - F.col("slope") * F.col("stx"), F.lit(0.0))
    free = F.greatest(F.col("n") - F.when(flat, 1).otherwise(2), F.lit(1))
    return g.select(*by, "slope", (F.col("mv") - F.col("slope") * F.col("mt")).alias("intercept"), F.sqrt(rest / free).alias("residual_std"), "n")


def fit_bias(bias: DataFrame, by: Sequence[str] = PIXEL) -> DataFrame:
    """bias_mean and read_noise by pixel."""
    return mean_and_deviation(bias, by).select(*by, F.col("mean").alias("bias_mean"), F.col("std").alias("read_noise"))


def fit_dark(dark: DataFrame, bias: DataFrame, by: Sequence[str] = PIXEL, sigma: float = 5.0) -> DataFrame:
    """dark_rate (not below 0) by pixel and hot_pixel.

    With several exposures the rate is a regression's slope, with one it is
    the mean over the exposure.
    """
    d = dark.join(bias.select(*by, "bias_mean"), list(by)).withColumn("net", F.col("adu") - F.col("bias_mean"))
    fit = linear_regression(d, by, value="net")
    single = d.groupBy(*by).agg(F.count_distinct("exposure_s").alias("k"), (F.avg("net") / F.avg("exposure_s")).alias("r"))
    rate = fit.join(single, list(by)).select(*by, F.greatest(F.when(F.col("k") > 1, F.col("slope")).otherwise(F.col("r")), F.lit(0.0)).alias("dark_rate"))
    return hot_pixels(rate, "dark_rate", sigma)


def exact_median(df: DataFrame, value: str, accuracy: int = 10_000) -> float | None:
    """The median of a column of the whole table, without a task that holds all its values.

    A sketch gives two numbers that the middle lies between; the few values
    between them are counted from and put in order. Should the sketch have
    missed, the aggregate over all values decides.
    """
    d = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    lo, hi, n = d.agg(F.percentile_approx("v", 0.5 - 2 / accuracy, accuracy), F.percentile_approx("v", 0.5 + 2 / accuracy, accuracy), F.count("*")).first()
    if not n:
        return None
    near = d.agg(F.count_if(F.col("v") < lo).alias("below"), F.count_if(F.col("v").between(lo, hi)).alias("k")).first()
    at = [(n - 1) // 2 - near.below, n // 2 - near.below]
    if lo == hi and at[0] >= 0 and at[1] < near.k:
        return lo
    if at[0] < 0 or at[1] >= near.k:
        return d.agg(F.median("v")).first()[0]
    few = d.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("*").alias("k")).orderBy("v").collect()  # about 4 / accuracy of the values
    ends = []
    for a in at:
        for r in few:
            if a < r.k:
                ends.append(r.v)
                break
            a -= r.k
    return sum(ends) / 2


def hot_pixels(pixels: DataFrame, value: str, sigma: float = 5.0) -> DataFrame:
    """pixels with hot_pixel: value above the median by sigma robust deviations."""
    pixels = cut(pixels, "rates")  # read several times
    centre = exact_median(pixels, value)
    if centre is None:
        return pixels.withColumn("hot_pixel", F.lit(None).cast("boolean"))
    away = exact_median(pixels.select(F.abs(F.col(value) - centre).alias("d")), "d")
    return pixels.withColumn("hot_pixel", F.col(value) > centre + sigma * MAD * away)


def normalised_flats(flat: DataFrame, bias: DataFrame, dark: DataFrame | None = None, by: Sequence[str] = PIXEL) -> DataFrame:
    """flat frames less bias and dark, over the frame's median by channel; frames of a median not above 0 are left out, net of everything."""
    f = flat.join(bias.select(*by, "bias_mean"), list(by))
    net = F.col("adu") - F.col("bias_mean")
    if dark is not None:
        f = f.join(dark.select(*by, "dark_rate"), list(by))
        net = net - F.col("dark_rate") * F.col("exposure_s")
    f = f.withColumn("net", net)
    scale = f.groupBy("frame_id", "channel").agg(F.median("net").alias("scale")).where("scale > 0")
    return f.join(scale, ["frame_id", "channel"]).withColumn("norm", F.col("net") / F.col("scale"))


def fit_flat(flat: DataFrame, bias: DataFrame, dark: DataFrame | None = None, by: Sequence[str] = PIXEL) -> DataFrame:
    """flat_gain (its median is 1) and flat_uncertainty, the spread beyond the noise of counting."""
    f = normalised_flats(flat, bias, dark, by)
    g = f.groupBy(*by).agg(F.avg("norm").alias("gain"), F.stddev_samp("norm").alias("std"), F.avg("net").alias("raw"), F.count("*").alias("n"))
    g = cut(g, "gains")
    middle = exact_median(g, "gain") or 1.0
    noise = 1.0 / (F.greatest("raw", F.lit(1.0)) * F.col("n"))
    left = F.sqrt(F.greatest(F.pow("std", F.lit(2.0)) - noise, F.lit(0.0)))
    return g.select(*by, (F.col("gain") / middle).alias("flat_gain"), F.when(F.col("raw") > 0, left).otherwise(0.0).alias("flat_uncertainty"))


def fit_dark_flat(dark_flat: DataFrame, bias: DataFrame, by: Sequence[str] = PIXEL) -> DataFrame:
    """amp_glow: the mean of dark flats less bias."""
    return dark_flat.join(bias.select(*by, "bias_mean"), list(by)).groupBy(*by).agg(F.avg(F.col("adu") - F.col("bias_mean")).alias("amp_glow"))


def fit_all(px: DataFrame, by: Sequence[str] = PIXEL, keep=None) -> DataFrame:
    """The instrument by pixel, from frames of frame_type bias, dark, flat and dark_flat; maps without frames are null.

    keep(map, name), if given, stores a map that later ones need, so that its
    frames are read once; the maps have one row per pixel.
    """
    of = lambda kind: px.where(F.col("frame_type") == kind)
    keep = keep or (lambda df, name: df)
    bias = keep(fit_bias(of("bias"), by), "bias")
    dark = keep(fit_dark(of("dark"), bias, by), "dark")
    out = bias.join(dark, list(by), "left").join(fit_flat(of("flat"), bias, dark, by), list(by), "left")
    return out.join(fit_dark_flat(of("dark_flat"), bias, by), list(by), "left")


def calibrate(px: DataFrame, model: DataFrame, by: Sequence[str] = PIXEL, rotation: str | None = None, height: int = 0, width: int = 0) -> DataFrame:
    """px with calibrated: (adu - bias - dark * t) / gain; absent maps count as 0, gains up to 0.01 as 1.

    With rotation, frames turned by more than 90 degrees (a meridian flip)
    take their gain from the opposite pixel of a height x width sensor.
    """
    maps = set(model.columns)
    pick = lambda c, default: F.coalesce(F.col(f"m.{c}"), F.lit(default)) if c in maps else F.lit(default)
    on = [F.col(f"p.{c}") == F.col(f"m.{c}") for c in by]
    out = px.alias("p").join(model.alias("m"), on, "left")
    net = F.col("p.adu") - pick("bias_mean", 0.0) - pick("dark_rate", 0.0) * F.col("p.exposure_s")
    if rotation is None:
        gain = pick("flat_gain", 1.0)
    else:
        flip = F.abs(F.col(f"p.{rotation}")) > 90
        g = model.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("flat_gain").alias("__gain"))
        at = {"y": F.when(flip, height - 1 - F.col("p.y")).otherwise(F.col("p.y")), "x": F.when(flip, width - 1 - F.col("p.x")).otherwise(F.col("p.x"))}
        out = out.join(g, [at.get(c, F.col(f"p.{c}")) == F.col(f"__{c}") for c in by], "left")
        gain = F.coalesce(F.col("__gain"), F.lit(1.0))
    return out.select("p.*", (net / F.when(gain > 0.01, gain).otherwise(1.0)).alias("calibrated"))


def bayer_channel(pattern: str, y: Column, x: Column) -> Column:
    cells = BAYER[pattern.upper()]
    return F.get(F.array(*[F.lit(cells[r, c]) for r in (0, 1) for c in (0, 1)]), ((y % 2) * 2 + x % 2).cast("int"))


def is_colour(pattern: Column) -> Column:
    """Whether a frame is a colour sensor's: its pattern is known."""
    return pattern.isNotNull()


def bayer_split(px: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """px with the channel of its place in the pattern, on the half-size grid."""
    halved = {"y": F.floor(F.col("y") / 2).cast("int"), "x": F.floor(F.col("x") / 2).cast("int")}
    return px.withColumn("channel", bayer_channel(pattern, F.col("y"), F.col("x"))).withColumns(halved)


def channel_medians(px: DataFrame, value: str = "adu") -> DataFrame:
    return px.groupBy("frame_id", "channel").agg(F.median(value).alias("median"))


def normalise_channels(px: DataFrame, value: str = "adu") -> DataFrame:
    """px with norm: value over the median of its frame and channel, where that is above 0."""
    m = channel_medians(px, value)
    return px.join(m, ["frame_id", "channel"]).withColumn("norm", F.when(F.col("median") > 0, F.col(value) / F.col("median")).otherwise(F.col(value))).drop("median")


def luminance(px: DataFrame, value: str = "adu") -> DataFrame:
    """The mean of the colour planes by frame and place."""
    return px.groupBy("frame_id", "y", "x").agg(F.avg(value).alias("lum"))


def validate(model: DataFrame) -> DataFrame:
    """One row: the messages on read noise (99 % above 50), hot pixels (more than 1 %) and gain (below 0.1), and whether the model is empty."""
    s = model.agg(F.percentile("read_noise", 0.99).alias("rn"), F.avg(F.col("hot_pixel").cast("int")).alias("hot"), F.min("flat_gain").alias("gain"), F.count("*").alias("n"))
    say = lambda test, text: F.when(test, F.lit(text))
    messages = F.array_compact(F.array(say(F.col("rn") > 50, "read_noise"), say(F.col("hot") > 0.01, "hot_pixels"), say(F.col("gain") < 0.1, "flat_gain"), say(F.col("n") == 0, "shape")))
    return s.select(messages.alias("messages"))


def compatible(a: DataFrame, b: DataFrame, temp_tolerance: float = 2.0) -> DataFrame:
    """Pairs of models (model_id, h, w, gain, temperature) that may be combined; unknown gain or temperature rules nothing out.

    The frame's shape is the join key; pairs come once, lower id first.
    """
    pairs = a.alias("a").join(b.alias("b"), ["h", "w"]).where(F.col("a.model_id") < F.col("b.model_id"))
    unknown = lambda c: F.col(f"a.{c}").isNull() | F.col(f"b.{c}").isNull()
    close = F.abs(F.col("a.temperature") - F.col("b.temperature")) <= temp_tolerance
    ok = (unknown("gain") | (F.col("a.gain") == F.col("b.gain"))) & (unknown("temperature") | close)
    return pairs.where(ok).select(F.col("a.model_id").alias("a"), F.col("b.model_id").alias("b"))


def check_shape(frames: DataFrame) -> DataFrame:
    """frames, or an error while they are read if a frame's data don't have its h x w numbers, or shapes differ."""
    shapes = frames.select("h", "w").distinct().limit(2).collect()
    if len(shapes) > 1:
        raise ValueError(f"frames differ in shape: {[tuple(s) for s in shapes]}")
    fits = F.size("data") == F.col("h") * F.col("w")
    return frames.withColumn("data", F.when(fits, F.col("data")).otherwise(F.raise_error(F.lit("a frame's data don't fit its shape")).cast("array<double>")))


def first_known(frames: DataFrame, columns: Sequence[str], order: str = "seq") -> DataFrame:
    """One row: the first value in frame order that isn't null, of each column."""
    return frames.agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
