"""Weighted stacks as sums by canvas pixel, what is derived from them, and choice and summaries of frames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frame
from ..plans.staging import cut
from . import images
from .calibration import MAD, PIXEL

SUMS = ("weighted_sum", "weight_sum", "sky_sum", "sq_sum")


def stack_terms(value: Column, sky: Column, t: Column) -> list[Column]:
    s = value - sky
    return [F.sum(t * s).alias("weighted_sum"), F.sum(t).alias("weight_sum"), F.sum(sky).alias("sky_sum"), F.sum(t * s * s).alias("sq_sum")]


def accumulate(px: DataFrame, meta: DataFrame, by: Sequence[str] = PIXEL, value: str = "calibrated", weight: str | None = None) -> DataFrame:
    """The four sums by pixel; meta has transparency and sky by frame. With weight, each sample counts by that column too."""
    d = px.join(meta.select("frame_id", "transparency", "sky"), "frame_id")
    t = F.col("transparency") if weight is None else F.col("transparency") * F.col(weight)
    return d.groupBy(*by).agg(*stack_terms(F.col(value), F.col("sky"), t))


def merge(a: DataFrame, b: DataFrame, by: Sequence[str] = PIXEL) -> DataFrame:
    """The sums of two stacks of different frames."""
    return a.unionByName(b).groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def derive(stack: DataFrame, n_frames: int | Column) -> DataFrame:
    """stack with weighted_mean, sky_mean, variance and quality (its weight over the largest one)."""
    stack = cut(stack, "sums")  # for its greatest weight first
    top = stack.agg(F.max("weight_sum")).first()[0] or 0.0
    w = F.when(F.col("weight_sum") > 0, F.col("weight_sum")).otherwise(1.0)
    mean = F.col("weighted_sum") / w
    n = F.lit(n_frames) if isinstance(n_frames, int) else n_frames
    return stack.withColumns({"weighted_mean": mean, "sky_mean": F.col("sky_sum") / n, "variance": F.greatest(F.col("sq_sum") / w - mean * mean, F.lit(0.0)), "quality": F.col("weight_sum") / top if top > 0 else F.lit(0.0)})


def sky_by_channel(px: DataFrame, sky: str = "sky") -> DataFrame:
    """A frame's sky split over its channels in the ratio of their medians to the frame's."""
    whole = px.groupBy("frame_id").agg(F.median("calibrated").alias("all"), F.first(sky).alias("sky"))
    own = px.groupBy("frame_id", "channel").agg(F.median("calibrated").alias("own"))
    return own.join(whole, "frame_id").select("frame_id", "channel", F.when(F.col("all") != 0, F.col("sky") * F.col("own") / F.col("all")).otherwise(F.col("sky")).alias("sky"))


def place(px: DataFrame, meta: DataFrame, rows: int, cols: int, row0: int = 0, col0: int = 0) -> DataFrame:
    """px at the whole-pixel part of each frame's shift (dy, dx) on a canvas; what falls outside goes."""
    d = px.join(meta.select("frame_id", "dy", "dx"), "frame_id")
    y = F.col("y") + row0 + F.round("dy").cast("int")
    x = F.col("x") + col0 + F.round("dx").cast("int")
    return d.withColumns({"y": y, "x": x}).where((F.col("y") >= 0) & (F.col("y") < rows) & (F.col("x") >= 0) & (F.col("x") < cols)).drop("dy", "dx")


AFFINE = ("a", "b", "c", "d", "e", "f")


def warp(frames: DataFrame, rows: int, cols: int, order: int = 1, min_cover: float = 0.5) -> DataFrame:
    """frames(frame_id, h, w, data, a..f) resampled on a canvas: frame_id, h, w, data, NaN where a frame doesn't reach.

    (a, b, c, d, e, f) takes canvas (x, y) to frame (ax+by+c, dx+ey+f). Each
    frame is gathered from its own row, so nothing is shuffled or multiplied.
    Order 1 is bilinear, where covered pixels are those whose weights in the
    frame sum to more than min_cover; order 3 is a cubic spline within the
    frame's edge pixels. Frames with an unknown affine are covered nowhere.
    """

    def work(image, row):
        affine = tuple(row[c] for c in AFFINE)
        return np.full((rows, cols), np.nan) if None in affine else frame.warped(image, affine, rows, cols, order, min_cover)

    return images.map_images(frames, work, list(AFFINE)).drop(*AFFINE)


def covered(warped: DataFrame, value: str = "calibrated") -> DataFrame:
    """The pixels that warped frames reach: frame_id, y, x, value."""
    p = warped.select("frame_id", "w", F.posexplode("data").alias("at", value)).where(~F.isnan(value))
    return p.select("frame_id", (F.col("at") / F.col("w")).cast("int").alias("y"), (F.col("at") % F.col("w")).alias("x"), value)


def union_canvas(corners: DataFrame) -> DataFrame:
    """One row: rows, cols, row0, col0 of the smallest canvas around all projected corners (y, x)."""
    g = corners.agg(F.floor(F.min("y")).alias("y0"), F.ceil(F.max("y")).alias("y1"), F.floor(F.min("x")).alias("x0"), F.ceil(F.max("x")).alias("x1"))
    return g.select((F.col("y1") - F.col("y0") + 1).alias("rows"), (F.col("x1") - F.col("x0") + 1).alias("cols"), (-F.col("y0")).alias("row0"), (-F.col("x0")).alias("col0"))


def shifted_corners(meta: DataFrame, height: int, width: int) -> DataFrame:
    """The corners of each frame on the reference's grid, and the reference's own."""
    at = F.explode(F.array(*[F.struct(F.lit(float(y)).alias("y"), F.lit(float(x)).alias("x")) for y in (0, height - 1) for x in (0, width - 1)]))
    moved = meta.select(at.alias("k"), "dy", "dx").select((F.col("k.y") + F.col("dy")).alias("y"), (F.col("k.x") + F.col("dx")).alias("x"))
    fixed = meta.limit(1).select(at.alias("k")).select("k.y", "k.x")
    return moved.unionByName(fixed)


def select_best(meta: DataFrame, top_frac: float, key: str = "transparency") -> DataFrame:
    """The best share of the frames: the clearest or the sharpest; at least one, ties by frame_id."""
    if key not in ("transparency", "fwhm"):
        raise ValueError(f"frames are ranked by transparency or fwhm, not {key}")
    k = max(1, round(meta.count() * top_frac))
    order = [F.desc(key) if key == "transparency" else F.asc(key), F.asc("frame_id")]
    return meta.orderBy(*order).limit(k)


def outliers(meta: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Frames whose transparency is below the median by sigma robust deviations; none, if there are fewer than four."""
    m = meta.agg(F.median("transparency").alias("m"), F.count("*").alias("n"))
    d = meta.join(F.broadcast(m)).agg(F.first("m").alias("m"), F.first("n").alias("n"), F.median(F.abs(F.col("transparency") - F.col("m"))).alias("d"))
    return meta.join(F.broadcast(d)).where((F.col("n") >= 4) & (F.col("transparency") < F.col("m") - sigma * MAD * F.col("d"))).drop("m", "n", "d")


def graded(meta: DataFrame, by: Sequence[str] = ("session",), sigma: float = 3.0, max_fwhm: float | None = None) -> DataFrame:
    """meta with reason: null for a frame that is fit to be stacked, else cloud (as outliers, within its group), blur or unknown."""
    near = F.col("transparency")
    m = meta.groupBy(*by).agg(F.median(near).alias("__m"), F.count("*").alias("__n"))
    d = meta.join(m, list(by)).groupBy(*by).agg(F.first("__m").alias("__m"), F.first("__n").alias("__n"), F.median(F.abs(near - F.col("__m"))).alias("__d"))
    cloud = (F.col("__n") >= 4) & (near < F.col("__m") - sigma * MAD * F.col("__d"))
    reason = F.when(near.isNull() | F.col("fwhm").isNull(), "unknown").when(cloud, "cloud")
    if max_fwhm is not None:
        reason = reason.when(F.col("fwhm") > max_fwhm, "blur")
    return meta.join(d, list(by)).withColumn("reason", reason).drop("__m", "__n", "__d")


def quality_filter(meta: DataFrame, min_transparency: float | None = None, max_fwhm: float | None = None) -> DataFrame:
    """meta without poor frames; a bound that isn't given drops nothing."""
    if min_transparency is not None:
        meta = meta.where(F.col("transparency") >= min_transparency)
    return meta if max_fwhm is None else meta.where(F.col("fwhm") <= max_fwhm)


def summary(meta: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """min, median, max, std (of the population), n and best_n, the frames below the first quartile, of a column; by groups, if given."""
    q = meta.groupBy(*by).agg(F.percentile(value, 0.25).alias("q1"))
    d = meta.join(F.broadcast(q), list(by)) if by else meta.join(F.broadcast(q))
    return d.groupBy(*by).agg(F.min(value).alias("min"), F.median(value).alias("median"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"), F.count_if(F.col(value) < F.col("q1")).alias("best_n"))


def rescaled(stack: DataFrame, meta: DataFrame, subset: DataFrame) -> DataFrame:
    """stack scaled to a subset of its frames by their share of the transparency."""
    all_t = meta.agg(F.sum("transparency").alias("__all"))
    own = subset.agg(F.sum("transparency").alias("__own"))
    share = F.broadcast(all_t.join(own).select((F.col("__own") / F.col("__all")).alias("__share")))
    return stack.join(share).withColumns({c: F.col(c) * F.col("__share") for c in SUMS}).drop("__share")


def rotation_to_reference(meta: DataFrame, order: str = "frame_id") -> DataFrame:
    """meta with turn: rotation relative to the first frame, in (-180, 180]; that frame is looked up once, not by a window over all rows."""
    first = F.broadcast(meta.agg(F.min_by("rotation", order).alias("__r")))
    turn = 180 - F.pmod(180 - (F.col("rotation") - F.col("__r")), F.lit(360.0))
    return meta.join(first).withColumn("turn", turn).drop("__r")


def remaining(all_frames: DataFrame, done: DataFrame) -> DataFrame:
    """The frames that a resumed run still has to do, by id."""
    return all_frames.join(done, "frame_id", "left_anti")


def prior_values(meta: DataFrame, value: str, order: str = "frame_id", by: Sequence[str] = ("session",)) -> DataFrame:
    """meta with prior: the last known value of an earlier frame of its session."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return meta.withColumn("prior", F.last(value, ignorenulls=True).over(w))
