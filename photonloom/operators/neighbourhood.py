"""Neighbourhoods in images: windows over rows and columns, and offset joins for sparse masks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frame
from ..plans.staging import cut
from . import images
from .calibration import MAD

ROW = ("frame_id", "channel", "y")
COLUMN = ("frame_id", "channel", "x")


def along_x(by: Sequence[str] = ROW):
    return Window.partitionBy(*by).orderBy("x")


def along_y(by: Sequence[str] = COLUMN):
    return Window.partitionBy(*by).orderBy("y")


def reflect(i: Column, n: int) -> Column:
    """An index outside 0..n-1 mirrored at the edge (the edge's own pixel repeated)."""
    j = F.pmod(i, F.lit(2 * n))
    return F.when(j < n, j).otherwise(2 * n - 1 - j).cast("int")


def replace_masked(px: DataFrame, mask: DataFrame, height: int, width: int, radius: int = 2, value: str = "adu") -> DataFrame:
    """px with the masked pixels replaced by the median of their (2 radius + 1)^2 neighbourhood, mirrored at the edges.

    mask(channel, y, x) holds for all frames, mask(frame_id, channel, y, x) for
    its frame alone. It is sparse: only its pixels are exploded into offsets
    and joined.
    """
    own = ["frame_id"] if "frame_id" in mask.columns else []
    offsets = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in range(-radius, radius + 1) for i in range(-radius, radius + 1)])
    asked = mask.select(*own, "channel", F.col("y").alias("my"), F.col("x").alias("mx")).distinct().withColumn("o", F.explode(offsets))
    asked = asked.select(*own, "channel", "my", "mx", reflect(F.col("my") + F.col("o.j"), height).alias("y"), reflect(F.col("mx") + F.col("o.i"), width).alias("x"))
    med = asked.join(px, [*own, "channel", "y", "x"]).groupBy("frame_id", "channel", F.col("my").alias("y"), F.col("mx").alias("x")).agg(F.median(value).alias("__v"))
    out = px.join(med, ["frame_id", "channel", "y", "x"], "left")
    return out.withColumn(value, F.coalesce("__v", F.col(value))).drop("__v")


def outlier_mask(px: DataFrame, sigma: float = 10.0, value: str = "adu") -> DataFrame:
    """Pixels of a frame far above the median of their channel."""
    m = px.groupBy("frame_id", "channel").agg(F.median(value).alias("m"))
    d = px.join(m, ["frame_id", "channel"]).withColumn("a", F.abs(F.col(value) - F.col("m")))
    s = d.groupBy("frame_id", "channel").agg(F.median("a").alias("s"))
    return d.join(s, ["frame_id", "channel"]).where(F.col(value) > F.col("m") + sigma * MAD * F.col("s")).select("frame_id", "channel", "y", "x")


def maximum_filter(px: DataFrame, size: int, value: str = "adu") -> DataFrame:
    """px with peak: the largest value in size x size around a pixel; first along rows, then along columns."""
    lo, hi = -(size // 2), size - 1 - size // 2
    rows = px.withColumn("__r", F.max(value).over(along_x().rowsBetween(lo, hi)))
    return rows.withColumn("peak", F.max("__r").over(along_y().rowsBetween(lo, hi))).drop("__r")


def local_maxima(px: DataFrame, size: int, value: str = "adu") -> DataFrame:
    return maximum_filter(px, size, value).where(F.col(value) == F.col("peak")).drop("peak")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    import math

    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def smooth(px: DataFrame, height: int, width: int, sigma: float = 1.0, value: str = "adu") -> DataFrame:
    """px with smooth: a Gaussian mean along rows, then columns, mirrored at the edges.

    A row's (column's) values are gathered into one array of the image's width
    (height) and combined there, so no offset join multiplies the pixels.
    """
    w = gaussian_weights(sigma)
    r = len(w) // 2

    def pass_over(df, by, axis, n, source, out):
        g = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, source))), lambda s: s[source]).alias("__a"))
        taps = lambda i: sum((F.lit(v) * F.get("__a", reflect(i + (k - r), n)) for k, v in enumerate(w)), F.lit(0.0))
        return g.select(*by, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), taps)).alias(axis, out))

    rows = pass_over(px, ROW, "x", width, value, "__h")
    both = pass_over(rows, COLUMN, "y", height, "__h", "smooth")
    return px.join(both, ["frame_id", "channel", "y", "x"])


def debayer(px: DataFrame, height: int, width: int, value: str = "adu") -> DataFrame:
    """Colour preview r, g, b of px split into R, G0, G1, B planes (half size): each plane repeated to full size, then the mean of a pixel, the next ones in x and y and the one between; the last row and column stay."""
    colour = F.when(F.col("channel").isin("G0", "G1"), "g").otherwise(F.lower("channel"))
    plane = px.groupBy("frame_id", "y", "x").agg(*[F.avg(F.when(colour == c, F.col(value))).alias(c) for c in "rgb"])
    cell = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1)]))
    full = plane.select("frame_id", "y", "x", "r", "g", "b", cell.alias("k")).select("frame_id", (2 * F.col("y") + F.col("k.j")).alias("y"), (2 * F.col("x") + F.col("k.i")).alias("x"), "r", "g", "b")
    # the neighbours of a repeated pixel lie in its own cell or the next one
    rows, cols = Window.partitionBy("frame_id", "y").orderBy("x"), Window.partitionBy("frame_id", "x").orderBy("y")
    across = full.withColumns({f"{c}x": F.col(c) + F.lead(c).over(rows) for c in "rgb"})
    down = across.withColumns({f"{c}s": (F.col(f"{c}x") + F.lead(f"{c}x").over(cols)) * 0.25 for c in "rgb"})
    inner = (F.col("y") < height - 1) & (F.col("x") < width - 1)
    return down.select("frame_id", "y", "x", *[F.when(inner, F.col(f"{c}s")).otherwise(F.col(c)).alias(c) for c in "rgb"])


def total_variation(px: DataFrame, value: str = "adu", eps: float = 1e-8, diagonal: bool = False) -> DataFrame:
    """By frame and channel, the sum over all pixels with a next one in both directions of the root of squared differences; with diagonal, two more at a weight of one half."""
    d = px.withColumns({"__x": F.lead(value).over(along_x()), "__y": F.lead(value).over(along_y())})
    d = d.withColumn("__d", F.lead("__x").over(along_y()))
    v = F.col(value)
    square = lambda c: c * c
    total = square(F.col("__x") - v) + square(F.col("__y") - v)
    if diagonal:
        total = total + 0.5 * (square(F.col("__d") - v) + square(F.col("__x") - F.col("__y")))
    return d.where("__d IS NOT NULL").groupBy("frame_id", "channel").agg(F.sum(F.sqrt(total + eps)).alias("tv"))


def haar_details(px: DataFrame, value: str = "adu", levels: int = 1) -> DataFrame:
    """By frame and channel, the absolute sum of the three details of each two by two block, over levels of halving."""
    d, parts = px.select("frame_id", "channel", "y", "x", F.col(value).cast("double").alias("v")), None
    for _ in range(levels):
        at = lambda j, i: F.sum(F.when((F.col("y") % 2 == j) & (F.col("x") % 2 == i), F.col("v")))
        g = d.groupBy("frame_id", "channel", F.floor(F.col("y") / 2).cast("int").alias("yb"), F.floor(F.col("x") / 2).cast("int").alias("xb")).agg(at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 0).alias("c"), at(1, 1).alias("d")).where("a + b + c + d IS NOT NULL")
        detail = (F.abs(F.expr("a - b + c - d")) + F.abs(F.expr("a + b - c - d")) + F.abs(F.expr("a - b - c + d"))) / 2
        part = g.groupBy("frame_id", "channel").agg(F.sum(detail).alias("l1"))
        parts = part if parts is None else parts.unionByName(part)
        d = g.select("frame_id", "channel", F.col("yb").alias("y"), F.col("xb").alias("x"), F.expr("(a + b + c + d) / 2").alias("v"))
    return parts.groupBy("frame_id", "channel").agg(F.sum("l1").alias("l1"))


def pool(px: DataFrame, scale: int, value: str = "adu") -> DataFrame:
    """Means of scale x scale blocks."""
    block = lambda c: F.floor(F.col(c) / scale).cast("int").alias(c)
    return px.groupBy("frame_id", "channel", block("y"), block("x")).agg(F.avg(value).alias(value))


def repeat(px: DataFrame, scale: int, value: str = "adu") -> DataFrame:
    """Each pixel as scale x scale equal ones."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(scale * scale - 1)))
    d = px.select("frame_id", "channel", "y", "x", value, cell.alias("k"))
    return d.select("frame_id", "channel", (F.col("y") * scale + (F.col("k") / scale).cast("int")).alias("y"), (F.col("x") * scale + F.col("k") % scale).alias("x"), value)


def defect_interpolation(px: DataFrame, mixture: DataFrame, radius: int = 1, normal_threshold: float = 0.5, value: str = "adu") -> DataFrame:
    """px with pixels of p_normal below the threshold replaced by their neighbours' mean, weighed by p_normal; without weight around them they stay.

    Only defects are exploded into offsets; the rest of px passes through.
    """
    known = mixture.select("channel", "y", "x", "p_normal")
    offsets = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in range(-radius, radius + 1) for i in range(-radius, radius + 1) if (j, i) != (0, 0)])
    asked = known.where(F.col("p_normal") < normal_threshold).select("channel", F.col("y").alias("dy"), F.col("x").alias("dx"), F.explode(offsets).alias("o"))
    asked = asked.select("channel", "dy", "dx", (F.col("dy") + F.col("o.j")).alias("y"), (F.col("dx") + F.col("o.i")).alias("x")).join(known, ["channel", "y", "x"])
    near = asked.join(px.select("frame_id", "channel", "y", "x", F.col(value).alias("v")), ["channel", "y", "x"])
    fill = near.groupBy("frame_id", "channel", F.col("dy").alias("y"), F.col("dx").alias("x")).agg((F.sum(F.col("p_normal") * F.col("v")) / F.when(F.sum("p_normal") > 0, F.sum("p_normal"))).alias("__v"))
    return px.join(fill, ["frame_id", "channel", "y", "x"], "left").withColumn(value, F.coalesce("__v", F.col(value))).drop("__v")


def sigma_clipped(px: DataFrame, by: Sequence[str], value: str = "adu", sigma: float = 3.0, rounds: int = 3) -> DataFrame:
    """median, spread (robust, at least 1e-6) and n by group after rounds of strict clipping; a group without spread is done.

    What the rounds leave lies between two numbers by group; these are stored
    after each round, so a round reads the values twice, whatever came before.
    """
    base = px.select(*by, F.col(value).cast("double").alias("v"))
    keys, bounds = list(by), None
    with_ = lambda a, b: a.join(b, keys) if keys else a.join(F.broadcast(b))  # noqa: E731  without keys one row
    for k in range(rounds + 1):
        d = base if bounds is None else with_(base, bounds).where((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi"))).select(*keys, "v")
        m = d.groupBy(*keys).agg(F.median("v").alias("m"))
        s = with_(d, m).groupBy(*keys).agg((F.median(F.abs(F.col("v") - F.col("m"))) * MAD).alias("s"), F.first("m").alias("m"), F.count("*").alias("n"))
        if k == rounds:
            return s.select(*keys, F.col("m").alias("median"), F.greatest("s", F.lit(1e-6)).alias("spread"), "n")
        done = F.col("s") < 1e-9
        inf = F.lit(float("inf"))
        lo, hi = F.when(done, -inf).otherwise(F.col("m") - sigma * F.col("s")), F.when(done, inf).otherwise(F.col("m") + sigma * F.col("s"))
        new = s.select(*keys, lo.alias("lo"), hi.alias("hi"))
        if bounds is not None:
            old = bounds.withColumnsRenamed({"lo": "lo0", "hi": "hi0"})
            new = with_(new, old).select(*keys, F.greatest("lo", "lo0").alias("lo"), F.least("hi", "hi0").alias("hi"))
        bounds = cut(new, "bounds")


def sky_mesh(px: DataFrame, height: int, width: int, box: int = 128, value: str = "adu") -> DataFrame:
    """The clipped median of overlapping tiles: frame_id, channel, tr, tc, sky; the tiles' centres are spread evenly from edge to edge.

    A pixel works out from its place which tiles it is in, so there is no join.
    """

    def tiles(at: str, size: int):
        spans = frame.tile_bounds(max(2, size // box), size, box)
        return F.explode(F.array_compact(F.array(*[F.when((F.col(at) >= a) & (F.col(at) < b), F.lit(k)) for k, (a, b) in enumerate(spans)])))

    d = px.select("frame_id", "channel", "x", value, tiles("y", height).alias("tr")).select("frame_id", "channel", "tr", value, tiles("x", width).alias("tc"))
    return sigma_clipped(d, ["frame_id", "channel", "tr", "tc"], value).select("frame_id", "channel", "tr", "tc", F.col("median").alias("sky"))


def sky_meshes(frames: DataFrame, box: int = 128) -> DataFrame:
    """The sky in overlapping tiles of frames(frame_id, h, w, data), as the run takes it: frame_id, tr, tc, sky. One pass, each frame in its own row."""

    def work(image, row):
        mesh = frame.sky_mesh(image, box)
        return [(row["frame_id"], r, c, float(v)) for (r, c), v in np.ndenumerate(mesh)]

    return images.measure_images(frames, f"frame_id {dict(frames.dtypes)['frame_id']}, tr int, tc int, sky double", work)
