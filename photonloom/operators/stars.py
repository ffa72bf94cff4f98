"""Stars: matching by triangles, photometry by range joins, transparency, centroids and point-spread functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frame
from .neighbourhood import local_maxima


def ranked(stars: DataFrame, value: str = "peak", limit: int | None = None) -> DataFrame:
    """stars with star_rank from 0 by brightness within the frame (ties: y, x); the brightest, with a limit."""
    w = Window.partitionBy("frame_id").orderBy(F.desc(value), "y", "x")
    out = stars.withColumn("star_rank", F.row_number().over(w) - 1)
    return out if limit is None else out.where(F.col("star_rank") < limit)


def gathered(stars: DataFrame, limit: int) -> DataFrame:
    """A frame's stars below limit as one row: frame_id, s of r (star_rank), y, x in order of rank; dealt by frame over many tasks, however few bytes they are."""
    tasks = max(int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * stars.sparkSession.sparkContext.defaultParallelism)  # few bytes, much work
    star = F.struct(F.col("star_rank").alias("r"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    return stars.where(F.col("star_rank") < limit).repartition(tasks, "frame_id").groupBy("frame_id").agg(F.sort_array(F.collect_list(star)).alias("s"))


def triangles(stars: DataFrame, limit: int = 50) -> DataFrame:
    """All triangles of a frame's brightest stars: frame_id, i < j < k, u = a/c, v = b/c of the sides a <= b <= c.

    limit bounds a frame's stars, and so its triangles. A frame's stars are one
    row; each is followed by those behind it, twice, so nothing is joined and
    all that travels is stars.
    """
    known = F.col("frame_id").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()
    behind = lambda s: F.slice(s, F.col("at") + 2, F.size(s))
    t = gathered(stars.where(known), limit).select("frame_id", "s", F.posexplode("s").alias("at", "p"))
    t = t.select("frame_id", "p", behind("s").alias("s")).select("frame_id", "p", "s", F.posexplode("s").alias("at", "q"))
    t = t.select("frame_id", "p", "q", behind("s").alias("s")).select("frame_id", "p", "q", F.explode("s").alias("r"))
    d = lambda a, b: F.sqrt((F.col(f"{a}.y") - F.col(f"{b}.y")) * (F.col(f"{a}.y") - F.col(f"{b}.y")) + (F.col(f"{a}.x") - F.col(f"{b}.x")) * (F.col(f"{a}.x") - F.col(f"{b}.x")))
    t = t.where((F.col("p.r") < F.col("q.r")) & (F.col("q.r") < F.col("r.r")))  # stars of one rank make no triangle
    t = t.select("frame_id", F.col("p.r").alias("i"), F.col("q.r").alias("j"), F.col("r.r").alias("k"), d("p", "q").alias("d"), d("p", "r").alias("e"), d("q", "r").alias("f"))
    low, middle, high = F.least("d", "e", "f"), F.greatest(F.least("d", "e"), F.least(F.greatest("d", "e"), "f")), F.greatest("d", "e", "f")
    return t.where(high >= 1e-6).select("frame_id", "i", "j", "k", (low / high).alias("u"), (middle / high).alias("v"))


def match_triangles(tri: DataFrame, reference: DataFrame, tol: float = 0.02, max_reference: int = 100_000) -> DataFrame:
    """Each triangle with the nearest reference triangle within tol in (u, v); of those equally near to 1e-9, the one of the brightest stars.

    reference has the triangles of one frame's stars, whose number triangles()
    bounds; tasks hold them in cells of tol and compare a cell's triangles with
    those of the cells around it. More than max_reference are an error.
    """
    ref = reference.select("i", "j", "k", "u", "v").limit(max_reference + 1).toPandas().sort_values(["i", "j", "k"])
    if len(ref) > max_reference:
        raise ValueError(f"more than {max_reference} reference triangles")
    corners, shapes = ref[["i", "j", "k"]].to_numpy(), ref[["u", "v"]].to_numpy(dtype=float)
    shared = tri.sparkSession.sparkContext.broadcast((corners, shapes))  # max_reference rows of five numbers at most

    def run(batches):
        import pandas as pd

        from ..functions.frame import nearest_shapes

        corners, shapes = shared.value
        held, size = [], 0

        def matched():
            pdf = pd.concat(held, ignore_index=True)
            found = nearest_shapes(pdf[["u", "v"]].to_numpy(dtype=float), shapes, tol)
            out = pdf.loc[found >= 0, ["frame_id", "i", "j", "k"]].copy()
            out["ri"], out["rj"], out["rk"] = corners[found[found >= 0]].T if len(out) else ([], [], [])
            held.clear()
            return out

        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= 250_000:  # many to a cell
                yield matched()
                size = 0
        if held:
            yield matched()

    kinds = dict(tri.dtypes)
    names = ["frame_id", "i", "j", "k"]
    return tri.select(*names, "u", "v").mapInPandas(run, ", ".join([f"{c} {kinds[c]}" for c in names] + [f"{c} {kinds[c[1:]]}" for c in ("ri", "rj", "rk")]))


def star_votes(matches: DataFrame, min_votes: int = 2, min_pairs: int = 3) -> DataFrame:
    """Pairs (star, ref) of a frame with min_votes triangles or more; none for frames with fewer than min_pairs such pairs."""
    pair = lambda a, b: F.struct(F.col(a).alias("star"), F.col(b).alias("ref"))
    v = matches.select("frame_id", F.explode(F.array(pair("i", "ri"), pair("j", "rj"), pair("k", "rk"))).alias("p")).groupBy("frame_id", "p.star", "p.ref").agg(F.count("*").alias("votes")).where(F.col("votes") >= min_votes)
    n = v.groupBy("frame_id").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_pairs)
    return v.join(n, "frame_id").drop("__n")


def match_stars(stars: DataFrame, reference, limit: int = 50, tol: float = 0.02, min_votes: int = 2, min_pairs: int = 3) -> DataFrame:
    """star_votes of all triangles of each frame's brightest stars against those of the frame `reference`: frame_id, star, ref, votes.

    A frame's stars are one row of at most `limit` places; its triangles are
    made, matched and counted there, so what travels is stars and pairs, not
    triangles. The reference frame's stars are sent to the tasks.
    """
    short = gathered(stars, limit)
    first = short.where(F.col("frame_id") == F.lit(reference)).select("s").first()
    ref = stars.sparkSession.sparkContext.broadcast([tuple(s) for s in first.s] if first else [])  # limit stars

    def run(batches):
        places = lambda s: np.array([(y, x) for _, y, x in s], dtype=float).reshape(-1, 2)
        known, ranks = frame.Reference(places(ref.value), limit, tol), np.array([r for r, *_ in ref.value], dtype=np.int64)
        for batch in batches:
            for key, own in zip(batch.column("frame_id"), batch.column("s").to_pylist()):
                own = [(s["r"], s["y"], s["x"]) for s in own]
                votes = known.votes(places(own))
                i, j = np.nonzero(votes >= min_votes)
                if len(i) >= min_pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(i), key.type), pa.array(np.array([r for r, *_ in own])[i]), pa.array(ranks[j]), pa.array(votes[i, j])], names=["frame_id", "star", "ref", "votes"])

    return short.mapInArrow(run, f"frame_id {dict(stars.dtypes)['frame_id']}, star long, ref long, votes long")


def aperture_flux(stars: DataFrame, px: DataFrame, radius: float, value: str = "adu") -> DataFrame:
    """flux of each star within radius, less the median of the ring from 1.5 to 2.5 radii; a star asks only for the pixels of its box."""
    reach = int(2.5 * radius) + 1
    span = F.sequence(F.lit(-reach), F.lit(reach))
    box = stars.select("frame_id", "star_rank", F.col("y").alias("sy"), F.col("x").alias("sx"), F.explode(span).alias("j")).select("*", F.explode(span).alias("i"))
    box = box.select("frame_id", "star_rank", "sy", "sx", (F.round("sy").cast("int") + F.col("j")).alias("y"), (F.round("sx").cast("int") + F.col("i")).alias("x"))
    d = F.hypot(F.col("y") - F.col("sy"), F.col("x") - F.col("sx"))
    hit = box.join(px.select("frame_id", "y", "x", F.col(value).alias("v")), ["frame_id", "y", "x"]).withColumn("d", d)
    inside = F.col("d") <= radius
    ring = (F.col("d") > 1.5 * radius) & (F.col("d") <= 2.5 * radius)
    g = hit.groupBy("frame_id", "star_rank").agg(F.sum(F.when(inside, F.col("v"))).alias("s"), F.count_if(inside).alias("n"), F.median(F.when(ring, F.col("v"))).alias("sky"))
    return g.select("frame_id", "star_rank", (F.col("s") - F.col("n") * F.coalesce("sky", F.lit(0.0))).alias("flux"))


def transparency(fluxes: DataFrame, reference: DataFrame) -> DataFrame:
    """By frame, the median ratio of its stars' fluxes to the reference's of the same rank, between 0.01 and 1.5; 1 with fewer than two pairs."""
    r = reference.select("star_rank", F.col("flux").alias("ref"))
    j = fluxes.join(r, "star_rank", "left").withColumn("q", F.when((F.col("flux") > 0) & (F.col("ref") > 0), F.col("flux") / F.col("ref")))
    t = F.least(F.greatest(F.median("q"), F.lit(0.01)), F.lit(1.5))
    return j.groupBy("frame_id").agg(F.when(F.count("q") >= 2, t).otherwise(1.0).alias("transparency"), F.count("q").alias("pairs"))


def centroids(peaks: DataFrame, px: DataFrame, radius: int = 2, value: str = "adu") -> DataFrame:
    """Centres of gravity of the values above 0 in the (2 radius + 1)^2 pixels around each peak; the peak itself without any."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    box = peaks.select("frame_id", F.col("y").alias("py"), F.col("x").alias("px"), F.explode(span).alias("j")).select("*", F.explode(span).alias("i"))
    box = box.select("frame_id", "py", "px", (F.col("py") + F.col("j")).alias("y"), (F.col("px") + F.col("i")).alias("x"))
    v = box.join(px.select("frame_id", "y", "x", F.greatest(value, F.lit(0.0)).alias("v")), ["frame_id", "y", "x"])
    g = v.groupBy("frame_id", "py", "px").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("y")).alias("sy"), F.sum(F.col("v") * F.col("x")).alias("sx"))
    whole = F.when(F.col("s") > 0, F.col("s"))
    return g.select("frame_id", "py", "px", F.coalesce(F.col("sy") / whole, F.col("py").cast("double")).alias("y"), F.coalesce(F.col("sx") / whole, F.col("px").cast("double")).alias("x"))


def candidate_peaks(px: DataFrame, noise: DataFrame, height: int, width: int, snr: float = 5.0, size: int = 3, border: int = 2, saturation: float | None = None, value: str = "adu") -> DataFrame:
    """Local maxima above snr times the frame's noise(frame_id, rms), away from the border and below saturation."""
    p = local_maxima(px, size, value).join(noise, "frame_id").where(F.col(value) > snr * F.col("rms"))
    p = p.where((F.col("y") >= border) & (F.col("y") < height - border) & (F.col("x") >= border) & (F.col("x") < width - border))
    return p if saturation is None else p.where(F.col(value) < saturation)


def isolated(peaks: DataFrame, min_sep: float, max_stars: int = 50, value: str = "adu") -> DataFrame:
    """By frame, from the brightest down, the peaks that no kept peak is nearer to than min_sep; max_stars at most.

    The choice is by order, so a frame's peaks are gone through together, one
    frame after the other, in Arrow batches; a frame's peaks fit in memory.
    """

    def keep(pdf):
        pdf = pdf.sort_values([value, "y", "x"], ascending=[False, True, True])
        ys, xs, rows = [], [], []
        for row, y, x in zip(pdf.index, pdf.y, pdf.x):
            if all((y - a) ** 2 + (x - b) ** 2 >= min_sep**2 for a, b in zip(ys, xs)):
                ys.append(y), xs.append(x), rows.append(row)
                if len(rows) == max_stars:
                    break
        out = pdf.loc[rows, ["frame_id", "y", "x", value]].copy()
        out["star_rank"] = range(len(out))
        return out

    kinds = dict(peaks.dtypes)
    return peaks.groupBy("frame_id").applyInPandas(keep, f"frame_id {kinds['frame_id']}, y {kinds['y']}, x {kinds['x']}, {value} double, star_rank long")


def psf_stack(stamps: DataFrame) -> DataFrame:
    """The pixel-wise median of aligned stamps (frame_id, star_rank, ky, kx, v), not below 0, of sum 1."""
    g = stamps.groupBy("frame_id", "ky", "kx").agg(F.greatest(F.median("v"), F.lit(0.0)).alias("v"))
    s = g.groupBy("frame_id").agg(F.sum("v").alias("s"))
    return g.join(s, "frame_id").select("frame_id", "ky", "kx", F.when(F.col("s") > 0, F.col("v") / F.col("s")).otherwise(0.0).alias("w"))


def background_noise(px: DataFrame, value: str = "adu") -> DataFrame:
    """rms (population; at least 1, and 1 with 100 pixels or fewer) of the pixels below a frame's 60th percentile."""
    q = px.groupBy("frame_id").agg(F.percentile(value, 0.6).alias("q"))
    g = px.join(q, "frame_id").where(F.col(value) < F.col("q")).groupBy("frame_id").agg(F.stddev_pop(value).alias("s"), F.count("*").alias("n"))
    return q.select("frame_id").join(g, "frame_id", "left").select("frame_id", F.when(F.col("n") > 100, F.greatest("s", F.lit(1.0))).otherwise(1.0).alias("rms"))
