"""The run over frames as arrays: one narrow stage of array kernels for each pass over the frames, and sums that tasks add up themselves.

A frame is one row. What is summed over frames (moments of a pixel, the stack)
is added up in each task's own arrays where a task sees many frames, so that it
hands on as many numbers as the sensor has pixels; where frames are large and
a task sees few, they are dealt once by bands of sensor rows instead. The instrument's maps, whose size is
the sensor's, are the only arrays that the driver and all tasks hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import frame as kernel
from ..functions.kernels import sky_surface
from ..operators import geometry
from ..operators.calibration import BAYER

MOMENTS = ("n", "mt", "mv", "stt", "stv", "svv")
MAPS = ("bias_mean", "read_noise", "dark_rate", "flat_gain", "flat_uncertainty", "amp_glow")
STACK = ("weighted_sum", "weight_sum", "sky_sum", "sq_sum")


def images(batches, *extra: str) -> Iterator[tuple[np.ndarray, dict]]:
    """Each row's image and the extra columns, a row at a time, as images may be large."""
    for batch in batches:
        for k in range(batch.num_rows):
            data = batch.column("data")[k].values.to_numpy(zero_copy_only=False).astype(np.float64)
            yield data.reshape(batch.column("h")[k].as_py(), batch.column("w")[k].as_py()), {c: batch.column(c)[k].as_py() for c in extra}


def merged(a: tuple, b: tuple) -> tuple:
    """The moments (n, means of t and v, sums of squares and products about them) of two disjoint sets of samples, pixel by pixel."""
    n = a[0] + b[0]
    share = np.where(n > 0, b[0] / np.where(n > 0, n, 1), 0.0)
    dt, dv, w = b[1] - a[1], b[2] - a[2], a[0] * share
    return n, a[1] + dt * share, a[2] + dv * share, a[3] + b[3] + dt * dt * w, a[4] + b[4] + dt * dv * w, a[5] + b[5] + dv * dv * w


def rows_of(name: str, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each row of the sensor: channel, y, and each array's numbers there."""
    h = len(next(iter(arrays.values())))
    return pa.RecordBatch.from_arrays([pa.array([name] * h), pa.array(np.arange(h, dtype=np.int32)), *[pa.array(list(a), pa.list_(pa.float64())) for a in arrays.values()]], names=["channel", "y", *arrays])


def frames_per_task(frames: DataFrame) -> float:
    """How many frames a task of a scan sees on the whole."""
    return frames.count() / max(frames.rdd.getNumPartitions(), 1)


def in_bands(parts: DataFrame, channel_rows: int) -> DataFrame:
    """Rows of (channel, band, ...) dealt so that a band is in one task: a shuffle of the frames, once, whatever a task hands on otherwise."""
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts.sparkSession.sparkContext.defaultParallelism)
    return parts.repartition(min(tasks, channel_rows), "channel", "band")


def bands_of(name: str, image: np.ndarray, rows: int, **numbers: float) -> pa.RecordBatch:
    """An image as one row for each band of sensor rows: channel, band, numbers, data."""
    tops = range(0, len(image), rows)
    n = len(tops)
    return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([y // rows for y in tops], pa.int32()), *[pa.array([float(v)] * n) for v in numbers.values()], pa.array([np.ascontiguousarray(image[y : y + rows]).ravel() for y in tops], pa.list_(pa.float64()))], names=["channel", "band", *numbers, "data"])


#: A band's rows of the sensor: few enough that there are bands for many tasks.
BAND = 16


def moments(frames: DataFrame, work: Callable[[np.ndarray, dict], np.ndarray | None], least: float = 12.0) -> dict[str, np.ndarray] | None:
    """By pixel, the moments of work(image, row) over exposure; images of None are left out, and without any frame there is nothing.

    Tasks that see `least` frames or more add them up and hand on their six sums
    for each pixel. Where frames are so large that a task sees fewer, that
    would be more than the frames themselves; then the frames are dealt once by
    bands of sensor rows.
    """

    def samples(batches):
        for image, row in images(batches, "exposure_s"):
            v = work(image, row)
            if v is not None:
                yield v, row["exposure_s"]

    def grown(total, v, t):
        one, zero = np.ones_like(v), np.zeros_like(v)
        new = (one, one * t, v, zero, zero, zero)
        return new if total is None else merged(total, new)

    def run(batches):
        total = None
        for v, t in samples(batches):
            total = grown(total, v, t)
        if total is not None:
            yield rows_of("L", dict(zip(MOMENTS, total)))

    def cut(batches):
        for v, t in samples(batches):
            yield bands_of("L", v, BAND, t=t)

    def add_bands(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                band = batch.column("band")[k].as_py()
                held[band] = grown(held.get(band), batch.column("data")[k].values.to_numpy(), batch.column("t")[k].as_py())
        for band, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([band], pa.int32()), *[pa.array([v], pa.list_(pa.float64())) for v in total]], names=["y", *MOMENTS])

    columns = ", ".join(f"{c} array<double>" for c in MOMENTS)
    rows = frames.select("h", "w", "data", "exposure_s")
    if frames_per_task(frames) < least:
        size = frames.select("h", "w").first()
        if size is None:
            return None
        parts = rows.mapInArrow(cut, "channel string, band int, t double, data array<double>")
        t = in_bands(parts, -(-size.h // BAND)).mapInArrow(add_bands, f"y int, {columns}").toArrow()  # as many numbers as the sensor has pixels
        if not t.num_rows:
            return None
        order = np.argsort(t.column("y").to_numpy())
        return {c: np.concatenate([t.column(c)[int(k)].values.to_numpy() for k in order]).reshape(size.h, size.w) for c in MOMENTS}

    parts = rows.mapInArrow(run, f"channel string, y int, {columns}")

    def fold(key, table):
        total = None
        for k in range(table.num_rows):
            part = tuple(table.column(c)[k].values.to_numpy() for c in MOMENTS)
            total = part if total is None else merged(total, part)
        return pa.table({"y": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([v], pa.list_(pa.float64())) for c, v in zip(MOMENTS, total)}})

    t = parts.groupBy("y").applyInArrow(fold, f"y int, {columns}").toArrow()  # as many numbers as the sensor has pixels
    if not t.num_rows:
        return None
    order = np.argsort(t.column("y").to_numpy())
    return {c: np.stack([t.column(c)[int(k)].values.to_numpy() for k in order]) for c in MOMENTS}


def fit_model(frames: DataFrame, sigma: float = 5.0) -> dict[str, np.ndarray]:
    """The instrument's maps from frames of frame_type bias, dark, flat and dark_flat: three passes, each over its own kind; maps without frames are absent."""
    of = lambda kind: frames.where(F.col("frame_type") == kind)
    h, w = frames.select("h", "w").first()
    maps: dict[str, np.ndarray] = {}
    bias = moments(of("bias"), lambda v, _: v)
    if bias:
        maps |= {"bias_mean": bias["mv"], "read_noise": np.sqrt(np.where(bias["n"] > 1, bias["svv"] / np.maximum(bias["n"] - 1, 1), np.nan))}
    shared = _broadcast(frames.sparkSession, maps, h, w)
    dark = moments(of("dark"), lambda v, _: v - shared.value["bias_mean"])
    if dark:
        several = dark["stt"] > 1e-12
        slope = np.where(several, dark["stv"] / np.where(several, dark["stt"], 1.0), dark["mv"] / dark["mt"])
        rate = maps["dark_rate"] = np.maximum(slope, 0.0)
        middle = np.median(rate)
        maps["hot_pixel"] = rate > middle + sigma * kernel.MAD * np.median(np.abs(rate - middle))
    shared = _broadcast(frames.sparkSession, maps, h, w)
    maps |= _flat(of("flat"), shared)
    glow = moments(of("dark_flat"), lambda v, _: v - shared.value["bias_mean"])
    if glow:
        maps["amp_glow"] = glow["mv"]
    return maps


def _flat(flats: DataFrame, shared) -> dict[str, np.ndarray]:
    """flat_gain, whose median is 1, and its spread beyond the noise of counting; frames of a median not above 0 are left out."""

    def net(v, row):
        return v - shared.value["bias_mean"] - shared.value["dark_rate"] * row["exposure_s"]

    def normal(v, row):
        x = net(v, row)
        m = np.median(x)
        return x / m if m > 0 else None

    gain = moments(flats, normal)
    if not gain:
        return {}
    raw = moments(flats, lambda v, row: x if np.median(x := net(v, row)) > 0 else None)
    middle = np.median(gain["mv"]) or 1.0
    var = np.where(gain["n"] > 1, gain["svv"] / np.maximum(gain["n"] - 1, 1), np.nan)
    left = np.sqrt(np.maximum(var - 1 / (np.maximum(raw["mv"], 1.0) * gain["n"]), 0.0))
    return {"flat_gain": gain["mv"] / middle, "flat_uncertainty": np.where(raw["mv"] > 0, left, 0.0)}


def _broadcast(spark: SparkSession, maps: dict[str, np.ndarray], h: int, w: int):
    """The maps that calibration needs, those that are absent as what changes nothing; of the sensor's size."""
    plain = {"bias_mean": np.zeros((h, w)), "dark_rate": np.zeros((h, w)), "flat_gain": np.ones((h, w)), "hot_pixel": np.zeros((h, w), bool)}
    return spark.sparkContext.broadcast({c: np.where(np.isnan(m), v, m) if (m := maps.get(c, v)).dtype != bool else m for c, v in plain.items()})


def model_table(spark: SparkSession, maps: dict[str, np.ndarray], h: int) -> DataFrame:
    """The maps as one row for each pixel: channel, y, x, and null where a map is absent."""
    shared = spark.sparkContext.broadcast(maps)

    def run(batches):
        for batch in batches:
            for y in batch.column(0).to_pylist():
                m = shared.value
                n = next(iter(m.values())).shape[1]
                numbers = [pa.array(m[c][y], pa.float64(), from_pandas=True) if c in m else pa.nulls(n, pa.float64()) for c in MAPS]
                hot = pa.array(m["hot_pixel"][y]) if "hot_pixel" in m else pa.nulls(n, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(["L"] * n), pa.array([y] * n, pa.int32()), pa.array(range(n), pa.int32()), *numbers, hot], names=["channel", "y", "x", *MAPS, "hot_pixel"])

    schema = "channel string, y int, x int, " + ", ".join(f"{c} double" for c in MAPS) + ", hot_pixel boolean"
    return spark.range(h if maps else 0).mapInArrow(run, schema)


def maps_of(model: DataFrame, h: int, w: int) -> dict[str, np.ndarray]:
    """The maps of a stored model; of the sensor's size."""
    columns = [c for c in (*MAPS, "hot_pixel") if c in model.columns]
    t = model.select("y", "x", *columns).toArrow()
    y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
    maps = {}
    for c in columns:
        if t.column(c).null_count < t.num_rows:
            maps[c] = np.zeros((h, w), bool) if c == "hot_pixel" else np.full((h, w), np.nan)
            maps[c][y, x] = t.column(c).fill_null(False).to_numpy(zero_copy_only=False) if c == "hot_pixel" else t.column(c).to_numpy(zero_copy_only=False)
    return maps


def planes(image: np.ndarray, pattern: str | None) -> dict[str, np.ndarray]:
    """The image as channel L, or a colour sensor's four planes of half the size."""
    return {name: image[r::2, c::2] for (r, c), name in BAYER[pattern.upper()].items()} if pattern else {"L": image}


def characterised(lights: DataFrame, maps: dict[str, np.ndarray], cfg, pattern: str | None = None) -> DataFrame:
    """One pass over the raw lights: frame_id, h, w, data (calibrated, hot and cosmic-ray pixels replaced, its sky level), sky, fwhm, stars (y, x, flux), brightest first, and psf where there are stars enough.

    The sky is a surface through the clipped medians of tiles of cfg.sky_box; what
    it differs from its median by is taken off, and its median stays as sky. On a
    colour sensor sky and stars are those of the mean of the four planes, and
    each plane's sky goes in the ratio of its median to theirs.
    """
    h, w = lights.select("h", "w").first() or (1, 1)
    shared = _broadcast(lights.sparkSession, maps, h, w)
    kind = dict(lights.dtypes)["frame_id"]
    names = ["frame_id", "h", "w", "data", "sky", "fwhm", "stars", "psf"]

    def run(batches):
        for image, row in images(batches, "frame_id", "exposure_s"):
            m = shared.value
            cal = kernel.replaced(kernel.calibrated(image, row["exposure_s"], m), m["hot_pixel"])
            if cfg.cosmic_sigma is not None:  # each colour by itself
                for part in planes(cal, pattern).values():
                    part[:] = kernel.replaced(part, kernel.outliers(part, cfg.cosmic_sigma))
            saturated = image >= cfg.saturation if cfg.saturation else None
            lum = np.mean(list(planes(cal, pattern).values()), axis=0)
            if saturated is not None and pattern:
                saturated = np.any(list(planes(saturated, pattern).values()), axis=0)
            surface = sky_surface(kernel.sky_mesh(lum, cfg.sky_box), *lum.shape)
            sky = float(np.median(surface))
            middle = np.median(lum)
            for part in planes(cal, pattern).values():
                part -= (surface - sky) * (np.median(part) / middle if pattern and middle else 1.0)
            lum = lum - (surface - sky)
            stars = kernel.find_stars(lum - sky, cfg.snr, cfg.min_sep, cfg.max_stars, cfg.aperture, saturated=saturated)
            listed = [{"y": y, "x": x, "flux": f} for y, x, f in stars.tolist()]
            psf = kernel.aligned_psf(lum - sky, stars, cfg.psf_size)
            yield pa.RecordBatch.from_arrays([pa.array([row["frame_id"]]), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([cal.ravel()], pa.list_(pa.float64())), pa.array([sky]), pa.array([kernel.width(lum - sky, stars)], pa.float64()), pa.array([listed], pa.list_(pa.struct([("y", pa.float64()), ("x", pa.float64()), ("flux", pa.float64())]))), pa.array([None if psf is None else psf.ravel()], pa.list_(pa.float64()))], names=names)

    return lights.select("frame_id", "exposure_s", "h", "w", "data").mapInArrow(run, f"frame_id {kind}, h int, w int, data array<double>, sky double, fwhm double, stars array<struct<y: double, x: double, flux: double>>, psf array<double>")


AFFINE = ("a", "b", "c", "d", "e", "f")


def compared(seen: DataFrame, reference) -> DataFrame:
    """frame_id, sky, n_stars, transparency, fwhm, dx, dy, rotation, scale_ratio of characterised frames against the reference frame's stars, and to_reference.

    to_reference (a..f) takes the frame's (x, y) to the reference's
    (ax+by+c, dx+ey+f); it is null where the stars don't tell. dx, dy are the
    shift of the stars' middle.
    """
    found = seen.where(F.col("frame_id") == F.lit(reference)).select("stars").first()
    ref = np.array([(s.y, s.x, s.flux) for s in (found.stars if found else [])]).reshape(-1, 3)  # max_stars at most
    kind = dict(seen.dtypes)["frame_id"]

    def run(batches):
        import pandas as pd

        known = kernel.Reference(ref)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                own = np.array([(s["y"], s["x"], s["flux"]) for s in r.stars]).reshape(-1, 3)
                found = kernel.registered(own, known)
                m = found or {"tx": 0.0, "ty": 0.0, "rotation": 0.0, "scale": None}
                affine = dict(zip(AFFINE, (m["turn"].real, -m["turn"].imag, m["shift"].real, m["turn"].imag, m["turn"].real, m["shift"].imag))) if found else None
                rows.append((r.frame_id, r.sky, len(own), kernel.clear_sky(own[:, 2], ref[:, 2]), r.fwhm, m["tx"], m["ty"], m["rotation"], m["scale"], affine, r.has_psf))
            yield pd.DataFrame(rows, columns=["frame_id", "sky", "n_stars", "transparency", "fwhm", "dx", "dy", "rotation", "scale_ratio", "to_reference", "has_psf"])

    affine = "struct<" + ", ".join(f"{c}: double" for c in AFFINE) + ">"
    return seen.select("frame_id", "sky", "fwhm", "stars", F.col("psf").isNotNull().alias("has_psf")).mapInPandas(run, f"frame_id {kind}, sky double, n_stars long, transparency double, fwhm double, dx double, dy double, rotation double, scale_ratio double, to_reference {affine}, has_psf boolean")


@dataclass(frozen=True)
class Canvas:
    """The grid of a stack: its size, and where the reference's first pixel lies on it."""

    rows: int
    cols: int
    row0: int = 0
    col0: int = 0


def registered(meta: DataFrame, lights: DataFrame, reference, how: str, colour: bool) -> DataFrame:
    """meta with registered (wcs, stars or none) and to_reference by the best way there is for each frame.

    By the WCS of the lights' columns crpix1..cd22 where both the frame and
    the reference have one; else by stars; else a frame stays where it is.
    how is affine, or shift for the stars' shift alone whatever else is known.
    """
    stars_only = F.when(F.col("to_reference").isNotNull() | (F.col("frame_id") == F.lit(reference)), "stars").otherwise("none")
    if how == "shift":
        moved = dict(zip(AFFINE, (F.lit(1.0), F.lit(0.0), F.col("dx"), F.lit(0.0), F.lit(1.0), F.col("dy"))))
        return meta.withColumns({"registered": stars_only, "to_reference": _struct(moved)})
    same = _struct(dict(zip(AFFINE, map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)))))
    if not set(geometry.WCS) <= set(lights.columns):
        return meta.withColumns({"registered": stars_only, "to_reference": F.when(F.col("frame_id") == F.lit(reference), same).otherwise(F.coalesce("to_reference", same))})
    own = lights.select("frame_id", "h", "w", *geometry.WCS)
    ref = own.where(F.col("frame_id") == F.lit(reference)).select(*[F.col(c).alias(f"r_{c}") for c in geometry.WCS]).limit(1)
    d = meta.join(own, "frame_id").join(F.broadcast(ref))
    planes = 2 if colour else 1
    h, w = F.col("h") / planes, F.col("w") / planes
    # the frame's middle and two points beside it go through the sky to the reference's grid
    cx, cy, arm = (w - 1) / 2, (h - 1) / 2, F.least(h, w) / 4
    (x0, y0), (x1, y1), (x2, y2) = [[v / planes for v in geometry.through_sky(x * planes, y * planes, "", "r_")] for x, y in ((cx, cy), (cx + arm, cy), (cx, cy + arm))]
    m = {"a": (x1 - x0) / arm, "b": (x2 - x0) / arm, "d": (y1 - y0) / arm, "e": (y2 - y0) / arm}
    sky = _struct({"a": m["a"], "b": m["b"], "c": x0 - m["a"] * cx - m["b"] * cy, "d": m["d"], "e": m["e"], "f": y0 - m["d"] * cx - m["e"] * cy})
    known = x0.isNotNull() & x1.isNotNull() & x2.isNotNull()
    best = F.when(known, sky).when(F.col("frame_id") == F.lit(reference), same).otherwise(F.coalesce("to_reference", same))
    return d.withColumns({"registered": F.when(known, "wcs").otherwise(stars_only), "to_reference": best}).select(*meta.columns, "registered")


def with_psf_frame(meta: DataFrame, lights: DataFrame) -> DataFrame:
    """meta with psf_frame: the frame whose PSF a frame uses, which is its own, else that of the last frame before it in its session that has one; null before the first."""
    session = lights.select("frame_id", F.col("session").alias("__s")) if "session" in lights.columns else lights.select("frame_id", F.lit(0).alias("__s"))
    known = F.when(F.col("has_psf"), F.col("frame_id"))
    order = Window.partitionBy("__s").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # short rows of one session
    return meta.join(session, "frame_id").withColumn("psf_frame", F.last(known, ignorenulls=True).over(order)).drop("__s")


def _struct(columns: dict) -> Column:
    return F.struct(*[columns[c].cast("double").alias(c) for c in AFFINE])


def union_canvas(meta: DataFrame, height: int, width: int) -> Canvas:
    """The smallest canvas around the reference and the corners of all frames of meta on its grid."""
    t = lambda c: F.col(f"to_reference.{c}")
    spots = F.array(*[F.struct((t("d") * x + t("e") * y + t("f")).alias("y"), (t("a") * x + t("b") * y + t("c")).alias("x")) for y in (0, height - 1) for x in (0, width - 1)])
    near = lambda c, up: F.ceil(c - 1e-6) if up else F.floor(c + 1e-6)  # noqa: E731  rounding adds no empty row
    k = meta.select(F.explode(spots).alias("k"))
    r = k.agg(*[near(f(f"k.{c}"), f is F.max).alias(f"{c}{n}") for c in "yx" for n, f in enumerate((F.min, F.max))]).first()
    if r.y0 is None:
        return Canvas(height, width)
    y0, y1, x0, x1 = min(r.y0, 0), max(r.y1, height - 1), min(r.x0, 0), max(r.x1, width - 1)
    return Canvas(y1 - y0 + 1, x1 - x0 + 1, -y0, -x0)


def from_canvas(m: dict[str, float], canvas: Canvas) -> tuple[float, ...]:
    """a..f, which take canvas (x, y) to the frame: the inverse of to_reference, behind the canvas's origin."""
    to = np.array([[m["a"], m["b"], m["c"] + canvas.col0], [m["d"], m["e"], m["f"] + canvas.row0], [0.0, 0.0, 1.0]])
    return tuple(np.linalg.inv(to)[:2].ravel().tolist())


def stacked(seen: DataFrame, meta: DataFrame, pattern: str | None = None, canvas: Canvas | None = None, order: int = 1, least: float = 8.0) -> DataFrame:
    """The stack's four sums by channel and canvas pixel, of frames put there by their to_reference.

    A colour sensor's planes each move as the half-size mean of them does, on
    which the stars were found, and share its sky in the ratio of their
    medians. order is that of the spline that resamples: 1 or 3. As moments(),
    tasks that see `least` frames or more hand on sums, others their frames in
    bands of the canvas.
    """
    rows = seen.select("frame_id", "h", "w", "data").join(meta.select("frame_id", "sky", "transparency", "to_reference"), "frame_id")

    def moved(batches):
        for image, row in images(batches, "sky", "transparency", "to_reference"):
            middle = np.median(image)
            for name, p in planes(image, pattern).items():
                where = canvas or Canvas(*p.shape)
                v = kernel.warped(p, from_canvas(row["to_reference"], where), where.rows, where.cols, order)
                sky = row["sky"] if not pattern or middle == 0 else row["sky"] * np.median(p) / middle
                yield name, v, sky, row["transparency"]

    def grown(sums, v, sky, t):
        ok = np.isfinite(v)
        s = np.where(ok, v - sky, 0.0)
        new = (t * s, t * ok, sky * ok, t * s * s)
        return new if sums is None else tuple(a + b for a, b in zip(sums, new))

    def run(batches):
        total: dict[str, tuple] = {}
        for name, v, sky, t in moved(batches):
            total[name] = grown(total.get(name), v, sky, t)
        for name, sums in total.items():
            yield rows_of(name, dict(zip(STACK, sums)))

    def cut(batches):
        for name, v, sky, t in moved(batches):
            yield bands_of(name, v, BAND, sky=sky, t=t)

    def listed(name, y0, width, sums):
        """What is covered of some rows, pixel by pixel."""
        keep = np.flatnonzero(sums[1] != 0)
        return [pa.array([name] * len(keep), pa.string()), pa.array((y0 + keep // width).astype(np.int32)), pa.array((keep % width).astype(np.int32)), *[pa.array(v[keep]) for v in sums]]

    def add_bands(width):
        def run(batches):
            held: dict[tuple, tuple] = {}
            for batch in batches:
                for k in range(batch.num_rows):
                    key = batch.column("channel")[k].as_py(), batch.column("band")[k].as_py()
                    held[key] = grown(held.get(key), batch.column("data")[k].values.to_numpy(), batch.column("sky")[k].as_py(), batch.column("t")[k].as_py())
            for (name, band), sums in held.items():
                yield pa.RecordBatch.from_arrays(listed(name, band * BAND, width, sums), names=["channel", "y", "x", *STACK])

        return run

    pixels = "channel string, y int, x int, " + ", ".join(f"{c} double" for c in STACK)
    rows = rows.select("h", "w", "data", "sky", "transparency", "to_reference")
    if frames_per_task(seen) < least:
        size = seen.select("h", "w").first()
        if size is not None:
            planes_ = 2 if pattern else 1
            where = canvas or Canvas(size.h // planes_, size.w // planes_)
            parts = rows.mapInArrow(cut, "channel string, band int, sky double, t double, data array<double>")
            return in_bands(parts, -(-where.rows // BAND) * planes_**2).mapInArrow(add_bands(where.cols), pixels)
    columns = ", ".join(f"{c} array<double>" for c in STACK)
    parts = rows.mapInArrow(run, f"channel string, y int, {columns}")

    def add(key, table):
        sums = tuple(np.sum([table.column(c)[k].values.to_numpy() for k in range(table.num_rows)], axis=0) for c in STACK)
        return pa.Table.from_arrays(listed(key[0].as_py(), key[1].as_py(), len(sums[0]), sums), names=["channel", "y", "x", *STACK])

    return parts.groupBy("channel", "y").applyInArrow(add, pixels)


def is_colour(frames: DataFrame) -> str | None:
    """The pattern of a colour sensor's frames, or None; frames of different patterns don't go together."""
    if "bayer_pattern" not in frames.columns:
        return None
    found = [r[0] for r in frames.select("bayer_pattern").distinct().limit(3).collect()]
    if len(found) > 1:
        raise ValueError(f"frames differ in their colour pattern: {found}")
    return found[0] if found else None
