"""The instrument's posteriors in the run: carried from session to session, updated by a session's frames as arrays, and its maps read off them.

The bias and the read noise inform each other frame by frame, so a pixel's
frames are gone through in order. Frames are cut into bands of sensor rows; a
band of all frames is one group, whose size is bounded by making bands of more
frames narrower. Dark rates and gains are sums, added up in the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bayes import Priors
from . import framewise

PARAMS = ("bias", "read_noise", "dark", "flat")
#: Two numbers by parameter (as bayes.Priors.start has them), each a map of the sensor, and the frames seen.
State = dict[str, tuple[np.ndarray, np.ndarray, int]]


def start(h: int, w: int, priors: Priors = Priors()) -> State:
    """The priors for each pixel."""
    return {k: (np.full((h, w), float(a)), np.full((h, w), float(b)), 0) for k, (a, b) in priors.start().items()}


def ordered_bias(frames: DataFrame, state: State, h: int, w: int, group_bytes: int = 1 << 27) -> State:
    """bias and read_noise after the frames in order of seq: each updates the bias with the noise so far, then the noise about the new bias."""
    n = frames.count()
    if not n:
        return {}
    rows = max(1, min(h, group_bytes // (8 * w * n)))
    sent = frames.sparkSession.sparkContext.broadcast({k: state[k][:2] for k in ("bias", "read_noise")})  # of the sensor's size

    def cut(batches):
        for image, row in framewise.images(batches, "seq"):
            tops = range(0, h, rows)
            yield pa.RecordBatch.from_arrays([pa.array([y // rows for y in tops], pa.int32()), pa.array([row["seq"]] * len(tops), pa.int64()), pa.array([image[y : y + rows].ravel() for y in tops], pa.list_(pa.float64()))], names=["band", "seq", "data"])

    def fold(key, table):
        at = slice(key[0].as_py() * rows, (key[0].as_py() + 1) * rows)
        (p, q), (a, b) = ([x[at].ravel().copy() for x in sent.value[k]] for k in ("bias", "read_noise"))
        noise = lambda: np.maximum(np.sqrt(b / np.maximum(a - 1, 1e-9)), 1e-6)
        for k in np.argsort(table.column("seq").to_numpy(), kind="stable"):
            v = table.column("data")[int(k)].values.to_numpy()
            s2 = noise() ** 2
            p, q = p + 1 / s2, q + v / s2
            a, b = a + 0.5, b + 0.5 * (v - q / p) ** 2
        return pa.table({"band": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([x], pa.list_(pa.float64())) for c, x in zip("pqab", (p, q, a, b))}})

    bands = frames.select("seq", "h", "w", "data").mapInArrow(cut, "band int, seq long, data array<double>")
    t = bands.groupBy("band").applyInArrow(fold, "band int, p array<double>, q array<double>, a array<double>, b array<double>").toArrow()  # of the sensor's size
    order = np.argsort(t.column("band").to_numpy())
    p, q, a, b = (np.concatenate([t.column(c)[int(k)].values.to_numpy() for k in order]).reshape(h, w) for c in "pqab")
    return {"bias": (p, q, state["bias"][2] + n), "read_noise": (a, b, state["read_noise"][2] + n)}


def updated(frames: DataFrame, state: State) -> State:
    """The posteriors after a session's bias, dark and flat frames (frame_type), whatever of them there is."""
    h, w = state["bias"][0].shape
    of = lambda kind: frames.where(F.col("frame_type") == kind)
    out = {**state, **ordered_bias(of("bias"), state, h, w)}
    maps = maps_of(out)
    sent = frames.sparkSession.sparkContext.broadcast(maps)
    dark = framewise.moments(of("dark"), lambda v, _: np.maximum(v - sent.value["bias_mean"], 0.0))
    if dark:
        n = dark["n"]
        out["dark"] = (out["dark"][0] + n * dark["mv"], out["dark"][1] + n * dark["mt"], out["dark"][2] + int(n.max()))
        sent = frames.sparkSession.sparkContext.broadcast(maps_of(out))

    def weighed(power: int):
        def work(v, row):
            m = sent.value
            net = v - m["bias_mean"] - m["dark_rate"] * row["exposure_s"]
            level = np.median(net)
            if level <= 0:
                return None
            weight = level**2 / (level + m["read_noise"] ** 2)
            return weight * (net / level) ** power

        return work

    flat, product = framewise.moments(of("flat"), weighed(0)), framewise.moments(of("flat"), weighed(1))
    if flat:
        n = flat["n"]
        out["flat"] = (out["flat"][0] + n * flat["mv"], out["flat"][1] + n * product["mv"], out["flat"][2] + int(n.max()))
    return out


def maps_of(state: State, sigma: float = 5.0) -> dict[str, np.ndarray]:
    """The instrument's maps: the means of the posteriors. Hot pixels need dark frames, as a prior has none."""
    (p, q, _), (a, b, _), (c, d, seen), (f, g, flats) = (state[k] for k in PARAMS)
    rate = c / d
    maps = {"bias_mean": q / p, "read_noise": np.sqrt(b / np.maximum(a - 1, 1e-9)), "dark_rate": rate}
    if seen:
        middle = np.median(rate)
        maps["hot_pixel"] = rate > middle + sigma * framewise.kernel.MAD * np.median(np.abs(rate - middle))
    gain = g / f
    maps["flat_gain"] = gain / (np.median(gain) or 1.0)
    if flats:
        maps["flat_uncertainty"] = 1 / np.sqrt(f)
    return maps


def table(spark: SparkSession, state: State, temperature: float) -> DataFrame:
    """The state as rows: channel, y, x, param, p1, p2, n, ref_temp_c."""
    sent = spark.sparkContext.broadcast(state)
    h, w = state["bias"][0].shape

    def run(batches):
        for batch in batches:
            for y in batch.column(0).to_pylist():
                for k, (a, b, n) in sent.value.items():
                    yield pa.RecordBatch.from_arrays([pa.array(["L"] * w), pa.array([y] * w, pa.int32()), pa.array(range(w), pa.int32()), pa.array([k] * w), pa.array(a[y]), pa.array(b[y]), pa.array([n] * w, pa.int64()), pa.array([temperature] * w)], names=["channel", "y", "x", "param", "p1", "p2", "n", "ref_temp_c"])

    return spark.range(h).mapInArrow(run, "channel string, y int, x int, param string, p1 double, p2 double, n long, ref_temp_c double")


def state_of(rows: DataFrame, h: int, w: int, priors: Priors = Priors()) -> State:
    """The state of stored rows; parameters or pixels that they don't have are as the priors."""
    out = start(h, w, priors)
    t = rows.select("y", "x", "param", "p1", "p2", "n").toArrow()  # four numbers a pixel of the sensor
    y, x, name = t.column("y").to_numpy(), t.column("x").to_numpy(), np.array(t.column("param").to_pylist())
    for k in PARAMS:
        at = name == k
        if at.any():
            for m, c in zip(out[k][:2], ("p1", "p2")):
                m[y[at], x[at]] = t.column(c).to_numpy()[at]
            out[k] = (*out[k][:2], int(t.column("n").to_numpy()[at].max()))
    return out
