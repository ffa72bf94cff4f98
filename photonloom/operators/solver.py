"""Super-resolution by regularised maximum likelihood: forward model, losses with analytic gradients, Adam.

A channel's image is solved in one Arrow group; the distributed variant keeps
the image on the driver (its size is that of one frame) and lets the executors
predict and back-project the frames, batch by batch.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frame import finer_psf
from ..functions.kernels import gaussian_psf, pool, psf_spectrum, resample, unpool
from ..plans.staging import cut, shared_folder


@dataclass
class SolverConfig:
    scale: int = 2
    iterations: int = 300
    rate: float = 1e-2
    least_rate: float = 1e-4
    tv: float = 1e-2
    kl: float = 0.0
    wavelet: float = 0.0
    tv_eps: float = 1e-8
    tolerance: float = 1e-6
    patience: int = 20
    log_every: int = 10
    mode: str = "fast"
    batch: int = 8
    seed: int = 0
    #: Whether the frames were aligned before they were summed, so that the model needs no shift of its own.
    stats_aligned: bool = True

    def check(self) -> None:
        for test, text in ((self.scale >= 1, "scale is at least 1"), (self.iterations > 0, "iterations are above 0"), (self.rate > 0, "rate is above 0"), (min(self.tv, self.kl, self.wavelet) >= 0, "weights aren't below 0"), (self.mode in ("fast", "exact"), "mode is fast or exact"), (self.batch >= 1, "batch is at least 1")):
            if not test:
                raise ValueError(text)


@dataclass
class Solution:
    image: np.ndarray
    losses: list[float] = field(default_factory=list)
    gradients: list[float] = field(default_factory=list)
    iterations: int = 0
    converged: bool = False


def turned(rotation: float, ratio: float = 1.0) -> tuple[float, ...] | None:
    """The Jacobian (a, b, d, e) of a scene turned by rotation (degrees, x towards y) and enlarged by ratio: where a pixel of the result comes from; None for next to nothing."""
    if abs(rotation) <= 1e-4 and abs(ratio - 1) <= 1e-5:
        return None
    c, s = math.cos(math.radians(rotation)) / ratio, math.sin(math.radians(rotation)) / ratio
    return c, -s, s, c


class Turn:
    """The linear part of the forward model's affine map, about an image's middle, bilinearly with nothing beyond the edges; and its exact transpose."""

    def __init__(self, shape: tuple[int, int], jacobian: tuple[float, ...]):
        self.shape, self.jacobian = shape, jacobian

    def taps(self, band: int = 256):
        """(rows of the result, places in the scene, weights) of the four neighbours, in bands of rows."""
        (h, w), (a, b, d, e) = self.shape, self.jacobian
        cy, cx = (h - 1) / 2, (w - 1) / 2
        for top in range(0, h, band):
            y, x = np.mgrid[top : min(top + band, h), :w]
            sx, sy = a * (x - cx) + b * (y - cy) + cx, d * (x - cx) + e * (y - cy) + cy
            x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
            for j in (0, 1):
                for i in (0, 1):
                    yy, xx = y0 + j, x0 + i
                    inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
                    weight = np.where(inside, (1 - np.abs(sy - yy)) * (1 - np.abs(sx - xx)), 0.0)
                    yield slice(top, top + band), np.where(inside, yy * w + xx, 0), weight

    def __call__(self, image: np.ndarray) -> np.ndarray:
        out, flat = np.zeros(self.shape), image.ravel()
        for rows, at, weight in self.taps():
            out[rows] += weight * flat[at]
        return out

    def transpose(self, result: np.ndarray) -> np.ndarray:
        out = np.zeros(result.size)
        for rows, at, weight in self.taps():
            out += np.bincount(at.ravel(), (weight * result[rows]).ravel(), out.size)
        return out.reshape(self.shape)


def seen_from(to_reference: dict, rows: int, cols: int) -> list[Column]:
    """turn, dy and dx of the forward model, from the affine map (columns a..f) that takes a frame's (x, y) to the scene's: the frame is the scene turned about its middle, then moved."""
    cx, cy, m = (cols - 1) / 2, (rows - 1) / 2, to_reference
    x, y = m["a"] * cx + m["b"] * cy + m["c"] - cx, m["d"] * cx + m["e"] * cy + m["f"] - cy
    det = m["a"] * m["e"] - m["b"] * m["d"]
    dx, dy = -(m["e"] * x - m["b"] * y) / det, -(m["a"] * y - m["d"] * x) / det
    return [F.array(m["a"], m["b"], m["d"], m["e"]).alias("turn"), dy.alias("dy"), dx.alias("dx")]


class Forward:
    """t * pool(psf * shift(turn(image))) of one frame, and its transpose."""

    def __init__(self, shape: tuple[int, int], scale: int, psf: np.ndarray, t: float = 1.0, dy: float = 0.0, dx: float = 0.0, jacobian: tuple[float, ...] | None = None):
        self.shape, self.scale, self.t = shape, scale, t
        self.turn = Turn(shape, tuple(jacobian)) if jacobian is not None and np.abs(np.subtract(jacobian, (1, 0, 0, 1))).max() > 1e-6 else None
        self.wide = (2 * shape[0], 2 * shape[1])  # the image and its mirror image: periodic without an edge
        ramp = np.exp(-2j * np.pi * (np.fft.fftfreq(self.wide[0])[:, None] * dy * scale + np.fft.rfftfreq(self.wide[1])[None, :] * dx * scale))
        self.spectrum = psf_spectrum(psf, self.wide) * ramp  # the kernel and the shift together, once
        self.y, self.x = (np.concatenate([np.arange(n), np.arange(n)[::-1]]) for n in shape)

    def __call__(self, image: np.ndarray) -> np.ndarray:
        if self.turn:
            image = self.turn(image)
        out = np.fft.irfft2(np.fft.rfft2(image[np.ix_(self.y, self.x)]) * self.spectrum, s=self.wide)
        return self.t * pool(out[: self.shape[0], : self.shape[1]], self.scale)

    def transpose(self, residual: np.ndarray) -> np.ndarray:
        grid = np.zeros(self.wide)
        up = unpool(residual, self.scale)
        grid[: up.shape[0], : up.shape[1]] = self.t * up
        back = np.fft.irfft2(np.fft.rfft2(grid) * np.conj(self.spectrum), s=self.wide)
        h, w = self.shape
        back = back[:h] + back[h:][::-1]
        back = back[:, :w] + back[:, w:][:, ::-1]
        return self.turn.transpose(back) if self.turn else back


def poisson_nll(rate: np.ndarray, seen: np.ndarray, eps: float = 1e-12) -> tuple[float, np.ndarray]:
    r = np.maximum(rate, eps)
    return float((r - seen * np.log(r)).sum()), np.where(rate > eps, 1 - seen / r, 0.0)


def kl_divergence(image: np.ndarray, prior: np.ndarray, eps: float = 1e-12) -> tuple[float, np.ndarray]:
    a, b = np.maximum(image, eps), np.maximum(prior, eps)
    return float((a * np.log(a / b) - a + b).sum()), np.log(a / b)


def total_variation(image: np.ndarray, eps: float = 1e-8, diagonal: bool = True) -> tuple[float, np.ndarray]:
    """The sum of root squared differences to the right, down and (at half the weight) both diagonals, with its gradient."""
    a, b, c, d = image[:-1, :-1], image[:-1, 1:], image[1:, :-1], image[1:, 1:]
    parts = [(b - a, "b", "a", 1.0), (c - a, "c", "a", 1.0)]
    if diagonal:
        parts += [(d - a, "d", "a", 0.5), (b - c, "b", "c", 0.5)]
    root = np.sqrt(sum(w * v * v for v, _, _, w in parts) + eps)
    grad = np.zeros_like(image)
    view = {"a": grad[:-1, :-1], "b": grad[:-1, 1:], "c": grad[1:, :-1], "d": grad[1:, 1:]}
    for v, plus, minus, w in parts:
        g = w * v / root
        view[plus] += g
        view[minus] -= g
    return float(root.sum()), grad


def haar_l1(image: np.ndarray, levels: int = 1) -> tuple[float, np.ndarray]:
    """The absolute details of two by two blocks over levels of halving, with a subgradient."""
    h, w = image.shape[0] // 2 * 2, image.shape[1] // 2 * 2
    grad = np.zeros_like(image)
    if levels == 0 or h < 2 or w < 2:
        return 0.0, grad
    a, b, c, d = image[0:h:2, 0:w:2], image[0:h:2, 1:w:2], image[1:h:2, 0:w:2], image[1:h:2, 1:w:2]
    total = 0.0
    for sa, sb, sc, sd in ((1, -1, 1, -1), (1, 1, -1, -1), (1, -1, -1, 1)):
        v = (sa * a + sb * b + sc * c + sd * d) / 2
        total += float(np.abs(v).sum())
        s = np.sign(v) / 2
        grad[0:h:2, 0:w:2] += sa * s
        grad[0:h:2, 1:w:2] += sb * s
        grad[1:h:2, 0:w:2] += sc * s
        grad[1:h:2, 1:w:2] += sd * s
    rest, below = haar_l1((a + b + c + d) / 2, levels - 1)
    for y in (0, 1):
        for x in (0, 1):
            grad[y:h:2, x:w:2] += below / 2
    return total + rest, grad


def softplus(theta: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, theta)


def inverse_softplus(image: np.ndarray) -> np.ndarray:
    v = np.maximum(image, 1e-3)
    return v + np.log(-np.expm1(-v))


def regulariser(image: np.ndarray, prior: np.ndarray, cfg: SolverConfig) -> tuple[float, np.ndarray]:
    loss, grad = 0.0, np.zeros_like(image)
    for weight, f in ((cfg.tv, lambda: total_variation(image, cfg.tv_eps)), (cfg.kl, lambda: kl_divergence(image, prior)), (cfg.wavelet, lambda: haar_l1(image, 2))):
        if weight:
            v, g = f()
            loss, grad = loss + weight * v, grad + weight * g
    return loss, grad


def adam(start: np.ndarray, prior: np.ndarray, likelihood, cfg: SolverConfig) -> Solution:
    """Minimises likelihood(image, iteration) -> (loss, gradient) plus the regularisers over softplus(theta), at a rate that falls along a cosine."""
    theta, m, v = inverse_softplus(start), np.zeros_like(start), np.zeros_like(start)
    out = Solution(start)
    calm, before = 0, None
    for k in range(cfg.iterations):
        image = softplus(theta)
        loss, grad = likelihood(image, k)
        extra, more = regulariser(image, prior, cfg)
        loss, grad = loss + extra, (grad + more) * (1 - np.exp(-image))  # the slope of softplus
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        rate = cfg.least_rate + (cfg.rate - cfg.least_rate) * (1 + math.cos(math.pi * k / cfg.iterations)) / 2
        theta = theta - rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(v / (1 - 0.999 ** (k + 1))) + 1e-8)
        out.iterations = k + 1
        if k % cfg.log_every == 0 or k == cfg.iterations - 1:  # stopping looks at logged steps alone
            out.losses.append(loss)
            out.gradients.append(float(np.sqrt((grad * grad).mean())))
            if before is not None:
                calm = calm + 1 if abs(before - loss) <= cfg.tolerance * abs(before) else 0
                if calm >= cfg.patience:
                    out.converged = True
                    break
            before = loss
    out.image = softplus(theta)
    return out


def upsampled_prior(mean: np.ndarray, scale: int) -> np.ndarray:
    return np.maximum(resample(mean, mean.shape[0] * scale, mean.shape[1] * scale), 0)


def solve_sum(weighted_sum: np.ndarray, weighted_mean: np.ndarray, frames: list[dict], cfg: SolverConfig) -> Solution:
    """From the weighted sum of all frames: its prediction is the sum of t^2 times each frame's blurred image. frames: t, psf, dy, dx."""
    cfg.check()
    prior = upsampled_prior(weighted_mean, cfg.scale)
    moved = not cfg.stats_aligned
    models = [Forward(prior.shape, cfg.scale, f["psf"], f["t"] ** 2, moved * f.get("dy", 0.0), moved * f.get("dx", 0.0), f.get("turn") if moved else None) for f in frames]

    def likelihood(image, _):
        loss, g = poisson_nll(sum(m(image) for m in models), weighted_sum)
        return loss, sum(m.transpose(g) for m in models)

    return adam(np.maximum(prior, 1e-3), prior, likelihood, cfg)


def solve_frames(images: list[np.ndarray], weighted_mean: np.ndarray, frames: list[dict], cfg: SolverConfig) -> Solution:
    """From the calibrated frames themselves, in seeded batches without repetition; a batch stands for all frames."""
    cfg.check()
    prior = upsampled_prior(weighted_mean, cfg.scale)
    models = [Forward(prior.shape, cfg.scale, f["psf"], f["t"], f.get("dy", 0.0), f.get("dx", 0.0), f.get("turn")) for f in frames]
    if len({i.shape for i in images}) > 1:
        raise ValueError("frames differ in shape")
    rng = np.random.default_rng(cfg.seed)

    def likelihood(image, _):
        some = rng.permutation(len(images))[: cfg.batch]
        loss, grad = 0.0, np.zeros_like(image)
        for k in some:
            v, g = poisson_nll(models[k](image), images[k])
            loss, grad = loss + v, grad + models[k].transpose(g)
        share = len(images) / len(some)
        return loss * share, grad * share

    return adam(np.maximum(prior, 1e-3), prior, likelihood, cfg)


SOLVED = "channel string, h int, w int, image array<double>, losses array<double>, gradients array<double>, log_every int, iterations int, converged boolean"


def solved_row(channel: str, s: Solution, cfg: SolverConfig) -> pa.Table:
    h, w = s.image.shape
    cells = [channel, h, w, s.image.ravel(), s.losses, s.gradients, cfg.log_every, s.iterations, s.converged]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.bool_()]
    return pa.table([pa.array([c], k) for c, k in zip(cells, kinds)], names=[c.split()[0] for c in SOLVED.split(", ")])


def solved_channels(stack: DataFrame, frames: list[dict], height: int, width: int, cfg: SolverConfig) -> DataFrame:
    """stack(channel, y, x, weighted_sum, weighted_mean) solved channel by channel: a row of SOLVED for each, stored, as flux and history are both read off it."""
    cfg.check()

    def solve(key, table):
        a, b = np.zeros((height, width)), np.zeros((height, width))
        at = table.column("y").to_numpy(), table.column("x").to_numpy()
        a[at], b[at] = table.column("weighted_sum").to_numpy(), table.column("weighted_mean").to_numpy()
        return solved_row(key[0].as_py(), solve_sum(np.maximum(a, 0), np.maximum(b, 0), frames, cfg), cfg)

    return cut(stack.select("channel", "y", "x", "weighted_sum", "weighted_mean").groupBy("channel").applyInArrow(solve, SOLVED), "solved")


def flux_of(solved: DataFrame) -> DataFrame:
    """channel, y, x, flux, iterations, converged, loss of rows of SOLVED."""
    d = solved.select("channel", "w", "iterations", "converged", F.element_at("losses", -1).alias("loss"), F.posexplode("image").alias("at", "flux"))
    return d.select("channel", (F.col("at") / F.col("w")).cast("int").alias("y"), (F.col("at") % F.col("w")).alias("x"), "flux", "iterations", "converged", "loss")


def history_of(solved: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The logged steps of all channels, whatever mode solved them: channel, step, loss, gradient, change (relative, to the step logged before; null for the first), calm, whether that is within the tolerance, and log10_loss for a logarithmic axis: of losses that aren't all positive, what they are above the least and 1e-12."""
    log = F.posexplode(F.arrays_zip("losses", "gradients"))
    d = solved.select("channel", "log_every", "iterations", log.alias("k", "l"))
    d = d.select("channel", F.least(F.col("k") * F.col("log_every"), F.col("iterations") - 1).alias("step"), F.col("l.losses").alias("loss"), F.col("l.gradients").alias("gradient"))
    before = F.lag("loss").over(Window.partitionBy("channel").orderBy("step"))  # a few hundred short rows a channel
    change = F.abs(before - F.col("loss")) / F.abs(before)
    least = F.min("loss").over(Window.partitionBy("channel"))
    shift = F.when(least > 0, 0.0).otherwise(1e-12 - least)
    return d.withColumns({"change": change, "calm": change <= tolerance, "log10_loss": F.log10(F.col("loss") + shift)})


def solve_channels(stack: DataFrame, frames: list[dict], height: int, width: int, cfg: SolverConfig) -> DataFrame:
    """stack(channel, y, x, weighted_sum, weighted_mean) solved channel by channel: channel, y, x, flux, iterations, converged, loss."""
    return flux_of(solved_channels(stack, frames, height, width, cfg))


class Batches:
    """Frames dealt to batches for passes over them: each pass takes each frame once, in batches of about `batch` frames, whose order is drawn anew.

    The frames are written once, in a partition for each batch, so that a step
    reads the frames of its batch alone.
    """

    def __init__(self, frames: DataFrame, batch: int, seed: int):
        self.n_frames = frames.count()
        self.n = max(-(-self.n_frames // batch), 1)
        self.seed, self.frames = seed, frames
        if self.n > 1:
            dealt = frames.withColumn("part", F.pmod(F.xxhash64(F.col("frame_id").cast("string"), F.lit(seed)), F.lit(self.n)).cast("int"))
            path = f"{shared_folder(frames.sparkSession)}/batches-{uuid.uuid4().hex}"
            dealt.repartition("part").write.partitionBy("part").parquet(path)
            self.frames = frames.sparkSession.read.schema(dealt.schema).parquet(path)

    def order(self, epoch: int) -> list[int]:
        return np.random.default_rng((self.seed, epoch)).permutation(self.n).tolist()

    def at(self, step: int) -> DataFrame:
        """The batch of a step."""
        if self.n == 1:
            return self.frames
        epoch, k = divmod(step, self.n)
        return self.frames.where(F.col("part") == self.order(epoch)[k])


def gradient(frames: DataFrame, image: np.ndarray, psf: np.ndarray | None, cfg: SolverConfig, psf_size: int = 25, fan: int = 16) -> tuple[float, np.ndarray, int]:
    """Loss, gradient and number of frames(data, transparency, dy, dx, and turn, psf and fwhm where they have them) at an image.

    Tasks add up their frames and hand on one array each; where there are more
    than `fan` of them, a round of tasks adds those up before the driver does.
    A frame is blurred by its psf, or else by a Gaussian of its fwhm; others
    share the PSF given.
    """
    sent = frames.sparkSession.sparkContext.broadcast(image)  # one image
    columns = ["data", "transparency", "dy", "dx", *[c for c in ("turn", "fwhm", "psf") if c in frames.columns]]

    def work(batches):
        loss, n, grad = 0.0, 0, np.zeros(image.shape)
        for batch in batches:
            rest = batch.select(columns[1:]).to_pylist()
            for k, r in enumerate(rest):
                if r.get("psf") is not None:
                    own = finer_psf(np.reshape(r["psf"], (math.isqrt(len(r["psf"])), -1)), cfg.scale)
                else:
                    own = gaussian_psf(psf_size, r["fwhm"] * cfg.scale) if r.get("fwhm") is not None else psf
                f = Forward(image.shape, cfg.scale, own, r["transparency"], r["dy"], r["dx"], r.get("turn"))
                seen = batch.column("data")[k].values.to_numpy(zero_copy_only=False).astype(np.float64)
                v, g = poisson_nll(f(sent.value), seen.reshape(image.shape[0] // cfg.scale, -1))
                loss, n, grad = loss + v, n + 1, grad + f.transpose(g)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([grad.ravel()], pa.list_(pa.float64()))], names=["loss", "n", "grad"])

    def add(batches):
        loss, n, grad = 0.0, 0, None
        for batch in batches:
            for k in range(batch.num_rows):
                g = batch.column("grad")[k].values.to_numpy()
                loss, n, grad = loss + batch.column("loss")[k].as_py(), n + batch.column("n")[k].as_py(), g.copy() if grad is None else grad + g
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([grad], pa.list_(pa.float64()))], names=["loss", "n", "grad"])

    schema = "loss double, n long, grad array<double>"
    parts = frames.select(*columns).mapInArrow(work, schema)
    tasks = parts.rdd.getNumPartitions()
    if tasks > fan:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(add, schema)
    t = parts.toArrow()  # one image for each of the last tasks
    loss, n, grad = 0.0, 0, np.zeros(image.size)
    for k in range(t.num_rows):
        loss, n, grad = loss + t.column("loss")[k].as_py(), n + t.column("n")[k].as_py(), grad + t.column("grad")[k].values.to_numpy()
    sent.unpersist()
    return loss, grad.reshape(image.shape), n


def solve_distributed(frames: DataFrame, weighted_mean: np.ndarray, psf: np.ndarray | None, cfg: SolverConfig, psf_size: int = 25) -> Solution:
    """From frames(frame_id, data, transparency, dy, dx, turn, psf, fwhm; the last three where known) spread over the executors: a step's batch of frames stands for all.

    The image goes out, loss and gradient come back as sums over tasks: what
    travels is the size of one image, whatever the number of frames.
    """
    cfg.check()
    prior = upsampled_prior(weighted_mean, cfg.scale)
    batches = Batches(frames, cfg.batch, cfg.seed)

    def likelihood(image, step):
        loss, grad, n = gradient(batches.at(step), image, psf, cfg, psf_size)
        share = batches.n_frames / n if n else 0.0
        return loss * share, grad * share

    return adam(np.maximum(prior, 1e-3), prior, likelihood, cfg)


def solve(cfg: SolverConfig, stack: DataFrame, meta: list[dict], height: int, width: int, frames: DataFrame | None = None, psf_size: int = 25) -> DataFrame:
    """channel, y, x, flux by the configured mode; see solve_all."""
    return flux_of(solve_all(cfg, stack, meta, height, width, frames, psf_size)).select("channel", "y", "x", "flux")


def solve_all(cfg: SolverConfig, stack: DataFrame, meta: list[dict], height: int, width: int, frames: DataFrame | None = None, psf_size: int = 25) -> DataFrame:
    """Rows of SOLVED by the configured mode: fast, from the stack's sums, or exact, from frames(frame_id, channel, data, transparency, dy, dx) too.

    meta has t, psf, dy, dx by frame. In the exact mode each frame is blurred
    by its own psf or fwhm, where frames have such a column, else by the mean
    PSF of meta, and turned where they have the column turn; without frames it
    is an error.
    """
    cfg.check()
    if cfg.mode == "fast":
        return solved_channels(stack, meta, height, width, cfg)
    if frames is None:
        raise ValueError("the exact mode needs the frames")
    spark, out = stack.sparkSession, []
    psf = np.mean([m["psf"] for m in meta], axis=0) if meta else None
    for channel in sorted(r[0] for r in stack.select("channel").distinct().collect()):  # four at most
        mean = np.zeros((height, width))
        pdf = stack.where(F.col("channel") == channel).select("y", "x", "weighted_mean").toPandas()  # one image
        mean[pdf.y, pdf.x] = np.maximum(pdf.weighted_mean, 0)
        out.append(solved_row(channel, solve_distributed(frames.where(F.col("channel") == channel), mean, psf, cfg, psf_size), cfg))
    return cut(spark.createDataFrame(pa.concat_tables(out), SOLVED) if out else spark.createDataFrame([], SOLVED), "solved")


def run_from_stack(spark, folder: str, cfg: SolverConfig, height: int, width: int, psf_size: int = 25) -> DataFrame:
    """The fast solution of a stored stack, from its tables alone."""
    from ..functions.kernels import gaussian_psf
    from ..sources import store

    stack, meta = store.load_stack(spark, folder)
    rows = meta.select("transparency", "fwhm").collect()  # two numbers a frame
    each = [{"t": r.transparency, "psf": gaussian_psf(psf_size, (r.fwhm or 3.0) * cfg.scale)} for r in rows]
    return solve(SolverConfig(**{**cfg.__dict__, "mode": "fast"}), stack, each, height, width)
