"""Conjugate posteriors of the detector, by pixel, and how they carry over between sessions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import PIXEL

#: Band gap of silicon in eV, Boltzmann's constant in eV/K, 0 degrees Celsius in K (fixed values).
BAND_GAP, BOLTZMANN, ZERO_C = 1.12, 8.617333e-5, 273.15


@dataclass(frozen=True)
class Priors:
    """Weak prior knowledge of a sensor; the defaults are fixed values."""

    bias_mean: float = 300.0
    bias_std: float = 100.0
    read_noise: float = 6.0
    read_noise_concentration: float = 2.0
    dark_rate: float = 0.002
    dark_concentration: float = 2.0
    dark_temperature: float = -10.0
    flat_std: float = 1.0

    @staticmethod
    def for_gain_100() -> Priors:
        return Priors(bias_mean=280.0)

    def start(self) -> dict[str, tuple[float, float]]:
        """The two numbers of each posterior before any frame."""
        c, d = self.read_noise_concentration, self.dark_concentration
        tau = self.bias_std**2
        return {"bias": (1 / tau, self.bias_mean / tau), "read_noise": (c + 1, c * self.read_noise**2), "dark": (d + 1, (d + 1) / self.dark_rate), "flat": (1 / self.flat_std**2, 1 / self.flat_std**2)}


def bias_posterior(px: DataFrame, sigma: float | Column, priors: Priors = Priors(), by: Sequence[str] = PIXEL) -> DataFrame:
    """Normal posterior of the bias for known noise: precision, numerator, mean, std."""
    precision, numerator = priors.start()["bias"]
    s2 = F.pow(F.greatest(F.lit(sigma) if isinstance(sigma, float) else sigma, F.lit(1e-6)), F.lit(2.0))
    g = px.groupBy(*by).agg((F.lit(precision) + F.sum(1.0 / s2)).alias("precision"), (F.lit(numerator) + F.sum(F.col("adu") / s2)).alias("numerator"))
    return g.withColumns({"mean": F.col("numerator") / F.col("precision"), "std": 1.0 / F.sqrt("precision")})


def read_noise_moments(alpha: Column, beta: Column) -> dict[str, Column]:
    """Mean of the variance, its root and the deviation of an inverse-gamma posterior."""
    variance = beta / F.greatest(alpha - 1, F.lit(1e-9))
    return {"variance": variance, "read_noise": F.sqrt(variance), "variance_std": variance / F.sqrt(F.greatest(alpha - 2, F.lit(1e-9)))}


def read_noise_posterior(px: DataFrame, mean: str, priors: Priors = Priors(), by: Sequence[str] = PIXEL) -> DataFrame:
    """Inverse-gamma posterior of the noise about the known mean in a column."""
    a, b = priors.start()["read_noise"]
    g = px.groupBy(*by).agg((a + 0.5 * F.count("adu")).alias("alpha"), (b + 0.5 * F.sum(F.pow(F.col("adu") - F.col(mean), F.lit(2.0)))).alias("beta"))
    return g.withColumns(read_noise_moments(F.col("alpha"), F.col("beta")))


def dark_posterior(px: DataFrame, bias: str, priors: Priors = Priors(), by: Sequence[str] = PIXEL) -> DataFrame:
    """Gamma posterior of the dark rate: alpha, beta, rate, std."""
    a, b = priors.start()["dark"]
    g = px.groupBy(*by).agg((a + F.sum(F.greatest(F.col("adu") - F.col(bias), F.lit(0.0)))).alias("alpha"), (b + F.sum("exposure_s")).alias("beta"))
    return g.withColumns({"rate": F.col("alpha") / F.col("beta"), "std": F.sqrt("alpha") / F.col("beta")})


def flat_posterior(px: DataFrame, norm: str, signal: str, noise: str, priors: Priors = Priors(), by: Sequence[str] = PIXEL) -> DataFrame:
    """Normal posterior of the gain from normalised flats, each weighed by its signal and read noise."""
    precision, numerator = priors.start()["flat"]
    w = F.pow(signal, F.lit(2.0)) / (F.col(signal) + F.pow(noise, F.lit(2.0)))
    g = px.groupBy(*by).agg((precision + F.sum(w)).alias("precision"), (numerator + F.sum(F.col(norm) * w)).alias("numerator"))
    return g.withColumns({"gain": F.col("numerator") / F.col("precision"), "std": 1.0 / F.sqrt("precision")})


def ordered_fold(px: DataFrame, priors: Priors = Priors(), by: Sequence[str] = PIXEL, order: str = "seq") -> DataFrame:
    """bias_mean and read_noise when each frame, in order, updates the bias with the noise so far, then the noise with the new bias.

    The order counts, so a pixel's samples are gathered, ordered and folded in
    one expression; a pixel holds one short struct per frame of a session.
    """
    p0, n0 = priors.start()["bias"]
    a0, b0 = priors.start()["read_noise"]
    start = F.struct(F.lit(p0).alias("p"), F.lit(n0).alias("n"), F.lit(float(a0)).alias("a"), F.lit(float(b0)).alias("b"))

    def step(s, v):
        noise = F.greatest(F.sqrt(s.b / F.greatest(s.a - 1, F.lit(1e-9))), F.lit(1e-6))
        p = s.p + 1.0 / (noise * noise)
        n = s.n + v.adu / (noise * noise)
        d = v.adu - n / p
        return F.struct(p.alias("p"), n.alias("n"), (s.a + 0.5).alias("a"), (s.b + 0.5 * d * d).alias("b"))

    end = lambda s: F.struct((s.n / s.p).alias("bias_mean"), F.sqrt(s.b / F.greatest(s.a - 1, F.lit(1e-9))).alias("read_noise"))
    samples = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("adu").cast("double").alias("adu"))))
    return px.groupBy(*by).agg(samples.alias("s")).select(*by, F.aggregate("s", start, step, end).alias("r")).select(*by, "r.*")


def arrhenius(rate: Column, from_c: Column, to_c: Column) -> Column:
    """A dark rate at another temperature."""
    return rate * F.exp(-BAND_GAP / (2 * BOLTZMANN) * (1.0 / (to_c + ZERO_C) - 1.0 / (from_c + ZERO_C)))


def temperature_corrected(posterior: DataFrame, to_c: Column) -> DataFrame:
    """A dark posterior (alpha, beta, ref_temp_c) at another temperature; differences below 0.1 degrees change nothing."""
    near = F.abs(to_c - F.col("ref_temp_c")) < 0.1
    alpha = F.when(near, F.col("alpha")).otherwise(arrhenius(F.col("alpha"), F.col("ref_temp_c"), to_c))
    return posterior.withColumns({"alpha": alpha, "ref_temp_c": F.when(near, F.col("ref_temp_c")).otherwise(to_c)})


def carry_over(posteriors: DataFrame, to_c: float | None = None) -> DataFrame:
    """Posteriors (param, p1, p2, n, ref_temp_c) as the next session's start: no frames yet, the gain's mean 1 with its precision kept, dark rates at the new temperature."""
    p1 = F.col("p1")
    if to_c is not None:
        moved = F.abs(F.lit(to_c) - F.col("ref_temp_c")) >= 0.1
        p1 = F.when((F.col("param") == "dark") & moved, arrhenius(p1, F.col("ref_temp_c"), F.lit(to_c))).otherwise(p1)
    p2 = F.when(F.col("param") == "flat", F.col("p1")).otherwise(F.col("p2"))
    return posteriors.withColumns({"p1": p1, "p2": p2, "n": F.lit(0).cast("long")})


def initial_state(pixels: DataFrame, priors: Priors = Priors(), by: Sequence[str] = PIXEL) -> DataFrame:
    """The priors for every pixel key: param, p1, p2, n, ref_temp_c; four rows a key, without a join."""
    rows = F.array(*[F.struct(F.lit(k).alias("param"), F.lit(float(a)).alias("p1"), F.lit(float(b)).alias("p2")) for k, (a, b) in priors.start().items()])
    return pixels.select(*by).distinct().select(*by, F.explode(rows).alias("r")).select(*by, "r.*", F.lit(0).cast("long").alias("n"), F.lit(priors.dark_temperature).alias("ref_temp_c"))


def point_estimates(state: DataFrame) -> DataFrame:
    """state with estimate: the mean of each posterior (of read noise the root of the mean variance)."""
    p1, p2 = F.col("p1"), F.col("p2")
    e = F.when(F.col("param").isin("bias", "flat"), p2 / p1).when(F.col("param") == "dark", p1 / p2).otherwise(F.sqrt(p2 / F.greatest(p1 - 1, F.lit(1e-9))))
    return state.withColumn("estimate", e)


def projected(moments: DataFrame) -> DataFrame:
    """State rows (param, p1, p2) from means and deviations (param, mean, std), as models without posteriors have them: those of the posterior with these moments.

    The mean of read_noise is that of its variance. A deviation that is null or
    not above 0 tells nothing, and its row is left out.
    """
    m, s = F.col("mean"), F.col("std")
    ratio = F.pow(m / s, F.lit(2.0))
    normal, gamma, inverse = (1 / (s * s), m / (s * s)), (ratio, m / (s * s)), (2 + ratio, m * (1 + ratio))
    pick = lambda k: F.when(F.col("param").isin("bias", "flat"), normal[k]).when(F.col("param") == "dark", gamma[k]).when(F.col("param") == "read_noise", inverse[k])
    return moments.where(s > 0).withColumns({"p1": pick(0), "p2": pick(1)}).drop("mean", "std")


#: What frames add to a pixel's posteriors: numbers that sum over frames, whatever their order and grouping.
SUMS = ("n_bias", "bias_sum", "bias_sq", "n_dark", "dark_counts", "dark_seconds")


def frame_sums(px: DataFrame, pedestal: float = 300.0, by: Sequence[str] = PIXEL) -> DataFrame:
    """SUMS by pixel from bias and dark frames; values are taken above the pedestal, the bias that darks are known to have."""
    bias, dark, v = F.col("frame_type") == "bias", F.col("frame_type") == "dark", F.col("adu") - pedestal
    of = lambda kind, x: F.coalesce(F.sum(F.when(kind, x)), F.lit(0.0))
    return px.where(bias | dark).groupBy(*by).agg(
        F.count(F.when(bias, F.col("adu"))).alias("n_bias"), of(bias, v).alias("bias_sum"), of(bias, v * v).alias("bias_sq"),
        F.count(F.when(dark, F.col("adu"))).alias("n_dark"), of(dark, F.greatest(v, F.lit(0.0))).alias("dark_counts"), of(dark & F.col("adu").isNotNull(), F.col("exposure_s")).alias("dark_seconds"),
    )


def add_sums(parts: DataFrame, by: Sequence[str] = PIXEL) -> DataFrame:
    """The sums of several sets of frames."""
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def state_of_sums(sums: DataFrame, sigma: float = 6.0, pedestal: float = 300.0, priors: Priors = Priors(), by: Sequence[str] = PIXEL) -> DataFrame:
    """Posteriors (param, p1, p2, n, estimate) of bias, read noise and dark rate; parameters without a frame are left out.

    The bias is that of a known noise sigma, the read noise that about the bias's
    mean, the dark rate that of counts above the pedestal.
    """
    start = priors.start()
    precision = start["bias"][0] + F.col("n_bias") / sigma**2
    numerator = start["bias"][1] + (F.col("bias_sum") + F.col("n_bias") * pedestal) / sigma**2
    m = numerator / precision - pedestal
    spread = F.greatest(F.col("bias_sq") - 2 * m * F.col("bias_sum") + F.col("n_bias") * m * m, F.lit(0.0))
    row = lambda name, a, b, n: F.struct(F.lit(name).alias("param"), a.alias("p1"), b.alias("p2"), F.col(n).alias("n"))
    rows = F.array(
        row("bias", precision, numerator, "n_bias"),
        row("read_noise", start["read_noise"][0] + 0.5 * F.col("n_bias"), start["read_noise"][1] + 0.5 * spread, "n_bias"),
        row("dark", start["dark"][0] + F.col("dark_counts"), start["dark"][1] + F.col("dark_seconds"), "n_dark"),
    )
    return point_estimates(sums.select(*by, F.explode(rows).alias("r")).select(*by, "r.*").where("n > 0"))
