"""A mixture of three gamma laws over dark rates: normal, hot and cold pixels, by EM with one aggregation a round."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-6
NAMES = ("normal", "hot", "cold")
#: Starting shapes, shares and multiples of the typical rate (fixed values).
START = {"shape": (5.0, 2.0, 2.0), "share": (0.995, 0.004, 0.001), "rate": (1.0, 10.0, 0.1)}


@dataclass(frozen=True)
class Mixture:
    share: tuple[float, ...]
    alpha: tuple[float, ...]
    beta: tuple[float, ...]
    history: tuple[float, ...] = ()
    converged: bool = False

    def means(self) -> list[float]:
        return [a / b for a, b in zip(self.alpha, self.beta)]


def trigamma(x: float) -> float:
    total = 0.0
    while x < 6:
        total += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return total + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def digamma(x: float) -> float:
    total = 0.0
    while x < 6:
        total -= 1 / x
        x += 1
    y = 1 / (x * x)
    return total + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def gamma_shape(s: float, rounds: int = 20) -> float:
    """The likeliest shape for s = ln(mean) - mean(ln), by Newton from the usual closed approximation."""
    s = max(s, 1e-8)
    a = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(rounds):
        step = (math.log(a) - digamma(a) - s) / (1 / a - trigamma(a))
        a = max(a - step, FLOOR)
        if abs(step) < 1e-10 * a:
            break
    return max(a, FLOOR)


def log_terms(x: Column, m: Mixture) -> list[Column]:
    """ln(share * density) of each component."""
    return [F.lit(math.log(p) + a * math.log(b) - math.lgamma(a)) + (a - 1) * F.log(x) - b * x for p, a, b in zip(m.share, m.alpha, m.beta)]


def with_probabilities(rates: DataFrame, m: Mixture, value: str = "rate") -> DataFrame:
    """rates with p (a share for each component) and loglik, both through the greatest term."""
    x = F.greatest(F.col(value), F.lit(FLOOR))
    d = rates.withColumn("__t", F.array(*log_terms(x, m))).withColumn("__top", F.array_max("__t"))
    d = d.withColumn("__e", F.transform("__t", lambda t: F.exp(t - F.col("__top")))).withColumn("__s", F.aggregate("__e", F.lit(0.0), lambda a, b: a + b))
    return d.withColumns({"p": F.transform("__e", lambda e: e / F.col("__s")), "loglik": F.col("__top") + F.log("__s")}).drop("__t", "__top", "__e", "__s")


def moments(rates: DataFrame, m: Mixture, weight: str, value: str = "rate"):
    """One row: the sums that a round needs."""
    d = with_probabilities(rates, m, value)
    x, w = F.greatest(F.col(value), F.lit(FLOOR)), F.col(weight)
    r = [F.get("p", F.lit(k)) * w for k in range(3)]
    return d.agg(*[F.sum(v).alias(f"n{k}") for k, v in enumerate(r)], *[F.sum(v * x).alias(f"x{k}") for k, v in enumerate(r)], *[F.sum(v * F.log(x)).alias(f"l{k}") for k, v in enumerate(r)], F.sum(F.col("loglik") * w).alias("ll"))


def fit_mixture(rates: DataFrame, value: str = "rate", rounds: int = 100, tol: float = 1e-4, least_share: float = 1e-4) -> Mixture:
    """EM over all rates; equal rates count once with their number, so the table shrinks before the rounds begin."""
    x = F.greatest(F.col(value), F.lit(FLOOR))
    table = rates.select(x.alias("rate")).groupBy("rate").agg(F.count("*").alias("n")).cache()
    try:
        q = rates.agg(F.percentile(value, [0.1, 0.9])).first()[0]
        if q is None:
            raise ValueError("no rates to fit")
        typical = max(rates.where(F.col(value).between(q[0], q[1])).agg(F.avg(value)).first()[0], FLOOR)
        m = Mixture(START["share"], START["shape"], tuple(a / (typical * k) for a, k in zip(START["shape"], START["rate"])))
        history: list[float] = []
        converged = False
        for _ in range(rounds):
            s = moments(table, m, "n").first()
            history.append(s["ll"])
            total = s["n0"] + s["n1"] + s["n2"]
            share = [max(s[f"n{k}"] / total, least_share) for k in range(3)]
            alpha, beta = [], []
            for k in range(3):
                n = s[f"n{k}"]
                if n < 1e-10:
                    alpha.append(m.alpha[k]), beta.append(m.beta[k])
                    continue
                mean = s[f"x{k}"] / n
                a = gamma_shape(math.log(mean) - s[f"l{k}"] / n)
                alpha.append(a), beta.append(a / mean)
            m = Mixture(tuple(p / sum(share) for p in share), tuple(alpha), tuple(beta))
            if len(history) > 1 and abs(history[-1] - history[-2]) <= tol * abs(history[-2]):
                converged = True
                break
    finally:
        table.unpersist()
    cold, normal, hot = sorted(range(3), key=lambda k: m.alpha[k] / m.beta[k])
    pick = lambda v: tuple(v[k] for k in (normal, hot, cold))
    return Mixture(pick(m.share), pick(m.alpha), pick(m.beta), tuple(history), converged)


def labels(rates: DataFrame, m: Mixture, value: str = "rate") -> DataFrame:
    """rates with p_normal, p_hot, p_cold and label (0, 1, 2: the likeliest, the first of equal ones)."""
    d = with_probabilities(rates, m, value)
    d = d.withColumns({f"p_{n}": F.get("p", F.lit(k)) for k, n in enumerate(NAMES)})
    return d.withColumn("label", (F.array_position("p", F.array_max("p")) - 1).cast("int")).drop("p", "loglik")


def label_counts(labelled: DataFrame) -> DataFrame:
    """One row: n_normal, n_hot, n_cold."""
    return labelled.agg(*[F.count_if(F.col("label") == k).alias(f"n_{n}") for k, n in enumerate(NAMES)])
