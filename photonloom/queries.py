"""The library's queries over the driver's tables, each with the same query in DuckDB's SQL where SQL can express it.

Floating results are rounded on both sides, as sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import display, kernels
from .operators import bayes, calibration, geometry, images, mixture, neighbourhood, solver, stacking, stars, synth, validation
from .plans import adapters, ground_truth
from .plans.adapters import SQL
from .plans.staging import cut
from .sources import fits, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a query under its function's name; views are those of the adapters that its SQL reads."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            with_ = "WITH " + ", ".join([SQL[v] for v in views]) + (", " if sql.lstrip().startswith(",") else " ") if views else ""
            ORACLE[f.__name__] = with_ + sql.lstrip().removeprefix(",")
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(c: str | Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def millionths(c: str) -> Column:
    """round(c, 6) of numbers from 0 to 1 as DuckDB has it, by a product; F.round writes each number out in decimals first, which took two thirds of the time for triangles."""
    return (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)


def px_of(spark, sf_dir, kind=None) -> DataFrame:
    p = adapters.pixels(spark, sf_dir)
    return p if kind is None else p.where(F.col("frame_type") == kind)


def lights(spark, sf_dir) -> DataFrame:
    return px_of(spark, sf_dir, "light").withColumn("calibrated", F.col("adu"))


BIAS = "bias AS (SELECT y, x, avg(adu) AS bias_mean, stddev_samp(adu) AS read_noise FROM px WHERE frame_type = 'bias' GROUP BY y, x)"
MODEL_FLAT = """flatnet AS (SELECT frame_id, y, x, adu - bias_mean AS net FROM px JOIN bias USING (y, x) WHERE frame_type = 'flat'),
fscale AS (SELECT frame_id, median(net) AS scale FROM flatnet GROUP BY frame_id HAVING median(net) > 0),
fg AS (SELECT y, x, avg(net / scale) AS gain, stddev_samp(net / scale) AS std, avg(net) AS raw, count(*) AS n FROM flatnet JOIN fscale USING (frame_id) GROUP BY y, x),
flat AS (SELECT y, x, gain / CASE WHEN m <> 0 THEN m ELSE 1 END AS flat_gain, CASE WHEN raw > 0 THEN sqrt(greatest(std * std - 1 / (greatest(raw, 1) * n), 0)) ELSE 0 END AS flat_uncertainty FROM fg, (SELECT median(gain) AS m FROM fg))"""
DARK = """dnet AS (SELECT y, x, t, adu - bias_mean AS net FROM px JOIN bias USING (y, x) WHERE frame_type = 'dark'),
dark AS (SELECT y, x, greatest(CASE WHEN count(DISTINCT t) > 1 THEN regr_slope(net, t) ELSE avg(net) / avg(t) END, 0) AS dark_rate FROM dnet GROUP BY y, x)"""
CAL = f"{BIAS}, {DARK}, {MODEL_FLAT.replace('adu - bias_mean AS net FROM px JOIN bias USING (y, x)', 'adu - bias_mean - dark_rate * t AS net FROM px JOIN bias USING (y, x) JOIN dark USING (y, x)')}, cal AS (SELECT px.*, (adu - bias_mean - dark_rate * t) / CASE WHEN flat_gain > 0.01 THEN flat_gain ELSE 1 END AS calibrated FROM px JOIN bias USING (y, x) JOIN dark USING (y, x) JOIN flat USING (y, x) WHERE frame_type = 'light')"
STACK = "stack AS (SELECT y, x, sum(transparency * (calibrated - 0.0)) AS ws, sum(transparency) AS w, sum(0.0) AS sk, sum(transparency * calibrated * calibrated) AS sq, count(*) AS n FROM cal JOIN meta USING (frame_id) GROUP BY y, x)"


def model_of(spark, sf_dir) -> DataFrame:
    p = adapters.pixels(spark, sf_dir)
    return cut(calibration.fit_all(p, keep=cut), "model")


def calibrated_lights(spark, sf_dir) -> DataFrame:
    return calibration.calibrate(px_of(spark, sf_dir, "light"), model_of(spark, sf_dir))


def stack_of(spark, sf_dir) -> DataFrame:
    meta = adapters.frame_meta(spark, sf_dir).withColumn("sky", F.lit(0.0))
    return stacking.accumulate(calibrated_lights(spark, sf_dir), meta)


# calibration -----------------------------------------------------------------


@query(f", {CAL}, {STACK} SELECT y, x, round(ws / w, 6) AS weighted_mean, round(greatest(sq / w - (ws / w) * (ws / w), 0), 4) AS variance, round(w / max(w) OVER (), 6) AS quality FROM stack", "px", "meta")
def fast_stack(spark, sf_dir):
    s = stacking.derive(stack_of(spark, sf_dir), 1)
    return s.select("y", "x", r("weighted_mean", "weighted_mean"), r("variance", "variance", 4), r("quality", "quality"))


@query("SELECT y, x, round(avg(adu), 6) AS mean, round(stddev_samp(adu), 6) AS std, count(adu) AS n FROM px WHERE frame_type = 'bias' GROUP BY y, x", "px")
def bias_welford(spark, sf_dir):
    return rounded(calibration.mean_and_deviation(px_of(spark, sf_dir, "bias")).drop("channel"))


@query("SELECT pixel, round(coalesce(regr_slope(adu, t), 0), 4) AS slope, round(coalesce(regr_intercept(adu, t), avg(adu)), 3) AS intercept, round(sqrt(greatest(regr_syy(adu, t) - coalesce(regr_slope(adu, t), 0) * regr_sxy(adu, t), 0) / greatest(count(adu) - CASE WHEN regr_sxx(adu, t) < 1e-12 THEN 1 ELSE 2 END, 1)), 3) AS residual_std, count(adu) AS n FROM smp GROUP BY pixel", "smp")
def dark_regression(spark, sf_dir):
    d = calibration.linear_regression(adapters.samples(spark, sf_dir), ["pixel"])
    return d.select("pixel", r("slope", "slope", 4), r("intercept", "intercept", 3), r("residual_std", "residual_std", 3), "n")


@query("SELECT pixel, 0.0::DOUBLE AS slope, round(avg(adu), 4) AS intercept, round(coalesce(stddev_samp(adu), 0), 4) AS residual_std FROM smp WHERE t = 10 GROUP BY pixel", "smp")
def dark_regression_degenerate(spark, sf_dir):
    d = calibration.linear_regression(adapters.samples(spark, sf_dir).where("exposure_s = 10"), ["pixel"])
    return d.select("pixel", r("slope", "slope"), r("intercept", "intercept", 4), r("residual_std", "residual_std", 4))


@query(", rate AS (SELECT pixel, avg(adu / t) AS rate FROM smp GROUP BY pixel), m AS (SELECT median(rate) AS m FROM rate), d AS (SELECT median(abs(rate - m)) AS d FROM rate, m) SELECT pixel, round(rate, 4) AS rate, rate > m + 5 * 1.4826 * d AS hot_pixel FROM rate, m, d", "smp")
def hot_pixel_mask(spark, sf_dir):
    rate = adapters.samples(spark, sf_dir).groupBy("pixel").agg(F.avg(F.col("adu") / F.col("exposure_s")).alias("rate"))
    return calibration.hot_pixels(rate, "rate").select("pixel", r("rate", "rate", 4), "hot_pixel")


@query(f", {BIAS}, {DARK} SELECT y, x, round(dark_rate, 8) AS dark_rate FROM dark", "px")
def dark_rate_map(spark, sf_dir):
    p = adapters.pixels(spark, sf_dir)
    d = calibration.fit_dark(p.where("frame_type = 'dark'"), calibration.fit_bias(p.where("frame_type = 'bias'")))
    return d.select("y", "x", r("dark_rate", "dark_rate", 8))


@query(f", {BIAS}, {MODEL_FLAT} SELECT y, x, round(flat_gain, 6) AS flat_gain, round(flat_uncertainty, 5) AS flat_uncertainty FROM flat", "px")
def flat_gain(spark, sf_dir):
    p = adapters.pixels(spark, sf_dir)
    d = calibration.fit_flat(p.where("frame_type = 'flat'"), calibration.fit_bias(p.where("frame_type = 'bias'")))
    return d.select("y", "x", r("flat_gain", "flat_gain"), r("flat_uncertainty", "flat_uncertainty", 5))


@query(f", {BIAS} SELECT y, x, round(avg(adu - bias_mean), 6) AS amp_glow FROM px JOIN bias USING (y, x) WHERE frame_type = 'dark' GROUP BY y, x", "px")
def amp_glow(spark, sf_dir):
    p = adapters.pixels(spark, sf_dir)
    return calibration.fit_dark_flat(p.where("frame_type = 'dark'"), calibration.fit_bias(p.where("frame_type = 'bias'"))).select("y", "x", r("amp_glow", "amp_glow"))


@query(f", {CAL} SELECT frame_id, y, x, round(calibrated, 5) AS calibrated FROM cal", "px")
def calibrate_frame(spark, sf_dir):
    return calibrated_lights(spark, sf_dir).select("frame_id", "y", "x", r("calibrated", "calibrated", 5))


@query(f", {BIAS}, {MODEL_FLAT} SELECT p.frame_id, p.y, p.x, round((p.adu - b.bias_mean) / CASE WHEN f.flat_gain > 0.01 THEN f.flat_gain ELSE 1 END, 5) AS calibrated FROM px p JOIN meta m USING (frame_id) JOIN bias b ON b.y = p.y AND b.x = p.x JOIN flat f ON f.y = CASE WHEN abs(m.rotation) > 90 THEN 7 - p.y ELSE p.y END AND f.x = CASE WHEN abs(m.rotation) > 90 THEN 7 - p.x ELSE p.x END WHERE p.frame_type = 'light'", "px", "meta")
def meridian_flip_flat(spark, sf_dir):
    p = adapters.pixels(spark, sf_dir)
    bias = calibration.fit_bias(p.where("frame_type = 'bias'"))
    model = bias.join(calibration.fit_flat(p.where("frame_type = 'flat'"), bias), ["channel", "y", "x"])
    d = p.where("frame_type = 'light'").join(adapters.frame_meta(spark, sf_dir).select("frame_id", "rotation"), "frame_id")
    return calibration.calibrate(d, model, rotation="rotation", height=8, width=8).select("frame_id", "y", "x", r("calibrated", "calibrated", 5))


@query("SELECT frame_id, CASE (y % 2) * 2 + x % 2 WHEN 0 THEN 'R' WHEN 1 THEN 'G0' WHEN 2 THEN 'G1' ELSE 'B' END AS channel, y // 2 AS y, x // 2 AS x, round(adu, 6) AS adu FROM px", "px")
def bayer_split(spark, sf_dir):
    return calibration.bayer_split(px_of(spark, sf_dir)).select("frame_id", "channel", "y", "x", r("adu", "adu"))


BAYER = "bay AS (SELECT frame_id, CASE (y % 2) * 2 + x % 2 WHEN 0 THEN 'R' WHEN 1 THEN 'G0' WHEN 2 THEN 'G1' ELSE 'B' END AS channel, y // 2 AS y, x // 2 AS x, adu FROM px)"


@query(f", {BAYER} SELECT frame_id, channel, round(median(adu), 6) AS median FROM bay GROUP BY frame_id, channel", "px")
def bayer_medians(spark, sf_dir):
    return rounded(calibration.channel_medians(calibration.bayer_split(px_of(spark, sf_dir))))


@query(f", {BAYER} SELECT frame_id, channel, y, x, round(CASE WHEN m > 0 THEN adu / m ELSE adu END, 6) AS norm FROM bay JOIN (SELECT frame_id, channel, median(adu) AS m FROM bay GROUP BY frame_id, channel) USING (frame_id, channel)", "px")
def bayer_normalise(spark, sf_dir):
    return calibration.normalise_channels(calibration.bayer_split(px_of(spark, sf_dir))).select("frame_id", "channel", "y", "x", r("norm", "norm"))


@query(f", {BAYER} SELECT frame_id, y, x, round(avg(adu), 6) AS lum FROM bay GROUP BY frame_id, y, x", "px")
def luminance(spark, sf_dir):
    return rounded(calibration.luminance(calibration.bayer_split(px_of(spark, sf_dir))))


@query(f", {BIAS}, {MODEL_FLAT} SELECT list_filter([CASE WHEN quantile_cont(read_noise, 0.99) > 50 THEN 'read_noise' END, CASE WHEN min(flat_gain) < 0.1 THEN 'flat_gain' END], lambda v: v IS NOT NULL)::VARCHAR AS messages FROM bias JOIN flat USING (y, x)", "px")
def model_validate(spark, sf_dir):
    m = model_of(spark, sf_dir).withColumn("hot_pixel", F.lit(False))
    return calibration.validate(m).select(F.concat(F.lit("["), F.array_join("messages", ", "), F.lit("]")).alias("messages"))


@query("WITH m AS (SELECT s_suppkey AS model_id, 8 AS h, 8 + s_suppkey % 3 AS w, s_nationkey % 3 AS gain, s_acctbal / 1000 AS temperature FROM supplier) SELECT a.model_id AS a, b.model_id AS b FROM m a JOIN m b ON a.h = b.h AND a.w = b.w AND a.model_id < b.model_id AND (a.gain = b.gain) AND abs(a.temperature - b.temperature) <= 2")
def model_compatible(spark, sf_dir):
    k = F.col("s_suppkey")
    m = adapters.table(spark, sf_dir, "supplier").select(k.alias("model_id"), F.lit(8).alias("h"), (8 + k % 3).alias("w"), (F.col("s_nationkey") % 3).alias("gain"), (F.col("s_acctbal") / 1000).alias("temperature"))
    return calibration.compatible(m, m)


# Bayesian calibration --------------------------------------------------------


@query("SELECT y, x, round((300.0 / 10000 + sum(adu) / 36.0) / (1.0 / 10000 + count(*) / 36.0), 6) AS mean, round(1 / sqrt(1.0 / 10000 + count(*) / 36.0), 6) AS std FROM px WHERE frame_type = 'bias' GROUP BY y, x", "px")
def bias_posterior(spark, sf_dir):
    return bayes.bias_posterior(px_of(spark, sf_dir, "bias"), 6.0).select("y", "x", r("mean", "mean"), r("std", "std"))


@query(f", {BIAS}, p AS (SELECT y, x, 3.0 + 0.5 * count(*) AS a, 72.0 + 0.5 * sum((adu - bias_mean) ** 2) AS b FROM px JOIN bias USING (y, x) WHERE frame_type = 'bias' GROUP BY y, x) SELECT y, x, round(b / (a - 1), 4) AS variance, round(sqrt(b / (a - 1)), 6) AS read_noise, round(b / (a - 1) / sqrt(a - 2), 4) AS variance_std FROM p", "px")
def read_noise_posterior(spark, sf_dir):
    p = px_of(spark, sf_dir, "bias")
    d = p.join(calibration.fit_bias(p).select("channel", "y", "x", "bias_mean"), ["channel", "y", "x"])
    return bayes.read_noise_posterior(d, "bias_mean").select("y", "x", r("variance", "variance", 4), r("read_noise", "read_noise"), r("variance_std", "variance_std", 4))


@query(f", {BIAS} SELECT y, x, round((3.0 + sum(greatest(adu - bias_mean, 0))) / (3.0 / 0.002 + sum(t)), 8) AS rate, round(sqrt(3.0 + sum(greatest(adu - bias_mean, 0))) / (3.0 / 0.002 + sum(t)), 8) AS std FROM px JOIN bias USING (y, x) WHERE frame_type = 'dark' GROUP BY y, x", "px")
def dark_posterior(spark, sf_dir):
    p = adapters.pixels(spark, sf_dir)
    d = p.where("frame_type = 'dark'").join(calibration.fit_bias(p.where("frame_type = 'bias'")), ["channel", "y", "x"])
    return bayes.dark_posterior(d, "bias_mean").select("y", "x", r("rate", "rate", 8), r("std", "std", 8))


@query(f", {BIAS}, {MODEL_FLAT}, w AS (SELECT y, x, net / scale AS f, scale * scale / (scale + 36.0) AS w FROM flatnet JOIN fscale USING (frame_id)) SELECT y, x, round((1 + sum(f * w)) / (1 + sum(w)), 6) AS gain, round(1 / sqrt(1 + sum(w)), 6) AS std FROM w GROUP BY y, x", "px")
def flat_posterior(spark, sf_dir):
    p = adapters.pixels(spark, sf_dir)
    f = calibration.normalised_flats(p.where("frame_type = 'flat'"), calibration.fit_bias(p.where("frame_type = 'bias'"))).withColumn("rn", F.lit(6.0))
    return bayes.flat_posterior(f, "norm", "scale", "rn").select("y", "x", r("gain", "gain"), r("std", "std"))


@query("""WITH RECURSIVE s AS (SELECT vec_id, (i // 8)::INT AS y, (i % 8)::INT AS x, 300.0 + 40.0 * embedding[i + 1]::DOUBLE AS adu, row_number() OVER (PARTITION BY i ORDER BY vec_id) AS k FROM (SELECT *, unnest(range(64)) AS i FROM embeddings) WHERE vec_id % 4 = 0),
f AS (SELECT y, x, 0::BIGINT AS k, 1.0 / 10000::DOUBLE AS p, 300.0::DOUBLE / 10000 AS n, 3.0::DOUBLE AS a, 72.0::DOUBLE AS b FROM s WHERE k = 1
UNION ALL SELECT f.y, f.x, s.k, f.p + 1 / v, f.n + s.adu / v, f.a + 0.5, f.b + 0.5 * (s.adu - (f.n + s.adu / v) / (f.p + 1 / v)) ** 2 FROM (SELECT *, greatest(b / (a - 1), 1e-12) AS v FROM f) f JOIN s ON s.y = f.y AND s.x = f.x AND s.k = f.k + 1)
SELECT y, x, round(n / p, 6) AS bias_mean, round(sqrt(b / (a - 1)), 6) AS read_noise FROM f WHERE k = (SELECT max(k) FROM s)""")
def bayes_ordered_fold(spark, sf_dir):
    return rounded(bayes.ordered_fold(px_of(spark, sf_dir, "bias")).drop("channel"))


@query("SELECT p_partkey AS pixel, round(p_retailprice * exp(-1.12 / (2 * 8.617333e-5) * (1 / (p_size - 20.0 + 273.15) - 1 / 263.15)), 4) AS rate FROM part")
def arrhenius_scale(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("pixel"), r(bayes.arrhenius(F.col("p_retailprice"), F.lit(-10.0), F.col("p_size") - 20.0), "rate", 4))


@query("WITH s AS (SELECT p_partkey AS pixel, CASE p_partkey % 4 WHEN 0 THEN 'bias' WHEN 1 THEN 'read_noise' WHEN 2 THEN 'dark' ELSE 'flat' END AS param, p_retailprice AS p1, p_retailprice * 1.5 AS p2, (p_size % 3 - 11.0)::DOUBLE AS ref FROM part) SELECT pixel, param, round(CASE WHEN param = 'dark' AND abs(-10.0 - ref) >= 0.1 THEN p1 * exp(-1.12 / (2 * 8.617333e-5) * (1 / 263.15 - 1 / (ref + 273.15))) ELSE p1 END, 4) AS p1, round(CASE WHEN param = 'flat' THEN p1 ELSE p2 END, 4) AS p2, 0::BIGINT AS n FROM s")
def bayes_session_carry(spark, sf_dir):
    k = F.col("p_partkey")
    param = F.get(F.array(*map(F.lit, ("bias", "read_noise", "dark", "flat"))), (k % 4).cast("int"))
    s = adapters.table(spark, sf_dir, "part").select(k.alias("pixel"), param.alias("param"), F.col("p_retailprice").alias("p1"), (F.col("p_retailprice") * 1.5).alias("p2"), F.lit(5).cast("long").alias("n"), (F.col("p_size") % 3 - 11.0).alias("ref_temp_c"))
    return bayes.carry_over(s, -10.0).select("pixel", "param", r("p1", "p1", 4), r("p2", "p2", 4), "n")


@query("SELECT y, x, param, round(p2 / CASE WHEN param IN ('bias', 'flat') THEN p1 ELSE 1 END, 6) AS e FROM (SELECT DISTINCT y, x FROM px), (VALUES ('bias', 0.0001, 0.03), ('flat', 1.0, 1.0)) t(param, p1, p2)", "px")
def bayes_initial_state(spark, sf_dir):
    s = bayes.point_estimates(bayes.initial_state(px_of(spark, sf_dir))).where("param IN ('bias', 'flat')")
    return s.select("y", "x", "param", r("estimate", "e"))


# stacking, choice and summaries ----------------------------------------------


@query("SELECT y, x, round(sum(transparency * (adu - sky)), 4) AS weighted_sum, round(sum(transparency), 6) AS weight_sum, round(sum(sky), 4) AS sky_sum, round(sum(transparency * (adu - sky) ** 2), 2) AS sq_sum FROM px JOIN meta USING (frame_id) WHERE frame_type = 'light' GROUP BY y, x", "px", "meta")
def stack_sums(spark, sf_dir):
    s = stacking.accumulate(lights(spark, sf_dir), adapters.frame_meta(spark, sf_dir))
    return s.select("y", "x", r("weighted_sum", "weighted_sum", 4), r("weight_sum", "weight_sum"), r("sky_sum", "sky_sum", 4), r("sq_sum", "sq_sum", 2))


@query(f", {CAL}, {STACK} SELECT y, x, round(greatest(sq / w - (ws / w) * (ws / w), 0), 4) AS variance FROM stack", "px", "meta")
def variance_map(spark, sf_dir):
    return stacking.derive(stack_of(spark, sf_dir), 1).select("y", "x", r("variance", "variance", 4))


@query("SELECT y, x, round(sum(transparency) / max(sum(transparency)) OVER (), 6) AS quality, round(sum(sky) / count(*), 6) AS sky_mean FROM px JOIN meta USING (frame_id) WHERE frame_type = 'light' GROUP BY y, x", "px", "meta")
def quality_map(spark, sf_dir):
    n = lights(spark, sf_dir).select("frame_id").distinct().count()
    s = stacking.derive(stacking.accumulate(lights(spark, sf_dir), adapters.frame_meta(spark, sf_dir)), n)
    return s.select("y", "x", r("quality", "quality"), r("sky_mean", "sky_mean"))


@query(f", {BAYER}, c AS (SELECT frame_id, channel, median(adu) AS own FROM bay GROUP BY frame_id, channel), a AS (SELECT frame_id, median(adu) AS al FROM bay GROUP BY frame_id) SELECT frame_id, channel, round(290.0 * own / al, 6) AS sky FROM c JOIN a USING (frame_id)", "px")
def sky_by_channel(spark, sf_dir):
    p = calibration.bayer_split(px_of(spark, sf_dir)).withColumn("calibrated", F.col("adu")).withColumn("sky", F.lit(290.0))
    return rounded(stacking.sky_by_channel(p))


@query("SELECT frame_id, CAST(y + round(dy) AS INT) AS y, CAST(x + round(dx) AS INT) AS x, round(adu, 6) AS adu FROM px JOIN meta USING (frame_id) WHERE y + round(dy) BETWEEN 0 AND 7 AND x + round(dx) BETWEEN 0 AND 7", "px", "meta")
def translate_place(spark, sf_dir):
    d = stacking.place(px_of(spark, sf_dir), adapters.frame_meta(spark, sf_dir), 8, 8)
    return d.select("frame_id", "y", "x", r("adu", "adu"))


@query("SELECT CAST(ceil(greatest(max(dy) + 7, 7)) - floor(least(min(dy), 0)) + 1 AS BIGINT) AS rows, CAST(ceil(greatest(max(dx) + 7, 7)) - floor(least(min(dx), 0)) + 1 AS BIGINT) AS cols, CAST(-floor(least(min(dy), 0)) AS BIGINT) AS row0, CAST(-floor(least(min(dx), 0)) AS BIGINT) AS col0 FROM meta", "meta")
def union_canvas(spark, sf_dir):
    return stacking.union_canvas(stacking.shifted_corners(adapters.frame_meta(spark, sf_dir), 8, 8))


@query("""SELECT frame_id, y::INT AS y, x::INT AS x, round(sum(w * adu) / sum(w), 5) AS v FROM (SELECT m.frame_id, g.y, g.x, (1 - abs(g.y + m.dy - t.ty)) * (1 - abs(g.x + m.dx - t.tx)) AS w, p.adu FROM meta m, (SELECT a.range AS y, b.range AS x FROM range(8) a, range(8) b) g, LATERAL (SELECT floor(g.y + m.dy) + j AS ty, floor(g.x + m.dx) + i AS tx FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(j, i)) t JOIN px p ON p.frame_id = m.frame_id AND p.y = t.ty AND p.x = t.tx) WHERE w > 0 GROUP BY frame_id, y, x HAVING sum(w) > 0.5""", "px", "meta")
def warp_to_canvas(spark, sf_dir):
    one, none = F.lit(1.0), F.lit(0.0)
    affine = {"a": one, "b": none, "c": F.col("dx"), "d": none, "e": one, "f": F.col("dy")}
    w = stacking.covered(stacking.warp(frames_with(spark, sf_dir, affine), 8, 8))
    return w.select("frame_id", "y", "x", r("calibrated", "v", 5))


def frames_with(spark, sf_dir, columns: dict[str, Column]) -> DataFrame:
    """All frames, and columns that are made of what their numbers say of them."""
    return adapters.frames(spark, sf_dir).withColumns(adapters.frame_facts(F.col("frame_id"))).withColumns(columns)


def _spline_sql() -> str:
    """px as the weights sp of cubic B-splines: the inverse of the matrix that has 4/6 on its diagonal and 1/6 beside it, 2/6 at the mirrored ends, along rows and columns."""
    import numpy as np

    m = np.diag([4.0] * 8) + np.diag([1.0] * 7, 1) + np.diag([1.0] * 7, -1)
    m[0, 1] = m[7, 6] = 2.0
    inverse = np.linalg.inv(m / 6)
    rows = ", ".join(f"({i}, {j}, {inverse[i, j]!r}::DOUBLE)" for i in range(8) for j in range(8)).replace("np.float64(", "").replace(")::DOUBLE", "::DOUBLE")
    return f"""inv AS (SELECT * FROM (VALUES {rows}) t(i, j, m)),
half AS (SELECT frame_id, i AS y, x, sum(m * adu) AS v FROM px JOIN inv ON j = y GROUP BY ALL),
sp AS (SELECT frame_id, y, i AS x, sum(m * v) AS v FROM half JOIN inv ON j = x GROUP BY ALL)"""


def _beta_sql(d: str) -> str:
    return f"(CASE WHEN abs({d}) < 1 THEN (4 - 6 * {d} * {d} + 3 * abs({d}) ** 3) / 6 WHEN abs({d}) < 2 THEN (2 - abs({d})) ** 3 / 6 ELSE 0 END)"


@query(f""", {_spline_sql()}, g AS (SELECT m.frame_id, a.range AS y, b.range AS x, cos(radians(m.rotation)) AS c, sin(radians(m.rotation)) AS s, m.dy, m.dx FROM meta m, range(8) a, range(8) b),
t AS (SELECT frame_id, y, x, c * (x - 3.5) - s * (y - 3.5) + 3.5 + dx AS sx, s * (x - 3.5) + c * (y - 3.5) + 3.5 + dy AS sy FROM g),
o AS (SELECT range - 1 AS k FROM range(4)),
w AS (SELECT t.frame_id, t.y, t.x, {_beta_sql('(sy - floor(sy) - j.k)')} * {_beta_sql('(sx - floor(sx) - i.k)')} AS w, 7 - abs(7 - abs(floor(sy)::INT + j.k)) AS ky, 7 - abs(7 - abs(floor(sx)::INT + i.k)) AS kx FROM t, o j, o i WHERE sx BETWEEN -1e-9 AND 7 + 1e-9 AND sy BETWEEN -1e-9 AND 7 + 1e-9)
SELECT w.frame_id, w.y::INT AS y, w.x::INT AS x, round(sum(w * v), 4) AS v FROM w JOIN sp ON sp.frame_id = w.frame_id AND sp.y = ky AND sp.x = kx GROUP BY ALL""", "px", "meta")
def warp_cubic(spark, sf_dir):
    w = stacking.covered(stacking.warp(frames_with(spark, sf_dir, turned_by(F.col("rotation"))), 8, 8, order=3))
    return w.select("frame_id", "y", "x", r("calibrated", "v", 4))


def turned_by(rotation: Column) -> dict[str, Column]:
    """A turn about the middle of an 8 x 8 frame, then its shift."""
    c, n = F.cos(F.radians(rotation)), F.sin(F.radians(rotation))
    return {"a": c, "b": -n, "c": -c * 3.5 + n * 3.5 + 3.5 + F.col("dx"), "d": n, "e": c, "f": -n * 3.5 - c * 3.5 + 3.5 + F.col("dy")}


BEST = "SELECT frame_id, round({0}, 6) AS {0} FROM meta ORDER BY {0} {1}, frame_id LIMIT (SELECT greatest(1, round_even(count(*) * 0.25, 0))::BIGINT FROM meta)"


@query(BEST.format("transparency", "DESC"), "meta")
def select_best_transparency(spark, sf_dir):
    return rounded(stacking.select_best(adapters.frame_meta(spark, sf_dir), 0.25).select("frame_id", "transparency"))


@query(BEST.format("fwhm", "ASC"), "meta")
def select_best_fwhm(spark, sf_dir):
    return rounded(stacking.select_best(adapters.frame_meta(spark, sf_dir), 0.25, "fwhm").select("frame_id", "fwhm"))


@query("SELECT frame_id, round(v, 6) AS v FROM (SELECT s_suppkey AS frame_id, s_acctbal AS v FROM supplier), (SELECT median(s_acctbal) AS m FROM supplier), (SELECT median(abs(s_acctbal - (SELECT median(s_acctbal) FROM supplier))) AS d FROM supplier) WHERE v < m - 1.0 * 1.4826 * d")
def transparency_outliers(spark, sf_dir):
    s = adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id"), F.col("s_acctbal").alias("transparency"))
    return stacking.outliers(s, 1.0).select("frame_id", r("transparency", "v"))


SUMMARY = "SELECT session, round(min({0}), 6) AS min, round(median({0}), 6) AS median, round(max({0}), 6) AS max, round(stddev_pop({0}), 6) AS std, count({0}) AS n, count(*) FILTER ({0} < q1) AS best_n FROM meta JOIN (SELECT session, quantile_cont({0}, 0.25) AS q1 FROM meta GROUP BY session) USING (session) GROUP BY session"


@query(SUMMARY.format("transparency"), "meta")
def transparency_summary(spark, sf_dir):
    return rounded(stacking.summary(adapters.frame_meta(spark, sf_dir), "transparency", ["session"]))


@query(SUMMARY.format("fwhm"), "meta")
def fwhm_summary(spark, sf_dir):
    return rounded(stacking.summary(adapters.frame_meta(spark, sf_dir), "fwhm", ["session"]))


@query(", s AS (SELECT y, x, sum(transparency * (adu - sky)) AS ws, sum(transparency) AS w FROM px JOIN meta USING (frame_id) WHERE frame_type = 'light' GROUP BY y, x), k AS (SELECT sum(transparency) FILTER (transparency > 0.75) / sum(transparency) AS k FROM meta WHERE frame_id % 4 = 3) SELECT y, x, round(ws * k, 3) AS weighted_sum, round(w * k, 5) AS weight_sum FROM s, k", "px", "meta")
def rebuild_subset(spark, sf_dir):
    meta = adapters.frame_meta(spark, sf_dir).where("frame_id % 4 = 3")
    s = stacking.accumulate(lights(spark, sf_dir), meta)
    d = stacking.rescaled(s, meta, meta.where("transparency > 0.75"))
    return d.select("y", "x", r("weighted_sum", "weighted_sum", 3), r("weight_sum", "weight_sum", 5))


@query("SELECT frame_id, round(180 - ((180 - (rotation - r0)) % 360 + 360) % 360, 6) AS turn FROM meta, (SELECT rotation AS r0 FROM meta ORDER BY frame_id LIMIT 1)", "meta")
def rotation_to_reference(spark, sf_dir):
    return rounded(stacking.rotation_to_reference(adapters.frame_meta(spark, sf_dir)).select("frame_id", "turn"))


@query("SELECT frame_id, session FROM meta WHERE frame_id NOT IN (SELECT frame_id FROM meta WHERE frame_id % 3 = 0)", "meta")
def resume_remaining(spark, sf_dir):
    m = adapters.frame_meta(spark, sf_dir)
    return stacking.remaining(m, m.where("frame_id % 3 = 0")).select("frame_id", "session")


@query("SELECT frame_id, session, last_value(CASE WHEN frame_id % 5 <> 0 THEN round(fwhm, 6) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM meta", "meta")
def prior_psf_carry(spark, sf_dir):
    m = adapters.frame_meta(spark, sf_dir).withColumn("known", F.when(F.col("frame_id") % 5 != 0, F.round("fwhm", 6)))
    return stacking.prior_values(m, "known").select("frame_id", "session", "prior")


@query("SELECT frame_id, session FROM meta WHERE transparency >= 0.7 AND fwhm <= 3.0", "meta")
def quality_filter(spark, sf_dir):
    return stacking.quality_filter(adapters.frame_meta(spark, sf_dir), 0.7, 3.0).select("frame_id", "session")


# neighbourhoods --------------------------------------------------------------


@query("SELECT frame_id, y, x, round(adu, 6) AS adu FROM (SELECT *, max(rm) OVER (PARTITION BY frame_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS peak FROM (SELECT *, max(adu) OVER (PARTITION BY frame_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS rm FROM px)) WHERE adu = peak", "px")
def local_maxima(spark, sf_dir):
    return neighbourhood.local_maxima(px_of(spark, sf_dir), 3).select("frame_id", "y", "x", r("adu", "adu"))


@query(", d AS (SELECT *, lead(adu) OVER (PARTITION BY frame_id, y ORDER BY x) AS dx, lead(adu) OVER (PARTITION BY frame_id, x ORDER BY y) AS dy FROM px) SELECT frame_id, round(sum(sqrt((dx - adu) ** 2 + (dy - adu) ** 2 + 1e-8)), 4) AS tv FROM d WHERE dx IS NOT NULL AND dy IS NOT NULL GROUP BY frame_id", "px")
def total_variation(spark, sf_dir):
    return neighbourhood.total_variation(px_of(spark, sf_dir)).select("frame_id", r("tv", "tv", 4))


@query(", d AS (SELECT *, lead(adu) OVER (PARTITION BY frame_id, y ORDER BY x) AS dx, lead(adu) OVER (PARTITION BY frame_id, x ORDER BY y) AS dy FROM px), e AS (SELECT *, lead(dx) OVER (PARTITION BY frame_id, x ORDER BY y) AS dd FROM d) SELECT frame_id, round(sum(sqrt((dx - adu) ** 2 + (dy - adu) ** 2 + 0.5 * ((dd - adu) ** 2 + (dx - dy) ** 2) + 1e-8)), 4) AS tv FROM e WHERE dd IS NOT NULL GROUP BY frame_id", "px")
def total_variation_diagonal(spark, sf_dir):
    return neighbourhood.total_variation(px_of(spark, sf_dir), diagonal=True).select("frame_id", r("tv", "tv", 4))


def _haar_level(n: int, of: str) -> str:
    """One halving in SQL: h{n} has the blocks of table `of`(frame_id, y, x, v), l{n} what is left."""
    at = lambda j, i: f"sum(v) FILTER (y % 2 = {j} AND x % 2 = {i})"
    return f"h{n} AS (SELECT frame_id, y // 2 AS y, x // 2 AS x, {at(0, 0)} AS a, {at(0, 1)} AS b, {at(1, 0)} AS c, {at(1, 1)} AS d FROM {of} GROUP BY ALL), l{n} AS (SELECT frame_id, y, x, (a + b + c + d) / 2 AS v FROM h{n})"


@query(f", l0 AS (SELECT frame_id, y, x, adu AS v FROM px), {_haar_level(1, 'l0')}, {_haar_level(2, 'l1')}, e AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2) SELECT frame_id, round(sum((abs(a - b + c - d) + abs(a + b - c - d) + abs(a - b - c + d)) / 2), 4) AS l1 FROM e GROUP BY frame_id", "px")
def haar_two_levels(spark, sf_dir):
    return neighbourhood.haar_details(px_of(spark, sf_dir), levels=2).select("frame_id", r("l1", "l1", 4))


@query(", b AS (SELECT frame_id, y // 2 AS yb, x // 2 AS xb, sum(adu) FILTER (y % 2 = 0 AND x % 2 = 0) AS a, sum(adu) FILTER (y % 2 = 0 AND x % 2 = 1) AS b, sum(adu) FILTER (y % 2 = 1 AND x % 2 = 0) AS c, sum(adu) FILTER (y % 2 = 1 AND x % 2 = 1) AS d FROM px GROUP BY ALL) SELECT frame_id, round(sum((abs(a - b + c - d) + abs(a + b - c - d) + abs(a - b - c + d)) / 2), 4) AS l1 FROM b GROUP BY frame_id", "px")
def haar_l1(spark, sf_dir):
    return neighbourhood.haar_details(px_of(spark, sf_dir)).select("frame_id", r("l1", "l1", 4))


@query("SELECT frame_id, y // 2 AS y, x // 2 AS x, round(avg(adu), 6) AS adu FROM px GROUP BY ALL", "px")
def downsample_avgpool(spark, sf_dir):
    return rounded(neighbourhood.pool(px_of(spark, sf_dir), 2).drop("channel"))


@query("SELECT frame_id, (y * 2 + j)::INT AS y, (x * 2 + i)::INT AS x, round(adu, 6) AS adu FROM px, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(j, i)", "px")
def upsample_nearest(spark, sf_dir):
    return rounded(neighbourhood.repeat(px_of(spark, sf_dir), 2).drop("channel"))


@query(f""", {BAYER}, pl AS (SELECT frame_id, y, x, avg(adu) FILTER (channel = 'R') AS r, avg(adu) FILTER (channel IN ('G0', 'G1')) AS g, avg(adu) FILTER (channel = 'B') AS b FROM bay GROUP BY frame_id, y, x),
u AS (SELECT frame_id, 2 * y + j AS y, 2 * x + i AS x, r, g, b FROM pl, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(j, i)),
a AS (SELECT *, r + lead(r) OVER w AS rx, g + lead(g) OVER w AS gx, b + lead(b) OVER w AS bx FROM u WINDOW w AS (PARTITION BY frame_id, y ORDER BY x)),
d AS (SELECT *, (rx + lead(rx) OVER w) / 4 AS rs, (gx + lead(gx) OVER w) / 4 AS gs, (bx + lead(bx) OVER w) / 4 AS bs FROM a WINDOW w AS (PARTITION BY frame_id, x ORDER BY y))
SELECT frame_id, y::INT AS y, x::INT AS x, round(coalesce(rs, r), 5) AS r, round(coalesce(gs, g), 5) AS g, round(coalesce(bs, b), 5) AS b FROM d""", "px")
def debayer_preview(spark, sf_dir):
    return rounded(neighbourhood.debayer(calibration.bayer_split(px_of(spark, sf_dir)), 8, 8), 5)


MIX = "mix AS (SELECT y, x, 0.2 + ((y * 5 + x * 3) % 8) / 10.0::DOUBLE AS p_normal FROM (SELECT DISTINCT y, x FROM px))"


def mixture_pixels(p: DataFrame) -> DataFrame:
    return p.select("channel", "y", "x").distinct().withColumn("p_normal", 0.2 + ((F.col("y") * 5 + F.col("x") * 3) % 8) / 10.0)


@query(f", {MIX} SELECT p.frame_id, p.y, p.x, round(coalesce(CASE WHEN m.p_normal < 0.5 THEN (SELECT sum(q.p_normal * n.adu) / sum(q.p_normal) FROM px n JOIN mix q ON q.y = n.y AND q.x = n.x WHERE n.frame_id = p.frame_id AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1 AND NOT (n.y = p.y AND n.x = p.x)) END, p.adu), 5) AS adu FROM px p JOIN mix m ON m.y = p.y AND m.x = p.x", "px")
def defect_interpolation(spark, sf_dir):
    p = px_of(spark, sf_dir)
    return neighbourhood.defect_interpolation(p, mixture_pixels(p)).select("frame_id", "y", "x", r("adu", "adu", 5))


@query(", r0 AS (SELECT frame_id, adu AS v FROM px), s0 AS (SELECT frame_id, median(v) AS m FROM r0 GROUP BY 1), d0 AS (SELECT frame_id, m, 1.4826 * median(abs(v - m)) AS s FROM r0 JOIN s0 USING (frame_id) GROUP BY 1, 2), r1 AS (SELECT frame_id, v FROM r0 JOIN d0 USING (frame_id) WHERE s < 1e-9 OR abs(v - m) < 3 * s), s1 AS (SELECT frame_id, median(v) AS m FROM r1 GROUP BY 1), d1 AS (SELECT frame_id, m, 1.4826 * median(abs(v - m)) AS s FROM r1 JOIN s1 USING (frame_id) GROUP BY 1, 2), r2 AS (SELECT frame_id, v FROM r1 JOIN d1 USING (frame_id) WHERE s < 1e-9 OR abs(v - m) < 3 * s), s2 AS (SELECT frame_id, median(v) AS m FROM r2 GROUP BY 1), d2 AS (SELECT frame_id, m, 1.4826 * median(abs(v - m)) AS s FROM r2 JOIN s2 USING (frame_id) GROUP BY 1, 2), r3 AS (SELECT frame_id, v FROM r2 JOIN d2 USING (frame_id) WHERE s < 1e-9 OR abs(v - m) < 3 * s), s3 AS (SELECT frame_id, median(v) AS m FROM r3 GROUP BY 1) SELECT frame_id, round(m, 6) AS median, round(greatest(1.4826 * median(abs(v - m)), 1e-6), 6) AS spread, count(*) AS n FROM r3 JOIN s3 USING (frame_id) GROUP BY frame_id, m", "px")
def sigma_clip_stats(spark, sf_dir):
    return rounded(neighbourhood.sigma_clipped(px_of(spark, sf_dir), ["frame_id"]))


def _clipped_sql(key: str, rounds: int = 3, tile: bool = False) -> str:
    """From r0(key, v): the clipped median by key, after some rounds; strictly, or as tiles are clipped: inclusive, and no more without four values or a spread."""
    steps = []
    stays = "(s < 1e-6 OR n < 4 OR (v >= m - 3 * s AND v <= m + 3 * s))" if tile else "(s < 1e-9 OR abs(v - m) < 3 * s)"
    for k in range(rounds):
        steps.append(f"s{k} AS (SELECT {key}, median(v) AS m, count(*) AS n FROM r{k} GROUP BY {key}), d{k} AS (SELECT {key}, m, n, 1.4826 * median(abs(v - m)) AS s FROM r{k} JOIN s{k} USING ({key}) GROUP BY {key}, m, n), r{k + 1} AS (SELECT {key}, v FROM r{k} JOIN d{k} USING ({key}) WHERE {stays})")
    return ", ".join(steps) + f", s{rounds} AS (SELECT {key}, median(v) AS m FROM r{rounds} GROUP BY {key}) SELECT {key}, round(m, 6) AS sky FROM s{rounds}"


@query(f", tl AS (SELECT * FROM (VALUES (0, 0, 2), (1, 5, 8)) t(k, lo, hi)), r0 AS (SELECT frame_id, a.k AS tr, b.k AS tc, adu AS v FROM px JOIN tl a ON y >= a.lo AND y < a.hi JOIN tl b ON x >= b.lo AND x < b.hi WHERE frame_type = 'light'), {_clipped_sql('frame_id, tr, tc')}", "px")
def sky_tiles(spark, sf_dir):
    return rounded(neighbourhood.sky_mesh(px_of(spark, sf_dir, "light"), 8, 8, 4).drop("channel"))


@query(f", tl AS (SELECT * FROM (VALUES (0, 0, 2), (1, 5, 8)) t(k, lo, hi)), r0 AS (SELECT frame_id, a.k AS tr, b.k AS tc, adu AS v FROM px JOIN tl a ON y >= a.lo AND y < a.hi JOIN tl b ON x >= b.lo AND x < b.hi), {_clipped_sql('frame_id, tr, tc', tile=True)}", "px")
def sky_mesh_tiles(spark, sf_dir):
    """The run's tiles, of all frames."""
    return rounded(neighbourhood.sky_meshes(adapters.frames(spark, sf_dir), 4))


@query(""", k AS (SELECT a.range AS ky, b.range AS kx, CASE WHEN a.range < 4 THEN a.range ELSE a.range - 8 END AS fy, CASE WHEN b.range < 4 THEN b.range ELSE b.range - 8 END AS fx FROM range(8) a, range(8) b),
h AS (SELECT frame_id, x, a.range AS ky, sum(adu * cos(2 * pi() * y * a.range / 8)) AS re, -sum(adu * sin(2 * pi() * y * a.range / 8)) AS im FROM px, range(8) a GROUP BY ALL),
f AS (SELECT frame_id, ky, b.range AS kx, sum(re * cos(2 * pi() * x * b.range / 8) + im * sin(2 * pi() * x * b.range / 8)) AS re, sum(im * cos(2 * pi() * x * b.range / 8) - re * sin(2 * pi() * x * b.range / 8)) AS im FROM h, range(8) b GROUP BY ALL)
SELECT frame_id, floor(sqrt(fy * fy + fx * fx))::INT AS ring, (floor(sqrt(fy * fy + fx * fx)) + 0.5) / 8 AS frequency, round(ln(avg(re * re + im * im)), 5) AS log_power FROM f JOIN k USING (ky, kx) WHERE fy * fy + fx * fx < 16 GROUP BY ALL""", "px")
def power_by_ring(spark, sf_dir):
    """The logarithm, as powers span many orders."""
    p = validation.ring_power(adapters.frames(spark, sf_dir), 4)
    return p.select("frame_id", "ring", "frequency", r(F.log("power"), "log_power", 5))


@query(""", k AS (SELECT m.frame_id, a.range AS y, b.range AS x, cos(radians(m.rotation)) AS c, sin(radians(m.rotation)) AS s, m.dy, m.dx FROM meta m, range(8) a, range(8) b),
t AS (SELECT frame_id, y, x, c * (x - 3.5) - s * (y - 3.5) + 3.5 + dx AS sx, s * (x - 3.5) + c * (y - 3.5) + 3.5 + dy AS sy FROM k),
w AS (SELECT t.frame_id, t.y, t.x, (1 - abs(sy - floor(sy) - j)) * (1 - abs(sx - floor(sx) - i)) AS w, adu FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(j, i) JOIN px p ON p.frame_id = t.frame_id AND p.y = floor(sy) + j AND p.x = floor(sx) + i)
SELECT frame_id, y::INT AS y, x::INT AS x, round(sum(w * adu) / sum(w), 4) AS v FROM w WHERE w > 0 GROUP BY ALL HAVING sum(w) > 0.500001""", "px", "meta")
def warp_rotated(spark, sf_dir):
    w = stacking.covered(stacking.warp(frames_with(spark, sf_dir, turned_by(F.col("rotation"))), 8, 8, min_cover=0.500001))  # just above a half, so that rounding decides nothing
    return w.select("frame_id", "y", "x", r("calibrated", "v", 4))


SIGMA_CLIP = ORACLE["sigma_clip_stats"].removeprefix("WITH " + SQL["px"] + ",").strip()


@query(f", {SIGMA_CLIP[: SIGMA_CLIP.rindex(' SELECT frame_id, round(m, 6)')]}, c AS (SELECT frame_id, m, greatest(1.4826 * median(abs(v - m)), 1e-6) AS s FROM r3 JOIN s3 USING (frame_id) GROUP BY frame_id, m), t AS (SELECT frame_id, quantile_cont(adu, 0.999) AS top FROM px GROUP BY 1) SELECT frame_id, round(m - 2.8 * s, 5) AS black, round(greatest(top, m - 2.8 * s + 1), 5) AS white FROM c JOIN t USING (frame_id)", "px")
def display_levels(spark, sf_dir):
    return rounded(display.auto_params(px_of(spark, sf_dir), ("frame_id",)).select("frame_id", "black", "white"), 5)


# display ---------------------------------------------------------------------


def _stretched(spark, sf_dir, mode):
    p = px_of(spark, sf_dir).select("frame_id", "y", "x", display.normalised(F.col("adu"), F.lit(250.0), F.lit(400.0)).alias("v"))
    return p.select("frame_id", "y", "x", r(display.stretch(F.col("v"), mode, 50.0, 0.25), "v"), display.to_uint8(F.round(display.stretch(F.col("v"), mode, 50.0, 0.25), 6)).alias("u8"))


NORM = "nrm AS (SELECT frame_id, y, x, (least(greatest(adu, 250.0), 400.0) - 250.0) / 150.0 AS n FROM px)"


def _stretch_sql(curve):
    return f", {NORM} SELECT frame_id, y, x, round(v, 6) AS v, floor(round(v, 6) * 255 + 0.5)::SMALLINT AS u8 FROM (SELECT frame_id, y, x, least(greatest({curve}, 0), 1) AS v FROM nrm)"


@query(_stretch_sql("asinh(50.0 * n) / asinh(50.0)"), "px")
def stretch_asinh(spark, sf_dir):
    return _stretched(spark, sf_dir, "asinh")


@query(_stretch_sql("n"), "px")
def stretch_linear(spark, sf_dir):
    return _stretched(spark, sf_dir, "linear")


@query(_stretch_sql("ln(1 + 50.0 * n) / ln(51.0)"), "px")
def stretch_log(spark, sf_dir):
    return _stretched(spark, sf_dir, "log")


@query(_stretch_sql("(0.25 - 1) * n / ((2 * 0.25 - 1) * n - 0.25)"), "px")
def stretch_midtone(spark, sf_dir):
    return _stretched(spark, sf_dir, "midtone")


@query(f", {NORM} SELECT frame_id, y, x, floor(round(n, 9) * 255 + 0.5)::SMALLINT AS byte FROM nrm", "px")
def display_bytes(spark, sf_dir):
    v = F.round(display.normalised(F.col("adu"), F.lit(250.0), F.lit(400.0)), 9)
    return px_of(spark, sf_dir).select("frame_id", "y", "x", display.to_uint8(v).alias("byte"))


@query(f", {NORM}, b AS (SELECT least(floor(round(n, 9) * 256), 255)::INT AS bin, count(*) AS c FROM nrm GROUP BY 1) SELECT g.range::INT AS bin, round((g.range + 0.5) / 256, 6) AS centre, coalesce(c, 0)::BIGINT AS count FROM range(256) g LEFT JOIN b ON b.bin = g.range", "px")
def display_histogram(spark, sf_dir):
    p = px_of(spark, sf_dir).select(F.round(display.normalised(F.col("adu"), F.lit(250.0), F.lit(400.0)), 9).alias("v"))
    return rounded(display.histogram(p, "v"))


@query(f", {BAYER}, pl AS (SELECT frame_id, y, x, round((avg(adu) FILTER (channel = 'R') - 200) / 200, 9) AS r, round((avg(adu) FILTER (channel IN ('G0', 'G1')) - 200) / 200, 9) AS g, round((avg(adu) FILTER (channel = 'B') - 200) / 200, 9) AS b FROM bay GROUP BY frame_id, y, x), l AS (SELECT 'r' AS channel, r AS v FROM pl UNION ALL SELECT 'g', g FROM pl UNION ALL SELECT 'b', b FROM pl), c AS (SELECT channel, least(floor(v * 32), 31)::INT AS bin, count(*) AS n FROM l WHERE v BETWEEN 0 AND 1 GROUP BY ALL) SELECT h.channel, k.range::INT AS bin, coalesce(n, 0)::BIGINT AS count FROM (SELECT DISTINCT channel FROM l) h, range(32) k LEFT JOIN c ON c.channel = h.channel AND c.bin = k.range", "px")
def rgb_histograms(spark, sf_dir):
    p = calibration.bayer_split(px_of(spark, sf_dir))
    m = lambda *c: F.round((F.avg(F.when(F.col("channel").isin(*c), F.col("adu"))) - 200) / 200, 9)
    rgb = p.groupBy("frame_id", "y", "x").agg(m("R").alias("r"), m("G0", "G1").alias("g"), m("B").alias("b"))
    return display.rgb_histograms(rgb, 32).where("channel <> 'lum'").select("channel", "bin", "count")


# geometry --------------------------------------------------------------------


@query("SELECT p_partkey AS id, round(206264.80624709636 * 3.76e-3 / (200 + p_size * 10), 6) AS plate_scale, round((200 + p_size * 10) / 80.0, 6) AS f_number, round(1.219669891266504 * 206264.80624709636 * 550e-6 / 80.0, 6) AS airy_arcsec FROM part")
def scope_geometry(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (200.0 + F.col("p_size") * 10).alias("focal_mm"), F.lit(80.0).alias("aperture_mm"), F.lit(3.76).alias("pixel_um"), F.lit(550.0).alias("wavelength_nm"))
    return geometry.scope(p).select("id", r("plate_scale", "plate_scale"), r("f_number", "f_number"), r("airy_arcsec", "airy_arcsec"))


WCS = "wcs AS (SELECT p_partkey AS id, 256.5::DOUBLE AS crpix1, 256.5::DOUBLE AS crpix2, (p_partkey % 360)::DOUBLE AS crval1, ((p_partkey * 7) % 120 - 60)::DOUBLE AS crval2, 0.0005 * cos(radians(p_size)) AS cd11, -0.0005 * sin(radians(p_size)) AS cd12, 0.0005 * sin(radians(p_size)) AS cd21, 0.0005 * cos(radians(p_size)) AS cd22, (p_partkey % 512)::DOUBLE AS px, ((p_partkey * 3) % 512)::DOUBLE AS py FROM part)"
XI = "radians(cd11 * (px + 1 - crpix1) + cd12 * (py + 1 - crpix2))"
ETA = "radians(cd21 * (px + 1 - crpix1) + cd22 * (py + 1 - crpix2))"


def wcs_rows(spark, sf_dir) -> DataFrame:
    k, a = F.col("p_partkey"), F.radians("p_size")
    return adapters.table(spark, sf_dir, "part").select(
        k.alias("id"), F.lit(256.5).alias("crpix1"), F.lit(256.5).alias("crpix2"), (k % 360).cast("double").alias("crval1"), ((k * 7) % 120 - 60).cast("double").alias("crval2"),
        (0.0005 * F.cos(a)).alias("cd11"), (-0.0005 * F.sin(a)).alias("cd12"), (0.0005 * F.sin(a)).alias("cd21"), (0.0005 * F.cos(a)).alias("cd22"),
        (k % 512).cast("double").alias("px"), ((k * 3) % 512).cast("double").alias("py"),
    )


@query(f"WITH {WCS} SELECT id, round(sqrt(cd11 ** 2 + cd21 ** 2) * 3600, 6) AS scale, round((degrees(atan2(cd12, cd22)) % 360 + 360) % 360, 6) AS position_angle, cd11 * cd22 - cd12 * cd21 > 0 AS flip_x FROM wcs")
def wcs_geometry(spark, sf_dir):
    none = {c: F.lit(None).cast("double") for c in ("cdelt1", "cdelt2", "crota2")}
    return geometry.wcs_geometry(wcs_rows(spark, sf_dir).withColumns(none)).select("id", r("scale", "scale"), r("position_angle", "position_angle"), "flip_x")


@query(f"WITH {WCS}, s AS (SELECT id, {XI} AS xi, {ETA} AS eta, radians(crval1) AS a, radians(crval2) AS d FROM wcs) SELECT id, round(((degrees(a + atan2(xi, cos(d) - eta * sin(d))) % 360) + 360) % 360, 6) AS ra, round(degrees(atan2(sin(d) + eta * cos(d), sqrt(xi * xi + (cos(d) - eta * sin(d)) ** 2))), 6) AS dec FROM s")
def tan_pixel_to_sky(spark, sf_dir):
    s = geometry.pixel_to_sky(F.col("px"), F.col("py"))
    return wcs_rows(spark, sf_dir).select("id", r(s["ra"], "ra"), r(s["dec"], "dec"))


@query(f"WITH {WCS} SELECT id, round(px, 5) AS x, round(py, 5) AS y FROM wcs")
def tan_round_trip(spark, sf_dir):
    d = wcs_rows(spark, sf_dir).withColumns(geometry.pixel_to_sky(F.col("px"), F.col("py")))
    s = geometry.sky_to_pixel(F.col("ra"), F.col("dec"))
    return d.select("id", r(s["x"], "x", 5), r(s["y"], "y", 5))


@query("SELECT s_suppkey AS id, round(CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 24 + 30 / 60.0 + 15 / 3600.0) * 15 ELSE s_suppkey % 24 + 0.5 END, 8) AS ra FROM supplier")
def parse_ra_hint(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.when(k % 2 == 0, F.concat((k % 24).cast("string"), F.lit(":30:15"))).otherwise(F.concat((k % 24).cast("string"), F.lit(".5")))
    return adapters.table(spark, sf_dir, "supplier").select(k.alias("id"), r(geometry.parse_angle(text, hours=True), "ra", 8))


SHIFTS = "SELECT frame_id, CASE WHEN frame_id % 5 = 0 THEN -9999.0 ELSE dx END AS dx_px, CASE WHEN frame_id % 5 = 0 THEN -9999.0 ELSE dy END AS dy_px, rotation AS rotation_deg FROM meta"


def shift_columns(spark, sf_dir) -> DataFrame:
    """Shifts as foreign tables have them: -9999 where there is none."""
    none = F.col("frame_id") % 5 == 0
    mark = lambda c: F.when(none, -9999.0).otherwise(F.col(c))
    return adapters.frame_meta(spark, sf_dir).select("frame_id", mark("dx").alias("dx_px"), mark("dy").alias("dy_px"), F.lit(0.0).alias("dx_arcsec"), F.lit(0.0).alias("dy_arcsec"), F.col("rotation").cast("double").alias("rotation_deg"), F.lit(1.0).alias("scale_ratio"))


@query(f", s AS ({SHIFTS}) SELECT frame_id, dx_px <> -9999 AS has_shift, round(CASE WHEN dx_px <> -9999 THEN dx_px END, 6) AS dx, round(CASE WHEN dx_px <> -9999 THEN rotation_deg END, 6) AS rotation FROM s", "meta")
def shift_record(spark, sf_dir):
    d = geometry.shift_record(shift_columns(spark, sf_dir))
    return d.select("frame_id", F.col("shift").isNotNull().alias("has_shift"), r("shift.dx_px", "dx"), r("shift.rotation_deg", "rotation"))


@query(f", s AS ({SHIFTS}) SELECT frame_id, round(nullif(dx_px, -9999), 6) AS dx_px, round(nullif(dy_px, -9999), 6) AS dy_px FROM s", "meta")
def sentinel_to_null(spark, sf_dir):
    return rounded(store.from_sentinel(shift_columns(spark, sf_dir), "dx_px", "dy_px").select("frame_id", "dx_px", "dy_px"))


@query("SELECT frame_id, round(dx / 2, 6) AS dx_to_ref, round(dy / 2, 6) AS dy_to_ref FROM meta", "meta")
def half_resolution_shift(spark, sf_dir):
    m = adapters.frame_meta(spark, sf_dir).select("frame_id", F.col("dx").alias("dx_to_ref"), F.col("dy").alias("dy_to_ref"))
    return rounded(geometry.half_resolution(m))


@query("SELECT frame_id, round(CASE WHEN frame_id <> 0 THEN coalesce(CASE WHEN frame_id % 3 > 0 THEN dx END, CASE WHEN frame_id % 2 > 0 THEN dy END) END, 6) AS shift FROM meta", "meta")
def resolve_shift(spark, sf_dir):
    k = F.col("frame_id")
    found = geometry.resolve_shift(k == 0, F.when(k % 3 > 0, F.col("dx")), F.when(k % 2 > 0, F.col("dy")))
    return adapters.frame_meta(spark, sf_dir).select("frame_id", F.round(found, 6).alias("shift"))


def _kernel_sql(v):
    return f"WITH k AS (SELECT (i // 9)::INT AS ky, (i % 9)::INT AS kx, (i // 9 - 4) ** 2 + (i % 9 - 4) ** 2 AS r2 FROM (SELECT unnest(range(81)) AS i)), v AS (SELECT ky, kx, {v} AS v FROM k) SELECT ky, kx, round(v / (SELECT sum(v) FROM v), 9) AS w FROM v"


@query(_kernel_sql("exp(-4 * ln(2) * r2 / 9.0)"))
def gaussian_kernel(spark, sf_dir):
    return rounded(geometry.gaussian_kernel(spark, 9, 3.0), 9)


@query(_kernel_sql("(1 + r2 / (9.0 / (4 * (pow(2, 1 / 2.5) - 1)))) ** -2.5"))
def moffat_kernel(spark, sf_dir):
    return rounded(geometry.moffat_kernel(spark, 9, 3.0, 2.5), 9)


# stars -----------------------------------------------------------------------

TRI = """tri AS (SELECT frame_id, i, j, k, l[1] / l[3] AS u, l[2] / l[3] AS v FROM (SELECT p.frame_id, p.star_rank AS i, q.star_rank AS j, r.star_rank AS k, list_sort([sqrt((p.y - q.y) ** 2 + (p.x - q.x) ** 2), sqrt((p.y - r.y) ** 2 + (p.x - r.x) ** 2), sqrt((q.y - r.y) ** 2 + (q.x - r.x) ** 2)]) AS l FROM star p JOIN star q ON p.frame_id = q.frame_id AND p.star_rank < q.star_rank JOIN star r ON p.frame_id = r.frame_id AND q.star_rank < r.star_rank) WHERE l[3] >= 1e-6)"""


@query(f", {TRI} SELECT frame_id, i, j, k, round(u, 6) AS u, round(v, 6) AS v FROM tri", "star")
def triangle_descriptors(spark, sf_dir):
    return stars.triangles(adapters.star_catalogue(spark, sf_dir)).select("frame_id", "i", "j", "k", millionths("u"), millionths("v"))


@query(f""", {TRI}, ref AS (SELECT i, j, k, u, v, (floor(u / 0.02) + a.range - 1)::INT AS cu, (floor(v / 0.02) + b.range - 1)::INT AS cv FROM tri, range(3) a, range(3) b WHERE frame_id = 0),
m AS (SELECT t.frame_id, t.i, t.j, t.k, min({{'d': round(sqrt((t.u - f.u) ** 2 + (t.v - f.v) ** 2), 9), 'i': f.i, 'j': f.j, 'k': f.k}}) AS n FROM tri t JOIN ref f ON f.cu = floor(t.u / 0.02)::INT AND f.cv = floor(t.v / 0.02)::INT WHERE sqrt((t.u - f.u) ** 2 + (t.v - f.v) ** 2) <= 0.02 GROUP BY ALL),
p AS (SELECT frame_id, i AS star, n.i AS r FROM m UNION ALL SELECT frame_id, j, n.j FROM m UNION ALL SELECT frame_id, k, n.k FROM m), c AS (SELECT frame_id, star, r, count(*) AS votes FROM p GROUP BY ALL HAVING count(*) >= 2) SELECT frame_id, star, r AS ref, votes FROM c WHERE frame_id IN (SELECT frame_id FROM c GROUP BY frame_id HAVING count(*) >= 3)""", "star")
def triangle_match_votes(spark, sf_dir):
    return stars.match_stars(adapters.star_catalogue(spark, sf_dir), 0)


@query(", r AS (SELECT star_rank, flux AS ref FROM star WHERE frame_id = 0) SELECT frame_id, round(CASE WHEN count(q) >= 2 THEN least(greatest(median(q), 0.01), 1.5) ELSE 1 END, 6) AS transparency, count(q) AS pairs FROM (SELECT frame_id, CASE WHEN flux > 0 AND ref > 0 THEN flux / ref END AS q FROM star LEFT JOIN r USING (star_rank)) GROUP BY frame_id", "star")
def transparency(spark, sf_dir):
    s = adapters.star_catalogue(spark, sf_dir)
    return rounded(stars.transparency(s, s.where("frame_id = 0")))


@query(", s AS (SELECT frame_id, 3.3::DOUBLE AS sy, 3.7::DOUBLE AS sx FROM meta), h AS (SELECT frame_id, adu, sqrt((y - sy) ** 2 + (x - sx) ** 2) AS d FROM s JOIN px USING (frame_id)) SELECT frame_id, round(sum(adu) FILTER (d <= 1.5) - count(*) FILTER (d <= 1.5) * coalesce(median(adu) FILTER (d > 2.25 AND d <= 3.75), 0), 5) AS flux FROM h GROUP BY frame_id", "px", "meta")
def aperture_flux(spark, sf_dir):
    s = adapters.frame_meta(spark, sf_dir).select("frame_id", F.lit(0).alias("star_rank"), F.lit(3.3).alias("y"), F.lit(3.7).alias("x"))
    return stars.aperture_flux(s, px_of(spark, sf_dir), 1.5).select("frame_id", r("flux", "flux", 5))


@query(", g AS (SELECT session, y, x, greatest(median(adu - 290), 0) AS v FROM px GROUP BY ALL) SELECT session, y, x, round(v / sum(v) OVER (PARTITION BY session), 6) AS w FROM g", "px")
def psf_median_stack(spark, sf_dir):
    s = px_of(spark, sf_dir).select(F.col("session").alias("frame_id"), F.col("frame_id").alias("star_rank"), F.col("y").alias("ky"), F.col("x").alias("kx"), (F.col("adu") - 290).alias("v"))
    return stars.psf_stack(s).select(F.col("frame_id").alias("session"), F.col("ky").alias("y"), F.col("kx").alias("x"), r("w", "w"))


@query("SELECT frame_id, star_rank, round(flux, 4) AS flux, row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, y, x) - 1 AS rank FROM star QUALIFY rank < 5", "star")
def brightest_stars(spark, sf_dir):
    s = adapters.star_catalogue(spark, sf_dir).withColumnRenamed("star_rank", "n")
    return stars.ranked(s, "flux", 5).select("frame_id", F.col("n").alias("star_rank"), r("flux", "flux", 4), F.col("star_rank").cast("long").alias("rank"))


# mixture, losses, validation -------------------------------------------------

M = mixture.Mixture((0.9, 0.06, 0.04), (5.0, 2.0, 2.0), (0.004, 0.0004, 0.02))
ES = "e AS (SELECT pixel, rate, [ln(0.9) + 5 * ln(0.004) - lgamma(5) + 4 * ln(rate) - 0.004 * rate, ln(0.06) + 2 * ln(0.0004) - lgamma(2) + ln(rate) - 0.0004 * rate, ln(0.04) + 2 * ln(0.02) - lgamma(2) + ln(rate) - 0.02 * rate] AS t FROM (SELECT pixel, avg(adu / t) AS rate FROM smp GROUP BY pixel)), q AS (SELECT pixel, t, list_max(t) AS m, exp(t[1] - list_max(t)) AS a, exp(t[2] - list_max(t)) AS b, exp(t[3] - list_max(t)) AS c FROM e)"


def rates_of(spark, sf_dir) -> DataFrame:
    return adapters.samples(spark, sf_dir).groupBy("pixel").agg(F.avg(F.col("adu") / F.col("exposure_s")).alias("rate"))


@query(f", {ES} SELECT pixel, round(a / (a + b + c), 6) AS p_normal, round(b / (a + b + c), 6) AS p_hot, round(c / (a + b + c), 6) AS p_cold, round(m + ln(a + b + c), 6) AS loglik FROM q", "smp")
def em_e_step(spark, sf_dir):
    d = mixture.with_probabilities(rates_of(spark, sf_dir), M)
    return d.select("pixel", *[r(F.get("p", F.lit(k)), f"p_{n}") for k, n in enumerate(mixture.NAMES)], r("loglik", "loglik"))


@query(f", {ES} SELECT pixel, (list_position(t, m) - 1)::INT AS label FROM q", "smp")
def mixture_labels(spark, sf_dir):
    return mixture.labels(rates_of(spark, sf_dir), M).select("pixel", "label")


@query(f", {ES}, g AS (SELECT q.*, e.rate, a / (a + b + c) AS g0, b / (a + b + c) AS g1, c / (a + b + c) AS g2, m + ln(a + b + c) AS ll FROM q JOIN e USING (pixel)) SELECT round(sum(g0), 4) AS n0, round(sum(g1), 4) AS n1, round(sum(g2), 4) AS n2, round(sum(g0 * rate), 2) AS x0, round(sum(g1 * rate), 2) AS x1, round(sum(g2 * rate), 4) AS x2, round(sum(g0 * ln(rate)), 3) AS l0, round(sum(g1 * ln(rate)), 3) AS l1, round(sum(g2 * ln(rate)), 4) AS l2, round(sum(ll), 3) AS ll FROM g", "smp")
def mixture_moments(spark, sf_dir):
    m = mixture.moments(rates_of(spark, sf_dir).withColumn("w", F.lit(1.0)), M, "w")
    digits = {"x0": 2, "x1": 2, "l0": 3, "l1": 3, "ll": 3}
    return m.select(*[r(c, c, digits.get(c, 4)) for c in m.columns])


@query(f", {ES}, l AS (SELECT list_position(t, m) - 1 AS label FROM q) SELECT count(*) FILTER (label = 0) AS n_normal, count(*) FILTER (label = 1) AS n_hot, count(*) FILTER (label = 2) AS n_cold FROM l", "smp")
def mixture_label_counts(spark, sf_dir):
    return mixture.label_counts(mixture.labels(rates_of(spark, sf_dir), M))


@query("SELECT frame_id, round(sum(greatest(v, 1e-12) - adu * ln(greatest(v, 1e-12))), 4) AS nll FROM (SELECT frame_id, adu, avg(adu) OVER (PARTITION BY y, x) AS v FROM px) GROUP BY frame_id", "px")
def poisson_nll(spark, sf_dir):
    p = px_of(spark, sf_dir)
    m = p.groupBy("y", "x").agg(F.greatest(F.avg("adu"), F.lit(1e-12)).alias("v"))
    return p.join(m, ["y", "x"]).groupBy("frame_id").agg(r(F.sum(F.col("v") - F.col("adu") * F.log("v")), "nll", 4))


@query("SELECT frame_id, round(sum(adu * ln(adu / v) - adu + v), 5) AS kl FROM (SELECT frame_id, adu, avg(adu) OVER (PARTITION BY y, x) AS v FROM px) WHERE adu > 0 GROUP BY frame_id", "px")
def poisson_kl(spark, sf_dir):
    p = px_of(spark, sf_dir)
    m = p.groupBy("y", "x").agg(F.avg("adu").alias("v"))
    a, v = F.col("adu"), F.col("v")
    return p.join(m, ["y", "x"]).where("adu > 0").groupBy("frame_id").agg(r(F.sum(a * F.log(a / v) - a + v), "kl", 5))


@query(", p AS (SELECT frame_id, adu AS a, avg(adu) OVER (PARTITION BY y, x) AS b FROM px) SELECT frame_id, round(sqrt(avg((a - b) ** 2)), 5) AS rmse, round(20 * log10((max(b) - min(b)) / sqrt(avg((a - b) ** 2))), 5) AS psnr, round(corr(a, b), 5) AS pearson FROM p GROUP BY frame_id", "px")
def rmse_psnr_pearson(spark, sf_dir):
    p = px_of(spark, sf_dir)
    pairs = p.join(p.groupBy("y", "x").agg(F.avg("adu").alias("b")), ["y", "x"])
    return rounded(validation.agreement(pairs, "adu", "b", ["frame_id"]), 5)


@query(", i AS (SELECT session, y, x, avg(adu) AS v, avg(t) AS t FROM px GROUP BY ALL), w AS (SELECT y, x, avg(adu) AS b FROM px GROUP BY ALL), p AS (SELECT session, v - avg(v) OVER (PARTITION BY session) AS a, b - avg(b) OVER (PARTITION BY session) AS b FROM i JOIN w USING (y, x)) SELECT session, round(sqrt(avg((a - b) ** 2)), 5) AS rmse, round(20 * log10((max(b) - min(b)) / sqrt(avg((a - b) ** 2))), 5) AS psnr, round(corr(a, b), 5) AS pearson FROM p GROUP BY session", "px")
def stack_accuracy(spark, sf_dir):
    p = px_of(spark, sf_dir)
    pairs = p.groupBy("session", "y", "x").agg(F.avg("adu").alias("v")).join(p.groupBy("y", "x").agg(F.avg("adu").alias("b")), ["y", "x"])
    return rounded(validation.stack_accuracy(pairs, "v", "b", ["session"]), 5)


@query(f", {BIAS}, v AS (SELECT y, x, var_samp(adu) AS variance, avg(t) AS t FROM px WHERE frame_type = 'light' GROUP BY y, x) SELECT y, x, round(variance, 4) AS variance, round(variance / (0.9 * t + 0.01 * t + read_noise ** 2), 6) AS chi2 FROM v JOIN bias USING (y, x)", "px")
def chi2_noise_budget(spark, sf_dir):
    model = calibration.fit_bias(px_of(spark, sf_dir, "bias")).withColumns({"sky": F.lit(0.9), "dark_rate": F.lit(0.01), "flat_gain": F.lit(1.0)})
    d = validation.noise_budget(lights(spark, sf_dir), model)
    return d.select("y", "x", r("variance", "variance", 4), r("chi2", "chi2"))


@query(", d AS (SELECT adu, CASE WHEN (y - 2) ** 2 + (x - 2) ** 2 <= 4 THEN ['disc'] ELSE [] END || CASE WHEN (y - 5) ** 2 + (x - 5) ** 2 <= 9 THEN ['gauss'] ELSE [] END || CASE WHEN (y - 2) ** 2 + (x - 2) ** 2 > 4 AND (y - 5) ** 2 + (x - 5) ** 2 > 9 THEN ['background'] ELSE [] END AS regions FROM px), e AS (SELECT adu, unnest(regions) AS region FROM d) SELECT region, round(avg(adu), 5) AS mean, round(stddev_pop(adu), 5) AS std, round(avg(((adu - 300) / 10) ** 2), 4) AS chi2, round((avg(adu) - 300) / 300, 6) AS bias_frac, count(*) AS n FROM e GROUP BY region", "px")
def region_stats(spark, sf_dir):
    p = validation.region_masks(px_of(spark, sf_dir), (2, 2, 2.0), (5, 5, 3.0)).withColumns({"truth": F.lit(300.0), "sigma": F.lit(10.0)})
    d = validation.region_stats(p, "adu", "truth", "sigma")
    return d.select("region", r("mean", "mean", 5), r("std", "std", 5), r("chi2", "chi2", 4), r("bias_frac", "bias_frac"), "n")


@query(", p AS (SELECT y, x, avg(adu) AS a, 300.0 + y AS b FROM px GROUP BY y, x) SELECT round(median(a), 5) AS median_found, round(median(b), 5) AS median_true, round(median(abs(a - b)), 5) AS median_error, round(quantile_cont(abs(a - b), 0.95), 5) AS p95_error FROM p", "px")
def parameter_error(spark, sf_dir):
    p = px_of(spark, sf_dir).groupBy("y", "x").agg(F.avg("adu").alias("a")).withColumn("b", 300.0 + F.col("y"))
    return rounded(validation.parameter_error(p, "a", "b").drop("share"), 5)


@query("SELECT ring, round(avg(adu), 5) AS mean, count(*) AS n FROM (SELECT adu, (floor(sqrt((y - 3.5) ** 2 + (x - 3.5) ** 2) / 6.0 * 6) + 1)::BIGINT AS ring FROM px) WHERE ring BETWEEN 1 AND 6 GROUP BY ring", "px")
def radial_profile(spark, sf_dir):
    return rounded(validation.radial_profile(px_of(spark, sf_dir), 3.5, 3.5, 6, 6.0), 5)


# discovery and time ----------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, date_trunc('hour', ts) AS hour FROM events GROUP BY event_type, hour")
def exposure_tumbling(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").start.alias("hour")).agg(F.count("*").alias("n"), r(F.sum("value"), "total", 4)).select("event_type", "n", "total", F.col("hour").cast("timestamp_ntz").alias("hour"))


@query("WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS started, count(*) AS n FROM k GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'light' WHEN 'click' THEN 'dark' WHEN 'purchase' THEN 'flat' ELSE NULL END AS frame_type, round(coalesce(value, 300.0), 4) AS exposure_s FROM events")
def header_projection(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    named = F.when(F.col("event_type") == "view", " Light Frame ").when(F.col("event_type") == "click", "DARK").when(F.col("event_type") == "purchase", "Flat Field").otherwise(F.lit("none"))
    d = e.select("event_id", F.create_map(F.lit("IMAGETYP"), named, F.lit("EXPOSURE"), F.col("value").cast("string")).alias("header"))
    d = fits.header_values(d, 300.0).withColumn("frame_type", fits.frame_type(F.element_at("header", "IMAGETYP")))
    return d.select("event_id", "frame_type", r("exposure_s", "exposure_s", 4))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 3 THEN 'light' WHEN s_suppkey % 3 = 0 THEN 'bias' WHEN s_suppkey % 3 = 1 THEN 'dark' ELSE 'flat' END AS frame_type FROM supplier")
def frame_discovery(spark, sf_dir):
    k = F.col("s_suppkey")
    folder = F.when(k % 4 == 3, F.lit("misc")).otherwise(F.get(F.array(*map(F.lit, ("bias", "Darks", "flats"))), (k % 3).cast("int")))
    d = adapters.table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("/data/"), folder, F.lit("/f.fits")).alias("path"), F.create_map(F.lit("IMAGETYP"), F.lit("light")).alias("header"))
    return fits.discover(d).select("id", "frame_type")


# kernels and solvers: no SQL; tests compare them with plain formulas ---------


def _through_sky(k: int, x: str) -> str:
    """A frame's pixel (x, 255.5) in the pixels of the reference r, in SQL."""
    xi, eta = (f"radians(w.cd{n}1 * ({x} + 1 - w.crpix1) + w.cd{n}2 * (255.5 + 1 - w.crpix2))" for n in (1, 2))
    return f"""s{k} AS (SELECT w.id, radians(w.crval1) + atan2({xi}, cos(radians(w.crval2)) - {eta} * sin(radians(w.crval2))) - radians(r.crval1) AS h, atan2(sin(radians(w.crval2)) + {eta} * cos(radians(w.crval2)), sqrt({xi} ** 2 + (cos(radians(w.crval2)) - {eta} * sin(radians(w.crval2))) ** 2)) AS d, r.* EXCLUDE (id, px, py) FROM w, r),
t{k} AS (SELECT *, sin(d) * sin(radians(crval2)) + cos(d) * cos(radians(crval2)) * cos(h) AS den FROM s{k}),
u{k} AS (SELECT *, degrees(cos(d) * sin(h) / den) AS xi, degrees((sin(d) * cos(radians(crval2)) - cos(d) * sin(radians(crval2)) * cos(h)) / den) AS eta, cd11 * cd22 - cd12 * cd21 AS det FROM t{k}),
p{k} AS (SELECT id, (cd22 * xi - cd12 * eta) / det + crpix1 - 1 AS x, (cd11 * eta - cd21 * xi) / det + crpix2 - 1 AS y FROM u{k})"""


@query(f"""WITH {WCS}, w AS (SELECT * REPLACE (180.0 + id % 7 * 0.001 AS crval1, 20.0 AS crval2) FROM wcs), r AS (SELECT * FROM w WHERE id = 1), {_through_sky(0, "255.5")}, {_through_sky(1, "383.5")}
SELECT w.id, round(p0.x - 255.5, 5) AS dx_to_ref, round(p0.y - 255.5, 5) AS dy_to_ref, round(((degrees(atan2(r.cd12, r.cd22)) - degrees(atan2(w.cd12, w.cd22)) + 180) % 360 + 360) % 360 - 180, 5) AS rotation, round(sqrt((p1.x - p0.x) ** 2 + (p1.y - p0.y) ** 2) / 128, 5) AS scale_ratio FROM w JOIN p0 USING (id) JOIN p1 USING (id), r""")
def frame_shift(spark, sf_dir):
    d = wcs_rows(spark, sf_dir).withColumns({"crval1": F.lit(180.0) + F.col("id") % 7 * 0.001, "crval2": F.lit(20.0)})
    return rounded(geometry.frame_shift(d, d.where("id = 1"), 512, 512).select("id", "dx_to_ref", "dy_to_ref", "rotation", "scale_ratio"), 5)


def _sky_sql(k: int, x: float, y: float) -> str:
    """The reference's pixel (x, y) in the pixels of each frame w, in SQL."""
    xi, eta = (f"radians(r.cd{n}1 * ({x} + 1 - r.crpix1) + r.cd{n}2 * ({y} + 1 - r.crpix2))" for n in (1, 2))
    return f"""a{k} AS (SELECT w.*, radians(r.crval1) + atan2({xi}, cos(radians(r.crval2)) - {eta} * sin(radians(r.crval2))) - radians(w.crval1) AS h, atan2(sin(radians(r.crval2)) + {eta} * cos(radians(r.crval2)), sqrt({xi} ** 2 + (cos(radians(r.crval2)) - {eta} * sin(radians(r.crval2))) ** 2)) AS d FROM w, r),
b{k} AS (SELECT *, sin(d) * sin(radians(crval2)) + cos(d) * cos(radians(crval2)) * cos(h) AS den FROM a{k}),
c{k} AS (SELECT *, degrees(cos(d) * sin(h) / den) AS xi, degrees((sin(d) * cos(radians(crval2)) - cos(d) * sin(radians(crval2)) * cos(h)) / den) AS eta, cd11 * cd22 - cd12 * cd21 AS det FROM b{k}),
q{k} AS (SELECT id, (cd22 * xi - cd12 * eta) / det + crpix1 - 1 AS x, (cd11 * eta - cd21 * xi) / det + crpix2 - 1 AS y FROM c{k})"""


NEAR_WCS = f"WITH {WCS}, w AS (SELECT * REPLACE (180.0 + id % 7 * 0.001 AS crval1, 20.0 AS crval2) FROM wcs), r AS (SELECT * FROM w WHERE id = 1)"


def beside_reference(spark, sf_dir) -> DataFrame:
    """Frames near each other on the sky, with the WCS of the first as r_..."""
    d = wcs_rows(spark, sf_dir).withColumns({"crval1": F.lit(180.0) + F.col("id") % 7 * 0.001, "crval2": F.lit(20.0)})
    return d.join(F.broadcast(d.where("id = 1").select(*[F.col(c).alias(f"r_{c}") for c in geometry.WCS])))


@query(f"""{NEAR_WCS}, {_sky_sql(0, 299.5 - 44, 279.5 - 24)}, {_sky_sql(1, 299.5 + 140 - 44, 279.5 - 24)}, {_sky_sql(2, 299.5 - 44, 279.5 + 140 - 24)},
j AS (SELECT q0.id, q0.x AS x0, q0.y AS y0, (q1.x - q0.x) / 140 AS a, (q2.x - q0.x) / 140 AS b, (q1.y - q0.y) / 140 AS d, (q2.y - q0.y) / 140 AS e FROM q0 JOIN q1 USING (id) JOIN q2 USING (id))
SELECT id, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(x0 - a * 299.5 - b * 279.5, 4) + 0.0 AS c, round(d, 6) + 0.0 AS d, round(e, 6) + 0.0 AS e, round(y0 - d * 299.5 - e * 279.5, 4) + 0.0 AS f FROM j""")
def wcs_canvas_affine(spark, sf_dir):
    """Canvas of 560 x 600 in which the reference begins at row 24, column 44."""
    m = geometry.canvas_affine(560, 600, 24, 44)
    return beside_reference(spark, sf_dir).select("id", *[(F.round(m[c], 4 if c in "cf" else 6) + 0.0).alias(c) for c in "abcdef"])  # no negative zeros


@query()
def fit_dark_mixture(spark, sf_dir):
    m = mixture.fit_mixture(rates_of(spark, sf_dir))
    return spark.createDataFrame([(n, float(s), float(a), float(b), len(m.history), m.converged) for n, s, a, b in zip(mixture.NAMES, m.share, m.alpha, m.beta)], "component string, share double, alpha double, beta double, rounds int, converged boolean")


LIGHT = "lt AS (SELECT frame_id, y, x, adu FROM px WHERE frame_type = 'light')"


def _mirrored(v: str) -> str:
    """An index of 8 mirrored at the edges, in SQL."""
    return f"(CASE WHEN (({v}) % 16 + 16) % 16 < 8 THEN (({v}) % 16 + 16) % 16 ELSE 15 - (({v}) % 16 + 16) % 16 END)"


@query(f""", {LIGHT}, md AS (SELECT frame_id, median(adu) AS m FROM lt GROUP BY 1), sd AS (SELECT frame_id, m, median(abs(adu - m)) AS s FROM lt JOIN md USING (frame_id) GROUP BY 1, 2),
o AS (SELECT lt.frame_id, y, x FROM lt JOIN sd USING (frame_id) WHERE adu > m + 3 * 1.4826 * s),
k AS (SELECT o.frame_id, o.y, o.x, {_mirrored("o.y + a.range - 2")} AS ny, {_mirrored("o.x + b.range - 2")} AS nx FROM o, range(5) a, range(5) b),
v AS (SELECT k.frame_id, k.y, k.x, median(lt.adu) AS v FROM k JOIN lt ON lt.frame_id = k.frame_id AND lt.y = k.ny AND lt.x = k.nx GROUP BY 1, 2, 3)
SELECT frame_id, y, x, round(coalesce(v, adu), 6) AS adu FROM lt LEFT JOIN v USING (frame_id, y, x)""", "px")
def replace_hot_pixels(spark, sf_dir):
    p = px_of(spark, sf_dir, "light")
    return rounded(neighbourhood.replace_masked(p, neighbourhood.outlier_mask(p, 3.0), 8, 8).select("frame_id", "y", "x", "adu"))


@query(f""", {LIGHT}, wt AS (SELECT (range - 4)::INT AS o, exp(-0.5 * (range - 4) ** 2) / sum(exp(-0.5 * (range - 4) ** 2)) OVER () AS w FROM range(9)),
h AS (SELECT k.frame_id, k.y, k.x, sum(wt.w * n.adu) AS v FROM lt k, wt JOIN lt n ON n.frame_id = k.frame_id AND n.y = k.y AND n.x = {_mirrored("k.x + wt.o")} GROUP BY 1, 2, 3)
SELECT k.frame_id, k.y, k.x, round(sum(wt.w * n.v), 5) AS smooth FROM h k, wt JOIN h n ON n.frame_id = k.frame_id AND n.x = k.x AND n.y = {_mirrored("k.y + wt.o")} GROUP BY 1, 2, 3""", "px")
def smooth_frames(spark, sf_dir):
    return rounded(neighbourhood.smooth(px_of(spark, sf_dir, "light"), 8, 8).select("frame_id", "y", "x", "smooth"), 5)


@query()
def sky_background(spark, sf_dir):
    mesh = neighbourhood.sky_mesh(px_of(spark, sf_dir, "light"), 8, 8, 4)
    tiles = images.images_of(mesh.select("frame_id", F.col("tr").alias("y"), F.col("tc").alias("x"), F.col("sky").alias("adu")), 2, 2)
    return images.map_images(tiles, lambda m, _: kernels.sky_surface(m, 8, 8))


@query()
def extract_stars(spark, sf_dir):
    p = px_of(spark, sf_dir, "light").withColumn("adu", F.col("adu") - 290)
    peaks = stars.candidate_peaks(p, stars.background_noise(p), 8, 8, 5.0, 3, 1)
    return rounded(stars.isolated(peaks, 2.0, 10))


@query()
def fit_moffat(spark, sf_dir):
    def work(image, row):
        m = kernels.fit_moffat(image - image.min(), 40)
        return [(row["frame_id"], m["fwhm"], m["y"], m["x"])]

    return images.measure_images(adapters.frames(spark, sf_dir), "frame_id long, fwhm double, y double, x double", work)


@query()
def fourier_shift(spark, sf_dir):
    f = adapters.frames(spark, sf_dir).join(adapters.frame_meta(spark, sf_dir).select("frame_id", "dy", "dx"), "frame_id")
    return images.map_images(f, lambda image, row: kernels.fourier_shift(image, row["dy"], row["dx"]), ["dy", "dx"])


#: The transform of 8 x 8 frames in SQL: ft(frame_id, ky, kx, re, im).
DFT = """h AS (SELECT frame_id, x, a.range AS ky, sum(adu * cos(2 * pi() * y * a.range / 8)) AS re, -sum(adu * sin(2 * pi() * y * a.range / 8)) AS im FROM px, range(8) a GROUP BY ALL),
ft AS (SELECT frame_id, ky, b.range AS kx, sum(re * cos(2 * pi() * x * b.range / 8) + im * sin(2 * pi() * x * b.range / 8)) AS re, sum(im * cos(2 * pi() * x * b.range / 8) - re * sin(2 * pi() * x * b.range / 8)) AS im FROM h, range(8) b GROUP BY ALL)"""


@query(f""", {DFT},
p AS (SELECT frame_id, ky, kx, re, im, -2 * pi() * (CASE WHEN ky < 4 THEN ky ELSE ky - 8 END * dy + kx * dx) / 8 AS a FROM ft JOIN meta USING (frame_id) WHERE kx <= 4),
s AS (SELECT frame_id, ky, kx, CASE WHEN kx IN (0, 4) THEN 1 ELSE 2 END * (re * cos(a) - im * sin(a)) AS re, CASE WHEN kx IN (0, 4) THEN 1 ELSE 2 END * (re * sin(a) + im * cos(a)) AS im FROM p),
c AS (SELECT frame_id, y.range AS y, kx, sum(re * cos(2 * pi() * ky * y.range / 8) - im * sin(2 * pi() * ky * y.range / 8)) AS re, sum(re * sin(2 * pi() * ky * y.range / 8) + im * cos(2 * pi() * ky * y.range / 8)) AS im FROM s, range(8) y GROUP BY ALL)
SELECT frame_id, y::INT AS y, x.range::INT AS x, round(sum(re * cos(2 * pi() * kx * x.range / 8) - im * sin(2 * pi() * kx * x.range / 8)) / 64, 5) AS v FROM c, range(8) x GROUP BY ALL""", "px", "meta")
def fourier_shift_pixels(spark, sf_dir):
    f = images.map_images(frames_with(spark, sf_dir, {}), lambda image, row: kernels.fourier_shift(image, row["dy"], row["dx"]), ["dy", "dx"])
    return stacking.covered(f, "v").select("frame_id", "y", "x", r("v", "v", 5))


@query(f", wt AS (SELECT a.range - 2 AS j, b.range - 2 AS i, exp(-ln(2) * ((a.range - 2) ** 2 + (b.range - 2) ** 2)) AS w FROM range(5) a, range(5) b) SELECT k.frame_id, k.y, k.x, round(sum(wt.w * n.adu) / (SELECT sum(w) FROM wt), 5) AS adu FROM px k, wt JOIN px n ON n.frame_id = k.frame_id AND n.y = {_mirrored('k.y + wt.j')} AND n.x = {_mirrored('k.x + wt.i')} GROUP BY 1, 2, 3", "px")
def convolve_psf(spark, sf_dir):
    psf = kernels.gaussian_psf(5, 2.0)
    out = images.map_images(adapters.frames(spark, sf_dir), lambda image, _: kernels.convolve(image, psf))
    return rounded(adapters.explode_frames(out).drop("channel"), 5)


@query()
def airy_psf(spark, sf_dir):
    p = kernels.broadband_psf(15, 3.76, 80.0, 400.0, (450, 550, 650), (0.3, 0.4, 0.3), 0.2)
    return spark.createDataFrame([(int(y), int(x), float(p[y, x])) for y in range(15) for x in range(15)], "ky int, kx int, w double")


@query()
def wiener_deconvolve(spark, sf_dir):
    known = kernels.gaussian_psf(15, 2.0)
    f = adapters.frame_meta(spark, sf_dir).select("frame_id", F.lit(1).alias("h"), F.lit(1).alias("w"), F.array("fwhm").alias("data"))
    return images.map_images(f, lambda v, _: kernels.wiener_deconvolve(kernels.gaussian_psf(15, float(v[0, 0]) + 1), known, 100.0))


@query("SELECT frame_id, 1.01::DOUBLE AS scale, round(degrees(0.02), 6) AS rotation, 3.0::DOUBLE AS tx, -2.0::DOUBLE AS ty FROM star GROUP BY frame_id HAVING count(*) >= 3", "star")
def similarity_fit(spark, sf_dir):
    s = adapters.star_catalogue(spark, sf_dir)

    def fit(key, pdf):
        import numpy as np
        import pandas as pd

        src = pdf[["y", "x"]].to_numpy()
        z = (src[:, 1] + 1j * src[:, 0]) * 1.01 * np.exp(0.02j) + (3 - 2j)
        m = kernels.similarity_fit(src, np.stack([z.imag, z.real], axis=1)) or {}
        return pd.DataFrame([(key[0], m.get("scale"), m.get("rotation"), m.get("tx"), m.get("ty"))], columns=["frame_id", "scale", "rotation", "tx", "ty"])

    return rounded(s.groupBy("frame_id").applyInPandas(fit, "frame_id long, scale double, rotation double, tx double, ty double"))


@query()
def forward_model(spark, sf_dir):
    psf = kernels.gaussian_psf(5, 2.0)
    return images.map_images(adapters.frames(spark, sf_dir), lambda image, _: solver.Forward(image.shape, 2, psf, 0.8, 0.25, -0.5)(image))


def _solver_input(spark, sf_dir, bayer=False):
    p = lights(spark, sf_dir)
    p = calibration.bayer_split(p) if bayer else p
    meta = adapters.frame_meta(spark, sf_dir)
    s = stacking.accumulate(p, meta.withColumn("sky", F.lit(0.0)))
    # frames of one PSF and no shift predict as one frame does whose t^2 is the sum of theirs
    n, t2 = meta.where("frame_id % 4 = 3").agg(F.count("*"), F.sum(F.col("transparency") ** 2)).first()
    return stacking.derive(s, n), [{"t": float(t2 or 0.0) ** 0.5, "psf": kernels.gaussian_psf(5, 2.0)}]


#: All 300 iterations, unless the loss stands still before.
SOLVER = solver.SolverConfig()


@query()
def map_fast(spark, sf_dir):
    stack, frames = _solver_input(spark, sf_dir)
    return rounded(solver.solve_channels(stack, frames, 8, 8, SOLVER), 4)


@query()
def map_multichannel(spark, sf_dir):
    stack, frames = _solver_input(spark, sf_dir, bayer=True)
    return rounded(solver.solve_channels(stack, frames, 4, 4, SOLVER), 4)


@query()
def map_exact(spark, sf_dir):
    """From the light frames themselves, batch by batch, each with its own width, turn and shift."""
    import numpy as np

    small = F.when(F.col("frame_id") % 3 == 0, 2.0).otherwise(0.0)  # degrees
    f = frames_with(spark, sf_dir, {"fwhm": F.col("fwhm") / 2, "dy": F.col("dy") / 10, "dx": F.col("dx") / 10}).where("frame_type = 'light'")
    c, n = F.cos(F.radians(small)), F.sin(F.radians(small))
    f = f.select("frame_id", "data", "transparency", "dy", "dx", "fwhm", F.array(c, -n, n, c).alias("turn"))
    # 80 steps at this rate come within 1e-5 of the least loss
    s = solver.solve_distributed(f, np.full((8, 8), 300.0), None, solver.SolverConfig(iterations=80, rate=10.0, batch=64), 5)
    return spark.createDataFrame([(int(y), int(x), float(round(s.image[y, x], 4))) for y in range(16) for x in range(16)], "y int, x int, flux double")


@query()
def auto_stretch_png(spark, sf_dir):
    p = px_of(spark, sf_dir, "light")
    return display.to_png(display.stretch_mono(p, display.auto_params(p)), 8, 8)


DEBAYER = ORACLE["debayer_preview"].removeprefix("WITH " + SQL["px"])


def _stretch_rgb_sql(sky: str, key: str) -> str:
    """Colours of a debayered light through the asinh curve: sky is r0(frame_id, v), what levels are taken from, key(c) the frame_id there of a colour (0 to 2)."""
    debayered = DEBAYER[: DEBAYER.rindex("\nSELECT frame_id")].replace(" FROM px)", " FROM lt)")
    clip = SIGMA_CLIP[SIGMA_CLIP.index("s0 AS") : SIGMA_CLIP.rindex(" SELECT frame_id, round(m, 6)")]
    colour = lambda k, c: f"(SELECT round(least(greatest(asinh(beta * n) / asinh(beta), 0), 1), 5) FROM (SELECT beta, CASE WHEN white - black < 1e-12 THEN 0 ELSE (least(greatest(d.{c}, black), white) - black) / (white - black) END AS n FROM q WHERE q.frame_id = {key.format(k)})) AS {c}"
    return f""", {LIGHT}{debayered}, rgb AS (SELECT frame_id, y::INT AS y, x::INT AS x, coalesce(rs, r) AS r, coalesce(gs, g) AS g, coalesce(bs, b) AS b FROM d), r0 AS ({sky}), {clip},
c AS (SELECT frame_id, m, greatest(1.4826 * median(abs(v - m)), 1e-6) AS s FROM r3 JOIN s3 USING (frame_id) GROUP BY frame_id, m),
l AS (SELECT frame_id, m, m - 2.8 * s AS black, greatest(top, m - 2.8 * s + 1) AS white FROM c JOIN (SELECT frame_id, quantile_cont(v, 0.999) AS top FROM r0 GROUP BY 1) USING (frame_id)),
q AS (WITH RECURSIVE h AS (SELECT frame_id, black, white, least(greatest((m - black) / (white - black), 1e-6), 0.5) AS bg, 1.0::DOUBLE AS lo, 1e6::DOUBLE AS hi, NULL::DOUBLE AS hit, 0 AS k FROM l
UNION ALL SELECT frame_id, black, white, bg, CASE WHEN f < 0.18 THEN mid ELSE lo END, CASE WHEN f < 0.18 THEN hi ELSE mid END, coalesce(hit, CASE WHEN abs(f - 0.18) < 1e-4 THEN mid END), k + 1 FROM (SELECT *, asinh(mid * bg) / asinh(mid) AS f FROM (SELECT *, (lo + hi) * 0.5 AS mid FROM h WHERE k < 60)))
SELECT frame_id, black, white, coalesce(hit, (lo + hi) * 0.5) AS beta FROM h WHERE k = 60)
SELECT frame_id, y, x, {", ".join(colour(k, c) for k, c in enumerate("rgb"))} FROM rgb d"""


@query(_stretch_rgb_sql("SELECT frame_id, 0.299 * r + 0.587 * g + 0.114 * b AS v FROM rgb", "d.frame_id"), "px")
def stretch_rgb_linked(spark, sf_dir):
    return rounded(display.stretch_rgb(neighbourhood.debayer(calibration.bayer_split(px_of(spark, sf_dir, "light")), 8, 8)), 5)


@query(_stretch_rgb_sql("SELECT frame_id * 4 + c AS frame_id, v FROM (SELECT frame_id, 0 AS c, r AS v FROM rgb UNION ALL SELECT frame_id, 1, g FROM rgb UNION ALL SELECT frame_id, 2, b FROM rgb)", "d.frame_id * 4 + {}"), "px")
def stretch_rgb_unlinked(spark, sf_dir):
    return rounded(display.stretch_rgb(neighbourhood.debayer(calibration.bayer_split(px_of(spark, sf_dir, "light")), 8, 8), linked=False), 5)


@query()
def synthetic_session(spark, sf_dir):
    frames = synth.generate_session(spark, synth.FAST)
    return frames.select("frame_id", "frame_type", "exposure_s", "h", "w", F.round(F.aggregate("data", F.lit(0.0), lambda a, b: a + b), 3).alias("total"))


@query()
def validation_report(spark, sf_dir):
    """All ten measures of a session of 64 x 64 with eight lights and thirty stars."""
    return rounded(ground_truth.report(spark, ground_truth.measures(spark, synth.FAST, 60)), 4)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_stack(spark, sf_dir)
