"""Models, states and stacks as Parquet tables of a folder; nulls stay nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTINEL = -9999.0


def save_model(model: DataFrame, meta: dict, folder: str) -> None:
    model.write.mode("overwrite").parquet(f"{folder}/instrument/pixels")
    rows = [(str(k), None if v is None else str(v)) for k, v in meta.items()]
    model.sparkSession.createDataFrame(rows, "key string, value string").write.mode("overwrite").parquet(f"{folder}/instrument/meta")


def load_model(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/instrument/pixels"), {r.key: r.value for r in spark.read.parquet(f"{folder}/instrument/meta").collect()}


def save_state(state: DataFrame, folder: str, session: str) -> None:
    """A session's posteriors, each version in a partition of its own."""
    state.withColumn("session_id", F.lit(session)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(f"{folder}/bayes")


def load_state(spark: SparkSession, folder: str, session: str | None = None, seen: bool = False) -> DataFrame:
    """The state of a session, by default the last one by name; with seen, of the parameters alone that frames have told of (n above 0)."""
    d = spark.read.option("recursiveFileLookup", "false").schema("channel string, y int, x int, param string, p1 double, p2 double, n long, ref_temp_c double, session_id string").parquet(f"{folder}/bayes")
    last = session or d.agg(F.max("session_id")).first()[0]
    d = d.where(F.col("session_id") == last).drop("session_id")
    return d.where("n > 0") if seen else d


def save_stack(stack: DataFrame, meta: DataFrame, folder: str) -> None:
    stack.write.mode("overwrite").parquet(f"{folder}/stack/pixels")
    meta.write.mode("overwrite").parquet(f"{folder}/stack/frames")


def load_stack(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/stack/pixels"), spark.read.parquet(f"{folder}/stack/frames")


def save_mixture(mixture, pixels: DataFrame, folder: str) -> None:
    """A fitted mixture's parameters and its pixels' probabilities."""
    spark = pixels.sparkSession
    rows = [(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(mixture.share, mixture.alpha, mixture.beta))]
    spark.createDataFrame(rows, "part int, share double, alpha double, beta double").write.mode("overwrite").parquet(f"{folder}/mixture/parameters")
    spark.createDataFrame([(k, float(v)) for k, v in enumerate(mixture.history)], "round int, loglik double").write.mode("overwrite").parquet(f"{folder}/mixture/history")
    pixels.write.mode("overwrite").parquet(f"{folder}/mixture/pixels")


def load_mixture(spark: SparkSession, folder: str):
    """(mixture, pixels) as they were saved."""
    from ..operators.mixture import Mixture

    p = spark.read.parquet(f"{folder}/mixture/parameters").orderBy("part").collect()
    h = spark.read.parquet(f"{folder}/mixture/history").orderBy("round").collect()
    return Mixture(tuple(r.share for r in p), tuple(r.alpha for r in p), tuple(r.beta for r in p), tuple(r.loglik for r in h), True), spark.read.parquet(f"{folder}/mixture/pixels")


#: The tables that a run leaves in its folder.
TABLES = ("instrument", "stack", "bayes", "mixture", "solution", "history")


def invalidate(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> list[str]:
    """Deletes the named tables of a run's folder, and nothing else in it; the names of those that were there."""
    if unknown := set(tables) - set(TABLES):
        raise ValueError(f"no tables of a run: {sorted(unknown)}")
    gone = []
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True):
            gone.append(name)
    return gone


def frame_count(spark: SparkSession, folder: str) -> int:
    return load_stack(spark, folder)[1].count()


def sensor_shape(spark: SparkSession, folder: str) -> tuple[int, int]:
    r = load_model(spark, folder)[0].agg(F.max("y"), F.max("x")).first()
    return r[0] + 1, r[1] + 1


def image_of(px: DataFrame, value: str, height: int, width: int):
    """One image of pixels(y, x, value) on the driver, NaN where there is none."""
    import numpy as np

    out = np.full((height, width), np.nan)
    pdf = px.select("y", "x", F.col(value).alias("v")).toPandas()  # one image
    out[pdf.y, pdf.x] = pdf.v
    return out


def image_rows(px: DataFrame, values: list[str], height: int, width: int) -> DataFrame:
    """Pixels (channel, y, x, values) as one row for each channel with an array for each value, NaN where there is none; a channel's image is put together in a task."""

    def gather(key, table):
        import numpy as np
        import pyarrow as pa

        at = table.column("y").to_numpy() * width + table.column("x").to_numpy()
        out = []
        for v in values:
            image = np.full(height * width, np.nan)
            image[at] = table.column(v).to_numpy()
            out.append(pa.array([image], pa.list_(pa.float64())))
        return pa.table([pa.array([key[0].as_py()]), *out], names=["channel", *values])

    return px.select("channel", "y", "x", *values).groupBy("channel").applyInArrow(gather, "channel string, " + ", ".join(f"{v} array<double>" for v in values))


PRODUCT = "name string, h int, w int, data array<double>, header map<string,string>, extensions map<string,array<double>>"


def stack_products(stack: DataFrame, meta: DataFrame, height: int, width: int) -> DataFrame:
    """Rows for format("fits"): fast_stack, the weighted mean (a cube of the channels in order, where there are several), with NFRAMES, MEDTRANS, MEDFWHM and CHAN1.. in its header; and a file for each channel with variance and quality as extensions."""
    each = image_rows(stack, ["weighted_mean", "variance", "quality"], height, width)
    m = meta.agg(F.count("*").alias("n"), F.median("transparency").alias("t"), F.median("fwhm").alias("w"))
    about = F.map_from_arrays(F.array(*map(F.lit, ("NFRAMES", "MEDTRANS", "MEDFWHM"))), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("0.0")) for c in "ntw"])).alias("about")
    d = each.join(F.broadcast(m.select(about)))
    size = [F.lit(height).alias("h"), F.lit(width).alias("w")]
    more = F.map_from_arrays(F.array(F.lit("VARIANCE"), F.lit("QUALITY")), F.array("variance", "quality"))
    single = d.select(F.concat(F.lit("stack_"), "channel").alias("name"), *size, F.col("weighted_mean").alias("data"), F.map_concat("about", F.create_map(F.lit("CHANNEL"), "channel")).alias("header"), more.alias("extensions"))
    g = d.agg(F.array_sort(F.collect_list(F.struct("channel", "weighted_mean"))).alias("p"), F.first("about").alias("about"))  # four images at most
    names = F.map_from_entries(F.transform("p", lambda c, i: F.struct(F.concat(F.lit("CHAN"), (i + 1).cast("string")), c.channel)))
    whole = g.where(F.size("p") > 0).select(F.lit("fast_stack").alias("name"), *size, F.flatten(F.transform("p", lambda c: c.weighted_mean)).alias("data"), F.map_concat("about", names).alias("header"), F.lit(None).cast("map<string,array<double>>").alias("extensions"))
    return single.unionByName(whole)


def solution_products(solution: DataFrame, quality: DataFrame, height: int, width: int) -> DataFrame:
    """Rows for format("fits"): a file for each channel of a solution (channel, y, x, flux), with the stack's quality (channel, y, x, quality) on the same grid as extension QUALITY."""
    top = solution.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
    s = max((top.y + 1) // height, 1) if top.y is not None else 1
    q = quality.select("channel", F.col("y").alias("__y"), F.col("x").alias("__x"), "quality")
    d = solution.withColumns({"__y": (F.col("y") / s).cast("int"), "__x": (F.col("x") / s).cast("int")}).join(q, ["channel", "__y", "__x"], "left").select("channel", "y", "x", "flux", "quality")
    each = image_rows(d, ["flux", "quality"], height * s, width * s)
    return each.select(F.concat(F.lit("map_"), "channel").alias("name"), F.lit(height * s).alias("h"), F.lit(width * s).alias("w"), F.col("flux").alias("data"), F.create_map(F.lit("CHANNEL"), F.col("channel"), F.lit("SCALE"), F.lit(str(s))).alias("header"), F.create_map(F.lit("QUALITY"), F.col("quality")).alias("extensions"))


def write_products(rows: DataFrame, folder: str) -> None:
    """Writes such rows as FITS files of a folder, each by the task that put its image together."""
    from . import fits

    fits.register(rows.sparkSession)
    rows.write.format("fits").mode("append").save(folder)


def from_sentinel(df: DataFrame, *columns: str) -> DataFrame:
    """Foreign tables mark a null by -9999; ours don't."""
    return df.withColumns({c: F.when(F.abs(F.col(c) - SENTINEL) >= 1, F.col(c)) for c in columns})


def summary_text(df: DataFrame, *columns: str) -> str:
    """Least, median and greatest value and number of each column, one line each, from one aggregation."""
    row = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("median", F.median), ("max", F.max), ("n", F.count))]).first()
    show = lambda v: "-" if v is None else f"{v:.6g}"
    return "\n".join(f"{c}: {show(row[f'{c}_min'])} .. {show(row[f'{c}_median'])} .. {show(row[f'{c}_max'])} ({row[f'{c}_n']})" for c in columns)
