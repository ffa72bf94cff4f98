"""Image-shaped views of the relational tables, in plain expressions that any SQL engine can repeat.

An embedding of 64 numbers is an 8 x 8 frame; its label is the session, and
vec_id orders the frames. lineitem gives samples of many pixels (parts) at
varying exposure (quantity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8
EXPOSURES = [60.0, 120.0, 300.0, 600.0]
TYPES = ["bias", "dark", "flat", "light"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_number(i: Column) -> dict[str, Column]:
    """What a frame's number says of it."""
    return {
        "frame_type": F.get(F.array(*map(F.lit, TYPES)), (i % 4).cast("int")),
        "exposure_s": F.get(F.array(*map(F.lit, EXPOSURES)), (i % 4).cast("int")),
    }


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame: frame_id, seq, session, frame_type, exposure_s, h, w, data (row-major)."""
    return frames_of(table(spark, sf_dir, "embeddings"))


def frames_of(embeddings: DataFrame) -> DataFrame:
    """The frames of a table or stream of embeddings."""
    e = embeddings.select(F.col("vec_id").alias("frame_id"), F.col("vec_id").alias("seq"), F.col("label").alias("session"), F.transform("embedding", lambda v: 300.0 + 40.0 * v.cast("double")).alias("data"))
    return e.withColumns({**frame_number(F.col("frame_id")), "h": F.lit(SIDE), "w": F.lit(SIDE)})


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel of a frame: frame_id, seq, session, frame_type, exposure_s, channel, y, x, adu."""
    return explode_frames(frames(spark, sf_dir))


def explode_frames(df: DataFrame) -> DataFrame:
    """frames in the long form; channel is L until the frames are split by colour."""
    rest = [c for c in df.columns if c not in ("data", "h", "w")]
    p = df.select(*rest, "w", F.posexplode("data").alias("at", "adu"))
    return p.select(*rest, F.lit("L").alias("channel"), (F.col("at") / F.col("w")).cast("int").alias("y"), (F.col("at") % F.col("w")).alias("x"), "adu")


def frame_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame: frame_id, session, transparency, fwhm, sky, dx, dy, rotation."""
    return meta_of(table(spark, sf_dir, "embeddings"))


def meta_of(embeddings: DataFrame) -> DataFrame:
    i = F.col("vec_id")
    return embeddings.select(i.alias("frame_id"), F.col("label").alias("session"), *[c.alias(n) for n, c in frame_facts(i).items()])


def frame_facts(i: Column) -> dict[str, Column]:
    """What a frame's number says of its quality and place."""
    return {
        "transparency": 0.5 + ((i * 37) % 100) / 200.0, "fwhm": 2.0 + ((i * 13) % 50) / 25.0, "sky": F.lit(290.0),
        "dx": ((i * 7) % 21) / 10.0 - 1.0, "dy": ((i * 11) % 21) / 10.0 - 1.0, "rotation": (i * 17) % 360 - 180.0,
    }


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one-dimensional pixels: pixel, exposure_s, adu."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pixel"), F.col("l_quantity").alias("exposure_s"), F.col("l_extendedprice").alias("adu"))


def star_catalogue(spark: SparkSession, sf_dir: str, per_frame: int = 50) -> DataFrame:
    """Stars from the parts: frame_id, star_rank, y, x, flux; per_frame stars in a field of 512 x 512."""
    k = F.col("p_partkey")
    frame, rank = F.floor(k / per_frame).alias("frame_id"), (k % per_frame).alias("star_rank")
    return table(spark, sf_dir, "part").select(frame, rank, ((k * 193) % 509 + (k % 7) / 7.0).alias("y"), ((k * 389) % 503 + (k % 11) / 11.0).alias("x"), F.col("p_retailprice").alias("flux"))


#: The same views in DuckDB's SQL.
SQL = {
    "px": "px AS (SELECT vec_id AS frame_id, label AS session, ['bias','dark','flat','light'][vec_id % 4 + 1] AS frame_type, [60.0,120.0,300.0,600.0][vec_id % 4 + 1]::DOUBLE AS t, (i // 8)::INT AS y, (i % 8)::INT AS x, 300.0 + 40.0 * embedding[i + 1]::DOUBLE AS adu FROM (SELECT *, unnest(range(64)) AS i FROM embeddings))",
    "meta": "meta AS (SELECT vec_id AS frame_id, label AS session, 0.5 + ((vec_id * 37) % 100) / 200.0::DOUBLE AS transparency, 2.0 + ((vec_id * 13) % 50) / 25.0::DOUBLE AS fwhm, 290.0::DOUBLE AS sky, ((vec_id * 7) % 21) / 10.0::DOUBLE - 1.0::DOUBLE AS dx, ((vec_id * 11) % 21) / 10.0::DOUBLE - 1.0::DOUBLE AS dy, ((vec_id * 17) % 360 - 180)::DOUBLE AS rotation FROM embeddings)",
    "smp": "smp AS (SELECT l_partkey AS pixel, l_quantity AS t, l_extendedprice AS adu FROM lineitem)",
    "star": "star AS (SELECT p_partkey // 50 AS frame_id, p_partkey % 50 AS star_rank, ((p_partkey * 193) % 509 + (p_partkey % 7) / 7.0::DOUBLE)::DOUBLE AS y, ((p_partkey * 389) % 503 + (p_partkey % 11) / 11.0::DOUBLE)::DOUBLE AS x, p_retailprice AS flux FROM part)",
}
