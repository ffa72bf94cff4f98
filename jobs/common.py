"""What the jobs share: settings, logging of what is read and written, the command line's session."""

from __future__ import annotations

import dataclasses
import json
import logging
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("photonloom.jobs")


def settings(kind, path: str | None, **given):
    """The dataclass `kind` from a JSON file, with what the command line gives on top; unknown names are an error."""
    read = json.load(open(path, encoding="utf-8")) if path else {}
    unknown = set(read) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return kind(**read | {k: v for k, v in given.items() if v is not None})


def write(df: DataFrame, path: str, *partitions: str) -> int:
    """Writes Parquet partitions in place of those of the same names, leaves all others, and logs and returns the number of rows."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if partitions:
        out = out.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic")
    out.parquet(path)
    rows = seen.get["rows"]
    log.info("wrote %d rows to %s", rows, path)
    return rows


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under spark.checkpoint.dir; a local master that has none set gets a temporary one."""
    from photonloom.plans.staging import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def session(name: str, staging: str) -> SparkSession:
    """A session for a command line; what is cut from its plans goes to the output's folder unless the cluster names one."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        spark.conf.set("spark.checkpoint.dir", staging)
    return spark
