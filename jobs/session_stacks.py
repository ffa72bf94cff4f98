"""Stacks of all sessions: masters of the detector, graded and calibrated lights, one weighted stack for each session.

    python -m jobs.session_stacks FRAMES OUTPUT [--config jobs/session_stacks.json] [--sessions 3 4]

FRAMES is a Parquet table of frames (vec_id, embedding, label: number, 64
values, session). OUTPUT gets

    masters/                the detector by pixel
    frames/session=...      each light with its grade: reason is null where it was stacked
    stack/session=...       channel, y, x, weighted_mean, variance, quality, n_frames

Only the sessions asked for are written (by default all of the table), each
in place of its former partition, so a run can be repeated with the same
result, and a failed one is repaired by the next. A session none of whose
lights is fit has no partition in stack. Frames without a number or of other
than 64 values are left out and counted in the log; an empty table writes
nothing but the masters' empty table.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonloom.operators import calibration, stacking
from photonloom.plans import adapters
from photonloom.plans.staging import cut

from .common import log, new_folder, session, settings, write

KEY = ("session", *calibration.PIXEL)
GRADES = "frame_id long, transparency double, fwhm double, sky double, reason string, session int"


@dataclass
class Settings:
    #: Lights wider than this are left out (null: none).
    max_fwhm: float | None = 3.8
    #: Lights dimmer than their session's median by so many robust deviations are left out.
    cloud_sigma: float = 1.5
    #: The sessions to stack (null: all).
    sessions: list[int] | None = None


def whole_frames(table: DataFrame) -> DataFrame:
    return table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") == adapters.SIDE**2))


def run(spark: SparkSession, frames: str, output: str, config: Settings = Settings()) -> DataFrame:
    """Writes OUTPUT and returns its stack, of all sessions that are there."""
    table = spark.read.parquet(frames)
    kept = whole_frames(table)
    counts = table.agg(F.count(F.lit(1)).alias("all")).join(kept.agg(F.count(F.lit(1)).alias("kept"))).first()
    log.info("read %d frames from %s, left out %d", counts["all"], frames, counts["all"] - counts["kept"])
    pixels = adapters.explode_frames(adapters.frames_of(kept))

    write(calibration.fit_all(pixels, keep=cut), f"{output}/masters")
    masters = spark.read.parquet(f"{output}/masters")

    lights = pixels.where("frame_type = 'light'")
    wanted = F.lit(True) if config.sessions is None else F.col("session").isin(config.sessions)
    calibrated = cut(calibration.calibrate(lights.where(wanted), masters), "calibrated")  # for the skies, then for the stack
    sky = calibrated.groupBy("frame_id").agg(F.median("calibrated").alias("sky"))
    meta = adapters.meta_of(kept).where(wanted).drop("sky").join(sky, "frame_id")
    graded = stacking.graded(meta, ("session",), config.cloud_sigma, config.max_fwhm)
    write(graded.select("frame_id", "transparency", "fwhm", "sky", "reason", "session"), f"{output}/frames", "session")

    good = spark.read.schema(GRADES).parquet(f"{output}/frames").where(wanted & F.col("reason").isNull())
    sums = stacking.accumulate(calibrated, good, KEY)
    n = good.groupBy("session").agg(F.count("*").alias("n_frames"))
    top = sums.groupBy("session").agg(F.max("weight_sum").alias("top"))
    mean = F.col("weighted_sum") / F.col("weight_sum")
    stack = sums.where("weight_sum > 0").join(n, "session").join(top, "session").select(
        *calibration.PIXEL, mean.alias("weighted_mean"), F.greatest(F.col("sq_sum") / F.col("weight_sum") - mean * mean, F.lit(0.0)).alias("variance"), (F.col("weight_sum") / F.col("top")).alias("quality"), "n_frames", "session"
    )
    write(stack.repartition("session"), f"{output}/stack", "session")
    return read_back(spark, output)


def read_back(spark: SparkSession, output: str) -> DataFrame:
    schema = "channel string, y int, x int, weighted_mean double, variance double, quality double, n_frames long, session int"
    try:
        return spark.read.schema(schema).parquet(f"{output}/stack")
    except AnalysisException:  # nothing was stacked yet
        return spark.createDataFrame([], schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one folder; the stack as it stands after the second."""
    output = new_folder(spark, "job1-session-stacks")
    for _ in range(2):
        out = run(spark, f"{sf_dir}/embeddings.parquet", output)
    return out.select("session", "y", "x", *[F.round(c, d).alias(c) for c, d in (("weighted_mean", 6), ("variance", 4), ("quality", 6))], "n_frames")


def oracle_sql(masters: str, pixels: str, meta: str) -> str:
    """The same in DuckDB's SQL, on top of the library's views of calibrated lights (cal) and of frames (meta)."""
    s = Settings()
    return f"""WITH {pixels}, {meta}, {masters},
skies AS (SELECT frame_id, median(calibrated) AS sky FROM cal GROUP BY frame_id),
fr AS (SELECT m.frame_id, m.session, m.transparency, m.fwhm, k.sky FROM meta m JOIN skies k USING (frame_id)),
mid AS (SELECT session, median(transparency) AS m, count(*) AS n FROM fr GROUP BY session),
dev AS (SELECT session, any_value(m) AS m, any_value(n) AS n, median(abs(transparency - m)) AS d FROM fr JOIN mid USING (session) GROUP BY session),
good AS (SELECT fr.* FROM fr JOIN dev USING (session) WHERE NOT (n >= 4 AND transparency < m - {s.cloud_sigma} * 1.4826 * d) AND fwhm <= {s.max_fwhm}),
st AS (SELECT g.session, y, x, sum(transparency * (calibrated - sky)) AS ws, sum(transparency) AS w, sum(transparency * (calibrated - sky) * (calibrated - sky)) AS sq FROM cal JOIN good g USING (frame_id) GROUP BY g.session, y, x),
nf AS (SELECT session, count(*) AS n_frames FROM good GROUP BY session)
SELECT session, y, x, round(ws / w, 6) AS weighted_mean, round(greatest(sq / w - (ws / w) * (ws / w), 0), 4) AS variance, round(w / max(w) OVER (PARTITION BY session), 6) AS quality, n_frames FROM st JOIN nf USING (session)"""


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Stacks the lights of each session of a table of frames.")
    p.add_argument("frames")
    p.add_argument("output")
    p.add_argument("--config")
    p.add_argument("--sessions", nargs="*", type=int)
    p.add_argument("--max-fwhm", type=float)
    a = p.parse_args(argv)
    config = settings(Settings, a.config, sessions=a.sessions, max_fwhm=a.max_fwhm)
    spark = session("photonloom-session-stacks", f"{a.output}/_staging")
    try:
        run(spark, a.frames, a.output, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
