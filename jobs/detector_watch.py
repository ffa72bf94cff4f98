"""The detector's posteriors, kept up to date while calibration frames arrive.

    python -m jobs.detector_watch FRAMES OUTPUT CHECKPOINT [--config jobs/detector_watch.json]

FRAMES is a folder of Parquet files of frames (vec_id, embedding, label), or a
pattern of such folders and files, that grows. A file stream with a checkpoint takes only the files that are new. Each
micro-batch's bias and dark frames become sums by session and pixel, in a
partition of their own that a repeated batch replaces; then the posteriors of
the sessions that the batch touches are written anew from all their sums:

    sums/session=.../batch=...      what each batch adds
    posterior/session=...           channel, y, x, param, p1, p2, n, estimate

The sums don't depend on order or grouping, so however the files arrive, in how
many runs and batches, and whatever fails between, the posteriors are those of
all frames. Rows without a number or of other than 64 values are left out;
frames that occur twice count twice; without new files a run changes nothing.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonloom.operators import bayes
from photonloom.operators.calibration import PIXEL
from photonloom.plans import adapters

from .common import log, new_folder, session, settings, write
from .session_stacks import whole_frames

KEY = ("session", *PIXEL)
FRAME = "vec_id long, embedding array<float>, label int"
SUMS = "channel string, y int, x int, n_bias long, bias_sum double, bias_sq double, n_dark long, dark_counts double, dark_seconds double, session int, batch long"
POSTERIOR = "channel string, y int, x int, param string, p1 double, p2 double, n long, estimate double, session int"


@dataclass
class Settings:
    #: The bias that dark frames are known to have.
    pedestal: float = 300.0
    #: The noise of one reading, as the bias's posterior takes it.
    sigma: float = 6.0
    #: New files taken in one micro-batch.
    files_per_batch: int = 64


def run(spark: SparkSession, frames: str, output: str, checkpoint: str, config: Settings = Settings()) -> DataFrame:
    """Takes what is new in FRAMES, waits for the stream to end, and returns the posteriors of all sessions."""
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", config.files_per_batch).parquet(frames)

    def add(batch: DataFrame, number: int) -> None:
        session_ = batch.sparkSession
        log.info("batch %d: read %d new frames from %s", number, batch.count(), frames)
        pixels = adapters.explode_frames(adapters.frames_of(whole_frames(batch)))
        sums = bayes.frame_sums(pixels, config.pedestal, KEY).withColumn("batch", F.lit(number).cast("long"))
        if not write(sums.repartition("session"), f"{output}/sums", "session", "batch"):
            return
        all_sums = session_.read.schema(SUMS).parquet(f"{output}/sums")
        touched = all_sums.where(F.col("batch") == number).select("session").distinct()
        parts = all_sums.join(touched, "session", "left_semi")
        state = bayes.state_of_sums(bayes.add_sums(parts, KEY), config.sigma, config.pedestal, by=KEY)
        write(state.select(*[c.split()[0] for c in POSTERIOR.split(", ")]).repartition("session"), f"{output}/posterior", "session")

    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return read_back(spark, output)


def read_back(spark: SparkSession, output: str) -> DataFrame:
    try:
        return spark.read.schema(POSTERIOR).parquet(f"{output}/posterior")
    except AnalysisException:  # no calibration frame has come yet
        return spark.createDataFrame([], POSTERIOR)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one folder and checkpoint; the posteriors as they stand after the second."""
    folder = new_folder(spark, "job2-detector-watch")
    table = f"{sf_dir}/embeddings.parque[t]"  # a stream takes a table of one file by a pattern alone
    for _ in range(2):
        out = run(spark, table, f"{folder}/out", f"{folder}/checkpoint")
    return out.select("session", "y", "x", "param", *[F.round(c, d).alias(c) for c, d in (("p1", 6), ("p2", 4), ("estimate", 6))], "n")


def oracle_sql(pixels: str) -> str:
    """The same in DuckDB's SQL, over all frames at once."""
    s, start = Settings(), bayes.Priors().start()
    v, var = f"(adu - {s.pedestal})", s.sigma**2
    lit = lambda x: f"{x!r}::DOUBLE"
    return f"""WITH {pixels},
b AS (SELECT session, y, x, count(*) AS n, {lit(start['bias'][0])} + count(*) / {var}::DOUBLE AS p, {lit(start['bias'][1])} + sum(adu) / {var}::DOUBLE AS q FROM px WHERE frame_type = 'bias' GROUP BY session, y, x),
rn AS (SELECT b.session, b.y, b.x, b.n, {lit(float(start['read_noise'][0]))} + 0.5 * b.n AS p, any_value({lit(start['read_noise'][1])}) + 0.5 * sum((adu - b.q / b.p) ** 2) AS q FROM b JOIN px ON px.session = b.session AND px.y = b.y AND px.x = b.x AND frame_type = 'bias' GROUP BY b.session, b.y, b.x, b.n),
d AS (SELECT session, y, x, count(*) AS n, {lit(float(start['dark'][0]))} + sum(greatest({v}, 0)) AS p, {lit(start['dark'][1])} + sum(t) AS q FROM px WHERE frame_type = 'dark' GROUP BY session, y, x),
u AS (SELECT session, y, x, 'bias' AS param, p, q, q / p AS e, n FROM b UNION ALL SELECT session, y, x, 'read_noise', p, q, sqrt(q / (p - 1)), n FROM rn UNION ALL SELECT session, y, x, 'dark', p, q, p / q, n FROM d)
SELECT session, y, x, param, round(p, 6) AS p1, round(q, 4) AS p2, round(e, 6) AS estimate, n FROM u"""


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Takes new calibration frames into the detector's posteriors.")
    p.add_argument("frames")
    p.add_argument("output")
    p.add_argument("checkpoint")
    p.add_argument("--config")
    a = p.parse_args(argv)
    config = settings(Settings, a.config)
    spark = session("photonloom-detector-watch", f"{a.output}/_staging")
    try:
        run(spark, a.frames, a.output, a.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
