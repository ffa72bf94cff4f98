"""Stacks that grow while frames arrive: the batch aggregates over a stream of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stacking
from ..operators.calibration import PIXEL


class Canvas:
    """The canvas has to be fixed before the first frame, as it decides where pixels go."""

    def __init__(self) -> None:
        self.size: tuple[int, int, int, int] | None = None
        self.started = False

    def fix(self, rows: int, cols: int, row0: int = 0, col0: int = 0) -> None:
        if self.started:
            raise RuntimeError("the canvas can't change once frames have been added")
        self.size = (rows, cols, row0, col0)


def live_sums(stream: DataFrame, canvas: Canvas | None = None) -> DataFrame:
    """The four sums by pixel of a stream of calibrated pixels that carry transparency, sky and, for a canvas, dy and dx."""
    if canvas is not None and canvas.size is not None:
        canvas.started = True
        rows, cols, row0, col0 = canvas.size
        y, x = F.col("y") + row0 + F.round("dy").cast("int"), F.col("x") + col0 + F.round("dx").cast("int")
        stream = stream.withColumns({"y": y, "x": x}).where((F.col("y") >= 0) & (F.col("y") < rows) & (F.col("x") >= 0) & (F.col("x") < cols))
    return stream.groupBy(*PIXEL).agg(*stacking.stack_terms(F.col("calibrated"), F.col("sky"), F.col("transparency")))


def accumulate_batches(stream: DataFrame, folder: str, checkpoint: str, partitions: int = 0):
    """A query that adds each micro-batch to the stack in folder; a batch that is repeated after a failure counts once.

    Versions are folders named by batch; a batch's version is the one before
    it and its own sums, so doing it again writes the same rows.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sums = live_sums(batch)
        before = version(spark, folder, number - 1)
        out = sums if before is None else stacking.merge(before, sums)
        (out.coalesce(partitions) if partitions else out).write.mode("overwrite").parquet(f"{folder}/v{number:09d}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """The newest stack of that batch or an earlier one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = sorted(n for n in names if n.startswith("v") and n[1:].isdigit() and int(n[1:]) <= number and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))
    return spark.read.parquet(f"{folder}/{done[-1]}") if done else None


def exposure_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of exposures by target: a stream with a watermark; times without a zone are taken as UTC."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return s.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def carry_psf(stream: DataFrame, min_stars: int = 8, default_fwhm: float = 3.0) -> DataFrame:
    """stream(session, frame_id, fwhm, n_stars) with the fwhm in use: a frame with too few stars takes its session's last good one, or the default.

    State is one number per session. A micro-batch's frames of a session go in
    order of frame_id, however many there are; they are short rows.
    """

    def step(key, batches, state):
        import pandas as pd

        last = state.get[0] if state.exists else default_fwhm
        for pdf in [pd.concat(list(batches)).sort_values("frame_id")]:
            used = []
            for f, n in zip(pdf.fwhm, pdf.n_stars):
                if n >= min_stars and f == f:
                    last = float(f)
                used.append(last)
            yield pd.DataFrame({"session": pdf.session, "frame_id": pdf.frame_id, "fwhm_used": used})
        state.update((last,))

    kinds = dict(stream.dtypes)
    out = f"session {kinds['session']}, frame_id {kinds['frame_id']}, fwhm_used double"
    return stream.groupBy("session").applyInPandasWithState(step, out, "fwhm double", "append", "NoTimeout")
