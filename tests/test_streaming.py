"""What streams add up to is what the batch gives."""

import pytest
from pyspark.sql import functions as F

from photonloom.operators import stacking
from photonloom.streaming import live

SCHEMA = "frame_id long, channel string, y int, x int, calibrated double, sky double, transparency double"


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(k, "L", y, x, float(k + y * x), 0.5, 0.5 + k / 10) for k in range(6) for y in range(3) for x in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        df.where(F.col("frame_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path, df


def test_batches_add_up(spark, folder):
    path, df = folder
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    q = live.accumulate_batches(stream, str(path / "stack"), str(path / "ck"), 1)
    q.awaitTermination()
    got = live.version(spark, str(path / "stack"), 99)
    want = live.live_sums(df)
    key = lambda d: sorted((r.channel, r.y, r.x, round(r.weighted_sum, 9), round(r.sq_sum, 9)) for r in d.collect())
    assert key(got) == key(want)


def test_complete_mode(spark, folder):
    path, df = folder
    stream = spark.readStream.schema(SCHEMA).parquet(str(path / "in"))
    q = live.live_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sums").agg(F.round(F.sum("weighted_sum"), 6)).first() == live.live_sums(df).agg(F.round(F.sum("weighted_sum"), 6)).first()


def test_canvas_is_fixed_before_the_first_frame(spark, folder):
    _, df = folder
    c = live.Canvas()
    c.fix(4, 4, 1, 1)
    moved = df.withColumns({"dy": F.lit(0.0), "dx": F.lit(0.0)})
    assert live.live_sums(moved, c).count() == 9
    with pytest.raises(RuntimeError):
        c.fix(5, 5)


def test_carried_psf(spark, tmp_path):
    rows = [("a", 0, 3.5, 20), ("a", 1, 9.0, 2), ("a", 2, 4.0, 20), ("b", 0, 1.0, 1)]
    schema = "session string, frame_id long, fwhm double, n_stars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.carry_psf(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("psf").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.session, r.frame_id): r.fwhm_used for r in spark.table("psf").collect()}
    assert got == {("a", 0): 3.5, ("a", 1): 3.5, ("a", 2): 4.0, ("b", 0): 3.0}


def test_sessions_and_remaining(spark):
    e = spark.sql("SELECT 1 AS user_id, timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, m) AS ts FROM VALUES (0), (10), (50) t(m)")
    assert sorted(r.n for r in live.exposure_sessions(e).collect()) == [1, 2]
    a = spark.range(5).withColumnRenamed("id", "frame_id")
    assert stacking.remaining(a, a.where("frame_id < 3")).count() == 2
