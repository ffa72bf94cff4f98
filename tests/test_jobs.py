"""The jobs: the same rows as their SQL, safe to run again, only what is new taken, their command lines."""

import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import detector_watch, session_stacks
from jobs.common import settings
from photonloom import queries

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
FRAME = "vec_id long, embedding array<float>, label int, note string"


def made(n, sessions=3, seed=1):
    g = random.Random(seed)
    return [(i, [g.gauss(0, 1) for _ in range(64)], g.randrange(sessions), "x") for i in range(n)]


ODD = [(None, [0.0] * 64, 1, "x"), (9001, None, 1, "x"), (9002, [0.0] * 3, 1, "x"), (9003, [0.0] * 64, None, "x"), (9005, [], 2, "x")]


@pytest.fixture()
def frames(spark, tmp_path):
    path = str(tmp_path / "frames")
    spark.createDataFrame(made(160) + ODD, FRAME).repartition(3).write.parquet(path)
    return path


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("job", [session_stacks, detector_watch])
def test_same_rows_as_sql(spark, job):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    sql = session_stacks.oracle_sql(queries.CAL, queries.SQL["px"], queries.SQL["meta"]) if job is session_stacks else detector_watch.oracle_sql(queries.SQL["px"])
    want = con.sql(sql).df()
    got = job.query(spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    as_rows = lambda d: sorted(map(str, d[columns].astype(str).itertuples(index=False, name=None)))
    assert as_rows(got) == as_rows(want) and len(got) > 500


# stacks ------------------------------------------------------------------------


def test_stacks_again_are_the_same(spark, frames, tmp_path):
    out = str(tmp_path / "out")
    first = rows(session_stacks.run(spark, frames, out))
    assert first and rows(session_stacks.run(spark, frames, out)) == first
    seen = spark.read.parquet(f"{out}/frames")
    assert seen.count() == 40 and {r.reason for r in seen.select("reason").distinct().collect()} <= {None, "cloud", "blur"}


def test_one_session_alone(spark, frames, tmp_path):
    """Other sessions' partitions stay as they are, and what is written is what a whole run writes."""
    out = str(tmp_path / "out")
    whole = rows(session_stacks.run(spark, frames, out))
    before = {p: t for p, t in files(f"{out}/stack").items() if "session=1" not in p}
    assert rows(session_stacks.run(spark, frames, out, session_stacks.Settings(sessions=[1]))) == whole
    after = files(f"{out}/stack")
    assert before and all(after.get(p) == t for p, t in before.items())
    alone = session_stacks.run(spark, frames, str(tmp_path / "alone"), session_stacks.Settings(sessions=[1]))
    assert rows(alone) == [r for r in whole if r[sorted(alone.columns).index("session")] == 1]


def test_stack_of_plain_loops(spark, frames, tmp_path):
    out = str(tmp_path / "out")
    got = {(r.session, r.y, r.x): r for r in session_stacks.run(spark, frames, out).collect()}
    good = {r.frame_id: r for r in spark.read.parquet(f"{out}/frames").where("reason IS NULL").collect()}
    masters = {(r.y, r.x): r for r in spark.read.parquet(f"{out}/masters").collect()}
    for s in range(3):
        mine = [(good[i], v) for i, v, label, _ in made(160) if label == s and i in good]
        for k in (0, 9, 63):
            m = masters[k // 8, k % 8]
            value = lambda v: 300.0 + 40.0 * _single(v[k]) - m.bias_mean - m.dark_rate * 600.0  # noqa: E731, B023
            gain = m.flat_gain if m.flat_gain > 0.01 else 1.0
            mean = sum(f.transparency * (value(v) / gain - f.sky) for f, v in mine) / sum(f.transparency for f, _ in mine)
            assert got[s, k // 8, k % 8].weighted_mean == pytest.approx(mean, abs=1e-6)
            assert got[s, k // 8, k % 8].n_frames == len(mine)


def _single(x):
    import numpy as np

    return float(np.float32(x))


def test_stacks_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame(ODD, FRAME).write.parquet(path)
    assert session_stacks.run(spark, path, str(tmp_path / "out")).count() == 0


# posteriors --------------------------------------------------------------------


def add(spark, data, path):
    spark.createDataFrame(data, FRAME).coalesce(1).write.mode("append").parquet(path)


def test_only_what_is_new(spark, tmp_path):
    """Two runs over growing input: the second reads the new file alone, and the posteriors are those of one run over all."""
    path, out, mark = (str(tmp_path / n) for n in ("frames", "out", "checkpoint"))
    data = made(200) + ODD
    add(spark, data[:120], path)
    first = rows(detector_watch.run(spark, path, out, mark))
    assert {r[0] for r in spark.read.parquet(f"{out}/sums").select("batch").distinct().collect()} == {0}
    add(spark, [r for r in data[120:] if r[2] in (0, 1)], path)  # nothing new of session 2
    untouched = {p: t for p, t in files(f"{out}/posterior").items() if "session=2" in p}
    second = detector_watch.run(spark, path, out, mark)
    n = spark.read.parquet(f"{out}/sums").groupBy("batch").agg(F.sum("n_bias")).orderBy("batch").collect()
    assert [r[0] for r in n] == [0, 1]
    after = files(f"{out}/posterior")
    assert untouched and all(after.get(p) == t for p, t in untouched.items())
    assert rows(second) != first
    whole = detector_watch.run(spark, path, str(tmp_path / "whole"), str(tmp_path / "whole-mark"))
    assert rows(second) == rows(whole)
    assert rows(detector_watch.run(spark, path, out, mark)) == rows(second)  # nothing new


def test_file_by_file_and_repeated_batch(spark, tmp_path):
    """One file a batch gives the same; a batch done again after a failure counts once."""
    path, out, mark = (str(tmp_path / n) for n in ("frames", "out", "checkpoint"))
    for k in range(3):
        add(spark, made(60, seed=k + 1), path)
    config = detector_watch.Settings(files_per_batch=1)
    got = rows(detector_watch.run(spark, path, out, mark, config))
    assert rows(detector_watch.run(spark, path, str(tmp_path / "one"), str(tmp_path / "one-mark"))) == got
    # the last batch's commit is lost: it is planned, its partitions are there, and it runs again
    last = max(Path(mark, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    Path(last.parent, f".{last.name}.crc").unlink(missing_ok=True)
    assert rows(detector_watch.run(spark, path, out, mark, config)) == got


def test_posteriors_of_nothing(spark, tmp_path):
    path = str(tmp_path / "frames")
    add(spark, ODD, path)
    assert detector_watch.run(spark, path, str(tmp_path / "out"), str(tmp_path / "mark")).count() == 0


# settings and command lines ------------------------------------------------------


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"max_fwhm": 2.5}))
    assert settings(session_stacks.Settings, str(p), sessions=[1]) == session_stacks.Settings(max_fwhm=2.5, sessions=[1])
    p.write_text(json.dumps({"maxfwhm": 2.5}))
    with pytest.raises(ValueError):
        settings(session_stacks.Settings, str(p))
    for job in (session_stacks, detector_watch):  # the files beside the jobs state the defaults
        assert settings(job.Settings, str(ROOT / "jobs" / f"{job.__name__.split('.')[-1]}.json")) == job.Settings()


@pytest.mark.parametrize("job, extra", [("session_stacks", []), ("detector_watch", ["mark"])])
def test_command_line(spark, frames, tmp_path, job, extra):
    args = [sys.executable, "-m", f"jobs.{job}", frames, str(tmp_path / "out"), *[str(tmp_path / e) for e in extra], "--config", str(ROOT / "jobs" / f"{job}.json")]
    done = subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and "read" in done.stderr
    written = spark.read.parquet(str(tmp_path / "out" / ("stack" if job == "session_stacks" else "posterior")))
    assert written.count() > 0
