"""Queries without SQL go over all frames of the table."""

import numpy as np
import pandas as pd
import pytest

from photonloom import queries
from photonloom.functions import kernels
from photonloom.operators import solver
from photonloom.plans import adapters

FRAMES = 120


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    g = np.random.default_rng(3)
    d = tmp_path_factory.mktemp("tables")
    e = g.normal(0, 0.1, (FRAMES, 64)).astype(np.float32)
    pd.DataFrame({"vec_id": range(FRAMES), "label": [k % 3 for k in range(FRAMES)], "embedding": list(e)}).to_parquet(d / "embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["fit_moffat", "wiener_deconvolve"])
def test_every_frame_has_rows(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).select("frame_id").distinct().toPandas()
    assert sorted(got.frame_id) == list(range(FRAMES))


def test_map_fast_is_of_all_light_frames(spark, folder):
    f = adapters.frames(spark, folder).where("frame_type = 'light'").join(adapters.frame_meta(spark, folder).select("frame_id", "transparency"), "frame_id").orderBy("frame_id").toPandas()
    stack, frames = queries._solver_input(spark, folder)
    whole = [{"t": t, "psf": kernels.gaussian_psf(5, 2.0)} for t in f.transparency]
    px = stack.toPandas()
    a, b = np.zeros((8, 8)), np.zeros((8, 8))
    a[px.y, px.x], b[px.y, px.x] = px.weighted_sum, px.weighted_mean
    assert a == pytest.approx(sum(t * np.reshape(v, (8, 8)) for t, v in zip(f.transparency, f.data)), rel=1e-6)
    want = solver.solve_sum(a, b, whole, queries.SOLVER)
    got = queries.QUERIES["map_fast"](spark, folder).toPandas()
    image = np.zeros((16, 16))
    image[got.y, got.x] = got.flux
    assert len(whole) == FRAMES // 4 and image == pytest.approx(want.image, rel=1e-4)


def test_map_exact_is_of_all_light_frames(spark, folder, monkeypatch):
    seen, solve = [], solver.solve_distributed
    monkeypatch.setattr(solver, "solve_distributed", lambda f, *rest: seen.append(f.count()) or solve(f, *rest))
    assert queries.QUERIES["map_exact"](spark, folder).count() == 256 and seen == [FRAMES // 4]
