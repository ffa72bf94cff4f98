"""Centroid clustering against plain loops, its SQL, and its edge cases."""

import hashlib
import math
import os
import random

import numpy as np
import pytest

from photonloom.llm import centroids

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, k=16, rounds=3):
    """The contract in plain loops over Python's integers."""
    kept = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [list(v) for _, v in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        label = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, label) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    long = lambda v: v if v < 1 << 63 else None
    return sorted(((i, j, long(d), long(sum(e for _, e, q in found if q == j)), long(total), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def made(n, seed=3, spread=1.0):
    g = random.Random(seed)
    middles = [[g.gauss(0, 2) for _ in range(64)] for _ in range(12)]
    return [(i, [float(np.float32(g.gauss(m, spread))) for m in middles[i % 12]]) for i in range(n)]


@pytest.mark.parametrize("rows", [made(300), made(300, spread=0.0), made(7), [(5, [0.25] * 64)] * 40 + made(40)], ids=["blobs", "ties", "fewer than centroids", "repeated rows"])
def test_equals_plain_loops(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    assert rows_of(centroids.cluster(df)) == plain(rows)


def test_rows_that_are_left_out(spark):
    v = [1.0] * 64
    odd = [(900, None), (901, []), (902, v[:63]), (903, [*v, 1.0]), (904, [*v[:63], None]), (905, [*v[:63], float("nan")]), (906, [*v[:63], float("inf")]), (907, [*v[:63], -3e38])]
    rows = made(60) + [(None, v), (908, [-0.01] * 64)]
    df = spark.createDataFrame([(i, x, "x") for i, x in rows + odd], SCHEMA)
    assert rows_of(centroids.cluster(df)) == plain(rows)
    assert centroids.cluster(df.limit(0)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(i, x, "x") for i, x in odd], SCHEMA)).collect() == []


def test_integers_of_any_size(spark):
    """Distances beyond 64 bits are worked out exactly, and null where no long holds them."""
    rows = made(40) + [(100 + i, [x * 10.0**i for x in v]) for i, v in made(16, seed=9)]
    df = spark.createDataFrame([(i, x, "x") for i, x in rows], SCHEMA)
    got = rows_of(centroids.cluster(df))
    assert got == plain(rows) and any(r[4] is None for r in got)


def test_gives_up_only_what_is_strictly_farther():
    g = np.random.default_rng(1)
    x = g.integers(-3, 4, (500, 64))
    model = centroids.Centroids([list(map(int, r)) for r in g.integers(-3, 4, (16, 64))] + [list(map(int, x[0]))] * 2, list(g.permutation(64)))
    label, d = model.nearest(x)
    far = ((x[:, None, :] - np.array(model.rows)[None]) ** 2).sum(axis=2)
    assert (label == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()


def test_dimensions_in_order_of_variance(spark):
    g = np.random.default_rng(2)
    wide = g.permutation(64)
    rows = [(i, [float(v) for v in g.normal(0, 1, 64) * (wide + 1)]) for i in range(400)]
    kept = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select(centroids.integers(centroids.F.col("embedding"), 64, 64).alias("v"))
    ints = np.array([[math.floor(64 * float(np.float32(x))) for x in v] for _, v in rows], dtype=object)
    spread = [len(rows) * (ints[:, i] ** 2).sum() - ints[:, i].sum() ** 2 for i in range(64)]
    assert centroids.variance_order(kept, 64) == sorted(range(64), key=lambda i: (-spread[i], i))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_equals_its_sql(spark):
    import duckdb

    from photonloom.llm.queries import op11_centroids

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.sql(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({centroids.oracle_sql()})").fetchall(), key=str)
    got = rows_of(op11_centroids(spark, SF))
    assert got == want and len(got) > 100
