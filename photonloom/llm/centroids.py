"""Centroid clustering over integer vectors with partial-distance search.

Each round is one narrow pass over the table: tasks assign their vectors and
hand on one row of sums for each centroid. A vector's distance to a centroid
is added up over groups of dimensions, those of the greatest variance over the
whole table first; once a partial sum is strictly above the least distance so
far, the centroid is given up for that vector. Survivors finish all dimensions,
so nothing is approximate.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below it, squared distances over 64 dimensions add up in 64 bits; beyond, Python's integers take over.
SMALL = 1 << 27
LONG = 1 << 63


def integers(vector: Column, scale: int, dims: int) -> Column:
    """floor(scale * x) of each component as long; null where the vector isn't one of dims finite components whose integers are longs."""
    y = F.transform(vector, lambda x: x.cast("double") * scale)
    fit = F.forall(y, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= float(-LONG)) & (v < float(LONG)))
    return F.when((F.size(vector) == dims) & fit, F.transform(y, lambda v: F.floor(v)))


@dataclass
class Centroids:
    """Centroids as exact integers, the order of dimensions, and how many dimensions are compared at a time."""

    rows: list[list[int]]
    order: list[int]
    step: int = 8

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row, and the squared distance (ties: the smaller number)."""
        exact = max((abs(v) for c in self.rows for v in c), default=0) >= SMALL or (x.size and max(abs(int(x.min())), abs(int(x.max()))) >= SMALL)
        kind = object if exact else np.int64
        x, c = x[:, self.order].astype(kind), np.array(self.rows, dtype=kind)[:, self.order]
        best, label = np.zeros(len(x), kind), np.zeros(len(x), np.int32)
        for k in range(len(c)):
            rows, part = np.arange(len(x)), np.zeros(len(x), kind)
            for at in range(0, x.shape[1], self.step):
                d = x[rows, at : at + self.step] - c[k, at : at + self.step]
                part = part + (d * d).sum(axis=1)
                if k:
                    still = part <= best[rows]
                    if not still.all():
                        rows, part = rows[still], part[still]
                if not len(rows):
                    break
            closer = slice(None) if not k else part < best[rows]
            best[rows[closer]], label[rows[closer]] = part[closer], k
        return label, best

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[k])).encode()).hexdigest()


def vectors_of(batch, column: str, dims: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(-1, dims) if batch.num_rows else np.zeros((0, dims), np.int64)


def totals(kept: DataFrame, dims: int, add) -> dict[int, list[int]]:
    """Sums over all vectors by group: add(x) gives (group, whole numbers) rows of a batch; a task hands on one row a group, which Spark adds up."""
    width = len(add(np.zeros((0, dims), np.int64), None))
    names = [f"s{i}" for i in range(width)]

    def run(batches):
        sums: dict[int, list[int]] = {}
        for batch in batches:
            found: dict[int, list[int]] = {}
            add(vectors_of(batch, "v", dims), found)
            for g, values in found.items():
                sums[g] = [a + b for a, b in zip(sums[g], values)] if g in sums else values
        if sums:
            columns = [pa.array([Decimal(sums[g][i]) for g in sums], pa.decimal128(38, 0)) for i in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *columns], names=["g", *names])

    parts = kept.select("v").mapInArrow(run, "g int, " + ", ".join(f"{n} decimal(38,0)" for n in names))
    rows = parts.groupBy("g").agg(*[F.sum(n).alias(n) for n in names]).collect()  # one row a group
    return {r.g: [int(r[n]) for n in names] for r in rows}


def whole_sums(x: np.ndarray) -> list[int]:
    """Exact sums by column."""
    if x.size and max(abs(int(x.min())), abs(int(x.max()))) >= SMALL:
        return [int(v) for v in x.astype(object).sum(axis=0)]
    return [int(v) for v in x.sum(axis=0)]


def variance_order(kept: DataFrame, dims: int) -> list[int]:
    """The dimensions in descending variance over the whole table, exactly; ties: the smaller number first."""

    def add(x, out):
        if out is None:
            return [0] * (2 * dims + 1)
        if len(x):
            big = max(abs(int(x.min())), abs(int(x.max()))) >= 1 << 20
            # components beyond 2^40 are all of great variance, and their squares aren't needed to the last digit
            y = np.clip(x, -(1 << 40), 1 << 40).astype(object) if big else x
            out[0] = [len(x), *[int(v) for v in y.sum(axis=0)], *[int(v) for v in (y * y).sum(axis=0)]]
        return None

    found = totals(kept, dims, add)
    if not found:
        return list(range(dims))
    n, *rest = found[0]
    spread = [n * rest[dims + i] - rest[i] ** 2 for i in range(dims)]
    return sorted(range(dims), key=lambda i: (-spread[i], i))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", seed: str = "1:", step: int = 8) -> DataFrame:
    """id_col with cluster, distance, cluster_inertia, inertia and centroid_sha256, a row for each vector that is kept.

    Kept are vectors of exactly `dims` components, none null or non-finite, whose
    integers floor(scale * x) are longs; null vectors go. The first centroids are
    the k kept vectors of least sha256 of seed and id (null id: the seed alone;
    ids that tie: the lesser vector first); with fewer vectors there are fewer
    centroids. Repeated rows count as often as they occur, and may be centroids
    more than once; a vector as near to several centroids goes to the least
    number. A centroid without vectors stays where it is. Distances and sums
    that no long holds are null. An empty table gives no rows; columns of other
    names are left out.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(f"`{id_col}`").alias("id"), integers(F.col(f"`{vector_col}`"), scale, dims).alias("v"))
    kept = named.where("v IS NOT NULL")
    first = kept.select(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("at"), "v").orderBy("at", "v").limit(k)
    now = Centroids([list(r.v) for r in first.collect()], variance_order(kept, dims), step)
    for _ in range(rounds if now.rows else 0):
        model = spark.sparkContext.broadcast(now)  # k vectors

        def add(x, out, model=model):
            if out is None:
                return [0] * (dims + 1)
            label, _ = model.value.nearest(x)
            for g in np.unique(label):
                mine = x[label == g]
                out[int(g)] = [len(mine), *whole_sums(mine)]
            return None

        sums = totals(kept, dims, add)
        now = Centroids([[s // sums[j][0] for s in sums[j][1:]] if j in sums else c for j, c in enumerate(now.rows)], now.order, step)
    model = spark.sparkContext.broadcast(now)

    def inertia(x, out):
        if out is None:
            return [0]
        label, d = model.value.nearest(x)
        for g in np.unique(label):
            out[int(g)] = [int(d[label == g].astype(object).sum())]
        return None

    within = {g: s[0] for g, s in totals(kept, dims, inertia).items()} if now.rows else {}
    all_ = sum(within.values())
    fits = lambda v: v if v < LONG else None
    digests = [now.digest(j) for j in range(len(now.rows))]

    def assign(batches):
        for batch in batches:
            label, d = model.value.nearest(vectors_of(batch, "v", dims))
            inner = [fits(within[int(g)]) for g in label]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(label, pa.int32()), pa.array([fits(int(v)) for v in d], pa.int64()), pa.array(inner, pa.int64()), pa.array([fits(all_)] * len(label), pa.int64()), pa.array([digests[g] for g in label], pa.string())],
                names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    kind = dict(named.dtypes)["id"]
    out = kept.mapInArrow(assign, f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.withColumnRenamed("id", id_col)


def oracle_sql(k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> str:
    """The same in DuckDB's SQL over the table embeddings; each round is a step of joins."""
    far = f"list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, {dims + 1})])"
    parts = [
        f"raw AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings WHERE len(embedding) = {dims})",
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [floor({scale} * x)::BIGINT FOR x IN e] AS v FROM raw WHERE len([x FOR x IN e IF x IS NOT NULL AND isfinite(x)]) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v AS c FROM kept QUALIFY k < {k})",
    ]
    near = f"SELECT row, arg_min(k, d * {k} + k) AS k, min(d) AS d FROM (SELECT row, k, {far}::HUGEINT AS d FROM kept, c{{j}}) GROUP BY row"
    for j in range(rounds):
        parts += [
            f"a{j} AS MATERIALIZED ({near.format(j=j)})",
            f"s{j} AS (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT a.k, v, unnest(range(1, {dims + 1})) AS i FROM a{j} a JOIN kept USING (row)) GROUP BY k, i)",
            f"m{j} AS (SELECT k, list((s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END)::BIGINT ORDER BY i) AS c FROM s{j} GROUP BY k)",
            f"c{j + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{j} o LEFT JOIN m{j} m USING (k))",
        ]
    parts.append(f"last AS MATERIALIZED ({near.format(j=rounds)})")
    return (
        "WITH " + ", ".join(parts) + " SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last JOIN kept USING (row) JOIN c{rounds} USING (k)"
    )
