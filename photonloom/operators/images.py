"""Whole-image kernels over a table of frames: one image per row, in Arrow batches, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_images(frames: DataFrame, work: Callable[[np.ndarray, dict], np.ndarray], extra: list[str] | None = None) -> DataFrame:
    """frames(frame_id, h, w, data, *extra) with data replaced by work(image, row); a batch holds few frames, as they may be large."""
    extra = extra or []
    kinds = dict(frames.dtypes)
    schema = ", ".join([f"frame_id {kinds['frame_id']}", "h int", "w int", "data array<double>", *[f"{c} {kinds[c]}" for c in extra]])

    def run(batches):
        for batch in batches:
            rest = [batch.column(c) for c in ("frame_id", *extra)]
            for k in range(batch.num_rows):
                row = {c: col[k].as_py() for c, col in zip(("frame_id", *extra), rest)}
                image = batch.column("data")[k].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.column("h")[k].as_py(), -1)
                out = work(image, row)
                yield pa.RecordBatch.from_arrays([rest[0][k : k + 1] if hasattr(rest[0], "slice") else rest[0], pa.array([out.shape[0]], pa.int32()), pa.array([out.shape[1]], pa.int32()), pa.array([out.ravel()], pa.list_(pa.float64())), *[c.slice(k, 1) for c in rest[1:]]], names=["frame_id", "h", "w", "data", *extra])

    return frames.select("frame_id", "h", "w", "data", *extra).mapInArrow(run, schema)


def measure_images(frames: DataFrame, schema: str, work: Callable[[np.ndarray, dict], list[tuple]], extra: list[str] | None = None) -> DataFrame:
    """Rows of schema from work(image, row) for every frame; row has frame_id and the extra columns."""
    extra = extra or []

    def run(batches):
        for pdf in batches:
            import pandas as pd

            rows = []
            for r in pdf.itertuples(index=False):
                image = np.asarray(r.data, dtype=np.float64).reshape(r.h, r.w)
                rows += work(image, {c: getattr(r, c) for c in ("frame_id", *extra)})
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return frames.select("frame_id", "h", "w", "data", *extra).mapInPandas(run, schema)


def images_of(px: DataFrame, height: int, width: int, value: str = "adu", by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Pixels gathered into row-major images; a pixel that is absent is 0."""
    at = (F.col("y") * width + F.col("x")).cast("int")
    whole = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return px.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.col(value).cast("double").alias("v")))).alias("m")).select(*by, F.lit(height).alias("h"), F.lit(width).alias("w"), whole.alias("data"))
