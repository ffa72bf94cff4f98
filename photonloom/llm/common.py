"""What the text operators share: reading, staging in the shared folder, appending columns by Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a local master gets a temporary folder, as in tests; on
    a cluster there is no folder to fall back on, and it is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="photonloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives the loss of executors.

    compact: in an eighth of the shuffle partitions, but two files for each core at least; for narrow tables of ids.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if compact:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, partitions // 8))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Removes what staged() wrote, for tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once and at hand as an object; a column that a lambda reads is copied out of its row each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def append_columns(docs: DataFrame, column: str, fields: Sequence[T.StructField], make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """docs with new columns, a function of one column, computed by Arrow batches in one narrow stage.

    make() is called once in each task and returns a function from the list of
    the column's values to one list per new field. An input column that bears
    the name of a new one is replaced.
    """
    names = [f.name for f in fields]
    keep = [f for f in docs.schema.fields if f.name not in names or f.name == column]
    clash = column in names
    inner = f"__{column}_in" if clash else column
    source = docs.select(*[F.col(f"`{f.name}`").alias(inner if f.name == column else f.name) for f in keep])
    new = to_arrow_schema(T.StructType(list(fields)))
    schema = T.StructType([*source.schema.fields, *fields])

    def run(batches):
        f = make()
        for batch in batches:
            out = f(batch.column(inner).to_pylist())
            arrays = [pa.array(values, type=new.field(i).type) for i, values in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *new.names])

    out = source.mapInArrow(run, schema)
    return out.drop(inner) if clash else out


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The rows of counts(..., n) with the greatest n, size at most: those above the count at which there would be more (ties go together).

    Found by a histogram of the counts whose number of bins is bounded (exact
    up to 4,096, then 256 to each doubling), so no task sends more than its
    share of what is chosen.
    """
    n = F.col("n")
    level = F.when(n <= 4096, n).otherwise(4096 + F.floor((F.log2(n.cast("double")) - 12) * 256)).cast("long")
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()
    total, cut = 0, None
    for r in sorted(bins, key=lambda r: -r.level):
        total += r.rows
        if total > size:
            break
        cut = r.level
    return counts.where(level >= cut) if cut is not None else counts.limit(0)
