"""What the operators share: tables that outlive executors, inputs, keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine (local mode) where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Has Spark delete the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs a re-read only.

    The shuffle files of the write go with its end, the folder when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def one_each(df: DataFrame, key: str, *, order: str, unique: bool = False) -> DataFrame:
    """df with one row for each key: rows without a key are not addressable and are left out, of rows that repeat a key the first by ``order`` (nulls last) stays.

    The usual case, unique keys, costs one count over the key column and no shuffle of the rest; a caller who knows that keys are ``unique`` and not null saves that. Else rows meet as one aggregate with
    partial minima, so that a key with many rows is not one task's.
    """
    if unique:
        return df
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    odd = counts.where("n > 1").limit(1).count()
    df = df.where(F.col(key).isNotNull())
    if not odd:
        return df
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min(F.struct(F.col(order).isNull().alias("_null"), order, *(c for c in rest if c != order))).alias("_first"))
    return first.select(key, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*df.columns)


def cores(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null is empty, and bytes that are not UTF-8 read as U+FFFD."""
    return [b.decode("utf-8", "replace") if b else "" for b in column.cast(pa.binary()).to_pylist()]


def batches(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


#: Bytes of an Arrow batch that a function sees at once.
BATCH_BYTES = 8 << 20


def bounded(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over parts of batches, so that what it makes of one is bounded by bytes and not by rows; what a worker has freed goes back to the machine when the task ends."""

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = max(1, batch.num_rows // max(1, -(-batch.nbytes // BATCH_BYTES)))
            for a in range(0, batch.num_rows, rows):
                yield batch.slice(a, rows)

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(parts(it))
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Freed memory that Arrow and the C library still hold, to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of simple DDL of the types that operators emit."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(", "))])
