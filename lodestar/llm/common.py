"""What the text operators share: inputs, shared storage, salted lookups."""

from __future__ import annotations

import ctypes
import functools
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this package.
SPACE = b" \t\n\x0b\x0c\r"
#: Rows and bytes of an Arrow batch; a batch of long texts stays small in a Python worker.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Copies of a small side in a salted lookup.
SALTS = 16


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and bytes: the same for all operators, as plans run long after they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives its memory back to the system at the end of a task: Python workers outlive their tasks."""

    @functools.wraps(run)
    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            freed()

    return held


def freed() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir; in local mode, as in tests, one under /tmp where that is unset."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = "/tmp/lodestar-checkpoints"
    return set_to.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written to a table in the shared folder and read again: cuts lineage, survives a lost executor.

    The table goes when the application ends, or by `discard`.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}"
    _path(spark, top)[1].deleteOnExit(_path(spark, top)[0])
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{top}/{name}")
    out = spark.read.schema(df.schema).parquet(f"{top}/{name}")
    out._stored_at = top
    return out


def discard(df: DataFrame) -> None:
    """Removes a stored table that no plan reads any more."""
    path, fs = _path(df.sparkSession, df._stored_at)
    fs.delete(path, True)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (null: empty), row_fp (hash of the text) and the columns asked for.

    A document is a doc_id; rows that repeat one are told apart by row_fp. Other columns are left
    behind here, so that names of a caller's columns never clash with those an operator makes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_fp"), *more)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """left joined to right, which has one row per key; a key's left rows go to `salts` tasks by `spread`."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A string column's values in UTF-8."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], size: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` bytes, each of at least one row and at most `rows`; a longer row comes alone."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            b = batch.column("text")[k].as_buffer()
            b = b.size if b is not None else 0
            if held and (n + b > size or len(held) == rows):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            held.append(row)
            n += b
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def small(a: np.ndarray) -> np.ndarray:
    """Counts or indexes in the least unsigned type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()) if a.size else 0))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed by byte planes."""
    flat = [(a.dtype.str, a.shape, np.ascontiguousarray(a).reshape(-1).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()) for a in arrays]
    return zstd.compress(pickle.dumps(flat, 5), 3)


def unpack(data: bytes) -> tuple[np.ndarray, ...]:
    return tuple(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(t).itemsize, -1).T).view(t).reshape(shape) for t, shape, b in pickle.loads(zstd.decompress(data)))


def steps(a: np.ndarray) -> np.ndarray:
    """Ascending integers as small differences."""
    return small(np.diff(a.astype(np.int64), prepend=0))


def summed_up(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=np.int64)


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), for the nodes of edges (a, b), by large-star and small-star rounds.

    A node's smallest neighbour is found by partial aggregation, and the join with it is salted by
    the neighbour, so that a hub's edges go to SALTS tasks. Each round is written to the shared folder.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    ends, before = stored(ends, "edges"), None
    while True:
        state = ends.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return ends.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(ends.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        before = tuple(state)
        both = ends.union(ends.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_lookup(both.filter("v > u"), least, ["u"], "v", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = salted_lookup(large, least, ["u"], "v", "inner").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        former, ends = ends, stored(small_star.filter("u <> v").distinct(), "edges")
        discard(former)
