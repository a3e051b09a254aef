"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import time
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space as `[^\x20\x09-\x0D]+` leaves it out; `bytes.split()` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Slices in which tables and bitmaps are put together.
SLICES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only on a single machine whose session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "/tmp/checkpoints"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stored(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """Like materialize(), as a Parquet table in the shared folder: columnar, so later readers prune columns.  It is
    deleted by discard(), or when the session's driver ends.  rows_a_file: the most, for large rows (0: any number)."""
    spark = df.sparkSession
    where = os.path.join(checkpoint_dir(spark), f"t-{uuid.uuid4().hex}")
    # a frame that was written holds its shuffle files for as long as it lives, and the caller may hold df
    once = df.select("*")
    once.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(where)
    files, path = _file_system(spark, where)
    files.deleteOnExit(path)
    release(spark)
    out = spark.read.parquet(where)
    out._stored_at = where
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nothing will read again: it does so when their objects are collected,
    which would else wait until the driver's heap fills.  Events under way hold them, too."""
    gc.collect()
    for _ in range(2):  # what the first run frees holds others
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def discard(*frames: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in frames:
        files, path = _file_system(df.sparkSession, df._stored_at)
        files.delete(path, True)


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of the rows' bytes (of files, their size)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, size: int) -> int:
    """Buckets of about `size` bytes of what df reads, but no more than 64 for each shuffle partition."""
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(2 * shuffles, planned_bytes(df) // size), 64 * shuffles)


def by_bucket(rows: DataFrame) -> DataFrame:
    """Blocks of a bucket one after the other in one task."""
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def packed(values: np.ndarray) -> bytes:
    """An array by byte planes, compressed: sorted keys and small numbers shrink to a few bytes each."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpacked(block: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def settle_memory() -> None:
    """Gives what a worker has freed back to the machine, as it will stay for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its memory stays
        pass


def joined(parts: DataFrame, size: int, kind, join) -> np.ndarray:
    """One array from its slices (number, packed part), several of a number being joined as they arrive: a task holds
    no more than one array, nor does the driver."""

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = unpacked(part.as_py(), kind)
                held[k] = join(held[k], part) if k in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([packed(x) for x in held.values()], pa.binary())], names=["slice", "part"])

    out = np.zeros((SLICES, size // SLICES), kind)
    for r in parts.repartition(parts.columns[0]).mapInArrow(merge, "slice int, part binary").collect():
        out[r[0]] = unpacked(bytes(r[1]), kind)
    return out.ravel()


def anonymous(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by place, so that no name of theirs clashes with an operator's, and the new names."""
    names = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with a function from a RecordBatch to a RecordBatch's columns (a dict of arrays)."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = function(batch)
                yield pa.RecordBatch.from_arrays([made[n] for n in names], names=names)

    return df.mapInArrow(run, schema)


def texts(column) -> list:
    """A string column's values as bytes (None stays None), without decoding."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def remainder(doc_id, n: int):
    """crc32 of the id as text, mod n (null ids: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b), root being the smallest node reachable.

    Large-star and small-star steps alternate until the edges no longer change; each round ends in a
    reliable checkpoint, every step is a hash aggregation and a join that AQE can split, and only two
    numbers a round reach the driver.  Empty edges give an empty result.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        now = materialize(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
