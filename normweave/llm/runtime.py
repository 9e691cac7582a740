"""Session helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import shared_dir
from ..functions.ship import ship

#: Words of a text: runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that nothing before them is run again."""
    shared_dir(df.sparkSession)
    ship(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def dealing(spark: SparkSession) -> Iterator[None]:
    """What is cut here keeps how it was dealt for later plans, which don't repeat it; adaptive execution would hide it."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """The same rows in the shared folder, dealt by keys in a way that later plans know of."""
    with dealing(df.sparkSession):
        return cut(df.repartition(parts, *keys))


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """A table of few columns, of so many rows, read by no more tasks than it takes: parts of up to 1 << 18 rows, but one for each core."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows >> 18))


def forget(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints that no table leads to any more; it does so only when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts_of(df: DataFrame, size: int = 4 << 20) -> int:
    """Parts of about `size` bytes for a table, by the optimizer's estimate; the session's shuffle partitions where it has none."""
    spark = df.sparkSession
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known >= 1 << 55:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, spark.sparkContext.defaultParallelism, min(known // size, 1 << 17))


def crc_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo modulus; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def attach(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of df that stay beside outputs of these names; an output replaces its namesake."""
    ship(df.sparkSession)
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled documents outside the held-out remainder.

    They are those of the smallest hashes of doc_id. An id labelled twice takes the larger label; null
    ids and labels are left out. The chosen ids, at most `rows` of them, are broadcast, so no text is
    shuffled to find them. Of an id on several rows the smallest text is taken, found before the shuffle.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_bucket(F.col("doc_id"), modulus) != held))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = usable.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == chosen["__id"])
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most `rows` rows, so that what a worker makes of one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pack(x: np.ndarray) -> bytes:
    """The array as planes of its bytes, compressed: the high bytes of counts and places are nearly all zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(raw: bytes, kind: type | str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    rows = np.zeros(planes.shape[::-1], np.uint8)
    for i, plane in enumerate(planes):
        if plane.any():
            rows[:, i] = plane
    return rows.view(kind).ravel()
