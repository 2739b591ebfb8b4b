"""Reading, storing and key helpers shared by the operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most `BATCH_ROWS`; a smaller setting of the session stays.

    Whole texts make rows of kilobytes. At Spark's 10,000 rows a batch takes tens of MB, once in the JVM beside its
    heap and once in each Python worker, which both keep what they have touched.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run inside send rows to Python in batches that end with the row that reaches `size` bytes.

    For tables whose rows hold blocks of hundreds of KB: a batch of all rows of a task is held by the JVM beside its heap,
    in a buffer that doubles as it grows, and again by the Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def local_table(spark: SparkSession, columns: dict[str, tuple[pa.DataType, list]]) -> DataFrame:
    """A table of the driver's rows. They go to Spark as Arrow: for plain rows each executor starts a second set of Python workers."""
    return spark.createDataFrame(pa.table({name: pa.array(values, kind, from_pandas=True) for name, (kind, values) in columns.items()}))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a Parquet table to the shared folder and read it back: cuts lineage durably.

    The folder is `spark.checkpoint.dir`; a local session without one gets a folder beside its warehouse.
    """
    spark = df.sparkSession
    small_batches(spark)
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    path = f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Freed memory goes back to the system: worker processes outlive their tasks and would keep it beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut batches into runs of rows with about `size` bytes of text (one row at least), with the texts; null texts are empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_string())
        lengths = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, length in enumerate(lengths):
            if i > start and held + length > size:
                yield batch.slice(start, i - start), texts.slice(start, i - start)
                start, held = i, 0
            held += int(length)
        if len(lengths) > start:
            yield batch.slice(start), texts.slice(start)
        batch = texts = lengths = None  # not held while the next batch is read
    release()


def row_hash(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text; null and empty count as the same text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def id_buckets(df: DataFrame, rows_per_bucket: int, most: int) -> tuple[Column, int]:
    """A column that numbers ranges of doc_id in ascending order, null ids last, and the number of ranges.

    Ranges are cut at approximate quantiles; at most `most` numbers reach the driver. Equal ids share a range.
    """
    ids = df.select("doc_id")
    buckets = max(1, min(most, ids.count() // rows_per_bucket))
    found = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10000)).first()[0] if buckets > 1 else None
    splits = sorted(set(found or []))
    if not splits:
        return F.when(F.col("doc_id").isNull(), 1).otherwise(0), 2
    cuts = F.array(*[F.lit(s) for s in splits])
    inside = F.size(F.filter(cuts, lambda s: s < F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), len(splits) + 1).otherwise(inside), len(splits) + 2
