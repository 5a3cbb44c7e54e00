"""Helpers that several operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.graph import discard, shared_dir, stash  # noqa: F401

# Arrow's own pools keep what was freed; a Python worker beside a full JVM has no room for that.
pa.set_memory_pool(pa.system_memory_pool())

#: Word separators of the contracts: space and the bytes 09 to 0D.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4_000_000):
    """Row ranges of a batch whose texts take about max_bytes together (one row at least), so that work arrays stay small."""
    sizes = [len(x) if x is not None else 0 for x in map(_buf, batch.column(column))]
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > max_bytes:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _buf(x: pa.Scalar):
    return x.as_buffer() if x.is_valid else None


def bounded_batches(spark: SparkSession, size: str = "2m") -> None:
    """Python workers get batches of bounded bytes, whatever the length of the texts; plans made from now on use it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def crc32_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))
