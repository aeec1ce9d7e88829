"""What keeps tasks small: short batches and row groups, and memory given back between tasks, as workers live on."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

from ..sources.store import GROUP_BYTES

#: Rows of an Arrow batch of texts, where the session has Spark's default of 10,000.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_GROUP = "parquet.block.size"
#: Rows of a batch that a Parquet reader decodes, where the session has Spark's default of 4,096.
READ_ROWS = 512
_READ = "spark.sql.parquet.columnarReaderBatchSize"
#: Of the buffers that a reader fills with a row group.
PIECE_BYTES = 1 << 18
_PIECES = {"parquet.hadoop.vectored.io.enabled": "false", "parquet.read.allocation.size": str(PIECE_BYTES)}


def tidy() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_batches(spark: SparkSession) -> None:
    """Texts may be long: unless the session has a limit of its own, batches get BATCH_ROWS rows at most. Both the JVM's
    buffers and the workers hold whole batches."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def short_groups(spark: SparkSession) -> None:
    """Each task that writes Parquet holds a row group, by default of 128 MB, which eight tasks don't find room for in a heap
    of 1 GB. Unless the session has a size of its own, whatever it writes gets groups of GROUP_BYTES."""
    if spark.conf.get(_GROUP, None) is None and spark.sparkContext._jsc.hadoopConfiguration().get(_GROUP) is None:
        spark.conf.set(_GROUP, str(GROUP_BYTES))


def short_reads(spark: SparkSession) -> None:
    """Each task that reads Parquet holds a row group's texts as they are stored, in one piece where reads are vectored, and a
    batch's columns, which are copied as they grow. Between them a heap of 1 GB, which the collector doesn't compact for such
    pieces, has no room for eight tasks. Unless the session has settings of its own, batches get READ_ROWS rows, and stored texts
    come in pieces of PIECE_BYTES."""
    if spark.conf.get(_READ) == "4096":
        spark.conf.set(_READ, str(READ_ROWS))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name, value in _PIECES.items():
        if spark.conf.get(name, None) is None and hadoop.get(name) is None:
            spark.conf.set(name, value)


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """text_batches for what runs inside; afterwards the session is as it was."""
    before = spark.conf.get(_BATCH)
    text_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
