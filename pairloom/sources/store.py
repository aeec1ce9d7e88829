"""Intermediate tables in the folder that the cluster shares.

A written table cuts lineage once and for all: a lost executor costs a re-read, never a recomputation of what stands
before. Unlike checkpoint() it computes its input once and keeps columns, so later reads stay pruned.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Of a row group: each task that writes or reads a table holds one.
GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="pairloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder; returns the table read back and its path. The session's end deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pairloom/{name}-{uuid.uuid4().hex}"
    fs, hadoop = _file_system(spark, path)
    fs.deleteOnExit(hadoop)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        fs, hadoop = _file_system(spark, path)
        fs.delete(hadoop, True)
