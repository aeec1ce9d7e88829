"""Streaming forms: idempotent upserts of results, and windowed rollups of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.resume import Slot, file_marks, pending
from ..sources.tables import exists


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "events*.parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(folder)


def windowed(events: DataFrame, at: str, by: list[str], value: str, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by window; in a stream, rows later than `late` are left out and windows close behind it."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_at", late)
    w = F.window("_at", size, slide) if slide else F.window("_at", size)
    return timed.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_at", late)
    return timed.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def process_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame], ok: str = "ok"):
    """Run `work` on new rows of a stream and append its results, once for each key: a batch that is replayed after a
    failure finds its own keys done. Failed results are kept and their keys done again when they come again."""

    def batch(df: DataFrame, batch_id: int) -> None:
        todo = df.dropDuplicates(keys)
        if exists(df.sparkSession, path):
            done = df.sparkSession.read.parquet(path)
            todo = pending(todo, done, keys, F.col("status") != ok)
        work(todo).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(results: DataFrame, keys: list[str], ok: str = "ok") -> DataFrame:
    """One result for each key: a good one if there is any."""
    whole = F.struct(*[F.col(c) for c in results.columns if c not in keys])
    return results.groupBy(*keys).agg(F.max_by(whole, F.when(F.col("status") == ok, 1).otherwise(0)).alias("_w")).select(*keys, "_w.*")


def process_keyed(stream: DataFrame, path: str, checkpoint: str, keys: list[str], slot: Slot, inputs: list[str], reference: str | None = None):
    """Run a slot on rows of a stream, each key once, with the done keys in Spark's state store: a batch reads the state of its
    own keys, never the results so far.

    A key's state is whether its last result was good, and the marks of its reference file (path, size, time of change; the
    file must be one that executors see). A key is done again when its last result failed, or its file has changed since.
    Of several rows of a key in a batch, the first by their inputs' text is done. Results of a batch are one folder of `path`,
    `batch=<id>`, written over when the batch is replayed: the store then stands where it stood before it, so a key comes
    once. Rows with a null key are keys as others. `settled` gives one result for each key.
    """
    fields = T._parse_datatype_string(slot.schema).fieldNames()
    slot.names = fields
    wanted = [*keys, *[c for c in inputs if c not in keys]]
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # one row is held, whatever the group's size
        first = min((row for pdf in batches for row in pdf.to_dict("records")), key=lambda row: str([row[c] for c in wanted]))
        marks = repr(file_marks(first[reference])) if reference else ""
        if state.exists and state.get == (True, marks):
            return
        got = slot.one(first)
        state.update((got["error_stage"] == "", marks))
        yield pd.DataFrame([{k: first[k] for k in keys} | got | {"status": "failed" if got["error_stage"] else "ok"}], columns=[*keys, *fields, "error_stage", "error_message", "status"])

    done = stream.select(*wanted).groupBy(*keys).applyInPandasWithState(work, f"{kinds}, {slot.schema}, error_stage string, error_message string, status string", "good boolean, marks string", "append", GroupStateTimeout.NoTimeout)

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return done.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(results: DataFrame, keys: list[str]) -> DataFrame:
    """The result of each key's last batch."""
    whole = F.struct(*[F.col(c) for c in results.columns if c not in keys])
    return results.groupBy(*keys).agg(F.max_by(whole, "batch").alias("_w")).select(*keys, "_w.*")
