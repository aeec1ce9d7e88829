"""Recordings as tables of one-second rows (job, second, samples): ducking under speech, and work in overlapping chunks.

No row holds a whole recording, however long; the last second of a job may be shorter than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import let
from .hot import join_sums

#: Gain under speech, gain elsewhere, seconds of a ramp; seconds of a chunk and the part of it that is shared.
UNDER, BED, FADE_S = 0.25, 0.8, 0.15
CHUNK_S, OVERLAP_S = 10.0, 0.1


def as_track(arrays: DataFrame, job: str, samples: str, rate: int) -> DataFrame:
    """(job, second, samples) of whole arrays. An empty or null array has no rows."""
    n = F.ceil(F.size(samples) / rate).cast("int")
    rows = arrays.where(F.size(samples) > 0).select(F.col(job).alias("job"), F.col(samples).cast("array<double>").alias("_s"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("second"))
    return rows.select("job", "second", F.slice("_s", (F.col("second") * rate + 1).cast("int"), rate).alias("samples"))


def lengths(track: DataFrame, rate: int) -> DataFrame:
    """(job, length, seconds): samples of each job, and how many rows it has."""
    return track.groupBy("job").agg(F.max(F.col("second") * rate + F.size("samples")).alias("length"), F.count(F.lit(1)).alias("seconds"))


def with_length(track: DataFrame, rate: int) -> DataFrame:
    return join_sums(track, lengths(track, rate), "job", "seconds", track.count()).drop("seconds")


# -- ducking -----------------------------------------------------------------


def covered(segments: DataFrame, job: str, start: str, end: str, rate: int) -> DataFrame:
    """(job, a, b): the samples [a, b) below any segment, as spans that don't touch. A sweep: segments by start, with the running
    maximum of ends; a span ends where the next segment starts beyond it."""
    rows = segments.select(F.col(job).alias("job"), F.greatest(F.lit(0).cast("long"), (F.col(start) * rate).cast("long")).alias("a"), (F.col(end) * rate).cast("long").alias("b")).where("b > a")
    w = W.partitionBy("job").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = rows.withColumn("_new", F.coalesce(F.col("a") > reach, F.lit(True)).cast("int"))
    return new.withColumn("_span", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("job", "_span").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_span")


def duck(track: DataFrame, segments: DataFrame, rate: int, job: str = "job", start: str = "start", end: str = "end", under: float = UNDER, bed: float = BED, fade_s: float = FADE_S) -> DataFrame:
    """The track with gain `under` below any segment and `bed` elsewhere, each gain the mean of those around it over fade_s, so
    that levels change in ramps. Beyond the ends the gain goes on as it is there; a job no longer than a ramp has steps.

    Spans of speech are dealt to the seconds that they can be heard in; there, a sample's gain follows from how much of its
    ramp lies in spans, so no sample meets a segment that is far away.
    """
    width = max(1, int(fade_s * rate))
    back, ahead = width - 1 - (width - 1) // 2, (width - 1) // 2
    whole = with_length(track, rate)
    size = whole.select("job", "length").distinct().withColumnRenamed("job", "_j")
    spans = covered(segments, job, start, end, rate).where("a >= 0")
    # what reaches an end of the recording goes on beyond it
    far = F.lit(width)
    spans = spans.join(size, F.col("job") == F.col("_j")).where("a < length").select("job", F.when(F.col("a") == 0, -far).otherwise(F.col("a")).alias("a"), F.when(F.col("b") >= F.col("length"), F.col("length") + far).otherwise(F.col("b")).alias("b"), "length")
    first, last = F.floor((F.greatest(F.col("a") - ahead, F.lit(0))) / rate), F.floor((F.least(F.col("b") + back, F.col("length")) - 1) / rate)
    near = spans.select("job", F.explode(F.sequence(first, last)).alias("second"), F.struct("a", "b").alias("_p")).groupBy("job", "second").agg(F.collect_list("_p").alias("_spans"))
    met = whole.join(near, ["job", "second"], "left")
    w = F.when(F.col("length") > width, width).otherwise(1)
    before, after = (F.when(F.col("length") > width, x).otherwise(0) for x in (back, ahead))

    def gain(p: Column) -> Column:
        def at(i: Column) -> Column:
            low, high = i - p["before"], i + p["after"] + 1
            part = F.aggregate(p["spans"], F.lit(0).cast("long"), lambda t, s: t + F.greatest(F.lit(0).cast("long"), F.least(high, s["b"]) - F.greatest(low, s["a"])))
            return F.lit(bed) + (under - bed) * part / p["w"]

        return F.transform(p["samples"], lambda v, k: v * let(p["at"] + k, at))

    state = F.struct("samples", "_spans", (F.col("second") * rate).alias("at"), before.alias("before"), after.alias("after"), w.alias("w"))
    moved = let(F.struct(state["samples"].alias("samples"), state["_spans"].alias("spans"), state["at"].alias("at"), state["before"].alias("before"), state["after"].alias("after"), state["w"].alias("w")), gain)
    return met.select("job", "second", F.when(F.col("_spans").isNull(), F.transform("samples", lambda v: v * bed)).otherwise(moved).alias("samples"))


# -- chunks ------------------------------------------------------------------


def chunks(track: DataFrame, rate: int, chunk: int, overlap: int) -> DataFrame:
    """(job, chunk, start, length, samples): the recording in pieces of `chunk` samples, each with the last `overlap` samples of the
    one before. length: the job's samples. chunk > overlap."""
    if not 0 <= overlap < chunk:
        raise ValueError("an overlap is shorter than a chunk")
    at, n = F.col("second") * rate, F.size("samples")
    first = F.floor(at / chunk)
    last = F.floor(F.least(at + n - 1 + overlap, F.col("length") - 1) / chunk)
    rows = with_length(track, rate).withColumn("chunk", F.explode(F.sequence(first, last)))
    start = F.greatest(F.lit(0).cast("long"), F.col("chunk") * chunk - overlap)
    rows = rows.withColumns({"start": start, "_a": F.greatest(start, at), "_b": F.least((F.col("chunk") + 1) * chunk, at + n)}).where("_a < _b")
    piece = F.slice("samples", (F.col("_a") - at + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int"))
    parts = rows.groupBy("job", "chunk", "start", "length").agg(F.sort_array(F.collect_list(F.struct("second", piece.alias("s")))).alias("_p"))
    return parts.select("job", "chunk", "start", "length", F.flatten(F.transform("_p", lambda p: p["s"])).alias("samples"))


def overlap_add(pieces: DataFrame, rate: int, chunk: int, overlap: int) -> DataFrame:
    """(job, second, samples): chunks put together. In what two chunks share, the first fades out as the second fades in, so what
    a step leaves alone comes back as it was."""
    ramp = lambda k: k / float(overlap - 1) if overlap > 1 else F.lit(0.0)
    size, last = F.size("samples"), F.col("start") + F.size("samples") >= F.col("length")

    def weight(k: Column, n: Column) -> Column:
        rising = F.when((F.col("chunk") > 0) & (k < overlap), ramp(k)).otherwise(1.0)
        falling = F.when(~last & (k >= n - overlap), 1.0 - ramp(k - (n - overlap))).otherwise(1.0)
        return rising * falling

    faded = pieces.withColumn("samples", F.transform("samples", lambda v, k: v * weight(k, size)))
    seconds = F.explode(F.sequence(F.floor(F.col("start") / rate), F.floor((F.col("start") + size - 1) / rate))).alias("second")
    rows = faded.select("job", "start", "length", "samples", seconds)
    at = F.col("second") * rate
    n = F.least(F.lit(rate).cast("long"), F.col("length") - at)
    a, b = F.greatest(at, F.col("start")), F.least(at + n, F.col("start") + F.size("samples"))
    zeros = lambda m: F.array_repeat(F.lit(0.0), m.cast("int"))
    padded = F.concat(zeros(a - at), F.slice("samples", (a - F.col("start") + 1).cast("int"), (b - a).cast("int")), zeros(at + n - b))
    sums = rows.select("job", "second", padded.alias("_s")).groupBy("job", "second").agg(F.collect_list("_s").alias("_s"))
    total = F.aggregate(F.slice("_s", 2, F.size("_s")), F.get("_s", F.lit(0)), lambda t, x: F.zip_with(t, x, lambda u, v: u + v))
    return sums.select("job", "second", total.alias("samples"))


def in_chunks(track: DataFrame, step, rate: int, chunk_s: float = CHUNK_S, overlap_s: float = OVERLAP_S) -> DataFrame:
    """The track after `step`, a function from chunk rows to chunk rows that changes `samples` but not their number: a model
    in mapInPandas, or an expression."""
    chunk, overlap = int(rate * chunk_s * (1 + overlap_s)), int(overlap_s * rate)
    return overlap_add(step(chunks(track, rate, chunk, overlap)), rate, chunk, overlap)
