"""Lines on a timeline: windows, overlaps, placement, words, who speaks when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import let
from ..sources.store import materialize, release

#: Fixed values, seconds: how far a line may run over, pauses before the same and another speaker, the least window.
SPILL, SAME_GAP, TURN_GAP, MIN_WINDOW = 0.3, 0.1, 0.2, 0.3


def line_windows(segments: DataFrame, job: str = "job", order: str = "idx", start: str = "start", end: str = "end", label: str = "label", total: str = "total") -> DataFrame:
    """segments with `window`, the seconds a line may take, and `deadline`, when it must be over: it may run over its own
    end, but leaves the next line its pause, and the last one ends with the media."""
    w = W.partitionBy(job).orderBy(order)
    nxt, same = F.lead(start).over(w), F.lead(label).over(w).eqNullSafe(F.col(label))
    gap = F.when(same, SAME_GAP).otherwise(TURN_GAP)
    rows = segments.withColumn("_next", nxt).withColumn("_gap", gap)
    stop = F.coalesce(F.col("_next"), F.col(total))
    until = F.least(F.col(end) + SPILL, F.when(F.col("_next").isNotNull(), F.col("_next") - F.col("_gap")).otherwise(F.col(total)))
    window = F.greatest(until - F.col(start), F.lit(MIN_WINDOW))
    return rows.withColumn("window", window).withColumn("deadline", F.least(F.col(start) + F.col("window"), stop)).drop("_next", "_gap")


def cumulative_starts(segments: DataFrame, job: str, order: str, seconds: str) -> DataFrame:
    """segments with `start`, the sum of the durations before."""
    before = W.partitionBy(job).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return segments.withColumn("start", F.coalesce(F.sum(seconds).over(before), F.lit(0.0)))


def dropped_seconds(seconds: Column, offset: Column, limit: Column) -> Column:
    """What a line of this length loses when it is placed at offset and must not pass the limit."""
    return F.greatest(F.lit(0.0), seconds - F.greatest(F.lit(0.0), limit - offset))


def first_labels(rows: DataFrame, job: str, order: str, label: str) -> DataFrame:
    """rows with labels numbered from 0 in order of first appearance in their job."""
    first = F.min(order).over(W.partitionBy(job, label))
    return rows.withColumn("_f", first).withColumn(label, F.dense_rank().over(W.partitionBy(job).orderBy("_f")) - 1).drop("_f")


def fill_nearest(rows: DataFrame, job: str, order: str, start: str, end: str, label: str) -> DataFrame:
    """rows whose missing label is taken from the segment of the job that is nearest in time; of equals, the first.

    A segment's gap to another is 0 where they overlap or touch. Repeated rows stay as they are; a missing label stays missing
    where its job has no known one; a segment without a start or an end lends no label and gets none.

    No two lists meet as a whole. The nearest known segment before and the one after come from running maxima and minima
    over ends and starts. For the first of those that overlap, known segments are ranked by start: those that start early
    enough are a prefix of ranks, which is at most one block for each power of two; in a block sorted by ends, a running
    minimum tells the first of those that end late enough. So work is n log n.
    """
    spark = rows.sparkSession
    marked, _ = materialize(rows.where(F.col(label).isNull()).withColumn("_row", F.monotonically_increasing_id()), "open")
    timed = lambda df: df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    x = timed(marked).select(F.col(job).alias("j"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), "_row")
    by_job = W.partitionBy("j")
    y = timed(rows).where(F.col(label).isNotNull()).select(F.col(job).alias("j"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), F.col(order).alias("_o"), F.col(label).alias("l"))
    y = y.withColumns({"r": F.row_number().over(by_job.orderBy("_o", "s", "e", "l")), "at": F.row_number().over(by_job.orderBy("s", "e", "_o")) - 1, "n": F.count(F.lit(1)).over(by_job)})
    y, path = materialize(y.drop("_o"), "known")
    own = F.struct("r", "l").alias("own")

    def met(known: DataFrame, asking: DataFrame, t: list[str], w, best) -> DataFrame:
        """asking rows with `best` over the known rows that stand before them; equal times count as before."""
        keys = [c for c in known.columns if c not in (*t, "own")]
        both = known.select(*keys, F.col(t[0]).alias("t"), F.lit(0).alias("kind"), "own", F.lit(None).cast("long").alias("_row")).unionByName(asking.select(*keys, F.col(t[1]).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(known.schema["own"].dataType).alias("own"), "_row"))
        return both.withColumn("best", best.over(w.rowsBetween(W.unboundedPreceding, 0))).where("kind = 1")

    low, high = W.partitionBy("j").orderBy("t", "kind"), W.partitionBy("j").orderBy(F.desc("t"), "kind")
    last = F.max(F.when(F.col("kind") == 0, F.struct("t", (-F.col("own.r")).alias("r"), "own")))
    before = met(y.select("j", "e", own), x.select("j", "s", "_row"), ["e", "s"], low, last).select("_row", (F.col("t") - F.col("best.t")).alias("gap"), F.col("best.own").alias("own"))
    first = F.min(F.when(F.col("kind") == 0, F.struct("t", F.col("own.r").alias("r"), "own")))
    after = met(y.select("j", "s", own), x.select("j", "e", "_row"), ["s", "e"], high, first).select("_row", (F.col("best.t") - F.col("t")).alias("gap"), F.col("best.own").alias("own"))
    # how many known segments start no later than the asking one's end, and the blocks that make up this prefix
    upto = met(y.select("j", "s", own), x.select("j", "e", "_row"), ["s", "e"], low, F.count("own")).select("_row", F.col("best").alias("k"))
    bits = F.sequence(F.lit(0), F.floor(F.log2(F.col("n"))).cast("int"))
    shift = lambda c, k: F.floor(F.col(c) / F.pow(F.lit(2.0), k)).cast("long")
    blocks = y.select("j", "e", own, "at", F.explode(bits).alias("bit")).withColumn("block", shift("at", F.col("bit"))).where("block % 2 = 0").drop("at")
    asked = x.join(upto, "_row").where("k > 0").select("j", "s", "_row", "k", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("k"))).cast("int"))).alias("bit"))
    asked = asked.where(shift("k", F.col("bit")) % 2 == 1).withColumn("block", shift("k", F.col("bit")) - 1).drop("k")
    late = W.partitionBy("j", "bit", "block").orderBy(F.desc("t"), "kind")
    over = met(blocks, asked, ["e", "s"], late, F.min("own")).select("_row", F.lit(0.0).alias("gap"), F.col("best").alias("own"))
    nearest = before.unionByName(after).unionByName(over).where("own IS NOT NULL").groupBy("_row").agg(F.min_by("own.l", F.struct("gap", "own.r")).alias("_near"))
    filled, _ = materialize(marked.join(nearest, "_row", "left").select(*[F.col("_near").alias(c) if c == label else c for c in rows.columns]), "filled")
    release(spark, path)
    return rows.where(F.col(label).isNotNull()).unionByName(filled)


def stab(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, bucket: float) -> DataFrame:
    """Points with the spans of their key that hold them (start <= at < end).

    Spans are dealt to the time buckets that they touch, so this is an equi-join on (key, bucket) and a filter; a key with
    very many points spreads over its buckets.
    """
    b = lambda x: F.floor(F.col(x) / bucket)
    s = spans.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(b(start), b(end))))
    p = points.withColumn("_b", b(at))
    return p.join(s, [key, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def word_states(words: DataFrame, at: Column, start: str = "start", end: str = "end") -> DataFrame:
    """words with `state` at a time: past, now or future."""
    return words.withColumn("state", F.when(F.col(end) <= at, "past").when(F.col(start) <= at, "now").otherwise("future"))


def estimated_words(lines: DataFrame, key: list[str], text: str, start: str, end: str) -> DataFrame:
    """One row for each word of a line with times in proportion to its weight: letters and digits plus 1, 2 more after
    punctuation that makes a pause."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"), F.lit(0))
    weight = lambda w: F.length(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")) + 1 + F.when(w.rlike(r"[.,!?;:…]$"), 2).otherwise(0)
    rows = lines.select(*key, start, end, F.posexplode(words).alias("pos", "word")).withColumn("_w", weight(F.col("word")))
    w = W.partitionBy(*key)
    upto = F.sum("_w").over(w.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"_upto": upto, "_all": F.sum("_w").over(w)})
    span = F.col(end) - F.col(start)
    return rows.select(*key, "pos", "word", (F.col(start) + span * (F.col("_upto") - F.col("_w")) / F.col("_all")).alias("word_start"), (F.col(start) + span * F.col("_upto") / F.col("_all")).alias("word_end"))


def greedy_reference(pieces: DataFrame, speaker: str, seconds: str, order: str, most: float = 25.0, target: float = 8.0, short: float = 1.0, least: float = 1.0) -> DataFrame:
    """Pieces that make up each speaker's reference, longest first, with `used` seconds: up to `most` in all; pieces under
    `short` only until there are `target`; a speaker with under `least` gets none."""
    w = W.partitionBy(speaker).orderBy(F.desc(seconds), order)
    before = F.coalesce(F.sum(seconds).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = pieces.withColumn("_before", before)
    used = F.greatest(F.lit(0.0), F.least(F.col(seconds), F.lit(most) - F.col("_before")))
    rows = rows.withColumn("used", F.when((F.col(seconds) < short) & (F.col("_before") >= target), 0.0).otherwise(used))
    return rows.withColumn("_sum", F.sum("used").over(W.partitionBy(speaker))).where((F.col("used") > 0) & (F.col("_sum") >= least)).drop("_before", "_sum")


def envelope(segments: Column, samples: int, rate: int, under: float = 0.25, bed: float = 1.0) -> Column:
    """Gain of each sample: `under` below any segment, else `bed`. segments: array of struct (start, end), seconds. Between two
    neighbouring starts or ends the gain is one, so segments are looked at once for each of these, not for each sample. For
    whole recordings see tracks.duck."""
    cut = lambda v: F.least(F.greatest((v * rate).cast("int"), F.lit(0)), F.lit(samples))
    spans = F.transform(segments, lambda s: F.struct(cut(s["start"]).alias("a"), cut(s["end"]).alias("b")))
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.lit(samples)), F.transform(spans, lambda s: s["a"]), F.transform(spans, lambda s: s["b"]))))

    def runs(p: Column) -> Column:
        gain = lambda x: F.when(F.exists(p["spans"], lambda s: (s["a"] <= x) & (x < s["b"])), under).otherwise(bed)
        return F.flatten(F.transform(F.slice(p["edges"], 1, F.size(p["edges"]) - 1), lambda x, k: F.array_repeat(gain(x), F.get(p["edges"], k + 1) - x)))

    return let(F.struct(spans.alias("spans"), edges.alias("edges")), runs)


def placed_track(lines: DataFrame, job: str, offset: str, piece: str, rate: int) -> DataFrame:
    """(job, second, samples): the sum of all pieces of a job's track, an array for each second that any piece reaches."""
    parts = lines.select(F.col(job).alias("job"), F.col(offset).alias("_o"), F.posexplode(piece).alias("_i", "_v"))
    at = F.col("_o") + F.col("_i")
    sums = parts.groupBy("job", F.floor(at / rate).alias("second"), F.pmod(at, F.lit(rate)).cast("int").alias("_k")).agg(F.sum("_v").alias("_v"))
    every = F.transform(F.sequence(F.lit(0), F.lit(rate - 1)), lambda k: F.struct(k.alias("_k"), F.lit(0.0).alias("_v")))
    rows = sums.groupBy("job", "second").agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_s"))
    missing = lambda s: F.array_except(F.transform(every, lambda x: x["_k"]), F.transform(s, lambda x: x["_k"]))
    whole = F.array_sort(F.concat("_s", F.transform(missing(F.col("_s")), lambda k: F.struct(k.alias("_k"), F.lit(0.0).alias("_v")))))
    return rows.select("job", "second", F.transform(whole, lambda x: x["_v"]).alias("samples"))
