"""Lines that are too long for their window, reworded: flagged, cut into sentences, each sentence given its share of the
line's budget, a candidate chosen for each, and the line put together again. Candidates come from a model, so as a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import budget_chars, needs_shortening, sentences, spoken_chars
from .selection import eligible, fitted, pick_shorter, rejoin


def flagged(lines: DataFrame, text: str, window: str, language: Column) -> DataFrame:
    return lines.where(needs_shortening(text, window, language))


def pieces(lines: DataFrame, key: list[str], text: str, window: str, language: Column) -> DataFrame:
    """(key, pos, sentence, room): the sentences of lines, and of the line's spoken characters each one's share, by length,
    one at least."""
    rows = lines.select(*key, budget_chars(window, language).alias("_budget"), F.posexplode(sentences(text)).alias("pos", "sentence"))
    own, all_ = spoken_chars("sentence"), F.sum(spoken_chars("sentence")).over(W.partitionBy(*key))
    return rows.withColumn("room", F.greatest(F.lit(1), F.floor(F.col("_budget") * F.try_divide(own.cast("double"), all_.cast("double")))).cast("int")).drop("_budget")


def shortened(lines: DataFrame, candidates: DataFrame, key: list[str], text: str, window: str, language: str, delta: float = 0.3) -> DataFrame:
    """lines with reworded text where it was too long and candidates (key, pos, candidate, score, rank) for its sentences
    are eligible; a sentence without one stays as it is, and so does a line without any."""
    long = flagged(lines, text, window, F.lit(language))
    cut = pieces(long, key, text, window, F.lit(language))
    at = [*key, "pos"]
    offered = cut.join(candidates, at)
    good = eligible(offered, at, "candidate", "score", "sentence", language, delta)
    chosen = pick_shorter(good, at, "candidate", "score", "room", "rank")
    after = cut.join(chosen, at, "left").withColumn("_t", F.coalesce("candidate", "sentence"))
    return fitted(lines, rejoin(after.select(*at, F.col("_t").alias(text)), key, "pos", text), key, text)


def retranslated(lines: DataFrame, candidates: DataFrame, key: list[str], text: str, window: str, language: str, delta: float = 0.3) -> DataFrame:
    """As shortened, for whole lines: candidates (key, candidate, score, rank) of the line's translation."""
    long = flagged(lines, text, window, F.lit(language)).select(*key, F.col(text).alias("_now"), budget_chars(window, F.lit(language)).alias("room"))
    good = eligible(long.join(candidates, key), key, "candidate", "score", "_now", language, delta)
    return fitted(lines, pick_shorter(good, key, "candidate", "score", "room", "rank").withColumnRenamed("candidate", text), key, text)
