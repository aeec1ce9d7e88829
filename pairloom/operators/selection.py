"""Choosing among candidates: translations that fit, takes, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import keeps_markers, spoken_chars
from .quantiles import exact_quantiles


def best_take(rows: DataFrame, by: list[str], runaway: str, cer: str, seconds: str, attempt: str) -> DataFrame:
    """One take of each line: not a runaway, then the least error to two places, then the shortest, then the earliest."""
    rank = F.struct(F.col(runaway), F.bround(cer, 2), F.col(seconds), F.col(attempt))
    whole = F.struct(*[F.col(c) for c in rows.columns if c not in by])
    return rows.groupBy(*by).agg(F.min_by(whole, rank).alias("_w")).select(*by, "_w.*")


def unique_candidates(rows: DataFrame, by: list[str], text: str, order: str) -> DataFrame:
    """Candidates without repeats, each at its first place."""
    first = F.row_number().over(W.partitionBy(*by, text).orderBy(order))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def eligible(rows: DataFrame, by: list[str], text: str, score: str, current: str, language: str | Column, delta: float = 0.3) -> DataFrame:
    """Candidates near the best score that are shorter than the current text and keep its markers."""
    top = F.max(score).over(W.partitionBy(*by))
    near = rows.withColumn("_top", top).where(F.col(score) >= F.col("_top") - delta)
    return near.where((spoken_chars(text) < spoken_chars(current)) & keeps_markers(text, current, language)).drop("_top")


def round_trip_ok(rows: DataFrame, back: str, current_back: str, source: str, drop: float = 15.0) -> DataFrame:
    """Candidates whose back-translation is at most `drop` chrF further from the source than the current one's."""
    from .text_metrics import sentence_chrf

    return rows.where(F.col(back).isNotNull()).where(sentence_chrf(back, source) >= sentence_chrf(current_back, source) - drop)


def pick_shorter(rows: DataFrame, by: list[str], text: str, score: str, target: str | None = None, order: str | None = None) -> DataFrame:
    """One eligible candidate for each line: with a target length, the best-scoring one that reaches it; else, or if none
    does, the shortest, better scores first."""
    n, first = spoken_chars(text), F.col(order) if order else F.col(text)
    pick = F.min_by(text, F.struct(n, -F.col(score), first))
    if target:
        reaches = n <= F.col(target)
        pick = F.coalesce(F.min_by(F.when(reaches, F.col(text)), F.when(reaches, F.struct(-F.col(score), first))), pick)
    return rows.groupBy(*by).agg(pick.alias(text))


def fitted(lines: DataFrame, chosen: DataFrame, by: list[str], text: str) -> DataFrame:
    """lines with the chosen text where there is one."""
    return lines.join(chosen.withColumnRenamed(text, "_chosen"), by, "left").withColumn(text, F.coalesce("_chosen", text)).drop("_chosen")


def rejoin(pieces: DataFrame, by: list[str], pos: str, text: str, sep: str = " ") -> DataFrame:
    """Pieces of each line put together in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda p: p[text])
    return pieces.groupBy(*by).agg(F.array_join(parts, sep).alias(text))


def percentile_picks(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The best, median and lower-quartile rows of each key, by value."""
    w = W.partitionBy(*by)
    k = F.row_number().over(w.orderBy(value, order))
    n = F.count(F.lit(1)).over(w)
    ranked = rows.withColumns({"_k": k, "_n": n})
    pick = F.when(F.col("_k") == F.col("_n"), "best").when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, "median").when(F.col("_k") == F.floor(F.col("_n") / 4) + 1, "lower_quartile")
    return ranked.withColumn("pick", pick).where("pick is not null").drop("_k", "_n")


def top_n(rows: DataFrame, by: list[str], n: int, *order) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in equal bins from 1 to `bins`; values outside go to the end bins."""
    x = F.least(F.greatest(F.col(value).cast("double"), F.lit(low)), F.lit(high))
    b = F.least(F.floor((x - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("long")
    return rows.where(F.col(value).isNotNull()).groupBy(*(by or []), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    got = exact_quantiles(rows, by, value, [0.0, 0.25, 0.5, 0.75, 1.0])
    return got.select(*by, "n", *[F.get("quantiles", F.lit(i)).alias(c) for i, c in enumerate(("low", "q1", "median", "q3", "high"))])
