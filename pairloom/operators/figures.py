"""The data behind the study's figures, as frames of a stated, small shape: drawing is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import histogram


def bars(scores: DataFrame, by: list[str], system: str, value: str, systems: list[str]) -> DataFrame:
    """One row for each key, a column for each system: baselines side by side, or the arms of a ladder."""
    return scores.groupBy(*by).pivot(system, systems).agg(F.first(value))


def curves(runs: DataFrame, by: list[str], history: str = "history") -> DataFrame:
    """One row for each epoch of a training history, array<struct<epoch, train_loss, dev_loss, ...>>, with the best epoch so
    far by dev_loss."""
    rows = runs.select(*by, F.posexplode(history).alias("pos", "_h")).select(*by, "pos", "_h.*")
    best = rows.groupBy(*by).agg(F.min_by("epoch", F.struct("dev_loss", "pos")).alias("best_epoch"))
    return rows.join(best, by)


def forest(scores: DataFrame, by: list[str], system: str, base: str, delta: str = "delta", low: str = "ci_low", high: str = "ci_high", scale: str = "mae") -> DataFrame:
    """Differences and their intervals as percentages of the base system's error, sorted by key and system."""
    of_base = scores.where(F.col(system) == base).groupBy(*by).agg(F.first(scale).alias("_b"))
    percent = lambda c: F.try_divide(100.0 * F.col(c), F.col("_b")).alias(f"{c}_pct")
    rows = scores.where(F.col(system) != base).join(F.broadcast(of_base), by)
    return rows.select(*by, system, percent(delta), percent(low), percent(high), (~(F.col(low) <= 0) | ~(F.col(high) >= 0)).alias("excludes_zero")).orderBy(*by, system)


def ratio_histogram(rows: DataFrame, ratio: str, most: float = 6.0, bins: int = 60, above: float = 2.0, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts of ratios in equal bins up to `most`, and the share of all ratios over `above`."""
    share = rows.where(F.col(ratio).isNotNull()).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(ratio) > above).cast("double")).alias("share_above"))
    return histogram(rows, ratio, 0.0, most, bins, by), share
