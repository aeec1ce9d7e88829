"""The quality gate over feature rows, with an account of what it drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The gate's bounds.
MIN_VOICED, MIN_SECONDS, MAX_SECONDS, MIN_HZ, MAX_HZ, EDGE = 0.30, 0.4, 20.0, 60.0, 400.0, 0.05
SIDES = ("en", "es")


def checks(side: str) -> dict[str, Column]:
    """Each criterion for one side; a missing value fails."""
    c = lambda name: F.col(f"{side}_{name}")
    tests = {"nan_f0": c("f0_mean_st").isNotNull(), "voiced_ratio": c("voiced_ratio") >= MIN_VOICED, "duration": c("duration").between(MIN_SECONDS, MAX_SECONDS), "f0_implausible": c("f0_mean_hz").between(MIN_HZ, MAX_HZ)}
    return {k: F.coalesce(v, F.lit(False)) for k, v in tests.items()}


def near_bound(hz: Column) -> Column:
    return (hz <= MIN_HZ * (1 + EDGE)) | (hz >= MAX_HZ * (1 - EDGE))


def passes() -> Column:
    out = F.lit(True)
    for side in SIDES:
        for ok in checks(side).values():
            out = out & ok
    return out


def no_error() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) == ""


def gate(features: DataFrame, same_speaker_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and one row of counts taken in a single pass over all rows.

    Counts of a criterion are over both sides, so a pair may count twice. dropped_quality_gate also holds the rows that
    the same-speaker restriction takes; dropped_by_criteria is the gate alone.
    """
    ok, same = passes() & no_error(), F.coalesce(F.col("same_speaker_pair"), F.lit(False))
    keep = ok & same if same_speaker_only else ok
    failed = {name: sum((F.count_if(no_error() & ~checks(s)[name]) for s in SIDES), F.lit(0)) for name in checks("en")}
    edge = near_bound(F.col("en_f0_mean_hz")) | near_bound(F.col("es_f0_mean_hz"))
    n = F.count(F.lit(1))
    stats = features.agg(
        n.alias("rows_extracted"),
        F.count_if(~no_error()).alias("dropped_extraction_error"),
        *[v.alias(f"failed_{k}") for k, v in failed.items()],
        F.count_if(no_error() & ~ok).alias("dropped_by_criteria"),
        F.count_if(ok & F.coalesce(edge, F.lit(False))).alias("near_bound_kept"),
        F.count_if(ok & same).alias("same_speaker_pairs"),
        F.count_if(ok & ~same).alias("different_speaker_pairs"),
        F.count_if(no_error() & ~keep).alias("dropped_quality_gate"),
        F.count_if(keep).alias("rows_kept"),
        F.coalesce(F.bround(1 - F.try_divide(F.count_if(keep), n), 4), F.lit(0.0)).alias("drop_rate"),
    )
    return features.where(keep), stats


def kept_by_split(kept: DataFrame) -> DataFrame:
    return kept.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a number in every column; NaN counts as none."""
    return rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]).dropna(subset=columns)


def enough(rows: DataFrame, keys: list[str], split: str = "split", least: int = 10, splits: int = 3) -> DataFrame:
    """Rows of those keys that have at least `least` rows in each of the splits."""
    per = rows.groupBy(*keys, split).agg(F.count(F.lit(1)).alias("_n"))
    fine = per.groupBy(*keys).agg(F.min("_n").alias("_least"), F.count(F.lit(1)).alias("_splits")).where((F.col("_least") >= least) & (F.col("_splits") >= splits))
    return rows.join(fine.select(*keys), keys, "left_semi")


def threshold_gate(rows: DataFrame, criteria: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The gate for any criteria: rows that meet all, and one row with what fails each and how many are kept."""
    sure = {k: F.coalesce(v, F.lit(False)) for k, v in criteria.items()}
    ok = F.lit(True)
    for v in sure.values():
        ok = ok & v
    return rows.where(ok), rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(~v).alias(f"failed_{k}") for k, v in sure.items()], F.count_if(ok).alias("n_kept"))
