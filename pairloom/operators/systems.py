"""The study of predictors: baselines, ridge from one pass of sums, selection, scores, and clustered inference.

Rows never come to the driver. Ridge needs counts, sums and products (k x k numbers for each key); inference over clusters
is in `inference`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import guarded_corr
from .inference import cluster_inference
from .quantiles import with_quantiles

#: The grid of ridge penalties.
LAMBDAS = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1e3, 1e4, 1e5, 1e6)


# -- scores ------------------------------------------------------------------


def error_metrics(rows: DataFrame, by: list[str], prediction: str, truth: str) -> DataFrame:
    """n, mae, medae, rmse and r (3 rows at least, both sides varying) of predictions."""
    e = F.col(prediction) - F.col(truth)
    full = rows.where(F.col(prediction).isNotNull() & F.col(truth).isNotNull())
    out = full.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), guarded_corr(prediction, truth, 3).alias("pearson_r"))
    return with_quantiles(out, full, by, F.abs(e), {"medae": 0.5}).select(*by, "n", "mae", "medae", "rmse", "pearson_r")


def versus_baseline(scores: DataFrame, by: list[str], system: str, value: str, baseline: str) -> DataFrame:
    """scores with the change against the baseline system of the same key in per cent, two places; NULL for a zero base."""
    base = F.max(F.when(F.col(system) == baseline, F.col(value))).over(W.partitionBy(*by))
    return scores.withColumn(f"{value}_vs_{baseline}_pct", F.when(base != 0, F.bround(100 * (F.col(value) - base) / base, 2)))


def baselines(rows: DataFrame, by: list[str], copy: str, target: str, split: str = "split") -> DataFrame:
    """rows with B0 (copy), B1 (train mean) and B2 (copy plus the train offset); keys without train rows have no B1, B2."""
    train = rows.where(F.col(split) == "train").groupBy(*by).agg(F.avg(target).alias("_mean"), F.avg(F.col(target) - F.col(copy)).alias("_offset"))
    met = rows.join(F.broadcast(train), by, "left") if by else rows.join(train, F.lit(True), "left")
    return met.withColumns({"B0": F.col(copy), "B1": F.col("_mean"), "B2": F.col(copy) + F.col("_offset")}).drop("_mean", "_offset")


def long_systems(rows: DataFrame, keep: list[str], systems: list[str]) -> DataFrame:
    return rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).cast("double").alias("prediction")) for s in systems])).alias("_s")).select(*keep, "_s.*")


# -- ridge -------------------------------------------------------------------


class Ridge:
    """Weights on standardised features, with an intercept that isn't penalised."""

    def __init__(self, features: list[str], weights: np.ndarray, mean: np.ndarray, sd: np.ndarray, intercept: float, penalty: float):
        self.features, self.weights, self.mean, self.sd, self.intercept, self.penalty = features, weights, mean, sd, intercept, penalty

    def column(self) -> Column:
        out = F.lit(float(self.intercept))
        for f, w, m, s in zip(self.features, self.weights, self.mean, self.sd, strict=True):
            out = out + F.lit(float(w)) * (F.col(f) - float(m)) / float(s)
        return out


class Moments:
    """n, means and centred products of features and target, from one pass."""

    def __init__(self, rows: DataFrame, features: list[str], target: str):
        self.features = features
        names = [*features, target]
        full = rows.dropna(subset=names)
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        got = full.agg(F.count(F.lit(1)), *[F.avg(n) for n in names], *[F.covar_pop(F.col(names[i]).cast("double"), F.col(names[j]).cast("double")) for i, j in pairs]).first()
        self.n = got[0]
        means = np.array([v if v is not None else 0.0 for v in got[1 : 1 + len(names)]], float)
        cov = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, got[1 + len(names) :], strict=True):
            cov[i, j] = cov[j, i] = v if v is not None else 0.0
        self.mean, self.y_mean = means[:-1], means[-1]
        self.cov, self.xy = cov[:-1, :-1], cov[:-1, -1]

    def ridge(self, penalty: float) -> Ridge:
        sd = np.sqrt(np.diag(self.cov))
        sd = np.where(sd < 1e-12, 1.0, sd)
        gram = self.n * self.cov / np.outer(sd, sd) + max(penalty, 1e-6) * np.eye(len(sd))
        w = np.linalg.lstsq(gram, self.n * self.xy / sd, rcond=None)[0]
        return Ridge(self.features, w, self.mean, sd, self.y_mean, penalty)


def one_se_penalty(models: list[Ridge], dev: DataFrame, copy: str, target: str) -> float:
    """The largest penalty whose dev error is within one standard error of the least; all penalties in one pass."""
    errors = [F.abs(F.col(copy) + m.column() - F.col(target)) for m in models]
    got = dev.agg(*[a for e in errors for a in (F.avg(e), F.stddev_samp(e), F.count(e))]).first()
    rows = [(m.penalty, got[3 * i], got[3 * i + 1], got[3 * i + 2]) for i, m in enumerate(models)]
    best = min(rows, key=lambda r: r[1])
    if best[3] < 2:
        return best[0]
    bar = best[1] + best[2] / math.sqrt(best[3])
    return max(r[0] for r in rows if r[1] <= bar)


def study(frame: DataFrame, features: list[str], copy: str, target: str, split: str = "split", penalties: tuple[float, ...] = LAMBDAS) -> tuple[DataFrame, Ridge]:
    """frame with B0, B1, B2 and ridge (B2's kind of prediction, with ridge on the residual from the copy)."""
    rows = baselines(frame, [], copy, target, split).withColumn("_residual", F.col(target) - F.col(copy))
    m = Moments(rows.where(F.col(split) == "train"), features, "_residual")
    models = [m.ridge(p) for p in penalties]
    chosen = m.ridge(one_se_penalty(models, rows.where(F.col(split) == "dev").dropna(subset=[*features, target]), copy, target))
    return rows.withColumn("ridge", F.col(copy) + chosen.column()).drop("_residual"), chosen


def standardised(rows: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """rows with x_std: less the train mean, over the train's population SD (1 where that is nothing)."""
    train = rows.where(F.col(split) == "train").agg(*[a for c in columns for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    met = rows.join(F.broadcast(train), F.lit(True))
    scale = lambda c: F.when(F.col(f"_s_{c}") < 1e-12, 1.0).otherwise(F.col(f"_s_{c}"))
    return met.withColumns({f"{c}_std": (F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in columns}).drop(*[x for c in columns for x in (f"_m_{c}", f"_s_{c}")])


def deployed(rows: DataFrame, gold: str, deploy: str) -> DataFrame:
    """rows with `used`, the deployment features if all are finite, else the gold ones, and `from_deploy`."""
    ok = F.coalesce(F.forall(deploy, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & (F.size(deploy) > 0)
    return rows.withColumn("from_deploy", ok).withColumn("used", F.when(ok, F.col(deploy)).otherwise(F.col(gold)))


# -- inference ---------------------------------------------------------------


def clustered(rows: DataFrame, cluster: str, error: str, base_error: str, seed: int = 498, draws: int = 2000) -> dict:
    """cluster_inference for one key, as a dict."""
    got = cluster_inference(rows, [], cluster, error, base_error, seed, draws).first()
    return got.asDict() if got else {"n_clusters": 0, "p": None, "ci_low": None, "ci_high": None, "excludes_zero": None}


def equivalent(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Whether two predictions agree within 1e-6 relative and 1e-9 absolute on all rows of a key."""
    close = F.abs(F.col(a) - F.col(b)) <= 1e-9 + 1e-6 * F.abs(F.col(b))
    return rows.groupBy(*by).agg(F.every(close).alias("equivalent"))


def holm(rows: DataFrame, p: str = "p", family: list[str] | None = None, out: str = "holm") -> DataFrame:
    """Holm's step-down adjustment within each family; missing p-values stay missing and don't count. A family is a
    report's tests; without one, all rows are one family and one task."""
    w = W.partitionBy(*(family or []), F.col(p).isNull())
    k = F.row_number().over(w.orderBy(p))
    raw = F.least(F.lit(1.0), (F.count(p).over(w) - k + 1) * F.col(p))
    ranked = rows.withColumn("_k", k).withColumn("_raw", raw)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.max("_raw").over(w.orderBy("_k").rowsBetween(W.unboundedPreceding, 0)))).drop("_k", "_raw")
