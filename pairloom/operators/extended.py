"""The extended study: more inputs, arms as they would be deployed, judgement of all systems at once, shapes of contours.

Rows stay in Spark; of a report's table, which has a row for each key and system, Holm's adjustment alone is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.numeric import finite
from ..sources.store import materialize
from . import inference, pairing, quantiles, systems

#: Inputs beside those of T1, and the names of the contour's coefficients.
WORD_INPUTS = ("mt_words", "log_word_ratio")
DCT_INPUTS = tuple(f"s_dct_{k}" for k in range(1, arrays.COEFFICIENTS + 1))
FEATURES_FULL = (*pairing.FEATURES_T1, *WORD_INPUTS, *DCT_INPUTS)
#: Fixed value: rows of a split without which a key isn't judged.
LEAST_ROWS = 10


def word_ratio(translated: Column, source: Column) -> Column:
    return F.ln((translated.cast("double") + 1) / (source.cast("double") + 1))


def with_full(frame: DataFrame, mt_words: str = "mt_words", shape: str = "s_shape") -> DataFrame:
    """frame with all inputs of FEATURES_FULL: words of the translation, their ratio, and the source contour's coefficients.
    Null where the words or the contour are missing, or the contour isn't of the fixed length or not finite."""
    points = F.col(shape)
    whole = (F.size(points) == arrays.POINTS) & F.forall(points, lambda v: finite(v).isNotNull())
    out = frame.withColumns({"mt_words": F.col(mt_words).cast("double"), "_dct": F.when(whole, arrays.dct_encode(F.col(shape)))})
    out = out.withColumn("log_word_ratio", word_ratio(F.col("mt_words"), F.col("s_n_words")))
    return out.withColumns({name: F.get("_dct", F.lit(k)) for k, name in enumerate(DCT_INPUTS)}).drop("_dct")


def with_deployed(frame: DataFrame, by: list[str], asr_words: str = "asr_words", mt_asr_words: str = "mt_asr_words") -> DataFrame:
    """frame with `deployed`, its scalar inputs (T1 and words) as they are when the words come from recognised speech.

    A row whose deployed inputs aren't all finite keeps its gold ones (`from_deploy` is false), so that arms stay paired; in a
    key without any row that has them, `deployed` is null and the arm has no results.
    """
    names = [*pairing.FEATURES_T1, *WORD_INPUTS]
    heard, said = F.col(asr_words).cast("double"), F.col(mt_asr_words).cast("double")
    swap = {"s_n_words": heard, "s_speaking_rate": F.when(F.col("s_duration") > 0, heard / F.col("s_duration")), "mt_words": said, "log_word_ratio": word_ratio(said, heard)}
    gold, deploy = (F.array(*[c.cast("double") for c in cs]) for cs in ([F.col(n) for n in names], [swap.get(n, F.col(n)) for n in names]))
    out = systems.deployed(frame.withColumns({"_gold": gold, "_deploy": deploy}), "_gold", "_deploy")
    some = out.groupBy(*by).agg(F.max("from_deploy").alias("_some"))
    met = inference._same_key(out, F.broadcast(some), by)  # a row a key: directions of a study
    return met.withColumn("deployed", F.when(F.col("_some"), F.col("used"))).drop("_gold", "_deploy", "used", "_some")


def coverage(frame: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rows, coverage): the share of rows with deployed inputs of their own."""
    return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("from_deploy").cast("double")).alias("coverage"))


def with_predictions(frame: DataFrame, sets: dict[str, list[str]], copy: str, target: str, split: str = "split") -> DataFrame:
    """frame with B0, B1, B2 and a ridge of the residual from the copy for each set of features. Rows without a set's
    features have no prediction of it."""
    rows = systems.baselines(frame, [], copy, target, split)
    residual = rows.withColumn("_residual", F.col(target) - F.col(copy))
    made = {}
    for name, features in sets.items():
        moments = systems.Moments(residual.where(F.col(split) == "train"), features, "_residual")
        dev = rows.where(F.col(split) == "dev").dropna(subset=[*features, copy, target])
        penalty = systems.one_se_penalty([moments.ridge(p) for p in systems.LAMBDAS], dev, copy, target)
        made[name] = F.col(copy) + moments.ridge(penalty).column()
    return rows.withColumns(made)


def judged(rows: DataFrame, by: list[str], names: list[str], truth: str, cluster: str, baseline: str = "B2", primary: tuple[str, ...] = (), draws: int = 2000, seed: int = 498) -> DataFrame:
    """One row for each key and system: n, mae, medae, rmse, pearson_r; against the baseline's errors on the same rows the
    change of mae in per cent, whether the errors are the same, the signed-rank test over rows and over clusters, the
    interval over resampled clusters; and Holm's adjustment of the clusters' p over all systems, and over `primary` alone.

    A system whose errors are the baseline's, or whose predictions are, has p of 1: a rank test of differences that are rounding
    finds an effect of no size. Errors alone don't tell where the baseline is all but right: beside an error near 0 any rounding
    of a prediction is large. `equivalent` speaks of errors. The baseline itself has no tests. Rows without truth or the baseline's prediction take no part; rows without a
    system's prediction none for that system.
    """
    whole = rows.select(*by, F.col(cluster).alias("_cluster"), finite(F.col(truth).cast("double")).alias("_truth"), *[finite(F.col(n).cast("double")).alias(n) for n in names])
    # predictions may be dear: they are worked out once for all that follows
    kept, _ = materialize(whole.where(F.col("_truth").isNotNull() & F.col(baseline).isNotNull()), "predictions")
    base = kept.withColumns({"_base": F.abs(F.col(baseline) - F.col("_truth")), "_basis": F.col(baseline)})
    long = systems.long_systems(base, [*by, "_cluster", "_truth", "_base", "_basis"], names).where("prediction is not null")
    long = long.withColumns({"_error": F.abs(F.col("prediction") - F.col("_truth"))}).withColumn("_difference", F.col("_error") - F.col("_base"))
    keys = [*by, "system"]
    other = long.where(F.col("system") != baseline)
    table = systems.versus_baseline(systems.error_metrics(long, keys, "prediction", "_truth"), by, "system", "mae", baseline)
    for part in (
        systems.equivalent(other, keys, "_error", "_base"),
        systems.equivalent(other, keys, "prediction", "_basis").withColumnRenamed("equivalent", "_alike"),
        inference.signed_ranks(other, keys, "_difference").select(*keys, F.col("p").alias("p_rows")),
        inference.cluster_inference(other, keys, "_cluster", "_error", "_base", seed, draws),
    ):
        table = inference._same_key(table, part, keys)
    same = F.coalesce(F.col("equivalent") | F.col("_alike"), F.lit(False))
    table = table.withColumns({c: F.when(same, 1.0).otherwise(F.col(c)) for c in ("p_rows", "p")}).withColumn("is_primary", F.col("system").isin(*primary) if primary else F.lit(False)).drop("_alike")
    table, _ = materialize(table, "judged")
    table = systems.holm(table, "p", out="holm_all").withColumn("_primary", F.when(F.col("is_primary"), F.col("p")))
    return systems.holm(table, "_primary", out="holm_primary").drop("_primary")


def families(table: DataFrame) -> DataFrame:
    """(family_size, family_size_all): tests that Holm's two adjustments were over."""
    return table.agg(F.count(F.when(F.col("is_primary"), F.col("p"))).alias("family_size"), F.count("p").alias("family_size_all"))


def shape_scores(rows: DataFrame, by: list[str], arms: dict[str, str | Column], truth: str) -> DataFrame:
    """(by..., system, n, shape_r_mean, shape_r_median) of the correlations of predicted contours with the true ones, over rows
    in which both vary. An arm without such rows has n 0."""
    told = F.array(*[F.struct(F.lit(name).alias("system"), arrays.array_corr(shape, F.col(truth)).alias("_r")) for name, shape in arms.items()])
    long = rows.select(*by, F.explode(told).alias("_s")).select(*by, "_s.*")
    table = long.groupBy(*by, "system").agg(F.count("_r").alias("n"), F.avg("_r").alias("shape_r_mean"))
    return quantiles.with_quantiles(table, long, [*by, "system"], "_r", {"shape_r_median": 0.5}).select(*by, "system", "n", "shape_r_mean", "shape_r_median")


def decoded_with_offset(frame: DataFrame, by: list[str], source: str, target: str, split: str = "split") -> DataFrame:
    """frame with `B2_shape`: the contour of the source's coefficients, each moved by its mean change over train rows."""
    moves = [F.avg(F.get(target, F.lit(k)) - F.get(source, F.lit(k))).alias(f"_{k}") for k in range(arrays.COEFFICIENTS)]
    train = frame.where(F.col(split) == "train").groupBy(*by).agg(*moves).select(*by, F.array(*[f"_{k}" for k in range(arrays.COEFFICIENTS)]).alias("_moves"))
    met = inference._same_key(frame, F.broadcast(train), by)  # a row a key: directions of a study
    return met.withColumn("B2_shape", arrays.dct_decode(F.zip_with(source, "_moves", lambda a, b: a + b))).drop("_moves")
