"""Summaries of result rows: reliability, means on two levels, guarded and decomposed correlations, paired deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import F0_HIGH, F0_LOW, col, finite, guarded_corr, pearson, semitones, strip
from ..functions.arrays import COEFFICIENTS, POINTS, array_corr, dct_decode, dct_encode
from ..sources.store import materialize
from ..sources.tables import PROSODY, SCORES
from .gate import gate
from .quantiles import with_quantiles


def reliability(rows: DataFrame, status: str = "status", ok: str = "ok", by: list[str] | None = None) -> DataFrame:
    """attempted, succeeded, failed and failure_rate (0 without rows). A missing status is a failure."""
    good = F.coalesce(F.col(status) == ok, F.lit(False))
    n = F.count(F.lit(1))
    return rows.groupBy(*(by or [])).agg(n.alias("attempted"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.coalesce(F.try_divide(F.count_if(~good), n), F.lit(0.0)).alias("failure_rate"))


def row_means(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """mean_x over finite values and x_count."""
    return rows.groupBy(*by).agg(*[a for v in values for a in (F.avg(finite(v)).alias(f"mean_{v}"), F.count(finite(v)).alias(f"{v}_count"))])


def two_level_means(rows: DataFrame, by: list[str], group: str, values: list[str]) -> DataFrame:
    """group_mean_x, the unweighted mean of the groups' means, and x_groups. A blank group is a group of its own; the
    first step combines map-side, the second sees one row for each group."""
    own = rows.groupBy(*by, F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g")).agg(*[F.avg(finite(v)).alias(v) for v in values])
    return own.groupBy(*by).agg(*[a for v in values for a in (F.avg(v).alias(f"group_mean_{v}"), F.count(v).alias(f"{v}_groups"))])


def prosody_long(results: DataFrame) -> DataFrame:
    """(keys, feature, generated, reference) of rows with one speaker on both sides; pitch in semitones, mean pitch only
    where both are plausible."""
    good = results.where((F.col("status") == "ok") & F.coalesce(F.col("same_speaker_pair"), F.lit(False)))
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_generated").alias("generated"), F.col(f"{f}_target_reference").alias("reference")) for f in PROSODY])
    long = good.select("direction", "speaker_id", F.explode(items).alias("_i")).select("direction", "speaker_id", "_i.*")
    g, r = F.col("generated"), F.col("reference")
    band = (F.col("feature") != "f0_mean") | (g.between(F0_LOW, F0_HIGH) & r.between(F0_LOW, F0_HIGH))
    pitch = F.col("feature").startswith("f0")
    long = long.where(g.isNotNull() & r.isNotNull() & band & (~pitch | ((g > 0) & (r > 0))))
    return long.withColumns({"generated": F.when(pitch, semitones(g)).otherwise(g), "reference": F.when(pitch, semitones(r)).otherwise(r)})


def correlations(long: DataFrame, by: list[str], x: str, y: str, least: int = 2) -> DataFrame:
    return long.groupBy(*by).agg(guarded_corr(x, y, least).alias("pearson_r"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))


def decomposition(rows: DataFrame, x: str, y: str, group: str, by: list[str] | None = None, drop_singletons: bool = True, least: int = 3) -> DataFrame:
    """pooled_r, within_r of group-centred values, between_r of group means (3 groups at least), n, n_groups and the share
    of x's variance that lies between groups; one shuffle, from each group's sums."""
    keys = by or []
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = rows.where(a.isNotNull() & b.isNotNull())
    g = both.groupBy(*keys, F.col(group).alias("_g")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.var_pop(a).alias("vx"), F.var_pop(b).alias("vy"), F.covar_pop(a, b).alias("cxy"))
    use = F.col("n") > 1 if drop_singletons else F.col("n") > 0
    n, mx, my = F.col("n"), F.col("mx"), F.col("my")

    def total(v: Column, only: Column | None = None) -> Column:
        return F.sum(F.when(only, v) if only is not None else v)

    grand = g.groupBy(*keys).agg((F.sum(n * mx) / F.sum(n)).alias("_grand"))
    g = g.join(grand, keys) if keys else g.join(grand, F.lit(True))
    shift = mx - F.col("_grand")
    sums = g.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.count_if(use).alias("n_groups"),
        pearson(F.sum(n), F.sum(n * mx), F.sum(n * my), F.sum(n * (F.col("vx") + mx * mx)), F.sum(n * (F.col("vy") + my * my)), F.sum(n * (F.col("cxy") + mx * my)), least).alias("pooled_r"),
        F.when(total(n, use) >= least, F.try_divide(total(n * F.col("cxy"), use), F.sqrt(total(n * F.col("vx"), use) * total(n * F.col("vy"), use)))).alias("within_r"),
        guarded_corr(F.when(use, mx), F.when(use, my), 3).alias("between_r"),
        F.try_divide(total(n * shift * shift, use), total(n * shift * shift + n * F.col("vx"), use)).alias("between_share"),
    )
    return sums.withColumn("n", F.col("n").cast("long"))


def centred(rows: DataFrame, values: list[str], group: list[str]) -> DataFrame:
    """rows with x_centred, the value less its group's mean."""
    w = W.partitionBy(*group)
    return rows.withColumns({f"{v}_centred": F.col(v) - F.avg(v).over(w) for v in values})


def paired_deltas(rows: DataFrame, measures: dict[str, tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """For each measure (first, second): n, means, sample SDs, mean delta second - first with its 95 % interval, and r."""
    items = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for m, (a, b) in measures.items()])
    long = rows.select(*(by or []), F.explode(items).alias("_i")).select(*(by or []), "_i.*").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    d = F.col("b") - F.col("a")
    half = 1.96 * F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))
    return long.groupBy(*(by or []), "measure").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.stddev_samp("a").alias("sd_a"), F.stddev_samp("b").alias("sd_b"), F.avg(d).alias("delta"), (F.avg(d) - half).alias("delta_low"), (F.avg(d) + half).alias("delta_high"), guarded_corr("a", "b", 2).alias("pearson_r"))


def ratio_stats(rows: DataFrame, over: str, under: str, by: list[str] | None = None) -> DataFrame:
    """n, median, mean, sample SD and 90th percentile of a ratio; pairs without a positive denominator are left out."""
    r = F.when(F.col(under) > 0, F.col(over) / F.col(under))
    out = rows.groupBy(*(by or [])).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"))
    return with_quantiles(out, rows, by or [], r, {"median": 0.5, "p90": 0.9}).select(*(by or []), "n", "median", "mean", "p90", "sd")


def as_numbers(table: DataFrame, by: list[str], columns: list[str], prefix: str | Column = "") -> DataFrame:
    """(by..., name, value): a table's columns as rows, with a prefix to their names."""
    lead = F.lit(prefix) if isinstance(prefix, str) else prefix
    items = F.array(*[F.struct(F.concat(lead, F.lit(c)).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return table.select(*by, F.explode(items).alias("_i")).select(*by, "_i.*")


DECOMPOSED = ["pooled_r", "within_r", "between_r", "n", "n_groups", "between_share"]
IDENTITY, ERRORS = ("speaker_similarity", "human_target_speaker_similarity"), ("asr_wer", "tts_intelligibility_wer")


def pipeline_numbers(results: DataFrame) -> DataFrame:
    """(direction, name, value): every number that a report of the pipeline states. direction is null for all rows together.

    Over rows that are ok: scores as means over rows and over speakers, similarity as a percentage of the human one, five prosody
    measures against the human target's (one speaker on both sides; three rows at least) split within and between
    speakers, and durations over the human ones.
    """
    good = results.where(F.col("status") == "ok")
    key = ["direction"]
    whole = reliability(results).withColumn("direction", F.lit(None).cast("string"))
    parts = [as_numbers(whole, key, ["attempted", "succeeded", "failed", "failure_rate"])]
    parts.append(as_numbers(good.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key, ["n"]))
    by_row, by_speaker = row_means(good, key, [*IDENTITY, *ERRORS]), two_level_means(good, key, "speaker_id", [*IDENTITY, *ERRORS])
    names = {f"mean_{f}": f"{f}_row_mean" for f in (*IDENTITY, *ERRORS)}
    parts.append(as_numbers(by_row.withColumnsRenamed(names), key, list(names.values())))
    names = {f"group_mean_{f}": f"{f}_speaker_mean" for f in (*IDENTITY, *ERRORS)} | {f"{f}_groups": f"{f}_n_speakers" for f in IDENTITY}
    ceiling = by_speaker.withColumnsRenamed(names).withColumn("identity_pct_of_ceiling", 100 * F.try_divide(*[F.col(f"{f}_speaker_mean") for f in IDENTITY]))
    parts.append(as_numbers(ceiling, key, [*names.values(), "identity_pct_of_ceiling"]))
    same = F.coalesce(F.col("same_speaker_pair"), F.lit(False))
    parts.append(as_numbers(good.groupBy(*key).agg(F.count_if(same).alias("prosody_n_same_speaker")), key, ["prosody_n_same_speaker"]))
    split = decomposition(prosody_long(results), "generated", "reference", "speaker_id", [*key, "feature"]).where("n >= 3")
    parts.append(as_numbers(split, key, DECOMPOSED, F.concat(F.lit("gen_vs_human_"), F.col("feature"), F.lit("_"))))
    made, human = (F.when(F.col(f"duration_{r}") != 0, F.col(f"duration_{r}")) for r in ("generated", "target_reference"))
    timed = good.withColumns({"_made": made, "_human": human})
    ratio = ratio_stats(timed.withColumn("_made", F.when(F.col("_human").isNotNull(), F.col("_made"))), "_made", "_human", key)
    parts.append(as_numbers(ratio, key, ["n", "median", "mean", "p90"], "duration_ratio_"))
    parts.append(as_numbers(timed.groupBy(*key).agg(F.avg("_made").alias("mean_generated_s"), F.avg("_human").alias("mean_human_s")), key, ["mean_generated_s", "mean_human_s"], "duration_ratio_"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


#: What a human pair is compared in: name, and the columns of its two sides.
HUMAN = {"f0_mean": ("en_f0_mean_st", "es_f0_mean_st"), "f0_std": ("en_f0_std_st", "es_f0_std_st"), "duration": ("en_duration", "es_duration"), "speaking_rate": ("en_speaking_rate", "es_speaking_rate")}


def human_numbers(features: DataFrame) -> DataFrame:
    """(name, value) over feature rows of one speaker that pass the gate: the gate's account, measures of the two sides split
    within and between speakers, the ratio of their durations, and how many speakers there are."""
    kept, stats = gate(features)
    long = kept.select("en_speaker", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for m, (a, b) in HUMAN.items()])).alias("_i")).select("en_speaker", "_i.*")
    split = decomposition(long, "x", "y", "en_speaker", ["m"])
    ratio = ratio_stats(kept, "es_duration", "en_duration")
    speakers = kept.agg(F.countDistinct("en_speaker").alias("n_speakers"))
    out = as_numbers(stats, [], stats.columns, "gate_")
    for part in (as_numbers(split, [], DECOMPOSED, F.concat("m", F.lit("_"))), as_numbers(ratio, [], ["n", "median", "mean", "sd"], "es_over_en_duration_"), as_numbers(speakers, [], ["n_speakers"])):
        out = out.unionByName(part)
    return out


def reconstruction_stats(rows: DataFrame, shape: str, by: list[str] | None = None, points: int = POINTS, coefficients: int = COEFFICIENTS) -> DataFrame:
    """How much of contours survives their DCT: contours, median, mean and 10th percentile of r with what comes back, and median
    root mean squared error. Contours that hardly vary, or are missing or not finite in a place, are left out."""
    s = F.col(shape)
    fine = F.coalesce((F.size(s) == points) & F.forall(s, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    back = rows.where(fine).withColumn("_back", dct_decode(dct_encode(shape, points, coefficients), points, coefficients))
    square = F.aggregate(F.zip_with(s, F.col("_back"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    told = back.select(*(by or []), array_corr(shape, "_back").alias("_r"), F.sqrt(square / points).alias("_rmse")).where("_r IS NOT NULL")
    out = told.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("contours"), F.avg("_r").alias("r_mean"))
    out = with_quantiles(out, told, by or [], "_r", {"r_median": 0.5, "r_p10": 0.1})
    return with_quantiles(out, told, by or [], "_rmse", {"rmse_median": 0.5})


def corpus_counts(manifest: DataFrame) -> DataFrame:
    """Pairs, same- and cross-speaker pairs, texts, and the distinct speakers of both columns together."""
    speakers = manifest.select(F.explode(F.array("english_speaker_id", "spanish_speaker_id")).alias("s")).where("s <> ''").agg(F.countDistinct("s").alias("speakers"))
    same = F.coalesce(F.col("same_speaker_pair"), F.lit(False))
    rows = manifest.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(same).alias("same_speaker"), F.count_if(~same).alias("different_speaker"), F.count_if(strip("english_text") != "").alias("english_texts"), F.count_if(strip("spanish_text") != "").alias("spanish_texts"))
    return rows.join(speakers, F.lit(True))


def split_counts(rows: DataFrame, splits: tuple[str, ...] = ("train", "dev", "test"), by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(*[F.count_if(F.col("split") == s).alias(s) for s in splits])


def summarize(results: DataFrame) -> DataFrame:
    """One row for each direction: reliability, score means on both levels with counts, correlations of pitch and the
    other measures. Corpus BLEU, chrF and error rates come from text_metrics, joined by direction."""
    good = results.where(F.col("status") == "ok")
    out = reliability(results, by=["direction"]).join(row_means(good, ["direction"], list(SCORES)), "direction", "left")
    out = out.join(two_level_means(good, ["direction"], "speaker_id", list(SCORES)), "direction", "left")
    r = correlations(prosody_long(results), ["direction", "feature"], "generated", "reference")
    wide = r.groupBy("direction").pivot("feature", list(PROSODY)).agg(F.first("pearson_r").alias("r"), F.first("n").alias("n"))
    return out.join(wide, "direction", "left")


def percent_of_ceiling(rows: DataFrame, value: str, ceiling: str, by: list[str], group: str) -> DataFrame:
    """Two-level means of a score and its ceiling, and the score as a percentage of it."""
    m = two_level_means(rows, by, group, [value, ceiling])
    return m.withColumn("percent_of_ceiling", 100 * F.try_divide(F.col(f"group_mean_{value}"), F.col(f"group_mean_{ceiling}")))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """An aggregate: missing values leave out their weight; NULL without weight."""
    v, w = col(value), col(weight)
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def job_totals(jobs: DataFrame) -> DataFrame:
    """Per job, over segments without an error: final and raw seconds over the original's, clamped, truncated, failed."""
    seg = jobs.select("job_id", F.explode_outer("segments").alias("s")).select("job_id", "s.*")
    ok = F.coalesce(F.col("status") != "error", F.col("index").isNotNull())
    sums = {k: F.sum(F.when(ok, F.col(f"{k}_seconds"))) for k in ("original", "raw", "final")}
    return seg.groupBy("job_id").agg(F.when(sums["original"] > 0, sums["final"] / sums["original"]).alias("final_ratio"), F.when(sums["original"] > 0, sums["raw"] / sums["original"]).alias("raw_ratio"), F.count_if(ok & F.coalesce("clamped", F.lit(False))).alias("clamped"), F.count_if(ok & (F.coalesce("truncated_seconds", F.lit(0.0)) > 0)).alias("truncated"), F.count_if(F.col("index").isNotNull() & ~ok).alias("failed"), weighted_mean("similarity", F.when(ok, F.lit(1.0))).alias("similarity"))


def job_speakers(jobs: DataFrame) -> DataFrame:
    """Per job and speaker: segments, voiced ones, seconds, mean similarity."""
    seg = jobs.select("job_id", F.explode("segments").alias("s")).select("job_id", "s.*")
    return seg.groupBy("job_id", "speaker").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("final_seconds") > 0).alias("voiced"), F.sum("original_seconds").alias("seconds"), F.avg("similarity").alias("similarity"))


def job_similarity(speakers: DataFrame, by: list[str], similarity: str = "similarity", voiced: str = "voiced") -> DataFrame:
    """Mean similarity of a job's speakers, each weighing as many segments as are voiced; speakers without a score leave out
    their weight, and a job whose scored speakers have no voiced segment has none."""
    return speakers.groupBy(*by).agg(weighted_mean(similarity, voiced).alias("similarity"))


def remaining_time(steps: DataFrame, by: str, order: str, seconds: str, total: str, last: int = 5, margin: float = 1.14) -> DataFrame:
    """After each step, the median of the last steps' seconds (never the first step's) times what remains times a margin;
    NULL before the third step."""
    w = W.partitionBy(by).orderBy(order)
    timed = steps.withColumn("_k", F.row_number().over(w)).withColumn("_t", F.when(F.col("_k") > 1, F.col(seconds)))
    recent = timed.withColumn("_recent", F.collect_list("_t").over(w.rowsBetween(-(last - 1), 0)))
    s, n = F.sort_array("_recent"), F.size("_recent")
    mid = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return recent.withColumn("eta_seconds", F.when(n >= 2, mid * (F.col(total) - F.col("_k")) * margin)).drop("_k", "_t", "_recent")


def settled_means(rows: DataFrame, key: str, limits: dict[str, list[float]], order: list[str]) -> DataFrame:
    """key and the mean of each column that limits names, not null ones only. Sums of doubles depend on the order of addition; where
    that decides on which side of one of the column's limits a mean lies, its sum is taken row by row in the given order, so that
    reruns agree. Only such keys' rows are sorted, and shuffled unless they are many; each of them goes through one task, which may spill.
    """
    aggs = [a for c in limits for a in (F.count(c).alias(f"_n_{c}"), F.avg(c).alias(c), F.avg(F.abs(F.col(c))).alias(f"_size_{c}"))]
    means, _ = materialize(rows.groupBy(F.col(key).alias("_key")).agg(*aggs), "means")
    # any two orders' means differ by less than 2 n 2^-53 of the mean size
    near = [F.abs(F.col(c) - x) <= (4 * F.col(f"_n_{c}") + 16) * 2.0**-53 * F.col(f"_size_{c}") for c, at in limits.items() for x in at]
    # written, so that a join knows its size and leaves all other rows where they are if it is small
    open_keys, _ = materialize(means.where(reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in near])).select("_key"), "open-keys")
    run = W.partitionBy("_key").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    met = rows.join(open_keys, F.col(key).eqNullSafe(F.col("_key")))
    sums = met.select("_key", *[F.sum(c).over(run).alias(f"_sum_{c}") for c in limits], F.count(F.lit(1)).over(run).alias("_row"))
    last = sums.groupBy(F.col("_key").alias("_open")).agg(*[F.max_by(f"_sum_{c}", "_row").alias(f"_sum_{c}") for c in limits])
    out = means.join(last, F.col("_key").eqNullSafe(F.col("_open")), "left")
    return out.select(F.col("_key").alias(key), *[F.coalesce(F.try_divide(f"_sum_{c}", F.col(f"_n_{c}").cast("double")), F.col(c)).alias(c) for c in limits])


def classify_effects(rows: DataFrame, p: str = "p", delta: str = "delta", tests: int = 6, small: float = 0.5) -> DataFrame:
    """survives (p under 0.05 / tests), negligible (it does, but the effect is small) or not_significant."""
    sure = F.col(p) < 0.05 / tests
    return rows.withColumn("effect", F.when(sure & (F.abs(delta) < small), "negligible").when(sure, "survives").otherwise("not_significant"))


def share_of_gain(rows: DataFrame, by: list[str], arm: str, value: str, floor: list[str], top: str) -> DataFrame:
    """Each arm's share of the way from the better floor arm (least error) to the top arm."""
    arms = {a: F.max(F.when(F.col(arm) == a, F.col(value))) for a in (*floor, top)}
    ends = rows.groupBy(*by).agg((F.least(*[arms[a] for a in floor]) if len(floor) > 1 else arms[floor[0]]).alias("_floor"), arms[top].alias("_top"))
    return rows.join(ends, by).withColumn("share_of_gain", F.try_divide(F.col("_floor") - F.col(value), F.col("_floor") - F.col("_top"))).drop("_floor", "_top")


def ladder(rows: DataFrame, by: list[str], arm: str, got: str, want: str, span: tuple[str, str], shape_r: str, seconds: tuple[str, str], speaker: str) -> DataFrame:
    """One row for each key and arm: level and span errors, r pooled and within speakers (singletons kept, over 3 rows),
    mean shape r, duration ratio, speakers."""
    keys = [*by, arm]
    full = rows.where(F.col(got).isNotNull() & F.col(want).isNotNull())
    table = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(got) - F.col(want))).alias("level_mae"), F.avg(F.abs(F.col(span[0]) - F.col(span[1]))).alias("span_mae"), guarded_corr(got, want, 4).alias("r_pooled"), F.avg(shape_r).alias("shape_r_mean"), F.avg(F.try_divide(F.col(seconds[0]), F.col(seconds[1]))).alias("duration_ratio"), F.countDistinct(speaker).alias("n_speakers"))
    within = decomposition(full, got, want, speaker, keys, drop_singletons=False, least=4).select(*keys, F.col("within_r").alias("r_within"))
    return table.join(within, keys, "left")
