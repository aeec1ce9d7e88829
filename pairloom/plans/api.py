"""The tool's commands as functions from paths to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import extended, gate, graph, inference, pairing, resume, summary, systems, text_metrics
from ..sources import tables

#: Named feature subsets.
FEATURE_SETS = {"t0": pairing.FEATURES_T0, "t1": pairing.FEATURES_T1, "full": extended.FEATURES_FULL}


def inspect(spark: SparkSession, root: str) -> DataFrame:
    return tables.inventory(spark, root)


def build_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Pairs below root; an error if there is no metadata or no complete pair."""
    found = tables.files(spark, root, "fragments-short.csv").select("path").orderBy("path").collect()
    if not found:
        raise FileNotFoundError(f"no fragments-short.csv below {root}")
    rows = None
    for r in found:
        part = tables.read_csv(spark, r["path"])
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rows = rows.na.fill("")
    pairs = pairing.link_pairs(tables.fragments(rows), tables.audio_index(tables.files(spark, root, "*.wav")))
    if pairs.isEmpty():
        raise ValueError("metadata was found, but no complete pair")
    return pairs


def split_manifest(manifest: DataFrame, seed: int = 498, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    out = graph.assign_splits(manifest, seed, ratios)
    graph.require_disjoint(out, ["english_speaker_id", "spanish_speaker_id"])
    return out


def merge_transcripts(spark: SparkSession, manifest: DataFrame, *paths: str) -> DataFrame:
    sources = [tables.transcripts_csv(tables.read_csv(spark, p)) if p.lower().endswith(".csv") else tables.transcripts_piped(spark.read.text(p)) for p in paths]
    return pairing.merge_transcripts(manifest, pairing.merge_sources(*sources))


def todo(spark: SparkSession, manifest: DataFrame, results: str, split: str | None = None, limit: int | None = None) -> DataFrame:
    """Result rows still to be made: of a split, of the first `limit` pairs, without those that are done well."""
    rows = manifest.where(F.col("split") == split) if split else manifest
    rows = rows.orderBy("pair_id").limit(limit) if limit is not None else rows
    return resume.pending(pairing.result_rows(rows), tables.read_results(spark, results), ["sample_id", "direction"], F.col("status") != "ok")


def summarize(spark: SparkSession, results: str) -> DataFrame:
    rows = tables.read_results(spark, results)
    out = summary.summarize(rows).join(text_metrics.error_rates(rows), "direction", "left")
    good = rows.where(F.col("status") == "ok")
    return out.join(text_metrics.translation_scores(good, ["direction"], "translated_text", "translation_reference"), "direction", "left")


def report(features: DataFrame, features_named: str = "t1") -> dict[str, DataFrame]:
    """T1 gate account, T3 paired deltas, T4 scores of the systems by direction and target, with inference over speakers: each
    system's absolute errors against those of the copy with an offset."""
    kept, stats = gate.gate(features)
    graph.require_disjoint(kept, ["en_speaker", "es_speaker"])
    frame = pairing.directional(kept)
    measures = {m: (f"en_{m}", f"es_{m}") for m in ("f0_mean_st", "f0_std_st", "duration", "speaking_rate")}
    scores = None
    names = list(FEATURE_SETS[features_named])
    for direction in ("en-es", "es-en"):
        for target in pairing.TARGETS:
            rows = gate.complete(frame.where(F.col("direction") == direction), [*names, f"copy_{target}", f"target_{target}"])
            n = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
            if min((n.get(s, 0) for s in ("train", "dev", "test")), default=0) < 10:
                continue
            made, _ = systems.study(rows, names, f"copy_{target}", f"target_{target}")
            long = systems.long_systems(made.where("split = 'test'").withColumn("truth", F.col(f"target_{target}")), ["truth"], ["B0", "B1", "B2", "ridge"])
            one = systems.error_metrics(long, ["system"], "prediction", "truth")
            error = lambda c: F.abs(F.col(c) - F.col(f"target_{target}"))
            speaker = made.where("split = 'test'").select("speaker", error("B2").alias("base"), F.explode(F.array(*[F.struct(F.lit(s).alias("system"), error(s).alias("error")) for s in ("B0", "B1", "ridge")])).alias("_s")).select("speaker", "base", "_s.*")
            sure = inference.cluster_inference(speaker, ["system"], "speaker", "error", "base")
            one = one.join(sure, "system", "left").select(F.lit(direction).alias("direction"), F.lit(target).alias("target"), "*")
            scores = one if scores is None else scores.unionByName(one)
    out = {"T1_gate": stats, "T3_corpus": summary.paired_deltas(kept, measures)}
    if scores is not None:
        out["T4_results"] = systems.versus_baseline(scores, ["direction", "target"], "system", "mae", "B2")
    return out


def extended_study(frame: DataFrame, arms: tuple[str, ...] = (), split: str = "test", sets: tuple[str, ...] = ("t0", "t1", "full"), draws: int = 2000) -> dict[str, DataFrame]:
    """All systems of both directions and all targets in one table, and the shapes' correlations.

    frame: a directional frame with the inputs of `extended.with_full` and the contours s_shape and t_shape. arms: columns of
    networks' predictions (as they were trained or as deployed), each an array of the targets in their order, the level, then
    the target contour's coefficients; they are the primary family but for those that end in `_deploy`. A direction with fewer
    than ten rows of the split is left out; where none is left, that is an error.
    """
    wide = None
    n = {(r.direction, r.split): r["count"] for r in frame.where(F.col("split").isin("train", "dev", split)).groupBy("direction", "split").count().collect()}
    least = extended.LEAST_ROWS
    judged_here = [d for d in ("en-es", "es-en") if n.get((d, split), 0) >= least and n.get((d, "train"), 0) and n.get((d, "dev"), 0)]
    if not judged_here:
        raise ValueError(f"no direction with {least} rows of {split}")
    named = {f"ridge_{s}": list(FEATURE_SETS[s]) for s in sets}
    for direction in judged_here:
        own = frame.where(F.col("direction") == direction)
        for i, target in enumerate(pairing.TARGETS):
            rows = gate.complete(own, [f"copy_{target}", f"target_{target}"])
            made = extended.with_predictions(rows, named, f"copy_{target}", f"target_{target}").where(F.col("split") == split)
            part = made.select("direction", F.lit(target).alias("target"), "speaker", F.col(f"target_{target}").cast("double").alias("truth"), "B0", "B1", "B2", *named, *[F.get(F.col(a), F.lit(i)).alias(a) for a in arms])
            wide = part if wide is None else wide.unionByName(part)
    primary = tuple(a for a in arms if not a.endswith("_deploy"))
    table = extended.judged(wide, ["direction", "target"], ["B0", "B1", "B2", *named, *arms], "truth", "speaker", primary=primary, draws=draws)
    coded = frame.withColumns({"_s": arrays.dct_encode(F.col("s_shape")), "_t": arrays.dct_encode(F.col("t_shape"))})
    coded = extended.decoded_with_offset(coded.where(F.col("direction").isin(judged_here)), ["direction"], "_s", "_t").where(F.col("split") == split)
    first = len(pairing.TARGETS) + 2
    shapes = {"B0": F.col("s_shape"), "B2": F.col("B2_shape")} | {a: arrays.dct_decode(F.slice(a, first, arrays.COEFFICIENTS)) for a in arms}
    return {"table": table, "families": extended.families(table), "shape": extended.shape_scores(coded, ["direction"], shapes, "t_shape")}


def numbers(spark: SparkSession, results: str, features: DataFrame) -> dict[str, DataFrame]:
    """The numbers of the pipeline's results and of the human pairs, each as rows of a name and a value."""
    return {"pipeline": summary.pipeline_numbers(tables.read_results(spark, results)), "human": summary.human_numbers(features)}


def leakcheck(mt: DataFrame, synthesis: DataFrame) -> DataFrame:
    """r and mean absolute difference of the three pairs of word counts; an error where the tables share no row."""
    out = pairing.leak_numbers(pairing.leak_check(mt, synthesis))
    return out.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no overlapping rows between the two tables")).cast("long")))
