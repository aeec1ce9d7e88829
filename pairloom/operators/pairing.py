"""Linking records into pairs, enriching them, and turning them by direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_div, safe_ln, seed31, strip
from ..functions.text import first_nonblank, word_count

_TEXTS = ("text", "transcript", "transcription", "orthography")


def _given(df: DataFrame, names: tuple[str, ...], prefix: str) -> Column:
    return first_nonblank(*[F.col(f"{prefix}.{n}") for n in names if n in df.columns])


def link_pairs(fragments: DataFrame, audio: DataFrame) -> DataFrame:
    """A manifest row for each English-Spanish pair that a fragment's trans_id names and both of whose recordings exist.

    fragments: keyed by `key`; audio: (audio_id, path). Either side may name the other: a pair comes once.
    """
    lang = F.lower(F.col("lang_code")) if "lang_code" in fragments.columns else F.lower(F.substring("key", 1, 2))
    f = fragments.withColumn("_lang", lang)
    own = f.select("key", "_lang", strip("trans_id").alias("_peer"))
    peer = f.select(F.col("key").alias("_peer"), F.col("_lang").alias("_peer_lang"))
    met = own.join(peer, "_peer").where(F.array_sort(F.array("_lang", "_peer_lang")) == F.array(F.lit("en"), F.lit("es")))
    english = F.when(F.col("_lang") == "en", F.col("key")).otherwise(F.col("_peer"))
    spanish = F.when(F.col("_lang") == "en", F.col("_peer")).otherwise(F.col("key"))
    pairs = met.select(english.alias("english_id"), spanish.alias("spanish_id")).distinct()
    for side in ("english", "spanish"):
        pairs = pairs.join(audio.select(F.col("audio_id").alias(f"{side}_id"), F.col("path").alias(f"{side}_audio")), f"{side}_id")
    speaker = ("participant_id_unique", "participant_id")
    e, s = f.alias("e"), f.alias("s")
    out = pairs.join(e, F.col("english_id") == F.col("e.key")).join(s, F.col("spanish_id") == F.col("s.key"))
    es, ss = _given(f, speaker, "e"), _given(f, speaker, "s")
    return out.select(F.concat_ws("__", "english_id", "spanish_id").alias("pair_id"), es.alias("english_speaker_id"), ss.alias("spanish_speaker_id"), (es == ss).alias("same_speaker_pair"), "english_id", "spanish_id", "english_audio", "spanish_audio", _given(f, _TEXTS, "e").alias("english_text"), _given(f, _TEXTS, "s").alias("spanish_text"), F.lit("").alias("split")).orderBy("pair_id")


def merge_sources(*sources: DataFrame, key: str = "audio_id", value: str = "text") -> DataFrame:
    """The union of (key, value) sources; a key that two sources give different values is an error."""
    rows = sources[0].select(key, value)
    for s in sources[1:]:
        rows = rows.unionByName(s.select(key, value))
    one = rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_other"))
    clash = F.concat(F.lit("Conflicting values for "), F.col(key))
    return one.select(key, F.when(F.col(value) == F.col("_other"), F.col(value)).otherwise(F.raise_error(clash)).alias(value))


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_values) of keys with several values."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def with_fallback(rows: DataFrame, side: DataFrame, key: str, value: str, side_key: str, side_value: str) -> DataFrame:
    """rows with `value` replaced by the side table's wherever that has the key, even by an empty text."""
    other = side.select(F.col(side_key).alias("_k"), F.col(side_value).alias("_v"))
    met = rows.join(other, rows[key] == F.col("_k"), "left")
    return met.withColumn(value, F.when(F.col("_k").isNotNull(), F.col("_v")).otherwise(F.col(value))).drop("_k", "_v")


def merge_transcripts(manifest: DataFrame, transcripts: DataFrame) -> DataFrame:
    out = with_fallback(manifest, transcripts, "english_id", "english_text", "audio_id", "text")
    return with_fallback(out, transcripts, "spanish_id", "spanish_text", "audio_id", "text")


def pair_key(df: DataFrame) -> Column:
    """pair_id under either of its names, trimmed."""
    have = [c for c in ("sample_id", "pair_id") if c in df.columns]
    return strip(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in have], F.lit("")))


def result_rows(manifest: DataFrame) -> DataFrame:
    """Two rows for each pair, one for each direction, with source and target columns and the row's seed."""
    both = manifest.withColumn("direction", F.explode(F.array(F.lit("en-es"), F.lit("es-en"))))

    def side(name: str, source: bool) -> Column:
        a, b = ("english", "spanish") if source else ("spanish", "english")
        return F.when(F.col("direction") == "en-es", F.col(f"{a}_{name}")).otherwise(F.col(f"{b}_{name}"))

    return both.select(F.col("pair_id").alias("sample_id"), side("speaker_id", True).alias("speaker_id"), "same_speaker_pair", "direction", side("audio", True).alias("source_audio"), side("audio", False).alias("target_audio"), side("text", True).alias("source_reference_text"), side("text", False).alias("translation_reference"), seed31("pair_id", "direction").alias("tts_seed"))


def training_pairs(manifest: DataFrame, split: str, direction: str) -> DataFrame:
    """(source, target) texts of a split in one direction; both sides must say something."""
    source, target = ("english_text", "spanish_text") if direction == "en-es" else ("spanish_text", "english_text")
    return manifest.where((F.col("split") == split) & (strip(source) != "") & (strip(target) != "")).select("pair_id", strip(source).alias("source"), strip(target).alias("target"))


#: Measures that are predicted, and those that predict.
TARGETS = ("f0_mean_st", "f0_std_st", "log_dur_ratio")
FEATURES_T0 = ("s_f0_mean_st", "s_f0_std_st", "s_log_dur", "s_voiced_ratio")
FEATURES_T1 = (*FEATURES_T0, "s_n_words", "s_speaking_rate")


def directional(features: DataFrame) -> DataFrame:
    """Both directions of each feature row: source measures s_*, target measures t_*, what copying the source predicts
    (copy_*) and what is to be predicted (target_*). Logs of nothing are NULL."""
    both = features.withColumn("direction", F.explode(F.array(F.lit("en-es"), F.lit("es-en"))))

    def side(name: str, source: bool) -> Column:
        a, b = ("en", "es") if source else ("es", "en")
        return F.when(F.col("direction") == "en-es", F.col(f"{a}_{name}")).otherwise(F.col(f"{b}_{name}"))

    out = both.select("pair_id", "direction", "split", side("speaker", True).alias("speaker"), *[side(m, True).alias(f"s_{m}") for m in ("f0_mean_st", "f0_std_st", "duration", "voiced_ratio", "n_words", "speaking_rate")], *[side(m, False).alias(f"t_{m}") for m in ("f0_mean_st", "f0_std_st", "duration")])
    out = out.withColumns({"s_log_dur": safe_ln("s_duration"), "log_dur_ratio": safe_ln(safe_div("t_duration", "s_duration"))})
    return out.withColumns({"copy_f0_mean_st": F.col("s_f0_mean_st"), "copy_f0_std_st": F.col("s_f0_std_st"), "copy_log_dur_ratio": F.lit(0.0), "target_f0_mean_st": F.col("t_f0_mean_st"), "target_f0_std_st": F.col("t_f0_std_st"), "target_log_dur_ratio": F.col("log_dur_ratio")})


def with_drop_reason(rows: DataFrame, sides: list[tuple[str, DataFrame, list[str], Column | None]]) -> DataFrame:
    """Left joins to several sides with `drop_reason`: the first side, in order, that lacks the key or fails its test.

    sides: (reason if absent, side table, key columns, test or None); a failed test's reason is the first one + '_unusable'.
    """
    reason = F.lit(None).cast("string")
    checks = []
    for name, side, keys, test in sides:
        mark = f"_has_{name}"
        rows = rows.join(side.withColumn(mark, F.lit(True)), keys, "left")
        checks.append((F.col(mark).isNull(), f"no_{name}"))
        if test is not None:
            checks.append((~F.coalesce(test, F.lit(False)), f"{name}_unusable"))
    for cond, name in reversed(checks):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    return rows.withColumn("drop_reason", reason).drop(*[f"_has_{n}" for n, *_ in sides])


def drop_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def expand_arms(rows: DataFrame, arms: list[str], usable: dict[str, Column] | None = None) -> DataFrame:
    """One row for each arm, with skip_reason where the arm's condition fails."""
    out = rows.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    reason = F.lit(None).cast("string")
    for arm, ok in (usable or {}).items():
        reason = F.when((F.col("arm") == arm) & ~F.coalesce(ok, F.lit(False)), F.lit(f"no_{arm}")).otherwise(reason)
    return out.withColumn("skip_reason", reason)


def measure_once(rows: DataFrame, roles: list[str], key: str, measure) -> DataFrame:
    """Each distinct path among the role columns measured once, joined back as {measure}_{role}.

    measure: DataFrame(path) -> DataFrame(path, value).
    """
    long = rows.unpivot([key], roles, "role", "path").where(F.col("path").isNotNull() & (F.col("path") != ""))
    values = measure(long.select("path").distinct())
    wide = long.join(values, "path", "left").groupBy(key).pivot("role", roles).agg(F.first("value"))
    return rows.join(wide.select(key, *[F.col(r).alias(f"value_{r}") for r in roles]), key, "left")


def leak_check(mt: DataFrame, synthesis: DataFrame, order: str | None = None) -> DataFrame:
    """(pair_id, direction, mt_words, pipeline_words, human_words) of the rows that both tables have, words counted from
    synthesis's translated_text and translation_reference; rows where either is blank are left out. Of several rows of mt
    with one key the last by `order` counts."""
    words = {"pipeline_words": "translated_text", "human_words": "translation_reference"}
    right = synthesis.withColumn("pair_id", pair_key(synthesis)).select("pair_id", "direction", *[word_count(t).alias(n) for n, t in words.items()])
    left = lookup(mt, ["pair_id", "direction"], "mt_words", order).select("pair_id", "direction", F.col("mt_words").cast("int").alias("mt_words"))
    return left.join(right.where("pipeline_words > 0 and human_words > 0"), ["pair_id", "direction"])


def leak_numbers(rows: DataFrame) -> DataFrame:
    """One row: n, and r and mean absolute difference of the word counts of leak_check, two by two."""
    pairs = {"mt_vs_pipeline": ("mt_words", "pipeline_words"), "mt_vs_human": ("mt_words", "human_words"), "pipeline_vs_human": ("pipeline_words", "human_words")}
    made = [x for n, (a, b) in pairs.items() for x in (F.corr(a, b).alias(f"{n}_r"), F.avg(F.abs(F.col(a) - F.col(b))).alias(f"{n}_mae_words"))]
    return rows.agg(F.count(F.lit(1)).alias("n"), *made)


def lookup(rows: DataFrame, keys: list[str], value: str, order: str | None = None) -> DataFrame:
    """One value for each key: blank ones skipped, of several the last by `order` (by value, where there is none)."""
    have = rows.where(strip(F.col(value).cast("string")) != "")
    return have.groupBy(*keys).agg(F.max_by(value, F.struct(order or value, value)).alias(value))


def deploy_lookup(results: DataFrame, direction: str, order: str | None = None) -> DataFrame:
    """(pair_id, asr_words, mt_words) of a direction's rows whose recognised and translated texts both aren't blank; of
    several rows of a pair the last by `order`."""
    own = results.where(F.col("direction") == direction).withColumn("pair_id", pair_key(results))
    both = own.select("pair_id", F.struct(word_count("asr_text").alias("asr_words"), word_count("translated_text").alias("mt_words")).alias("w"), *([F.col(order).alias("_o")] if order else [])).where("w.asr_words > 0 and w.mt_words > 0")
    return both.groupBy("pair_id").agg(F.max_by("w", F.struct(*(["_o"] if order else []), "w")).alias("w")).select("pair_id", "w.*")
