"""Readers and writers with explicit schemas. A missing path is an empty table where the caller says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite, strip
from ..functions.text import first_nonblank


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


#: The manifest's columns.
MANIFEST = T.StructType(
    [
        *_strings("pair_id", "english_speaker_id", "spanish_speaker_id"),
        T.StructField("same_speaker_pair", T.BooleanType()),
        *_strings("english_id", "spanish_id", "english_audio", "spanish_audio", "english_text", "spanish_text", "split"),
    ]
)
#: Measures of a recording in result rows and the roles they are taken in.
PROSODY, ROLES = ("f0_mean", "f0_std", "energy", "duration", "speaking_rate"), ("source", "generated", "target_reference")
#: Measures of one side of a feature row.
SIDE_FIELDS = ("duration", "f0_mean_hz", "f0_std_hz", "f0_mean_st", "f0_std_st", "voiced_ratio", "n_voiced", "rms", "n_words", "speaking_rate")
SCORES = ("asr_wer", "tts_intelligibility_wer", "speaker_similarity", "human_target_speaker_similarity")
RESULT_TEXTS = ("source_audio", "target_audio", "generated_audio", "source_reference_text", "asr_text", "translation_reference", "translated_text", "tts_asr_text")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) not in (None, []) and len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)) > 0


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, empty cells as '', a byte-order mark dropped from the first name."""
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, quote='"', escape='"', nullValue="\u0000", emptyValue="")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_optional_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one of the schema where the path doesn't exist. Missing columns are ''."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return conform(read_csv(spark, path), schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns cast to a schema: numbers by finite(), booleans by 'true', absent columns '' or NULL."""
    out = []
    for f in schema.fields:
        have = F.col(f.name) if f.name in df.columns else F.lit("")
        if isinstance(f.dataType, T.BooleanType):
            have = F.lower(strip(have.cast("string"))) == "true"
        elif isinstance(f.dataType, T.DoubleType):
            have = finite(have)
        elif isinstance(f.dataType, (T.LongType, T.IntegerType)):
            have = have.try_cast(f.dataType)
        out.append(have.alias(f.name))
    return df.select(*out)


def result_schema() -> T.StructType:
    doubles = [*SCORES, *[f"{f}_{r}" for f in PROSODY for r in ROLES]]
    return T.StructType([*_strings("sample_id", "speaker_id"), T.StructField("same_speaker_pair", T.BooleanType()), *_strings("direction", *RESULT_TEXTS), T.StructField("tts_seed", T.LongType()), *[T.StructField(d, T.DoubleType()) for d in doubles], *_strings("status", "error_stage", "error_message")])


def feature_schema() -> T.StructType:
    return T.StructType([*_strings("pair_id", "split"), T.StructField("same_speaker_pair", T.BooleanType()), *_strings("en_speaker", "es_speaker"), *[T.StructField(f"{s}_{f}", T.DoubleType()) for s in ("en", "es") for f in SIDE_FIELDS], *_strings("error")])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return conform(read_csv(spark, path), MANIFEST)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_optional_csv(spark, path, result_schema())


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return conform(read_csv(spark, path), feature_schema())


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.select(*[F.col(f.name) for f in MANIFEST.fields]).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_table(rows: DataFrame, path: str, columns: Sequence[str] | None = None, kind: str = "parquet", by: Sequence[str] = ()) -> None:
    """Overwrite by Spark's commit protocol: readers see the old files or the new ones."""
    out = rows.select(*columns) if columns else rows
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).format(kind).option("header", True).save(path)


def append_new(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Append the rows whose keys the table doesn't hold yet; returns what was appended."""
    spark = rows.sparkSession
    fresh = rows.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti") if exists(spark, path) else rows
    fresh.write.mode("append").parquet(path)
    return fresh


def write_lines(texts: DataFrame, path: str) -> None:
    texts.write.mode("overwrite").text(path)


def union_sorted(*frames: DataFrame) -> DataFrame:
    """Union by name over all columns that any frame has, columns in order of name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


# -- files -------------------------------------------------------------------


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, name, stem, length) of files below root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row: metadata files in order, number of recordings, of English ones and of Spanish ones."""
    meta = files(spark, root, "fragments-short.csv").agg(F.array_sort(F.collect_list("path")).alias("metadata_files"))
    stem = F.upper("stem")
    wav = files(spark, root, "*.wav").agg(F.count(F.lit(1)).alias("wav_count"), F.count_if(stem.startswith("EN_")).alias("english_wav_count"), F.count_if(stem.startswith("ES_")).alias("spanish_wav_count"))
    return meta.join(wav, F.lit(True))


def audio_index(wavs: DataFrame) -> DataFrame:
    """(audio_id, path); an id with two paths is an error."""
    one = wavs.groupBy(F.col("stem").alias("audio_id")).agg(F.min("path").alias("path"), F.max("path").alias("_other"))
    clash = F.concat(F.lit("Two files for audio id "), F.col("audio_id"))
    return one.select("audio_id", F.when(F.col("path") == F.col("_other"), F.col("path")).otherwise(F.raise_error(clash)).alias("path"))


def row_id(columns: Sequence[str]) -> Column:
    """The first non-blank of the columns that may hold a fragment's id."""
    have = [F.col(f"`{c}`") for c in ("id", "fragment_id", "audio_id", "_c0", "Unnamed: 0") if c in columns]
    return first_nonblank(*have)


def fragments(rows: DataFrame) -> DataFrame:
    """Fragment rows by fragment_id: blank ids go, repeats of a row are one, differing rows of one id are an error."""
    named = rows.withColumn("fragment_id_", row_id(rows.columns)).where("fragment_id_ <> ''")
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    one = named.groupBy("fragment_id_").agg(F.min(whole).alias("_row"), F.max(whole).alias("_other"))
    clash = F.concat(F.lit("Conflicting metadata for fragment "), F.col("fragment_id_"))
    sure = one.withColumn("_row", F.when(F.col("_row") == F.col("_other"), F.col("_row")).otherwise(F.raise_error(clash)))
    return sure.select(F.col("fragment_id_").alias("key"), *[F.col("_row")[c].alias(c) for c in rows.columns])


# -- transcripts -------------------------------------------------------------


def _stem(path: Column) -> Column:
    name = F.element_at(F.split(strip(path), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def transcripts_csv(rows: DataFrame) -> DataFrame:
    """(audio_id, text, repaired) of a table with columns audio_id and text."""
    if not {"audio_id", "text"} <= set(rows.columns):
        raise ValueError("a transcript table needs the columns audio_id and text")
    return rows.select(_stem(F.col("audio_id")).alias("audio_id"), strip("text").alias("text"), F.lit(False).alias("repaired"))


def transcripts_piped(lines: DataFrame, line: str = "value") -> DataFrame:
    """(audio_id, text, repaired) of lines `file|annotator|text`. A line with one delimiter too few is repaired by taking
    the annotator's two characters from the front of the rest; any other shape is an error. Later lines win."""
    parts = F.split(F.col(line), r"\|", 3)
    tail = F.get(parts, F.lit(1))
    repaired = (F.size(parts) == 2) & (F.length(tail) >= 2)
    text = F.when(F.size(parts) == 3, F.get(parts, F.lit(2))).when(repaired, tail.substr(F.lit(3), F.length(tail))).otherwise(F.raise_error(F.concat(F.lit("Expected file|annotator|text: "), F.col(line))))
    rows = lines.select(_stem(F.get(parts, F.lit(0))).alias("audio_id"), strip(text).alias("text"), repaired.alias("repaired"), F.monotonically_increasing_id().alias("_at"))
    return rows.groupBy("audio_id").agg(F.max_by("text", "_at").alias("text"), F.max_by("repaired", "_at").alias("repaired"))


# -- nested job results ------------------------------------------------------

WORDS = "array<struct<word:string,start:double,end:double>>"
SEGMENTS = f"array<struct<index:int,start:double,end:double,source_text:string,target_text:string,speaker:int,status:string,error:string,original_seconds:double,raw_seconds:double,final_seconds:double,scale:double,clamped:boolean,truncated_seconds:double,similarity:double,cer:double,attempts:int,words:{WORDS},source_words:{WORDS}>>"
JOB = f"job_id string, direction string, duration double, elapsed_s double, segments {SEGMENTS}, speakers array<struct<speaker:int,segments:int,voiced:int,reference_s:double,similarity:double>>, mix_info map<string,double>, similarity double, raw_ratio double, final_ratio double"


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job results of any age under one superset schema; fields that a file doesn't have are NULL, lists are empty."""
    df = spark.read.schema(JOB).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return df.withColumn("segments", F.coalesce("segments", F.array().cast(SEGMENTS)))


def write_jobs(jobs: DataFrame, path: str) -> None:
    jobs.write.mode("overwrite").json(path)


# -- reports -----------------------------------------------------------------


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A report table; for small frames, of which more than `most` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report table")

    def cell(v) -> str:
        return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def latex(df: DataFrame, most: int = 1_000) -> str:
    """As markdown, with as many rows refused."""
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError("too many rows for a report table")
    rows = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)).replace("_", r"\_") for v in r] for r in got]
    head = [c.replace("_", r"\_") for c in df.columns]
    return "\n".join([r"\begin{tabular}{" + "l" * len(head) + "}", *[" & ".join(r) + r" \\" for r in [head, *rows]], r"\end{tabular}"])


def write_report(tables: dict[str, DataFrame], folder: str, provenance: dict[str, str]) -> None:
    """Each table as CSV and Markdown, and the provenance as JSON, below the folder."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)
        spark.createDataFrame([(markdown(df),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.md")
    spark.createDataFrame([provenance]).coalesce(1).write.mode("overwrite").json(f"{folder}/provenance.json")
