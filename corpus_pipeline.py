"""A corpus pipeline: stages over the documents table, in order; each one's rows are the next one's documents."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import byte_bpe, mixing, near_dedup, quality_classifier, quality_rules
from pairloom.llm.memory import short_groups, short_reads
from pairloom.llm.store import materialize
from pairloom.session import workers_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: what importance resampling leaves out goes."""
    _, sample = quality_classifier.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return sample


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: what base rules or the learned decision list reject goes."""
    # the classifier leaves hardly a bad row to learn from: the list is learned on the table that the pipeline began with
    learned = quality_rules.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct("*").alias("_doc"), "text")
    return quality_rules.kept_only(quality_rules.apply(whole, learned)).select("_doc.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each near-duplicate component stays."""
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: sources come in proportion to their weights."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token counts and digests of the ids, and of the bytes they decode to, for each row of the mix."""
    return byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "source"))


def _light(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, with short batches of rows read, with the size of row groups bounded also for what the caller writes of its
    result, and with this package on the path of Python workers, as stages may be called one by one."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        workers_path(spark)
        short_groups(spark)
        short_reads(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _light(f)) for name, f in (("quality_classifier", classify), ("quality_rules", rules), ("near_dedup", dedup), ("mixing", mix), ("byte_bpe", encode))]

#: SQL can't express n-gram models, the learned list or the permutations; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
