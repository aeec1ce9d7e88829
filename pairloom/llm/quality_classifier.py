"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words and word pairs, BUCKETS buckets): one of target texts, one of the raw
corpus. A document's log importance weight is the sum over its n-grams of log p_target - log p_raw, of a document of more
than LENGTH n-grams their mean times LENGTH: otherwise the longest documents' sums decide. The rows with the k
largest sums of weight and Gumbel noise are a sample of k rows without replacement, by weight. Noise comes from a hash
of doc_id and text, so reruns agree and equal rows stay together.

The raw model counts all n-grams of all documents, the target model those of all documents labelled good. It is cross-fit: texts
are dealt to FOLDS folds by their hash, and each row, labelled or not, is weighed by a model that has counted no text of its
fold. Labelled rows' keys are so like those of other rows. By default k is as many rows as have keys above the cut that parts
the labelled kinds best (`wanted`, from all labelled documents; its cuts are judged by windows inside bins). Counts come to the driver as BUCKETS rows. The k-th key is found by histograms,
refined until few rows are left in its bin; no sort, no row list.

Defined cases: a null or empty text has no n-grams and weight 0. Rows that tie with the k-th key are kept with it.
Without target rows all weights are 0, and noise alone decides. An empty table gives an empty result. Null labels are
left out. The sample's rows keep all columns of the input as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .memory import text_batches, tidy
from .near_dedup import _maybe
from .store import materialize
from .words import buffers, chunks, mix, words

BUCKETS = 1 << 16
#: Labelled documents that the target model and k are worked out from, those of smallest hash; None: all of them.
MAX_TARGET_ROWS: int | None = None
#: Bins of keys inside which cuts are judged.
CUT_BINS = 4_096
#: Parts of the texts; a row's target model leaves out its own part.
FOLDS = 5
#: Longer documents weigh as if they had this many n-grams.
LENGTH = 128


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and n + 1 offsets of the texts in them. Letter case counts."""
    w, at = words(raw, offsets, seed=5, lower=False)
    n = np.diff(at)
    pairs = np.zeros(len(w), bool)
    pairs[:-1] = True
    pairs[at[1:][n > 0] - 1] = False  # a text's last word begins no pair
    first = np.flatnonzero(pairs)
    two = mix(w[first] * np.uint64(0x9E3779B97F4A7C15) + w[first + 1]) if len(first) else np.zeros(0, np.uint64)
    # word i goes to place 2 i - (texts before), its pair after it
    many = np.where(n > 0, 2 * n - 1, 0)
    to = np.concatenate([[0], np.cumsum(many)])
    own = np.repeat(np.arange(len(n)), n)
    place = to[:-1][own] + 2 * (np.arange(len(w)) - at[:-1][own])
    out = np.zeros(to[-1], np.uint64)
    out[place] = w
    out[place[first] + 1] = two
    return (out & np.uint64(BUCKETS - 1)).astype(np.int64), to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        raw, offsets = buffers(batch.column(0))
        for _, _, part, at in chunks(raw, offsets):
            total += np.bincount(grams(part, at)[0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
    tidy()


def model(texts: DataFrame) -> np.ndarray:
    """Counts of each bucket over all texts (one column)."""
    rows = texts.mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def _count_folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((FOLDS, BUCKETS), np.int64)
    for batch in batches:
        raw, offsets = buffers(batch.column(0))
        fold = batch.column(1).to_numpy()
        for i, _, part, at in chunks(raw, offsets):
            b, to = grams(part, at)
            own = np.repeat(fold[i + np.arange(len(to) - 1)].astype(np.int64), np.diff(to))
            total += np.bincount(own * BUCKETS + b, minlength=FOLDS * BUCKETS).reshape(FOLDS, BUCKETS)
    some = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, *total[:, some])], ["bucket", *(f"n{k}" for k in range(FOLDS))])
    tidy()


def fold_models(texts: DataFrame) -> np.ndarray:
    """FOLDS rows of counts of each bucket over all texts (one column), each without the texts of its own fold."""
    names = [f"n{k}" for k in range(FOLDS)]
    dealt = texts.select("text", fold_of(F.col("text")).alias("fold"))
    rows = dealt.mapInArrow(_count_folds, ", ".join(f"{x} long" for x in ("bucket", *names))).groupBy("bucket").agg(*[F.sum(x).alias(x) for x in names]).collect()
    out = np.zeros((FOLDS, BUCKETS))
    for r in rows:
        out[:, r[0]] = r[1:]
    return out.sum(axis=0) - out


def target_texts(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int | None = MAX_TARGET_ROWS) -> DataFrame:
    good = labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    if most is not None:
        good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # a bitmap of fixed size thins the texts, so that those of other documents stay where they are; of the join's sides only
    # the ids are held, and no text is sorted
    ids = good.select(F.col("doc_id").cast("string").alias("rep"))
    return _maybe(docs.select(F.col("doc_id").cast("string").alias("rep"), "text"), ids).join(ids.hint("shuffle_hash"), "rep").select("text")


def log_ratios(target: np.ndarray, raw: np.ndarray, smooth: float = 5.0) -> np.ndarray:
    """Both models are smoothed in proportion to their counts: a bucket that neither has seen says nothing."""
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + smooth) / (raw * (target.sum() / max(raw.sum(), 1)) + smooth))


def log_weight(text: Column, ratios: np.ndarray, length: int | None = None) -> Column:
    """The sum of ratios over a text's n-grams, scaled down to `length` n-grams where it has more. ratios: of each bucket,
    or FOLDS rows of them, of which the text's own fold's counts."""
    own = np.atleast_2d(ratios)

    @F.arrow_udf("double")
    def weigh(column: pa.Array, fold: pa.Array) -> pa.Array:
        raw, offsets = buffers(column)
        out, row = np.zeros(len(column)), fold.to_numpy() % len(own)
        for i, j, part, at in chunks(raw, offsets):
            b, to = grams(part, at)
            n = np.diff(to)
            full = np.flatnonzero(n)
            if len(full):
                sums = np.add.reduceat(own[np.repeat(row[i + np.arange(len(n))], n), b], to[:-1][full])
                out[i + full] = sums if length is None else sums * np.minimum(1.0, length / n[full])
        return pa.array(np.round(out, 6))

    return weigh(text, fold_of(text))


def gumbel(doc_id: Column, text: Column, seed: int) -> Column:
    h = F.xxhash64(F.lit(seed), doc_id, F.crc32(F.coalesce(text, F.lit("")).cast("binary")))
    u = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int, few: int = 5_000, bins: int = 2_048) -> float:
    """The exact k-th largest value; each step counts rows in equal bins of the last step's bin."""
    lo, hi, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return 0.0
    k = min(max(k, 1), n)
    values, above = rows.select(column), 0
    while True:
        part, width = values.where(F.col(column).between(lo, hi)), (hi - lo) / bins
        if n <= few:
            return sorted((r[0] for r in part.collect()), reverse=True)[k - above - 1]
        # where bins can't be told apart any more, each value is its own
        place = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)) if lo + width > lo else F.col(column)
        counts = part.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                if r["lo"] == r["hi"]:
                    return r["lo"]
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """FOLDS rows of ratios, each for the texts of its fold and without their counts in the target model."""
    raw = model(docs.select("text"))
    return np.array([log_ratios(target, raw) for target in fold_models(target_texts(docs, labels, label))])


def wanted(keys: DataFrame, labels: DataFrame, label: str = "quality", most: int | None = MAX_TARGET_ROWS, recall: float = 0.99) -> int:
    """How many rows to draw: as many as have a key above the cut that parts labelled good from labelled bad keys best, of
    those cuts that keep `recall` of the good. From all labelled documents, or `most` of them; of rows that share a doc_id the one
    of largest key; all rows where a kind of label lacks."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    if most is not None:
        marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    got = keys.join(marks, "doc_id").groupBy("doc_id").agg(F.max("key").alias("key"), F.first("_label").alias("_label"))
    cuts, _ = materialize(got.groupBy("key").agg(F.count_if(F.col("_label") == 1).alias("good"), F.count_if(F.col("_label") == 0).alias("bad")), "cuts")
    n_good, n_bad, lo, hi = cuts.agg(F.sum("good"), F.sum("bad"), F.min("key"), F.max("key")).first()
    if not n_good or not n_bad:
        return keys.count()
    # good and bad keys below each cut: those of the bins before its own, and those before it in its bin
    bins = cuts.withColumn("b", F.floor((F.col("key") - lo) / ((hi - lo) or 1.0) * CUT_BINS))
    upto = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    per = bins.groupBy("b").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))  # CUT_BINS + 1 rows at most
    before = per.select("b", *[F.coalesce(F.sum(x).over(upto), F.lit(0)).alias(f"{x}_before") for x in ("good", "bad")])
    inside = W.partitionBy("b").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    below = {x: F.col(f"{x}_before") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in ("good", "bad")}
    placed = bins.join(F.broadcast(before), "b").select("key", (1 - below["good"] / n_good).alias("kept"), (1 - below["bad"] / n_bad).alias("passed"))
    worth = F.when(F.col("kept") >= recall, F.col("kept") - F.col("passed")).otherwise(-1.0)
    cut = -placed.agg(F.max(F.struct(worth.alias("worth"), (-F.col("key")).alias("least")))["least"]).first()[0]
    return keys.where(F.col("key") >= cut).count()


def scored(docs: DataFrame, ratios: np.ndarray, seed: int) -> DataFrame:
    """(_doc, _weight, _key): each row as it is, its log weight and its key."""
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", "text").withColumn("_weight", log_weight(F.col("text"), ratios, LENGTH))
    return rows.select("_doc", "_weight", (F.col("_weight") + gumbel(F.col("doc_id"), F.col("text"), seed)).alias("_key"))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, label: str = "quality", seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """docs with _weight and _key, of which the sample's rows have kept = true, as a narrow table (doc_id, log_weight, key,
    kept) and as the full rows of docs that the sample holds. share: of all rows; by default as `wanted` finds."""
    text_batches(docs.sparkSession)
    ratios = fit(docs, labels, label)
    keys, _ = materialize(scored(docs.select("doc_id", "text"), ratios, seed).select("_doc.doc_id", F.col("_weight").alias("log_weight"), F.col("_key").alias("key")), "resample-keys")
    k = wanted(keys, labels, label) if share is None else round(share * keys.count())
    least = kth_largest(keys, "key", k) if k else float("inf")
    sample = scored(docs, ratios, seed).where(F.col("_key") >= least).select("_doc.*")
    return keys.withColumn("kept", F.col("key") >= least), sample
