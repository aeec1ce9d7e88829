"""Error rates and translation scores: per-row edit counts and n-gram counts in Arrow batches, corpus scores as sums.

Corpus scores come from summed counts, never from means of row scores. Word error rates count edits over reference words.
BLEU has the public 13a tokens, orders 1 to 4, exponential smoothing; chrF has character orders 1 to 6 and beta 2, over
texts without white space, averaged over orders that occur.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import let, strip
from ..functions.text import error_words

BLEU_ORDER, CHRF_ORDER, BETA = 4, 6, 2


#: Words of different kinds that a pair of texts may have: as many as there are characters beyond the first 65,536.
MAX_KINDS = (1 << 20) - 1


def _character(number: Column) -> Column:
    """The character 65,536 places after `number`, from its four bytes in UTF-8."""
    at = number + 0x10000
    byte = lambda shift: F.shiftright(at, shift).bitwiseAND(63)
    code = F.lit(0xF0808080).cast("long") + F.shiftright(at, 18).cast("long") * (1 << 24) + byte(12).cast("long") * (1 << 16) + byte(6).cast("long") * (1 << 8) + byte(0).cast("long")
    return F.unhex(F.hex(code)).cast("string")


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Edits between two arrays of words: each kind of word becomes a character, and strings have a distance."""

    def distance(p: Column) -> Column:
        one = lambda words: F.array_join(F.transform(words, lambda w: _character(F.array_position(p["kinds"], w).cast("int"))), "")
        return F.when(F.size(p["kinds"]) > MAX_KINDS, F.raise_error(F.lit("too many kinds of words")).cast("int")).otherwise(F.levenshtein(one(p["r"]), one(p["h"])))

    none = F.array().cast("array<string>")
    r, h = F.coalesce(reference, none), F.coalesce(hypothesis, none)
    return let(F.struct(r.alias("r"), h.alias("h"), F.array_distinct(F.concat(r, h)).alias("kinds")), distance)


def with_word_errors(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """rows with edits, reference_words and wer; wer is NULL where the reference is blank. Rows without a hypothesis stay:
    nothing heard is an error rate of 1."""
    ref, hyp = error_words(reference), error_words(hypothesis)
    out = rows.withColumns({"edits": word_edits(ref, hyp), "reference_words": F.size(ref)})
    blank = strip(F.coalesce(F.col(reference), F.lit(""))) == ""
    return out.withColumn("wer", F.when(~blank, F.try_divide(F.col("edits").cast("double"), F.col("reference_words").cast("double"))))


def corpus_wer() -> Column:
    """An aggregate over with_word_errors: all edits over all reference words."""
    return F.try_divide(F.sum("edits"), F.sum("reference_words"))


def cer(reference: str, hypothesis: str) -> Column:
    """Character error rate; NULL for an empty reference."""
    return F.try_divide(F.levenshtein(reference, hypothesis).cast("double"), F.length(reference).cast("double"))


_13A = [(re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "), (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "), (re.compile(r"([\.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 ")]


def tokens_13a(text: str) -> list[str]:
    """Fixed rule: the public mteval 13a tokenisation."""
    line = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            line = line.replace(a, b)
    line = f" {line} "
    for find, put in _13A:
        line = find.sub(put, line)
    return line.split()


def _counts(seq, n: int) -> Counter:
    return Counter(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))


def bleu_counts(hypothesis: str, reference: str) -> list[int]:
    """Matches of orders 1 to 4, candidates of orders 1 to 4, lengths of hypothesis and reference."""
    h, r = tokens_13a(hypothesis.rstrip()), tokens_13a(reference.rstrip())
    pairs = [(_counts(h, n), _counts(r, n)) for n in range(1, BLEU_ORDER + 1)]
    return [*[sum((a & b).values()) for a, b in pairs], *[max(len(h) - n + 1, 0) for n in range(1, BLEU_ORDER + 1)], len(h), len(r)]


def chrf_counts(hypothesis: str, reference: str) -> list[int]:
    """For each order: n-grams of the hypothesis, of the reference, and matches."""
    h, r = "".join(hypothesis.split()), "".join(reference.split())
    out = []
    for n in range(1, CHRF_ORDER + 1):
        a, b = _counts(h, n), _counts(r, n)
        out += [sum(a.values()) if b else 0, sum(b.values()), sum((a & b).values())]
    return out


def bleu(counts: list[float]) -> float:
    """Score from summed counts; each order without a match halves what stands in for it."""
    matches, totals, h, r = counts[:4], counts[4:8], counts[8], counts[9]
    if not any(matches):
        return 0.0
    logs, smooth, orders = 0.0, 1.0, 0
    for m, t in zip(matches, totals, strict=True):
        if t == 0:
            break
        orders += 1
        if m == 0:
            smooth *= 2
            logs += math.log(100.0 / (smooth * t))
        else:
            logs += math.log(100.0 * m / t)
    if orders < BLEU_ORDER:
        return 0.0
    return math.exp(min(0.0, 1 - r / h) if h else -1e9) * math.exp(logs / BLEU_ORDER)


def chrf(counts: list[float]) -> float:
    total, orders = 0.0, 0
    precision = recall = 0.0
    for i in range(0, len(counts), 3):
        h, r, m = counts[i : i + 3]
        if h > 0 and r > 0:
            orders += 1
            precision += m / h
            recall += m / r
    if not orders:
        return 0.0
    precision, recall = precision / orders, recall / orders
    total = BETA**2 * precision + recall
    return 100 * (1 + BETA**2) * precision * recall / total if total else 0.0


def _counter(f):
    @F.pandas_udf("array<long>")
    def run(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([f(h or "", r or "") for h, r in zip(hypothesis, reference, strict=True)])

    return run


def _scorer(f):
    @F.pandas_udf("double")
    def run(counts: pd.Series) -> pd.Series:
        return pd.Series([f(list(c)) for c in counts])

    return run


def sentence_chrf(hypothesis: str | Column, reference: str | Column) -> Column:
    return _scorer(chrf)(_counter(chrf_counts)(hypothesis, reference))


def translation_scores(rows: DataFrame, by: list[str], hypothesis: str, reference: str) -> DataFrame:
    """corpus_bleu, corpus_chrf and reference_count of rows that have a reference. Rows give counts, counts are summed
    map-side and by key, and one score is worked out for each key."""
    good = rows.where(F.coalesce(F.col(reference), F.lit("")) != "")
    counted = good.select(*by, _counter(bleu_counts)(hypothesis, reference).alias("_b"), _counter(chrf_counts)(hypothesis, reference).alias("_c"))
    sums = counted.groupBy(*by).agg(F.array(*[F.sum(F.col("_b")[i]) for i in range(10)]).alias("_b"), F.array(*[F.sum(F.col("_c")[i]) for i in range(3 * CHRF_ORDER)]).alias("_c"), F.count(F.lit(1)).alias("reference_count"))
    return sums.select(*by, _scorer(bleu)("_b").alias("corpus_bleu"), _scorer(chrf)("_c").alias("corpus_chrf"), "reference_count")


def error_rates(results: DataFrame) -> DataFrame:
    """By direction, over successful rows: corpus error rates of recognition and of how intelligible the speech is."""
    good = results.where(F.col("status") == "ok")

    def rate(reference: str, hypothesis: str, name: str) -> DataFrame:
        have = good.where(strip(F.coalesce(F.col(reference), F.lit(""))) != "")
        empty = F.count_if(strip(F.coalesce(F.col(hypothesis), F.lit(""))) == "")
        return with_word_errors(have, reference, hypothesis).groupBy("direction").agg(corpus_wer().alias(f"corpus_{name}_wer"), F.count(F.lit(1)).alias(f"{name}_count"), empty.alias(f"{name}_empty_count"))

    return rate("source_reference_text", "asr_text", "asr").join(rate("translated_text", "tts_asr_text", "tts"), "direction", "full")


def compare(runs: DataFrame, by: list[str], system: str, hypothesis: str, reference: str, base: str) -> DataFrame:
    """Scores of each system and their differences to the base system's, three places."""
    scores = translation_scores(runs, [*by, system], hypothesis, reference)
    b = scores.where(F.col(system) == base).select(*by, F.col("corpus_bleu").alias("_b"), F.col("corpus_chrf").alias("_c"))
    met = scores.join(b, by, "left") if by else scores.join(b, F.lit(True), "left")
    return met.withColumns({"bleu_delta": F.bround(F.col("corpus_bleu") - F.col("_b"), 3), "chrf_delta": F.bround(F.col("corpus_chrf") - F.col("_c"), 3)}).drop("_b", "_c")
