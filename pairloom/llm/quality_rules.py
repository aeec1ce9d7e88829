"""Quality rules: text statistics as expressions, fixed base rules, and learned decision lists.

The statistics and both kinds of rules are DataFrame expressions; nothing runs Python on executors. A decision list is
learned from labelled statistics by sequential covering: grow a conjunction of thresholds for bad rows by information
gain, prune it on rows held back, keep it if it is precise there, take the rows that it covers away, go on. The list
becomes one ordered conditional expression.

Fitting takes a bounded sample of labelled rows: the MAX_FIT_ROWS smallest by hash of doc_id. Statistics, verdicts and
base rules cover all rows and whole texts.

Defined cases: a null or empty text has no words, all statistics 0, and fails the base rules. Null labels are left out
of fitting; without both kinds of label the list is empty and only base rules decide. Repeated rows are judged alike, and
very long texts whole. An empty table gives an empty result. Columns of the input that are named like an output column
(STATISTICS, base_failed, kept) are replaced, all others pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled rows that come to the driver for fitting.
MAX_FIT_ROWS = 20_000
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: what a lambda's body names from outside is computed again for each
    element, its own variable is not. An expression so closed may be copied into a filter without harm."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text has twice or more.

    Windows' hashes are sorted with their places; equal neighbours mark places, and sorted places cover up to three words
    each: n log n for any text, without a shuffle.
    """

    def twins(dealt: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(dealt, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(dealt, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])

    def count(marks: Column) -> Column:
        dealt = F.sort_array(F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(marks)) < F.size(marks), let(let(dealt, twins), covered)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, count)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the further statistics of FEATURES."""
    n = lambda x: F.size(x).cast("long")
    less = lambda x, chars: (F.length(x) - F.length(F.translate(x, chars, ""))).cast("long")

    def of_words(w: Column) -> list[Column]:
        return [n(w).alias("n_words"), n(F.array_distinct(w)).alias("n_kinds"), _repeat_words(w).alias("n_repeat_words")]

    def of_lines(x: Column) -> list[Column]:
        return [n(x).alias("n_lines"), (n(x) - n(F.array_distinct(x))).alias("n_dup_lines")]

    def of_packed(p: Column) -> list[Column]:
        """p: the text without white space."""
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊÍÑÓÖÚÜ"
        return [F.length(p).cast("long").alias("word_chars"), less(p, SYMBOLS).alias("n_symbols"), less(p, letters).alias("n_upper"), less(p, "!?…").alias("n_marks"), less(p, "0123456789").alias("n_digits")]

    def parts(body: Column) -> Column:
        words = F.filter(F.split(body, SPACES), lambda w: w != "")
        lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return F.struct(words.alias("words"), lines.alias("lines"), F.translate(body, " \t\n\x0b\x0c\r", "").alias("packed"))

    # one closed expression for all of them: the statistics aren't code that grows with their number
    made = let(parts(F.coalesce(F.col(text), F.lit(""))), lambda p: F.struct(*of_words(p["words"]), *of_lines(p["lines"]), *of_packed(p["packed"])))
    out = docs.withColumn("_made", made)
    return out.withColumns({k: F.col("_made")[k] for k in STATISTICS}).drop("_made")


#: Ratios that decision lists may test, each per word, character or line.
FEATURES = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "kinds_share": ("n_kinds", "n_words"),
}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines", "n_kinds")


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    at: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v >= self.at if self.above else v < self.at

    def column(self) -> Column:
        return feature(self.name) >= self.at if self.above else feature(self.name) < self.at

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.at:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions, each with a verdict (True: keep); the first that holds decides, else the row is kept."""

    rules: tuple[tuple[tuple[Test, ...], bool], ...] = ()

    def column(self) -> Column:
        out = None
        for tests, keep in self.rules:
            cond = tests[0].column()
            for t in tests[1:]:
                cond = cond & t.column()
            out = F.when(cond, F.lit(keep)) if out is None else out.when(cond, F.lit(keep))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(f"if {' and '.join(map(str, tests))}: {'keep' if keep else 'drop'}" for tests, keep in self.rules) or "keep all"


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FOIL's information gain of going from p0 bad and n0 good rows to p and n."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int = 3) -> list[Test]:
    tests, inside = [], np.ones(len(x), bool)
    while len(tests) < most and (inside & ~bad).any():
        best = (1e-9, None)
        b = bad[inside]
        for f, name in enumerate(names):
            v = x[inside, f]
            cuts = np.unique(v)
            cuts = cuts[np.linspace(0, len(cuts) - 1, min(len(cuts), 256)).astype(int)]
            # halfway between neighbours, so that rows like either side are judged like it
            cuts = np.unique((cuts[1:] + cuts[:-1]) / 2)
            if not len(cuts):
                continue
            pos, neg = np.sort(v[b]), np.sort(v[~b])
            below_p, below_n = np.searchsorted(pos, cuts), np.searchsorted(neg, cuts)
            for above, p, n in ((True, len(pos) - below_p, len(neg) - below_n), (False, below_p, below_n)):
                g = _gain(len(pos), len(neg), p, n)
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (g[k], Test(name, above, float(cuts[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= best[1].holds(x, names)
    return tests


def _covers(tests: list[Test], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in tests:
        out &= t.holds(x, names)
    return out


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.95, support: int = 5, most_rules: int = 12) -> DecisionList:
    """Sequential covering over rows x (columns `names`), of which `bad` are to be dropped.

    Every third row is held back: a grown conjunction loses its last tests while (p - n) / (p + n) on those rows doesn't
    fall, and joins the list only if its precision, with one good row added to the count on all rows, reaches `precision`.
    """
    rules: list[tuple[tuple[Test, ...], bool]] = []
    held = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < most_rules:
        grow, prune = left & ~held, left & held
        if bad[grow].sum() < support:
            break
        tests = _grow(x[grow], bad[grow], names)
        if not tests:
            break

        def worth(ts: list[Test]) -> float:
            c = _covers(ts, x[prune], names)
            p, n = (c & bad[prune]).sum(), (c & ~bad[prune]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        inside = _covers(tests, x, names) & left
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if p < support or p / (p + n + 1) < precision:
            break
        rules.append((tuple(tests), False))
        left &= ~inside
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = MAX_FIT_ROWS) -> DecisionList:
    """A list that drops what is like rows labelled 0; from the statistics of at most `rows` labelled documents.

    Labels of documents that the base rules drop anyway don't count. Of rows that share a doc_id the least text by its
    checksum, then by itself, is the document, so repeated rows change nothing; the driver gets at most `rows` rows.
    """
    marks = labels.select("doc_id", F.col(label).alias("_label")).where(F.col("doc_id").isNotNull() & F.col("_label").isin(0, 1))
    chosen = marks.groupBy("doc_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = met.groupBy("doc_id", "_label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_d")).select("doc_id", "_label", "_d.text")
    stats = with_statistics(one)
    names = list(FEATURES)
    got = stats.select(F.xxhash64("doc_id", F.lit(7)).alias("_place"), "_label", base_failed().alias("_failed"), *[feature(f).alias(f) for f in names]).collect()
    got = [r for r in got if not r["_failed"]]
    got.sort(key=lambda r: (r["_place"], *[r[f] for f in names]))
    x = np.array([[r[f] for f in names] for r in got], float).reshape(len(got), len(names))
    return learn(x, np.array([r["_label"] == 0 for r in got], bool), names)


def apply(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs with statistics, base_failed and kept."""
    return with_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column())


def kept_only(judged: DataFrame) -> DataFrame:
    """Rows that are kept. The row mark holds the optimizer back from computing the statistics in the filter once more."""
    return judged.withColumn("_mark", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_mark") >= 0)).drop("_mark")
