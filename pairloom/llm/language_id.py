"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of variable order, up to ORDER bytes. In a context, a byte seen c times of n,
among d distinct ones, costs -log2(c / (n + d)) bits, and leaving the context costs -log2(d / (n + d)); a byte then goes
to the next shorter context, at the root to all 256 bytes alike. Contexts never seen cost nothing to leave. Counts are
frozen after training, so a text's code length under a language is a sum over its bytes, and the shortest code wins.

As counts are frozen, all code lengths that some language has seen are tabulated once, for all languages side by side,
with gram (context and byte) as key; scoring a batch of texts is one vectorised lookup for each byte, and one more per
shorter order for the few grams that no language has seen. Whole texts are scored; texts never leave their task.

Training takes a bounded sample: of each language the DOCS documents with the smallest hash of doc_id and text among those
that may be learned from and have at most TEXT_BYTES bytes; longer ones are predicted, whole, but not learned from. The
tables go to the executors inside the function, their size bounded by that sample: more than MAX_COSTS costs (grams times
languages) are an error.

Defined cases: a null text, or one without a letter, gives `und` with score 0. With no training rows every text gives
`und`. Ties go to the first language in code-point order. A null doc_id is neither held out nor learned from. Repeated rows
are judged alike, and equal ones count as often as they come when learned from. An empty table gives an empty result. Only
doc_id, text and (to learn) lang are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .memory import text_batches
from .words import buffers, chunks

ORDER = 3
#: Bound on training documents for each language.
DOCS = 300
#: Longest text to learn from: with DOCS and MAX_LANGUAGES a bound on what comes to the driver.
TEXT_BYTES = 100_000
#: Costs that all tables together may hold, 1 GB as floats.
MAX_COSTS = 250_000_000
#: More languages than this are an error: a table of them goes to every task.
MAX_LANGUAGES = 1_000


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, most: int = DOCS) -> DataFrame:
    """(lang, text): at most `most` rows of each language, by hash of doc_id, of folds other than 1."""
    own = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 1)).where(F.octet_length("text").between(1, TEXT_BYTES))
    # a first cut by language counts, so that no window holds a whole language and few texts are shuffled
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    table = docs.sparkSession.createDataFrame([tuple(r) for r in counts], "lang string, _n long")
    # the same hash thins and ranks; it holds the text, so rows that share a doc_id spread
    mark = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("_mark")
    share = F.least(F.lit(1.0), (F.lit(2.0 * most) + 50) / F.col("_n")) * float((1 << 63) - 1)
    near = own.select("doc_id", "lang", "text", mark).join(F.broadcast(table), "lang").where(F.col("_mark") <= share)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("_mark", "doc_id"))
    return near.withColumn("_r", rank).where(F.col("_r") <= most).select("lang", "text")


class Table:
    """Open addressing from gram to a row of costs; costs of grams, and of leaving contexts, for all languages."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys))).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.costs = keys, costs
        left = np.arange(len(keys), dtype=np.int32)
        probe = 0
        while len(left):
            at = self._at(keys[left], probe)
            free = self.slots[at] < 0
            put, where = left[free], at[free]
            self.slots[where] = put  # of several, the last stays
            left = np.concatenate([left[~free], put[self.slots[where] != put]])
            probe += 1
        self.probes = max(1, probe)

    def _at(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = (keys + np.uint32((probe * 0x9E3779B1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        return h >> np.uint32(32 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        row = self.slots[self._at(keys, 0)]
        row = np.where((row >= 0) & (self.keys[row] == keys), row, np.int32(-1))
        for probe in range(1, self.probes):
            miss = np.flatnonzero(row < 0)
            if not len(miss):
                break
            r = self.slots[self._at(keys[miss], probe)]
            row[miss] = np.where((r >= 0) & (self.keys[r] == keys[miss]), r, np.int32(-1))
        return row


def _grams(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the `length` bytes that end at each byte, as far as its text reaches back, and whether it does."""
    code = np.zeros(len(raw), np.uint32)
    for k in range(length):
        code[k:] |= raw[: len(raw) - k].astype(np.uint32) << np.uint32(8 * k)
    whole = np.ones(len(raw), bool)
    starts = offsets[:-1]
    ends = offsets[1:]
    for k in range(length - 1):
        at = starts + k
        whole[at[at < ends]] = False
    return code, whole


class Model:
    """Frozen statistics of all languages: for each order a table of gram costs and one of leaving costs."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        n_langs = len(self.languages)
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by order, by language
        for order in range(ORDER + 1):
            per = []
            for lang in self.languages:
                raw = np.frombuffer(b"".join(texts[lang]), np.uint8)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[lang]])]).astype(np.int64)
                code, whole = _grams(raw, offsets, order + 1)
                per.append(np.unique(code[whole], return_counts=True))
            counts.append(per)
        self.grams: list[Table] = []
        self.leave: list[Table] = []
        for order in range(ORDER + 1):
            keys = np.unique(np.concatenate([k for k, _ in counts[order]])) if n_langs else np.zeros(0, np.uint32)
            # a context is a gram without its last byte
            contexts = np.unique(keys >> np.uint32(8)) if order else np.zeros(1, np.uint32)
            if len(keys) * n_langs > MAX_COSTS:
                raise ValueError(f"{len(keys)} grams of {n_langs} languages; {MAX_COSTS} costs at most")
            costs = np.zeros((len(keys), n_langs), np.float32)
            leave = np.zeros((len(contexts), n_langs), np.float32)
            for i, (k, c) in enumerate(counts[order]):
                own = (k >> np.uint32(8)) if order else np.zeros(len(k), np.uint32)
                at = np.searchsorted(contexts, own)
                n, d = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
                seen = d > 0
                leave[seen, i] = -np.log2(d[seen] / (n[seen] + d[seen]))
                # grams that this language has not seen: leave the context, then as one byte less
                context = np.searchsorted(contexts, (keys >> np.uint32(8)) if order else np.zeros(len(keys), np.uint32))
                if order:
                    less = keys & np.uint32((1 << (8 * order)) - 1)
                    costs[:, i] = leave[context, i] + self._cost(order - 1, less)[:, i]
                else:
                    costs[:, i] = leave[context, i] + 8.0
                rows = np.searchsorted(keys, k)
                costs[rows, i] = -np.log2(c / (n[at] + d[at]))
            self.grams.append(Table(keys, costs))
            self.leave.append(Table(contexts, leave))

    def _cost(self, order: int, grams: np.ndarray) -> np.ndarray:
        """Bits of grams' last bytes for all languages, from the given order down."""
        row = self.grams[order].find(grams)
        out = self.grams[order].costs[row] if len(self.grams[order].costs) else np.zeros((len(grams), len(self.languages)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            g = grams[miss]
            left = self.leave[order].find((g >> np.uint32(8)) if order else np.zeros(len(g), np.uint32))
            extra = np.where((left >= 0)[:, None], self.leave[order].costs[left], np.float32(0))
            down = self._cost(order - 1, g & np.uint32((1 << (8 * order)) - 1)) if order else np.float32(8.0)
            out[miss] = extra + down
        return out

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(raw):
            return out
        code, whole = _grams(raw, offsets, ORDER + 1)
        cost = self._cost(ORDER, code)
        # a text's first bytes have shorter contexts
        starts, ends = offsets[:-1], offsets[1:]
        for k in range(ORDER):
            at = (starts + k)[starts + k < ends]
            cost[at] = self._cost(k, code[at] & np.uint32((1 << (8 * (k + 1))) - 1))
        full = np.flatnonzero(ends > starts)
        out[full] = np.add.reduceat(cost, starts[full], axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, most: int = DOCS) -> Model:
    texts: dict[str, list[bytes]] = {}
    for r in training_rows(docs, most).collect():  # bounded by `most` for each language
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    return Model(texts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language with the shortest code, and 2 ^ -bits of it over the sum of all
    languages', where the bits of texts over 64 bytes count as if they had 64."""
    text_batches(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    languages = pa.array([*model.languages, "und"], pa.string())
    und = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(3))
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            best, score = np.full(batch.num_rows, und), np.zeros(batch.num_rows)
            if und:
                for i, j, part, at in chunks(raw, offsets):
                    bits = model.bits(part, at)
                    own = np.argmin(bits, 1)
                    n = np.maximum(np.diff(at), 1)
                    gap = (bits - bits[np.arange(j - i), own][:, None]) * np.minimum(1, 64 / n)[:, None]
                    ok = letters[i:j]
                    best[i:j] = np.where(ok, own, und)
                    score[i:j] = np.where(ok, 1 / np.exp2(-gap).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), languages.take(pa.array(best)), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
