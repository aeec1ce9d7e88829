"""Spelling variants: words one inserted, deleted or replaced code point apart, found by automatons of word halves.

A word is cut in two segments. Of two words that differ by one edit, one segment of the first stands untouched in the
second: at its start, or at its end. Every word's two segments go into Aho-Corasick automatons, dealt to shards; every word
is scanned by the shards that can hold a segment of it, hits are checked for offset and length, and the distance is verified.

A segment that very many words have (a common stem) would make one large group. Its words are cut again: the part that may
hold the edit is halved, and what stands outside of it is the new segment, until groups are small or the part is a
single code point, where at most as many words meet as there are letters. So no group is dropped and none is large.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import short_batches, tidy
from .store import materialize, release

#: Code points of a word, and times it occurs, at least.
LEAST, TIMES = 7, 2
#: One of so many (document, word) pairs loses a code point.
DROP = 31
#: A form occurs so many times as often as its variant, at least.
FORM = 10
#: Pairs of (word, count) that a task holds before it sends them on.
HELD = 200_000
#: Rows of a segment in one shard: beyond it patterns are cut again, and scanned words dealt to several shards.
HOT = 4_000
#: Rows and code points of a shard, about.
SHARD_ROWS, SHARD_CHARS = 20_000, 1_000_000
#: Patterns that a word is compared with one by one; more are cut again inside the task.
FEW = 64
#: Code points of a segment that go into the automaton; what is beyond is compared on a hit.
PIECE = 64

#: Latin-1 bytes: letters A-Z in lower case, a-z and U+00C0 to U+00FF as they are, all else a space.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


# -- words -------------------------------------------------------------------


def document_words(doc_id: object, text: str, drop: int = DROP, least: int = LEAST) -> Counter:
    """Results of a text's runs with their counts, without those of under `least` code points.

    A code point above U+00FF becomes '?' in Latin-1, which is no letter.
    """
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(w for w in text.encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= least).items():
        word = run.decode("latin-1")
        h = zlib.crc32(word.encode(), prefix)
        if h % drop == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            out[word] += n
    return out


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop: int = DROP, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(word, n) over all texts: the distinct results that occur `times` times at least. Counts are summed in each task, then
    by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time as a Python string
                t = batch.column(1)[i].as_py()
                if t:
                    held.update(document_words(batch.column(0)[i].as_py(), t, drop, least))
                if len(held) > HELD:
                    yield send()
        if held:
            yield send()
        tidy()

    parts = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


# -- segments ----------------------------------------------------------------


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with `key`: what a word of `len` code points has outside of its part [i, j), counted from the end after the part."""
    after = F.col("len") - F.col("j")
    head, tail = F.substr("word", F.lit(1), F.col("i")), F.substr("word", F.length("word") - after + 1, after)
    return rows.withColumn("key", F.xxhash64("len", "i", "j", head, tail))


def segment_rows(words: DataFrame) -> DataFrame:
    """(word, n, pattern, len, i, j, key): each word twice as a pattern, for an edit in its first or its second half, and as a
    scanned word for the halves of all lengths that one edit leads to."""

    def regions(length: Column, pattern: bool) -> list[Column]:
        half, row = (length / 2).cast("int"), lambda i, j: F.struct(F.lit(pattern).alias("pattern"), length.alias("len"), i.cast("int").alias("i"), j.cast("int").alias("j"))
        return [row(F.lit(0), half), row(half, length)]

    m = F.length("word")
    every = [*regions(m, True), *[r for d in (-1, 0, 1) for r in regions(m + d, False)]]
    return _keyed(words.select("word", "n", F.explode(F.array(*every)).alias("r")).select("word", "n", "r.*"))


def _halved(rows: DataFrame) -> DataFrame:
    mid = ((F.col("i") + F.col("j")) / 2).cast("int")
    parts = F.explode(F.array(F.struct(F.col("i").alias("i"), mid.alias("j")), F.struct(mid.alias("i"), F.col("j").alias("j")))).alias("r")
    return _keyed(rows.select("word", "n", "pattern", "len", parts).select("word", "n", "pattern", "len", "r.*"))


def dealt(rows: DataFrame, shards: int, hot: int = HOT) -> tuple[DataFrame, list[str]]:
    """Segment rows with `shard`, and the paths of the tables that they are read from.

    A segment with more than `hot` patterns is replaced by its two longer ones, as often as it takes; of a segment with
    more scanned words, these are dealt to several shards and its patterns go to all of them.
    """
    spark, ready, paths = rows.sparkSession, [], []
    while True:
        counts, path = materialize(rows.groupBy("key").agg(F.count_if("pattern").alias("n_patterns"), F.count_if(~F.col("pattern")).alias("n_scanned"), F.max(F.col("j") - F.col("i")).alias("wide")).where((F.col("n_patterns") > hot) | (F.col("n_scanned") > hot)), "segments")
        paths.append(path)
        cut = (F.col("n_patterns") > hot) & (F.col("wide") > 1)
        n, n_cut = counts.agg(F.count(F.lit(1)), F.count_if(cut)).first()
        if not n:
            release(spark, paths.pop())
            ready.append(rows.withColumn("salt", F.lit(0)))
            break
        marked = rows.join(counts, "key", "left")
        salts = F.ceil(F.coalesce("n_scanned", F.lit(1)) / hot).cast("int")
        salt = F.when(F.col("pattern"), F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)).otherwise(F.array(F.pmod(F.xxhash64("word", F.lit(7)), F.greatest(salts, F.lit(1))).cast("int")))
        ready.append(marked.where(~F.coalesce(cut, F.lit(False))).select(*rows.columns, F.explode(salt).alias("salt")))
        if not n_cut:
            break
        rows, path = materialize(_halved(marked.where(cut)), "segments")
        paths.append(path)
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out.withColumn("shard", F.pmod(F.xxhash64("key", "salt"), F.lit(shards)).cast("int")).drop("salt", "key"), paths


# -- one shard ---------------------------------------------------------------


def edit_at(a: str, b: str, i: int, j: int) -> bool:
    """Whether b is a with one code point inserted, deleted or replaced, first differing inside a's part [i, j).

    The first place where they differ is in one part of a word only, so a pair is found once, whatever its parts.
    """
    if a[:i] != b[:i]:
        return False
    n, m, p = len(a), len(b), i
    end = min(n, m)
    while p < end and p <= j and a[p] == b[p]:
        p += 1
    if not i <= min(p, n - 1) < j:
        return False
    if n == m:
        return p < n and a[p + 1 :] == b[p + 1 :]
    return a[p:] == b[p + 1 :] if m == n + 1 else a[p + 1 :] == b[p:] if n == m + 1 else False


def near_pairs(patterns: list[str], scanned: list[str], length: int, i: int, j: int, few: int = FEW) -> Iterator[tuple[str, str]]:
    """(pattern, scanned word) one edit apart with the edit in [i, j); patterns have `length` code points."""
    if len(patterns) <= few or j - i <= 1:
        for b in scanned:
            for a in patterns:
                if edit_at(a, b, i, j):
                    yield a, b
        return
    mid = (i + j) // 2
    for start, stop, of_a, of_b in ((mid, j, lambda a: a[i:mid], lambda b: b[i:mid]), (i, mid, lambda a: a[mid:j], lambda b: b[len(b) - (length - mid) : len(b) - (length - j)])):
        groups: dict[str, tuple[list[str], list[str]]] = defaultdict(lambda: ([], []))
        for a in patterns:
            groups[of_a(a)][0].append(a)
        for b in scanned:
            if (g := groups.get(of_b(b))) is not None:
                g[1].append(b)
        for own, others in groups.values():
            if others:
                yield from near_pairs(own, others, length, start, stop, few)


def shard_neighbours(rows: list[tuple[str, int, bool, int, int, int]]) -> dict[str, list]:
    """For each scanned word of a shard that has neighbours there: how many, and the most frequent (-n, word).

    rows: (word, n, pattern, len, i, j).
    """
    of: dict[str, int] = {}
    patterns: dict[tuple, set[str]] = defaultdict(set)
    routed: dict[str, set[tuple]] = defaultdict(set)
    for word, n, pattern, length, i, j in rows:
        at = (length, i, j, word[:i], word[len(word) - (length - j) :])
        if pattern:
            of[word] = n
            patterns[at].add(word)
        else:
            routed[word].add(at)
    automaton, pieces = ahocorasick.Automaton(), defaultdict(list)
    for at in patterns:
        _, _, _, head, tail = at
        start = len(head) >= len(tail)
        pieces[head[:PIECE] if start else tail[-PIECE:]].append((at, start))
    for piece, owners in pieces.items():
        automaton.add_word(piece, (len(piece), owners))
    out: dict[str, list] = {}
    if not pieces:
        return out
    automaton.make_automaton()
    hits: dict[tuple, list[str]] = defaultdict(list)
    for word, wanted in routed.items():
        last = len(word) - 1
        for end, (size, owners) in automaton.iter(word):
            first = end - size + 1
            if first and end < last:
                continue
            for at, start in owners:  # the segment's offset, then the length, and that the word was dealt here for it
                if (first == 0 if start else end == last) and abs(at[0] - last - 1) <= 1 and at in wanted:
                    hits[at].append(word)
    for at, scanned in hits.items():
        length, i, j = at[:3]
        for a, b in near_pairs(sorted(patterns[at]), scanned, length, i, j):
            best = (-of[a], a)
            have = out.setdefault(b, [0, best])
            have[0] += 1
            have[1] = min(have[1], best)
    return out


# -- the whole ---------------------------------------------------------------


def neighbours(words: DataFrame, hot: int = HOT, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, list[str]]:
    """(word, n_near, best_n, best) of words that have a near word: their number, and the most frequent one. words: a table
    with one row a word. Also the paths of the tables that the rows are read from."""
    n, chars = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    shards = 1 + max(8 * n // shard_rows, 8 * chars // SHARD_CHARS)
    rows, paths = dealt(segment_rows(words), shards, hot)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = shard_neighbours(list(pdf[["word", "n", "pattern", "len", "i", "j"]].itertuples(index=False, name=None)))
        tidy()
        return pd.DataFrame({"word": list(found), "n_near": [v[0] for v in found.values()], "best_n": [-v[1][0] for v in found.values()], "best": [v[1][1] for v in found.values()]})

    parts = rows.groupBy("shard").applyInPandas(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best")), paths


def roots(forms: DataFrame) -> tuple[DataFrame, str]:
    """(word, root) of a table of (word, form): forms followed to the last. Each step doubles what it follows; as a form is
    ten times as frequent, there are few."""
    spark = forms.sparkSession
    now, path = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.where("moved").limit(1).count():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step, step_path = materialize(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        release(spark, path)
        now, path = step, step_path
    return now.select("word", "root"), path


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, form_times: int = FORM, hot: int = HOT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each word of all texts: word, n, n_near, form, form_n, root.

    Near words differ by one code point. The form is the near word of largest n, of equals the smallest in code-point order, if
    that is at least `form_times` the word's own; the root is where forms lead.

    A null or empty text has no words. A null doc_id counts as an empty one in the checksum. Repeated rows count as often as
    they stand. Texts and words may be of any length; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    with short_batches(spark):
        words, _ = materialize(word_counts(docs, doc_id, text, least=least, times=times), "words")
        near, paths = neighbours(words, hot, shard_rows)
        formed, _ = materialize(words.join(near, "word", "left"), "near")
        release(spark, *paths)
    is_form = F.col("best_n") >= form_times * F.col("n")
    found = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    ends, _ = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
