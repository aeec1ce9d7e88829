"""How far the sources of a language differ: summed differences of smoothed term shares, by inclusion and exclusion.

A group (language, source) gives every kept term of its language a share, also those that it doesn't hold. Over all kept
terms the difference of two groups splits by what each of them holds:

* terms that only one group holds cost |its share - the other's share of nothing|. Summed over all terms that a group holds,
  this needs its histogram of counts only;
* terms that both hold are then counted wrongly twice, which a join of postings by term puts right;
* terms that neither holds cost one constant each.

So no table has a row for each group and each kept term. Everything is integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .memory import short_batches, tidy
from .store import materialize

#: A term is kept where so many documents of its language have it.
DOCUMENTS = 30
#: Added to each count, and what the shares of a group sum up to.
SMOOTH, ONE = 5, 1_000_000_000
#: Terms of a group in the report.
TOP = 50
#: Terms that a task holds before it sends their counts on.
HELD = 200_000

#: Bytes of UTF-8: A-Z in lower case, a-z and all from 0x80 as they are, else a space.
TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by group. Counts are summed in each task, then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        seen: dict[tuple, Counter] = defaultdict(Counter)

        def send() -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            for (a, b), terms in n.items():
                of = seen[a, b]
                cols[0] += [a] * len(terms)
                cols[1] += [b] * len(terms)
                cols[2] += [t.decode() for t in terms]
                cols[3] += terms.values()
                cols[4] += [of[t] for t in terms]
            n.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "term", "n", "docs"])

        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                terms = Counter(batch.column(2)[i].as_buffer().to_pybytes().translate(TERMS).split())
                before = len(n[key])
                n[key].update(terms)
                seen[key].update(terms.keys())
                held += len(n[key]) - before
                if held > HELD:
                    yield send()
                    held = 0
        if n:
            yield send()
        tidy()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source)], F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return rows.toDF("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str | int, total: str, kept: str) -> Column:
    """1 + floor(ONE * (count + SMOOTH) / (total + SMOOTH * kept)), exactly; NULL where nothing is kept."""
    return F.expr(f"CAST(1 + CAST({ONE} AS DECIMAL(10, 0)) * CAST({count} + {SMOOTH} AS DECIMAL(20, 0)) DIV CAST(nullif({total} + {SMOOTH} * {kept}, 0) AS DECIMAL(20, 0)) AS BIGINT)")


def kept_counts(counts: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, n_lang, first) of the terms that `documents` documents of the language have; `first` marks
    one row of each term. A term of a language has as many rows as there are sources with it."""
    w = W.partitionBy("lang", "term")
    rows = counts.select("lang", "source", "term", "n", F.sum("docs").over(w).alias("docs"), F.sum("n").over(w).alias("n_lang"), (F.min("source").over(w) == F.col("source")).alias("first"))
    return rows.where(F.col("docs") >= documents).drop("docs")


def group_totals(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, held, kept, lang_total, nothing): a group's occurrences and terms, its language's terms and
    occurrences, and the group's share of a term that it doesn't hold. One row for each group, also those without terms."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"), F.count_if("first").alias("firsts"))
    langs = own.groupBy("lang").agg(F.sum("firsts").alias("kept"), F.sum("total").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return rows.select("lang", "source", *[zero(c) for c in ("total", "held", "kept", "lang_total")]).withColumn("nothing", F.coalesce(share(0, "total", "kept"), F.lit(0)))


def pair_sums(totals: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, a, b, value) for each two groups of a language, a < b. shares: (lang, source, term, p)."""
    side = lambda s: totals.select("lang", F.col("source").alias(s), F.col("held").alias(f"held_{s}"), F.col("nothing").alias(f"z_{s}"), "kept")
    pairs = side("a").join(side("b").drop("kept"), "lang").where("a < b")
    # all that a group holds, against the other's share of nothing
    histogram = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    others = totals.select("lang", F.col("source").alias("other"), F.col("nothing").alias("z"))
    one = histogram.join(others, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.abs(F.col("p") - F.col("z")) * F.col("terms")).alias("one"))
    # what both hold
    z = totals.select("lang", "source", "nothing")
    posting = shares.join(z, ["lang", "source"])
    left, right = (posting.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("nothing").alias(f"n_{s}")) for s in ("a", "b"))
    p, q, z_p, z_q = (F.col(c) for c in ("p_a", "p_b", "n_a", "n_b"))
    mended = F.abs(p - q) - F.abs(p - z_q) - F.abs(q - z_p)
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(mended).alias("mended"), F.count(F.lit(1)).alias("both"))
    of = lambda a, b, out: one.select("lang", F.col("source").alias(a), F.col("other").alias(b), F.col("one").alias(out))
    whole = pairs.join(both, ["lang", "a", "b"], "left").join(of("a", "b", "one_a"), ["lang", "a", "b"], "left").join(of("b", "a", "one_b"), ["lang", "a", "b"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    neither = F.col("kept") - F.col("held_a") - F.col("held_b") + zero("both")
    return whole.select("lang", "a", "b", (zero("one_a") + zero("one_b") + zero("mended") + neither * F.abs(F.col("z_a") - F.col("z_b"))).alias("value"))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", documents: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank).

    part `pair`: each other source of the language, with the summed difference of shares over all kept terms, all ranks.
    part `term`: kept terms that the group holds and whose share is above the language's, ranks up to `top`. Ranks go by
    value, the largest first, then by the item's bytes.

    A null text, lang or source counts as empty. Repeated rows count as documents of their own. A language without kept terms
    has pairs of value 0 and no terms; a lone source has no pairs. Texts may be of any length; an empty table gives no rows.
    Other columns are not read.
    """
    with short_batches(docs.sparkSession):
        kept, _ = materialize(kept_counts(term_counts(docs, lang, source, text), documents), "terms")
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    totals, _ = materialize(group_totals(groups, kept), "groups")
    shares, _ = materialize(kept.join(totals, ["lang", "source"]).select("lang", "source", "term", share("n", "total", "kept").alias("p"), share("n_lang", "lang_total", "kept").alias("q")), "shares")
    sums, _ = materialize(pair_sums(totals, shares), "pairs")
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    w = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.withColumn("rank", F.row_number().over(w))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    rows = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return rows(pairs, "pair").unionByName(rows(terms, "term"))
