"""Mixing sources to target weights: fixed-length token blocks, multinomial counts, index permutations.

Each source's documents, in a fixed order, are one stream of words cut into blocks of `block` words. The mix has as many
block slots as the targets ask for, in output shards. Each shard draws its source counts from a multinomial whose
weights are what the sources still have to give, so that the totals meet the targets exactly. A source's k-th slot takes
block perm(k mod blocks) of pass k div blocks, where perm is the pass's pseudorandom permutation of block indices:
within a pass no block comes twice. Slots and blocks are joined by (source, block index).

Everything runs as DataFrame expressions. To the driver come one row for each source (sizes) and the counts of shards by
sources, both drawn there; texts are never shuffled for `mix`, and once for `mixed_documents`.

Order in a source: documents are dealt by hash into buckets, bucket sums give the buckets' offsets and a window inside
each bucket the document's own; a source with a third of all rows spreads over as many buckets as others together.

Defined cases: a null source is a source of its own, the last one; null or wordless texts have size 0 and take nothing;
rows with equal doc_id, source, size and text are interchangeable in `mix`, while each row of `mixed_documents` has all
columns of one row of the input. An empty table gives an empty result. Of the input only doc_id, source and text are read,
and rows are carried whole as one column, so extra columns can't clash.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import let
from .store import materialize

#: A source table up to this many rows is broadcast; a larger one is joined by a salted key.
BROADCAST_SOURCES = 20_000
SALTS = 32
#: Mean slots of the mix that one task makes.
TASK_SLOTS = 50_000
#: Mean rows of a bucket, over all sources.
BUCKET_ROWS = 20_000
WORDS = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, times: float) -> list[float]:
    """Targets by weight that stop at `times` each size; what stands above is shared among the others by weight."""
    cap = [times * s for s in sizes]
    target, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes)], float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap[i]
        left -= sum(cap[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return target


def draw_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard, shape (shards, sources): multinomial by what is left, totals as given.

    A draw beyond what a source has left goes to the sources that have some, in order of what they have left.
    """
    left, total = np.array(slots, np.int64), int(sum(slots))
    out = np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        size = (k + 1) * total // shards - k * total // shards
        if not size:
            continue
        rng = np.random.Generator(np.random.Philox(key=[seed, k]))
        got = np.minimum(rng.multinomial(size, left / left.sum()), left)
        short = size - int(got.sum())
        for i in np.argsort(-(left - got), kind="stable"):
            more = min(short, int(left[i] - got[i]))
            got[i] += more
            short -= more
        out[k], left = got, left - got
    return out


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 to n - 1, keyed: alternating Feistel rounds over a x b >= n, walked until inside.

    a and b are about the square root of n, so fewer than a points lie outside; a walk of 64 steps stays outside
    with a chance of about (1 / b) ^ 64, and then raises instead of giving a wrong index.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def rounds(v: Column) -> Column:
        # even rounds add to the part below a, odd ones to the part below b
        state = F.struct((v % a).alias("u"), F.floor(v / a).cast("long").alias("v"))
        for_rounds = F.array(*[F.lit(r) for r in range(4)])
        return F.aggregate(
            for_rounds,
            state,
            lambda s, r: F.when(r % 2 == 0, F.struct(((s["u"] + F.pmod(F.xxhash64(s["v"], r, key), a)) % a).alias("u"), s["v"].alias("v"))).otherwise(
                F.struct(s["u"].alias("u"), ((s["v"] + F.pmod(F.xxhash64(s["u"], r, key), b)) % b).alias("v"))
            ),
            lambda s: s["v"] * a + s["u"],
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), rounds(x), lambda v, _: F.when(v < n, v).otherwise(rounds(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the permutation's walk did not end")).cast("long"))


def _key(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


class Plan:
    """Sizes, targets and slot counts of the sources, in code-point order with null last."""

    def __init__(self, rows: list[tuple[str | None, int]], block: int, shards: int, seed: int, weights=(1, 2, 3), times: float = 3.0):
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
        self.names, self.sizes = [r[0] for r in rows], [int(r[1]) for r in rows]
        self.block, self.shards, self.seed, self.buckets = block, shards, seed, 64
        self.weights = [weights[i % len(weights)] for i in range(len(rows))]
        self.targets = water_fill(self.sizes, self.weights, sum(self.sizes), times)
        self.blocks = [-(-s // block) for s in self.sizes]
        # the last block of a source may be short: slots are counted by the mean length of its blocks
        most = [math.floor(times * b + 1e-9) for b in self.blocks]
        self.slots = [min(m, round(t * b / s)) if s else 0 for t, s, b, m in zip(self.targets, self.sizes, self.blocks, most, strict=True)]
        self.counts = draw_counts(self.slots, shards, seed)


def _inline(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a constant of the plan, parsed from JSON: a frame made from Python's objects would start Python workers."""
    columns = [c.split() for c in schema.split(", ")]
    data = json.dumps([dict(zip([c for c, _ in columns], r, strict=True)) for r in rows])
    kind = f"array<struct<{', '.join(f'{c}:{k}' for c, k in columns)}>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(data), kind)).alias("_r")).select("_r.*")


def _with_source(df: DataFrame, plan: Plan, columns: dict[str, list], source: Column) -> DataFrame:
    """df with source_no and the given per-source columns; null-safe. Broadcast up to a bound, else by a salted key."""
    spark = df.sparkSession
    kinds = ", ".join(f"{k} {'double' if v and isinstance(v[0], float) else 'long'}" for k, v in columns.items())
    rows = [(name, i, *[v[i] for v in columns.values()]) for i, name in enumerate(plan.names)]
    table = _inline(spark, rows, f"_source string, source_no long{', ' if kinds else ''}{kinds}")
    df = df.withColumn("_key", source)
    if len(rows) <= BROADCAST_SOURCES:
        return df.join(F.broadcast(table), F.col("_key").eqNullSafe(F.col("_source"))).drop("_key", "_source")
    table = table.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = df.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    # the planner takes the table for as small as the constant that it is parsed from
    return df.join(table.hint("merge"), F.col("_key").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_salt_of"))).drop("_key", "_source", "_salt", "_salt_of")


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, size, a row mark (the column `row`, or a new one) and the hash that orders and buckets rows."""
    mark = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), mark.alias("row_id"), F.xxhash64("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("deal"))


def plan_mix(keys: DataFrame, block: int = 128, shards: int = 16, seed: int = 7, weights=(1, 2, 3), times: float = 3.0) -> Plan:
    rows = keys.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row for each source
    plan = Plan([(r["source"], r["size"]) for r in rows], block, shards, seed, weights, times)
    plan.buckets = max(64, sum(r["n"] for r in rows) // BUCKET_ROWS)
    return plan


def place(keys: DataFrame, plan: Plan) -> DataFrame:
    """keys with source_no, target, source_size, blocks and `start`, the document's first word in its source's stream."""
    per = {"source_size": plan.sizes, "target": [float(t) for t in plan.targets], "blocks": plan.blocks}
    rows = _with_source(keys, plan, per, F.col("source")).withColumn("bucket", F.pmod(F.col("deal"), F.lit(plan.buckets)))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("_sum"))
    ahead = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("source_no").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    own = W.partitionBy("source_no", "bucket").orderBy("deal", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.join(offsets, (F.col("source_no") == F.col("_s")) & (F.col("bucket") == F.col("_b")))
    return rows.withColumn("start", F.col("_before") + F.col("_own")).drop("_s", "_b", "_before", "_own", "bucket")


def slots(spark, plan: Plan) -> DataFrame:
    """One row for each block of the mix: shard, slot, source_no, pass, block_no."""
    rows, before = [], [0] * len(plan.names)
    first = 0
    for k in range(plan.shards):
        for i, c in enumerate(plan.counts[k]):
            if c:
                rows.append((k, i, before[i], int(c), first, plan.blocks[i]))
                before[i] += int(c)
                first += int(c)
    table = _inline(spark, rows, "shard long, source_no long, before long, n long, first long, blocks long")
    # runs of a few thousand slots, so that one row's explosion is bounded and dealt out
    step = 4096
    runs = table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))).alias("run"))
    # a stated number: by its few bytes the table would be put into one task, which then makes all slots
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(plan.slots) // TASK_SLOTS)
    runs = runs.repartition(tasks, F.col("shard"), F.col("source_no"), F.col("run"))
    one = runs.select("*", F.explode(F.sequence(F.col("run") * step, F.least(F.col("n"), (F.col("run") + 1) * step) - 1)).alias("i"))
    k = F.col("before") + F.col("i")
    one = one.withColumns({"pass": F.floor(k / F.col("blocks")), "within": k % F.col("blocks"), "slot": F.col("first") + F.col("i")})
    key = _key(plan.seed, F.col("source_no"), F.col("pass"))
    return one.select("shard", "slot", "source_no", "pass", permuted(F.col("within"), F.col("blocks"), key).alias("block_no"))


def pieces(placed: DataFrame, plan: Plan) -> DataFrame:
    """One row for each document and block that it reaches into: first word in the document and how many."""
    b, end = plan.block, F.col("start") + F.col("size")
    span = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b)))
    rows = placed.withColumn("block_no", F.explode_outer(span))
    lo, hi = F.greatest(F.col("start"), F.col("block_no") * b), F.least(end, (F.col("block_no") + 1) * b)
    return rows.withColumns({"from_word": lo - F.col("start"), "words": F.coalesce(hi - lo, F.lit(0).cast("long"))})


def mix(docs: DataFrame, block: int = 128, shards: int = 16, seed: int = 7, weights=(1, 2, 3), times: float = 3.0) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: how many of each document's words the mix takes, repeats counted.

    A source's words come within a block or two of its target; no document gives more than `times` its size.
    """
    keys, _ = materialize(sized(docs), "mix-keys")
    plan = plan_mix(keys, block, shards, seed, weights, times)
    if not plan.names:
        return keys.select("doc_id", "size", "source", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"))
    times_taken = slots(docs.sparkSession, plan).groupBy("source_no", "block_no").agg(F.count(F.lit(1)).alias("times"))
    placed = place(keys, plan)
    own = ["row_id", "doc_id", "size", "source", "source_size", "target"]
    # the planner takes the slots for as small as what they are made from and would broadcast them
    joined = pieces(placed.where("size > 0"), plan).join(times_taken.hint("merge"), ["source_no", "block_no"], "left")
    some = joined.groupBy(*own).agg(F.sum(F.col("words") * F.coalesce(F.col("times"), F.lit(0))).cast("long").alias("taken"))
    none = _with_source(keys.where("size = 0"), plan, {"source_size": plan.sizes, "target": plan.targets}, F.col("source")).select(*own, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).drop("row_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows like those of docs: a document comes whole for each full pass over its source, and once more with
    the words of those of its blocks that the last, partial pass takes, in order and with their white space.

    `text` and, if there is one, `n_chars` are the row's own; all other columns are the document's.
    """
    spark = docs.sparkSession
    # written with a number for each row, which both sides of the join below read; whole rows are one column, so no name clashes
    whole, _ = materialize(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "mix-docs")
    keys, _ = materialize(sized(whole.select("_doc.doc_id", "_doc.source", "_doc.text", "_row"), "_row"), "mix-keys")
    plan = plan_mix(keys, **options)
    if not plan.names:
        return docs
    full = [s // b if b else 0 for s, b in zip(plan.slots, plan.blocks, strict=True)]
    placed, _ = materialize(place(keys.where("size > 0"), plan).select("row_id", "source_no", "start", "size"), "mix-placed")
    passes = list(enumerate(full))
    last = slots(spark, plan).join(F.broadcast(_inline(spark, passes, "source_no long, pass long")), ["source_no", "pass"]).select("source_no", "block_no")
    parts = pieces(placed, plan).join(last.hint("merge"), ["source_no", "block_no"]).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("from_word", "words"))).alias("_parts"))
    rows = placed.select("row_id", "source_no").join(parts, "row_id", "left").join(F.broadcast(_inline(spark, passes, "source_no long, _full long")), "source_no")
    rows = rows.where("_full > 0 or _parts is not null").select(F.col("row_id").alias("_row"), "_full", "_parts")
    met = whole.join(rows, "_row")
    words = F.regexp_extract_all("_doc.text", F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), F.lit(0))
    taken = let(words, lambda w: F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice(w, p["from_word"].cast("int") + 1, p["words"].cast("int")))), ""))
    cut = F.when(F.col("_parts").isNotNull(), F.array(taken)).otherwise(F.array().cast("array<string>"))
    copies = F.array_repeat(F.col("_doc.text"), F.col("_full").cast("int"))
    out = met.withColumn("_text", F.explode(F.concat(copies, cut)))
    made = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[made.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
