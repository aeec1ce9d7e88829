"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n - 1 by (doc_id, crc32, size); the permutation sends a row number to a position p, and shard
p mod k, slot p div k follow. Both can be computed for any row number, and inverted, without looking at other rows.

Numbering: the narrow key table is written once to the shared folder, range-partitioned by its keys and a row mark (so
no key, however frequent, fills one task), sorted within partitions and written with its place; the partitions' counts
(as many as there are partitions) give the offsets. Texts are read once and never shuffled.

Defined cases: a null text has size 0 + 16 and the crc32 of the empty string; a null doc_id sorts first; rows that are
equal in all three columns take neighbouring numbers in any order, which leaves the result the same. An empty table
gives an empty result. Only the three columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize, release

ROUNDS = 4


def _scramble(x: np.ndarray, key: int, r: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


class Feistel:
    """A keyed permutation of 0 to n - 1: balanced Feistel rounds over the next power of four, walked until inside."""

    def __init__(self, n: int, key: int):
        self.n, self.key = n, key
        self.half = max(1, math.ceil(max(n - 1, 1).bit_length() / 2))
        self.mask = np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ (_scramble(left, self.key, r) & self.mask), left
            else:
                left, right = right, left ^ (_scramble(right, self.key, r) & self.mask)
        return (left << shift) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def position(self, row) -> np.ndarray:
        return self._walk(row, False)

    def row(self, position) -> np.ndarray:
        return self._walk(position, True)


def locate(row, n: int, shards: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers."""
    p = Feistel(n, key).position(row)
    return p % shards, p // shards


def row_at(shard, slot, n: int, shards: int, key: int) -> np.ndarray:
    """The global row number that stands at a slot of a shard."""
    return Feistel(n, key).row(np.asarray(slot) * shards + np.asarray(shard))


def size_and_crc(text: Column) -> tuple[Column, Column]:
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return F.octet_length(raw).cast("long") + 16, F.crc32(raw)


def numbered(docs: DataFrame, partitions: int | None = None) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, row) with row from 0 to n - 1, and n."""
    spark = docs.sparkSession
    size, crc = size_and_crc(F.col("text"))
    keys, keys_path = materialize(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("mark")), "shard-keys")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_crc32", "size", "mark"]
    dealt = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed, _ = materialize(dealt.select("doc_id", "size", "text_crc32", F.monotonically_increasing_id().alias("at")), "shard-rows")
    release(spark, keys_path)
    part, inside = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for p, n in counts:  # a row for each partition
        before.append((p, total))
        total += n
    offsets = spark.createDataFrame(before or [(0, 0)], "part long, first_row long")
    rows = placed.join(F.broadcast(offsets), part == F.col("part"))
    return rows.select("doc_id", "size", "text_crc32", (F.col("first_row") + inside).alias("row")), total


def shard(docs: DataFrame, shards: int, key: int = 20_240_229) -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot. Shards differ by one row at most; slots of a shard have no gaps."""
    rows, n = numbered(docs)

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(Feistel(n, key).position(row.to_numpy()))

    placed = rows.withColumn("_p", position("row"))
    return placed.select("doc_id", "size", "text_crc32", "row", (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {int(shards)}").alias("slot"))
