"""Exact duplicates, by a minimal perfect hash over the digests of earlier documents.

The index of a history holds, for each shard of digests, a minimal perfect hash: a function that sends the shard's n
digests to n slots without a collision. A slot holds the full digest and where the winner stands. Any other digest leads
to some slot as well, so a lookup compares all 32 bytes there: a match is a repeat, everything else is new and is grouped
by itself.

Only digests travel. They are summed by digest in each task before any shuffle, so a text with very many copies is a few
rows; a shard has a bounded number of digests, and the way back from digests to documents spares hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hot import join_sums
from .store import materialize
from .words import mix

#: Digests of a shard, about; a shard's row in the index is some 60 bytes a digest.
SHARD_KEYS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "shard int, n long, seeds binary, digests binary, winners binary, sizes binary"
#: Rounds in which the digests of a bucket look for free slots together.
ROUNDS = 1 << 20


# -- the hash ----------------------------------------------------------------


def halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each 32-byte digest, from bytes that don't choose its shard."""
    words = digests.reshape(-1, 32).view("<u8")
    return words[:, 1], words[:, 2]


def slots_of(digests: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The slot of each digest. A bucket's seed below 0 names the slot of its only digest; else it is mixed with the digest."""
    n = len(seeds)
    of_bucket, of_slot = halves(digests)
    seed = seeds[(of_bucket % np.uint64(n)).astype(np.int64)]
    return np.where(seed < 0, -seed - 1, _slot(of_slot, np.maximum(seed, 0).astype(np.uint64), n))


def _slot(x: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (mix(x ^ mix(seed + np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)).astype(np.int64)


def perfect_hash(digests: np.ndarray) -> np.ndarray:
    """Seeds of n buckets that send n different digests (32 bytes each) to n slots.

    The largest buckets look first: all buckets of one size try one seed in each round, and of those whose digests all fall
    into free slots the first in each slot stay. Buckets of one digest take what slots are left.
    """
    n = len(digests) // 32
    of_bucket, of_slot = halves(digests)
    bucket = (of_bucket % np.uint64(max(n, 1))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    start = np.searchsorted(bucket[order], np.arange(n + 1))
    size = np.diff(start)
    seeds, taken = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(int(size.max(initial=0)), 1, -1):
        open_ = np.flatnonzero(size == k)
        keys = of_slot[order[start[open_][:, None] + np.arange(k)]]
        for seed in range(ROUNDS):
            if not len(open_):
                break
            at = _slot(keys, np.array([seed], np.uint64), n)
            sorted_ = np.sort(at, 1)
            fine = ~taken[at].any(1) & (sorted_[:, 1:] != sorted_[:, :-1]).all(1)
            some = np.flatnonzero(fine)
            if len(some):
                flat = at[some].ravel()
                _, first = np.unique(flat, return_index=True)
                mine = np.zeros(len(flat), bool)
                mine[first] = True
                some = some[mine.reshape(-1, k).all(1)]
                taken[at[some]] = True
                seeds[open_[some]] = seed
                left = np.ones(len(open_), bool)
                left[some] = False
                open_, keys = open_[left], keys[left]
        if len(open_):
            raise ValueError("digests of one shard must differ")
    seeds[np.flatnonzero(size == 1)] = -np.flatnonzero(~taken)[: int((size == 1).sum())] - 1
    return seeds


# -- the index ---------------------------------------------------------------


def normalised(text: str | Column) -> Column:
    """The text, null as empty, with A-Z and nothing else in lower case."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, row): `row` marks rows, so that of equal rows one can stay. Write it before use: marks are dealt anew
    with each run."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, winner, size) of key rows: the largest doc_id's place, null below all, of equals the first row."""
    at = F.struct(F.col("doc_id").alias("doc_id"), (-F.col("row")).alias("row"))
    return rows.groupBy("digest").agg(F.max(at).alias("winner"), F.count(F.lit(1)).alias("size"))


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substr("digest", F.lit(1), F.lit(7))), 16, 10).cast("long"), F.lit(shards)).cast("int")


_NULL = -(1 << 63)


def _blobs(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {"digest": np.frombuffer(b"".join(pdf["digest"]), np.uint8), "at": pdf[["doc_id", "row"]].to_numpy(np.int64), "size": pdf["size"].to_numpy(np.int64)}


def _flat(sums: DataFrame, shards: int) -> DataFrame:
    return sums.select(_shard(shards).alias("shard"), "digest", F.coalesce("winner.doc_id", F.lit(_NULL)).alias("doc_id"), F.col("winner.row").alias("row"), "size")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of a history's winners (see `winners`): one row a shard."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _blobs(pdf)
        seeds = perfect_hash(got["digest"])
        slot = slots_of(got["digest"], seeds)
        back = np.empty(len(slot), np.int64)
        back[slot] = np.arange(len(slot))
        blob = lambda a: a[back].tobytes()
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [len(slot)], "seeds": [seeds.tobytes()], "digests": [blob(got["digest"].reshape(-1, 32))], "winners": [blob(got["at"])], "sizes": [blob(got["size"])]})

    return _flat(history, shards).groupBy("shard").applyInPandas(build, INDEX)


def look_up(sums: DataFrame, index: DataFrame, shards: int, salts: int = 1) -> DataFrame:
    """Winners of new rows looked up in a history's index: (digest, winner, size, size_before, earlier).

    A digest that the index holds comes with the history's winner, if that is the larger one, with both sizes added, and
    with `earlier` the history's own winner; others come as they are. salts: parts that each shard's new digests are dealt
    to, where they are many more than the history's.
    """

    def probe(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        if not len(new):
            return new.assign(size_before=[], e_doc_id=[], e_row=[])[["digest", "doc_id", "row", "size", "size_before", "e_doc_id", "e_row"]]
        got = _blobs(new)
        at, size, before, earlier = got["at"], got["size"], np.zeros(len(new), np.int64), np.zeros((len(new), 2), np.int64)
        if len(old):
            there = old.iloc[0]
            digests, where, sizes = (np.frombuffer(there[c], t) for c, t in (("digests", np.uint8), ("winners", np.int64), ("sizes", np.int64)))
            slot = slots_of(got["digest"], np.frombuffer(there["seeds"], np.int64))
            same = (digests.reshape(-1, 32)[slot] == got["digest"].reshape(-1, 32)).all(1)  # byte by byte
            where = where.reshape(-1, 2)[slot]
            before = np.where(same, sizes[slot], 0)
            earlier = np.where(same[:, None], where, 0)
            older = same & ((where[:, 0] > at[:, 0]) | (where[:, 0] == at[:, 0]) & (where[:, 1] > at[:, 1]))
            at = np.where(older[:, None], where, at)
        return pd.DataFrame({"digest": new["digest"], "doc_id": at[:, 0], "row": at[:, 1], "size": size + before, "size_before": before, "e_doc_id": earlier[:, 0], "e_row": earlier[:, 1]})

    new = _flat(sums, shards).withColumn("salt", F.pmod(F.hash("digest"), F.lit(salts)))
    old = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    out = new.groupBy("shard", "salt").cogroup(old.groupBy("shard", "salt")).applyInPandas(probe, "digest binary, doc_id long, row long, size long, size_before long, e_doc_id long, e_row long")
    place = lambda d, r: F.struct(F.nullif(F.col(d), F.lit(_NULL)).alias("doc_id"), F.col(r).alias("row"))
    return out.select("digest", place("doc_id", "row").alias("winner"), "size", "size_before", F.when(F.col("size_before") > 0, place("e_doc_id", "e_row")).alias("earlier"))


def index_rows(index: DataFrame) -> DataFrame:
    """(digest, winner, size) of an index's slots."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.frombuffer(r["winners"], np.int64).reshape(-1, 2)
                digests = pa.Array.from_buffers(pa.binary(32), r["n"], [None, pa.py_buffer(r["digests"])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(np.frombuffer(r["sizes"], np.int64))], ["digest", "doc_id", "row", "size"])

    rows = index.select("n", "digests", "winners", "sizes").mapInArrow(read, "digest binary, doc_id long, row long, size long")
    return rows.select("digest", F.struct(F.nullif(F.col("doc_id"), F.lit(_NULL)).alias("doc_id"), "row").alias("winner"), "size")


# -- documents ---------------------------------------------------------------


def shards_for(*numbers: int, of: int = SHARD_KEYS) -> int:
    return max(1, -(-max(numbers, default=1) // of))


def judged(rows: DataFrame, sums: DataFrame, total: int) -> DataFrame:
    """Key rows with the verdict on their text."""
    met = join_sums(rows, sums.select("digest", "winner", F.col("size").alias("group_size")), "digest", "group_size", total)
    return met.select("doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size", (-F.col("row") == F.col("winner.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows whose doc_id is in the lower half of the range are the history: their distinct digests are indexed; the later rows'
    digests are looked up there, and those that aren't there are grouped by themselves. Where the halves part makes no difference
    to the result.

    A null text counts as empty; a null doc_id is smaller than any, and belongs to the history. Texts are compared after A-Z only
    is lower-cased, by SHA-256 in UTF-8, whole and of any length. Of equal texts the row with the largest doc_id stays, of
    rows that share it exactly one. An empty table gives no rows. Other columns are not read.
    """
    rows, _ = materialize(keys(docs, doc_id, text), "digests")
    total, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    middle = (low + high) // 2 if low is not None else 0
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    history, _ = materialize(winners(rows.where(old)), "history")
    new, _ = materialize(winners(rows.where(~old)), "new")
    n_old, n_new = history.count(), new.count()
    shards = shards_for(n_old, of=shard_keys)
    index, _ = materialize(build_index(history, shards), "index")
    found, _ = materialize(look_up(new, index, shards, max(1, -(-n_new // (shards * shard_keys)))), "found")
    met = found.where("size_before > 0").select("digest")
    alone = index_rows(index).join(met, "digest", "left_anti")
    sums, _ = materialize(found.select("digest", "winner", "size").unionByName(alone.select("digest", "winner", "size")), "winners")
    return judged(rows, sums, total)


def fresh(docs: DataFrame, index: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text neither the index of earlier documents nor a better row of docs holds. Nulls
    and ties as in exact_duplicates."""
    marked, _ = materialize(docs.withColumn("_id", F.col(doc_id).cast("long")).withColumn("_digest", F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))).withColumn("_row", F.monotonically_increasing_id()), "docs")
    sums = winners(marked.select(F.col("_id").alias("doc_id"), F.col("_digest").alias("digest"), F.col("_row").alias("row")))
    stay = look_up(sums, index, shards).where("size_before = 0").select((-F.col("winner.row")).alias("_row"))
    return marked.join(stay, "_row", "left_semi").select(*docs.columns)
