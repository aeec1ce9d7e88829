"""Nearest neighbours by block matrix join.

Vectors are packed into blocks: float values, int8 codes with one scale for each vector, and the length of what the
codes miss. Blocks of queries meet blocks of candidates as tiles. A tile's product of codes gives all inner products to
within |x - x'| |y| + |x'| |y - y'|, by Cauchy-Schwarz; only pairs whose upper bound reaches the k-th best so far are
computed from the float values in double precision and pushed on the query's heap. So no neighbour is lost: results are
exact, ties to the smaller vec_id.

Tiles form a grid of query blocks by runs of candidate blocks (a stated query set against all rows): a cell's task keeps
its queries' heaps over its run and gives k rows for each query, and a top-k by query merges the cells. A candidate block
is sent once to each query block and a query block once to each run. Memory is bounded by a tile.

Defined cases: vectors that are null, empty, zero or hold a null or a non-finite component take no part, nor do rows
without vec_id. Only vectors of equal length meet. Rows with the query's own vec_id are the query's own and never its
neighbours. Several query rows of one vec_id with different vectors are answered one by one, in rows of equal query_id;
equal rows are one query. Repeated candidates come back as often as they occur. An empty table gives an empty result. Only
the key and the vector are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 2048
QUERY_BLOCK = 1024
#: Candidate blocks that one task meets one after another, at most.
RUN = 16
PAIRS = 1 << 16

PACKED = "dim int, cell long, ids binary, marks binary, vectors binary"


def usable(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    v = F.col(value)
    fine = F.size(v) > 0
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    fine &= F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & v.isNotNull() & fine)
    return rows.select(F.col(key).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))


def _pack(size: int):
    """Rows (vec_id, mark, v, dim, cell) to blocks of up to `size` rows of one length and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def block(kind: tuple[int, int]) -> pa.RecordBatch:
            parts = [np.concatenate(x).tobytes() for x in zip(*held.pop(kind), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([kind[0]], pa.int32()), pa.array([kind[1]], pa.int64()), *[pa.array([x], pa.binary()) for x in parts]], ["dim", "cell", "ids", "marks", "vectors"])

        for batch in batches:
            ids, marks, dims, cells = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(dims.astype(np.int64))])
            for kind in sorted(set(zip(dims.tolist(), cells.tolist(), strict=True))):
                own = np.flatnonzero((dims == kind[0]) & (cells == kind[1]))
                rows = flat[(starts[own][:, None] + np.arange(kind[0])).ravel()].reshape(-1, kind[0])
                for i in range(0, len(own), size):
                    part = slice(i, i + size)
                    held.setdefault(kind, []).append((ids[own[part]], marks[own[part]], rows[part]))
                    if sum(len(x[0]) for x in held[kind]) >= size:
                        yield block(kind)
        for kind in list(held):
            yield block(kind)

    return run


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, for exact products), scales, lengths of the coded vectors and of what they miss."""
    top = np.abs(x).max(1)
    scale = np.where(top > 0, top / 127, 1.0)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    coded = q * scale[:, None]
    return q.astype(np.float32), scale, np.sqrt((coded**2).sum(1)), np.sqrt(((x - coded) ** 2).sum(1))


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in order of the components."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


class Heaps:
    """The k best candidates of each query so far, with the k-th score as bar."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids = k, [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n
        self.bar = np.full(n, -np.inf)

    def push(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.ids[q] = score[order], ids[order]
        if len(order) == self.k:
            self.bar[q] = self.score[q][-1]


def search_tile(heaps: Heaps, q_ids, q, q_codes, c_ids, c, k: int) -> None:
    """Push on the heaps all candidates of a tile that may be among a query's k best."""
    cq, cs, cl, ce = codes(c)
    qq, qs, ql, qe = q_codes
    # sums of products of codes stay below 2^24 up to 1,040 components, so float32 holds them exactly
    wide = np.float32 if q.shape[1] <= 1040 else np.float64
    near = (qq.astype(wide) @ cq.astype(wide).T).astype(np.float64) * qs[:, None] * cs[None, :]
    full = np.sqrt((c**2).sum(1))
    slack = qe[:, None] * full[None, :] + ql[:, None] * ce[None, :]
    slack += 1e-12 * (1 + np.abs(near) + (ql + qe)[:, None] * full[None, :])
    own = q_ids[:, None] == c_ids[None, :]
    low = np.where(own, -np.inf, near - slack)
    if low.shape[1] >= k:
        # the k-th largest lower bound: the k-th best of this tile is no worse
        bar = np.maximum(heaps.bar, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
    else:
        bar = heaps.bar
    i, j = np.nonzero(~own & (near + slack >= bar[:, None]))
    for a in range(0, len(i), PAIRS):
        x, y = i[a : a + PAIRS], j[a : a + PAIRS]
        score = inner(q[x], c[y])
        edges = np.flatnonzero(np.diff(x)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(x)], strict=True):
            heaps.push(x[lo], score[lo:hi], c_ids[y[lo:hi]])


def _search(k: int):
    """Tiles (cell, run, dim, q_ids, q_marks, q, ids, vectors), those of one query block and run together, to best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def result() -> pa.RecordBatch:
            _, ids, marks, _, _, heaps = held
            n = [len(x) for x in heaps.ids]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.repeat(marks, n)), pa.array(np.concatenate(heaps.ids)), pa.array(np.concatenate(heaps.score))], ["query_id", "query_mark", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                cell, part, dim = (batch.column(i)[r].as_py() for i in range(3))
                q_ids, q_marks, ids = (np.frombuffer(batch.column(i)[r].as_buffer(), np.int64) for i in (3, 4, 6))
                q, c = (np.frombuffer(batch.column(i)[r].as_buffer(), np.float64).reshape(-1, dim) for i in (5, 7))
                kind = (cell, part, dim, q_marks.tobytes())
                if held is None or held[0] != kind:
                    if held is not None:
                        yield result()
                    held = (kind, q_ids.copy(), q_marks.copy(), q.copy(), codes(q), Heaps(len(q_ids), k))
                search_tile(held[5], held[1], held[3], held[4], ids, c, k)
        if held is not None:
            yield result()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the largest inner product for each row of queries."""
    asked, all_rows = usable(queries, key, value).distinct(), usable(vectors, key, value)
    cells = max(1, -(-asked.count() // QUERY_BLOCK))
    runs = max(1, -(-all_rows.count() // (BLOCK * RUN)))
    marked = asked.select("vec_id", F.xxhash64("vec_id", "v").alias("mark"), "v", "dim").withColumn("cell", F.pmod("mark", F.lit(cells)))
    q = marked.repartition("cell").mapInArrow(_pack(QUERY_BLOCK), PACKED).select("cell", "dim", F.col("ids").alias("q_ids"), F.col("marks").alias("q_marks"), F.col("vectors").alias("q"))
    c = all_rows.select("vec_id", F.lit(0).cast("long").alias("mark"), "v", "dim", F.lit(0).cast("long").alias("cell")).mapInArrow(_pack(BLOCK), PACKED)
    c = c.select(F.pmod(F.xxhash64("ids"), F.lit(runs)).alias("run"), "dim", "ids", "vectors")
    c = c.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    q = q.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    tiles = q.join(c, ["cell", "run", "dim"]).sortWithinPartitions("cell", "run", "dim", "q_marks")
    best = tiles.select("cell", "run", "dim", "q_ids", "q_marks", "q", "ids", "vectors").mapInArrow(_search(k), "query_id long, query_mark long, vec_id long, score double")
    order = W.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
