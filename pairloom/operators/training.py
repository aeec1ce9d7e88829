"""Networks for prosody targets whose gradients are summed over partitions, one minibatch a step, for all keys and seeds at once.

Rows are written once, dealt to minibatches of about `batch` rows by a hash of their id, and a large minibatch to several files;
a step reads the files of one minibatch of each key, sums the gradients of its rows inside tasks, then over tasks in the
JVM. The driver holds parameters and sums only (keys x seeds x parameters, MOST_NUMBERS at most), and takes an AdamW step.
The minibatches' order is dealt anew each epoch; all seeds of a key see the same one, so that rows are read once. What is
dropped out is a hash of row id, seed, epoch and unit: neither partitions nor lost executors change a result by more than
the rounding of sums.

Two kinds of network, both with a last layer of zeros, so that an untrained network predicts the baseline: `dense` (scalars
and coefficients to two layers with normalisation) and `curve` (two convolutions over the curve's points, their means and
largest values beside the scalars).

Defined cases: rows without key, id or split, or whose arrays are null, of another length or hold what is not finite, take
no part; a key without rows in train or in dev has no network; an empty table gives an empty result. Rows of equal id share
a minibatch and what is dropped out. Equal largest points share their gradient.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import store
from .network import IMPROVES, PATIENCE

#: Points of a convolution's kernel, its channels, the longest gradient.
KERNEL, CHANNELS, CLIP = 5, 16, 1.0
#: Numbers that the driver holds, at most; rows that a task works on at once; rows of a file.
MOST_NUMBERS, SLICE, FILE_ROWS = 20_000_000, 512, 65_536

_erf = np.vectorize(math.erf, otypes=[float])


# -- layers: a value, and a function from its gradient to those of the inputs --------------------------------------


def _linear(x, w, b):
    return x @ w + b, lambda g: (g @ w.T, x.T @ g, g.sum(0))


def _normed(x, scale, shift):
    inv = 1 / np.sqrt(x.var(1, keepdims=True) + 1e-5)
    z = (x - x.mean(1, keepdims=True)) * inv

    def back(g):
        gz = g * scale
        return inv * (gz - gz.mean(1, keepdims=True) - z * (gz * z).mean(1, keepdims=True)), (g * z).sum(0), g.sum(0)

    return z * scale + shift, back


def _gelu(x):
    cdf = 0.5 * (1 + _erf(x / math.sqrt(2)))
    return x * cdf, lambda g: g * (cdf + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi))


def _windows(x):
    half = KERNEL // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (half, half))), KERNEL, axis=2)


def _convolved(x, w, b):
    """x (rows, channels, points) with w (out, channels, KERNEL); as many points as before."""
    wide = _windows(x)

    def back(g):
        return np.einsum("ndqj,dcj->ncq", _windows(g), w[:, :, ::-1], optimize=True), np.einsum("ndp,ncpk->dck", g, wide, optimize=True), g.sum((0, 2))

    return np.einsum("ncpk,dck->ndp", wide, w, optimize=True) + b[:, None], back


def _pooled(x):
    top = x.max(2, keepdims=True)
    at = x == top
    share, channels = at / at.sum(2, keepdims=True), x.shape[1]
    return np.concatenate([x.mean(2), top[:, :, 0]], 1), lambda g: g[:, :channels, None] / x.shape[2] + g[:, channels:, None] * share


def _uniform(marks: np.ndarray, salt: int, width: int) -> np.ndarray:
    """Numbers in [0, 1) from a mixed hash of marks, salt and column."""
    z = marks.astype(np.int64).view(np.uint64)[:, None] + (np.arange(width, dtype=np.uint64) * np.uint64(width + 1) + np.uint64(salt % 2**63))[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


@dataclass(frozen=True)
class Shape:
    """A kind of network with its sizes."""

    kind: str
    inputs: int
    points: int
    outputs: int
    hidden: int = 64
    dropout: float = 0.1

    def parts(self) -> list[tuple[int, ...]]:
        h, end = self.hidden, [(self.hidden, self.outputs), (self.outputs,)]
        if self.kind == "dense":
            return [(self.inputs + self.points, h), (h,), (h,), (h,), (h, h), (h,), (h,), (h,), *end]
        if self.kind == "curve":
            return [(CHANNELS, 1, KERNEL), (CHANNELS,), (CHANNELS, CHANNELS, KERNEL), (CHANNELS,), (2 * CHANNELS + self.inputs, h), (h,), *end]
        raise ValueError(f"unknown kind of network {self.kind!r}: dense or curve")

    def parameters(self) -> int:
        return sum(math.prod(p) for p in self.parts())

    def split(self, theta: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([math.prod(p) for p in self.parts()])
        return [x.reshape(p) for x, p in zip(np.split(np.asarray(theta, float), ends[:-1]), self.parts(), strict=True)]

    def start(self, seed: int) -> np.ndarray:
        """Weights and biases uniform within 1 / sqrt(inputs of a unit), norms of one, a last layer of zeros."""
        rng, out, shapes, wide = np.random.default_rng(seed), [], self.parts(), 1
        norms = {2, 6} if self.kind == "dense" else set()
        for i, p in enumerate(shapes):
            if i >= len(shapes) - 2 or i - 1 in norms:
                out.append(np.zeros(p))
            elif i in norms:
                out.append(np.ones(p))
            else:
                wide = wide if len(p) == 1 else math.prod(p[1:]) if len(p) == 3 else p[0]
                out.append(rng.uniform(-1, 1, p) / math.sqrt(wide))
        return np.concatenate([p.ravel() for p in out])

    def run(self, theta: np.ndarray, x: np.ndarray, c: np.ndarray, marks: np.ndarray | None = None, salt: int = 0):
        """Outputs, and a function from their gradient to that of theta. With marks, units are dropped out."""
        p, layer = self.split(theta), 0

        def dropped(z):
            nonlocal layer
            layer += 1
            if marks is None or not self.dropout:
                return z, lambda g: g
            keep = (_uniform(marks, salt * 4 + layer, z.shape[1]) >= self.dropout) / (1 - self.dropout)
            return z * keep, lambda g: g * keep

        if self.kind == "dense":
            tape, z = [], np.concatenate([x, c], 1)
            for k in (0, 4):
                z, lin = _linear(z, p[k], p[k + 1])
                z, norm = _normed(z, p[k + 2], p[k + 3])
                z, bend = _gelu(z)
                z, drop = dropped(z)
                tape.append((lin, norm, bend, drop))
            z, last = _linear(z, p[8], p[9])

            def back(g):
                g, *found = last(g)
                for lin, norm, bend, drop in reversed(tape):
                    g, scale, shift = norm(bend(drop(g)))
                    g, w, b = lin(g)
                    found = [w, b, scale, shift, *found]
                return np.concatenate([f.ravel() for f in found])
        else:
            z, conv1 = _convolved(c[:, None, :], p[0], p[1])
            z, bend1 = _gelu(z)
            z, conv2 = _convolved(z, p[2], p[3])
            z, bend2 = _gelu(z)
            z, pool = _pooled(z)
            z, lin = _linear(np.concatenate([z, x], 1), p[4], p[5])
            z, bend3 = _gelu(z)
            z, drop = dropped(z)
            z, last = _linear(z, p[6], p[7])

            def back(g):
                g, wl, bl = last(g)
                g, w, b = lin(bend3(drop(g)))
                g, w2, b2 = conv2(bend2(pool(g[:, : 2 * CHANNELS])))
                _, w1, b1 = conv1(bend1(g))
                return np.concatenate([f.ravel() for f in (w1, b1, w2, b2, w, b, wl, bl)])

        return z, back

    def loss(self, theta, x, c, y, weights, marks=None, salt: int = 0, gradient: bool = True):
        """The sum of the rows' weighted smooth L1 losses (a square below 1, a line beyond), and its gradient."""
        total, slope = 0.0, np.zeros(self.parameters() if gradient else 0)
        for a in range(0, len(y), SLICE):
            part = slice(a, a + SLICE)
            out, back = self.run(theta, x[part], c[part], None if marks is None else marks[part], salt)
            e = out - y[part]
            far = np.abs(e)
            total += float((np.where(far < 1, e * e / 2, far - 0.5) * weights).sum())
            if gradient:
                slope += back(np.clip(e, -1, 1) * weights)
        return total, slope


# -- sums over partitions ---------------------------------------------------------------------------------------


def usable(rows: DataFrame, shape: Shape, by: str, ident: list[str], scalars: str, curve: str, targets: str, split: str) -> DataFrame:
    """(k, s, mark, x, c, y): rows that take part."""
    numbers = lambda c: F.col(c).cast("array<double>")
    fine = lambda c, n: (F.size(c) == n) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    known = rows.where(" and ".join(f"`{c}` is not null" for c in [by, split, *ident]))
    out = known.select(F.col(by).cast("string").alias("k"), F.col(split).alias("s"), F.xxhash64(*ident).alias("mark"), numbers(scalars).alias("x"), numbers(curve).alias("c"), numbers(targets).alias("y"))
    return out.where(fine("x", shape.inputs) & fine("c", shape.points) & fine("y", shape.outputs))


def sums(rows: DataFrame, shape: Shape, thetas: dict[tuple[str, int], np.ndarray], weights: list[float] | None = None, epoch: int = 0, gradient: bool = True, drop: bool = True) -> DataFrame:
    """(k, seed, n, loss, gradient) of usable rows for the networks of `thetas`, by (key, seed): sums, not means."""
    w = np.ones(shape.outputs) if weights is None else np.asarray(weights, float)
    nets: dict[str, list[tuple[int, np.ndarray]]] = {}
    for (k, seed), theta in thetas.items():
        nets.setdefault(k, []).append((seed, theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for batch in batches:
            keys, marks = np.asarray(batch.column("k").to_pylist()), batch.column("mark").to_numpy(zero_copy_only=False)
            x, c, y = (batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size) for name, size in (("x", shape.inputs), ("c", shape.points), ("y", shape.outputs)))
            for k in np.unique(keys).tolist():
                own = keys == k
                for seed, theta in nets.get(k, ()):
                    loss, slope = shape.loss(theta, x[own], c[own], y[own], w, marks[own] if drop else None, seed * 1_000_003 + epoch, gradient)
                    at = found.setdefault((k, seed), [0, 0.0, np.zeros(len(slope))])
                    at[0] += int(own.sum())
                    at[1] += loss
                    at[2] += slope
        for (k, seed), (n, loss, slope) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([seed], pa.int64()), pa.array([n], pa.int64()), pa.array([loss]), pa.array([slope.tolist()], pa.list_(pa.float64()))], ["k", "seed", "n", "loss", "gradient"])

    made = rows.select("k", "mark", "x", "c", "y").mapInArrow(run, "k string, seed long, n long, loss double, gradient array<double>")
    totals = [F.sum("n").alias("n"), F.sum("loss").alias("loss")]
    if not gradient:
        return made.groupBy("k", "seed").agg(*totals)
    out = made.groupBy("k", "seed").agg(*totals, Summarizer.sum(array_to_vector("gradient")).alias("gradient"))
    return out.withColumn("gradient", vector_to_array("gradient"))


class AdamW:
    """Adam with a decay that the gradient's scale doesn't touch, after the gradient is cut to a length of CLIP."""

    def __init__(self, size: int, rate: float, decay: float):
        self.rate, self.decay, self.k, self.m, self.s = rate, decay, 0, np.zeros(size), np.zeros(size)

    def step(self, theta: np.ndarray, g: np.ndarray) -> np.ndarray:
        g, self.k = g * min(1.0, CLIP / (float(np.sqrt((g * g).sum())) + 1e-6)), self.k + 1
        self.m, self.s = 0.9 * self.m + 0.1 * g, 0.999 * self.s + 0.001 * g * g
        return theta * (1 - self.rate * self.decay) - self.rate * (self.m / (1 - 0.9**self.k)) / (np.sqrt(self.s / (1 - 0.999**self.k)) + 1e-8)


def train(rows: DataFrame, shape: Shape, by: str, ident: list[str], scalars: str, curve: str, targets: str, seeds: list[int], split: str = "split", weights: list[float] | None = None, batch: int = 256, epochs: int = 400, patience: int = PATIENCE, rate: float = 1e-3, decay: float = 1e-2, file_rows: int = FILE_ROWS) -> DataFrame:
    """(by, seed, theta, best_loss, best_epoch, epochs, losses): for each key and seed the parameters of the epoch with the
    least development loss, and the development losses of all its epochs. A network stops when its loss has not improved
    for `patience` epochs."""
    spark = rows.sparkSession
    out = f"`{by}` string, seed long, theta array<double>, best_loss double, best_epoch int, epochs int, losses array<double>"
    base = usable(rows, shape, by, ident, scalars, curve, targets, split).where(F.col("s").isin("train", "dev"))
    counts = base.groupBy("k").agg(F.count_if(F.col("s") == "train").alias("train"), F.count_if(F.col("s") == "dev").alias("dev")).where("train > 0 and dev > 0")
    most = MOST_NUMBERS // max(1, 4 * len(seeds) * shape.parameters())
    found = counts.orderBy("k").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} keys: {len(seeds)} networks of {shape.parameters()} numbers for each don't fit on the driver")
    if not found:
        return spark.createDataFrame([], out)
    parts = {r.k: -(-r.train // batch) for r in found}
    # large minibatches are cut into files; a key's rows are dealt to all of them, so no task holds a key
    many = counts.select("k", F.ceil(F.col("train") / batch).alias("_parts"))
    dealt = base.join(F.broadcast(many), "k").withColumn("part", F.when(F.col("s") == "train", F.pmod("mark", "_parts")).otherwise(-1)).drop("_parts")
    spread = F.pmod(F.xxhash64("mark"), F.when(F.col("s") == "train", F.lit(max(1, -(-batch // file_rows)))).otherwise(F.lit(max(1, -(-max(r.dev for r in found) // file_rows)))))
    kept, path = store.materialize(dealt.repartition("k", "part", spread).sortWithinPartitions("part", "k"), "training")
    try:
        dev = kept.where("part = -1")
        theta = {(k, seed): shape.start(seed) for k in parts for seed in seeds}
        adam = {at: AdamW(shape.parameters(), rate, decay) for at in theta}
        best = {at: (math.inf, 0, t) for at, t in theta.items()}
        losses: dict[tuple[str, int], list[float]] = {at: [] for at in theta}
        live = set(theta)
        for epoch in range(1, epochs + 1):
            order = {k: np.random.default_rng([seeds[0], epoch]).permutation(n).tolist() for k, n in parts.items() if any(at[0] == k for at in live)}
            for step in range(max(map(len, order.values()))):
                asked: dict[int, list[str]] = {}
                for k, turn in order.items():
                    if step < len(turn):
                        asked.setdefault(turn[step], []).append(k)
                wanted = F.lit(False)
                for part, ks in asked.items():
                    wanted = wanted | ((F.col("part") == part) & F.col("k").isin(ks))
                now = {at: theta[at] for at in live if any(at[0] in ks for ks in asked.values())}
                for r in sums(kept.where(wanted), shape, now, weights, epoch).collect():
                    at = (r.k, r.seed)
                    theta[at] = adam[at].step(theta[at], np.asarray(r.gradient) / (r.n * shape.outputs))
            for r in sums(dev, shape, {at: theta[at] for at in live}, weights, gradient=False, drop=False).collect():
                at, loss = (r.k, r.seed), r.loss / (r.n * shape.outputs)
                losses[at].append(loss)
                if loss < best[at][0] - IMPROVES:
                    best[at] = (loss, epoch, theta[at])
                elif epoch - best[at][1] >= patience:
                    live.discard(at)
            if not live:
                break
    finally:
        store.release(spark, path)
    return spark.createDataFrame([(k, seed, best[k, seed][2].tolist(), best[k, seed][0], best[k, seed][1], len(losses[k, seed]), losses[k, seed]) for k, seed in sorted(theta)], out)


def predicted(shape: Shape, thetas: list[np.ndarray], scalars: str | Column, curve: str | Column, baseline: str | Column, sd: list[float]) -> Column:
    """The baseline plus the mean of the networks' outputs, each output in units of its train SD; NULL for rows without a
    whole input."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, c, b in batches:
            out = pd.Series([None] * len(b), dtype=object)
            whole = lambda v, n: v is not None and len(v) == n and bool(np.isfinite(np.asarray(v, float)).all())
            fine = [i for i in range(len(b)) if whole(x.iloc[i], shape.inputs) and whole(c.iloc[i], shape.points) and b.iloc[i] is not None]
            for a in range(0, len(fine), SLICE):
                part = fine[a : a + SLICE]
                xs, cs = (np.stack([np.asarray(v.iloc[i], float) for i in part]) for v in (x, c))
                made = np.mean([shape.run(np.asarray(t), xs, cs)[0] for t in thetas], axis=0) * np.asarray(sd)
                for i, row in zip(part, made, strict=True):
                    out.iloc[i] = (row + np.asarray(b.iloc[i], float)).tolist()
            yield out

    return run(scalars, curve, baseline)
