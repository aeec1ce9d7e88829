"""A small network for prosody targets: NumPy training on each (direction, seed) group, prediction in Arrow batches.

The output layer starts at zero, so an untrained network predicts the baseline; training stops when the development loss
has not improved for `patience` epochs and keeps the best weights; seeds are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least improvement that counts, and the epochs to wait for one.
IMPROVES, PATIENCE = 1e-7, 40


class Network:
    """One hidden layer with tanh."""

    def __init__(self, inputs: int, hidden: int, outputs: int, seed: int):
        rng = np.random.default_rng(seed)
        self.parts = [rng.normal(size=(inputs, hidden)) / np.sqrt(max(inputs, 1)), np.zeros(hidden), np.zeros((hidden, outputs)), np.zeros(outputs)]

    def parameters(self) -> int:
        return sum(p.size for p in self.parts)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.parts
        return np.tanh(x @ w + b) @ v + c

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, v, c = self.parts
        h = np.tanh(x @ w + b)
        e = 2 * (h @ v + c - y) / y.size
        back = (e @ v.T) * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ e, e.sum(0)]


def mean_loss(losses: list[tuple[float, int]]) -> float | None:
    """The mean over examples of batch losses, each weighted by its size."""
    n = sum(k for _, k in losses)
    return sum(v * k for v, k in losses) / n if n else None


def train(x: np.ndarray, y: np.ndarray, dev_x: np.ndarray, dev_y: np.ndarray, hidden: int = 16, seed: int = 0, epochs: int = 400, rate: float = 0.01, decay: float = 1e-4) -> tuple[Network, list[float]]:
    """Adam over whole batches; the network with the least development loss, and the losses."""
    net = Network(x.shape[1], hidden, y.shape[1], seed)
    m, s = [np.zeros_like(p) for p in net.parts], [np.zeros_like(p) for p in net.parts]
    best, kept, wait, losses = np.inf, [p.copy() for p in net.parts], 0, []
    for k in range(1, epochs + 1):
        for i, g in enumerate(net.gradients(x, y)):
            g = g + decay * net.parts[i]
            m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
            net.parts[i] = net.parts[i] - rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(s[i] / (1 - 0.999**k)) + 1e-8)
        losses.append(float(((net(dev_x) - dev_y) ** 2).mean()))
        if losses[-1] < best - IMPROVES:
            best, kept, wait = losses[-1], [p.copy() for p in net.parts], 0
        else:
            wait += 1
            if wait >= PATIENCE:
                break
    net.parts = kept
    return net, losses


def train_all(rows: DataFrame, by: str, features: str, targets: str, seeds: list[int], split: str = "split", **options) -> DataFrame:
    """(by, seed, weights, best_loss, epochs): one task for each key and seed. A key is one study, of thousands of rows."""
    source = rows.select(F.col(by).cast("string").alias("k"), F.col(split).alias("s"), F.col(features).cast("array<double>").alias("x"), F.col(targets).cast("array<double>").alias("y"))
    many = source.where(F.col("s").isin("train", "dev")).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {s: pdf[pdf["s"] == s] for s in ("train", "dev")}
        if part["train"].empty or part["dev"].empty:
            return pd.DataFrame({"k": [], "seed": [], "weights": [], "best_loss": [], "epochs": []})
        x, y, dx, dy = (np.stack([np.asarray(v, float) for v in part[s][c]]) for s in ("train", "dev") for c in ("x", "y"))
        net, losses = train(x, y, dx, dy, seed=int(pdf["seed"].iloc[0]), **options)
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "seed": [int(pdf["seed"].iloc[0])], "weights": [np.concatenate([p.ravel() for p in net.parts]).tolist()], "best_loss": [min(losses)], "epochs": [len(losses)]})

    return many.groupBy("k", "seed").applyInPandas(run, "k string, seed int, weights array<double>, best_loss double, epochs int").withColumnRenamed("k", by)


def overfits(x: np.ndarray, y: np.ndarray, examples: int = 8, seed: int = 0, epochs: int = 4_000, enough: float = 1e-3, **options) -> dict[str, object]:
    """Whether a network can learn the first few examples by heart, without decay: a network that can't is fed wrongly. The
    loss is in units of the targets' variance."""
    few, want = x[:examples], y[:examples]
    scale = max(float(want.var()), 1e-12)
    net, losses = train(few, want, few, want, seed=seed, epochs=epochs, decay=0.0, **options)
    loss = float(((net(few) - want) ** 2).mean()) / scale
    return {"examples": len(few), "epochs": len(losses), "loss": loss, "passed": loss < enough}


def restored(weights: list[float], inputs: int, outputs: int) -> Network:
    hidden = (len(weights) - outputs) // (inputs + 1 + outputs)
    net, at = Network(inputs, hidden, outputs, 0), 0
    for i, p in enumerate(net.parts):
        net.parts[i] = np.asarray(weights[at : at + p.size]).reshape(p.shape)
        at += p.size
    return net


def ensemble(features: str | Column, nets: list[Network], baseline: str | Column, sd: list[float]) -> Column:
    """The baseline plus the mean of the networks' outputs, each output in units of its train SD."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, b in batches:
            if not len(x):
                yield pd.Series([], dtype=object)
                continue
            out = np.mean([n(np.stack([np.asarray(v, float) for v in x])) for n in nets], axis=0) * np.asarray(sd)
            yield pd.Series((out + np.stack([np.asarray(v, float) for v in b])).tolist())

    return run(features, baseline)
