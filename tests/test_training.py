"""Networks trained in steps: gradients against finite differences, sums over partitions, training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import training

SCHEMA = "id long, k string, split string, x array<double>, c array<double>, y array<double>"


def data(n: int, seed: int = 1, outputs: int = 2):
    rng = np.random.default_rng(seed)
    x, c = rng.normal(size=(n, 3)), rng.normal(size=(n, 8))
    y = np.stack([x[:, 0] + 0.5 * c.max(1), np.tanh(c.mean(1) * 2)][:outputs], 1)
    return x, c, y


def frame(spark, n: int, keys=("a",)):
    x, c, y = data(n)
    return spark.createDataFrame([(i, keys[i % len(keys)], "dev" if i // len(keys) % 4 == 0 else "train", x[i].tolist(), c[i].tolist(), y[i].tolist()) for i in range(n)], SCHEMA)


@pytest.mark.parametrize(("kind", "inputs", "points", "expected"), [("dense", 8, 8, 6284), ("curve", 8, 64, 4796)])
def test_sizes_and_untrained(kind, inputs, points, expected):
    shape = training.Shape(kind, inputs, points, 12)
    assert shape.parameters() == expected == len(shape.start(0))
    rng = np.random.default_rng(0)
    assert not shape.run(shape.start(3), rng.normal(size=(7, inputs)), rng.normal(size=(7, points)))[0].any()
    with pytest.raises(ValueError, match="unknown kind"):
        training.Shape("other", 1, 1, 1).parts()


@pytest.mark.parametrize("kind", ["dense", "curve"])
@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradients_are_finite_differences(kind, dropout):
    shape = training.Shape(kind, 3, 8, 2, hidden=5, dropout=dropout)
    x, c, y = data(9)
    y[0] += 5  # the line beyond 1
    rng, weights, marks = np.random.default_rng(2), np.array([1.0, 0.3]), np.arange(9) * 7919
    theta = shape.start(1) + rng.normal(size=shape.parameters()) * 0.2
    _, slope = shape.loss(theta, x, c, y, weights, marks, 5)
    for i in range(shape.parameters()):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        up, down = (shape.loss(theta + s * step, x, c, y, weights, marks, 5, gradient=False)[0] for s in (1, -1))
        assert slope[i] == pytest.approx((up - down) / 2e-6, abs=2e-6, rel=1e-5)


def test_dropout_is_fair():
    u = training._uniform(np.arange(-5000, 5000) * 31, 77, 64)
    assert 0 <= u.min() and u.max() < 1 and abs((u < 0.1).mean() - 0.1) < 0.002
    assert abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(u[:-1, 3], u[1:, 3])[0, 1]) < 0.05
    assert (training._uniform(np.arange(9), 1, 4) != training._uniform(np.arange(9), 2, 4)).all()


def test_partitions_change_nothing(spark):
    shape = training.Shape("curve", 3, 8, 2, hidden=6)
    rows = frame(spark, 240, ("a", "b"))
    args = dict(by="k", ident=["id"], scalars="x", curve="c", targets="y", seeds=[1, 2], weights=[1.0, 0.3], batch=60, epochs=2, rate=0.01)
    one = {(r.k, r.seed): r for r in training.train(rows.coalesce(1), shape, **args).collect()}
    eight = {(r.k, r.seed): r for r in training.train(rows.repartition(8), shape, file_rows=9, **args).collect()}
    assert set(one) == {(k, s) for k in "ab" for s in (1, 2)} == set(eight)
    for at, r in one.items():
        assert r.losses == pytest.approx(eight[at].losses, rel=1e-9) and np.allclose(r.theta, eight[at].theta, atol=1e-8)
    assert one["a", 1].losses != one["a", 2].losses


def test_sums_are_those_of_all_rows(spark):
    shape = training.Shape("dense", 3, 8, 2, hidden=6)
    rows = frame(spark, 700)
    use = training.usable(rows.repartition(5), shape, "k", ["id"], "x", "c", "y", "split")
    theta = shape.start(4) + 0.1
    got = training.sums(use, shape, {("a", 4): theta, ("none", 4): theta}, [1.0, 0.3], drop=False).collect()
    x, c, y = data(700)
    loss, slope = shape.loss(theta, x, c, y, np.array([1.0, 0.3]))
    assert len(got) == 1 and got[0].n == 700 and got[0].loss == pytest.approx(loss) and np.allclose(got[0].gradient, slope)


@pytest.mark.parametrize("kind", ["dense", "curve"])
def test_learns_and_predicts(spark, kind):
    shape = training.Shape(kind, 3, 8, 2, hidden=16, dropout=0.0)
    rows = frame(spark, 400)
    made = training.train(rows, shape, "k", ["id"], "x", "c", "y", [1], batch=150, epochs=12, rate=0.05).first()
    assert made.best_loss == min(made.losses) < 0.35 * made.losses[0] and made.losses.index(made.best_loss) == made.best_epoch - 1
    some = rows.limit(20).withColumn("b", F.array(F.lit(1.0), F.lit(2.0))).unionByName(spark.createDataFrame([(-1, "a", "dev", None, [1.0] * 8, None, [0.0, 0.0])], SCHEMA + ", b array<double>"))
    got = some.select("id", "y", training.predicted(shape, [np.array(made.theta)], "x", "c", "b", [1.0, 1.0]).alias("p")).collect()
    assert next(r.p for r in got if r.id == -1) is None
    assert np.mean([abs(np.array(r.p) - [1, 2] - r.y).mean() for r in got if r.id >= 0]) < 0.5


def test_odd_rows(spark):
    shape = training.Shape("dense", 3, 8, 2, hidden=4)
    rows = frame(spark, 40)
    bad = spark.createDataFrame([(None, "a", "train", [1.0] * 3, [1.0] * 8, [0.0] * 2), (900, None, "train", [1.0] * 3, [1.0] * 8, [0.0] * 2), (901, "a", None, [1.0] * 3, [1.0] * 8, [0.0] * 2), (902, "a", "train", [1.0, None, 1.0], [1.0] * 8, [0.0] * 2), (903, "a", "train", [1.0] * 3, [1.0] * 7, [0.0] * 2), (904, "a", "dev", [1.0] * 3, [1.0] * 8, [0.0, float("nan")]), (905, "lone", "train", [1.0] * 3, [1.0] * 8, [0.0] * 2)], SCHEMA)
    args = dict(by="k", ident=["id"], scalars="x", curve="c", targets="y", seeds=[1], batch=16, epochs=1)
    plain, odd = (training.train(r.withColumn("part", F.lit("clash")).withColumn("mark", F.lit("clash")), shape, **args).collect() for r in (rows, rows.unionByName(bad)))
    assert len(plain) == len(odd) == 1 and plain[0].losses == pytest.approx(odd[0].losses) and np.allclose(plain[0].theta, odd[0].theta)
    assert training.train(rows.limit(0), shape, **args).count() == 0
