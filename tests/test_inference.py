"""Quantiles, resampled clusters, signed ranks and tables of numbers against brute force."""

import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import inference, quantiles, summary

# -- quantiles ---------------------------------------------------------------

PS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize(("small", "bins"), [(10_000, 1024), (5, 4), (1, 2)])
def test_quantiles_against_numpy(spark, small, bins):
    """Ties, signs, very large and very small values, groups of one, equal values only; nodes of all kinds."""
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(size=500), "ties": rng.integers(0, 4, 300).astype(float), "one": np.array([3.5]), "equal": np.full(200, -2.0), "tails": 10.0 ** rng.integers(-4, 5, 60) * rng.choice([-1, 1], 60), "edge": np.array([-1.7e308, 1.7e308, 0.0, 1.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(None, 1.0), (None, 2.0), ("none", None), ("nan", math.nan), ("inf", math.inf), ("inf", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "v", PS, small, bins).collect()}
    assert set(got) == {*groups, None, "none", "nan", "inf"}
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        if k != "edge":
            assert got[k].quantiles == pytest.approx(np.quantile(vs, PS).tolist(), rel=1e-12, abs=1e-12)
    assert got["edge"].quantiles[0] == -1.7e308 and got["edge"].quantiles[3] == 0.5 and got["edge"].quantiles[-1] == 1.7e308
    assert got[None].quantiles[3] == 1.5 and got["inf"].quantiles == [4.0] * len(PS)
    assert (got["none"].n, got["none"].quantiles, got["nan"].n) == (0, None, 0)


def test_quantiles_without_keys(spark):
    df = spark.range(30_001).select((F.col("id") * 2.0).alias("v"))
    got = quantiles.exact_quantiles(df, [], "v", [0.5, 0.25]).collect()
    assert [(r.n, r.quantiles) for r in got] == [(30_001, [30_000.0, 15_000.0])]
    assert quantiles.exact_quantiles(df.limit(0), ["v"], "v", [0.5]).count() == 0


# -- bootstrap ---------------------------------------------------------------


def numpy_interval(n, e, b, draws=2000, seed=3):
    rng = np.random.default_rng(seed)
    pick = np.stack([rng.integers(0, len(n), len(n)) for _ in range(draws)])
    d = (e[pick].sum(1) - b[pick].sum(1)) / n[pick].sum(1)
    return np.percentile(d, [2.5, 97.5]), d.std()


def test_every_draw_picks_as_many_clusters(spark):
    sizes = {"few": 14, "one": 1, "many": 2500}
    rows = [(k, f"c{i}", 1.0, float(i)) for k, n in sizes.items() for i in range(n)]
    per = spark.createDataFrame(rows, "k string, c string, n double, e double")
    got = inference.resample(per, ["k"], "c", ["n", "e"], draws=300).collect()
    assert len(got) == 900 and all(r.n == sizes[r.k] for r in got) and all(r.e == 0 for r in got if r.k == "one")
    many = [r.e / r.n for r in got if r.k == "many"]  # mean 1249.5, SD of a mean of 2500 picks 14.4
    assert abs(statistics.mean(many) - 1249.5) < 4 and 12.5 < statistics.stdev(many) < 16.5
    again = inference.resample(per.repartition(7), ["k"], "c", ["n", "e"], draws=300).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    other = inference.resample(per, ["k"], "c", ["n", "e"], draws=300, seed=5).collect()
    assert sorted(map(tuple, got)) != sorted(map(tuple, other))


def test_intervals_are_those_of_numpy(spark):
    """Both are 2000 draws of one distribution: their ends differ by a few standard errors of a percentile, under 0.3 SD."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k, c in (("a", 14), ("b", 40), ("c", 700)):
        n, e, b = rng.integers(5, 60, c).astype(float), rng.normal(30, 9, c), rng.normal(33, 9, c)
        e, b = e * n, b * n
        want[k] = numpy_interval(n, e, b)
        rows += [(k, str(i), *map(float, x)) for i, x in enumerate(zip(n, e, b, strict=True))]
    per = spark.createDataFrame(rows, "k string, c string, n double, e double, b double")
    got = {r.k: r for r in inference.percentile_interval(inference.resample(per, ["k"], "c", ["n", "e", "b"]), ["k"], "n", "e", "b").collect()}
    for k, ((low, high), sd) in want.items():
        assert abs(got[k].ci_low - low) < 0.3 * sd and abs(got[k].ci_high - high) < 0.3 * sd
        assert got[k].excludes_zero == (low > 0 or high < 0)


def test_tree_of_picks():
    sizes = [3, 0, 5, 1, 7]
    picks = [inference.node_picks(sizes, i, np.full(4000, 16), [1, 2]) for i in range(5)]
    assert (sum(picks) == 16).all() and not picks[1].any()
    assert [round(float(p.mean()), 0) for p in picks] == [3, 0, 5, 1, 7]


# -- signed ranks ------------------------------------------------------------


def brute_p(d):
    """Over all sign patterns of the ranks."""
    size = [abs(x) for x in d]
    ranks = [sorted(size).index(s) + 1 for s in size]
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    stat = min(plus, sum(ranks) - plus)
    below = sum(sum(p) <= stat for p in itertools.product(*[(0, r) for r in ranks]))
    return stat, min(1.0, 2 * below / 2 ** len(d))


def normal_p(d):
    d = [x for x in d if x]
    n, size = len(d), sorted(abs(x) for x in d)
    rank = {s: (2 * size.index(s) + size.count(s) + 1) / 2 for s in size}
    plus = sum(rank[abs(x)] for x in d if x > 0)
    ties = sum(size.count(s) ** 3 - size.count(s) for s in set(size))
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return min(plus, n * (n + 1) / 2 - plus), math.erfc(abs(plus - n * (n + 1) / 4) / sd / math.sqrt(2))


def test_signed_ranks_against_all_patterns(spark):
    rng = np.random.default_rng(4)
    keys = {f"e{n}-{i}": rng.normal(0.3 * i, 1, n).tolist() for n in range(1, 13) for i in range(3)}
    large = {"n60": rng.normal(0.2, 1, 60).tolist(), "tied": rng.integers(-3, 5, 40).astype(float).tolist(), "zero": [0.0, 1.0, 2.5, -3.0], "wide": (10.0 ** rng.uniform(-8, 8, 200) * rng.choice([-1, 1], 200)).tolist(), "far": rng.normal(4, 1, 90).tolist()}
    rows = [(k, v) for k, vs in (keys | large).items() for v in vs] + [("none", 0.0), ("none", 0.0), ("e5-0", None), ("e5-0", math.nan), (None, 1.0), (None, -2.0)]
    got = {r.k: r for r in inference.signed_ranks(spark.createDataFrame(rows, "k string, d double").repartition(5), ["k"], "d").collect()}
    assert set(got) == {*keys, *large, "none", None}
    for k, d in keys.items():
        assert (got[k].statistic, got[k].p) == (brute_p(d)[0], pytest.approx(brute_p(d)[1], abs=1e-15)) and got[k].n == len(d)
    for k, d in large.items():
        stat, p = normal_p(d)
        assert got[k].statistic == stat and got[k].p == pytest.approx(min(1.0, p), rel=1e-9, abs=1e-300)
    assert (got["none"].n, got["none"].n_nonzero, got["none"].statistic, got["none"].p) == (2, 0, None, None)
    assert (got[None].statistic, got[None].p) == (1.0, 1.0)
    flat = inference.signed_ranks(spark.createDataFrame([(float(x),) for x in (1, -2, 3, -4, 5, -6, 7)], "d double"), [], "d").first()
    assert flat.p == pytest.approx(0.8125)


def test_exact_null_up_to_50(spark):
    got = {r.n: r.ways for r in inference.null_table(spark).collect()}
    assert set(got) == set(range(1, 51)) and all(w[-1] == 2.0**n and len(w) == n * (n + 1) // 2 + 1 for n, w in got.items())
    assert got[3] == [1, 2, 3, 5, 6, 7, 8]


def test_erfc(spark):
    xs = [0.0, 1e-9, 0.3, 1.0, 1.999, 2.0, 2.5, 5.0, 9.0, 26.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(inference.erfc(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(x) for x in xs], rel=1e-11)


def test_inference_by_key(spark):
    rows = [(k, f"s{i % 8}" if i % 8 else None, 1.0 + i % 8 / 10, 2.0 + i % 8 / 9 * (k == "a")) for k in "ab" for i in range(80)]
    rows += [("few", f"s{i}", 1.0, 2.0) for i in range(5)] + [("same", f"s{i}", 1.0, 1.0) for i in range(9)] + [("a", "s1", None, 9.0)]
    got = {r.k: r for r in inference.cluster_inference(spark.createDataFrame(rows, "k string, c string, e double, b double"), ["k"], "c", "e", "b").collect()}
    assert got["a"].n_clusters == 8 and got["a"].p == pytest.approx(2 / 2**8) and got["a"].ci_high < 0 and got["a"].excludes_zero
    assert (got["few"].n_clusters, got["few"].p, got["few"].ci_low, got["few"].excludes_zero) == (5, None, -1.0, True)
    assert (got["same"].p, got["same"].ci_low, got["same"].excludes_zero) == (None, 0.0, False)


# -- tables of numbers -------------------------------------------------------


def test_human_numbers(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        en, es = float(rng.uniform(1, 5)), float(rng.uniform(1, 5))
        rows.append((f"p{i}", f"s{i % 7}", float(rng.normal(10, 3)), float(rng.normal(11, 3)), float(rng.uniform(2, 4)), float(rng.uniform(2, 4)), en, es, 150.0 if i else 20.0, 160.0, 0.6, 0.6, 3.0, 3.5, None, True))
    names = "pair_id string, en_speaker string, en_f0_mean_st double, es_f0_mean_st double, en_f0_std_st double, es_f0_std_st double, en_duration double, es_duration double, en_f0_mean_hz double, es_f0_mean_hz double, en_voiced_ratio double, es_voiced_ratio double, en_speaking_rate double, es_speaking_rate double, error string, same_speaker_pair boolean"
    got = {r.name: r.value for r in summary.human_numbers(spark.createDataFrame(rows, names)).collect()}
    kept = rows[1:]  # the first one's pitch is no voice's
    ratio = [r[7] / r[6] for r in kept]
    assert got["gate_rows_kept"] == 59 and got["n_speakers"] == 7 and got["es_over_en_duration_n"] == 59
    assert got["es_over_en_duration_median"] == pytest.approx(statistics.median(ratio)) and got["es_over_en_duration_sd"] == pytest.approx(statistics.stdev(ratio))
    x, y = np.array([r[2] for r in kept]), np.array([r[3] for r in kept])
    g = np.array([r[1] for r in kept])
    xc, yc = (v - np.array([v[g == k].mean() for k in g]) for v in (x, y))
    assert got["f0_mean_pooled_r"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got["f0_mean_within_r"] == pytest.approx(np.corrcoef(xc, yc)[0, 1])
    assert got["f0_mean_between_share"] == pytest.approx(1 - (xc**2).sum() / ((x - x.mean()) ** 2).sum())
    assert got["speaking_rate_pooled_r"] is None and len(got) == 13 + 24 + 4 + 1 and not any(math.isnan(v) for v in got.values() if v is not None)


def test_reconstruction_stats(spark):
    rng = np.random.default_rng(6)
    shapes = [np.cumsum(rng.normal(size=64)).tolist() for _ in range(21)]
    df = spark.createDataFrame([(s,) for s in [*shapes, [1.0] * 64, None, [math.nan] * 64, [1.0, 2.0]]], "shape array<double>")
    got = summary.reconstruction_stats(df, "shape").first()
    k, i = np.arange(1, 9)[:, None], np.arange(64)[None, :]
    m = math.sqrt(2 / 64) * np.cos(math.pi * (2 * i + 1) * k / 128)
    a = np.array(shapes)
    back = a @ m.T @ m
    r = [np.corrcoef(x, b)[0, 1] for x, b in zip(a, back, strict=True)]
    rmse = np.sqrt(((a - back) ** 2).mean(1))
    assert got.contours == 21 and got.r_mean == pytest.approx(np.mean(r))
    assert (got.r_median, got.r_p10, got.rmse_median) == pytest.approx((np.median(r), np.percentile(r, 10), np.median(rmse)))


def test_job_similarity(spark):
    rows = [("a", 3, 0.9), ("a", 1, 0.5), ("a", 7, None), ("b", 0, 0.4), ("c", 2, None), (None, 1, 0.25)]
    got = {r.job: r.similarity for r in summary.job_similarity(spark.createDataFrame(rows, "job string, voiced long, similarity double"), ["job"]).collect()}
    assert got == {"a": pytest.approx(0.8), "b": None, "c": None, None: 0.25}
