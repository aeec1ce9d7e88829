"""Inference over clusters for all keys at once: bootstrap intervals and signed ranks. Nothing goes through the driver.

A bootstrap draw picks as many clusters as a key has, with repeats: a multinomial over its clusters. Clusters are dealt to buckets
by hash, and a draw's picks go down a tree of binomials, from all clusters to one bucket: each node's split is drawn from the
node's own seed, so every task that asks for it gets the same answer and no draw is ever stored. A bucket's clusters
then share its picks, and what is sent are a bucket's sums for each draw.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import finite, let
from ..sources.store import materialize
from .hot import join_sums

#: Clusters of a bucket and buckets of a group, about; draws that one row computes.
BUCKET, GROUP, BLOCK = 256, 512, 250
#: Clusters that a test needs, and the least difference that counts.
LEAST_CLUSTERS, LEAST_DIFFERENCE = 6, 1e-12
#: Values up to which the signed-rank test is exact.
EXACT = 50


# -- bootstrap ---------------------------------------------------------------


def node_picks(sizes: list[int], at: int, picks: np.ndarray, seed: list[int]) -> np.ndarray:
    """Of each draw's picks from all members of the parts, how many fall to part `at`."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    low, high = 0, len(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(picks, (upto[mid] - upto[low]) / (upto[high] - upto[low]))
        picks, low, high = (left, low, mid) if at < mid else (picks - left, mid, high)
    return picks


def bucket_sums(values: np.ndarray, groups: list[int], group: int, buckets: list[int], bucket: int, seed: int, block: int, draws: int) -> np.ndarray:
    """Sums of each column of a bucket's clusters (rows of values) over `draws` draws."""
    base = [seed & (1 << 64) - 1, block]
    picks = node_picks(groups, group, np.full(draws, sum(groups)), [*base, 0])
    picks = node_picks(buckets, bucket, picks, [*base, 1, group])
    m = len(values)
    return np.random.default_rng([*base, 2, group, bucket]).multinomial(picks, np.full(m, 1 / m)) @ values


def resample(per: DataFrame, by: list[str], cluster: str, values: list[str], draws: int = 2000, seed: int = 498) -> DataFrame:
    """(by..., draw, values...): for each key and draw, the sums of values over as many clusters as the key has, drawn with
    repeats. per: one row for each key and cluster. The same whatever the partitions."""
    rows = per.select(F.struct(*by).alias("_k") if by else F.struct(F.lit(0).alias("all")).alias("_k"), F.col(cluster).cast("string").alias("_c"), F.array(*[F.col(v).cast("double") for v in values]).alias("_v"))
    rows, _ = materialize(rows, "clusters")
    sizes = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    n_buckets = F.ceil(F.col("_n") / BUCKET)
    dealt = join_sums(rows, sizes, "_k", "_n", rows.count()).withColumn("_b", F.pmod(F.xxhash64("_c"), n_buckets))
    buckets, _ = materialize(dealt.groupBy("_k", "_b").agg(F.sort_array(F.collect_list(F.struct("_c", "_v"))).alias("_m")), "buckets")
    group = F.floor(F.col("_b") / GROUP).alias("_g")
    inner = buckets.groupBy("_k", group).agg(F.sort_array(F.collect_list(F.struct("_b", F.size("_m").alias("n")))).alias("_in"), F.sum(F.size("_m")).alias("_gn"))
    outer = inner.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_g", F.col("_gn").alias("n")))).alias("_out"))
    met = buckets.withColumn("_g", group).join(inner.select("_k", "_g", "_in"), ["_k", "_g"]).join(outer, "_k")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // BLOCK) - 1))).alias("_block")
    key_seed = F.xxhash64(F.lit(seed).cast("long"), "_k") if by else F.lit(seed).cast("long")

    @F.pandas_udf(f"array<struct<{', '.join(f'v{i}:double' for i in range(len(values)))}>>")
    def sums(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        names = [f"v{i}" for i in range(len(values))]
        for series in frames:
            out = []
            for groups, g, inside, b, flat, s, block in zip(*series, strict=True):
                d = min(BLOCK, draws - block * BLOCK)
                got = bucket_sums(np.array(flat, float).reshape(-1, len(values)), [x["n"] for x in groups], [x["_g"] for x in groups].index(g), [x["n"] for x in inside], [x["_b"] for x in inside].index(b), int(s), int(block), d)
                out.append([dict(zip(names, x, strict=True)) for x in got.tolist()])
            yield pd.Series(out)

    flat = F.flatten(F.transform("_m", lambda x: x["_v"]))
    parts = met.select("_k", "_out", "_g", "_in", "_b", flat.alias("_flat"), key_seed.alias("_s"), blocks)
    long = parts.select("_k", "_block", F.posexplode(sums("_out", "_g", "_in", "_b", "_flat", "_s", "_block")).alias("_d", "_x"))
    total = long.groupBy("_k", (F.col("_block") * BLOCK + F.col("_d")).alias("draw")).agg(*[F.sum(F.col("_x")[f"v{i}"]).alias(v) for i, v in enumerate(values)])
    return total.select(*[F.col("_k")[c].alias(c) for c in by], "draw", *values)


def resample_given(per: DataFrame, picks: DataFrame, by: list[str], cluster: str, values: list[str]) -> DataFrame:
    """As `resample`, over given picks (by..., draw, cluster, times); picks of clusters that a key doesn't have count for
    nothing."""
    met = picks.join(per.select(*by, cluster, *values), [*by, cluster])
    return met.groupBy(*by, "draw").agg(*[F.sum(F.col("times") * F.col(v)).alias(v) for v in values])


def percentile_interval(sums: DataFrame, by: list[str], n: str, first: str, second: str, level: float = 0.95) -> DataFrame:
    """(by..., ci_low, ci_high, excludes_zero) of the mean difference first - second over draws. A key has one row a draw, so
    its percentiles keep as many values."""
    d = F.try_divide(F.col(first) - F.col(second), F.col(n))
    tail = (1 - level) / 2
    got = sums.groupBy(*by).agg(F.percentile(d, F.array(F.lit(tail), F.lit(1 - tail))).alias("_p"))
    low, high = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    return got.select(*by, low.alias("ci_low"), high.alias("ci_high"), ((low > 0) | (high < 0)).alias("excludes_zero"))


# -- signed ranks ------------------------------------------------------------


def _fold(steps: Column, start: Column, step) -> Column:
    return F.aggregate(steps, start, step)


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0: below 2 by the series of positive terms, from there by the continued
    fraction."""

    def both(x: Column) -> Column:
        # sum of 2^k x^(2k+1) / (1 3 5 ... (2k+1)), as (term, sum)
        state = F.struct(x.alias("t"), x.alias("s"))
        series = _fold(F.sequence(F.lit(1), F.lit(60)), state, lambda a, k: F.struct((a["t"] * 2 * x * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * x * x / (2 * k + 1)).alias("s")))["s"]
        tail = _fold(F.sequence(F.lit(120), F.lit(1)), x, lambda a, k: x + k / 2.0 / a)
        return F.when(x < 2, 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / tail)

    return let(x.cast("double"), both)


def null_table(spark, most: int = EXACT) -> DataFrame:
    """(n, ways): for n ranks up to `most`, in how many sign patterns the positive ranks sum up to 0, 1, 2, ... at most. A fold
    over ranks: with each, a sum is reached without it or with it. At most 2^50, so doubles are exact."""
    top = F.col("n") * (F.col("n") + 1) / 2

    def with_rank(ways: Column, r: Column) -> Column:
        return F.transform(ways, lambda w, s: w + F.when(s >= r, F.get(ways, (s - r).cast("int"))).otherwise(0.0))

    start = F.transform(F.sequence(F.lit(0).cast("long"), top.cast("long")), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    ways = _fold(F.sequence(F.lit(1), F.col("n").cast("int")), start, with_rank)
    upto = F.aggregate("ways", F.array().cast("array<double>"), lambda a, w: F.array_append(a, w + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0))))
    return spark.range(1, most + 1).toDF("n").withColumn("ways", ways).select("n", upto.alias("ways"))


def signed_ranks(rows: DataFrame, by: list[str], difference: str) -> DataFrame:
    """(by..., n, n_nonzero, statistic, p): Wilcoxon's two-sided signed-rank test for each key.

    Zeros are left out; equal sizes share their mean rank. Exact without ties and zeros up to 50 values, else the normal
    approximation with tie correction. Nulls, NaN and infinite values are left out; without a value other than zero, p is
    null.

    Ranks come in two steps, so that a large key isn't sorted in one task: sizes are dealt to narrow bands of their
    logarithm, bands are counted, and windows rank inside a band.
    """
    values = rows.select(*by, finite(F.col(difference)).alias("_d")).where(F.col("_d").isNotNull())
    band = F.when(F.col("_d") != 0, F.floor(F.log2(F.abs("_d")) * 64)).alias("_band")
    sizes, _ = materialize(values.groupBy(*by, band, F.abs("_d").alias("_a")).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("_d") > 0).alias("plus")), "sizes")
    nonzero = sizes.where("_a <> 0")
    w = W.partitionBy(*by).orderBy("_band")
    bands = nonzero.groupBy(*by, "_band").agg(F.sum("m").alias("_n")).withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    inside = W.partitionBy(*by, "_band").orderBy("_a")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_band")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    placed = nonzero.withColumn("_own", F.sum("m").over(inside) - F.col("m")).alias("r").join(bands.alias("b"), on).select("r.*", "b._before")
    # twice the mean rank is whole
    rank2 = (2 * (F.col("_before") + F.col("_own")) + F.col("m") + 1).cast("decimal(19,0)")
    m = F.col("m").cast("decimal(12,0)")
    ranked = placed.groupBy(*by).agg(F.sum("m").alias("n_nonzero"), F.sum(rank2 * F.col("plus")).alias("_plus2"), F.sum(m * m * m - m).alias("_ties"))
    every = sizes.groupBy(*by).agg(F.sum("m").alias("n"))
    joined = _same_key(every, ranked, by)
    n = F.coalesce(F.col("n_nonzero"), F.lit(0)).cast("double")
    all2 = n * (n + 1)
    plus2 = F.coalesce(F.col("_plus2").cast("double"), F.lit(0.0))
    stat = F.least(plus2, all2 - plus2) / 2
    out = joined.withColumns({"n_nonzero": n.cast("long"), "statistic": F.when(n > 0, stat), "_ties": F.coalesce(F.col("_ties").cast("double"), F.lit(0.0))})
    nulls = F.broadcast(null_table(rows.sparkSession).withColumnRenamed("n", "_m"))
    out = out.join(nulls, (F.col("_m") == F.col("n")) & (F.col("n_nonzero") == F.col("n")) & (F.col("_ties") == 0), "left")
    n = F.col("n_nonzero").cast("double")
    exact = F.least(F.lit(1.0), 2 * F.get("ways", F.col("statistic").cast("int")) / F.pow(F.lit(2.0), n))
    spread = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    normal = F.when(spread > 0, F.least(F.lit(1.0), erfc(F.abs(F.col("statistic") - n * (n + 1) / 4) / F.sqrt(spread) / math.sqrt(2))))
    return out.select(*by, "n", "n_nonzero", "statistic", F.when(n > 0, F.when(F.col("ways").isNotNull(), exact).otherwise(normal)).alias("p"))


def _same_key(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with right's other columns where the keys are the same, nulls included."""
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right.withColumnsRenamed({c: f"_r_{c}" for c in by}), on, "left").drop(*[f"_r_{c}" for c in by])


# -- both --------------------------------------------------------------------


def cluster_inference(rows: DataFrame, by: list[str], cluster: str, error: str, base_error: str, seed: int = 498, draws: int = 2000) -> DataFrame:
    """(by..., n_clusters, p, ci_low, ci_high, excludes_zero) of error against base_error.

    p: the signed-rank test over clusters' mean errors, null with fewer than six clusters or where none differ. The interval
    holds 95 % of the mean difference over resampled clusters. Rows without one of the errors are left out; a missing cluster
    counts as a blank one.
    """
    both = rows.where(F.col(error).isNotNull() & F.col(base_error).isNotNull())
    per, _ = materialize(both.groupBy(*by, F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("_cluster")).agg(F.count(F.lit(1)).alias("_n"), F.sum(error).cast("double").alias("_e"), F.sum(base_error).cast("double").alias("_b")), "clusters")
    means = per.withColumn("_diff", F.col("_e") / F.col("_n") - F.col("_b") / F.col("_n"))
    size = means.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n_clusters"), F.max(F.abs("_diff")).alias("_most"))
    tested = _same_key(size, signed_ranks(means, by, "_diff").select(*by, "p"), by)
    interval = percentile_interval(resample(per, by, "_cluster", ["_n", "_e", "_b"], draws, seed), by, "_n", "_e", "_b")
    out = _same_key(tested, interval, by)
    fine = (F.col("n_clusters") >= LEAST_CLUSTERS) & (F.col("_most") > LEAST_DIFFERENCE)
    return out.select(*by, "n_clusters", F.when(fine, F.col("p")).alias("p"), "ci_low", "ci_high", "excludes_zero")
