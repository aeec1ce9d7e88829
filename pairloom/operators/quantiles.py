"""Exact quantiles of groups of any size, by refined histograms of all groups together.

Spark's `percentile` and `median` keep every distinct value of a group. Here a step counts each group's values in bins
between its least and its largest value; the bins that hold a wanted rank become the nodes of the next step, with their
own least and largest value. A node of few rows is sorted, one of equal values is done. What a step sends is a bin table, and
the rows that go on are those inside of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import col, finite
from ..sources.store import materialize, release
from .hot import join_sums

#: Bins of a node, and the most rows of a node that are sorted together.
BINS, SMALL = 1024, 10_000


def _ranks(probabilities: list[float]) -> Column:
    """The places, from 0, of the values that the quantiles of n values stand between."""
    at = [F.lit(p) * (F.col("n") - 1) for p in probabilities]
    return F.sort_array(F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])))


def _inside(data: DataFrame, nodes: DataFrame, total: int, paths: list[str]) -> DataFrame:
    """(_k, first, lo, hi, v): values inside of nodes."""
    met = join_sums(data, nodes.select("_k", "first", "lo", "hi", "size"), "_k", "size", total, paths)
    return met.where(F.col("v").between(F.col("lo"), F.col("hi"))).select("_k", "first", "lo", "hi", "v")


def _children(data: DataFrame, nodes: DataFrame, total: int, bins: int, paths: list[str]) -> DataFrame:
    """The bins of nodes that hold a wanted rank, as nodes."""
    # halves, as the difference of two doubles may be above the largest one
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    rows = _inside(data, nodes, total, paths).withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
    counts = rows.groupBy("_k", "first", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    w = W.partitionBy("_k", "first").orderBy("bin")
    placed = counts.withColumn("at", F.col("first") + F.sum("n").over(w) - F.col("n"))
    met = placed.join(nodes.select("_k", "first", "ranks", "size"), ["_k", "first"])
    own = F.filter("ranks", lambda r: (r >= F.col("at")) & (r < F.col("at") + F.col("n")))
    return met.select("_k", F.col("at").alias("first"), "n", "lo", "hi", own.alias("ranks"), "size").where(F.size("ranks") > 0)


def exact_quantiles(rows: DataFrame, by: list[str], value: str | Column, probabilities: list[float], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """(by..., n, quantiles): the count of finite values of each group and their quantiles, an array in the order of the
    probabilities, interpolated linearly between the two values that a quantile stands between.

    Nulls, NaN and infinite values are left out; a group without finite values has n 0 and null quantiles. A null in `by` is a key
    like any other. Without `by` there is one row, if there are any rows.
    """
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    source = rows.select(key.alias("_k"), finite(col(value)).alias("v"))
    tops, _ = materialize(source.groupBy("_k").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumns({"first": F.lit(0).cast("long"), "ranks": _ranks(probabilities), "size": F.col("n")}), "quantiles")
    spark, data, done = rows.sparkSession, source.where("v IS NOT NULL"), []
    total = tops.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    big = F.col("n") > small
    nodes, gone, kept = tops.where("n > 0"), None, []
    ends: list[DataFrame] = []
    while True:
        ends.append(nodes.where((F.col("lo") == F.col("hi")) | ~big))
        nodes = nodes.where((F.col("lo") < F.col("hi")) & big)
        open_rows = nodes.agg(F.sum("n")).first()[0]
        if not open_rows:
            break
        if gone is not None:  # the rows of open nodes, far fewer than before
            data, path = materialize(_inside(data, nodes, total, kept).select("_k", "v"), "values")
            if gone:
                release(spark, gone)
            gone = path
        else:
            gone = ""
        nodes, path = materialize(_children(data, nodes, total, bins, kept), "nodes")
        done.append(path)
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    equal = found.where("lo = hi").select("_k", F.explode("ranks").alias("rank"), F.col("lo").alias("v"))
    few = found.where("lo < hi")
    place = F.col("first") + F.row_number().over(W.partitionBy("_k", "first").orderBy("v")) - 1
    sorted_ = _inside(source.where("v IS NOT NULL"), few, total, kept).withColumn("rank", place).join(few.select("_k", "first", "ranks"), ["_k", "first"]).where(F.array_contains("ranks", F.col("rank"))).select("_k", "rank", "v")
    values = equal.unionByName(sorted_).groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))
    out, _ = materialize(tops.select("_k", "n").join(values, "_k", "left"), "quantiles")
    release(spark, *done, *kept, *([gone] if gone else []))

    def quantile(p: float) -> Column:
        at = F.lit(p) * (F.col("n") - 1)
        low, high = (F.try_element_at("of", f(at).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (at - F.floor(at))

    return out.select(*[F.col("_k")[c].alias(c) for c in by], "n", F.when(F.col("n") > 0, F.array(*[quantile(p) for p in probabilities])).alias("quantiles"))


def with_quantiles(table: DataFrame, rows: DataFrame, by: list[str], value: str | Column, names: dict[str, float]) -> DataFrame:
    """A table of one row for each key of `by`, with quantiles of the rows' values under the given names."""
    got = exact_quantiles(rows, by, value, list(names.values()))
    pick = got.select(*[F.col(c).alias(f"_q_{c}") for c in by], *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(names)])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return table.join(pick, on, "left").drop(*[f"_q_{c}" for c in by])
