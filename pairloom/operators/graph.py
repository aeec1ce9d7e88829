"""Connected components, leak-free partitioning by component, and the checks that go with them.

Components run as alternating large-star and small-star steps: each is a minimum by node, summed before the shuffle, and a
join that links anew, in which a node with very many neighbours is broadcast instead of shuffled; so no task holds a
component or a list of neighbours. Steps are written to the shared folder, so a lost executor costs a
re-read; the loop ends when a step changes nothing, after about log2 of the largest component. Up to FEW_LINKS links stay in
one partition, where the same steps need no shuffle: dealing a megabyte to all partitions costs more than the steps.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import strip
from ..sources.store import materialize, release
from .hot import join_sums

#: Up to so many links, about a megabyte, the steps run in one partition.
FEW_LINKS = 1 << 16


def _star(edges: DataFrame, large: bool, many: int, paths: list[str]) -> DataFrame:
    """large: link each node's larger neighbours to the least of it and its neighbours; small, where all v are below u:
    the node and its other neighbours to the least one. many: rows of edges, about; paths: gets what the result reads."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    both = both.coalesce(1) if many <= FEW_LINKS else both
    least = both.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n"))
    joined = both.join(least, "u") if many <= FEW_LINKS else join_sums(both, least, "u", "_n", 2 * many if large else many, paths)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.least("_m", "u").alias("v"))
    else:
        out = joined.select(F.when(F.col("v") == F.col("_m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("_m").alias("v"))
    return out.distinct()


def components(links: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, component): every node of a link between two different nodes, with the smallest node it reaches. Rows with a
    null node are no links."""
    spark = links.sparkSession
    start = links.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    edges, path = materialize(start, "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        # each star reads its links several times, so its input is a table: two stars in one plan would multiply its parts
        read: list[str] = []
        half, half_path = materialize(_star(edges, True, seen[0], read), "links")
        step, step_path = materialize(_star(half, False, seen[0], read), "links")
        release(spark, path, half_path, *read)
        edges, path, now = step, step_path, mark(step)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if seen[0] <= FEW_LINKS:
        return stars.union(stars.select(F.col("component").alias("node"), "component")).coalesce(1).distinct()
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def speaker_components(pairs: DataFrame, a: str = "english_speaker_id", b: str = "spanish_speaker_id") -> DataFrame:
    """(speaker, component) over the speakers that pairs link; a blank speaker is an error."""
    sure = [F.when(strip(F.coalesce(F.col(c), F.lit(""))) != "", F.col(c)).otherwise(F.raise_error(F.lit("a pair lacks a speaker"))).alias(n) for c, n in ((a, "a"), (b, "b"))]
    links = pairs.select(*sure)
    found = components(links).select(F.col("node").alias("speaker"), "component")
    alone = links.select(F.explode(F.array("a", "b")).alias("speaker")).distinct().join(found, "speaker", "left_anti")
    return found.union(alone.select("speaker", F.col("speaker").alias("component")))


def greedy_parts(weights: dict[str, int], seed: int = 498, ratios: tuple[float, ...] = (0.7, 0.15, 0.15), names: tuple[str, ...] = ("train", "dev", "test")) -> dict[str, str]:
    """Parts of components: shuffled by the seed, heaviest first, each to the part that is least full for its share."""
    if len(ratios) != len(names) or min(ratios) <= 0:
        raise ValueError("each part needs a positive ratio")
    order = sorted(weights)
    if len(order) < len(names):
        raise ValueError("there are fewer components than parts")
    random.Random(seed).shuffle(order)
    total = sum(weights.values())
    want = {n: total * r / sum(ratios) for n, r in zip(names, ratios, strict=True)}
    full, out = dict.fromkeys(names, 0), {}
    for c in sorted(order, key=lambda c: -weights[c]):
        out[c] = min(names, key=lambda n: full[n] / want[n])
        full[out[c]] += weights[c]
    return out


def assign_splits(pairs: DataFrame, seed: int = 498, ratios: tuple[float, ...] = (0.7, 0.15, 0.15), a: str = "english_speaker_id", b: str = "spanish_speaker_id") -> DataFrame:
    """pairs with `split`, such that no component of speakers reaches into two. To the driver comes one weight for each
    component, of which a corpus has as many as it has unconnected speakers."""
    found = speaker_components(pairs, a, b)
    rows = pairs.drop("split").join(found.select(F.col("speaker").alias(a), "component"), a)
    weights = {r["component"]: r["n"] for r in rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = pairs.sparkSession.createDataFrame(sorted(greedy_parts(weights, seed, ratios).items()), "component string, split string")
    return rows.join(parts, "component").drop("component").select(*[c for c in pairs.columns if c != "split"], "split")


def leaks(rows: DataFrame, groups: list[str], split: str = "split") -> DataFrame:
    """(member, n_splits) of members of the group columns that stand in several splits."""
    long = rows.select(F.explode(F.array(*[F.col(g).cast("string") for g in groups])).alias("member"), split)
    return long.groupBy("member").agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def require_disjoint(rows: DataFrame, groups: list[str], split: str = "split") -> None:
    found = leaks(rows, groups, split).limit(5).collect()
    if found:
        raise ValueError(f"members in several splits: {[r['member'] for r in found]}")
