"""Sampling and initialisation, by the portable uniform of (seed, key): results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.random import uniform
from ..plans.storage import stored
from .graph import MetricGraph, both_ways
from .spaces import Space


def first_edges(graph: MetricGraph) -> DataFrame:
    return graph.nodes_as_points().select("node_id", "ord", "u", "v", "pos", "length")


def uniform_nodes(graph: MetricGraph, n: int, seed: int) -> DataFrame:
    """n nodes, each equally likely, at position 0; weights don't matter."""
    at = Window.orderBy("node_id")
    nodes = first_edges(graph).withColumn("at", (F.row_number().over(at) - 1).cast("long"))
    total = nodes.count()
    drawn = graph.spark.range(n).select(F.col("id").alias("ord"), F.floor(uniform(seed, "id") * total).alias("at"))
    return drawn.join(F.broadcast(nodes.drop("ord")), "at").select(F.col("ord").alias("point_id"), "ord", "u", "v", "pos")


def inverse_cdf(items: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """(draw, key, lo, total, target): n draws of items with probability by weight, items in order of key.

    Cumulative weights make ranges; a draw falls into one. The items are one row per node or edge; their running sum is
    taken in one task, the join to the draws is a range join against the broadcast ranges.
    """
    total = items.agg(F.sum(weight)).first()[0]
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    ranged = items.withColumn("hi", F.sum(weight).over(w)).withColumn("lo", F.col("hi") - F.col(weight))
    last = ranged.agg(F.max(key)).first()[0]
    draws = items.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform(seed, "id") * total).alias("target"))
    inside = (F.col("target") >= F.col("lo")) & ((F.col("target") < F.col("hi")) | (F.col(key) == last))
    return draws.join(F.broadcast(ranged), inside)


def uniform_edges(graph: MetricGraph, n: int, seed: int) -> DataFrame:
    """n points, uniform by length over all edges."""
    edges = graph.edges.withColumn("key", F.concat_ws("|", "u", "v"))
    if edges.isEmpty():
        raise ValueError("the graph has no edges")
    x = inverse_cdf(edges.select("key", "u", "v", "length"), "key", "length", n, seed)
    return x.select(F.col("draw").alias("point_id"), F.col("draw").alias("ord"), "u", "v", F.least("length", uniform(seed + 1, "draw") * F.col("length")).alias("pos"))


def weighted_nodes(graph: MetricGraph, n: int, seed: int, weight: str = "weight") -> DataFrame:
    """n nodes by weight, at position 0; all weights must be positive."""
    if weight not in graph.nodes.columns or not graph.nodes.where(F.col(weight).isNull() | (F.col(weight) <= 0)).isEmpty():
        raise ValueError(f"every node needs a positive {weight}")
    items = graph.nodes.select(F.col("node_id").alias("key"), F.col(weight).cast("double").alias("w"))
    x = inverse_cdf(items, "key", "w", n, seed).join(F.broadcast(first_edges(graph).select(F.col("node_id").alias("key"), "u", "v", "pos")), "key")
    return x.select(F.col("draw").alias("point_id"), F.col("draw").alias("ord"), "u", "v", "pos")


def shuffled(points: DataFrame, seed: int) -> DataFrame:
    """points with ord by a random order; ranks are a global sort, as the order is the result."""
    return points.withColumn("ord", (F.row_number().over(Window.orderBy(uniform(seed, "point_id"), "point_id")) - 1).cast("long"))


def random_init(points: DataFrame, k: int, seed: int) -> DataFrame:
    """k distinct observations as centers 0..k-1."""
    chosen = points.withColumn("_u", uniform(seed, "point_id")).orderBy("_u", "point_id").limit(k)
    if chosen.count() < k:
        raise ValueError(f"{k} centers need at least as many observations")
    return chosen.withColumn("cid", (F.row_number().over(Window.orderBy("_u", "point_id")) - 1).cast("int")).drop("_u")


def kmeans_pp(space: Space, points: DataFrame, k: int, seed: int, weight: str | None = None) -> DataFrame:
    """k-means++: the first center uniformly, each next one by (weighted) squared distance; uniformly if all are zero.

    Each round keeps every point's least squared distance so far and meets only the newest center. The draw runs over
    the cumulative sum by point_id.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    n = points.count()
    if not 0 < k or not n:
        raise ValueError("k must be positive and there must be observations")
    columns = [c for c in points.columns if c not in ("label", "d")]
    state = points.select(*columns).withColumn("d2", F.lit(None).cast("double"))
    chosen = None
    for i in range(k):
        share = F.lit(1.0) if i == 0 else w * F.col("d2")
        totals = state.select(F.sum(share).alias("t")).first()["t"]
        share = share if totals and totals > 0 else F.lit(1.0)
        target = uniform(seed, F.lit(i)) * (totals if totals and totals > 0 else float(n))
        run = F.sum(share).over(Window.orderBy("point_id").rowsBetween(Window.unboundedPreceding, 0))
        pick = state.withColumn("_cum", run).where(F.col("_cum") > target).orderBy("point_id").limit(1)
        if pick.isEmpty():
            pick = state.where(share > 0).orderBy(F.desc("point_id")).limit(1)
        center = stored(pick.select(*columns).withColumn("cid", F.lit(i)))
        chosen = center if chosen is None else chosen.unionByName(center)
        if i + 1 < k:
            d = space.assign(state.select(*columns, "d2"), center).withColumn("d2", F.least(F.coalesce("d2", F.lit(float("inf"))), F.col("d") * F.col("d")))
            state = stored(d.select(*columns, "d2"))
    return chosen


def bootstrap(points: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws with replacement, ord from 0."""
    total = points.count()
    numbered = points.withColumn("_at", F.row_number().over(Window.orderBy("point_id")) - 1)
    draws = points.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(uniform(seed, "id") * total).alias("_at"))
    return draws.join(numbered, "_at").drop("_at", "ord").withColumnRenamed("draw", "ord")


__all__ = ["both_ways", "bootstrap", "inverse_cdf", "kmeans_pp", "random_init", "shuffled", "uniform_edges", "uniform_nodes", "weighted_nodes"]
