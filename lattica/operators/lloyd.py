"""Lloyd iterations over DataFrames, and weighted k-medoids over a graph's nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..plans.storage import stored
from .graph import MetricGraph
from .spaces import GraphSpace, Space
from .updates import farthest_point, least_energy_node, node_centers

Update = Callable[[DataFrame], DataFrame]


def node_update(graph: MetricGraph, rule=least_energy_node) -> Update:
    return lambda labelled: node_centers(graph, rule(graph, labelled))


def reseed(space: Space, points: DataFrame, old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Fills the clusters that got no center, one after the other: each with the point farthest from all centers so far."""
    columns = [c for c in new.columns if c != "cid"]
    have = {r["cid"] for r in new.select("cid").collect()}  # k rows
    for cid in range(k):
        if cid not in have:
            ahead = old.join(new.select("cid"), "cid", "left_anti").where(F.col("cid") > cid).select("cid", *columns)
            far = farthest_point(space, points, new.select("cid", *columns).unionByName(ahead))
            new = stored(new.unionByName(far.select(F.lit(cid).alias("cid"), *columns)))
    return new


def lloyd(space: Space, points: DataFrame, centers: DataFrame, update: Update, max_iterations: int = 100, tolerance: float = 1e-4) -> tuple[DataFrame, float, int]:
    """Assign, update, reseed, until the empirical energy changes by less than tolerance: (centers, energy, iterations)."""
    columns = [c for c in centers.columns if c in ("cid", "u", "v", "pos", "x")]
    now, k = stored(centers.select(*columns)), centers.count()
    labelled, before, i = stored(space.assign(points, now), "labelled"), None, 0
    for i in range(1, max_iterations + 1):
        now = reseed(space, points, now, stored(update(labelled).select(*columns)), k)
        labelled = stored(space.assign(points, now), "labelled")  # gives this round's energy and the next one's clusters
        energy = labelled.agg(F.avg(F.col("d") * F.col("d"))).first()[0]
        if before is not None and abs(before - energy) < tolerance:
            return now, energy, i
        before = energy
    return now, before, i


def kmedoids(graph: MetricGraph, weighted: DataFrame, medoids: DataFrame, max_iterations: int = 100) -> tuple[DataFrame, float, int]:
    """Weighted k-medoids over nodes (weighted: node_id, w), from medoids (cid, node_id): (medoids, energy, iterations).

    A cluster's medoid is its member with the least weighted sum of squared distances; it ends when labels and medoids stay.
    """
    ords = graph.nodes.select("node_id", "ord")
    w, now = weighted.select("node_id", "w"), stored(medoids.select("cid", "node_id"))
    d = graph.node_dist
    mark, i = None, 0
    for i in range(1, max_iterations + 1):
        labelled = label_nodes(d, w, now)
        best = medoid_of(d, labelled, ords)
        kept = now.join(best.select("cid"), "cid", "left_anti")
        now = stored(best.unionByName(kept))
        new = sorted(map(tuple, now.collect()))  # k rows
        if new == mark:
            break
        mark = new
    final = label_nodes(d, w, now)
    return now, final.agg((F.sum(F.col("w") * F.col("d") * F.col("d")) / F.sum("w"))).first()[0], i


def label_nodes(d: DataFrame, w: DataFrame, medoids: DataFrame) -> DataFrame:
    """(node_id, w, cid, d): the nearest medoid of each node, the lowest of equal ones."""
    x = w.join(d.toDF("node_id", "t", "d"), "node_id").join(F.broadcast(medoids.toDF("cid", "t")), "t")
    best = x.groupBy("node_id", "w").agg(F.min(F.struct("d", "cid")).alias("b"))
    return best.select("node_id", "w", F.col("b.cid").alias("cid"), F.col("b.d").alias("d"))


def medoid_of(d: DataFrame, labelled: DataFrame, ords: DataFrame) -> DataFrame:
    own = labelled.select("cid", F.col("node_id").alias("s"))
    far = labelled.select("cid", F.col("node_id").alias("t"), "w")
    e = own.join(far, "cid").join(d.toDF("s", "t", "dist"), ["s", "t"]).groupBy("cid", "s").agg(F.sum(F.col("w") * F.col("dist") * F.col("dist")).alias("e"))
    best = e.join(ords.toDF("s", "ord"), "s").groupBy("cid").agg(F.min(F.struct(F.round("e", 9).alias("e"), "ord", "s")).alias("b"))
    return best.select("cid", F.col("b.s").alias("node_id"))


__all__ = ["GraphSpace", "kmedoids", "lloyd", "node_update", "reseed"]
