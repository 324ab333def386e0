"""Cluster updates: from labelled points to new centers, all clusters in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as G
from ..plans.storage import stored
from .graph import MetricGraph, closest_node
from .spaces import Space


def most_frequent_node(graph: MetricGraph, labelled: DataFrame) -> DataFrame:
    """(label, node_id, n): the closest node of most points of each cluster; of equal ones the first met by ord."""
    at = labelled.withColumn("node_id", closest_node()) if "length" in labelled.columns else graph.with_length(labelled).withColumn("node_id", closest_node())
    n = at.groupBy("label", "node_id").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = n.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "node_id")).alias("b"))
    return best.select("label", F.col("b.node_id").alias("node_id"), (-F.col("b.m")).alias("n"))


def candidate_energies(graph: MetricGraph, labelled: DataFrame, members_only: bool = False, weight: str | None = None) -> DataFrame:
    """(label, node_id, ord, energy): sum of squared distances from each candidate node to the cluster's points, rounded to nodes."""
    at = graph.with_length(labelled).withColumn("t", closest_node())
    w = F.sum(weight).alias("w") if weight else F.count("*").cast("double").alias("w")
    counts = at.groupBy("label", "t").agg(w)
    e = counts.join(graph.node_dist.toDF("node_id", "t", "dist"), "t").groupBy("label", "node_id").agg(F.sum(F.col("w") * F.col("dist") * F.col("dist")).alias("energy"))
    if members_only:
        e = e.join(counts.select("label", F.col("t").alias("node_id")), ["label", "node_id"], "left_semi")
    return e.join(graph.nodes.select("node_id", "ord"), "node_id")


def least_energy_node(graph: MetricGraph, labelled: DataFrame, members_only: bool = False, weight: str | None = None) -> DataFrame:
    """(label, node_id, energy): the best candidate, over all nodes (or the cluster's own: k-medoids); the first by ord of equal ones."""
    e = candidate_energies(graph, labelled, members_only, weight)
    best = e.groupBy("label").agg(F.min(F.struct(F.round("energy", 9).alias("e"), "ord", "node_id", "energy")).alias("b"))
    return best.select("label", F.col("b.node_id").alias("node_id"), F.col("b.energy").alias("energy"))


def node_centers(graph: MetricGraph, chosen: DataFrame, cid: str = "label") -> DataFrame:
    """Nodes as centers: position 0 of the edge to the first neighbour."""
    return chosen.join(graph.nodes_as_points(), "node_id").select(F.col(cid).cast("int").alias("cid"), "u", "v", "pos")


def karcher_mean(space: Space, labelled: DataFrame, dim: int, steps: int = 64, tol: float = 1e-9, log=G.sphere_log, exp=G.sphere_exp) -> DataFrame:
    """(cid, x): mean of each cluster on a manifold, from its first point by ord, by mean <- exp(mean, mean of logs)."""
    first = labelled.groupBy(F.col("label").alias("cid")).agg(F.min_by("x", "ord").alias("x"))
    now = stored(first.withColumn("step", F.lit(1.0)))
    for _ in range(steps):
        logs = labelled.join(F.broadcast(now.select(F.col("cid").alias("label"), F.col("x").alias("m"))), "label").withColumn("v", log("m", "x"))
        mean = logs.groupBy(F.col("label").alias("cid")).agg(F.first("m").alias("m"), *(F.avg(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(dim)))
        v = F.array(*(F.col(f"v{i}") for i in range(dim)))
        now = stored(mean.withColumn("v", v).select("cid", exp("m", "v").alias("x"), G.norm("v").alias("step")))
        if tol and now.agg(F.max("step")).first()[0] < tol:
            break
    return now.select("cid", "x")


def farthest_point(space: Space, points: DataFrame, centers: DataFrame) -> DataFrame:
    """The point farthest from its nearest center; the first by ord of equal ones."""
    d = space.assign(points, centers)
    return d.orderBy(F.desc(F.round("d", 9)), "ord").limit(1)


def majority_labels(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    """(predicted, truth): the most frequent truth of each predicted label; the smaller of equal ones."""
    n = rows.groupBy(predicted, truth).agg(F.count("*").alias("n"))
    w = Window.partitionBy(predicted).orderBy(F.desc("n"), truth)
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select(predicted, truth, "n")
