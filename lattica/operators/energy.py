"""Energies: means and sums of squared distances to the nearest center."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .graph import MetricGraph
from .spaces import GraphSpace, Space

MODES = ("uniform", "empirical", "node_measure")


def nearest_per_node(graph: MetricGraph, centers: DataFrame) -> DataFrame:
    """(node_id, d): distance of every node to its nearest center."""
    return graph.node_center_distances(centers).groupBy("node_id").agg(F.min("d").alias("d"))


def uniform_energy(graph: MetricGraph, centers: DataFrame) -> DataFrame:
    """Mean over all nodes."""
    return nearest_per_node(graph, centers).agg(F.avg(F.col("d") * F.col("d")).alias("energy"))


def empirical_energy(space: Space, points: DataFrame, centers: DataFrame, by: str | None = None) -> DataFrame:
    """Mean over points, at their exact positions; one row, or one for each value of a column."""
    d = space.assign(points, centers)
    return (d.groupBy(by) if by else d.groupBy()).agg(F.avg(F.col("d") * F.col("d")).alias("energy"))


def node_measure_energy(graph: MetricGraph, centers: DataFrame, observed: DataFrame) -> DataFrame:
    """Mean over nodes weighted by obs_weight (observed: node_id, obs_weight); weightless nodes are left out first."""
    w = observed.select("node_id", F.col("obs_weight").cast("double").alias("w")).where("w > 0")
    return nearest_per_node(graph, centers).join(w, "node_id").agg((F.sum(F.col("w") * F.col("d") * F.col("d")) / F.sum("w")).alias("energy"))


def node_energy(graph: MetricGraph, centers: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Sum over nodes, weighted by weight (1 where missing)."""
    w = (graph.nodes if weights is None else weights).select("node_id", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w"))
    return nearest_per_node(graph, centers).join(w, "node_id").agg(F.sum(F.col("w") * F.col("d") * F.col("d")).alias("energy"))


def energy(space: Space, centers: DataFrame, how: str = "uniform", observations: DataFrame | None = None, observed: DataFrame | None = None) -> DataFrame:
    """Dispatch by mode. Uniform and node_measure define their own measure and refuse observations; manifolds know empirical only."""
    if how not in MODES:
        raise ValueError(f"how must be one of {MODES}, got {how!r}")
    if how == "empirical":
        if observations is None or observations.isEmpty():
            raise ValueError("empirical energy needs observations")
        return empirical_energy(space, observations, centers)
    if observations is not None:
        raise ValueError(f"{how} energy takes no observations")
    if not isinstance(space, GraphSpace):
        raise ValueError("manifolds have empirical energy only")
    if how == "uniform":
        return uniform_energy(space.graph, centers)
    if observed is None or observed.where("obs_weight > 0").isEmpty():
        raise ValueError("node_measure energy needs a positive obs_weight")
    if not observed.where("obs_weight < 0").isEmpty():
        raise ValueError("obs_weight must not be negative")
    return node_measure_energy(space.graph, centers, observed)
