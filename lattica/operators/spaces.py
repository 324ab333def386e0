"""Spaces: how points and centers of each kind are compared. Points have point_id and the space's columns, centers cid.

assign() is one pass over the points without a shuffle of points x centers: centers are few (at most MAX_CENTERS) and
become constants (manifolds) or an array per node (graphs).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bolza as B
from ..functions import geometry as G
from . import sphere_blocks as blocks
from .graph import MetricGraph, same_edge

MAX_CENTERS = 10_000
#: Products written out as code; longer ones go through higher-order functions.
UNROLLED = 4_096
#: Inner products of two columns are written out for fewer dimensions than this.
WRITTEN_OUT = 8


class Space:
    """What every space gives: distance(a, b) as a Column where points are values, distances and assign for tables."""

    def distance(self, a: str, b: str) -> Column:
        raise NotImplementedError

    def distances(self, points: DataFrame, centers: DataFrame) -> DataFrame:
        """points x centers with cid and d."""
        raise NotImplementedError

    def assign(self, points: DataFrame, centers: DataFrame) -> DataFrame:
        """points with label, the cid of the nearest center (the lowest of equal ones), and d."""
        raise NotImplementedError

    def pairs(self, a: DataFrame, b: DataFrame | None = None) -> DataFrame:
        """(i, j, d) of all pairs of points; without b, those with i < j."""
        raise NotImplementedError

    def label_sums(self, labelled: DataFrame, label: str) -> DataFrame:
        """(i, lj, s, m): for every point and label, the sum of distances to that label's other points, and how many."""
        half = self.pairs(labelled)
        both = half.unionAll(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
        of = labelled.select(F.col("point_id").alias("j"), F.col(label).alias("lj"))
        return both.join(F.broadcast(of), "j").groupBy("i", "lj").agg(F.sum("d").alias("s"), F.count("*").alias("m"))

    def random_points(self, n: int, seed: int) -> np.ndarray:
        raise NotImplementedError(f"{type(self).__name__} has no uniform sampling")


def few(centers: DataFrame, *columns: str) -> list:
    rows = centers.select("cid", *columns).orderBy("cid").limit(MAX_CENTERS + 1).collect()
    if not rows or len(rows) > MAX_CENTERS:
        raise ValueError(f"between 1 and {MAX_CENTERS} centers are expected, got {len(rows)}")
    return rows


def lowest(candidates: Column) -> tuple[Column, Column]:
    best = F.array_min(candidates)
    return best["cid"], best["d"]


class Manifold(Space):
    """Points and centers carry `x`, an array of doubles."""

    def between(self, x: Column, y: Column) -> Column:
        raise NotImplementedError

    def to_constant(self, x: Column, y: list[float]) -> Column:
        return self.between(x, F.array(*map(F.lit, y)))

    def distance(self, a: str = "x", b: str = "y") -> Column:
        return self.between(F.col(a), F.col(b))

    def distances(self, points: DataFrame, centers: DataFrame) -> DataFrame:
        return points.crossJoin(F.broadcast(centers.select("cid", F.col("x").alias("y")))).withColumn("d", self.distance("x", "y")).drop("y")

    def assign(self, points: DataFrame, centers: DataFrame) -> DataFrame:
        rows = few(centers, "x")
        if len(rows) * len(rows[0]["x"]) <= UNROLLED:
            found = F.array(*(F.struct(self.to_constant(F.col("x"), [float(v) for v in r["x"]]).alias("d"), F.lit(r["cid"]).alias("cid")) for r in rows))
        else:
            text = ";".join(f"{r['cid']}:" + ",".join(repr(float(v)) for v in r["x"]) for r in rows)
            parts = F.transform(F.split(F.lit(text), ";"), lambda s: F.split(s, ":"))
            found = F.transform(parts, lambda p: F.struct(self.between(F.col("x"), F.split(F.get(p, F.lit(1)), ",").cast("array<double>")).alias("d"), F.get(p, F.lit(0)).cast("int").alias("cid")))
        return points.withColumn("_best", F.array_min(found)).select(*(c for c in points.columns if c not in ("label", "d")), F.col("_best.cid").alias("label"), F.col("_best.d").alias("d"))

    def pairs(self, a: DataFrame, b: DataFrame | None = None) -> DataFrame:
        left = a.select(F.col("point_id").alias("i"), "x")
        right = (a if b is None else b).select(F.col("point_id").alias("j"), F.col("x").alias("y"))
        x = left.join(right, F.col("i") < F.col("j")) if b is None else left.crossJoin(right)
        return x.select("i", "j", self.distance("x", "y").alias("d"))


@dataclass(frozen=True)
class Sphere(Manifold):
    dim: int = 2
    name = "sphere"

    def between(self, x, y):
        if self.dim < WRITTEN_OUT:  # as plain code, which is compiled; higher-order functions are interpreted
            inner = sum((F.get(x, F.lit(i)) * F.get(y, F.lit(i)) for i in range(self.dim + 1)), F.lit(0.0))
            return F.acos(G.clipped(inner, -1.0, 1.0))
        return G.sphere_distance(x, y)

    def to_constant(self, x, y):
        inner = sum((F.get(x, F.lit(i)) * v for i, v in enumerate(y)), F.lit(0.0))
        return F.acos(G.clipped(inner, -1.0, 1.0))

    def belongs(self, x: str = "x", atol: float = 1e-6) -> Column:
        return (F.size(x) == self.dim + 1) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (F.abs(G.norm(x) - 1) < atol)

    def label_sums(self, labelled, label):
        """Block by block; only sums leave a task."""
        return blocks.label_sums(labelled, label) if blocks.usable(labelled, self.dim + 1) else super().label_sums(labelled, label)

    def pairs(self, a, b=None):
        if all(blocks.usable(t, self.dim + 1) for t in ((a,) if b is None or b is a else (a, b))):
            return blocks.pairs(a, b)
        return super().pairs(a, b)

    def nearest(self, points: DataFrame, k: int) -> DataFrame:
        """(i, j, d): the k nearest other points of every point, ties to the smaller id."""
        if blocks.usable(points, self.dim + 1):
            return blocks.nearest(points, k)
        d = points.select(F.col("point_id").alias("i"), "x").join(points.select(F.col("point_id").alias("j"), F.col("x").alias("y")), F.col("i") != F.col("j"))
        rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
        return d.withColumn("d", self.distance("x", "y")).withColumn("rank", rank).where(F.col("rank") <= k).select("i", "j", "d")

    def random_points(self, n, seed):
        v = np.random.default_rng(seed).standard_normal((n, self.dim + 1))
        return v / np.linalg.norm(v, axis=1, keepdims=True)


@dataclass(frozen=True)
class Hyperboloid(Manifold):
    dim: int = 2
    name = "hyperboloid"

    def between(self, x, y):
        return G.hyperboloid_distance(x, y)

    def belongs(self, x: str = "x", atol: float = 1e-6) -> Column:
        return (F.size(x) == self.dim + 1) & (F.abs(G.lorentz(x, x) + 1) < atol) & (F.get(x, F.lit(0)) > 0)


@dataclass(frozen=True)
class Bolza(Manifold):
    """Points `x` are (re, im) in the Poincare disk, up to the group."""

    name = "bolza"

    def between(self, x, y):
        p, q = (G.Complex(F.get(v, F.lit(0)), F.get(v, F.lit(1))) for v in (x, y))
        return B.quotient_distance(p, q)

    def belongs(self, x: str = "x") -> Column:
        return G.disk_belongs(G.Complex(F.get(F.col(x), F.lit(0)), F.get(F.col(x), F.lit(1))))

    def random_points(self, n, seed):
        p = B.np_uniform(n, np.random.default_rng(seed))
        return np.stack([p.real, p.imag], 1)


@dataclass(frozen=True)
class GraphSpace(Space):
    """Points and centers are (u, v, pos) on the edges of a metric graph."""

    graph: MetricGraph
    name = "graph"

    def distances(self, points, centers):
        return self.graph.center_distances(points, centers)

    def assign(self, points, centers):
        few(centers)
        near = self.graph.node_center_distances(centers)
        per_node = near.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("cid", "d"))).alias("near"))
        own = self.graph.with_length(centers).select(F.struct("cid", F.col("u").alias("cu"), F.col("v").alias("cv"), F.col("pos").alias("cpos")).alias("c"))
        all_centers = own.agg(F.array_sort(F.collect_list("c")).alias("centers"))
        hint = F.broadcast if self.graph.few_nodes else (lambda t: t)
        x = self.graph.with_length(points).crossJoin(F.broadcast(all_centers))
        x = x.join(hint(per_node.toDF("u", "near_u")), "u").join(hint(per_node.toDF("v", "near_v")), "v")
        i = F.sequence(F.lit(0), F.size("centers") - 1)

        def at(k: Column) -> Column:
            c = F.get(F.col("centers"), k)
            route = F.least(F.col("pos") + F.get(F.col("near_u"), k)["d"], F.col("length") - F.col("pos") + F.get(F.col("near_v"), k)["d"])
            p, n, arc = F.col("pos"), F.col("length"), F.abs(F.col("pos") - c["cpos"])
            one = F.when((F.col("u") == F.col("v")) & (c["cu"] == F.col("u")) & (c["cv"] == F.col("u")), F.least(arc, n - arc)).when((c["cu"] == F.col("u")) & (c["cv"] == F.col("v")), arc).when((c["cu"] == F.col("v")) & (c["cv"] == F.col("u")), F.abs(n - p - c["cpos"])).otherwise(route)
            return F.struct(F.least(route, one).alias("d"), c["cid"].alias("cid"))

        x = x.withColumn("_best", F.array_min(F.transform(i, at)))
        keep = [c for c in points.columns if c not in ("length", "label", "d")]
        return x.select(*keep, "length", F.col("_best.cid").alias("label"), F.col("_best.d").alias("d"))

    def pairs(self, a, b=None):
        return self.graph.all_distances(a, b)


__all__ = ["Bolza", "GraphSpace", "Hyperboloid", "Manifold", "Space", "Sphere", "same_edge"]
