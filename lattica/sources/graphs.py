"""Graph generators and importers: every one gives (nodes, edges) DataFrames.

nodes(node_id, ord, weight[, block, label]) and edges(u, v, length, weight), each undirected edge once.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.random import uniform


def _positive(value, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not value > 0:
        raise ValueError(f"{name} must be a positive number, got {value!r}")
    return float(value)


def _count(value, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} must be a non-negative integer, got {value!r}")
    return value


def nodes_of(edges: DataFrame) -> DataFrame:
    """Nodes by sorted id, weight 1."""
    ids = edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    from pyspark.sql import Window

    return ids.withColumn("ord", (F.row_number().over(Window.orderBy("node_id")) - 1).cast("long")).withColumn("weight", F.lit(1.0))


def star_pair(spark: SparkSession, n_a: int = 5, n_aa: int = 3, bridge_length: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Two stars of stars, A and B, whose hubs a bridge joins; all other edges have length 1."""
    n_a, n_aa, bridge = _count(n_a, "n_a"), _count(n_aa, "n_aa"), _positive(bridge_length, "bridge_length")
    side = spark.range(2).select(F.when(F.col("id") == 0, "A").otherwise("B").alias("s"))
    first = side.crossJoin(F.broadcast(spark.range(1, n_a + 1).withColumnRenamed("id", "i")))
    second = first.crossJoin(F.broadcast(spark.range(1, n_aa + 1).withColumnRenamed("id", "j")))
    name = lambda *c: F.concat(*(F.col(x).cast("string") if len(x) == 1 else F.lit(x[1:]) for x in c))
    edges = (
        spark.range(1).select(F.lit("A0").alias("u"), F.lit("B0").alias("v"), F.lit(bridge).alias("length"))
        .unionByName(first.select(F.concat("s", F.lit("0")).alias("u"), name("s", "i").alias("v"), F.lit(1.0).alias("length")))
        .unionByName(second.select(name("s", "i").alias("u"), name("s", "i", "._", "j").alias("v"), F.lit(1.0).alias("length")))
        .withColumn("weight", F.lit(1.0))
    )
    return nodes_of(edges), edges


def random_star_pair(spark: SparkSession, n_a: int = 5, n_b: int = 5, lam_a: float = 0, lam_b: float = 0, bridge_length: float = 10.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Hubs of weight 5, neighbours of weight 3 with Poisson many children of weight 1; edges weigh the harmonic mean of their ends."""
    rng, bridge = np.random.default_rng(seed), _positive(bridge_length, "bridge_length")
    nodes, edges = [("A0", 5.0), ("B0", 5.0)], [("A0", "B0", float(rng.uniform(0.9 * bridge, 1.1 * bridge)))]
    for side, n, lam in (("A", _count(n_a, "n_a"), lam_a), ("B", _count(n_b, "n_b"), lam_b)):
        for i in range(1, n + 1):
            nodes.append((f"{side}{i}", 3.0))
            edges.append((f"{side}0", f"{side}{i}", float(rng.uniform(0.9, 1.1))))
            for j in range(1, int(rng.poisson(lam)) + 1):
                nodes.append((f"{side}{i}_{j}", 1.0))
                edges.append((f"{side}{i}", f"{side}{i}_{j}", float(rng.uniform(0.4, 0.6))))
    n = spark.createDataFrame([(x, i, w) for i, (x, w) in enumerate(nodes)], "node_id string, ord long, weight double")
    e = spark.createDataFrame(edges, "u string, v string, length double")
    w = n.select("node_id", "weight")
    e = e.join(F.broadcast(w.toDF("u", "wu")), "u").join(F.broadcast(w.toDF("v", "wv")), "v")
    return n, e.select("u", "v", "length", (2 / (1 / F.col("wu") + 1 / F.col("wv"))).alias("weight"))


def block_model(spark: SparkSession, sizes: list[int], p: list[list[float]], lengths: list[list[float]] | None = None, weights: list[float] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Stochastic block model: an edge for each pair of nodes by the portable uniform of (seed, i, j)."""
    k = len(sizes)
    if k == 0 or len(p) != k or any(len(r) != k for r in p) or any(not 0 <= x <= 1 for r in p for x in r):
        raise ValueError("p must be a square matrix of probabilities with a row for each size")
    if any(not math.isclose(p[i][j], p[j][i]) for i in range(k) for j in range(k)):
        raise ValueError("p must be symmetric")
    lengths, weights = lengths or [[1.0] * k] * k, weights or [1.0] * k
    for x in [*(x for r in lengths for x in r), *weights]:
        _positive(x, "lengths and weights")
    starts = np.cumsum([0, *(_count(s, "sizes") for s in sizes)])
    block = F.lit(0)
    for i, s in enumerate(starts[1:-1], 1):
        block = F.when(F.col("ord") >= int(s), i).otherwise(block)
    nodes = spark.range(int(starts[-1])).withColumnRenamed("id", "ord").withColumn("block", block.cast("int"))
    table = spark.createDataFrame([(i, j, float(p[i][j]), float(lengths[i][j])) for i in range(k) for j in range(k)], "bi int, bj int, p double, length double")
    pairs = nodes.toDF("i", "bi").join(nodes.toDF("j", "bj"), F.col("i") < F.col("j")).join(F.broadcast(table), ["bi", "bj"])
    edges = pairs.where(uniform(seed, "i", "j") < F.col("p")).select(F.col("i").cast("string").alias("u"), F.col("j").cast("string").alias("v"), "length", F.lit(1.0).alias("weight"))
    weight = F.get(F.array(*map(F.lit, map(float, weights))), F.col("block"))
    return nodes.select(F.col("ord").cast("string").alias("node_id"), "ord", weight.alias("weight"), "block"), edges


def imported(edges: DataFrame, node_weight: float = 1.0, edge_length: float = 1.0, edge_weight: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """An existing edge list (u, v), both directions of an edge taken as one, with uniform length and weights."""
    length, weight, own = _positive(edge_length, "edge_length"), _positive(edge_weight, "edge_weight"), _positive(node_weight, "node_weight")
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumns({"length": F.lit(length), "weight": F.lit(weight)})
    return nodes_of(e).withColumn("weight", F.lit(own)), e


def complete(objects: DataFrame, distances: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Objects (node_id, ord[, label]) joined pairwise, by the upper triangle of a symmetric matrix (i, j, d) over ord, or length 1."""
    a, b = objects.select(F.col("node_id").alias("u"), F.col("ord").alias("i")), objects.select(F.col("node_id").alias("v"), F.col("ord").alias("j"))
    if distances is None:
        edges = a.join(b, F.col("i") < F.col("j")).select("u", "v", F.lit(1.0).alias("length"))
    else:
        m, t = distances.select("i", "j", "d"), distances.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("d").alias("back"))
        bad = m.join(t, ["i", "j"], "left").where((F.col("i") != F.col("j")) & ((F.col("d") <= 0) | F.col("back").isNull() | (F.abs(F.col("d") - F.col("back")) > 1e-8 + 1e-5 * F.abs("back"))))
        if not bad.isEmpty():
            raise ValueError("distances must be symmetric and positive off the diagonal")
        edges = m.where("i < j").join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("u", "v", F.col("d").alias("length"))
    nodes = objects.withColumn("weight", F.lit(1.0)) if "weight" not in objects.columns else objects
    return nodes, edges.withColumn("weight", F.lit(1.0))
