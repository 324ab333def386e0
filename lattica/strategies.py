"""The extension surface: strategies as small values, each a rule over DataFrames, and the calls that take them.

Own strategies are classes with the one method of their kind; own spaces derive from `lattica.operators.spaces.Space`
(distances and assign over tables) and, to be annealed, have a kernel with start, distance, nearest, diffuse, drift,
point, read and energy (see `lattica.operators.kernels`).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import annealing as A
from .operators import lloyd as L
from .operators import sampling as P
from .operators import updates as U
from .operators.spaces import GraphSpace, Manifold, Space
from .sources import nets as N


class Sampling(Protocol):
    def sample(self, spark: SparkSession, space: Space, n: int) -> DataFrame: ...


class Initialization(Protocol):
    def centers(self, space: Space, points: DataFrame, k: int) -> DataFrame: ...


class Robustification(Protocol):
    def select(self, space: Space, trajectory: DataFrame, how: A.Annealing) -> DataFrame: ...


class Update(Protocol):
    def update(self, space: Space, labelled: DataFrame) -> DataFrame: ...


class Net(Protocol):
    def build(self, spark: SparkSession, space: Manifold, n: int) -> DataFrame: ...


@dataclass
class Seeded:
    """A seed of which every call takes the next stream: calls differ, equal strategies agree call by call."""

    seed: int = 0
    _calls: int = field(default=0, repr=False)

    def next_seed(self) -> int:
        self._calls += 1
        return int(np.random.SeedSequence([self.seed, self._calls]).generate_state(1)[0])


def _graph(space: Space):
    if not isinstance(space, GraphSpace):
        raise TypeError("this strategy needs a metric graph")
    return space.graph


@dataclass
class UniformNodes(Seeded):
    def sample(self, spark, space, n):
        return P.uniform_nodes(_graph(space), n, self.next_seed())


@dataclass
class UniformEdges(Seeded):
    def sample(self, spark, space, n):
        return P.uniform_edges(_graph(space), n, self.next_seed())


@dataclass
class WeightedNodes(Seeded):
    def sample(self, spark, space, n):
        return P.weighted_nodes(_graph(space), n, self.next_seed())


@dataclass
class UniformOnManifold(Seeded):
    def sample(self, spark, space, n):
        return N.uniform_net(spark, space, n, self.next_seed())


@dataclass
class RandomObservations(Seeded):
    """k distinct observations."""

    def centers(self, space, points, k):
        return P.random_init(points, k, self.next_seed())


@dataclass
class KMeansPlusPlus(Seeded):
    def centers(self, space, points, k):
        return P.kmeans_pp(space, points, k, self.next_seed())


@dataclass(frozen=True)
class LeastEnergy:
    """The best state of the collection window; the start competes."""

    def select(self, space, trajectory, how):
        return A.minimise_energy(trajectory, how)


@dataclass(frozen=True)
class MostFrequentNode:
    """The node that each center slot was closest to most often, as (run_slot, cid, state)."""

    def select(self, space, trajectory, how):
        return A.most_frequent_nodes(_graph(space), trajectory, how)


@dataclass(frozen=True)
class MostFrequentNodeUpdate:
    def update(self, space, labelled):
        graph = _graph(space)
        return U.node_centers(graph, U.most_frequent_node(graph, labelled))


@dataclass(frozen=True)
class LeastEnergyNodeUpdate:
    members_only: bool = False

    def update(self, space, labelled):
        graph = _graph(space)
        return U.node_centers(graph, U.least_energy_node(graph, labelled, self.members_only))


@dataclass(frozen=True)
class KarcherMeanUpdate:
    dim: int
    steps: int = 64
    tol: float = 1e-9

    def update(self, space, labelled):
        return U.karcher_mean(space, labelled, self.dim, self.steps, self.tol)


@dataclass(frozen=True)
class AnnealedMeanUpdate:
    how: A.Annealing = A.Annealing(1, robust_prop=0.1)
    seed: int = 0
    n_samples: int | None = None

    def update(self, space, labelled):
        found = A.frechet_means(space, labelled, self.how, self.seed, self.n_samples)
        if isinstance(space, GraphSpace):
            return found.select("cid", "center.u", "center.v", "center.pos")
        return found.select("cid", F.col("center").alias("x"))


@dataclass
class UniformNet(Seeded):
    def build(self, spark, space, n):
        return N.uniform_net(spark, space, n, self.next_seed())


@dataclass(frozen=True)
class FibonacciNet:
    def build(self, spark, space, n):
        return N.fibonacci_net(spark, n, space)


@dataclass(frozen=True)
class RepulsionNet:
    k: int = 12
    n_iter: int = 600
    riesz_s: float = 1.0
    cooling: float = 300.0
    seed: int = 0
    ambient: bool = False

    def build(self, spark, space, n):
        return N.repulsion_net(spark, space, n, self.k, self.n_iter, self.riesz_s, self.cooling, self.seed, self.ambient)


def sample_points(spark: SparkSession, space: Space, n: int, strategy: Sampling) -> DataFrame:
    if not isinstance(n, int) or n <= 0:
        raise ValueError(f"n must be a positive integer, got {n!r}")
    return strategy.sample(spark, space, n)


def lloyd(space: Space, points: DataFrame, k: int, update: Update, initialization: Initialization | None = None, max_iterations: int = 100, tolerance: float = 1e-4) -> tuple[DataFrame, float, int]:
    """(centers, energy, iterations), from k-means++ unless told otherwise."""
    start = (initialization or KMeansPlusPlus()).centers(space, points, k)
    return L.lloyd(space, points, start, lambda labelled: update.update(space, labelled), max_iterations, tolerance)


def anneal(space: Space, points: DataFrame, how: A.Annealing, seeds: list[int], robustification: Robustification | None = None, **kw) -> DataFrame:
    """One annealing per seed, and what the robustification selects of each."""
    from .plans.storage import stored

    found = stored(A.trajectories(space, points, A.run_table(points.sparkSession, seeds), how, **kw), "trajectories")
    return (robustification or LeastEnergy()).select(space, found, how)


def distinct_seeds(n: int, entropy: int = 0) -> list[int]:
    return np.random.default_rng(entropy).choice(2**31, n, replace=False).tolist()
