import pytest
from pyspark.sql import functions as F

from lattica import strategies as S
from lattica.operators import annealing as A
from lattica.operators.spaces import GraphSpace, Sphere
from lattica.plans.storage import stored

from .test_graph import make, pts


@pytest.fixture(scope="module")
def graph(spark):
    return GraphSpace(make(spark, [(i, i + 1, 1) for i in range(6)]))


def test_sampling_strategies(spark, graph):
    for kind in (S.UniformNodes, S.UniformEdges, S.WeightedNodes):
        a, b = kind(3), kind(3)
        one, two, again = (sorted(map(tuple, s.sample(spark, graph, 20).collect())) for s in (a, a, b))
        assert one != two and one == again and len(one) == 20
    with pytest.raises(TypeError):
        S.UniformNodes().sample(spark, Sphere(2), 3)
    with pytest.raises(ValueError):
        S.sample_points(spark, graph, 0, S.UniformNodes())
    assert S.sample_points(spark, Sphere(2), 9, S.UniformOnManifold(1)).count() == 9
    assert len(set(S.distinct_seeds(50))) == 50


def test_lloyd_with_strategies(spark, graph):
    p = stored(pts(spark, [(0, 1, 0.1 * i) for i in range(5)] + [(5, 6, 0.1 * i) for i in range(5)]))
    for update in (S.LeastEnergyNodeUpdate(), S.LeastEnergyNodeUpdate(True), S.MostFrequentNodeUpdate(), S.AnnealedMeanUpdate()):
        centers, energy, n = S.lloyd(graph, p, 2, update, S.RandomObservations(1), 3)
        assert centers.count() == 2 and energy < 1 and 1 <= n <= 3


def test_lloyd_on_the_sphere(spark):
    p = stored(S.sample_points(spark, Sphere(2), 60, S.UniformOnManifold(2)))
    centers, energy, _ = S.lloyd(Sphere(2), p, 4, S.KarcherMeanUpdate(3), max_iterations=4)
    assert centers.count() == 4 and energy < 1 and centers.where(F.size("x") == 3).count() == 4


def test_annealing_with_strategies(spark, graph):
    p = stored(pts(spark, [(0, 1, 0.1 * i) for i in range(5)] + [(5, 6, 0.1 * i) for i in range(5)]))
    how = A.Annealing(2, robust_prop=0.5)
    assert S.anneal(graph, p, how, [1, 2]).count() == 2
    assert S.anneal(graph, p, how, [1], S.MostFrequentNode()).select("state").count() == 2


def test_nets(spark):
    for net in (S.UniformNet(1), S.FibonacciNet(), S.RepulsionNet(n_iter=5)):
        assert net.build(spark, Sphere(2), 30).count() == 30
