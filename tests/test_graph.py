"""Metric graphs: hand values for distances, routes, energies, validation and changes."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import energy as E
from lattica.operators import graph as Q
from lattica.operators.spaces import GraphSpace


def make(spark, edges, order=None):
    e = spark.createDataFrame([(str(u), str(v), float(n), 1.0) for u, v, n in edges], "u string, v string, length double, weight double")
    names = order or list(dict.fromkeys(str(x) for u, v, _ in edges for x in (u, v)))
    n = spark.createDataFrame([(x, i, 1.0) for i, x in enumerate(names)], "node_id string, ord long, weight double")
    return Q.MetricGraph(n, e)


def pts(spark, rows):
    return spark.createDataFrame([(i, i, str(u), str(v), float(p)) for i, (u, v, p) in enumerate(rows)], "point_id long, ord long, u string, v string, pos double")


def centers(spark, rows):
    return spark.createDataFrame([(i, str(u), str(v), float(p)) for i, (u, v, p) in enumerate(rows)], "cid int, u string, v string, pos double")


@pytest.fixture(scope="module")
def path5(spark):
    return make(spark, [(i, i + 1, 10) for i in range(4)])


def one_distance(graph, spark, a, b):
    row = GraphSpace(graph).pairs(pts(spark, [a]), pts(spark, [b])).collect()
    return row[0]["d"]


def test_house_distances(spark):
    house = make(spark, [(0, 1, 1), (1, 2, 2), (2, 3, 0.5), (3, 0, 1.5), (0, 2, 0.8)])
    d = {(r["s"], r["t"]): r["d"] for r in house.node_dist.collect()}
    assert d["0", "2"] == pytest.approx(0.8) and d["0", "3"] == pytest.approx(1.3) and d["1", "3"] == pytest.approx(2.3)
    for rounds in (32, 1):  # edge by edge, and by squaring
        joined = {(r["s"], r["t"]): r["d"] for r in house.joined_paths(rounds).collect()}
        assert joined.keys() == d.keys() and all(joined[k] == pytest.approx(d[k]) for k in d)
    assert house.diameter().first()["diameter"] == pytest.approx(2.3)


def test_searched_paths_equal_the_matrix(spark, monkeypatch):
    """Searches from every node, as larger graphs have them, with a loop, equal ways and, at last, a part out of reach."""
    edges = [(0, 1, 1), (1, 2, 2), (2, 3, 0.5), (3, 0, 1.5), (0, 2, 0.8), (3, 3, 1), (3, 4, 0.25), (4, 5, 0.25), (3, 5, 0.5)]
    names, dense = make(spark, edges).matrix()
    monkeypatch.setattr(Q, "DENSE_NODES", 1)
    graph = make(spark, edges)
    assert graph.matrix()[0] == names and graph.matrix()[1] == pytest.approx(dense)
    assert {(r["s"], r["t"]): r["d"] for r in graph.node_dist.collect()} == pytest.approx({(s, t): dense[i, j] for i, s in enumerate(names) for j, t in enumerate(names)})
    split = make(spark, [*edges, (8, 9, 1)])
    assert split.node_dist.where("s = '8'").count() == 2 and split.matrix()[1][0, -1] == float("inf")
    monkeypatch.setattr(Q, "MATRIX_NODES", 3)
    with pytest.raises(ValueError, match="more than 3 nodes"):
        make(spark, edges).matrix()


def lumpy(seed=1, n=60):
    """Edges of a tree with some chords, loops and parallel edges, whose last nodes are out of reach."""
    import random

    own = random.Random(seed)
    edges = [(own.randrange(i), i, own.randrange(1, 9) / 4) for i in range(1, n)]
    edges += [(own.randrange(20), own.randrange(20), own.randrange(1, 9) / 4) for _ in range(6)]
    return edges + [(3, 3, 0.5), (5, edges[4][0], 0.25), (n, n + 1, 30.0), (n + 1, n + 2, 1.0)]


def test_routes_equal_the_closure():
    import numpy as np

    from lattica.operators.routes import Routes

    for edges in (lumpy(), [(0, 1, 1.0)], [(i, i + 1, 1.0) for i in range(9)]):
        n = max(max(u, v) for u, v, _ in edges) + 1
        d = np.full((n, n), np.inf)
        np.fill_diagonal(d, 0.0)
        for u, v, length in edges:
            d[u, v] = d[v, u] = min(d[u, v], length)
        for k in range(n):
            np.minimum(d, d[:, k : k + 1] + d[k], out=d)
        routes = Routes(n, edges)
        assert np.array([routes[i] for i in range(n)]) == pytest.approx(d)
        assert np.array([[routes[i, j] for j in range(n)] for i in range(n)]) == pytest.approx(d)
        deep, longest = routes.reach()
        most = [deep[k] + routes.core_row(k) + deep for k in range(len(deep))]
        assert max([longest, *(w[j] for k, w in enumerate(most) for j in range(len(w)) if j != k and np.isfinite(w[j]))]) == pytest.approx(d[np.isfinite(d)].max())


def test_centers_and_diameter_of_a_large_graph_take_no_table_of_all_nodes(spark, monkeypatch):
    edges = lumpy()
    small = make(spark, edges[:-2])
    c = centers(spark, [(0, edges[0][1], 0.1), (*edges[20][:2], 0.2)])
    wanted = sorted(map(tuple, small.node_center_distances(c).collect())), small.diameter().first()[0]
    monkeypatch.setattr(Q, "DENSE_NODES", 1)
    monkeypatch.setattr(Q.MetricGraph, "searched_paths", lambda self: pytest.fail("all pairs"))
    large = make(spark, edges[:-2])
    assert sorted(map(tuple, large.node_center_distances(c).collect())) == [pytest.approx(x) for x in wanted[0]]
    assert large.diameter().first()[0] == pytest.approx(wanted[1])
    assert make(spark, edges).diameter().first()[0] == pytest.approx(31.0)
    monkeypatch.setattr(Q, "SEARCH_NODES", 1)
    joined = make(spark, edges[:-2])
    assert sorted(map(tuple, joined.node_center_distances(c).collect())) == [pytest.approx(x) for x in wanted[0]]


def test_distance_is_symmetric_and_knows_both_orientations(spark, path5):
    assert one_distance(path5, spark, (0, 1, 3), (1, 0, 2)) == pytest.approx(5)
    assert one_distance(path5, spark, (0, 1, 3), (2, 3, 4)) == pytest.approx(21)
    assert one_distance(path5, spark, (2, 3, 4), (0, 1, 3)) == pytest.approx(21)


def test_an_edge_may_be_longer_than_the_way_round(spark):
    trap = make(spark, [("d", "a", 1), ("a", "b", 10), ("a", "c", 1), ("c", "b", 1), ("b", "e", 1)])
    assert one_distance(trap, spark, ("a", "b", 1), ("a", "b", 9)) == pytest.approx(4)
    assert one_distance(trap, spark, ("a", "b", 4), ("a", "b", 6)) == pytest.approx(2)
    hops = {(r["s"], r["t"]): r["hop"] for r in Q.first_hops(trap).collect()}
    assert hops["a", "b"] == "c" and hops["d", "e"] == "a" and hops["e", "a"] == "b"


def test_self_loops_take_the_shorter_arc(spark):
    rose = make(spark, [(0, 0, 10), (0, 1, 1), (1, 1, 2)])
    assert one_distance(rose, spark, (0, 0, 1), (0, 0, 9)) == pytest.approx(2)
    assert one_distance(rose, spark, (0, 0, 8), (1, 1, 0.5)) == pytest.approx(3.5)
    d = GraphSpace(rose).assign(pts(spark, [(0, 0, 8), (0, 1, 0.5)]), centers(spark, [(0, 0, 9), (1, 1, 1)]))
    got = {r["point_id"]: (r["label"], r["d"]) for r in d.collect()}
    assert got[0] == (0, pytest.approx(1)) and got[1] == (0, pytest.approx(1.5))


def test_quantum_path(spark, path5):
    r = Q.quantum_path(path5, pts(spark, [(0, 1, 3)]), pts(spark, [(2, 3, 4)])).first()
    assert (r["distance"], r["exit"], r["entry"]) == (pytest.approx(21), "1", "2")
    r = Q.quantum_path(path5, pts(spark, [(0, 1, 3)]), pts(spark, [(1, 0, 4)])).first()
    assert (r["distance"], r["exit"], r["entry"]) == (pytest.approx(3), None, None)


def test_closest_node_and_reverse(spark, path5):
    p = path5.with_length(pts(spark, [(0, 1, 4.9), (0, 1, 5), (1, 0, 5), (3, 4, 10)]))
    assert [r[0] for r in p.orderBy("point_id").select(Q.closest_node()).collect()] == ["0", "1", "0", "4"]
    assert [r[0] for r in Q.reversed_points(p).orderBy("point_id").select("pos").collect()] == pytest.approx([5.1, 5, 5, 0])


def test_validation(spark, path5):
    bad = pts(spark, [(0, 1, 5), (0, 2, 1), (0, 1, 11), (1, 0, -1), (4, 3, 10)])
    assert sorted(r["point_id"] for r in path5.invalid_points(bad).collect()) == [1, 2, 3]
    assert path5.validate().require_connected() is path5
    with pytest.raises(ValueError):
        make(spark, [(0, 1, 1), (2, 3, 1)]).require_connected()
    with pytest.raises(ValueError):
        Q.MetricGraph(path5.nodes, path5.edges.withColumn("length", F.when(F.col("u") == "2", -1.0).otherwise(F.col("length")))).validate()
    for length in (0, -1, "1", True, None):
        with pytest.raises(ValueError):
            path5.add_edge("0", "9", length)


def test_changes_give_new_graphs(spark):
    g = make(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 5)])
    assert g.diameter().first()[0] == pytest.approx(2)
    cut = g.remove_edges(spark.createDataFrame([("c", "b")], "u string, v string"))
    assert cut.diameter().first()[0] == pytest.approx(6) and g.diameter().first()[0] == pytest.approx(2)
    more = g.add_edge("c", "d", 2.0)
    assert more.nodes.count() == 4 and more.diameter().first()[0] == pytest.approx(4)
    assert g.add_edge("c", "a", 0.5).edges.count() == 3
    assert g.remove_nodes(spark.createDataFrame([("b",)], "node_id string")).edges.collect()[0]["length"] == 5
    assert g.clear().nodes.count() == 0 and g.clear(edges_only=True).nodes.count() == 3
    assert g.add_nodes(spark.createDataFrame([("z",), ("a",)], "node_id string")).nodes.count() == 4


def test_register_observations_replaces(spark, path5):
    p = pts(spark, [(0, 1, 1), (0, 1, 9), (1, 2, 1)])
    once = path5.register_observations(p)
    again = Q.MetricGraph(once, path5.edges).register_observations(p)
    for n in (once, again):
        assert {r["node_id"]: r["obs_weight"] for r in n.collect()} == {"0": 1.0, "1": 2.0, "2": 0.0, "3": 0.0, "4": 0.0}


def test_nodes_as_points(spark, path5):
    got = {r["node_id"]: (r["u"], r["v"], r["pos"]) for r in path5.nodes_as_points().collect()}
    assert got["0"] == ("0", "1", 0.0) and got["2"] == ("2", "1", 0.0) and len(got) == 5


def test_energies(spark):
    g = make(spark, [(0, 1, 1), (1, 2, 2)])
    space, c = GraphSpace(g), centers(spark, [(0, 1, 0.5)])
    p = pts(spark, [(0, 1, 0.9), (1, 2, 0.6)])
    assert E.energy(space, c, "empirical", p).first()[0] == pytest.approx(0.685)
    assert E.energy(space, c, "uniform").first()[0] == pytest.approx((0.25 + 0.25 + 6.25) / 3)
    w = spark.createDataFrame([("0", 1.0), ("1", 0.0), ("2", 3.0)], "node_id string, obs_weight double")
    assert E.energy(space, c, "node_measure", observed=w).first()[0] == pytest.approx((0.25 + 3 * 6.25) / 4)
    assert E.node_energy(g, c).first()[0] == pytest.approx(6.75)
    for how, kw in (("obs", {}), ("uniform", {"observations": p}), ("empirical", {}), ("node_measure", {}), ("node_measure", {"observed": w.withColumn("obs_weight", F.lit(0.0))})):
        with pytest.raises(ValueError):
            E.energy(space, c, how, **kw)


def test_ties_go_to_the_lowest_center(spark, path5):
    c = centers(spark, [(0, 1, 10), (1, 2, 0), (0, 1, 0)])
    got = GraphSpace(path5).assign(pts(spark, [(0, 1, 10), (0, 1, 5)]), c).orderBy("point_id").collect()
    assert [r["label"] for r in got] == [0, 0]


def test_assign_agrees_with_all_distances(spark, path5):
    p, c = pts(spark, [(i % 4, i % 4 + 1, (i * 7) % 10) for i in range(30)]), centers(spark, [(0, 1, 3), (2, 1, 4), (3, 4, 9)])
    full = path5.center_distances(p, c).groupBy("point_id").agg(F.min_by("cid", F.struct(F.round("d", 9), "cid")).alias("label"), F.min("d").alias("d"))
    assert sorted(map(tuple, full.collect())) == sorted((r["point_id"], r["label"], r["d"]) for r in GraphSpace(path5).assign(p, c).collect())


def test_queries_over_all_points_and_nodes(spark, sf):
    from lattica.operators import diagnostics as D
    from lattica.plans import registry
    from lattica.plans.fixtures import geo

    registry.load()
    g = geo(spark, sf)
    run = lambda name: registry.QUERIES[name](spark, sf).collect()
    names, dist = g.graph.matrix()
    n, at = len(names), {x: i for i, x in enumerate(names)}
    nodes = run("geo02_node_distance")
    assert len(nodes) == n * (n - 1) // 2 and all(abs(r["d"] - dist[at[r["s"]], at[r["t"]]]) < 1e-5 for r in nodes)
    hops = run("join16_first_hop")
    assert len(hops) == n * (n - 1) and all(abs(dist[at[r["s"]], at[r["hop"]]] + dist[at[r["hop"]], at[r["t"]]] - dist[at[r["s"]], at[r["t"]]]) < 1e-6 for r in hops)
    points = {r["point_id"]: (at[r["u"]], at[r["v"]], r["pos"], r["length"]) for r in g.graph.with_length(g.points).collect()}

    def between(a, b):
        (u, v, x, length), (w, z, y, other) = points[a], points[b]
        ways = [dist[u, w] + x + y, dist[u, z] + x + other - y, dist[v, w] + length - x + y, dist[v, z] + length - x + other - y]
        return min(ways + ([abs(x - y)] if (u, v) == (w, z) else []))

    m = len(points)
    pairs = run("geo03_pair_distance")
    following = {(a, a + 1) for a in points if a + 1 in points}
    assert m > 41 and {(r["a"], r["b"]) for r in pairs} == following and len(pairs) == len(following) and all(abs(r["d"] - between(r["a"], r["b"])) < 1e-5 for r in pairs)
    assert {(r["a"], r["b"]) for r in run("geo05_distance")} == {(a, b) for a in points for b in points if a < b}
    path = {(r["a"], r["b"]): r["distance"] for r in run("geo04_quantum_path")}
    assert set(path) == {(a, b) for a, b in following if points[a][0] != points[b][0]} and all(abs(d - between(*k)) < 1e-5 for k, d in path.items())
    weight = {r["node_id"]: r["weight"] for r in g.graph.nodes.collect()}
    nu = [weight[x] for x in names]
    u = {(x, y): sum(w * min(dist[i, k], dist[j, k]) ** 2 for k, w in enumerate(nu)) for i, x in enumerate(names) for j, y in enumerate(names)}
    assert {(r["i"], r["j"]) for r in run("agg17_pair_potential")} == set(u)
    assert all(abs(r["u"] - u[r["i"], r["j"]]) < 1e-4 for r in run("agg17_pair_potential"))
    depth = D.critical_depth(g.graph, spark.createDataFrame([(*k, float(x)) for k, x in u.items()], "i string, j string, u double"))
    assert abs(run("bas05_critical_depth")[0]["c_star"] - depth) < 1e-6 and abs(run("bas06_drift_calibration")[0]["beta0"] - 0.3 / depth) < 1e-6
    events = spark.read.parquet(f"{sf}/events.parquet").collect()
    done = {r["event_id"] for r in events if r["event_id"] % 3 == 0 and r["event_type"] == "view"}
    assert {r["seed"] for r in run("snk03_missing_seeds")} == {r["event_id"] for r in events} - done
