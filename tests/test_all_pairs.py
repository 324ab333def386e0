"""Queries over all pairs of nodes or points, on graphs with many ends that can't be told apart."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lattica.operators import diagnostics as D
from lattica.operators import graph as Q
from lattica.operators.spaces import GraphSpace
from lattica.plans import clustering_queries, registry


def comb(spark, ends):
    """A path of four nodes with a long middle, ends at each of them of two lengths, a loop and a doubled edge."""
    edges = [("a", "b", 1.0), ("b", "c", 5.0), ("c", "d", 1.5), ("b", "c", 6.0), ("c", "c", 2.0)]
    edges += [(f"{p}{i}", p, 0.5 + (i % 2) * 0.25) for p in "abcd" for i in range(ends)]
    edges = spark.createDataFrame([(*e, 1.0) for e in edges], "u string, v string, length double, weight double")
    names = sorted({r[0] for r in edges.select(F.explode(F.array("u", "v"))).collect()})
    nodes = spark.createDataFrame([(x, i, 3.0 if len(x) == 1 else 1.0 + (x == "a0")) for i, x in enumerate(names)], "node_id string, ord long, weight double")
    return Q.MetricGraph(nodes, edges)


def test_first_hops_look_up_no_table_of_pairs(spark):
    g = comb(spark, 2)
    got = {(r["s"], r["t"]): r["hop"] for r in Q.first_hops(g).collect()}
    assert "dist" not in g._cache
    step = {}
    for r in Q.both_ways(g.edges).collect():
        step[r["u"], r["v"]] = min(r["length"], step.get((r["u"], r["v"]), 1e9))
    dist = {(r["s"], r["t"]): r["d"] for r in g.node_dist.collect()}
    names = {s for s, _ in dist}
    want = {(s, t): min((round(n + dist[v, t], 9), v) for (u, v), n in step.items() if u == s)[1] for s in names for t in names if s != t}
    assert got == want
    apart = Q.MetricGraph(g.nodes, g.edges.where("not (u = 'b' and v = 'c')"))
    assert {(r["s"], r["t"]) for r in Q.first_hops(apart).collect()} == {(s, t) for s, t in want if (s[0] in "ab") == (t[0] in "ab")}


def test_distances_of_all_points_meet_by_edge(spark, monkeypatch):
    g = comb(spark, 2)
    rows = [("a", "b", 0.3), ("b", "a", 0.2), ("a", "b", 0.9), ("c", "c", 0.1), ("c", "c", 1.8), ("a0", "a", 0.0), ("d", "c", 1.0)]
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "point_id int, u string, v string, pos double")
    want = {(r["a_point_id"], r["b_point_id"]): r["d"] for r in g.pair_distances(p, p).collect()}

    def refused(*_):
        raise AssertionError("four lookups a pair")

    monkeypatch.setattr(Q.MetricGraph, "pair_distances", refused)
    half = {(r["i"], r["j"]): r["d"] for r in GraphSpace(g).pairs(p).collect()}
    assert half == pytest.approx({k: d for k, d in want.items() if k[0] < k[1]})
    assert {(r["i"], r["j"]): r["d"] for r in GraphSpace(g).pairs(p, p).collect()} == pytest.approx(want)


def test_potential_of_all_nodes_from_kinds(spark, monkeypatch):
    g = comb(spark, 5)
    want = {(r["i"], r["j"]): r["u"] for r in D.pair_potential(g.node_dist, g.nodes.select(F.col("node_id").alias("v"), F.col("weight").alias("nu"))).collect()}
    monkeypatch.setattr(D, "pair_potential", None)
    assert {(r["i"], r["j"]): r["u"] for r in D.node_potential(g).collect()} == pytest.approx(want)


def test_spectral_and_depth_of_all_nodes_from_kinds(spark):
    g = comb(spark, 16)
    u = D.pair_potential(g.node_dist, g.nodes.select(F.col("node_id").alias("v"), F.col("weight").alias("nu")))
    depth = D.critical_depth(g, u)
    assert depth > 0 and D.node_critical_depth(g) == pytest.approx(depth)
    full, kinds = ({r["node_id"]: r["label"] for r in t.collect()} for t in (D.spectral(D.rbf_affinity(g.node_dist), 3), D.node_spectral(g, 3)))
    assert full.keys() == kinds.keys() and len({(full[x], kinds[x]) for x in full}) == len(set(full.values())) == 3


def test_queries_on_more_nodes_than_a_matrix_holds(spark, monkeypatch):
    """2,004 nodes, which bas02, bas05 and bas06 refused."""
    registry.load()
    g = comb(spark, 500)
    monkeypatch.setattr(clustering_queries, "geo", lambda *_: SimpleNamespace(graph=g))
    labels = {r["node_id"]: r["label"] for r in registry.QUERIES["bas02_spectral"](spark, "").collect()}
    assert len(labels) == 2004 and len({labels[f"a{i}"] for i in range(2, 500)}) == 1
    depth = registry.QUERIES["bas05_critical_depth"](spark, "").first()[0]
    assert depth > 0 and registry.QUERIES["bas06_drift_calibration"](spark, "").first()[0] == pytest.approx(0.3 / depth)
