"""Queries over the metric graph: sources, constraints, distances, shortest paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as Q
from ..operators.spaces import GraphSpace
from ..sources import graphs as S
from ..sources import tables as T
from .fixtures import SQL_GEO, geo, sql_u, table
from .registry import BIAS, query, r, rounded

WITH = f"WITH RECURSIVE {SQL_GEO}\n"


@query("src01_star_pair", f"""
WITH side AS (SELECT unnest(['A', 'B']) AS s), one AS (SELECT s, unnest(range(1, 6)) AS i FROM side), two AS (SELECT s, i, unnest(range(1, 4)) AS j FROM one)
SELECT 'A0' AS u, 'B0' AS v, 2.0::double AS length UNION ALL SELECT s || '0', s || i, 1.0 FROM one UNION ALL SELECT s || i, s || i || '_' || j, 1.0 FROM two""")
def src01(spark, sf):
    return S.star_pair(spark)[1].select("u", "v", "length")


@query("src02_random_star_pair")
def src02(spark, sf):
    return S.random_star_pair(spark, lam_a=2.0, lam_b=1.0, seed=3)[1]


BLOCK_SQL = f"""WITH n AS (SELECT i, CASE WHEN i < 20 THEN 0 ELSE 1 END AS b FROM (SELECT unnest(range(0, 40)) AS i))
SELECT a.i::varchar AS u, z.i::varchar AS v, {{}} AS length FROM n AS a JOIN n AS z ON a.i < z.i WHERE {sql_u("11", "a.i", "z.i")} < CASE WHEN a.b = z.b THEN 0.8 ELSE 0.1 END"""


@query("src03_block_model", BLOCK_SQL.format("1.0::double"))
def src03(spark, sf):
    return S.block_model(spark, [20, 20], [[0.8, 0.1], [0.1, 0.8]], seed=11)[1].select("u", "v", "length")


@query("src04_block_lengths", BLOCK_SQL.format("CASE WHEN a.b = z.b THEN 1.0::double ELSE 4.0::double END"))
def src04(spark, sf):
    return S.block_model(spark, [20, 20], [[0.8, 0.1], [0.1, 0.8]], [[1.0, 4.0], [4.0, 1.0]], [1.0, 2.0], seed=11)[1].select("u", "v", "length")


@query("src05_import_graph", WITH + "SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v, 2.5::double AS length, 1.5::double AS weight FROM b")
def src05(spark, sf):
    return S.imported(Q.both_ways(geo(spark, sf).graph.edges), edge_length=2.5, edge_weight=1.5)[1]


@query("src06_complete_graph", "SELECT a.r_name AS u, b.r_name AS v, 1 + (b.r_regionkey - a.r_regionkey) * 0.5::double AS length FROM region AS a JOIN region AS b ON a.r_regionkey < b.r_regionkey")
def src06(spark, sf):
    objects = table(spark, sf, "region").select(F.col("r_name").alias("node_id"), F.col("r_regionkey").cast("long").alias("ord"))
    i, j = objects.select(F.col("ord").alias("i")), objects.select(F.col("ord").alias("j"))
    d = i.crossJoin(j).withColumn("d", F.when(F.col("i") == F.col("j"), 0.0).otherwise(1 + F.abs(F.col("i") - F.col("j")) * 0.5))
    return S.complete(objects, d)[1].select("u", "v", "length")


@query("snk02_latex_values", "SELECT '\\newcommand{\\' || regexp_replace(r_name, '[^A-Za-z]', '', 'g') || '}{' || printf('%.3f', r_regionkey * 1.5::double) || '}' AS value FROM region")
def snk02(spark, sf):
    return T.latex_values(table(spark, sf, "region").withColumn("x", F.col("r_regionkey") * 1.5), "r_name", "x")


@query("snk03_missing_seeds", "SELECT DISTINCT event_id AS seed FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_type = 'view')")
def snk03(spark, sf):
    e = table(spark, sf, "events")
    done = e.where("event_id % 3 = 0").select(F.col("event_id").alias("seed"), F.col("event_type").alias("config_hash"), F.lit("x").alias("code_hash"))
    return T.missing_seeds(e.select(F.col("event_id").alias("seed")).distinct(), done, "view", "x")


@query("ddl01_add_edge", WITH + "SELECT u, v, length FROM e WHERE NOT (least(u, v) = 'N0' AND greatest(u, v) = 'R0') UNION ALL SELECT 'N0', 'R0', 7.5 UNION ALL SELECT 'N0', 'X1', 2.0")
def ddl01(spark, sf):
    return geo(spark, sf).graph.add_edge("N0", "R0", 7.5).add_edge("N0", "X1", 2.0).edges.select("u", "v", "length")


@query("ddl03_remove_node", WITH + "SELECT u, v, length FROM e WHERE u <> 'N3' AND v <> 'N3' AND NOT (least(u, v) = 'R0' AND greatest(u, v) = 'R1')")
def ddl03(spark, sf):
    g = geo(spark, sf).graph
    return g.remove_nodes(spark.createDataFrame([("N3",)], "node_id string")).remove_edges(spark.createDataFrame([("R1", "R0")], "u string, v string")).edges.select("u", "v", "length")


@query("ddl06_invalid_edges", WITH + "SELECT u, v FROM (SELECT u, v, CASE WHEN u LIKE 'S1%' THEN 0.6 - length WHEN u LIKE 'S2%' THEN NULL ELSE length END AS length FROM e) WHERE length IS NULL OR length <= 0")
def ddl06(spark, sf):
    g = geo(spark, sf).graph
    bad = g.edges.withColumn("length", F.when(F.col("u").startswith("S1"), 0.6 - F.col("length")).when(~F.col("u").startswith("S2"), F.col("length")))
    return Q.MetricGraph(g.nodes, bad).invalid_edges().select("u", "v")


@query("ddl07_components", WITH + """, bb AS (SELECT * FROM b WHERE u NOT LIKE 'R%' OR v NOT LIKE 'R%'), cc(node_id, m) AS (SELECT node_id, node_id FROM n UNION SELECT cc.node_id, bb.v FROM cc JOIN bb ON cc.m = bb.u)
SELECT node_id, min(m) AS component FROM cc GROUP BY node_id""")
def ddl07(spark, sf):
    g = geo(spark, sf).graph
    return Q.MetricGraph(g.nodes, g.edges.where(~(F.col("u").startswith("R") & F.col("v").startswith("R")))).components()


@query("ddl08_invalid_points", WITH + "SELECT point_id FROM (SELECT point_id, CASE WHEN point_id % 10 = 0 THEN pos + 1.5 ELSE pos END AS pos, CASE WHEN point_id % 7 = 0 THEN 'Q' ELSE u END AS u, v, length FROM p) WHERE u = 'Q' OR pos > length")
def ddl08(spark, sf):
    g = geo(spark, sf)
    bad = g.points.withColumns({"pos": F.when(F.col("point_id") % 10 == 0, F.col("pos") + 1.5).otherwise(F.col("pos")), "u": F.when(F.col("point_id") % 7 == 0, "Q").otherwise(F.col("u"))})
    return g.graph.invalid_points(bad).select("point_id")


@query("ddl12_register_observations", WITH + "SELECT node_id, obs_weight FROM ow")
def ddl12(spark, sf):
    g = geo(spark, sf)
    return g.graph.register_observations(g.points).select("node_id", "obs_weight")


def pairs(g):
    """Every point with the next one."""
    return g.points, g.points, F.col("b_point_id") == F.col("a_point_id") + 1


PAIRS = """, q AS (
  SELECT a.point_id AS a, z.point_id AS b, a.u AS au, a.v AS av, z.u AS bu, z.v AS bv,
    CASE WHEN a.u = z.u AND a.v = z.v THEN abs(a.pos - z.pos) ELSE 1e300 END AS on_edge,
    a.pos + d1.d + z.pos AS r0, a.pos + d2.d + z.length - z.pos AS r1, a.length - a.pos + d3.d + z.pos AS r2, a.length - a.pos + d4.d + z.length - z.pos AS r3
  FROM p AS a JOIN p AS z ON z.point_id = a.point_id + 1
  JOIN nd AS d1 ON d1.s = a.u AND d1.t = z.u JOIN nd AS d2 ON d2.s = a.u AND d2.t = z.v JOIN nd AS d3 ON d3.s = a.v AND d3.t = z.u JOIN nd AS d4 ON d4.s = a.v AND d4.t = z.v)
"""


@query("geo01_edge_length", WITH + "SELECT point_id, b.length FROM p JOIN b ON p.v = b.u AND p.u = b.v")
def geo01(spark, sf):
    g = geo(spark, sf)
    return g.graph.with_length(Q.reversed_points(g.graph.with_length(g.points))).select("point_id", "length")


@query("geo02_node_distance", WITH + f"SELECT s, t, {r('d')} AS d FROM nd WHERE s < t")
def geo02(spark, sf):
    return geo(spark, sf).graph.node_dist.where("s < t").select("s", "t", rounded("d", "d"))


@query("geo03_pair_distance", WITH + PAIRS + f"SELECT a, b, {r('least(r0, r1, r2, r3, on_edge)')} AS d FROM q")
def geo03(spark, sf):
    g = geo(spark, sf)
    return g.graph.pair_distances(*pairs(g)).select(F.col("a_point_id").alias("a"), F.col("b_point_id").alias("b"), rounded("d", "d"))


@query("geo04_quantum_path", WITH + PAIRS + f"""SELECT a, b, {r('least(r0, r1, r2, r3, on_edge)')} AS distance,
  CASE WHEN on_edge < least(r0, r1, r2, r3) THEN NULL WHEN least(r0, r1) <= least(r2, r3) THEN au ELSE av END AS exit,
  CASE WHEN on_edge < least(r0, r1, r2, r3) THEN NULL WHEN least(r0, r1) <= least(r2, r3) THEN CASE WHEN r0 <= r1 THEN bu ELSE bv END ELSE CASE WHEN r2 <= r3 THEN bu ELSE bv END END AS entry FROM q WHERE au <> bu""")
def geo04(spark, sf):
    g = geo(spark, sf)
    a, b, on = pairs(g)
    return Q.quantum_path(g.graph, a, b, on & (F.col("a_u") != F.col("b_u"))).select(F.col("a_point_id").alias("a"), F.col("b_point_id").alias("b"), rounded("distance", "distance"), "exit", "entry")


@query("geo05_distance", WITH + PAIRS.replace("z.point_id = a.point_id + 1", "a.point_id < z.point_id") + f"SELECT a, b, {r('least(r0, r1, r2, r3, on_edge)')} AS d FROM q")
def geo05(spark, sf):
    """All pairs of points, by definition of the space's own method."""
    g = geo(spark, sf)
    # As rounded(), of numbers that are not negative, without decimals made for each of very many rows.
    d = F.floor((F.col("d") + BIAS) * 1e6 + 0.5) / F.lit(1e6)
    return GraphSpace(g.graph).pairs(g.points).select(F.col("i").alias("a"), F.col("j").alias("b"), d.alias("d"))


@query("geo06_closest_node", WITH + "SELECT point_id, node_id FROM cn")
def geo06(spark, sf):
    g = geo(spark, sf)
    return g.graph.with_length(g.points).select("point_id", Q.closest_node().alias("node_id"))


@query("geo07_reverse", WITH + f"SELECT point_id, v AS u, u AS v, {r('length - pos')} AS pos FROM p")
def geo07(spark, sf):
    g = geo(spark, sf)
    return Q.reversed_points(g.graph.with_length(g.points)).select("point_id", "u", "v", rounded("pos", "pos"))


FIRST = "SELECT b.u AS node_id, arg_min(b.v, n.ord) AS v, arg_min(b.length, n.ord) AS length FROM b JOIN n ON n.node_id = b.v GROUP BY b.u"


@query("geo08_nodes_as_points", WITH + f"SELECT node_id, node_id AS u, v, 0.0::double AS pos, length FROM ({FIRST})")
def geo08(spark, sf):
    return geo(spark, sf).graph.nodes_as_points().select("node_id", "u", "v", "pos", "length")


@query("geo09_nodes_as_centers", WITH + f"SELECT (ord / 3)::int AS cid, node_id AS u, v, 0.0::double AS pos FROM ({FIRST}) JOIN n USING (node_id) WHERE ord % 3 = 0")
def geo09(spark, sf):
    from ..operators.updates import node_centers

    g = geo(spark, sf).graph
    return node_centers(g, g.nodes.where("ord % 3 = 0").select("node_id", (F.col("ord") / 3).cast("int").alias("label")))


@query("join03_center_distances", WITH + f"SELECT point_id, cid, {r('d')} AS d FROM pc")
def join03(spark, sf):
    g = geo(spark, sf)
    return g.graph.center_distances(g.points, g.centers).select("point_id", "cid", rounded("d", "d"))


@query("join04_node_center_distances", WITH + f"SELECT node_id, cid, {r('d')} AS d FROM nc")
def join04(spark, sf):
    g = geo(spark, sf)
    return g.graph.node_center_distances(g.centers).select("node_id", "cid", rounded("d", "d"))


@query("join06_points_at_nodes", WITH + f""", a AS (SELECT point_id, u AS node_id FROM p WHERE pos = 0 UNION ALL SELECT point_id, v FROM p WHERE abs(pos - length) < 1e-10 AND pos <> 0)
SELECT a.point_id AS i, z.point_id AS j, {r('d')} AS d FROM a JOIN a AS z ON a.point_id < z.point_id JOIN nd ON nd.s = a.node_id AND nd.t = z.node_id""")
def join06(spark, sf):
    g = geo(spark, sf)
    p = g.graph.with_length(g.points)
    at = p.where((F.col("pos") == 0) | (F.abs(F.col("pos") - F.col("length")) < 1e-10)).select("point_id", F.when(F.col("pos") == 0, F.col("u")).otherwise(F.col("v")).alias("node"))
    a, b = at.toDF("i", "s"), at.toDF("j", "t")
    return a.join(b, F.col("i") < F.col("j")).join(g.graph.node_dist, ["s", "t"]).select("i", "j", rounded("d", "d"))


@query("join07_all_pairs", WITH + f"SELECT s, t, {r('d')} AS d FROM nd")
def join07(spark, sf):
    return geo(spark, sf).graph.joined_paths().select("s", "t", rounded("d", "d"))


@query("join08_distance_matrix", WITH + f"SELECT s.ord AS i, t.ord AS j, {r('d')} AS d FROM nd JOIN n AS s ON s.node_id = nd.s JOIN n AS t ON t.node_id = nd.t WHERE s.ord <= t.ord")
def join08(spark, sf):
    g = geo(spark, sf).graph
    ords = F.broadcast(g.nodes.select("node_id", "ord"))
    x = g.node_dist.join(ords.toDF("s", "i"), "s").join(ords.toDF("t", "j"), "t")
    return x.where("i <= j").select("i", "j", rounded("d", "d"))


@query("join16_first_hop", WITH + """, w AS (SELECT b.u AS s, nd.t, b.v AS hop, round(b.length + nd.d, 9) AS d FROM b JOIN nd ON nd.s = b.v WHERE b.u <> nd.t)
SELECT s, t, arg_min(hop, (d, hop)) AS hop FROM w GROUP BY s, t""")
def join16(spark, sf):
    return Q.first_hops(geo(spark, sf).graph)

