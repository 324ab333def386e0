"""Metric graphs as DataFrames: validation, changes, shortest paths, and distances between points on edges.

A point is (u, v, pos): pos from u along the edge (u, v), in either orientation of the stored edge. Graphs are values: a
change gives a new one, so that derived distances can't go stale.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.storage import stored
from .routes import Routes

#: Up to so many nodes, shortest paths are found on the driver (the matrix has at most 32 MB).
DENSE_NODES = 2_000
#: Up to so many nodes, all distances may be one matrix, as annealing on a graph takes it (at most 512 MB).
MATRIX_NODES = 8_000
#: Up to so many nodes and edges, graphs are shipped to tasks that search from some nodes each; beyond, paths are joined.
SEARCH_NODES, SEARCH_EDGES = 200_000, 1_000_000
#: Centers are few; tables of nodes x centers up to so many rows are broadcast.
BROADCAST_ROWS = 1_000_000
#: Points on up to so many edges meet by a table of all pairs of these (at most a million rows).
FEW_EDGES = 1_000
FAR = 1e300


def both_ways(edges: DataFrame) -> DataFrame:
    """Directed view: every edge from each of its ends, a self-loop once."""
    e = edges.select("u", "v", "length")
    return e.unionAll(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "length"))


def _packed(names: list[str], source: int, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"i": pa.array([source]), "d": pa.array([d.tobytes()], pa.binary())})


def _reached(names: list[str], source: int, d: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(np.isfinite(d))
    return pa.RecordBatch.from_pydict({"s": pa.array([names[source]] * len(at), pa.string()), "t": pa.array([names[i] for i in at], pa.string()), "d": pa.array(d[at])})


@dataclass(frozen=True)
class MetricGraph:
    nodes: DataFrame
    edges: DataFrame
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def few_nodes(self) -> bool:
        """Whether tables with a row per node may be broadcast."""
        if "few" not in self._cache:
            self._cache["few"] = self.nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return self._cache["few"]

    # Validation.

    def invalid_edges(self) -> DataFrame:
        """Edges whose length is missing or not positive."""
        return self.edges.where(F.col("length").isNull() | F.isnan("length") | (F.col("length") <= 0))

    def validate(self) -> "MetricGraph":
        if not self.invalid_edges().isEmpty():
            raise ValueError("every edge needs a positive length")
        return self

    def components(self) -> DataFrame:
        """(node_id, component): the smallest node id that can be reached, by spreading minima until nothing changes."""
        b = both_ways(self.edges).select("u", "v")
        now = stored(self.nodes.select("node_id", F.col("node_id").alias("component")))
        while True:
            heard = now.join(b, now["node_id"] == b["u"]).groupBy(F.col("v").alias("node_id")).agg(F.min("component").alias("heard"))
            new = now.join(heard, "node_id", "left").select("node_id", F.least("component", F.coalesce("heard", "component")).alias("component"))
            up = new.select(F.col("node_id").alias("component"), F.col("component").alias("top"))
            new = stored(new.join(up, "component", "left").select("node_id", F.least("component", F.coalesce("top", "component")).alias("component")))
            if new.exceptAll(now).isEmpty():
                return new
            now = new

    def require_connected(self) -> "MetricGraph":
        n = self.components().agg(F.countDistinct("component")).first()[0]
        if n > 1:
            raise ValueError(f"the graph must be connected; it has {n} components")
        return self

    # Changes: each gives a new graph.

    def add_edge(self, u, v, length: float, weight: float = 1.0) -> "MetricGraph":
        if isinstance(length, bool) or not isinstance(length, (int, float)) or not length > 0:
            raise ValueError(f"length must be a positive number, got {length!r}")
        return self.add_edges(self.spark.createDataFrame([(str(u), str(v), float(length), float(weight))], "u string, v string, length double, weight double"))

    def add_edges(self, edges: DataFrame) -> "MetricGraph":
        """Bulk addition; lengths are not looked at before validate() or distances. An edge that is there is replaced."""
        key = [F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")]
        new = edges.select("u", "v", "length", (F.col("weight") if "weight" in edges.columns else F.lit(1.0)).alias("weight"))
        old = self.edges.select("u", "v", "length", "weight", *key).join(new.select(*key), ["x", "y"], "left_anti").drop("x", "y")
        missing = new.select(F.explode(F.array("u", "v")).alias("node_id")).distinct().join(self.nodes, "node_id", "left_anti")
        return MetricGraph(self._with_nodes(missing), old.unionByName(new))

    def add_nodes(self, nodes: DataFrame) -> "MetricGraph":
        return MetricGraph(self._with_nodes(nodes.join(self.nodes, "node_id", "left_anti")), self.edges)

    def _with_nodes(self, new: DataFrame) -> DataFrame:
        top = self.nodes.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
        rows = new.withColumn("ord", F.row_number().over(Window.orderBy("node_id")) + F.lit(top))
        return self.nodes.unionByName(rows.select("node_id", F.col("ord").cast("long"), (F.col("weight") if "weight" in new.columns else F.lit(1.0)).alias("weight")), allowMissingColumns=True)

    def remove_edges(self, edges: DataFrame) -> "MetricGraph":
        gone = edges.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).distinct()
        rest = self.edges.join(gone, (F.least(self.edges["u"], self.edges["v"]) == gone["x"]) & (F.greatest(self.edges["u"], self.edges["v"]) == gone["y"]), "left_anti")
        return MetricGraph(self.nodes, rest)

    def remove_nodes(self, nodes: DataFrame) -> "MetricGraph":
        """Without these nodes and all edges at them."""
        gone = nodes.select("node_id").distinct()
        rest = self.edges.join(gone.withColumnRenamed("node_id", "u"), "u", "left_anti").join(gone.withColumnRenamed("node_id", "v"), "v", "left_anti")
        return MetricGraph(self.nodes.join(gone, "node_id", "left_anti"), rest)

    def clear(self, edges_only: bool = False) -> "MetricGraph":
        return MetricGraph(self.nodes if edges_only else self.nodes.limit(0), self.edges.limit(0))

    # Shortest paths.

    @property
    def node_dist(self) -> DataFrame:
        """(s, t, d) between all nodes; found once per graph."""
        if "dist" not in self._cache:
            self._cache["dist"] = self.dense_paths() if self.size <= DENSE_NODES else self.searched_paths() if self.searchable else self.joined_paths()
        return self._cache["dist"]

    @property
    def size(self) -> int:
        """The number of nodes, up to one more than SEARCH_NODES."""
        if "size" not in self._cache:
            self._cache["size"] = self.nodes.limit(SEARCH_NODES + 1).count()
        return self._cache["size"]

    @property
    def searchable(self) -> bool:
        """Whether the graph may be shipped to tasks."""
        if "searchable" not in self._cache:
            self._cache["searchable"] = self.size <= SEARCH_NODES and self.edges.limit(SEARCH_EDGES + 1).count() <= SEARCH_EDGES
        return self._cache["searchable"]

    def dist_from(self, sources: DataFrame) -> DataFrame:
        """(s, t, d) from the nodes of sources (node_id) to all nodes, without those from others where the graph is large."""
        if "dist" in self._cache or self.size <= DENSE_NODES:
            return self.node_dist
        sources = stored(sources.select("node_id").distinct(), "sources")
        if not self.searchable:
            return self.joined_paths(sources=sources)
        if sources.count() > self.size // 2:
            return self.node_dist
        wanted = {r["node_id"] for r in sources.collect()}  # fewer than the graph's nodes, which are collected anyway
        return stored(self._searched(self._names(SEARCH_NODES), _reached, "s string, t string, d double", wanted))

    def matrix(self) -> tuple[list[str], np.ndarray]:
        """Nodes by ord and their distances, for graphs of at most MATRIX_NODES nodes."""
        if "matrix" not in self._cache:
            names = self._names(MATRIX_NODES)
            d = np.full((len(names),) * 2, np.inf)
            if len(names) > DENSE_NODES:
                # Searched in parallel and stored first, as a local iterator would run one task after the other.
                for r in stored(self._searched(names, _packed, "i long, d binary")).toLocalIterator():
                    d[r["i"]] = np.frombuffer(r["d"])
            else:
                np.fill_diagonal(d, 0.0)
                for i, j, length in self._ends(names):
                    d[i, j] = d[j, i] = min(d[i, j], length)
                for k in range(len(names)):
                    np.minimum(d, d[:, k : k + 1] + d[k], out=d)
            self._cache["matrix"] = names, d
        return self._cache["matrix"]

    def local(self) -> tuple[list[str], list[tuple[int, int, float]], np.ndarray | Routes]:
        """Nodes by ord, edges by their numbers, and distances: the matrix of up to DENSE_NODES nodes, else Routes."""
        if self.size <= DENSE_NODES:
            names, dist = self.matrix()
            return names, self._ends(names), dist
        names = self._names(BROADCAST_ROWS)
        ends = self._ends(names)
        return names, ends, Routes(len(names), ends)

    def _names(self, most: int) -> list[str]:
        names = [r["node_id"] for r in self.nodes.select("node_id", "ord").orderBy("ord", "node_id").limit(most + 1).collect()]
        if len(names) > most:
            raise ValueError(f"more than {most} nodes: use node_dist")
        return names

    def _ends(self, names: list[str]) -> list[tuple[int, int, float]]:
        """Edges by the numbers of their ends; at most SEARCH_EDGES, or DENSE_NODES squared."""
        at, most = {x: i for i, x in enumerate(names)}, max(SEARCH_EDGES, DENSE_NODES**2)
        rows = self.edges.select("u", "v", "length").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} edges: use node_dist")
        return [(at[r["u"]], at[r["v"]], r["length"]) for r in rows]

    def _searched(self, names: list[str], told, schema: str, sources: set[str] | None = None) -> DataFrame:
        """What told(names, source, distances) makes of the distances of every node, or of some; each task searches from a part of them."""
        ends, n = self._ends(names), len(names)
        wanted = None if sources is None else [i for i, x in enumerate(names) if x in sources]
        count = n if wanted is None else len(wanted)

        def run(batches):
            routes = Routes(n, ends)
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    source = k if wanted is None else wanted[k]
                    yield told(names, source, routes[source])

        return self.spark.range(0, count, 1, max(1, min(count, 4 * self.spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)

    def searched_paths(self) -> DataFrame:
        """(s, t, d) by a search from every node over the whole graph, which every task holds; nodes out of reach have no row."""
        return stored(self._searched(self._names(SEARCH_NODES), _reached, "s string, t string, d double"))

    def dense_paths(self) -> DataFrame:
        names, d = self.matrix()
        if np.isinf(d).any():
            raise ValueError("the graph must be connected")
        import pandas as pd

        s, t = np.meshgrid(np.array(names, object), np.array(names, object), indexing="ij")
        frame = pd.DataFrame({"s": s.ravel(), "t": t.ravel(), "d": d.ravel()})
        return stored(self.spark.createDataFrame(frame, "s string, t string, d double"))

    def joined_paths(self, rounds: int = 32, sources: DataFrame | None = None) -> DataFrame:
        """Shortest paths by joins, all or those from sources (node_id), which are never squared. Each round extends the paths that the last one shortened by one edge, so that a sparse
        graph costs nodes x nodes x degree rows a round; a graph with paths of more edges than rounds goes on to squaring."""
        steps = stored(both_ways(self.edges).groupBy("u", "v").agg(F.min("length").alias("length")), "edges")
        now = front = stored((self.nodes if sources is None else sources).select(F.col("node_id").alias("s"), F.col("node_id").alias("t"), F.lit(0.0).alias("d")))
        for _ in range(rounds) if sources is None else itertools.count():
            longer = front.join(steps, front["t"] == steps["u"]).groupBy("s", F.col("v").alias("t")).agg(F.min(F.col("d") + F.col("length")).alias("new"))
            both = now.join(longer, ["s", "t"], "full").withColumn("shorter", F.col("d").isNull() | (F.col("new") < F.col("d") - 1e-12))
            both = stored(both.select("s", "t", F.when(F.col("shorter"), F.col("new")).otherwise(F.col("d")).alias("d"), F.coalesce("shorter", F.lit(False)).alias("shorter")))
            now, front = both.select("s", "t", "d"), both.where("shorter").select("s", "t", "d")
            if front.isEmpty():
                return now
        return self.squared_paths(now)

    def squared_paths(self, now: DataFrame) -> DataFrame:
        """Min-plus squaring of (s, t, d): paths of twice as many edges in each round, until none gets shorter."""
        mark = now.agg(F.count("*"), F.sum("d")).first()
        while True:
            again = now.select(F.col("s").alias("t"), F.col("t").alias("far"), F.col("d").alias("more"))
            now = stored(now.join(again, "t").groupBy("s", F.col("far").alias("t")).agg(F.min(F.col("d") + F.col("more")).alias("d")))
            new = now.agg(F.count("*"), F.sum("d")).first()
            if mark[0] == new[0] and abs((new[1] or 0) - (mark[1] or 0)) <= 1e-9 * max(1.0, new[1] or 0):
                return now
            mark = new

    def diameter(self) -> DataFrame:
        """The longest of all shortest paths between nodes that reach each other."""
        if "dist" in self._cache or self.size <= DENSE_NODES or not self.searchable:
            return self.node_dist.agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("diameter"))
        # Between two trees of the core the longest way joins their deepest nodes, so only the core is searched.
        names = self._names(SEARCH_NODES)
        ends, n = self._ends(names), len(names)
        core = len(Routes(n, ends).core)

        def run(batches):
            routes = Routes(n, ends)
            deep, most = routes.reach()
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    way = deep[k] + routes.core_row(k) + deep
                    way[k] = 0.0  # within one tree
                    most = max(most, float(way[np.isfinite(way)].max()))
            yield pa.RecordBatch.from_pydict({"d": pa.array([most])})

        parts = max(1, min(core, 4 * self.spark.sparkContext.defaultParallelism))
        return self.spark.range(0, core, 1, parts).mapInArrow(run, "d double").agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("diameter"))

    # Points.

    def with_length(self, points: DataFrame) -> DataFrame:
        """points on existing edges, in either orientation, with the edge's length."""
        return points.drop("length").join(both_ways(self.edges), ["u", "v"])

    def invalid_points(self, points: DataFrame) -> DataFrame:
        """Points off the graph: on no edge, or outside [0, length]."""
        ok = self.with_length(points).where((F.col("pos") >= 0) & (F.col("pos") <= F.col("length"))).select("point_id")
        return points.join(ok, "point_id", "left_anti")

    def register_observations(self, points: DataFrame) -> DataFrame:
        """nodes with obs_weight: how many points are closest to each (replacing any there was)."""
        n = self.with_length(points).groupBy(closest_node().alias("node_id")).agg(F.count("*").cast("double").alias("obs_weight"))
        return self.nodes.drop("obs_weight").join(n, "node_id", "left").withColumn("obs_weight", F.coalesce("obs_weight", F.lit(0.0)))

    def nodes_as_points(self) -> DataFrame:
        """Each node at position 0 of the edge to its first neighbour by ord; nodes without neighbour are refused."""
        b = both_ways(self.edges).join(self.nodes.select(F.col("node_id").alias("v"), F.col("ord").alias("o")), "v")
        first = b.groupBy("u").agg(F.min_by(F.struct("v", "length"), "o").alias("e"))
        return self.nodes.join(first, self.nodes["node_id"] == first["u"]).select("node_id", "ord", "u", F.col("e.v").alias("v"), F.lit(0.0).alias("pos"), F.col("e.length").alias("length"))

    def node_center_distances(self, centers: DataFrame) -> DataFrame:
        """(node_id, cid, d): least of the two ways round the center's edge."""
        c = self.with_length(centers).select("cid", F.col("u").alias("cu"), F.col("v").alias("cv"), F.col("pos").alias("cpos"), F.col("length").alias("clen"))
        dist = self.dist_from(c.select(F.explode(F.array("cu", "cv")).alias("node_id")))
        du, dv = dist.toDF("cu", "node_id", "du"), dist.toDF("cv", "nv", "dv")
        near = F.broadcast(c).join(du, "cu").join(dv, (F.col("node_id") == F.col("nv")) & (dv["cv"] == c["cv"]))
        return near.select("node_id", "cid", F.least(F.col("cpos") + F.col("du"), F.col("clen") - F.col("cpos") + F.col("dv")).alias("d"))

    def center_distances(self, points: DataFrame, centers: DataFrame) -> DataFrame:
        """points (with length) x centers with d, the geodesic distance.

        The centers' distances to all nodes are found first, so that a point takes two equi-joins on its ends and no
        four-fold lookup; the shares of one edge are compared beside that.
        """
        near = self.node_center_distances(centers)
        own = self.with_length(centers).select("cid", F.col("u").alias("cu"), F.col("v").alias("cv"), F.col("pos").alias("cpos"))
        p = self.with_length(points)
        x = p.join(near.toDF("u", "cid", "du"), "u")
        x = x.join(near.toDF("v", "cid", "dv"), ["v", "cid"]).join(F.broadcast(own), "cid")
        route = F.least(F.col("pos") + F.col("du"), F.col("length") - F.col("pos") + F.col("dv"))
        return x.withColumn("d", F.least(route, same_edge())).drop("du", "dv", "cu", "cv", "cpos")

    def all_distances(self, a: DataFrame, b: DataFrame | None = None) -> DataFrame:
        """(i, j, d) of all pairs of points of a and b, or of a with i < j. Where points lie on up to FEW_EDGES edges, the ways
        between each two of these are found once and sent with the points of one side to those of the other."""
        within, b = b is None, a if b is None else b
        sides = [self.with_length(x).select("point_id", "u", "v", "pos", "length") for x in (a, b)]
        used = sides[0].select("u", "v") if within else sides[0].select("u", "v").unionAll(sides[1].select("u", "v"))
        on = sorted((r["u"], r["v"]) for r in used.distinct().limit(FEW_EDGES + 1).collect())
        if len(on) > FEW_EDGES or b.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            x = self.pair_distances(a, b, F.col("a_point_id") < F.col("b_point_id") if within else None)
            return x.select(F.col("a_point_id").alias("i"), F.col("b_point_id").alias("j"), "d")
        edges = self.spark.createDataFrame([(k, *x) for k, x in enumerate(on)], "e int, u string, v string")
        dist = self.dist_from(edges.select(F.explode(F.array("u", "v")).alias("node_id")))
        ways = edges.toDF("x", "a_u", "a_v").crossJoin(edges.toDF("y", "b_u", "b_v"))
        for i in "uv":
            for j in "uv":
                ways = ways.join(dist.toDF(f"a_{i}", f"b_{j}", f"d{i}{j}"), [f"a_{i}", f"b_{j}"])
        same = (F.col("a_u") == F.col("b_u")) & (F.col("a_v") == F.col("b_v"))
        turned = (F.col("a_u") == F.col("b_v")) & (F.col("a_v") == F.col("b_u"))
        ways = stored(ways.select("x", "y", "duu", "duv", "dvu", "dvv", F.when(same & turned, 3).when(same, 1).when(turned, 2).otherwise(0).alias("share")), "ways")
        left = sides[0].join(F.broadcast(edges), ["u", "v"]).select(F.col("point_id").alias("i"), F.col("e").alias("x"), F.col("pos").alias("a_pos"), F.col("length").alias("a_length"))
        right = stored(sides[1].join(F.broadcast(edges), ["u", "v"]).select(F.col("point_id").alias("j"), F.col("e").alias("y"), F.col("pos").alias("b_pos"), F.col("length").alias("b_length")), "points")
        x = left.repartition(4 * self.spark.sparkContext.defaultParallelism).join(F.broadcast(ways), "x")
        x = x.join(F.broadcast(right), (x["y"] == right["y"]) & (F.col("i") < F.col("j")) if within else x["y"] == right["y"])
        arc, share = F.abs(F.col("a_pos") - F.col("b_pos")), F.col("share")
        along = F.when(share == 0, F.lit(FAR)).when(share == 1, arc).when(share == 2, F.abs(F.col("a_length") - F.col("a_pos") - F.col("b_pos"))).otherwise(F.least(arc, F.col("a_length") - arc))
        return x.select("i", "j", F.least(*routes(), along).alias("d"))

    def pair_distances(self, a: DataFrame, b: DataFrame, on: Column | None = None) -> DataFrame:
        """(a, b, d) for pairs of point ids, all or those with a join condition, by four lookups of node distances."""
        left = self.with_length(a).select(*(F.col(c).alias(f"a_{c}") for c in ("point_id", "u", "v", "pos", "length")))
        right = self.with_length(b).select(*(F.col(c).alias(f"b_{c}") for c in ("point_id", "u", "v", "pos", "length")))
        x = left.crossJoin(right) if on is None else left.join(right, on)
        for i in "uv":
            for j in "uv":
                x = x.join(self.node_dist.toDF(f"a_{i}", f"b_{j}", f"d{i}{j}"), [f"a_{i}", f"b_{j}"])
        return x.select("a_point_id", "b_point_id", "a_u", "a_v", "b_u", "b_v", F.least(*routes(), same_edge("a_", "b_", "a_length")).alias("d"), *(r.alias(f"r{i}") for i, r in enumerate(routes())), same_edge("a_", "b_", "a_length").alias("on_edge"))


def routes() -> list[Column]:
    """The four ways through the ends, in the order (u,u), (u,v), (v,u), (v,v)."""
    out_u, out_v = F.col("a_pos"), F.col("a_length") - F.col("a_pos")
    in_u, in_v = F.col("b_pos"), F.col("b_length") - F.col("b_pos")
    return [out_u + F.col("duu") + in_u, out_u + F.col("duv") + in_v, out_v + F.col("dvu") + in_u, out_v + F.col("dvv") + in_v]


def same_edge(a: str = "", b: str = "c", length: str = "length") -> Column:
    """Distance along a shared edge, the shorter arc of a self-loop, or FAR."""
    au, av, ap, n = F.col(f"{a}u"), F.col(f"{a}v"), F.col(f"{a}pos"), F.col(length)
    bu, bv, bp = F.col(f"{b}u"), F.col(f"{b}v"), F.col(f"{b}pos")
    arc = F.abs(ap - bp)
    return F.when((au == av) & (bu == bv) & (au == bu), F.least(arc, n - arc)).when((au == bu) & (av == bv), arc).when((au == bv) & (av == bu), F.abs(n - ap - bp)).otherwise(F.lit(FAR))


def quantum_path(graph: MetricGraph, a: DataFrame, b: DataFrame, on: Column | None = None) -> DataFrame:
    """(a, b, distance, exit, entry): the nodes through which the geodesic leaves and arrives; both null along one edge.

    Of equal ways the first of (u,u), (u,v), (v,u), (v,v) wins; the edge itself only if strictly shorter, but a shared
    self-loop always goes along the loop.
    """
    x = graph.pair_distances(a, b, on)
    ways = F.array(*(F.struct(F.col(f"r{i}").alias("d"), F.lit(i).alias("i"), F.col(f"a_{e}").alias("x"), F.col(f"b_{t}").alias("y")) for i, (e, t) in enumerate(("uu", "uv", "vu", "vv"))))
    best = F.array_min(ways)
    loop = (F.col("a_u") == F.col("a_v")) & (F.col("b_u") == F.col("b_v")) & (F.col("a_u") == F.col("b_u"))
    along = loop | (F.col("on_edge") < best["d"])
    return x.select("a_point_id", "b_point_id", F.when(along, F.col("on_edge")).otherwise(best["d"]).alias("distance"), F.when(~along, best["x"]).alias("exit"), F.when(~along, best["y"]).alias("entry"))


def closest_node() -> Column:
    """The nearer end of the point's edge; v at the middle."""
    return F.when(F.col("pos") < F.col("length") / 2, F.col("u")).otherwise(F.col("v"))


def reversed_points(points: DataFrame) -> DataFrame:
    """The same points from the other end (on a self-loop: other points). Needs length."""
    return points.withColumns({"u": F.col("v"), "v": F.col("u"), "pos": F.col("length") - F.col("pos")})


def first_hops(graph: MetricGraph) -> DataFrame:
    """(s, t, hop): the neighbour of s with the least way over its edge to t; the smallest id of equal ones, by ways of nine decimals.

    From a node of one neighbour every way goes there, so no distance is looked up. For the others, tasks go through the
    distances of their neighbours, a source at a time.
    """
    if not graph.searchable:
        step = both_ways(graph.edges).toDF("s", "hop", "step")
        on = graph.node_dist.toDF("hop", "t", "rest")
        best = step.join(on, "hop").where("s <> t").groupBy("s", "t").agg(F.min(F.struct(F.round(F.col("step") + F.col("rest"), 9).alias("d"), "hop")).alias("best"))
        return best.select("s", "t", F.col("best.hop").alias("hop"))
    spark, (names, ends, dist) = graph.spark, graph.local()
    near: list[dict[int, float]] = [{} for _ in names]
    for u, v, length in ends:
        near[u][v] = near[v][u] = min(length, near[u].get(v, np.inf))
    single = [i for i, x in enumerate(near) if len(x) == 1 and i not in x]
    several = [i for i, x in enumerate(near) if len(x) > 1 or i in x]

    def run(batches):
        ids = pa.array(names, pa.string())
        for batch in batches:
            for s in (several[k] for k in batch.column(0).to_pylist()):
                best, hop = np.full(len(names), np.inf), np.zeros(len(names), np.int64)
                for v in sorted(near[s], key=names.__getitem__):
                    way = np.round(near[s][v] + dist[v], 9)
                    closer = way < best
                    best[closer], hop[closer] = way[closer], v
                best[s] = np.inf
                at = np.flatnonzero(np.isfinite(best))
                for few in np.array_split(at, -(-len(at) // 20_000) or 1):
                    yield pa.RecordBatch.from_pydict({"s": pa.array([names[s]], pa.string()).take(pa.array(np.zeros(len(few), np.int64))), "t": ids.take(pa.array(few)), "hop": ids.take(pa.array(hop[few]))})

    parts = 4 * spark.sparkContext.defaultParallelism
    found = spark.range(0, len(several), 1, max(1, min(len(several), parts))).mapInArrow(run, "s string, t string, hop string")
    piece = _pieces(near)
    ones = spark.createDataFrame(pa.table({"piece": pa.array([piece[i] for i in single], pa.int64()), "s": pa.array([names[i] for i in single], pa.string()), "hop": pa.array([names[next(iter(near[i]))] for i in single], pa.string())}))
    every = spark.createDataFrame(pa.table({"piece": pa.array(piece, pa.int64()), "t": pa.array(names, pa.string())}))
    ones = ones.repartition(parts)
    # Nodes of a connected graph are one piece, where the key of a hash join would only chain all rows.
    met = ones.join(F.broadcast(every), F.col("s") != F.col("t")) if len(set(piece)) == 1 else ones.join(F.broadcast(every), "piece").where("s <> t")
    return found.unionAll(met.select("s", "t", "hop"))


def _pieces(near: list[dict[int, float]]) -> list[int]:
    """The number of every node's connected piece."""
    piece, count = [-1] * len(near), 0
    for i in range(len(near)):
        if piece[i] < 0:
            piece[i], waiting = count, [i]
            while waiting:
                for v in near[waiting.pop()]:
                    if piece[v] < 0:
                        piece[v] = count
                        waiting.append(v)
            count += 1
    return piece
