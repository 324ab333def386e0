"""Test inputs derived from the driver's tables: a metric graph, points on manifolds, trajectories; and the same as SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from ..operators.graph import MetricGraph
from ..operators.trajectory import clock
from .storage import stored


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


class Geo:
    """Regions in a ring, nations at their region, suppliers at their nation; customers are points on nation edges."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        t = lambda name: table(spark, sf, name)
        s = lambda prefix, key: F.concat(F.lit(prefix), key.cast("string"))
        region, nation, supplier = t("region"), t("nation"), t("supplier")
        edges = (
            region.select(s("R", F.col("r_regionkey")).alias("u"), s("R", (F.col("r_regionkey") + 1) % 5).alias("v"), F.lit(4.0).alias("length"))
            .unionByName(nation.select(s("N", F.col("n_nationkey")).alias("u"), s("R", F.col("n_regionkey")).alias("v"), (1 + (F.col("n_nationkey") % 5) * 0.25).cast("double").alias("length")))
            .unionByName(supplier.select(s("S", F.col("s_suppkey")).alias("u"), s("N", F.col("s_nationkey")).alias("v"), (0.5 + (F.col("s_suppkey") % 7) * 0.1).cast("double").alias("length")))
            .withColumn("weight", F.lit(1.0))
        )
        from pyspark.sql import Window

        degree = edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("deg"))
        nodes = degree.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).cast("long").alias("ord"), (1.0 + F.col("deg")).cast("double").alias("weight"))
        self.graph = MetricGraph(stored(nodes, "nodes"), stored(edges, "edges"))
        length = (1 + (F.col("n_nationkey") % 5) * 0.25).cast("double")
        on = nation.select("n_nationkey", s("N", F.col("n_nationkey")).alias("u"), s("R", F.col("n_regionkey")).alias("v"), length.alias("length"))
        customers = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(on), F.col("c_nationkey") == F.col("n_nationkey"))
        self.points = customers.select(F.col("c_custkey").alias("point_id"), F.col("c_custkey").alias("ord"), "u", "v", (F.col("length") * ((F.col("c_custkey") * 37) % 101) / 100.0).alias("pos"), F.col("c_mktsegment").alias("segment"))
        pick = F.when(F.col("n_nationkey") == 0, 0).when(F.col("n_nationkey") == 7, 1).otherwise(2)
        self.centers = stored(on.where("n_nationkey in (0, 7, 13)").select(pick.alias("cid"), "u", "v", (F.col("length") * 0.4).alias("pos")), "centers")


@lru_cache(maxsize=8)
def _geo(app: str, sf: str) -> Geo:
    return Geo(SparkSession.getActiveSession(), sf)


def geo(spark: SparkSession, sf: str) -> Geo:
    """The graph is small and used by many queries: found once per application and folder."""
    return _geo(spark.sparkContext.applicationId, sf)


def sphere(spark: SparkSession, sf: str, dim: int | None = None) -> DataFrame:
    """point_id, ord, x, label: embeddings as unit vectors, of all or the first dim + 1 coordinates."""
    e = table(spark, sf, "embeddings")
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    if dim is not None:
        x = F.slice(x, 1, dim + 1)
    raw = e.select(F.col("vec_id").alias("point_id"), F.col("vec_id").alias("ord"), "label", x.alias("raw"))
    return raw.withColumn("n", G.norm("raw")).select("point_id", "ord", "label", F.transform("raw", lambda v: v / F.col("n")).alias("x"))


def sphere_centers(points: DataFrame, k: int = 3) -> DataFrame:
    return points.where(F.col("point_id") < k).select(F.col("point_id").cast("int").alias("cid"), "x")


def disk(spark: SparkSession, sf: str) -> DataFrame:
    """point_id, ord, x = (re, im), re, im: points well inside the octagon."""
    p = sphere(spark, sf, 1)
    r = 0.6 * (F.col("point_id") % 97) / 97.0
    return p.select("point_id", "ord", (r * F.get("x", F.lit(0))).alias("re"), (r * F.get("x", F.lit(1))).alias("im")).withColumn("x", F.array("re", "im"))


def hyperboloid(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    a, b = (F.get("embedding", F.lit(i)).cast("double") * 3 for i in (0, 1))
    return e.select(F.col("vec_id").alias("point_id"), F.col("vec_id").alias("ord"), a.alias("a"), b.alias("b")).select("point_id", "ord", F.array(F.sqrt(1 + F.col("a") * F.col("a") + F.col("b") * F.col("b")), "a", "b").alias("x"))


def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    """run_slot, i, t, energy, state from events; the first row of each run plays the start (i = -1 is not there)."""
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    w = Window.partitionBy("run_slot").orderBy("ts", "event_id")
    rows = e.withColumn("run_slot", (F.col("user_id") % 8).cast("int")).withColumn("i", F.row_number().over(w) - 1)
    return clock(rows, 7).select("run_slot", "i", "t", F.col("value").alias("energy"), F.col("event_type").alias("state"))


#: The same inputs in SQL. Each text is a list of common table expressions.
U = "(('0x' || substr(md5({}), 1, 13))::bigint::double / 4503599627370496)"


def sql_u(*parts: str) -> str:
    return U.format(" || '|' || ".join(f"({p})::varchar" for p in parts))


SQL_GEO = """
e AS (
  SELECT 'R' || r_regionkey AS u, 'R' || ((r_regionkey + 1) % 5) AS v, 4.0::double AS length FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 1 + (n_nationkey % 5) * 0.25::double FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 0.5::double + (s_suppkey % 7) * 0.1::double FROM supplier),
b AS (SELECT u, v, length FROM e UNION ALL SELECT v, u, length FROM e),
n AS (SELECT u AS node_id, row_number() OVER (ORDER BY u) - 1 AS ord, 1.0 + count(*) AS weight FROM b GROUP BY u),
on_edge AS (SELECT n_nationkey, 'N' || n_nationkey AS u, 'R' || n_regionkey AS v, 1 + (n_nationkey % 5) * 0.25::double AS length FROM nation),
p AS (SELECT c_custkey AS point_id, c_custkey AS ord, u, v, length * ((c_custkey * 37) % 101) / 100.0::double AS pos, length, c_mktsegment AS segment FROM customer JOIN on_edge ON c_nationkey = n_nationkey),
c AS (SELECT CASE n_nationkey WHEN 0 THEN 0 WHEN 7 THEN 1 ELSE 2 END AS cid, u, v, length * 0.4::double AS pos, length FROM on_edge WHERE n_nationkey IN (0, 7, 13)),
nd(s, t, d) USING KEY (s, t) AS (
  SELECT node_id, node_id, 0.0::double FROM n
  UNION (SELECT x.s, b.v, min(x.d + b.length) FROM nd AS x JOIN b ON x.t = b.u LEFT JOIN recurring.nd AS k ON k.s = x.s AND k.t = b.v WHERE k.d IS NULL OR x.d + b.length < k.d - 1e-12 GROUP BY x.s, b.v)),
nc AS (SELECT a.s AS node_id, c.cid, least(c.pos + a.d, c.length - c.pos + z.d) AS d FROM c JOIN nd AS a ON a.t = c.u JOIN nd AS z ON z.t = c.v AND z.s = a.s),
pc AS (
  SELECT p.point_id, p.ord, p.u, p.v, p.pos, p.length, p.segment, c.cid,
    least(p.pos + a.d, p.length - p.pos + z.d, CASE WHEN c.u = p.u AND c.v = p.v THEN abs(p.pos - c.pos) ELSE 1e300 END) AS d
  FROM p CROSS JOIN c JOIN nc AS a ON a.node_id = p.u AND a.cid = c.cid JOIN nc AS z ON z.node_id = p.v AND z.cid = c.cid),
lab AS (SELECT point_id, any_value(ord) AS ord, any_value(u) AS u, any_value(v) AS v, any_value(pos) AS pos, any_value(length) AS length, any_value(segment) AS segment, arg_min(cid, (d, cid)) AS label, min(d) AS d FROM pc GROUP BY point_id),
near AS (SELECT node_id, min(d) AS d FROM nc GROUP BY node_id),
cn AS (SELECT *, CASE WHEN pos < length / 2 THEN u ELSE v END AS node_id FROM lab),
ow AS (SELECT n.node_id, coalesce(m, 0)::double AS obs_weight FROM n LEFT JOIN (SELECT node_id, count(*) AS m FROM cn GROUP BY node_id) USING (node_id))"""


def sql_sphere(dim: int | None = None) -> str:
    x = "list_transform(embedding, lambda v: v::double)" if dim is None else f"list_transform(embedding[1:{dim + 1}], lambda v: v::double)"
    return f"""
s0 AS (SELECT vec_id AS point_id, label, {x} AS raw FROM embeddings),
s AS (SELECT point_id, point_id AS ord, label, list_transform(raw, lambda v: v / sqrt(list_dot_product(raw, raw))) AS x FROM s0)"""


SQL_DISK = (
    sql_sphere(1)
    + """,
z AS (SELECT point_id, ord, 0.6::double * (point_id % 97) / 97.0::double * x[1] AS re, 0.6::double * (point_id % 97) / 97.0::double * x[2] AS im FROM s)"""
)
SQL_HYPERBOLOID = "h0 AS (SELECT vec_id AS point_id, embedding[1]::double * 3 AS a, embedding[2]::double * 3 AS b FROM embeddings), h AS (SELECT point_id, [sqrt(1 + a * a + b * b), a, b] AS x FROM h0)"
SQL_TRAJECTORY = f"""
t0 AS (SELECT (user_id % 8)::int AS run_slot, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS i, value AS energy, event_type AS state FROM events),
tr AS (SELECT run_slot, i, sqrt(2 * sum(-ln(1 - {sql_u("7", "run_slot", "i")})) OVER (PARTITION BY run_slot ORDER BY i) + 1) - 1 AS t, energy, state FROM t0)"""
