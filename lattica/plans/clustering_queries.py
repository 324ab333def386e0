"""Queries over assignments, energies, metrics, updates, sampling and Lloyd iterations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import energy as E
from ..operators import lloyd as L
from ..operators import metrics as M
from ..operators import sampling as P
from ..operators import updates as U
from ..operators.spaces import GraphSpace, Sphere
from . import fixtures as X
from .fixtures import SQL_GEO, geo, sql_u, table
from .registry import query, r, rounded
from .storage import stored

WITH = f"WITH RECURSIVE {SQL_GEO}\n"
S64, S3 = f"WITH {X.sql_sphere()}\n", f"WITH {X.sql_sphere(2)}\n"
ASSIGN = ", q AS (SELECT a.point_id, a.ord, a.label AS truth, a.x, b.point_id::int AS cid, acos(greatest(-1, least(1, list_dot_product(a.x, b.x)))) AS d FROM s AS a CROSS JOIN s AS b WHERE b.point_id < 3), sl AS (SELECT point_id, any_value(ord) AS ord, any_value(truth) AS truth, any_value(x) AS x, arg_min(cid, (d, cid)) AS label, min(d) AS d FROM q GROUP BY point_id)\n"


def ari_sql(rows: str, a: str, b: str, name: str = "ari") -> str:
    return f"""(SELECT CASE WHEN (sa + sb) / 2 - sa * sb / (t * (t - 1) / 2) = 0 THEN 1.0 ELSE (ij - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)) END AS {name} FROM
(SELECT sum(n * (n - 1) / 2.0::double) AS ij, sum(n)::double AS t FROM (SELECT count(*) AS n FROM {rows} GROUP BY {a}, {b})),
(SELECT sum(n * (n - 1) / 2.0::double) AS sa FROM (SELECT count(*) AS n FROM {rows} GROUP BY {a})),
(SELECT sum(n * (n - 1) / 2.0::double) AS sb FROM (SELECT count(*) AS n FROM {rows} GROUP BY {b})))"""


def nmi_sql(rows: str, a: str, b: str) -> str:
    h = lambda c: f"(SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT count(*)::double AS n FROM {rows} GROUP BY {c}), (SELECT count(*)::double AS t FROM {rows}))"
    mi = f"""(SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM (SELECT {a} AS a, {b} AS b, count(*)::double AS n FROM {rows} GROUP BY ALL)
JOIN (SELECT {a} AS a, count(*)::double AS na FROM {rows} GROUP BY {a}) USING (a) JOIN (SELECT {b} AS b, count(*)::double AS nb FROM {rows} GROUP BY {b}) USING (b), (SELECT count(*)::double AS t FROM {rows}))"""
    return f"(SELECT mi / ((x.h + y.h) / 2) AS nmi FROM {mi}, {h(a)} AS x, {h(b)} AS y)"


def sil_sql(rows: str) -> str:
    return f"""(SELECT avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM
(SELECT i, max(CASE WHEN lj = li THEN s / m END) AS a, min(CASE WHEN lj <> li THEN s / m END) AS b FROM
(SELECT x.point_id AS i, x.label AS li, y.label AS lj, sum(acos(greatest(-1, least(1, list_dot_product(x.x, y.x))))) AS s, count(*) AS m FROM {rows} AS x JOIN {rows} AS y ON x.point_id <> y.point_id GROUP BY ALL) GROUP BY i))"""


def sphere_labels(spark, sf, dim=None):
    p = X.sphere(spark, sf, dim).withColumnRenamed("label", "truth")
    return Sphere(dim or 63).assign(p, X.sphere_centers(p))


@query("entry_sphere_clusters", S64 + ASSIGN + f"SELECT label, count(*) AS n, {r('avg(d * d)')} AS energy FROM sl GROUP BY label")
def entry(spark, sf):
    return sphere_labels(spark, sf).groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg(F.col("d") * F.col("d")), "energy"))


@query("join01_assign_graph", WITH + f"SELECT point_id, label, {r('d')} AS d FROM lab")
def join01(spark, sf):
    g = geo(spark, sf)
    return GraphSpace(g.graph).assign(g.points, g.centers).select("point_id", "label", rounded("d", "d"))


@query("join01_assign_sphere", S64 + ASSIGN + f"SELECT point_id, label, {r('d')} AS d FROM sl")
def join01_sphere(spark, sf):
    return sphere_labels(spark, sf).select("point_id", "label", rounded("d", "d"))


@query("join02_labels", S64 + ASSIGN + "SELECT point_id, label FROM sl")
def join02(spark, sf):
    p = X.sphere(spark, sf)
    d = Sphere(63).distances(p.drop("label"), X.sphere_centers(p))
    return d.groupBy("point_id").agg(F.min_by("cid", F.struct("d", "cid")).alias("label"))


@query("agg01_uniform_energy", WITH + f"SELECT {r('avg(d * d)')} AS energy FROM near")
def agg01(spark, sf):
    g = geo(spark, sf)
    return E.uniform_energy(g.graph, g.centers).select(rounded("energy", "energy"))


@query("agg02_empirical_energy", WITH + f"SELECT {r('avg(d * d)')} AS energy FROM lab")
def agg02(spark, sf):
    g = geo(spark, sf)
    return E.empirical_energy(GraphSpace(g.graph), g.points, g.centers).select(rounded("energy", "energy"))


@query("agg03_node_measure_energy", WITH + f"SELECT {r('sum(obs_weight * d * d) / sum(obs_weight)')} AS energy FROM near JOIN ow USING (node_id) WHERE obs_weight > 0")
def agg03(spark, sf):
    g = geo(spark, sf)
    return E.energy(GraphSpace(g.graph), g.centers, "node_measure", observed=g.graph.register_observations(g.points)).select(rounded("energy", "energy"))


@query("agg04_manifold_energy", S64 + ASSIGN + f"SELECT {r('avg(d * d)')} AS energy FROM sl")
def agg04(spark, sf):
    p = X.sphere(spark, sf)
    return E.energy(Sphere(63), X.sphere_centers(p), "empirical", p).select(rounded("energy", "energy"))


@query("agg05_node_energy", WITH + f"SELECT {r('sum(weight * d * d)')} AS energy FROM near JOIN n USING (node_id)")
def agg05(spark, sf):
    g = geo(spark, sf)
    return E.node_energy(g.graph, g.centers).select(rounded("energy", "energy"))


@query("agg06_mean_energy_per_run", WITH + f"SELECT segment, {r('avg(d * d)')} AS energy FROM lab GROUP BY segment")
def agg06(spark, sf):
    g = geo(spark, sf)
    return E.empirical_energy(GraphSpace(g.graph), g.points, g.centers, "segment").select("segment", rounded("energy", "energy"))


@query("agg07_diameter", WITH + f"SELECT {r('max(d)')} AS diameter FROM nd")
def agg07(spark, sf):
    return geo(spark, sf).graph.diameter().select(rounded("diameter", "diameter"))


@query("agg08_most_frequent_node", WITH + ", k AS (SELECT label, node_id, count(*) AS n, min(ord) AS first FROM cn GROUP BY ALL) SELECT label, arg_min(node_id, (-n, first)) AS node_id, max(n) AS n FROM k GROUP BY label")
def agg08(spark, sf):
    g = geo(spark, sf)
    return U.most_frequent_node(g.graph, GraphSpace(g.graph).assign(g.points, g.centers))


@query("agg09_least_energy_node", WITH + f", k AS (SELECT label, nd.s AS node_id, sum(nd.d * nd.d) AS e FROM cn JOIN nd ON nd.t = cn.node_id GROUP BY ALL) SELECT label, arg_min(k.node_id, (round(e, 9), n.ord)) AS node_id, {r('min(e)')} AS energy FROM k JOIN n ON n.node_id = k.node_id GROUP BY label")
def agg09(spark, sf):
    g = geo(spark, sf)
    return U.least_energy_node(g.graph, GraphSpace(g.graph).assign(g.points, g.centers)).select("label", "node_id", rounded("energy", "energy"))


@query("agg19_kmedoid_update", WITH + f", k AS (SELECT label, nd.s AS node_id, sum(nd.d * nd.d) AS e FROM cn JOIN nd ON nd.t = cn.node_id GROUP BY ALL) SELECT label, arg_min(k.node_id, (round(e, 9), n.ord)) AS node_id, {r('min(e)')} AS energy FROM k JOIN n ON n.node_id = k.node_id WHERE (label, k.node_id) IN (SELECT (label, node_id) FROM cn) GROUP BY label")
def agg19(spark, sf):
    g = geo(spark, sf)
    return U.least_energy_node(g.graph, GraphSpace(g.graph).assign(g.points, g.centers), members_only=True).select("label", "node_id", rounded("energy", "energy"))


def karcher_sql(steps: int) -> str:
    text = "m0 AS (SELECT label AS cid, arg_min(x, ord) AS m FROM sl GROUP BY label)"
    for i in range(steps):
        text += f""",
l{i} AS (SELECT cid, m, list_transform([1, 2, 3], lambda k: x[k] - greatest(-1, least(1, list_dot_product(x, m))) * m[k]) AS t, acos(greatest(-1, least(1, list_dot_product(x, m)))) AS a FROM sl JOIN m{i} ON cid = label),
a{i} AS (SELECT cid, any_value(m) AS m, {", ".join(f"avg(CASE WHEN sqrt(list_dot_product(t, t)) <= 1e-12 THEN 0 ELSE t[{k}] * a / sqrt(list_dot_product(t, t)) END) AS v{k}" for k in (1, 2, 3))} FROM l{i} GROUP BY cid),
b{i} AS (SELECT cid, m, v1, v2, v3, v1 * m[1] + v2 * m[2] + v3 * m[3] AS p FROM a{i}),
c{i} AS (SELECT cid, m, [v1 - p * m[1], v2 - p * m[2], v3 - p * m[3]] AS v FROM b{i}),
m{i + 1} AS (SELECT cid, list_transform([1, 2, 3], lambda k: cos(sqrt(list_dot_product(v, v))) * m[k] + sin(sqrt(list_dot_product(v, v))) / sqrt(list_dot_product(v, v)) * v[k]) AS m FROM c{i})"""
    return text


@query("agg10_karcher_mean", S3 + ASSIGN + f", {karcher_sql(4)} SELECT cid, {r('m[1]')} AS x0, {r('m[2]')} AS x1, {r('m[3]')} AS x2 FROM m4")
def agg10(spark, sf):
    """Four steps, as in the SQL; tests run it to convergence."""
    labelled = stored(sphere_labels(spark, sf, 2))
    mean = U.karcher_mean(Sphere(2), labelled, 3, steps=4, tol=0)
    return mean.select(F.col("cid").cast("int").alias("cid"), *(rounded(F.get("x", F.lit(i)), f"x{i}") for i in range(3)))


@query("agg11_silhouette", S64 + f"SELECT {r('silhouette')} AS silhouette FROM {sil_sql('s')}")
def agg11(spark, sf):
    return M.silhouette(Sphere(63), stored(X.sphere(spark, sf))).select(rounded("silhouette", "silhouette"))


@query("agg12_adjusted_rand", f"SELECT {r('ari')} AS ari FROM {ari_sql('labels', 'quality', 'toxic')}")
def agg12(spark, sf):
    return M.adjusted_rand_index(table(spark, sf, "labels"), "quality", "toxic").select(rounded("ari", "ari"))


@query("agg13_mutual_info", f"SELECT {r('nmi')} AS nmi FROM {nmi_sql('labels', 'quality', 'toxic')}")
def agg13(spark, sf):
    return M.normalized_mutual_info(table(spark, sf, "labels"), "quality", "toxic").select(rounded("nmi", "nmi"))


@query("agg14_evaluate", S64 + ASSIGN + f"SELECT {r('silhouette')} AS silhouette, {r('ari')} AS ari, {r('nmi')} AS nmi FROM {sil_sql('sl')}, {ari_sql('sl', 'label', 'truth')}, {nmi_sql('sl', 'label', 'truth')}")
def agg14(spark, sf):
    p = stored(X.sphere(spark, sf).withColumnRenamed("label", "truth"))
    return M.evaluate(Sphere(63), p, X.sphere_centers(p), "truth").select(*(rounded(c, c) for c in ("silhouette", "ari", "nmi")))


RUNS_SQL = "WITH ru AS (SELECT event_type AS method, user_id % 10 AS seed, event_id AS run, value AS ari, round(sin(event_id) * 1000) AS energy, user_id % 4 AS cls, event_type AS pred FROM events WHERE value IS NOT NULL)\n"


def run_rows(spark, sf):
    e = table(spark, sf, "events").where("value is not null")
    return e.select(F.col("event_type").alias("method"), (F.col("user_id") % 10).alias("seed"), F.col("event_id").alias("run"), F.col("value").alias("ari"), F.round(F.sin(F.col("event_id").cast("double")) * 1000).alias("energy"), (F.col("user_id") % 4).alias("cls"))


PICK = "SELECT method, seed, arg_min(ari, (energy, run)) AS s FROM ru GROUP BY method, seed"


@query("agg15_method_statistics", RUNS_SQL + f"SELECT method, {r('mean')} AS mean, {r('std')} AS std, {r('best')} AS best, {r('selected')} AS selected FROM (SELECT method, avg(ari) AS mean, stddev_pop(ari) AS std, max(ari) AS best FROM ru GROUP BY method) JOIN (SELECT method, avg(s) AS selected FROM ({PICK}) GROUP BY method) USING (method)")
def agg15(spark, sf):
    return D.method_statistics(run_rows(spark, sf), ["method"]).select("method", *(rounded(c, c) for c in ("mean", "std", "best", "selected")))


@query("agg16_timing_statistics", RUNS_SQL + f"SELECT method, {r('avg(ari)')} AS time_mean_s, {r('coalesce(stddev_samp(ari), 0)')} AS time_std_s, count(*) AS n_seeds FROM ru WHERE seed <> 3 GROUP BY method")
def agg16(spark, sf):
    return D.timing_statistics(run_rows(spark, sf), ["method"], "ari", F.col("seed") == 3).select("method", rounded("time_mean_s", "time_mean_s"), rounded("time_std_s", "time_std_s"), "n_seeds")


@query("agg17_pair_potential", WITH + f", u AS (SELECT a.s AS i, b.s AS j, sum(weight * least(a.d * a.d, b.d * b.d)) AS u FROM nd AS a JOIN nd AS b ON a.t = b.t JOIN n ON n.node_id = a.t GROUP BY ALL) SELECT i, j, {r('u')} AS u FROM u")
def agg17(spark, sf):
    return D.node_potential(geo(spark, sf).graph, lambda u: rounded(u, "u"))


@query("agg18_ari_records", f"SELECT lang, {r('ari')} AS ari FROM (SELECT 'all' AS lang, ari FROM {ari_sql('labels', 'quality', 'toxic')}) UNION ALL SELECT 'en', {r('ari')} FROM {ari_sql('(SELECT quality, toxic FROM labels JOIN documents USING (doc_id) WHERE lang = $$en$$)', 'quality', 'toxic')}")
def agg18(spark, sf):
    rows = table(spark, sf, "labels")
    english = rows.join(table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), "doc_id")
    one = lambda name, t: M.adjusted_rand_index(t, "quality", "toxic").select(F.lit(name).alias("lang"), rounded("ari", "ari"))
    return one("all", rows).unionByName(one("en", english))


@query("agg22_majority_labels", S64 + ASSIGN + ", k AS (SELECT label, truth, count(*) AS n FROM sl GROUP BY ALL) SELECT label, arg_min(truth, (-n, truth)) AS truth, max(n) AS n FROM k GROUP BY label")
def agg22(spark, sf):
    return U.majority_labels(sphere_labels(spark, sf), "label", "truth")


@query("agg23_energy_dispatch", WITH + f"SELECT 'empirical' AS how, {r('avg(d * d)')} AS energy FROM lab UNION ALL SELECT 'uniform', {r('avg(d * d)')} FROM near UNION ALL SELECT 'node_measure', {r('sum(obs_weight * d * d) / sum(obs_weight)')} FROM near JOIN ow USING (node_id)")
def agg23(spark, sf):
    g = geo(spark, sf)
    space, observed = GraphSpace(g.graph), stored(g.graph.register_observations(g.points))
    out = [E.energy(space, g.centers, how, g.points if how == "empirical" else None, observed).select(F.lit(how).alias("how"), rounded("energy", "energy")) for how in E.MODES]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("top02_farthest_point", WITH + f"SELECT arg_min(point_id, (-round(d, 9), ord)) AS point_id, {r('max(d)')} AS d FROM lab")
def top02(spark, sf):
    g = geo(spark, sf)
    return U.farthest_point(GraphSpace(g.graph), g.points, g.centers).select("point_id", rounded("d", "d"))


@query("top03_selected_ari", RUNS_SQL + f"SELECT method, seed, {r('arg_min(ari, (energy, run))')} AS selected FROM ru GROUP BY method, seed")
def top03(spark, sf):
    return D.selected_value(run_rows(spark, sf), ["method", "seed"]).select("method", "seed", rounded("selected", "selected"))


DRAWS = "(SELECT unnest(range(0, 500))::bigint AS id)"
FIRST = "fe AS (SELECT b.u AS node_id, arg_min(b.v, n.ord) AS v FROM b JOIN n ON n.node_id = b.v GROUP BY b.u)"


@query("smp03_uniform_nodes", WITH + f", {FIRST}, nn AS (SELECT node_id, v, row_number() OVER (ORDER BY node_id) - 1 AS at FROM fe) SELECT id AS point_id, node_id AS u, v FROM {DRAWS}, (SELECT count(*) AS t FROM n) JOIN nn ON nn.at = floor({sql_u('5', 'id')} * t)::bigint")
def smp03(spark, sf):
    return P.uniform_nodes(geo(spark, sf).graph, 500, 5).select("point_id", "u", "v")


RANGES = ", ra AS (SELECT *, sum(w) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS hi, sum(w) OVER () AS total, max(key) OVER () AS last FROM it)"


@query("smp04_uniform_edges", WITH + f", it AS (SELECT u || '|' || v AS key, u, v, length AS w FROM e){RANGES} SELECT id AS point_id, u, v, {r('least(w, ' + sql_u('10', 'id') + ' * w)')} AS pos FROM {DRAWS} JOIN ra ON {sql_u('9', 'id')} * total >= hi - w AND ({sql_u('9', 'id')} * total < hi OR key = last)")
def smp04(spark, sf):
    return P.uniform_edges(geo(spark, sf).graph, 500, 9).select("point_id", "u", "v", rounded("pos", "pos"))


@query("smp05_weighted_nodes", WITH + f", {FIRST}, it AS (SELECT node_id AS key, weight::double AS w FROM n){RANGES} SELECT id AS point_id, key AS u, fe.v FROM {DRAWS} JOIN ra ON {sql_u('13', 'id')} * total >= hi - w AND ({sql_u('13', 'id')} * total < hi OR key = last) JOIN fe ON fe.node_id = key")
def smp05(spark, sf):
    return P.weighted_nodes(geo(spark, sf).graph, 500, 13).select("point_id", "u", "v")


@query("smp08_random_init", WITH + f"SELECT point_id, (row_number() OVER (ORDER BY {sql_u('17', 'point_id')}, point_id) - 1)::int AS cid FROM p QUALIFY cid < 5")
def smp08(spark, sf):
    return P.random_init(geo(spark, sf).points, 5, 17).select("point_id", "cid")


def kpp_sql(weight: str, seed: int) -> str:
    """Three rounds: the first uniform, the others by (weighted) squared distance to the centers so far."""
    first = f"c0 AS (SELECT point_id FROM (SELECT point_id, row_number() OVER (ORDER BY point_id) AS cum FROM s) WHERE cum > {sql_u(str(seed), '0')} * (SELECT count(*) FROM s) ORDER BY point_id LIMIT 1)"
    d = lambda k: f"SELECT a.point_id, any_value({weight}) AS w, min(acos(greatest(-1, least(1, list_dot_product(a.x, b.x)))) ^ 2) AS d2 FROM s AS a, s AS b WHERE b.point_id IN ({' UNION ALL '.join(f'SELECT point_id FROM c{i}' for i in range(k))}) GROUP BY a.point_id"
    text = first
    for k in (1, 2):
        text += f", k{k} AS (SELECT point_id, sum(w * d2) OVER (ORDER BY point_id ROWS UNBOUNDED PRECEDING) AS cum, sum(w * d2) OVER () AS total FROM ({d(k)})), c{k} AS (SELECT point_id FROM k{k} WHERE cum > {sql_u(str(seed), str(k))} * total ORDER BY point_id LIMIT 1)"
    return text + " SELECT 0 AS cid, point_id FROM c0 UNION ALL SELECT 1, point_id FROM c1 UNION ALL SELECT 2, point_id FROM c2"


@query("smp09_kmeans_pp", S3 + ", " + kpp_sql("1.0", 19))
def smp09(spark, sf):
    return P.kmeans_pp(Sphere(2), X.sphere(spark, sf, 2), 3, 19).select("cid", "point_id")


@query("smp10_weighted_kmeans_pp", S3 + ", " + kpp_sql("1.0 + a.label", 23))
def smp10(spark, sf):
    p = X.sphere(spark, sf, 2).withColumn("w", (1.0 + F.col("label")).cast("double")).drop("label")
    return P.kmeans_pp(Sphere(2), p, 3, 23, "w").select("cid", "point_id")


@query("smp11_shuffle", WITH + f"SELECT point_id, row_number() OVER (ORDER BY {sql_u('29', 'point_id')}, point_id) - 1 AS ord FROM p")
def smp11(spark, sf):
    return P.shuffled(geo(spark, sf).points, 29).select("point_id", "ord")


@query("smp13_bootstrap", WITH + f", np AS (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS at, count(*) OVER () AS t FROM p) SELECT id AS ord, point_id FROM {DRAWS} JOIN np ON np.at = floor({sql_u('31', 'id')} * t)::bigint")
def smp13(spark, sf):
    return P.bootstrap(geo(spark, sf).points, 500, 31).select("ord", "point_id")


def lloyd_sql(rounds: int) -> str:
    """Assign to nodes, least energy node, again; a center is a node."""
    text = ", k0 AS (SELECT (row_number() OVER (ORDER BY node_id) - 1)::int AS cid, node_id FROM n WHERE node_id IN ('N0', 'N13', 'N7'))"
    for i in range(rounds + 1):
        text += f""",
x{i} AS (SELECT p.point_id, k.cid, least(p.pos + a.d, p.length - p.pos + z.d) AS d FROM p CROSS JOIN k{i} AS k JOIN nd AS a ON a.s = p.u AND a.t = k.node_id JOIN nd AS z ON z.s = p.v AND z.t = k.node_id),
y{i} AS (SELECT point_id, arg_min(cid, (d, cid)) AS cid, min(d) AS d FROM x{i} GROUP BY point_id)"""
        if i < rounds:
            text += f""",
e{i} AS (SELECT y.cid, nd.s AS node_id, round(sum(nd.d * nd.d), 9) AS e FROM y{i} AS y JOIN cn USING (point_id) JOIN nd ON nd.t = cn.node_id GROUP BY ALL),
k{i + 1} AS (SELECT cid, arg_min(e.node_id, (e.e, n.ord)) AS node_id FROM e{i} AS e JOIN n ON n.node_id = e.node_id GROUP BY cid)"""
    return text + f" SELECT cid, node_id AS u, (SELECT {r('avg(d * d)')} FROM y{rounds}) AS energy FROM k{rounds}"


def start_nodes(g):
    nodes = g.graph.nodes.where("node_id in ('N0', 'N13', 'N7')").withColumn("label", F.when(F.col("node_id") == "N0", 0).when(F.col("node_id") == "N13", 1).otherwise(2))
    return U.node_centers(g.graph, nodes.select("node_id", "label"))


@query("str07_lloyd", WITH + lloyd_sql(3))
def str07(spark, sf):
    """Three iterations, as in the SQL; tests run it to convergence."""
    g = geo(spark, sf)
    centers, energy, _ = L.lloyd(GraphSpace(g.graph), stored(g.graph.with_length(g.points)), start_nodes(g), L.node_update(g.graph), 3, 0.0)
    return centers.select("cid", "u", rounded(F.lit(energy), "energy"))


@query("str08_reseed", WITH + f", o AS (SELECT point_id, p.ord, u, v, pos, least(p.pos + a.d, p.length - p.pos + z.d) AS d FROM p JOIN nd AS a ON a.s = p.u AND a.t = 'N0' JOIN nd AS z ON z.s = p.v AND z.t = 'N0') SELECT 0 AS cid, 'N0' AS u, 0.0::double AS pos UNION ALL SELECT 1, u, {r('pos')} FROM (SELECT * FROM o ORDER BY round(d, 9) DESC, ord LIMIT 1)")
def str08(spark, sf):
    """A cluster without a center takes the point farthest from the others."""
    g = geo(spark, sf)
    one = start_nodes(g).where("cid = 0")
    return L.reseed(GraphSpace(g.graph), g.points, one, stored(one), 2).select("cid", "u", rounded("pos", "pos"))


MEDOID = ", w AS (SELECT node_id, obs_weight AS w FROM ow WHERE obs_weight > 0), k0 AS (SELECT (row_number() OVER (ORDER BY node_id) - 1)::int AS cid, node_id FROM w QUALIFY cid < 3)"


def medoid_sql(rounds: int) -> str:
    text = MEDOID
    for i in range(rounds + 1):
        text += f""",
x{i} AS (SELECT w.node_id, any_value(w.w) AS w, arg_min(k.cid, (nd.d, k.cid)) AS cid, min(nd.d) AS d FROM w CROSS JOIN k{i} AS k JOIN nd ON nd.s = w.node_id AND nd.t = k.node_id GROUP BY w.node_id)"""
        if i < rounds:
            text += f""",
e{i} AS (SELECT a.cid, a.node_id, round(sum(b.w * nd.d * nd.d), 9) AS e FROM x{i} AS a JOIN x{i} AS b ON a.cid = b.cid JOIN nd ON nd.s = a.node_id AND nd.t = b.node_id GROUP BY ALL),
k{i + 1} AS (SELECT cid, arg_min(e.node_id, (e.e, n.ord)) AS node_id FROM e{i} AS e JOIN n ON n.node_id = e.node_id GROUP BY cid)"""
    return text + f" SELECT cid, node_id, (SELECT {r('sum(w * d * d) / sum(w)')} FROM x{rounds}) AS energy FROM k{rounds}"


@query("bas01_kmedoids", WITH + medoid_sql(3))
def bas01(spark, sf):
    g = geo(spark, sf)
    from pyspark.sql import Window

    w = stored(g.graph.register_observations(g.points).where("obs_weight > 0").select("node_id", F.col("obs_weight").alias("w")))
    start = w.withColumn("cid", F.row_number().over(Window.orderBy("node_id")) - 1).where("cid < 3")
    medoids, energy, _ = L.kmedoids(g.graph, w, start, 3)
    return medoids.select("cid", "node_id", rounded(F.lit(energy), "energy"))


@query("bas02_spectral")
def bas02(spark, sf):
    return D.node_spectral(geo(spark, sf).graph, 3)


@query("bas03_rbf_affinity", WITH + f", m AS (SELECT median(d) AS m FROM nd WHERE s <> t AND d > 0) SELECT s, t, {r('exp(-d * d / (2 * m * m))')} AS affinity FROM nd, m")
def bas03(spark, sf):
    return D.rbf_affinity(geo(spark, sf).graph.node_dist).select("s", "t", rounded("affinity", "affinity"))


@query("bas05_critical_depth")
def bas05(spark, sf):
    return spark.createDataFrame([(D.node_critical_depth(geo(spark, sf).graph),)], "c_star double")


@query("bas06_drift_calibration")
def bas06(spark, sf):
    return bas05(spark, sf).select((0.3 / F.col("c_star")).alias("beta0"))


@query("bas07_toy_optimum", f"SELECT {r('min((least(x ^ 2, y ^ 2) + least((x - 1) ^ 2, (y - 1) ^ 2) + least((x - 3) ^ 2, (y - 3) ^ 2)) / 3)')} AS energy FROM (SELECT unnest(range(0, 301)) * 0.01::double AS x), (SELECT unnest(range(0, 301)) * 0.01::double AS y)")
def bas07(spark, sf):
    return D.toy_optimum(spark, 1.0, 2.0, 300).select(rounded("energy", "energy"))


