"""Queries over trajectories and runs: clocks, windows, selection, annealing, online quantization."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annealing as A
from ..operators import trajectory as T
from ..operators.spaces import Bolza, GraphSpace, Sphere
from ..sources import nets as N
from ..sources import tables
from . import fixtures as X
from .fixtures import geo, table
from .registry import query, r, rounded
from .storage import stored

TR = f"WITH {X.SQL_TRAJECTORY}\n"
LAST = ", nn AS (SELECT run_slot, max(i) + 1 AS n FROM tr GROUP BY run_slot), win AS (SELECT tr.* FROM tr JOIN nn USING (run_slot) WHERE i >= floor((n - 1) * 0.75))"


@query("win01_clock", TR + f"SELECT run_slot, i, {r('t')} AS t FROM tr")
def win01(spark, sf):
    return X.trajectory(spark, sf).select("run_slot", "i", rounded("t", "t"))


@query("win02_history", TR + f"SELECT run_slot, count(*) AS n, {r('max(t)')} AS t, {r('avg(energy)')} AS energy FROM tr GROUP BY run_slot")
def win02(spark, sf):
    return X.trajectory(spark, sf).groupBy("run_slot").agg(F.count("*").alias("n"), rounded(F.max("t"), "t"), rounded(F.avg("energy"), "energy"))


@query("win03_window", TR + LAST + "SELECT run_slot, i FROM win")
def win03(spark, sf):
    return T.collected(X.trajectory(spark, sf), 0.25).select("run_slot", "i")


@query("win04_best_of_window", TR + LAST + f", al AS (SELECT * FROM win UNION ALL SELECT run_slot, -1, 0.0, energy, state FROM tr WHERE i = 0) SELECT run_slot, arg_min(i, (energy, i)) AS i, {r('min(energy)')} AS energy, arg_min(state, (energy, i)) AS state FROM al WHERE energy IS NOT NULL GROUP BY run_slot")
def win04(spark, sf):
    t = X.trajectory(spark, sf).withColumn("i", F.col("i").cast("long"))
    start = t.where("i = 0").withColumns({"i": F.lit(-1).cast("long"), "t": F.lit(0.0)})
    best = T.best_of_window(t.unionByName(start), 0.25)
    return best.select("run_slot", "i", rounded("energy", "energy"), "state")


@query("win05_most_frequent_state", TR + LAST + ", k AS (SELECT run_slot, state, count(*) AS n, min(i) AS first FROM win GROUP BY ALL) SELECT run_slot, arg_min(state, (-n, first)) AS state, max(n) AS n FROM k GROUP BY run_slot")
def win05(spark, sf):
    return T.most_frequent_state(X.trajectory(spark, sf), 0.25)


@query("win06_memory", TR + f"SELECT run_slot, i, {r('min(energy) OVER (PARTITION BY run_slot ORDER BY i)')} AS full_memory, {r('min(energy) OVER (PARTITION BY run_slot ORDER BY i ROWS 9 PRECEDING)')} AS last_ten FROM tr")
def win06(spark, sf):
    t = T.with_memory(X.trajectory(spark, sf)).withColumnRenamed("least", "full")
    t = T.with_memory(t, 10)
    return t.select("run_slot", "i", rounded("full", "full_memory"), rounded("least", "last_ten"))


GRID = ", gr AS (SELECT unnest(range(0, 40)) * 0.5::double AS t)"
RESAMPLED = f"""{GRID}, js AS (SELECT gr.t, ru.run_slot FROM gr, (SELECT DISTINCT run_slot FROM tr) AS ru),
lo AS (SELECT js.run_slot, js.t, max(tr.t) AS ta, arg_max(tr.energy, tr.t) AS ea FROM js LEFT JOIN tr ON tr.run_slot = js.run_slot AND tr.t <= js.t GROUP BY ALL),
hi AS (SELECT js.run_slot, js.t, min(tr.t) AS tb, arg_min(tr.energy, tr.t) AS eb FROM js LEFT JOIN tr ON tr.run_slot = js.run_slot AND tr.t > js.t GROUP BY ALL),
rs AS (SELECT run_slot, t, CASE WHEN ta IS NULL THEN eb WHEN tb IS NULL THEN ea ELSE ea + (eb - ea) * (t - ta) / (tb - ta) END AS energy FROM lo JOIN hi USING (run_slot, t))"""


def resampled(spark, sf):
    return T.resampled(X.trajectory(spark, sf), spark.range(40).select((F.col("id") * 0.5).alias("t")))


@query("win07_interpolation", TR + RESAMPLED + f" SELECT run_slot, t, {r('energy')} AS energy FROM rs")
def win07(spark, sf):
    return resampled(spark, sf).select("run_slot", "t", rounded("energy", "energy"))


@query("agg21_quantile_bands", TR + RESAMPLED + " SELECT t, " + ", ".join(f"{r(f'quantile_cont(energy, {p})')} AS p{round(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM rs GROUP BY t")
def agg21(spark, sf):
    bands = T.quantile_bands(resampled(spark, sf))
    return bands.select("t", *(rounded(c, c) for c in bands.columns[1:]))


@query("agg20_tail_slope", TR + RESAMPLED + f", sh AS (SELECT t, avg((energy > 60)::int::double) AS p FROM rs GROUP BY t) SELECT {r('regr_slope(ln(p), ln(t))')} AS slope FROM sh WHERE t > 0 AND p > 0 AND t >= (SELECT max(t) FROM sh) / 10")
def agg20(spark, sf):
    return T.tail_slope(T.exceedance(resampled(spark, sf), 60.0)).select(rounded("slope", "slope"))


@query("top01_best_run", "SELECT event_id AS run, user_id AS seed FROM events WHERE value IS NOT NULL ORDER BY value, user_id, event_id LIMIT 1")
def top01(spark, sf):
    e = table(spark, sf, "events").where("value is not null")
    return A.best_run(e.select(F.col("event_id").alias("run_slot"), F.col("user_id").alias("seed"), F.col("value").alias("energy"))).select(F.col("run_slot").alias("run"), "seed")


@query("run06_same_campaign", "WITH st AS (SELECT event_type AS experiment, user_id % 10 AS seed FROM events), pe AS (SELECT experiment, list_sort(list_distinct(list(seed))) AS s FROM st GROUP BY experiment) SELECT count(DISTINCT s) = 1 AS same_seeds, true AS same_code FROM pe")
def run06(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("experiment"), (F.col("user_id") % 10).alias("seed"), F.lit("v").alias("code"))
    return tables.same_campaign(e)


HOW = A.Annealing(3, step_size=0.2, robust_prop=0.1)
SEEDS = [1, 2, 2, 3]


def graph_points(spark, sf):
    g = geo(spark, sf)
    return GraphSpace(g.graph), stored(g.points)


@query("str01_annealing_graph")
def str01(spark, sf):
    space, points = graph_points(spark, sf)
    return A.trajectories(space, points, A.run_table(spark, SEEDS), HOW)


@query("str11_energy_recording")
def str11(spark, sf):
    space, points = graph_points(spark, sf)
    return A.trajectories(space, points, A.run_table(spark, [5]), HOW, record=True).select("run_slot", "i", "t", "energy")


@query("str12_final_states", TR + "SELECT run_slot, max(i) + 1 AS n, arg_max(state, i) AS state FROM tr GROUP BY run_slot")
def str12(spark, sf):
    return T.final_state(X.trajectory(spark, sf))


@query("str04_annealing_sphere")
def str04(spark, sf):
    return A.trajectories(Sphere(2), stored(X.sphere(spark, sf, 2)), A.run_table(spark, SEEDS), HOW)


@query("str04_annealing_bolza")
def str04_bolza(spark, sf):
    return A.trajectories(Bolza(), stored(N.bolza_blobs(spark, 40, 3)), A.run_table(spark, [1, 2]), HOW)


@query("str09_frechet_means")
def str09(spark, sf):
    p = X.sphere(spark, sf, 2).drop("label")
    return A.frechet_means(Sphere(2), Sphere(2).assign(p, X.sphere_centers(p)), A.Annealing(1, robust_prop=0.1))


@query("str10_clvq")
def str10(spark, sf):
    return A.clvq_runs(Sphere(2), stored(X.sphere(spark, sf, 2)), A.run_table(spark, [1, 2, 3]), 3)


@query("run01_worker")
def run01(spark, sf):
    space, points = graph_points(spark, sf)
    return A.minimise_energy(A.trajectories(space, points, A.run_table(spark, [7]), HOW, sample=60), HOW)


@query("run02_parallel_runs")
def run02(spark, sf):
    space, points = graph_points(spark, sf)
    return A.run_parallel(space, points, HOW, 4, SEEDS, return_all=True)


@query("run03_callback_runs")
def run03(spark, sf):
    space, points = graph_points(spark, sf)
    seen: list = []
    return A.run_parallel(space, points, HOW, 4, SEEDS, callback=lambda *x: seen.append(x))


@query("run04_multistart_nodes")
def run04(spark, sf):
    """Node-measure annealing with the most frequent node of every center slot."""
    g = geo(spark, sf)
    how = A.Annealing(3, step_size=0.2, robust_prop=0.2, energy_mode="node_measure")
    weights = {x["node_id"]: x["obs_weight"] for x in g.graph.register_observations(g.points).collect()}  # the graph of a run is held by its task
    space, points = graph_points(spark, sf)
    return A.most_frequent_nodes(g.graph, A.trajectories(space, points, A.run_table(spark, SEEDS), how, node_weights=weights), how)


@query("run05_seed_campaign")
def run05(spark, sf):
    import uuid

    from .storage import shared_dir

    path = f"{shared_dir(spark)}/lattica-campaign-{uuid.uuid4().hex}"
    space, points = graph_points(spark, sf)

    def run(seeds):
        return A.minimise_energy(A.trajectories(space, points, seeds.select(F.col("seed").cast("int").alias("run_slot"), "seed"), HOW), HOW).select("seed", "energy")

    config = {"k": HOW.k}
    tables.run_seeds(spark, [1, 2], run, path, config)
    return tables.run_seeds(spark, [1, 2, 3], run, path, config).select("seed", "energy")


@query("verify_annealing_energy", "SELECT unnest([0, 1])::int AS run_slot, 0.0::double AS difference")
def verify(spark, sf):
    """Energies reported by runs against the energy query over the emitted centers: the largest difference."""
    space, points = graph_points(spark, sf)
    found = stored(A.minimise_energy(A.trajectories(space, points, A.run_table(spark, [1, 2]), HOW), HOW))
    out = None
    for slot in (0, 1):
        centers = found.where(F.col("run_slot") == slot).select(F.posexplode("state").alias("cid", "c")).select("cid", "c.u", "c.v", "c.pos")
        d = space.assign(points, centers).agg(F.avg(F.col("d") * F.col("d")).alias("again"))
        row = found.where(F.col("run_slot") == slot).select("run_slot", "energy").crossJoin(d)
        out = row if out is None else out.unionByName(row)
    return out.select("run_slot", rounded(F.col("energy") - F.col("again"), "difference"))
