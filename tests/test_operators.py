"""Metrics, updates, Lloyd, sampling, annealing, nets, sources, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.operators import annealing as A
from lattica.operators import diagnostics as D
from lattica.operators import lloyd as L
from lattica.operators import metrics as M
from lattica.operators import sampling as P
from lattica.operators import trajectory as T
from lattica.operators import updates as U
from lattica.operators.spaces import Bolza, GraphSpace, Hyperboloid, Sphere
from lattica.plans import registry
from lattica.plans.storage import stored
from lattica.sources import graphs as S
from lattica.sources import nets as N
from lattica.sources import tables
from lattica.streaming import online

from .test_graph import centers, make, pts


def labels(spark, a, b):
    return spark.createDataFrame(list(zip(a, b)), "a int, b int")


@pytest.mark.parametrize(("a", "b", "ari", "nmi"), [([0, 0, 1, 1, 2, 2], [0, 0, 1, 1, 2, 2], 1, 1), ([0, 0, 1, 1, 2, 2], [2, 2, 0, 0, 1, 1], 1, 1), ([0, 0, 0], [1, 1, 1], 1, 1), ([0, 0, 1, 1], [0, 1, 0, 1], -0.5, 0)])
def test_label_metrics(spark, a, b, ari, nmi):
    rows = labels(spark, a, b)
    assert M.adjusted_rand_index(rows, "a", "b").first()[0] == pytest.approx(ari)
    assert M.normalized_mutual_info(rows, "a", "b").first()[0] == pytest.approx(nmi, abs=1e-9)


def test_silhouette_by_hand(spark):
    g = make(spark, [(0, 1, 10), (1, 2, 10)])
    p = pts(spark, [(0, 1, 0), (0, 1, 2), (1, 2, 10)]).withColumn("label", F.when(F.col("point_id") < 2, 0).otherwise(1))
    want = ((20 - 2) / 20 + (18 - 2) / 18 + 0) / 3
    assert M.checked_silhouette(GraphSpace(g), p).first()[0] == pytest.approx(want)
    with pytest.raises(ValueError):
        M.checked_silhouette(GraphSpace(g), p.withColumn("label", F.lit(0)))
    e = M.evaluate(GraphSpace(g), p.drop("label").withColumn("truth", F.lit(1)), centers(spark, [(0, 1, 1), (1, 2, 9)]), "truth")
    assert e.columns == ["silhouette", "ari", "nmi"]


def test_node_updates(spark):
    g = make(spark, [(i, i + 1, 1) for i in range(4)])
    p = g.with_length(pts(spark, [(0, 1, 0.9), (1, 2, 0.1), (1, 2, 0.2), (3, 4, 0.9)])).withColumn("label", F.lit(0))
    e = {r["node_id"]: r["energy"] for r in U.candidate_energies(g, p).collect()}
    assert e == {"0": 19, "1": 9, "2": 7, "3": 13, "4": 27}
    assert U.least_energy_node(g, p).first()["node_id"] == "2"
    assert U.least_energy_node(g, p, members_only=True).first()["node_id"] == "1"
    assert U.most_frequent_node(g, p).first()["node_id"] == "1"


def test_lloyd_reseeds_to_distinct_nodes(spark):
    g = make(spark, [(i, i + 1, 1) for i in range(4)])
    rows = [(0, 1, 0)] * 3 + [(2, 3, 0)] * 2 + [(4, 3, 0)] * 2
    p, start = pts(spark, rows), centers(spark, [(2, 1, 0)] * 3)
    c, energy, n = L.lloyd(GraphSpace(g), p, start, L.node_update(g), 1)
    at = sorted(r["u"] if r["pos"] == 0 else r["v"] for r in c.collect())
    assert at == ["0", "2", "4"] and energy == 0 and n == 1 and c.count() == 3
    c, energy, n = L.lloyd(GraphSpace(g), p, start, L.node_update(g, U.most_frequent_node))
    assert energy == 0 and n <= 3


def test_kmedoids(spark):
    g = make(spark, [(i, i + 1, 1) for i in range(9)])
    w = spark.createDataFrame([(str(i), 1.0) for i in (0, 1, 2, 7, 8, 9)], "node_id string, w double")
    m, energy, _ = L.kmedoids(g, w, spark.createDataFrame([(0, "0"), (1, "1")], "cid int, node_id string"))
    assert sorted(r["node_id"] for r in m.collect()) == ["1", "8"] and energy == pytest.approx(4 / 6)


def test_karcher_mean(spark):
    angles = [0.1, 0.2, 0.6]
    p = spark.createDataFrame([(i, i, [math.cos(a), math.sin(a), 0.0], 0) for i, a in enumerate(angles)], "point_id long, ord long, x array<double>, label int")
    assert U.karcher_mean(Sphere(2), p, 3).first()["x"] == pytest.approx([math.cos(0.3), math.sin(0.3), 0.0])


def test_sphere_and_hyperboloid_round_trips(spark):
    rows = [([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([0.0, 0.6, 0.8], [0.6, 0.0, -0.8]), ([1.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>").withColumn("v", G.sphere_log("x", "y"))
    got = df.select(G.sphere_exp("x", "v").alias("e"), G.sphere_norm("v").alias("n"), G.sphere_distance("x", "y").alias("d")).collect()
    for (x, y), r in zip(rows[:3], got):
        assert r["e"] == pytest.approx(y) and r["n"] == pytest.approx(r["d"])
    assert got[3]["n"] == 0 and got[3]["d"] == pytest.approx(math.pi)  # no direction to the antipode
    up = lambda a, b: [math.sqrt(1 + a * a + b * b), float(a), float(b)]
    h = spark.createDataFrame([(up(0.3, -2), up(1, 1)), (up(0, 0), up(0, 0))], "x array<double>, y array<double>").withColumn("v", G.hyperboloid_log("x", "y"))
    for r in h.select("y", G.hyperboloid_exp("x", "v").alias("e")).collect():
        assert r["e"] == pytest.approx(r["y"])
    with pytest.raises(NotImplementedError):
        Hyperboloid().random_points(3, 0)
    with pytest.raises(NotImplementedError):
        A.kernel_of(Hyperboloid())


def test_sampling_laws(spark):
    g = make(spark, [("a", "b", 1), ("b", "c", 3)])
    e = P.uniform_edges(g, 4000, 1)
    assert e.where("u = 'b'").count() / 4000 == pytest.approx(0.75, abs=0.03)
    assert g.invalid_points(e).isEmpty()
    heavy = type(g)(g.nodes.withColumn("weight", F.when(F.col("node_id") == "c", 8.0).otherwise(1.0)), g.edges)
    assert P.weighted_nodes(heavy, 3000, 2).where("u = 'c'").count() / 3000 == pytest.approx(0.8, abs=0.03)
    assert P.uniform_nodes(g, 3000, 3).where("u = 'a'").count() / 3000 == pytest.approx(1 / 3, abs=0.03)
    with pytest.raises(ValueError):
        P.weighted_nodes(type(g)(g.nodes.withColumn("weight", F.lit(0.0)), g.edges), 1, 0)
    p = pts(spark, [("a", "b", i / 10) for i in range(10)])
    assert sorted(r["ord"] for r in P.shuffled(p, 4).collect()) == list(range(10))
    assert P.random_init(p, 10, 5).select("point_id").distinct().count() == 10
    with pytest.raises(ValueError):
        P.random_init(p, 11, 5)
    assert P.bootstrap(p, 25, 6).count() == 25
    assert P.kmeans_pp(GraphSpace(g), pts(spark, [("a", "b", 0.5)] * 3), 3, 7).count() == 3  # all distances zero
    assert sorted(map(tuple, P.uniform_edges(g, 50, 1).collect())) == sorted(map(tuple, P.uniform_edges(type(g)(g.nodes.repartition(7), g.edges.repartition(5)), 50, 1).collect()))


def test_annealing_parameters():
    for bad in ({"k": 0}, {"k": True}, {"k": 2, "lambda0": 0}, {"k": 2, "beta0": "x"}, {"k": 2, "step_size": -1}, {"k": 2, "robust_prop": 1.5}, {"k": 2, "energy_mode": "obs"}):
        with pytest.raises(ValueError):
            A.Annealing(**bad)


@pytest.fixture(scope="module")
def two_piles(spark):
    g = make(spark, [(i, i + 1, 1) for i in range(6)])
    rows = [(0, 1, 0.1 * i) for i in range(8)] + [(5, 6, 0.1 * i) for i in range(8)]
    return GraphSpace(g), stored(pts(spark, rows))


def test_runs(spark, two_piles):
    space, p = two_piles
    how = A.Annealing(2, step_size=0.2, robust_prop=0.5)
    every = A.run_parallel(space, p, how, 6, [1, 1, 2, 2, 3, 3], return_all=True).collect()
    assert len(every) == 6 and [r["energy"] for r in every] == sorted(r["energy"] for r in every)
    assert len({(r["seed"], r["energy"]) for r in every}) == 3  # equal seeds, equal runs
    told = []
    best = A.run_parallel(space, p, how, 2, [1, 2], callback=lambda *x: told.append(x)).collect()
    assert len(best) == 1 and sorted(s for _, s, _ in told) == [1, 2]
    with pytest.raises(ValueError):
        A.run_parallel(space, p, how, 3, [1])
    assert best[0]["energy"] < 0.5


def test_reported_energies_are_those_of_the_centers(spark, two_piles):
    space, p = two_piles
    r = A.run_parallel(space, p, A.Annealing(2, robust_prop=0.3), 1, [4]).first()
    c = centers(spark, [(x["u"], x["v"], x["pos"]) for x in r["state"]])
    assert space.assign(p, c).agg(F.avg(F.col("d") * F.col("d"))).first()[0] == pytest.approx(r["energy"])


def test_trajectory_selection(spark, two_piles):
    space, p = two_piles
    how = A.Annealing(2, robust_prop=0.5)
    t = stored(A.trajectories(space, p, A.run_table(spark, [5, 6]), how, record=True))
    assert t.where("run_slot = 0").count() == 17 and t.agg(F.min("i")).first()[0] == -1
    best = {r["run_slot"]: r["energy"] for r in A.minimise_energy(t, how).collect()}
    for slot, least in best.items():
        own = [r for r in t.where(F.col("run_slot") == slot).collect() if r["i"] == -1 or r["i"] >= 7]
        assert least == min(r["energy"] for r in own)
    nodes = A.most_frequent_nodes(space.graph, t, how).collect()
    assert len(nodes) == 4 and all(r["state"] in "0123456" for r in nodes)
    weights = A.Annealing(2, energy_mode="node_measure")
    with pytest.raises(ValueError):
        A.trajectories(space, p, A.run_table(spark, [1]), weights)
    with pytest.raises(ValueError):
        A.trajectories(Sphere(2), N.fibonacci_net(spark, 20), A.run_table(spark, [1]), A.Annealing(2, energy_mode="uniform"))


def test_pairs_of_points_are_made_block_by_block(spark, monkeypatch):
    """The same as joins of all pairs, with equal points and blocks smaller than the table, and no pair is shuffled."""
    from lattica.operators import sphere_blocks
    from lattica.operators.spaces import Space

    for name in ("SLICE", "BLOCK"):
        monkeypatch.setattr(sphere_blocks, name, 7)
    s = Sphere(2)
    p = N.fibonacci_net(spark, 40).select("point_id", "x").union(N.fibonacci_net(spark, 40).where("point_id < 9").selectExpr("point_id + 100", "x"))
    p = stored(p.selectExpr("point_id", "x", "if(point_id % 3 = 0, null, point_id % 3) as label"))
    rows = lambda t: sorted(map(tuple, t.selectExpr(*(f"round({c}, 6)" if c in "sd" else c for c in t.columns)).collect()), key=str)
    found = s.pairs(p), s.pairs(p, p), s.nearest(p, 3), s.label_sums(p.where("label is not null"), "label")
    assert all("Join" not in t._jdf.queryExecution().toString() and "CartesianProduct" not in t._jdf.queryExecution().toString() for t in found)
    monkeypatch.setattr(sphere_blocks, "usable", lambda *_: False)
    assert rows(found[0]) == rows(s.pairs(p)) and rows(found[1]) == rows(s.pairs(p, p)) and rows(found[2]) == rows(s.nearest(p, 3))
    assert rows(found[3]) == rows(Space.label_sums(s, p.where("label is not null"), "label"))


def test_annealing_on_a_graph_without_a_matrix(spark, two_piles, monkeypatch):
    from lattica.operators import graph as Q

    space, p = two_piles
    found = []
    for most in (Q.DENSE_NODES, 1):
        monkeypatch.setattr(Q, "DENSE_NODES", most)
        monkeypatch.setattr(Q, "MATRIX_NODES", most)
        own = GraphSpace(Q.MetricGraph(space.graph.nodes, space.graph.edges))
        t = A.trajectories(own, p, A.run_table(spark, [5, 6]), A.Annealing(2), record=True)
        found.append([(r["run_slot"], r["i"], r["energy"], r["state"][0]["pos"]) for r in t.orderBy("run_slot", "i").collect()])
        again = GraphSpace(space.graph).assign(p, t.where("run_slot = 1 and i = 9").select(F.posexplode("state").alias("cid", "c")).select("cid", "c.u", "c.v", "c.pos"))
        assert again.agg(F.avg(F.col("d") * F.col("d"))).first()[0] == pytest.approx(t.where("run_slot = 1 and i = 9").first()["energy"])
    assert found[0] == [pytest.approx(x) for x in found[1]]


def test_observations_of_another_graph(spark, two_piles):
    space, p = two_piles
    for u, v, pos in (("0", "absent", 0.0), ("0", "1", 1e9)):
        odd = p.unionByName(p.limit(1).withColumns({"u": F.lit(u), "v": F.lit(v), "pos": F.lit(pos)}))
        with pytest.raises(ValueError, match="not in the space"):
            A.trajectories(space, odd, A.run_table(spark, [1]), A.Annealing(2))


def test_annealing_on_manifolds(spark):
    p = stored(N.sphere_mixture(spark, 200, 1))
    r = A.run_parallel(Sphere(2), p, A.Annealing(3, beta0=5.0, step_size=0.05, robust_prop=0.3), 4, [1, 2, 3, 4]).first()
    assert all(np.linalg.norm(c) == pytest.approx(1) for c in r["state"])
    c = spark.createDataFrame([(i, list(x)) for i, x in enumerate(r["state"])], "cid int, x array<double>")
    ari = M.adjusted_rand_index(Sphere(2).assign(p.withColumnRenamed("label", "truth"), c), "label", "truth").first()[0]
    assert ari > 0.5
    b = A.run_parallel(Bolza(), stored(N.bolza_blobs(spark, 30, 1)), A.Annealing(2), 1, [1]).first()
    assert all(np.hypot(*x) < 1 for x in b["state"])


def test_windows(spark):
    t = spark.createDataFrame([(0, i, float(i), float(e), "abcab"[i]) for i, e in enumerate((5, 3, 4, 2, 6))], "run_slot int, i int, t double, energy double, state string")
    assert [r["i"] for r in T.collected(t, 0.5).orderBy("i").collect()] == [2, 3, 4]
    assert [r["i"] for r in T.collected(t, 0.0).collect()] == [4]
    assert [r["least"] for r in T.with_memory(t).orderBy("i").collect()] == [5, 3, 3, 2, 2]
    assert [r["least"] for r in T.with_memory(t, 2).orderBy("i").collect()] == [5, 3, 3, 2, 2]
    grid = spark.createDataFrame([(-1.0,), (0.5,), (3.0,), (9.0,)], "t double")
    assert [r["energy"] for r in T.resampled(t, grid).orderBy("t").collect()] == [5, 4, 2, 6]
    assert T.most_frequent_state(t, 1.0).first()["state"] == "a"
    with pytest.raises(ValueError):
        T.collected(t, 1.5)


def test_net_spacing_is_each_points_own():
    """The spacing is the median distance to the neighbours of the same point; blocks of rows give the same neighbours."""
    x = Sphere(2).random_points(90, 4)
    near = N._nearest(Sphere(2), x, 7, False)
    assert (np.sort(near, 1) == np.sort(N._nearest(Sphere(2), x, 7, False, rows=13), 1)).all()
    far = np.arccos(np.clip(x @ x.T, -1, 1))
    _, spacing = N._push(Sphere(2), x, near, 1.0)
    for i in range(len(x)):
        others = np.sort(np.delete(far[i], i))[:7]
        assert spacing[i] == pytest.approx(np.median(others))


@pytest.mark.parametrize("mu", [(0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (0.01, 0.0, 0.99995), (0.6, 0.8, 0.0), (0.36, -0.48, -0.8)])
def test_von_mises_fisher_turns_around_its_mean(spark, mu):
    mu = tuple(np.array(mu) / np.linalg.norm(mu))
    x = np.array([r["x"] for r in N.von_mises_fisher(spark, mu, 50.0, 2000, 5).collect()])
    assert np.linalg.norm(x, axis=1) == pytest.approx(1.0)
    mean = x.mean(0)
    assert mean / np.linalg.norm(mean) == pytest.approx(np.array(mu), abs=0.02)
    assert np.linalg.norm(mean) == pytest.approx(1 / np.tanh(50.0) - 1 / 50.0, abs=0.01)


def test_nets(spark):
    ratio = {}
    for kind, net in (("uniform", N.uniform_net(spark, Sphere(2), 120, 1)), ("repulsion", N.repulsion_net(spark, Sphere(2), 120, n_iter=200))):
        x = np.array([r["x"] for r in net.collect()])
        d = np.arccos(np.clip(x @ x.T, -1, 1))
        np.fill_diagonal(d, 9)
        ratio[kind] = d.min(1).min() / d.min(1).max()
    assert ratio["repulsion"] > max(0.4, ratio["uniform"])
    a, b = (np.array([r["x"] for r in N.repulsion_net(spark, Sphere(2), 60, n_iter=30, ambient=f).orderBy("point_id").collect()]) for f in (False, True))
    assert a == pytest.approx(b)
    with pytest.raises(ValueError):
        N._nearest(Bolza(), np.zeros((5, 2)), 2, True)
    with pytest.raises(ValueError):
        N.fibonacci_net(spark, 5, Sphere(3))
    probes = N.uniform_net(spark, Sphere(2), 300, 2)
    radii = [N.covering_radius(Sphere(2), N.fibonacci_net(spark, n), probes).first()[0] for n in (50, 200)]
    assert radii[1] < radii[0]
    g = N.net_graph(Sphere(2), N.fibonacci_net(spark, 100), 0.5)
    assert g.edges.where("length > 0.5").isEmpty()
    with pytest.raises(ValueError):
        N.net_graph(Sphere(2), N.fibonacci_net(spark, 50), 0.05)


def test_radius_edges_by_cells_are_complete(spark):
    net = N.uniform_net(spark, Sphere(2), 150, 3)
    x = np.array([r["x"] for r in net.orderBy("point_id").collect()])
    d = np.arccos(np.clip(x @ x.T, -1, 1))
    for ell in (0.2, 0.9, 2.5):
        got = {(int(r["u"]), int(r["v"])) for r in N.net_edges(Sphere(2), net, ell).collect()}
        assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= ell}


def test_generators(spark):
    n, e = S.star_pair(spark)
    assert n.count() == 42 and e.count() == 41
    n, e = S.random_star_pair(spark, 3, 2, 1.0, 1.0, seed=1)
    assert e.where("u = 'A0' and v = 'B0' and length between 9 and 11").count() == 1 and n.count() == e.count() + 1
    for bad in ({"n_a": -1}, {"bridge_length": 0}):
        with pytest.raises(ValueError):
            S.star_pair(spark, **bad)
    for bad in (([1, 2], [[0.5]]), ([1], [[1.5]]), ([1, 1], [[0.5, 0.1], [0.2, 0.5]]), ([], [])):
        with pytest.raises(ValueError):
            S.block_model(spark, *bad)
    objects = spark.createDataFrame([(c, i) for i, c in enumerate("abc")], "node_id string, ord long")
    assert S.complete(objects)[1].count() == 3
    with pytest.raises(ValueError):
        S.complete(objects, spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0)], "i long, j long, d double"))
    with pytest.raises(ValueError):
        S.imported(S.star_pair(spark)[1], edge_length=-1)


def test_tables(spark, tmp_path):
    g = make(spark, [(0, 1, 1), (1, 2, 2)])
    tables.save_graph(g, str(tmp_path / "g"))
    again = tables.load_graph(spark, str(tmp_path / "g"))
    assert again.diameter().first()[0] == 3 and again.edges.count() == 2
    rows = spark.createDataFrame([("sphere net 5", 1.23456)], "name string, x double")
    tables.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["name"] == "sphere net 5"
    tables.write_latex(rows, str(tmp_path / "tex"), "name", "x")
    assert spark.read.text(str(tmp_path / "tex")).first()[0] == "\\newcommand{\\spherenet}{1.235}"
    assert set(tables.drawing(g).columns) >= {"size", "color"}
    ran = []

    def run(seeds):
        ran.append(sorted(r["seed"] for r in seeds.collect()))
        return seeds.withColumn("energy", F.col("seed") * 2.0)

    for want, config in (([1, 2], {"k": 2}), ([1, 2, 3], {"k": 2}), ([1], {"k": 3})):
        got = tables.run_seeds(spark, want, run, str(tmp_path / "runs"), config)
        assert sorted(r["seed"] for r in got.collect()) == want
    assert ran == [[1, 2], [3], [1]]


def test_diagnostics(spark):
    g = make(spark, [(0, 1, 1), (1, 2, 2)])
    u = D.pair_potential(g.node_dist, g.nodes.select(F.col("node_id").alias("v"), F.col("weight").alias("nu")))
    by = {(r["i"], r["j"]): r["u"] for r in u.collect()}
    assert by["0", "2"] == 1.0 and by["0", "0"] == 10.0 and by["0", "1"] == by["1", "0"] == 4.0
    assert 0 < D.critical_depth(g, u) <= max(by.values())
    assert D.toy_optimum(spark, 1, 2, 300).first()[0] == pytest.approx(1 / 6, abs=1e-3)
    two = make(spark, [(0, 1, 0.1), (1, 2, 0.1), (2, 3, 9), (3, 4, 0.1), (4, 5, 0.1)])
    got = {r["node_id"]: r["label"] for r in D.spectral(D.rbf_affinity(two.node_dist, 1.0), 2).collect()}
    assert got["0"] == got["1"] == got["2"] != got["3"] == got["4"] == got["5"]


def test_online_quantization_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.eye(3)[np.arange(60) % 3] + 0.1 * rng.standard_normal((60, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(i % 2, start + dt.timedelta(minutes=i), i, [float(v) for v in x[i]]) for i in range(60)]
    schema = "run_slot int, ts timestamp, point_id long, x array<double>"
    for part in range(2):
        spark.createDataFrame(rows[30 * part : 30 * part + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.online_quantization(stream, 3).writeStream.outputMode("update").format("memory").queryName("centers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("centers").groupBy("run_slot").agg(F.max("t").alias("t")).collect()
    assert {r["t"] for r in last} == {27}  # 30 points each, the first three become centers
    assert all(np.linalg.norm(r["x"]) == pytest.approx(1) for r in spark.table("centers").collect())
    e = spark.createDataFrame([(r[0], r[1], 1.0) for r in rows], "run_slot int, ts timestamp, energy double")
    assert online.energy_per_window(e, width="30 minutes").agg(F.sum("n")).first()[0] == 60


WHOLE = {"geo23_translations": 8, "geo27_quotient_distance": 1, "geo28_in_domain": 1, "geo30_nearest_copy": 1, "geo33_geodesic_arc": 10}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_manifold_queries_over_whole_tables(spark, sf, name):
    registry.load()
    n = len(spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    whole = {tuple(r) for r in registry.QUERIES[name](spark, sf).collect()}
    points = n if name in ("geo23_translations", "geo28_in_domain") else n - 1  # the others meet the point of the next id
    assert len(whole) == WHOLE[name] * points


def test_surface_exp_log_of_all_points(spark, sf):
    registry.load()
    assert registry.QUERIES["geo31_surface_exp_log"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count() - 1


def test_geodesic_pairs_of_all_points(spark, sf):
    registry.load()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    for name, dim in (("join05_pairwise", 64), ("join10_geodesic_matrix", 3)):
        x = np.array([r["embedding"][:dim] for r in rows], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        want, at = np.arccos(np.clip(x @ x.T, -1, 1)), {r["vec_id"]: k for k, r in enumerate(rows)}
        got = registry.QUERIES[name](spark, sf).toPandas()
        i, j = got["i"].map(at).to_numpy(), got["j"].map(at).to_numpy()
        assert len(got) == (len(rows) * (len(rows) - 1) // 2 if dim == 64 else len(rows) ** 2) == len(set(zip(i, j)))
        assert np.abs(got["d"].to_numpy() - want[i, j]).max() < 1e-5


def test_annealing_queries_take_all_points(spark, sf):
    from lattica.plans import run_queries

    larger = "/root/testdata/sf0.01"
    assert run_queries.graph_points(spark, larger)[1].count() == spark.read.parquet(f"{larger}/customer.parquet").count() > 150
    last = run_queries.str04(spark, sf).groupBy("run_slot").agg(F.max("i").alias("i")).collect()
    assert {r["i"] for r in last} == {spark.read.parquet(f"{sf}/embeddings.parquet").count() - 1}
