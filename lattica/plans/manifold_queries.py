"""Queries over spheres, the hyperboloid, the Poincare disk and the Bolza surface; nets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import bolza as B
from ..functions import geometry as G
from ..operators.spaces import Bolza, Hyperboloid, Sphere
from ..sources import nets as N
from . import fixtures as X
from .registry import ORACLES, query, r, rounded

S3, S64, DISK, HYP = f"WITH {X.sql_sphere(2)}\n", f"WITH {X.sql_sphere()}\n", f"WITH {X.SQL_DISK}\n", f"WITH {X.SQL_HYPERBOLOID}\n"


def parts(x: str, n: int = 3, alias: str = "x"):
    return [rounded(F.get(x, F.lit(i)), f"{alias}{i}") for i in range(n)]


def sql_parts(x: str, n: int = 3, alias: str = "x") -> str:
    return ", ".join(f"{r(f'{x}[{i + 1}]')} AS {alias}{i}" for i in range(n))


def meet(spark, sf, dim=2):
    """Every point with the point of the next id."""
    p = X.sphere(spark, sf, dim)
    return p.select("point_id", "x").join(p.select((F.col("point_id") - 1).alias("point_id"), F.col("x").alias("y")), "point_id")


MEET = "m AS (SELECT a.point_id, a.x, b.x AS y, list_dot_product(a.x, b.x) AS i FROM s AS a JOIN s AS b ON b.point_id = a.point_id + 1)"
LOG3 = "l AS (SELECT point_id, x, y, i, list_transform([1, 2, 3], lambda k: y[k] - i * x[k]) AS t FROM m), v AS (SELECT point_id, x, y, list_transform(t, lambda k: k * acos(greatest(-1, least(1, i))) / sqrt(list_dot_product(t, t))) AS v FROM l)"


@query("src09_hyperboloid_distance", HYP + f"SELECT a.point_id, {r('acosh(greatest(1.0, a.x[1] * b.x[1] - a.x[2] * b.x[2] - a.x[3] * b.x[3]))')} AS d FROM h AS a JOIN h AS b ON b.point_id = a.point_id + 1")
def src09(spark, sf):
    p = X.hyperboloid(spark, sf)
    both = p.select("point_id", "x").join(p.select((F.col("point_id") - 1).alias("point_id"), F.col("x").alias("y")), "point_id")
    return both.select("point_id", rounded(Hyperboloid().distance("x", "y"), "d"))


@query("src11_uniform_net")
def src11(spark, sf):
    return N.uniform_net(spark, Sphere(2), 200, 5)


FIB = """f0 AS (SELECT i, 1 - 2 * (i + 0.5::double) / 200 AS z, 2 * pi() * i / ((1 + sqrt(5)) / 2) AS a FROM (SELECT unnest(range(0, 200))::bigint AS i)),
f AS (SELECT i AS point_id, [sqrt(1 - z * z) * cos(a), sqrt(1 - z * z) * sin(a), z] AS x FROM f0)"""


@query("src12_fibonacci_net", f"WITH {FIB} SELECT point_id, {sql_parts('x')} FROM f")
def src12(spark, sf):
    return N.fibonacci_net(spark, 200, Sphere(2)).select("point_id", *parts("x"))


@query("src13_repulsion_net")
def src13(spark, sf):
    return N.repulsion_net(spark, Sphere(2), 120, n_iter=60)


@query("src14_repulsion_net_ambient")
def src14(spark, sf):
    return N.repulsion_net(spark, Sphere(2), 120, n_iter=60, ambient=True)


@query("src15_uniform_sphere")
def src15(spark, sf):
    return N.uniform_net(spark, Sphere(3), 300, 1)


@query("src16_uniform_octagon")
def src16(spark, sf):
    return N.uniform_net(spark, Bolza(), 300, 1)


VMF = f"""w AS (SELECT i, {X.sql_u('3', 'i', "'z'")} AS u, 2 * pi() * {X.sql_u('3', 'i', "'phi'")} AS phi FROM (SELECT unnest(range(0, 300)) AS i)),
w2 AS (SELECT i, phi, 1 + ln(u + (1 - u) * exp(-20.0)) / 10 AS h FROM w), w3 AS (SELECT i, h, sqrt(greatest(0.0, 1 - h * h)) * cos(phi) AS x, sqrt(greatest(0.0, 1 - h * h)) * sin(phi) AS y FROM w2)"""


@query("src17_von_mises_fisher", f"WITH {VMF} SELECT i AS point_id, {r('x + k * 0.6')} AS x0, {r('y + k * 0.8')} AS x1, {r('h - k')} AS x2 FROM (SELECT *, h - 0.6 * x - 0.8 * y AS k FROM w3)")
def src17(spark, sf):
    return N.von_mises_fisher(spark, (0.6, 0.8, 0.0), 10.0, 300, 3).select("point_id", *parts("x"))


@query("src18_sphere_mixture")
def src18(spark, sf):
    return N.sphere_mixture(spark, 300, 2)


@query("src18_grid_mixture")
def src18_grid(spark, sf):
    return N.grid_mixture(spark, 10, [(1, 1), (8, 8)], 2.0, 300, 2)


@query("src18_bolza_blobs")
def src18_bolza(spark, sf):
    return N.bolza_blobs(spark, 300, 2)


@query("ddl10_sphere_points", S3 + "SELECT point_id, abs(sqrt(list_dot_product(y, y)) - 1) < 1e-6 AS ok FROM (SELECT point_id, CASE WHEN point_id % 5 = 0 THEN list_transform(x, lambda v: v * 1.01) ELSE x END AS y FROM s)")
def ddl10(spark, sf):
    p = X.sphere(spark, sf, 2).withColumn("x", F.when(F.col("point_id") % 5 == 0, G.scale("x", F.lit(1.01))).otherwise(F.col("x")))
    return p.select("point_id", Sphere(2).belongs("x").alias("ok"))


@query("ddl11_disk_points", DISK + "SELECT point_id, sqrt(4 * re * re + 4 * im * im) < 1 + 1e-6 AS ok FROM z")
def ddl11(spark, sf):
    return X.disk(spark, sf).select("point_id", G.disk_belongs(G.z("re", "im").times(2)).alias("ok"))


@query("geo12_manifold_distance", S64 + f", {MEET} SELECT point_id, {r('acos(greatest(-1, least(1, i)))')} AS d FROM m")
def geo12(spark, sf):
    return meet(spark, sf, None).select("point_id", rounded(Sphere(63).distance("x", "y"), "d"))


HLOG = """k AS (SELECT a.point_id, a.x, b.x AS y, a.x[2] * b.x[2] + a.x[3] * b.x[3] - a.x[1] * b.x[1] AS i FROM h AS a JOIN h AS b ON b.point_id = a.point_id + 1),
k2 AS (SELECT point_id, x, i, list_transform([1, 2, 3], lambda j: y[j] + i * x[j]) AS t FROM k),
k3 AS (SELECT point_id, list_transform(t, lambda v: v * acosh(greatest(1.0, -i)) / sqrt(greatest(0.0, t[2] * t[2] + t[3] * t[3] - t[1] * t[1]))) AS v FROM k2)"""


@query("geo13_hyperboloid_log", HYP + f", {HLOG} SELECT point_id, {sql_parts('v', 3, 'v')} FROM k3")
def geo13(spark, sf):
    p = X.hyperboloid(spark, sf)
    both = p.select("point_id", "x").join(p.select((F.col("point_id") - 1).alias("point_id"), F.col("x").alias("y")), "point_id")
    return both.withColumn("v", G.hyperboloid_log("x", "y")).select("point_id", *parts("v", 3, "v"))


@query("geo13_hyperboloid_exp", HYP + f"SELECT point_id + 1 AS point_id, {sql_parts('y')} FROM (SELECT a.point_id, b.x AS y FROM h AS a JOIN h AS b ON b.point_id = a.point_id + 1)")
def geo13_exp(spark, sf):
    p = X.hyperboloid(spark, sf)
    both = p.select("point_id", "x").join(p.select((F.col("point_id") - 1).alias("point_id"), F.col("x").alias("y")), "point_id")
    there = both.withColumn("v", G.hyperboloid_log("x", "y")).withColumn("y", G.hyperboloid_exp("x", "v"))
    return there.select((F.col("point_id") + 1).alias("point_id"), *parts("y"))


@query("geo14_sphere_distance", S3 + f", {MEET} SELECT point_id, {r('acos(greatest(-1, least(1, i)))')} AS d FROM m")
def geo14(spark, sf):
    return meet(spark, sf).select("point_id", rounded(G.sphere_distance("x", "y"), "d"))


@query("geo15_sphere_exp", S3 + f", {MEET}, {LOG3}, g AS (SELECT point_id, x, v, sqrt(list_dot_product(v, v)) / 2 AS n FROM v) SELECT point_id, {', '.join(r(f'cos(n) * x[{i}] + sin(n) / n * v[{i}] / 2') + f' AS x{i - 1}' for i in (1, 2, 3))} FROM g")
def geo15(spark, sf):
    half = meet(spark, sf).withColumn("v", G.scale(G.sphere_log("x", "y"), 0.5))
    return half.withColumn("e", G.sphere_exp("x", "v")).select("point_id", *parts("e"))


@query("geo16_sphere_log", S3 + f", {MEET}, {LOG3} SELECT point_id, {sql_parts('v', 3, 'v')} FROM v")
def geo16(spark, sf):
    return meet(spark, sf).withColumn("v", G.sphere_log("x", "y")).select("point_id", *parts("v", 3, "v"))


@query("geo17_sphere_tangent", S3 + f", {MEET}, t AS (SELECT point_id, list_transform([1, 2, 3], lambda k: y[k] - i * x[k]) AS t FROM m) SELECT point_id, {sql_parts('t', 3, 't')}, {r('sqrt(list_dot_product(t, t))')} AS n FROM t")
def geo17(spark, sf):
    return meet(spark, sf).withColumn("t", G.sphere_to_tangent("x", "y")).select("point_id", *parts("t", 3, "t"), rounded(G.sphere_norm("t"), "n"))


@query("geo19_random_tangent")
def geo19(spark, sf):
    from ..functions.random import normal

    p = X.sphere(spark, sf, 2)
    v = F.array(*(normal(5, "point_id", F.lit(i)) for i in range(3)))
    return p.withColumn("v", v).select("point_id", G.sphere_to_tangent("x", "v").alias("v"))


TWO = "d AS (SELECT a.point_id, a.re, a.im, b.re AS wr, b.im AS wi FROM z AS a JOIN z AS b ON b.point_id = a.point_id + 1)"


def disk_pairs(spark, sf):
    p = X.disk(spark, sf)
    return p.select("point_id", "re", "im").join(p.select((F.col("point_id") - 1).alias("point_id"), F.col("re").alias("wr"), F.col("im").alias("wi")), "point_id")


def P():
    return G.z("re", "im")


def W():
    return G.z("wr", "wi")


#: 1 - conj(w) z, squared modulus; (z - w) / (1 - conj(w) z) in parts.
MOB = """mo AS (SELECT *, 1 - (wr * re + wi * im) AS er, -(wr * im - wi * re) AS ei FROM d),
mo2 AS (SELECT *, ((re - wr) * er + (im - wi) * ei) / (er * er + ei * ei) AS pr, ((im - wi) * er - (re - wr) * ei) / (er * er + ei * ei) AS pi_ FROM mo),
mo3 AS (SELECT *, sqrt(pr * pr + pi_ * pi_) AS q FROM mo2)"""


@query("geo20_disk_distance", DISK + f", {TWO}, {MOB} SELECT point_id, {r('2 * atanh(least(q, 1 - 1e-15))')} AS d FROM mo3")
def geo20(spark, sf):
    return disk_pairs(spark, sf).select("point_id", rounded(G.disk_distance(P(), W()), "d"))


@query("geo21_moebius", DISK + f", {TWO}, {MOB} SELECT point_id, {r('pr')} AS pr, {r('pi_')} AS pi, {r('re')} AS br, {r('im')} AS bi FROM mo3")
def geo21(spark, sf):
    there = G.to_origin(P(), W())
    back = G.from_origin(there, W())
    return disk_pairs(spark, sf).select("point_id", rounded(there.re, "pr"), rounded(there.im, "pi"), rounded(back.re, "br"), rounded(back.im, "bi"))


@query("geo22_disk_log", DISK + f", {TWO}, {MOB} SELECT point_id, {r('CASE WHEN q > 0 THEN pr * atanh(q) / q * (1 - wr * wr - wi * wi) ELSE 0 END')} AS vr, {r('CASE WHEN q > 0 THEN pi_ * atanh(q) / q * (1 - wr * wr - wi * wi) ELSE 0 END')} AS vi, {r('2 * atanh(q)')} AS n, {r('re')} AS br, {r('im')} AS bi FROM mo3")
def geo22(spark, sf):
    v = G.disk_log(W(), P())
    there = disk_pairs(spark, sf).withColumns({"vr": v.re, "vi": v.im})
    back = G.disk_exp(W(), G.z("vr", "vi"))
    return there.select("point_id", rounded("vr", "vr"), rounded("vi", "vi"), rounded(G.disk_norm(W(), G.z("vr", "vi")), "n"), rounded(back.re, "br"), rounded(back.im, "bi"))


#: The eight side pairings (alpha is real) and, for short words, their products, in SQL.
SIDES = "sd AS (SELECT k, 1 + sqrt(2) AS ar, 0.0::double AS ai, sqrt(2 + 2 * sqrt(2)) * cos((k + 0.5::double) * pi() / 4) AS br, sqrt(2 + 2 * sqrt(2)) * sin((k + 0.5::double) * pi() / 4) AS bi FROM (SELECT unnest(range(0, 8)) AS k))"


@query("geo23_translations", f"{DISK}, {SIDES}, mv AS (SELECT point_id, k, ar * re - ai * im + br AS nr, ar * im + ai * re + bi AS ni, br * re + bi * im + ar AS dr, br * im - bi * re - ai AS di FROM z CROSS JOIN sd) SELECT point_id, k::int AS k, {r('(nr * dr + ni * di) / (dr * dr + di * di)')} AS re, {r('(ni * dr - nr * di) / (dr * dr + di * di)')} AS im FROM mv")
def geo23(spark, sf):
    sides = F.broadcast(B.group_table(spark, B.side_pairings()).withColumnRenamed("g", "k"))
    p = X.disk(spark, sf).crossJoin(sides)
    to = G.apply_su11(G.z("a_re", "a_im"), G.z("b_re", "b_im"), P())
    return p.select("point_id", "k", rounded(to.re, "re"), rounded(to.im, "im"))


PRODUCT = "x.ar * s.ar - x.ai * s.ai + x.br * s.br + x.bi * s.bi AS ar, x.ar * s.ai + x.ai * s.ar - x.br * s.bi + x.bi * s.br AS ai, x.ar * s.br - x.ai * s.bi + x.br * s.ar + x.bi * s.ai AS br, x.ar * s.bi + x.ai * s.br - x.br * s.ai + x.bi * s.ar AS bi"
KEYED = ", ".join(f"{r(x)} AS {x}" for x in ("ar", "ai", "br", "bi"))


def group_rows(spark, ball):
    return B.group_table(spark, ball).select(*(rounded(f"{x}_{y}", f"{x}{'r' if y == 're' else 'i'}") for x in "ab" for y in ("re", "im")))


@query("geo24_word_ball", f"WITH {SIDES}, w0 AS (SELECT 1.0::double AS ar, 0.0::double AS ai, 0.0::double AS br, 0.0::double AS bi), w1 AS (SELECT {PRODUCT} FROM w0 AS x, sd AS s), w2 AS (SELECT {PRODUCT} FROM w1 AS x, sd AS s) SELECT DISTINCT {KEYED} FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2)")
def geo24(spark, sf):
    return group_rows(spark, B.word_ball(2))


NEAR = """g1 AS (SELECT 1.0::double AS ar, 0.0::double AS ai, 0.0::double AS br, 0.0::double AS bi),
""" + ",\n".join(f"g{i + 1} AS (SELECT any_value(ar) AS ar, any_value(ai) AS ai, any_value(br) AS br, any_value(bi) AS bi FROM (SELECT * FROM g{i} UNION ALL SELECT * FROM (SELECT {PRODUCT} FROM g{i} AS x, sd AS s)) WHERE 2 * atanh(least(1 - 1e-15, sqrt((br * br + bi * bi) / (ar * ar + ai * ai)))) <= 7.0 GROUP BY round(ar, 6) + 0.0, round(ai, 6) + 0.0, round(br, 6) + 0.0, round(bi, 6) + 0.0)" for i in range(1, 8))  # fmt: skip
GROUP = f"{SIDES}, {NEAR}, gg AS MATERIALIZED (SELECT * FROM g8)"


@query("geo25_near_ball", f"WITH {GROUP} SELECT DISTINCT {KEYED} FROM gg")
def geo25(spark, sf):
    return group_rows(spark, B.near_ball())


@query("geo26_copy_centres", f"WITH {GROUP} SELECT {r('(br * ar - bi * ai) / (ar * ar + ai * ai)')} AS re, {r('(bi * ar + br * ai) / (ar * ar + ai * ai)')} AS im FROM gg")
def geo26(spark, sf):
    b, a = G.z("b_re", "b_im"), G.z("a_re", "a_im")
    c = b / a.conj()
    return B.group_table(spark).select(rounded(c.re, "re"), rounded(c.im, "im"))


COPIES = """cp AS (SELECT d.point_id, re, im, ar, ai, br, bi, ar * wr - ai * wi + br AS nr, ar * wi + ai * wr + bi AS ni, br * wr + bi * wi + ar AS dr, br * wi - bi * wr - ai AS di FROM d CROSS JOIN gg),
cq AS (SELECT point_id, re, im, (nr * dr + ni * di) / (dr * dr + di * di) AS cr, (ni * dr - nr * di) / (dr * dr + di * di) AS ci FROM cp),
ce AS (SELECT point_id, cr, ci, 1 - (cr * re + ci * im) AS er, -(cr * im - ci * re) AS ei, re - cr AS xr, im - ci AS xi FROM cq),
cd AS (SELECT point_id, cr, ci, 2 * atanh(least(1 - 1e-15, sqrt((xr * xr + xi * xi) / (er * er + ei * ei)))) AS d FROM ce)"""


@query("geo27_quotient_distance", f"{DISK}, {TWO}, {GROUP}, {COPIES} SELECT point_id, {r('min(d)')} AS d FROM cd GROUP BY point_id")
def geo27(spark, sf):
    return disk_pairs(spark, sf).select("point_id", rounded(B.quotient_distance(P(), W()), "d"))


@query("geo28_in_domain", f"{DISK}, {GROUP}, far AS (SELECT point_id, re * 1.4 AS re, im * 1.4 AS im FROM z), ct AS (SELECT (br * ar - bi * ai) / (ar * ar + ai * ai) AS cr, (bi * ar + br * ai) / (ar * ar + ai * ai) AS ci FROM gg WHERE br * br + bi * bi > 1e-9), dd AS (SELECT point_id, re, im, min(2 * atanh(least(1 - 1e-15, sqrt(((cr - re) * (cr - re) + (ci - im) * (ci - im)) / ((1 - (re * cr + im * ci)) ^ 2 + (re * ci - im * cr) ^ 2))))) AS d FROM far CROSS JOIN ct GROUP BY ALL) SELECT point_id, 2 * atanh(sqrt(re * re + im * im)) <= d + 1e-9 AS inside FROM dd")
def geo28(spark, sf):
    far = X.disk(spark, sf).select("point_id", (F.col("re") * 1.4).alias("re"), (F.col("im") * 1.4).alias("im"))
    return far.select("point_id", B.in_domain(P()).alias("inside"))


@query("geo29_fold")
def geo29(spark, sf):
    def fold(batches):
        for b in batches:
            p = B.np_fold((b["re"] + 1j * b["im"]).to_numpy() * 1.5)
            yield b.assign(re=p.real, im=p.imag)

    return X.disk(spark, sf).select("point_id", "re", "im").mapInPandas(fold, "point_id long, re double, im double")


@query("geo30_nearest_copy", f"{DISK}, {TWO}, {GROUP}, {COPIES} SELECT point_id, {r('min(d)')} AS d, {r('arg_min(cr, d)')} AS re, {r('arg_min(ci, d)')} AS im FROM cd GROUP BY point_id")
def geo30(spark, sf):
    best = B.nearest_copy(P(), W())
    return disk_pairs(spark, sf).withColumn("b", best).select("point_id", rounded("b.d", "d"), rounded("b.re", "re"), rounded("b.im", "im"))


@query("geo31_surface_exp_log", f"SELECT point_id, d AS norm, re, im FROM ({ORACLES['geo30_nearest_copy']})")
def geo31(spark, sf):
    """There and back: exp(log) ends at the nearest copy of the target, and the logarithm is as long as the way there."""
    # The copy and the logarithm are each found below a generator, so that they are computed once a point.
    x = disk_pairs(spark, sf).withColumn("b", F.explode(F.array(B.nearest_copy(P(), W()))))
    log = G.disk_log(P(), G.z("b.re", "b.im"))
    x = x.withColumn("l", F.explode(F.array(F.struct(log.re.alias("re"), log.im.alias("im")))))
    v = G.z("l.re", "l.im")
    e = G.disk_exp(P(), v)
    return x.select("point_id", rounded(G.disk_norm(P(), v), "norm"), rounded(e.re, "re"), rounded(e.im, "im"))


@query("geo33_geodesic_arc", DISK + f""", {TWO}, {MOB.replace("(re - wr)", "(wr - re)").replace("(im - wi)", "(wi - im)").replace("1 - (wr * re + wi * im) AS er, -(wr * im - wi * re) AS ei", "1 - (re * wr + im * wi) AS er, -(re * wi - im * wr) AS ei")},
ar AS (SELECT point_id, j, re, im, CASE WHEN q > 0 THEN pr / q * tanh(atanh(q) * j / 9.0::double) ELSE 0 END AS ur, CASE WHEN q > 0 THEN pi_ / q * tanh(atanh(q) * j / 9.0::double) ELSE 0 END AS ui FROM mo3, (SELECT unnest(range(0, 10)) AS j))
SELECT point_id, j::int AS j, {r('((ur + re) * (1 + re * ur + im * ui) + (ui + im) * (re * ui - im * ur)) / ((1 + re * ur + im * ui) ^ 2 + (re * ui - im * ur) ^ 2)')} AS x, {r('((ui + im) * (1 + re * ur + im * ui) - (ur + re) * (re * ui - im * ur)) / ((1 + re * ur + im * ui) ^ 2 + (re * ui - im * ur) ^ 2)')} AS y FROM ar""")
def geo33(spark, sf):
    # The logarithm is a column of its own below the generator, so that it is computed once a point.
    log = G.disk_log(P(), W())
    x = disk_pairs(spark, sf).withColumns({"lr": log.re, "li": log.im}).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(9))))
    e = G.disk_exp(P(), G.z("lr", "li").times(F.col("j") / 9.0))
    return x.select("point_id", "j", rounded(e.re, "x"), rounded(e.im, "y"))


@query("join05_pairwise", S64 + f"SELECT a.point_id AS i, b.point_id AS j, {r('acos(greatest(-1, least(1, list_dot_product(a.x, b.x))))')} AS d FROM s AS a JOIN s AS b ON a.point_id < b.point_id")
def join05(spark, sf):
    return Sphere(63).pairs(X.sphere(spark, sf)).select("i", "j", rounded("d", "d"))


@query("join09_paired_geodesic", S3 + f", {MEET} SELECT point_id, {r('acos(greatest(-1, least(1, i)))')} AS d FROM m")
def join09(spark, sf):
    x = meet(spark, sf).withColumn("v", G.sphere_log("x", "y"))
    return x.select("point_id", rounded(G.sphere_norm("v"), "d"))


@query("join10_geodesic_matrix", S3 + f"SELECT a.point_id AS i, b.point_id AS j, {r('acos(greatest(-1, least(1, list_dot_product(a.x, b.x))))')} AS d FROM s AS a, s AS b")
def join10(spark, sf):
    p = X.sphere(spark, sf, 2)
    return Sphere(2).pairs(p, p).select("i", "j", rounded("d", "d"))


@query("join11_covering_radius", S3 + f", {FIB} SELECT {r('max(d)')} AS radius FROM (SELECT s.point_id, min(acos(greatest(-1, least(1, list_dot_product(s.x, f.x))))) AS d FROM s CROSS JOIN f GROUP BY s.point_id)")
def join11(spark, sf):
    return N.covering_radius(Sphere(2), N.fibonacci_net(spark, 200), X.sphere(spark, sf, 2)).select(rounded("radius", "radius"))


@query("join12_radius_edges", f"WITH {FIB} SELECT a.point_id::varchar AS u, b.point_id::varchar AS v, {r('acos(greatest(-1, least(1, list_dot_product(a.x, b.x))))')} AS length FROM f AS a JOIN f AS b ON a.point_id < b.point_id WHERE acos(greatest(-1, least(1, list_dot_product(a.x, b.x)))) <= 0.4")
def join12(spark, sf):
    return N.net_edges(Sphere(2), N.fibonacci_net(spark, 200), 0.4).select("u", "v", rounded("length", "length"))


@query("join13_net_to_graph")
def join13(spark, sf):
    return N.approximate_geodesic_space(spark, Sphere(2), 150, "fibonacci").edges


def neighbours(spark, sf, k):
    return Sphere(2).nearest(X.sphere(spark, sf, 2), k).select("i", "j", rounded("d", "d"))


KNN = S3 + ", q AS (SELECT a.point_id AS i, b.point_id AS j, acos(greatest(-1, least(1, list_dot_product(a.x, b.x)))) AS d FROM s AS a JOIN s AS b ON a.point_id <> b.point_id) SELECT i, j, " + r("d") + " AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM q) WHERE k <= {}"


@query("join14_nearest_neighbours", KNN.format(12))
def join14(spark, sf):
    return neighbours(spark, sf, 12)


@query("top04_smallest_k", KNN.format(3))
def top04(spark, sf):
    return neighbours(spark, sf, 3)


@query("join15_nearest_net_node", S3 + f", {FIB}, q AS (SELECT s.point_id, f.point_id AS node, acos(greatest(-1, least(1, list_dot_product(s.x, f.x)))) AS d FROM s CROSS JOIN f) SELECT point_id, arg_min(node, (d, node))::int AS node, {r('min(d)')} AS d FROM q GROUP BY point_id")
def join15(spark, sf):
    net = N.fibonacci_net(spark, 200).select(F.col("point_id").cast("int").alias("cid"), "x")
    return Sphere(2).assign(X.sphere(spark, sf, 2), net).select("point_id", F.col("label").alias("node"), rounded("d", "d"))


@query("join17_voronoi_raster", f"""WITH {GROUP}, ra AS (SELECT (i * 13 + j)::bigint AS point_id, (i - 6) / 12.0::double AS re, (j - 6) / 12.0::double AS im FROM (SELECT unnest(range(0, 13)) AS i), (SELECT unnest(range(0, 13)) AS j)),
ce0 AS (SELECT k AS cid, 0.45 * cos(2 * pi() * k / 3) AS wr, 0.45 * sin(2 * pi() * k / 3) AS wi FROM (SELECT unnest(range(0, 3)) AS k)),
cp AS (SELECT cid, ar * wr - ai * wi + br AS nr, ar * wi + ai * wr + bi AS ni, br * wr + bi * wi + ar AS dr, br * wi - bi * wr - ai AS di FROM ce0 CROSS JOIN gg),
cq AS (SELECT cid, (nr * dr + ni * di) / (dr * dr + di * di) AS cr, (ni * dr - nr * di) / (dr * dr + di * di) AS ci FROM cp),
cd AS (SELECT point_id, cid, round(min(2 * atanh(least(1 - 1e-15, sqrt(((cr - re) ^ 2 + (ci - im) ^ 2) / ((1 - (cr * re + ci * im)) ^ 2 + (cr * im - ci * re) ^ 2))))), 9) AS d FROM ra CROSS JOIN cq GROUP BY ALL)
SELECT point_id, arg_min(cid, (d, cid))::int AS label FROM cd GROUP BY point_id""")
def join17(spark, sf):
    raster = spark.range(13).toDF("i").crossJoin(spark.range(13).toDF("j")).select((F.col("i") * 13 + F.col("j")).alias("point_id"), F.array((F.col("i") - 6) / 12.0, (F.col("j") - 6) / 12.0).alias("x"))
    angle = 2 * math.pi / 3
    centers = spark.createDataFrame([(k, [0.45 * math.cos(angle * k), 0.45 * math.sin(angle * k)]) for k in range(3)], "cid int, x array<double>")
    d = Bolza().distances(raster, centers).withColumn("d", F.round("d", 9))
    return d.groupBy("point_id").agg(F.min_by("cid", F.struct("d", "cid")).alias("label"))


@query("str05_manifold_drift", S3 + f", {MEET}, {LOG3}, g AS (SELECT point_id, x, v, sqrt(list_dot_product(v, v)) * 0.3 AS n FROM v) SELECT point_id, {', '.join(r(f'cos(n) * x[{i}] + sin(n) / n * v[{i}] * 0.3') + f' AS x{i - 1}' for i in (1, 2, 3))} FROM g")
def str05(spark, sf):
    return meet(spark, sf).withColumn("e", G.sphere_drift("x", "y", 0.3)).select("point_id", *parts("e"))


@query("bas04_sphere_maps", S3 + f", {MEET}, {LOG3} SELECT point_id, {sql_parts('y')} FROM v")
def bas04(spark, sf):
    """exp(log) gives the target back, of unit length."""
    x = meet(spark, sf).withColumn("v", G.sphere_log("x", "y")).withColumn("e", G.normalised(G.sphere_exp("x", "v")))
    return x.select("point_id", *parts("e"))

