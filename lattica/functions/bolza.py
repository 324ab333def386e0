"""The Bolza surface: its Fuchsian group as small tables, and quotient geometry over the disk.

The group ball is found once on the driver; its size depends on the cutoff alone (265 elements at 7.0), so it is safe to
broadcast or to write into an expression.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import geometry as G

COSH_HALF = 1 + np.sqrt(2.0)
SINH_HALF = np.sqrt(COSH_HALF**2 - 1)
CUTOFF = 7.0
OCTAGON_RADIUS = 2.0**-0.25


def side_pairings() -> np.ndarray:
    """The eight translations across the sides, as (alpha, beta)."""
    angle = (np.arange(8) + 0.5) * np.pi / 4
    return np.stack([np.full(8, COSH_HALF, complex), SINH_HALF * np.exp(1j * angle)], 1)


def _times(g: np.ndarray, s: np.ndarray) -> np.ndarray:
    """All products of rows of g and s, in order of g."""
    a, b, c, d = g[:, None, 0], g[:, None, 1], s[None, :, 0], s[None, :, 1]
    return np.stack([a * c + b * d.conj(), a * d + b * c.conj()], -1).reshape(-1, 2)


def _expanded(keep, rounds: int | None) -> np.ndarray:
    sides, found = side_pairings(), np.array([[1.0 + 0j, 0j]])
    seen, front = {(1.0, 0.0, 0.0, 0.0)}, found
    while len(front) and rounds != 0:
        rounds = None if rounds is None else rounds - 1
        new = []
        for g in _times(front, sides):
            key = tuple(float(round(x, 6)) + 0.0 for x in (g[0].real, g[0].imag, g[1].real, g[1].imag))
            if key not in seen:
                seen.add(key)
                if keep(g):
                    new.append(g)
        front = np.array(new).reshape(-1, 2)
        found = np.concatenate([found, front])
    return found


def word_ball(radius: int) -> np.ndarray:
    """(alpha, beta) of all words of at most radius side pairings, identity first."""
    return _expanded(lambda g: True, radius)


@lru_cache(maxsize=8)
def near_ball(cutoff: float = CUTOFF) -> np.ndarray:
    """(alpha, beta) of all elements that move the origin by at most cutoff, identity first."""
    return _expanded(lambda g: 2 * np.arctanh(min(abs(g[1] / np.conj(g[0])), 1 - 1e-15)) <= cutoff, None)


def group_table(spark: SparkSession, ball: np.ndarray | None = None) -> DataFrame:
    """(g, a_re, a_im, b_re, b_im), to be broadcast."""
    ball = near_ball() if ball is None else ball
    rows = [(i, float(a.real), float(a.imag), float(b.real), float(b.imag)) for i, (a, b) in enumerate(ball)]
    return spark.createDataFrame(rows, "g int, a_re double, a_im double, b_re double, b_im double")


def with_copies(points: DataFrame, re: str = "wre", im: str = "wim", ball: np.ndarray | None = None) -> DataFrame:
    """points with a row for every group element g and the copy (cre, cim) of the point."""
    group = F.broadcast(group_table(points.sparkSession, ball))
    copy = G.apply_su11(G.z("a_re", "a_im"), G.z("b_re", "b_im"), G.z(re, im))
    return points.crossJoin(group).withColumns({"cre": copy.re, "cim": copy.im}).drop("a_re", "a_im", "b_re", "b_im")


def quotient_distance(p: G.Complex, q: G.Complex, ball: np.ndarray | None = None) -> Column:
    """Least distance of p to any copy of q, as one expression over a constant array."""
    copies = _group_array(ball)
    return F.array_min(F.transform(copies, lambda g: G.disk_distance(p, G.apply_su11(G.Complex(g["ar"], g["ai"]), G.Complex(g["br"], g["bi"]), q))))


def _group_array(ball: np.ndarray | None = None) -> Column:
    ball = near_ball() if ball is None else ball
    text = ";".join(",".join(repr(float(x)) for x in (a.real, a.imag, b.real, b.imag)) for a, b in ball)
    parts = F.transform(F.split(F.lit(text), ";"), lambda s: F.split(s, ",").cast("array<double>"))
    return F.transform(parts, lambda x: F.struct(*(F.get(x, F.lit(i)).alias(n) for i, n in enumerate(("ar", "ai", "br", "bi")))))


def nearest_copy(base: G.Complex, p: G.Complex, ball: np.ndarray | None = None) -> Column:
    """struct(d, g, re, im) of the copy of p that is nearest to base; the identity, then the earlier element, wins ties."""

    def at(g: Column, i: Column) -> Column:
        c = G.apply_su11(G.Complex(g["ar"], g["ai"]), G.Complex(g["br"], g["bi"]), p)
        return F.struct(G.disk_distance(base, c).alias("d"), i.alias("g"), c.re.alias("re"), c.im.alias("im"))

    return F.array_min(F.transform(_group_array(ball), at))


def in_domain(p: G.Complex, tol: float = 1e-9) -> Column:
    """At least as near to the origin as to any other copy of it."""
    origin = G.Complex(F.lit(0.0), F.lit(0.0))
    away = F.transform(F.slice(_group_array(), 2, len(near_ball())), lambda g: G.disk_distance(G.Complex(g["br"], g["bi"]) / G.Complex(g["ar"], -g["ai"]), p))
    return G.disk_distance(origin, p) <= F.array_min(away) + tol


def np_distance(p, q):
    r = np.abs(p - q) / np.abs(1 - np.conj(q) * p)
    return 2 * np.arctanh(np.clip(r, 0, 1 - 1e-15))


def np_fold(points: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Representatives in the octagon: the best side pairing, again and again, while it comes nearer to the origin."""
    p, sides = np.array(points, complex).ravel(), side_pairings()
    live = np.arange(len(p))
    for _ in range(rounds):
        if not len(live):
            break
        now = p[live]
        moved = (sides[:, :1] * now + sides[:, 1:]) / (sides[:, 1:].conj() * now + sides[:, :1].conj())
        best = np.abs(moved).argmin(0)
        to = moved[best, np.arange(len(now))]
        nearer = np_distance(0, to) < np_distance(0, now) - 1e-12
        live, to = live[nearer], to[nearer]
        p[live] = to
    return p.reshape(np.shape(points))


def np_quotient(p, q) -> np.ndarray:
    """Quotient distances of two broadcastable complex arrays."""
    ball = near_ball()
    p, q = np.asarray(p, complex)[..., None], np.asarray(q, complex)[..., None]
    return np_distance(p, (ball[:, 0] * q + ball[:, 1]) / (ball[:, 1].conj() * q + ball[:, 0].conj())).min(-1)


def np_nearest_copy(p: complex, q: complex) -> complex:
    ball = near_ball()
    copies = (ball[:, 0] * q + ball[:, 1]) / (ball[:, 1].conj() * q + ball[:, 0].conj())
    return copies[np_distance(p, copies).argmin()]


def np_exp(base, v):
    v = v / (1 - np.abs(base) ** 2)
    n = np.abs(v)
    p = np.where(n > 0, np.tanh(n) * v / np.where(n > 0, n, 1), 0)
    return (p + base) / (1 + np.conj(base) * p)


def np_log(base, p):
    at = (p - base) / (1 - np.conj(base) * p)
    n = np.abs(at)
    return (1 - np.abs(base) ** 2) * np.where(n > 0, np.arctanh(np.clip(n, 0, 1 - 1e-15)) * at / np.where(n > 0, n, 1), 0)


def np_uniform(n: int, rng: np.random.Generator) -> np.ndarray:
    """n points, uniform by hyperbolic area, in the octagon, by rejection from the disk around it."""
    top, out, have = np.cosh(np_distance(0, OCTAGON_RADIUS)), [], 0
    ball = near_ball()[1:]
    centres = ball[:, 1] / ball[:, 0].conj()
    while have < n:
        m = 3 * (n - have) + 32
        p = np.tanh(np.arccosh(1 + rng.random(m) * (top - 1)) / 2) * np.exp(2j * np.pi * rng.random(m))
        p = p[np_distance(0, p) <= np_distance(p[:, None], centres).min(1) + 1e-12]
        out.append(p)
        have += len(p)
    return np.concatenate(out)[:n] if out else np.zeros(0, complex)
