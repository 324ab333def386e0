"""Closed-form geometry as Column expressions: vectors, sphere, hyperboloid, Poincare disk and its isometries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

TINY = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def dot(x, y) -> Column:
    return F.aggregate(F.zip_with(_c(x), _c(y), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x) -> Column:
    return F.sqrt(dot(x, x))


def scale(x, k) -> Column:
    return F.transform(_c(x), lambda a: a * k)


def plus(x, y) -> Column:
    return F.zip_with(_c(x), _c(y), lambda a, b: a + b)


def normalised(x) -> Column:
    x = _c(x)
    return F.transform(x, lambda a: a / norm(x))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# Sphere: unit vectors of any dimension.


def sphere_distance(x, y) -> Column:
    return F.acos(clipped(dot(x, y), -1.0, 1.0))


def sphere_to_tangent(base, v) -> Column:
    inner = dot(base, v)
    return F.zip_with(_c(v), _c(base), lambda a, b: a - inner * b)


def sphere_exp(base, v) -> Column:
    """Moves along the tangential part of v; a part shorter than 1e-12 stays at base."""
    t = sphere_to_tangent(base, v)
    n = norm(t)
    moved = F.zip_with(_c(base), t, lambda b, a: F.cos(n) * b + F.sin(n) / n * a)
    return F.when(n <= TINY, _c(base)).otherwise(moved)


def sphere_log(base, x) -> Column:
    """Zero for equal and for antipodal points."""
    inner = clipped(dot(base, x), -1.0, 1.0)
    t = sphere_to_tangent(base, x)
    n = norm(t)
    return F.when(n <= TINY, F.transform(_c(x), lambda a: a * 0.0)).otherwise(scale(t, F.acos(inner) / n))


def sphere_norm(v) -> Column:
    return norm(v)


def sphere_drift(base, target, share) -> Column:
    return sphere_exp(base, scale(sphere_log(base, target), _c(share)))


# Hyperboloid: -x0^2 + x1^2 + ... = -1, x0 > 0.


def lorentz(x, y) -> Column:
    x, y = _c(x), _c(y)
    return dot(x, y) - 2 * F.get(x, F.lit(0)) * F.get(y, F.lit(0))


def hyperboloid_distance(x, y) -> Column:
    return F.acosh(F.greatest(F.lit(1.0), -lorentz(x, y)))


def hyperboloid_exp(base, v) -> Column:
    n = F.sqrt(F.greatest(F.lit(0.0), lorentz(v, v)))
    return F.when(n <= TINY, _c(base)).otherwise(F.zip_with(_c(base), _c(v), lambda b, a: F.cosh(n) * b + F.sinh(n) / n * a))


def hyperboloid_log(base, x) -> Column:
    inner = lorentz(base, x)
    t = F.zip_with(_c(x), _c(base), lambda a, b: a + inner * b)
    n = F.sqrt(F.greatest(F.lit(0.0), lorentz(t, t)))
    return F.when(n <= TINY, scale(t, F.lit(0.0))).otherwise(scale(t, hyperboloid_distance(base, x) / n))


# Poincare disk: complex numbers as pairs of Columns.


@dataclass(frozen=True)
class Complex:
    re: Column
    im: Column

    def __add__(self, o):
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o):
        return Complex(self.re - o.re, self.im - o.im)

    def __mul__(self, o):
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __truediv__(self, o):
        n = o.re * o.re + o.im * o.im
        return Complex((self.re * o.re + self.im * o.im) / n, (self.im * o.re - self.re * o.im) / n)

    def conj(self):
        return Complex(self.re, -self.im)

    def times(self, k) -> "Complex":
        return Complex(self.re * k, self.im * k)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.sqrt(self.abs2())


def z(re, im) -> Complex:
    return Complex(_c(re), _c(im))


def one() -> Complex:
    return Complex(F.lit(1.0), F.lit(0.0))


def to_origin(p: Complex, base: Complex) -> Complex:
    return (p - base) / (one() - base.conj() * p)


def from_origin(p: Complex, base: Complex) -> Complex:
    return (p + base) / (one() + base.conj() * p)


def disk_distance(p: Complex, q: Complex) -> Column:
    r = (p - q).abs() / (one() - q.conj() * p).abs()
    return 2 * F.atanh(clipped(r, 0.0, 1 - 1e-15))


def disk_log(base: Complex, p: Complex) -> Complex:
    at = to_origin(p, base)
    n = at.abs()
    k = F.when(n > 0, F.atanh(clipped(n, 0.0, 1 - 1e-15)) / n).otherwise(0.0)
    return at.times(k * (1 - base.abs2()))


def disk_exp(base: Complex, v: Complex) -> Complex:
    v = v.times(1 / (1 - base.abs2()))
    n = v.abs()
    return from_origin(v.times(F.when(n > 0, F.tanh(n) / n).otherwise(0.0)), base)


def disk_norm(base: Complex, v: Complex) -> Column:
    return 2 * v.abs() / (1 - base.abs2())


def apply_su11(a: Complex, b: Complex, p: Complex) -> Complex:
    """The isometry [[a, b], [conj b, conj a]]."""
    return (a * p + b) / (b.conj() * p + a.conj())


def disk_belongs(p: Complex, atol: float = 1e-6) -> Column:
    return p.abs() < 1 + atol
