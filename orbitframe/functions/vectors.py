"""Vectors of Columns: point-wise geometry, periodic boxes and lattice images, all as built-in expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


@dataclass(frozen=True)
class Vec:
    """Three Columns (or numbers) with the usual algebra."""

    x: Column | float
    y: Column | float
    z: Column | float

    def __iter__(self):
        return iter((self.x, self.y, self.z))

    def __add__(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def __mul__(self, s) -> Vec:
        return Vec(self.x * s, self.y * s, self.z * s)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm_squared(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm_squared())

    def normalized(self) -> Vec:
        """The unit vector; zero for the zero vector, null where a component is null."""
        n = self.norm()
        unit = lambda c: F.when(n > 0, c / F.nullif(n, F.lit(0.0))).when(n <= 0, 0.0)
        return Vec(unit(self.x), unit(self.y), unit(self.z))

    def to_array(self) -> Column:
        return F.array(*map(_col, self))


def vec(prefix: str = "", suffix: str = "") -> Vec:
    """The vector held in columns x, y, z with a prefix or suffix."""
    return Vec(*(F.col(f"{prefix}{c}{suffix}") for c in "xyz"))


def distance(a: Vec, b: Vec) -> Column:
    return (a - b).norm()


def angle(a: Vec, b: Vec) -> Column:
    """Angle of two vectors in radians; 0 if either is zero, null if either has a null component."""
    length = a.norm() * b.norm()
    cosine = a.dot(b) / F.nullif(length, F.lit(0.0))
    return F.when(length > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).when(length <= 0, 0.0)


def normal(a: Vec, b: Vec) -> Vec:
    """Unit normal of the plane of two vectors; zero if they are collinear."""
    return a.cross(b).normalized()


def triple(a: Vec, b: Vec, c: Vec) -> Column:
    return a.dot(b.cross(c))


def dihedral(ab: Vec, bc: Vec, cd: Vec) -> Column:
    """Torsion with cis at 0: the angle of the plane normals, positive where ab . (bc x cd) <= 0; degenerate gives 0, null gives null."""
    a = angle(normal(ab, bc), normal(bc, cd))
    return F.when(triple(ab, bc, cd) <= 0, a).otherwise(-a)


def dihedral_atan2(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Torsion with cis at pi by atan2; NaN where the middle bond or a projected arm vanishes, null where a place is null."""
    first, middle, last = b - a, c - b, d - c
    p, q = first.cross(middle), last.cross(middle)
    ok = (middle.norm_squared() > 0) & (p.norm_squared() > 0) & (q.norm_squared() > 0)
    return F.when(ok, F.atan2(middle.dot(p.cross(q)) / F.nullif(middle.norm(), F.lit(0.0)), p.dot(q))).when(~ok, F.lit(float("nan")))


def determinant(a: Vec, b: Vec, c: Vec) -> Column:
    return triple(a, b, c)


def inverse(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Vec, Vec]:
    """Rows of the inverse of the matrix with rows a, b, c; null where its determinant is (nearly) zero."""
    det = determinant(a, b, c)
    one = F.when(F.abs(det) > 2.220446049250313e-16, 1 / F.nullif(det, F.lit(0.0)))
    columns = b.cross(c) * one, c.cross(a) * one, a.cross(b) * one
    return tuple(Vec(*(getattr(col, axis) for col in columns)) for axis in "xyz")


def pdot(first: Column, second: Column) -> Column:
    """Inner products of two arrays of points, pair by pair; arrays of different lengths are an error."""
    one = lambda p, q: sum(p[k] * q[k] for k in range(3))
    return F.when(F.size(first) == F.size(second), F.zip_with(first, second, one)).otherwise(F.raise_error(F.lit("arrays of different lengths")))


def pnorm(points: Column) -> Column:
    """Lengths of an array of points."""
    return F.transform(points, lambda p: F.sqrt(sum(p[k] * p[k] for k in range(3))))


def _dot(a: list[float], b: list[float]) -> float:
    return sum(x * y for x, y in zip(a, b))


def _squared(a: list[float]) -> float:
    return _dot(a, a)


def _less(a: list[float], b: list[float], times: float) -> list[float]:
    return [x - times * y for x, y in zip(a, b)]


def _cross(p: list[float], q: list[float]) -> list[float]:
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


@dataclass(frozen=True)
class Box:
    """A periodic cell given by lengths and angles in degrees, held on the driver."""

    a: float
    b: float
    c: float
    alpha: float = 90.0
    beta: float = 90.0
    gamma: float = 90.0

    def __post_init__(self):
        values = (self.a, self.b, self.c, self.alpha, self.beta, self.gamma)
        if not all(math.isfinite(v) and v > 0 for v in values) or any(v >= 180 for v in values[3:]):
            raise ValueError("a box needs positive finite lengths and angles between 0 and 180 degrees")
        if self._depth2() <= 1e-12 * self.c**2:
            raise ValueError("the angles of the box leave it no volume")

    @property
    def orthogonal(self) -> bool:
        return self.alpha == self.beta == self.gamma == 90.0

    def _third(self) -> tuple[float, float, float, float]:
        """cos and sin of gamma, and the third vector's components along x and y."""
        ca, cb, cg = (0.0 if v == 90.0 else math.cos(math.radians(v)) for v in (self.alpha, self.beta, self.gamma))
        sg = 1.0 if self.gamma == 90.0 else math.sin(math.radians(self.gamma))
        return cg, sg, self.c * cb, self.c * (ca - cb * cg) / sg

    def _depth2(self) -> float:
        """The square of the third vector's component along z; not positive for angles that fit no cell."""
        _, _, cx, cy = self._third()
        return self.c**2 - cx**2 - cy**2

    def vectors(self) -> list[list[float]]:
        """Lower triangular lattice vectors, one a row."""
        cg, sg, cx, cy = self._third()
        return [[self.a, 0.0, 0.0], [self.b * cg, self.b * sg, 0.0], [cx, cy, math.sqrt(self._depth2())]]

    def volume(self) -> float:
        v = self.vectors()
        return v[0][0] * v[1][1] * v[2][2]

    def heights(self) -> list[float]:
        """Distances between opposite faces."""
        v, out = self.vectors(), []
        for k in range(3):
            out.append(self.volume() / math.sqrt(_squared(_cross(v[(k + 1) % 3], v[(k + 2) % 3]))))
        return out

    def to_fractional(self, r: Vec) -> Vec:
        v = self.vectors()
        z = r.z / F.lit(v[2][2])
        y = (r.y - z * v[2][1]) / F.lit(v[1][1])
        return Vec((r.x - y * v[1][0] - z * v[2][0]) / F.lit(v[0][0]), y, z)

    def to_cartesian(self, s: Vec) -> Vec:
        v = self.vectors()
        return Vec(s.x * v[0][0] + s.y * v[1][0] + s.z * v[2][0], s.y * v[1][1] + s.z * v[2][1], s.z * v[2][2])

    def wrap(self, r: Vec) -> Vec:
        """The image inside the cell."""
        if self.orthogonal:
            return Vec(*(F.pmod(c, F.lit(n)) for c, n in zip(r, (self.a, self.b, self.c))))
        s = self.to_fractional(r)
        return self.to_cartesian(Vec(*(F.pmod(c, F.lit(1.0)) for c in s)))

    def reduced(self) -> list[list[float]]:
        """A basis of the same lattice whose vectors are as short as can be, the shortest first."""
        basis = self.vectors()
        while True:
            basis.sort(key=_squared)
            for k, other in ((1, basis[0]), (2, basis[0]), (2, basis[1])):
                basis[k] = _less(basis[k], other, round(_dot(basis[k], other) / _squared(other)))
            found = None
            for k in range(3):
                p, q = basis[(k + 1) % 3], basis[(k + 2) % 3]
                for i, j in product((-1, 0, 1), repeat=2):
                    other = _less(_less(basis[k], p, i), q, j)
                    if _squared(other) < _squared(basis[k]) * (1 - 1e-12):
                        found, basis[k] = True, other
            if not found and all(_squared(basis[k]) <= _squared(basis[k + 1]) for k in (0, 1)):
                return basis

    def image_shifts(self) -> tuple[list[list[float]], list[list[float]], list[tuple[int, int, int]]]:
        """(reduced basis, its reciprocal rows, steps): some step from a rounded displacement leads to its nearest image.

        No displacement is further from the lattice than half the diagonal of the brick spanned by the basis made
        orthogonal. That bounds each coefficient of the nearest image, and so the steps that can lead to it.
        """
        basis = self.reduced()
        straight: list[list[float]] = []
        for v in basis:
            for u in straight:
                v = _less(v, u, _dot(v, u) / _squared(u))
            straight.append(v)
        far = math.sqrt(sum(map(_squared, straight))) / 2
        volume = self.volume()
        turn = _dot(_cross(basis[0], basis[1]), basis[2])
        dual = [[x / turn for x in _cross(basis[(k + 1) % 3], basis[(k + 2) % 3])] for k in range(3)]
        if not math.isclose(abs(turn), volume, rel_tol=1e-6):
            raise ArithmeticError("the cell is too thin for its lattice to be reduced")
        most = [math.floor(far * math.sqrt(_squared(row)) + 0.5 + 1e-9) for row in dual]
        return basis, dual, list(product(*(range(-n, n + 1) for n in most)))

    def nearest(self, d: Vec) -> Vec:
        """The displacement to the nearest image: rounding in an orthogonal cell, else along the reduced basis, and the cells around that."""
        if self.orthogonal:
            return Vec(*(c - F.round(c / F.lit(n)) * n for c, n in zip(d, (self.a, self.b, self.c))))
        basis, dual, steps = self.image_shifts()
        s = [F.round(d.x * row[0] + d.y * row[1] + d.z * row[2]) for row in dual]
        base = Vec(*(c - sum(s[k] * basis[k][m] for k in range(3)) for m, c in enumerate(d)))
        shifts = F.array(*(F.array(*(F.lit(float(sum(t[k] * basis[k][m] for k in range(3)))) for m in range(3))) for t in steps))

        def closest(b: Column) -> Column:
            def image(t: Column) -> Column:
                p = Vec(b["x"] + t[0], b["y"] + t[1], b["z"] + t[2])
                return F.struct(p.norm_squared().alias("d2"), p.x.alias("x"), p.y.alias("y"), p.z.alias("z"))

            return F.array_min(F.transform(shifts, image))

        once = F.array(F.struct(base.x.alias("x"), base.y.alias("y"), base.z.alias("z")))  # a lambda's argument is evaluated once
        best = F.get(F.transform(once, closest), 0)
        return Vec(best["x"], best["y"], best["z"])


def cell_vectors(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> tuple[Vec, Vec, Vec]:
    """Lower triangular lattice vectors of cells that rows hold; zero vectors where lengths or angles leave no volume."""
    right = lambda v, f, at: F.when(v == 90.0, F.lit(at)).otherwise(f(F.radians(v)))
    ca, cb, cg, sg = right(alpha, F.cos, 0.0), right(beta, F.cos, 0.0), right(gamma, F.cos, 0.0), right(gamma, F.sin, 1.0)
    cx, cy = c * cb, c * (ca - cb * cg) / F.nullif(sg, F.lit(0.0))
    depth = c * c - cx * cx - cy * cy
    fine = (a > 0) & (b > 0) & (c > 0) & (alpha > 0) & (beta > 0) & (gamma > 0) & (alpha < 180) & (beta < 180) & (gamma < 180) & (depth > 0)
    kept = lambda v: F.when(F.coalesce(fine, F.lit(False)), v).otherwise(0.0)
    zero = F.lit(0.0)
    return Vec(kept(a), zero, zero), Vec(kept(b * cg), kept(b * sg), zero), Vec(kept(cx), kept(cy), kept(F.sqrt(F.greatest(zero, depth))))


def cell_volume(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """The volume of cells that rows hold; 0 where there is none."""
    u, v, w = cell_vectors(a, b, c, alpha, beta, gamma)
    return u.x * v.y * w.z


def lattice_angles(a: Vec, b: Vec, c: Vec) -> Column:
    """[a, b, c, alpha, beta, gamma] of lattice vectors; all zero if any is (nearly) zero."""
    some = (a.norm() > 2.2e-16) & (b.norm() > 2.2e-16) & (c.norm() > 2.2e-16)
    parts = [a.norm(), b.norm(), c.norm(), F.degrees(angle(b, c)), F.degrees(angle(a, c)), F.degrees(angle(a, b))]
    return F.when(some, F.array(*parts)).otherwise(F.array(*[F.lit(0.0)] * 6))


def rotation(angle_rad: float, axis: tuple[float, float, float]) -> list[list[float]]:
    """Rodrigues' rotation matrix; the identity for a zero axis."""
    n = math.sqrt(sum(c * c for c in axis))
    if not n:
        return [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    x, y, z = (c / n for c in axis)
    c, s = math.cos(angle_rad), math.sin(angle_rad)
    t = 1 - c
    return [[t * x * x + c, t * x * y - s * z, t * x * z + s * y], [t * x * y + s * z, t * y * y + c, t * y * z - s * x], [t * x * z - s * y, t * y * z + s * x, t * z * z + c]]


def transformed(matrix: list[list[float]], r: Vec) -> Vec:
    """Matrix times column vector."""
    return Vec(*(r.x * row[0] + r.y * row[1] + r.z * row[2] for row in matrix))
