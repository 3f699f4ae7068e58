"""Three-component vectors as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F
from pyspark.sql.window import WindowSpec


def _each(other):
    return (other.x, other.y, other.z) if isinstance(other, Vec3) else (other, other, other)


def _column(part: Column | str) -> Column:
    return F.col(part) if isinstance(part, str) else part


@dataclass(frozen=True, eq=False)
class Vec3:
    """A triple of columns or column names; arithmetic is component-wise, also with scalars.

    Names turn into columns on use, so a vector may be declared before a session exists.
    """

    first: Column | str
    second: Column | str
    third: Column | str

    @staticmethod
    def of(x: str = "x", y: str = "y", z: str = "z") -> "Vec3":
        return Vec3(x, y, z)

    @property
    def x(self) -> Column:
        return _column(self.first)

    @property
    def y(self) -> Column:
        return _column(self.second)

    @property
    def z(self) -> Column:
        return _column(self.third)

    @staticmethod
    def field(struct: Column) -> "Vec3":
        return Vec3(struct["x"], struct["y"], struct["z"])

    @staticmethod
    def lit(x: float, y: float, z: float) -> "Vec3":
        return Vec3(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))

    @property
    def parts(self) -> tuple[Column, Column, Column]:
        return self.x, self.y, self.z

    def map(self, fn) -> "Vec3":
        return Vec3(*(fn(c) for c in self.parts))

    def _zip(self, other, fn) -> "Vec3":
        return Vec3(*(fn(a, b) for a, b in zip(self.parts, _each(other))))

    def __add__(self, other):
        return self._zip(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._zip(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._zip(other, lambda a, b: a * b)

    def __truediv__(self, other):
        """Component-wise quotient; NULL where the divisor is zero."""
        return self._zip(other, lambda a, b: F.try_divide(a, F.lit(b)))

    def __neg__(self):
        return self.map(lambda a: -a)

    def dot(self, other) -> Column:
        a, b = self.parts, other.parts
        return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]

    def cross(self, other) -> "Vec3":
        return Vec3(
            self.y * other.z - self.z * other.y,
            self.z * other.x - self.x * other.z,
            self.x * other.y - self.y * other.x,
        )

    def sq(self) -> Column:
        return self.dot(self)

    def length(self) -> Column:
        return F.sqrt(self.sq())

    def l1(self) -> Column:
        return F.abs(self.x) + F.abs(self.y) + F.abs(self.z)

    def sq_dist(self, other) -> Column:
        return (self - other).sq()

    def dist(self, other) -> Column:
        return F.sqrt(self.sq_dist(other))

    def project(self, target) -> Column:
        """Signed length of this vector along ``target``; NULL on a zero target."""
        return self.dot(target) / F.nullif(target.length(), F.lit(0.0))

    def unit(self) -> "Vec3":
        """Normalised copy; NULL components on a zero vector."""
        return self / F.nullif(self.length(), F.lit(0.0))

    def unit0(self) -> "Vec3":
        """Normalised copy that leaves the zero vector at zero."""
        n = self.length()
        return self.map(lambda a: F.when(n > 0, a / n).otherwise(F.lit(0.0)))

    def cosine(self, other) -> Column:
        return self.dot(other) / F.nullif(self.length() * other.length(), F.lit(0.0))

    def angle(self, other) -> Column:
        return F.acos(clamp(self.cosine(other), -1.0, 1.0))

    def abs(self) -> "Vec3":
        return self.map(F.abs)

    def min(self, other) -> "Vec3":
        return self._zip(other, F.least)

    def max(self, other) -> "Vec3":
        return self._zip(other, F.greatest)

    def nearly_null(self, eps: float = 1e-6) -> Column:
        a = self.abs()
        return (a.x < eps) & (a.y < eps) & (a.z < eps)

    def all_less(self, other) -> Column:
        a, b = self.parts, _each(other)
        return (a[0] < b[0]) & (a[1] < b[1]) & (a[2] < b[2])

    def equals(self, other) -> Column:
        a, b = self.parts, _each(other)
        return (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2])

    def transform(self, matrix) -> tuple["Vec3", Column]:
        """Row-major 4x4 matrix times (x, y, z, 1): the vector part and the fourth component."""
        rows = [
            F.lit(float(r[0])) * self.x + F.lit(float(r[1])) * self.y
            + F.lit(float(r[2])) * self.z + F.lit(float(r[3]))
            for r in matrix
        ]
        return Vec3(*rows[:3]), rows[3]

    def lag(self, w: WindowSpec, n: int = 1) -> "Vec3":
        return self.map(lambda a: F.lag(a, n).over(w))

    def lead(self, w: WindowSpec, n: int = 1) -> "Vec3":
        return self.map(lambda a: F.lead(a, n).over(w))

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def named(self, x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
        return [self.x.alias(x), self.y.alias(y), self.z.alias(z)]

    def columns(self, x: str = "x", y: str = "y", z: str = "z") -> dict[str, Column]:
        return {x: self.x, y: self.y, z: self.z}


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def trunc_int(c: Column) -> Column:
    return c.cast("int")
