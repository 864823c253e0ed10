"""Three columns as a vector; every operation stays a native column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


@dataclass(frozen=True)
class Vec:
    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(prefix: str = "", names: str = "xyz") -> Vec:
        """The columns ``<prefix>x, <prefix>y, <prefix>z``; a dotted prefix reaches into structs."""
        return Vec(*[F.col(f"{prefix}{n}") for n in names])

    @staticmethod
    def lit(x: float, y: float, z: float) -> Vec:
        return Vec(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))

    def __add__(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def __mul__(self, s) -> Vec:
        return Vec(self.x * s, self.y * s, self.z * s)

    def __truediv__(self, s) -> Vec:
        return Vec(self.x / s, self.y / s, self.z / s)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm2(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm2())

    def unit(self, eps: float = 1e-20) -> Vec:
        return self / (self.norm() + eps)

    def least(self, *o: Vec) -> Vec:
        return Vec(*[F.least(getattr(self, c), *[getattr(v, c) for v in o]) for c in "xyz"])

    def greatest(self, *o: Vec) -> Vec:
        return Vec(*[F.greatest(getattr(self, c), *[getattr(v, c) for v in o]) for c in "xyz"])

    def columns(self, prefix: str) -> dict[str, Column]:
        return {f"{prefix}{c}": getattr(self, c) for c in "xyz"}

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(n) for n, c in self.columns(prefix).items()]


def choose(*cases: tuple[Column, Vec], default: Vec) -> Vec:
    """The vector of the first case that holds."""
    out = []
    for c in "xyz":
        e = None
        for cond, v in cases:
            e = F.when(cond, getattr(v, c)) if e is None else e.when(cond, getattr(v, c))
        out.append(e.otherwise(getattr(default, c)))
    return Vec(*out)


def clamp(value: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))
