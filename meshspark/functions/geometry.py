"""Scalar geometry over columns. Functions of ``Vec`` arguments return expressions; functions that
take a DataFrame add their result in stages, so that no intermediate is written out twice and
whole-stage code generation sees short expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vec import EPS, Vec, choose, clamp

PARALLEL = 1e-9
COPLANAR = 1e-9


def _dropped(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def closest_on_segment(p: Vec, a: Vec, b: Vec) -> Vec:
    ab = b - a
    return a + ab * clamp((p - a).dot(ab) / (ab.norm2() + EPS))


def segment_distance2(p1: Vec, q1: Vec, p2: Vec, q2: Vec) -> Column:
    """Squared distance of two segments: one pass of clamping s, then t, then s again."""
    d1, d2, r = q1 - p1, q2 - p2, p1 - p2
    a, e, f, c, b = d1.norm2(), d2.norm2(), d2.dot(r), d1.dot(r), d1.dot(d2)
    denom = a * e - b * b
    s = F.when(denom > EPS, clamp((b * f - c * e) / (denom + EPS))).otherwise(F.lit(0.0))
    t = clamp((b * s + f) / (e + EPS))
    s = clamp((b * t - c) / (a + EPS))
    return (p1 + d1 * s - (p2 + d2 * t)).norm2()


def with_closest_on_triangle(df: DataFrame, p: Vec, a: Vec, b: Vec, c: Vec, out: str = "cp_", d2: str = "d2") -> DataFrame:
    """Adds the closest point of triangle abc to p and its squared distance.

    The seven Voronoi regions are tried in the order A, B, AB, C, AC, BC and else the face; the
    first that holds decides.
    """
    ab, ac = b - a, c - a
    stage = {"_d1": ab.dot(p - a), "_d2": ac.dot(p - a), "_d3": ab.dot(p - b), "_d4": ac.dot(p - b), "_d5": ab.dot(p - c), "_d6": ac.dot(p - c)}
    df = df.withColumns(stage)
    d = [None, *[F.col(f"_d{i}") for i in range(1, 7)]]
    df = df.withColumns({"_vc": d[1] * d[4] - d[3] * d[2], "_vb": d[5] * d[2] - d[1] * d[6], "_va": d[3] * d[6] - d[5] * d[4]})
    va, vb, vc = F.col("_va"), F.col("_vb"), F.col("_vc")
    total = va + vb + vc + EPS
    on_ab = a + ab * (d[1] / (d[1] - d[3] + EPS))
    on_ac = a + ac * (d[2] / (d[2] - d[6] + EPS))
    on_bc = b + (c - b) * ((d[4] - d[3]) / ((d[4] - d[3]) + (d[5] - d[6]) + EPS))
    at = choose(
        ((d[1] <= 0) & (d[2] <= 0), a), ((d[3] >= 0) & (d[4] <= d[3]), b), ((vc <= 0) & (d[1] >= 0) & (d[3] <= 0), on_ab), ((d[6] >= 0) & (d[5] <= d[6]), c),
        ((vb <= 0) & (d[2] >= 0) & (d[6] <= 0), on_ac), ((va <= 0) & (d[4] - d[3] >= 0) & (d[5] - d[6] >= 0), on_bc), default=a + ab * (vb / total) + ac * (vc / total),
    )
    df = df.withColumns(at.columns(out))
    df = df.withColumn(d2, (p - Vec.of(out)).norm2())
    return _dropped(df, ["_d1", "_d2", "_d3", "_d4", "_d5", "_d6", "_va", "_vb", "_vc"])


def with_triangle_distance2(df: DataFrame, one: list[Vec], two: list[Vec], out: str = "tri_d2") -> DataFrame:
    """Adds the least of 6 point-triangle and 9 edge-edge squared distances."""
    parts = []
    for tag, (tri, points) in {"s": (two, one), "t": (one, two)}.items():
        for i, p in enumerate(points):
            df = with_closest_on_triangle(df, p, *tri, out=f"_{tag}{i}_", d2=f"_{tag}{i}")
            df = df.drop(*[f"_{tag}{i}_{c}" for c in "xyz"])
            parts.append(f"_{tag}{i}")
    for i in range(3):
        df = df.withColumns({f"_e{i}{j}": segment_distance2(one[i], one[(i + 1) % 3], two[j], two[(j + 1) % 3]) for j in range(3)})
        parts += [f"_e{i}{j}" for j in range(3)]
    return df.withColumn(out, F.least(*parts)).drop(*parts)


def with_pierce(df: DataFrame, p: Vec, q: Vec, a: Vec, b: Vec, c: Vec, *, out: str = "hit", t: str | None = None, eps: float = 1e-9, t_lo: float = 0.0, t_hi: float = 1.0) -> DataFrame:
    """Adds whether segment pq pierces triangle abc (inclusive within ``eps``; parallel never), and
    with ``t`` the parameter of the crossing, null where there is none."""
    e1, e2, d = b - a, c - a, q - p
    df = df.withColumns((d.cross(e2)).columns("_h"))
    df = df.withColumn("_det", e1.dot(Vec.of("_h")))
    safe = F.when(F.abs("_det") >= PARALLEL, F.col("_det"))
    s = p - a
    df = df.withColumns({"_f": F.lit(1.0) / safe}).withColumns({"_u": F.col("_f") * s.dot(Vec.of("_h")), **s.cross(e1).columns("_q")})
    df = df.withColumns({"_v": F.col("_f") * d.dot(Vec.of("_q")), "_t": F.col("_f") * e2.dot(Vec.of("_q"))})
    u, v, at = F.col("_u"), F.col("_v"), F.col("_t")
    hit = F.coalesce((u >= -eps) & (v >= -eps) & (u + v <= 1 + eps) & (at >= t_lo - eps) & (at <= t_hi + eps), F.lit(False))
    df = df.withColumn(out, hit)
    if t:
        df = df.withColumn(t, F.when(F.col(out), at))
    return df.drop("_hx", "_hy", "_hz", "_det", "_f", "_u", "_qx", "_qy", "_qz", "_v", "_t")


def with_edge_cross(df: DataFrame, p: Vec, q: Vec, a: Vec, b: Vec, c: Vec, *, out: str = "crosses", eps: float = 0.0) -> DataFrame:
    """Adds whether segment pq strictly crosses the inside of triangle abc between its ends."""
    e1, e2, d, s = b - a, c - a, q - p, p - a
    df = df.withColumns(d.cross(e2).columns("_h")).withColumn("_det", e1.dot(Vec.of("_h")))
    df = df.withColumn("_f", F.lit(1.0) / F.when(F.abs("_det") > EPS, F.col("_det"))).withColumns(s.cross(e1).columns("_q"))
    df = df.withColumns({"_u": F.col("_f") * s.dot(Vec.of("_h")), "_v": F.col("_f") * d.dot(Vec.of("_q")), "_t": F.col("_f") * e2.dot(Vec.of("_q"))})
    u, v, t = F.col("_u"), F.col("_v"), F.col("_t")
    df = df.withColumn(out, F.coalesce((u > eps) & (v > eps) & (u + v < 1 - eps) & (t > eps) & (t < 1 - eps), F.lit(False)))
    return df.drop("_hx", "_hy", "_hz", "_det", "_f", "_qx", "_qy", "_qz", "_u", "_v", "_t")


def with_penetration(df: DataFrame, one: list[Vec], two: list[Vec], out: str = "penetrates", eps: float = 0.0) -> DataFrame:
    """Adds whether an edge of either triangle strictly crosses the other's inside: touching and
    coplanar overlap do not count."""
    names = []
    for tag, (edges, tri) in {"a": (one, two), "b": (two, one)}.items():
        for i in range(3):
            names.append(f"_{tag}{i}")
            df = with_edge_cross(df, edges[i], edges[(i + 1) % 3], *tri, out=names[-1], eps=eps)
    either = F.col(names[0])
    for n in names[1:]:
        either = either | F.col(n)
    return df.withColumn(out, either).drop(*names)


def with_intersection(df: DataFrame, one: list[Vec], two: list[Vec], out: str = "intersects", coplanar: bool = True) -> DataFrame:
    """Adds the interval test of two triangles: strict rejection when one lies on a side of the
    other's plane, else overlap of the crossing intervals on the line of both planes; nearly
    coplanar pairs intersect if their distance is (almost) zero (null without ``coplanar``)."""
    df = df.withColumns({**(one[1] - one[0]).cross(one[2] - one[0]).columns("_n1"), **(two[1] - two[0]).cross(two[2] - two[0]).columns("_n2")})
    n1, n2 = Vec.of("_n1"), Vec.of("_n2")
    df = df.withColumns({**{f"_b{i}": n1.dot(two[i] - one[0]) for i in range(3)}, **{f"_a{i}": n2.dot(one[i] - two[0]) for i in range(3)}, **n1.cross(n2).columns("_l")})
    line = Vec.of("_l")
    temps = [f"_{k}{i}" for k in "ab" for i in range(3)] + [f"_{k}{c}" for k in ("n1", "n2", "l") for c in "xyz"]
    ends = {}
    for tag, tri in (("a", one), ("b", two)):
        along = [line.dot(v) for v in tri]
        lo, hi = [], []
        for i in range(3):
            j = (i + 1) % 3
            di, dj = F.col(f"_{tag}{i}"), F.col(f"_{tag}{j}")
            cut = F.when(di * dj < 0, along[i] + (along[j] - along[i]) * (di / F.when(di != dj, di - dj)))
            on = F.when(F.abs(di) <= EPS, along[i])
            lo += [cut, on]
            hi += [cut, on]
        ends |= {f"_{tag}lo": F.least(*lo), f"_{tag}hi": F.greatest(*hi)}
    df = df.withColumns(ends)
    temps += list(ends)
    df = with_triangle_distance2(df, one, two, "_td2") if coplanar else df.withColumn("_td2", F.lit(None).cast("double"))
    beside = [(F.col(f"_{k}0") > EPS) & (F.col(f"_{k}1") > EPS) & (F.col(f"_{k}2") > EPS) | (F.col(f"_{k}0") < -EPS) & (F.col(f"_{k}1") < -EPS) & (F.col(f"_{k}2") < -EPS) for k in "ab"]
    overlap = F.coalesce(F.greatest(F.col("_alo"), F.col("_blo")) <= F.least(F.col("_ahi"), F.col("_bhi")), F.lit(False)) & F.col("_alo").isNotNull() & F.col("_blo").isNotNull()
    verdict = F.when(line.norm2() < COPLANAR, F.col("_td2") <= COPLANAR).when(beside[0] | beside[1], F.lit(False)).otherwise(overlap)
    return df.withColumn(out, verdict).drop(*temps, "_td2")


def doubled_area(a: Vec, b: Vec, c: Vec) -> Column:
    return (b - a).cross(c - a).norm()


def face_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    return (b - a).cross(c - a).unit()


def centroid(a: Vec, b: Vec, c: Vec) -> Vec:
    return (a + b + c) / 3.0


def bounding_radius(a: Vec, b: Vec, c: Vec) -> Column:
    m = centroid(a, b, c)
    return F.greatest((a - m).norm(), (b - m).norm(), (c - m).norm())


def box(*points: Vec, inflate: float = 0.0) -> tuple[Vec, Vec]:
    first, *rest = points
    by = Vec.lit(inflate, inflate, inflate)
    return first.least(*rest) - by, first.greatest(*rest) + by


def boxes_overlap(lo_a: Vec, hi_a: Vec, lo_b: Vec, hi_b: Vec) -> Column:
    """Inclusive on all axes."""
    out = F.lit(True)
    for c in "xyz":
        out = out & (getattr(lo_a, c) <= getattr(hi_b, c)) & (getattr(lo_b, c) <= getattr(hi_a, c))
    return out


def in_box(p: Vec, lo: tuple, hi: tuple) -> Column:
    """Inside the closed box."""
    return p.x.between(lo[0], hi[0]) & p.y.between(lo[1], hi[1]) & p.z.between(lo[2], hi[2])


def box_of(center: tuple, edge) -> tuple[tuple, tuple]:
    half = [e / 2 for e in (edge if isinstance(edge, (tuple, list)) else (edge,) * 3)]
    return tuple(c - h for c, h in zip(center, half, strict=True)), tuple(c + h for c, h in zip(center, half, strict=True))


def sag(vertex: list[Column], middle: Column) -> Column:
    return F.greatest(middle - (vertex[0] + vertex[1] + vertex[2]) / 3.0, F.lit(0.0))


def sag_ratio(vertex: list[Column], middle: Column, eps: float) -> Column:
    return middle / F.greatest((vertex[0] + vertex[1] + vertex[2]) / 3.0, F.lit(eps))


def pair_key(a: Column, b: Column, faces: int) -> Column:
    return F.least(a, b) * faces + F.greatest(a, b)


def solid_angle(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Signed solid angle of triangle abc seen from p."""
    a, b, c = a - p, b - p, c - p
    la, lb, lc = a.norm(), b.norm(), c.norm()
    return 2.0 * F.atan2(a.dot(b.cross(c)), la * lb * lc + a.dot(b) * lc + b.dot(c) * la + c.dot(a) * lb)


# transforms


def to_frame(p: Vec, center: tuple, scale: float) -> Vec:
    return (p - Vec.lit(*center)) * scale


def from_frame(p: Vec, center: tuple, scale: float) -> Vec:
    return p / scale + Vec.lit(*center)


def clamp_norm(v: Vec, cap) -> Vec:
    return v * F.least((cap if isinstance(cap, Column) else F.lit(float(cap))) / (v.norm() + 1e-20), F.lit(1.0))


def inward_cap(proposed: Vec, ref: Vec, toward: Vec, allowance: Column) -> Vec:
    """Takes back what a move goes along ``toward`` beyond the allowance."""
    return proposed - toward * F.greatest((proposed - ref).dot(toward) - allowance, F.lit(0.0))


def rigid(p: Vec, m: list[list[float]]) -> Vec:
    return Vec(*[p.x * m[i][0] + p.y * m[i][1] + p.z * m[i][2] + m[i][3] for i in range(3)])


def spherical(radius: Column, phi: Column, theta: Column) -> Vec:
    """Degrees; ``theta`` from the z axis."""
    ph, th = F.radians(phi), F.radians(theta)
    return Vec(radius * F.sin(th) * F.cos(ph), radius * F.sin(th) * F.sin(ph), radius * F.cos(th))
