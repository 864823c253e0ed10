"""Gradients of the loss terms of :mod:`objective` by vertex position, as ``vid, gx, gy, gz``.

Each is a sum of what pairs, faces or matches give their vertices. :func:`total` adds several in one shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import tiles
from ..functions.vec import Vec
from ..session import ship
from . import spatial
from .topology import CORNERS, corners, saved, triangles


def total(*parts: DataFrame) -> DataFrame:
    """The sum by vertex of several tables of parts."""
    rows = parts[0].select("vid", "gx", "gy", "gz")
    for more in parts[1:]:
        rows = rows.unionByName(more.select("vid", "gx", "gy", "gz"))
    return rows.groupBy("vid").agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in "xyz"])


def _given(rows: DataFrame, *parts: tuple[str, Vec]) -> DataFrame:
    """A row for each vertex column and its vector."""
    each = F.array(*[F.struct(F.col(v).alias("vid"), *g.named("g")) for v, g in parts])
    return rows.select(F.explode(each).alias("e")).select("e.*")


def data(vertices: DataFrame, matches: DataFrame, n: int, *, fit: float = 1.0, plane: float = 0.0) -> DataFrame:
    """Of ``fit * mean w |p - q|^2 + plane * mean w ((p - q) n)^2`` over ``n`` vertices; matches are ``vid, weight, qx.., nx..``."""
    both = vertices.select("vid", *Vec.of().named("p")).join(matches, "vid").where("weight > 0")
    off = Vec.of("p") - Vec.of("q")
    g = off * (2.0 * fit / max(n, 1))
    if plane:
        normal = Vec.of("n")
        g = g + normal * (off.dot(normal) * (2.0 * plane / max(n, 1)))
    return both.select("vid", *(g * F.col("weight")).named("g"))


def edge_laplacian(displacement: DataFrame, edges: DataFrame, n_edges: int, weight: float = 1.0) -> DataFrame:
    """Of ``weight`` times the mean over edges of the squared difference of displacements (x, y, z)."""
    side = lambda e, p: displacement.select(F.col("vid").alias(e), *Vec.of().named(p))
    d = (Vec.of("p") - Vec.of("q")) * (2.0 * weight / max(n_edges, 1))
    return _given(edges.join(side("e0", "p"), "e0").join(side("e1", "q"), "e1"), ("e0", d), ("e1", d * -1.0))


def sheet(pairs: DataFrame, vertices: DataFrame, faces: DataFrame, weight: float = 1.0) -> DataFrame:
    """Of ``weight`` times the sheet barrier; pairs are ``fa, fb, ux, uy, uz, margin``."""
    extra = pairs.select(F.col("fa").alias("a_fid"), F.col("fb").alias("b_fid"), "ux", "uy", "uz", "margin")
    both = spatial.gathered(pairs.select("fa", "fb"), vertices, faces).join(extra, ["a_fid", "b_fid"])
    gap = (G.centroid(*corners("b_")) - G.centroid(*corners("a_"))).dot(Vec.of("u"))
    both = saved(both.withColumn("short", F.col("margin") - gap).where("short > 0").select("short", *[f"{s}_{c}" for s in "ab" for c in CORNERS], "ux", "uy", "uz"))
    push = Vec.of("u") * (F.col("short") * (2.0 * weight / 3.0 / max(both.count(), 1)))
    return _given(both, *[(f"a_{c}", push) for c in CORNERS], *[(f"b_{c}", push * -1.0) for c in CORNERS])


class _SheetSums(tiles.Visit):
    """By face, what its pairs fall short of ``margin`` along ``axis``: added as the first of a pair, taken off as the second; ``pairs`` short as the first."""

    columns = ("mx", "my", "mz")
    schema = "i0 long, i1 long, i2 long, short double, pairs long"

    def __init__(self, axis: tuple[float, float, float], margin: float):
        self.axis, self.margin = axis, margin

    def begin(self, rows):
        self.rows, self.short = rows, np.zeros(rows.n)
        self.first, self.second = np.zeros(rows.n, np.int64), np.zeros(rows.n, np.int64)

    def take(self, i, j):
        at = self.rows.extra
        short = self.margin - sum((at[k][j] - at[k][i]) * u for k, u in enumerate(self.axis))
        keep = ~((short <= 0) | self.rows.null[i] | self.rows.null[j])  # as in columns, NaN is more than 0 and null is not
        i, j, short = i[keep], j[keep], short[keep]
        self.short += np.bincount(i, short, self.rows.n) - np.bincount(j, short, self.rows.n)
        self.first += np.bincount(i, minlength=self.rows.n)
        self.second += np.bincount(j, minlength=self.rows.n)

    def end(self):
        some = np.flatnonzero(self.first + self.second)
        return self.batch([*[c[some] for c in self.rows.corners], self.short[some], self.first[some]])


def sheet_between(vertices: DataFrame, faces: DataFrame, gap: float, axis: tuple[float, float, float], margin: float, weight: float = 1.0) -> DataFrame:
    """:func:`sheet` of all faces within ``gap``, with one axis and margin: sums by face are made where pairs are found, so what
    is written and shuffled grows with the faces."""
    sums = saved(spatial.visited(spatial.face_boxes(vertices, faces, gap), _SheetSums(axis, margin)))
    n = sums.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]  # pairs that are too near
    push = Vec.lit(*axis) * (F.col("short") * (2.0 * weight / 3.0 / max(n, 1)))
    return _given(sums, *[(c, push) for c in CORNERS])


def inversion(vertices: DataFrame, faces: DataFrame, reference: DataFrame, n_faces: int, *, flip: float = 0.0, part: float = 0.1, weight: float = 1.0) -> DataFrame:
    """Of ``weight`` times both inversion barriers; the reference is ``fid, nx, ny, nz, area2``."""
    a, b, c = corners()
    both = triangles(vertices, faces).join(reference, "fid").withColumns((b - a).cross(c - a).columns("k"))
    cross, n, known = Vec.of("k"), Vec.of("m"), Vec.of("n")
    both = both.withColumn("now2", cross.norm()).where("now2 > 0").withColumns((cross / F.col("now2")).columns("m"))
    turn = F.greatest(flip - n.dot(known), F.lit(0.0))
    small = F.greatest(part * F.col("area2") - F.col("now2"), F.lit(0.0)) / ((F.col("area2") + 1e-20) * (F.col("area2") + 1e-20))
    both = both.withColumns({"turn": turn, "small": small}).where("turn > 0 OR small > 0")
    # by the faces' doubled normals, then by their corners
    g = ((known - n * n.dot(known)) * (F.col("turn") / F.col("now2")) + n * F.col("small")) * (-2.0 * weight / max(n_faces, 1))
    both = both.withColumns(g.columns("h"))
    at_b, at_c = (c - a).cross(Vec.of("h")), Vec.of("h").cross(b - a)
    return _given(both, ("i0", (at_b + at_c) * -1.0), ("i1", at_b), ("i2", at_c))


def _corner_weights(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Barycentric weights of the points of triangles closest to ``p``."""
    dot = lambda u, v: np.einsum("ni,ni->n", u, v)
    over = lambda x, y: x / np.where(np.abs(y) > eps * eps, y, 1.0)
    ab, ac = b - a, c - a
    d1, d2, d3, d4, d5, d6 = (dot(e, p - x) for x in (a, b, c) for e in (ab, ac))
    vc, vb, va = d1 * d4 - d3 * d2, d5 * d2 - d1 * d6, d3 * d6 - d5 * d4
    zero, one = np.zeros(len(p)), np.ones(len(p))
    ab_, ac_, bc_ = over(d1, d1 - d3), over(d2, d2 - d6), over(d4 - d3, (d4 - d3) + (d5 - d6))
    v, w = over(vb, va + vb + vc), over(vc, va + vb + vc)
    cases = [
        ((d1 <= 0) & (d2 <= 0), (one, zero, zero)), ((d3 >= 0) & (d4 <= d3), (zero, one, zero)), ((vc <= 0) & (d1 >= 0) & (d3 <= 0), (1 - ab_, ab_, zero)),
        ((d6 >= 0) & (d5 <= d6), (zero, zero, one)), ((vb <= 0) & (d2 >= 0) & (d6 <= 0), (1 - ac_, zero, ac_)), ((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), (zero, 1 - bc_, bc_)),
    ]
    return np.stack([np.select([k for k, _ in cases], [x[i] for _, x in cases], other) for i, other in enumerate((1 - v - w, v, w))], axis=1)


def _along_segments(p1: np.ndarray, q1: np.ndarray, p2: np.ndarray, q2: np.ndarray, eps: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Places of the closest points of two segments."""
    dot = lambda u, v: np.einsum("ni,ni->n", u, v)
    d1, d2, r = q1 - p1, q2 - p2, p1 - p2
    a, e, f, c, b = dot(d1, d1), dot(d2, d2), dot(d2, r), dot(d1, r), dot(d1, d2)
    den = a * e - b * b
    s = np.where(den > eps, np.clip((b * f - c * e) / (den + eps), 0, 1), 0.0)
    t = np.clip((b * s + f) / (e + eps), 0, 1)
    return np.clip((b * t - c) / (a + eps), 0, 1), t


def closest_features(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of triangles (n, 6, 3): the squared distance, and weights (n, 6) of the corners whose sum is the vector
    between the closest points, from the second triangle to the first."""
    n = len(x)
    best, weights = np.full(n, np.inf), np.zeros((n, 6))
    found = []
    for i in range(3):
        w = np.zeros((n, 6))
        w[:, i], w[:, 3:] = 1, -_corner_weights(x[:, i], *(x[:, 3 + k] for k in range(3)))
        found.append(w)
        w = np.zeros((n, 6))
        w[:, 3 + i], w[:, :3] = -1, _corner_weights(x[:, 3 + i], *(x[:, k] for k in range(3)))
        found.append(w)
        for j in range(3):
            i1, j0, j1 = (i + 1) % 3, 3 + j, 3 + (j + 1) % 3
            s, t = _along_segments(x[:, i], x[:, i1], x[:, j0], x[:, j1])
            w = np.zeros((n, 6))
            w[:, i], w[:, i1], w[:, j0], w[:, j1] = 1 - s, s, t - 1, -t
            found.append(w)
    for w in found:
        d2 = (np.einsum("nk,nki->ni", w, x) ** 2).sum(axis=1)
        less = d2 < best
        best[less], weights[less] = d2[less], w[less]
    return best, weights


def _barrier(x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of triangles (n, 6, 3): which are nearer than ``margin``, and the gradients (6, 3) of the squared shortfall of those."""
    d2, w = closest_features(x)
    far = np.sqrt(d2 + 1e-18)
    at = np.flatnonzero(far < margin)
    return at, -2.0 * (margin - far[at])[:, None, None] * w[at][:, :, None] * (np.einsum("nk,nki->ni", w[at], x[at]) / far[at][:, None])[:, None, :]


class _BarrierSums(tiles.Visit):
    """By corner of a face, the gradients of its pairs nearer than ``margin``; ``pairs`` of which it is the first, at one corner."""

    columns = tuple(f"{k}{c}" for k in "abc" for c in "xyz")
    schema = "pairs long, vid long, gx double, gy double, gz double"

    def __init__(self, margin: float):
        self.margin = margin

    def begin(self, rows):
        self.rows, self.tri = rows, np.ascontiguousarray(rows.extra.T).reshape(rows.n, 3, 3)
        self.low, self.high = self.tri.min(axis=1), self.tri.max(axis=1)
        self.sums, self.first, self.met = np.zeros((3, 3 * rows.n)), np.zeros(rows.n, np.int64), np.zeros(rows.n, bool)

    def take(self, i, j):
        off = np.maximum(np.maximum(self.low[j] - self.high[i], self.low[i] - self.high[j]), 0.0)
        near = np.einsum("nk,nk->n", off, off) <= self.margin**2 * (1 + 1e-9)  # boxes farther apart hold nothing nearer
        i, j = i[near], j[near]
        at, g = _barrier(np.concatenate([self.tri[i], self.tri[j]], axis=1), self.margin)
        i, j = i[at], j[at]
        corner = np.concatenate([3 * i[:, None] + np.arange(3), 3 * j[:, None] + np.arange(3)], axis=1).reshape(-1)
        for k in range(3):
            self.sums[k] += np.bincount(corner, g[:, :, k].reshape(-1), 3 * self.rows.n)
        self.first += np.bincount(i, minlength=self.rows.n)
        self.met[i] = self.met[j] = True

    def end(self):
        some = np.flatnonzero(self.met)
        pairs = np.zeros((len(some), 3), np.int64)
        pairs[:, 0] = self.first[some]
        return self.batch([pairs.reshape(-1), self.rows.corners.T[some].reshape(-1), *[s.reshape(-1, 3)[some].reshape(-1) for s in self.sums]])


def _shared_out(sums: DataFrame, weight: float) -> DataFrame:
    """Sums ``vid, gx, gy, gz`` over the number of their ``pairs``."""
    sums = saved(sums)
    n = sums.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    return sums.select("vid", *[(F.col(f"g{c}") * (weight / max(n, 1))).alias(f"g{c}") for c in "xyz"])


def collision(pairs: DataFrame, vertices: DataFrame, faces: DataFrame, margin: float, weight: float = 1.0) -> DataFrame:
    """Of ``weight`` times the collision barrier of ``pairs`` (fa, fb): the closest points of two faces nearer than
    ``margin`` push the corners that they lie between. Distances are found on Arrow batches."""
    ship(vertices.sparkSession)
    both = spatial.gathered(pairs.select("fa", "fb"), vertices, faces)
    ids = [f"{s}_{c}" for s in "ab" for c in CORNERS]
    places = [f"{s}_{k}{c}" for s in "ab" for k in "abc" for c in "xyz"]

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in places], axis=1).reshape(-1, 6, 3)
            at, g = _barrier(x, margin)
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ids], axis=1) if len(at) else np.zeros((0, 6), np.int64)
            first = (np.arange(6 * len(at)) % 6 == 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(own.reshape(-1).astype(np.int64)), *[pa.array(g[:, :, k].reshape(-1)) for k in range(3)]], ["pairs", "vid", "gx", "gy", "gz"])

    return _shared_out(both.select(*ids, *places).mapInArrow(run, _BarrierSums.schema), weight)


def collision_within(vertices: DataFrame, faces: DataFrame, margin: float, weight: float = 1.0) -> DataFrame:
    """:func:`collision` of all faces whose boxes, inflated by ``margin``, overlap: sums by corner are made where pairs are found, so
    what is written and shuffled grows with the faces."""
    return _shared_out(spatial.visited(spatial.face_boxes(vertices, faces, margin), _BarrierSums(margin)), weight)


def _zeroed(value: str) -> Column:
    return F.coalesce(value, F.lit(0.0))


def moments(vertices: DataFrame) -> DataFrame:
    """The state of an optimizer: displacement ``d*`` and moments ``m*, v*, w*`` (of which ``w`` is the largest ``v``), all zero,
    and the decayed powers ``b1, b2`` of steps made."""
    return vertices.select("vid", *[F.lit(0.0).alias(f"{k}{c}") for k in "dmvw" for c in "xyz"], F.lit(1.0).alias("b1"), F.lit(1.0).alias("b2"))


def reset(state: DataFrame, vids: DataFrame, back: DataFrame | None = None) -> DataFrame:
    """The state with the moments of ``vids`` zero, and their displacements those of ``back`` if given."""
    out = state.join(vids.select("vid").distinct().withColumn("_r", F.lit(True)), "vid", "left")
    if back is not None:
        out = out.join(back.select("vid", *[F.col(f"d{c}").alias(f"_d{c}") for c in "xyz"]), "vid", "left")
    place = {f"d{c}": F.when(F.col("_r"), F.col(f"_d{c}")).otherwise(F.col(f"d{c}")) for c in "xyz"} if back is not None else {}
    zero = {f"{k}{c}": F.when(F.col("_r"), F.lit(0.0)).otherwise(F.col(f"{k}{c}")) for k in "mvw" for c in "xyz"}
    power = {b: F.when(F.col("_r"), F.lit(1.0)).otherwise(F.col(b)) for b in ("b1", "b2")}
    return out.withColumns(place | zero | power).select(*state.columns)


def adam_step(state: DataFrame, gradient: DataFrame, lr: float, *, decay: float = 0.0, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> DataFrame:
    """One step of AdamW with the largest second moment; vertices without gradient have zero. Steps are counted by vertex, so
    moments that were reset begin anew, and every step is the same generated code."""
    b1, b2 = betas
    rows = state.join(gradient, "vid", "left").withColumns({f"g{c}": _zeroed(f"g{c}") for c in "xyz"} | {"b1": F.col("b1") * b1, "b2": F.col("b2") * b2})
    rows = rows.withColumns({f"m{c}": b1 * F.col(f"m{c}") + (1 - b1) * F.col(f"g{c}") for c in "xyz"} | {f"v{c}": b2 * F.col(f"v{c}") + (1 - b2) * F.col(f"g{c}") * F.col(f"g{c}") for c in "xyz"})
    rows = rows.withColumns({f"w{c}": F.greatest(f"w{c}", f"v{c}") for c in "xyz"})
    rows = rows.withColumns({f"d{c}": F.col(f"d{c}") * (1 - lr * decay) - lr * (F.col(f"m{c}") / (1 - F.col("b1"))) / (F.sqrt(F.col(f"w{c}") / (1 - F.col("b2"))) + eps) for c in "xyz"})
    return rows.select(*state.columns)
