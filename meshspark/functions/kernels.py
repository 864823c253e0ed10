"""Tests of many rows at once with numpy, for ``mapInArrow`` and ``applyInArrow``: the same arithmetic in the same order as the
expressions of :mod:`geometry`, where those are too long for compiled code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .geometry import COPLANAR
from .vec import EPS


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _minus(a, b):
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def edge_crosses(p, q, a, b, c, eps: float = 0.0) -> np.ndarray:
    """As :func:`geometry.with_edge_cross`."""
    e1, e2, d, s = _minus(b, a), _minus(c, a), _minus(q, p), _minus(p, a)
    h = _cross(d, e2)
    det = _dot(e1, h)
    f = 1.0 / np.where(np.abs(det) > EPS, det, np.nan)
    k = _cross(s, e1)
    u, v, t = f * _dot(s, h), f * _dot(d, k), f * _dot(e2, k)
    return (u > eps) & (v > eps) & (u + v < 1 - eps) & (t > eps) & (t < 1 - eps)


def penetrates(one, two, eps: float = 0.0) -> np.ndarray:
    """Whether an edge of either triangle crosses the other's inside."""
    hit = np.zeros(len(one[0][0]), bool)
    for edge, tri in ((one, two), (two, one)):
        for i in range(3):
            hit |= edge_crosses(edge[i], edge[(i + 1) % 3], *tri, eps)
    return hit


def _span(di, line, tri):
    """The ends of a triangle's part on the line of two planes, where ``di`` are its corners' distances to the other's plane; NaN for none."""
    along = [_dot(line, v) for v in tri]
    lo = hi = np.full(len(along[0]), np.nan)
    for i in range(3):
        j = (i + 1) % 3
        cut = np.where(di[i] * di[j] < 0, along[i] + (along[j] - along[i]) * (di[i] / (di[i] - di[j])), np.nan)
        on = np.where(np.abs(di[i]) <= EPS, along[i], np.nan)
        lo, hi = np.fmin(np.fmin(lo, cut), on), np.fmax(np.fmax(hi, cut), on)
    return lo, hi


def meets(one, two, eps: float = 0.0) -> np.ndarray:
    """As :func:`geometry.with_intersection`: nearly coplanar pairs meet if their distance is (almost) zero."""
    n1, n2 = _cross(_minus(one[1], one[0]), _minus(one[2], one[0])), _cross(_minus(two[1], two[0]), _minus(two[2], two[0]))
    b, a = [_dot(n1, _minus(v, one[0])) for v in two], [_dot(n2, _minus(v, two[0])) for v in one]
    line = _cross(n1, n2)
    (alo, ahi), (blo, bhi) = _span(a, line, one), _span(b, line, two)
    hit = np.maximum(alo, blo) <= np.minimum(ahi, bhi)  # a NaN is no overlap
    for d in (a, b):
        hit &= ~((d[0] > EPS) & (d[1] > EPS) & (d[2] > EPS) | (d[0] < -EPS) & (d[1] < -EPS) & (d[2] < -EPS))
    flat = np.flatnonzero(_dot(line, line) < COPLANAR)
    if len(flat):
        at = lambda tri: [tuple(x[flat] for x in v) for v in tri]
        hit[flat] = triangle_distance2(at(one), at(two)) <= COPLANAR
    return hit


TESTS = {"penetrate": penetrates, "moller": meets}


def _verdicts(rows, kinds, eps: float = 0.0) -> list[np.ndarray]:
    one, two = ([tuple(rows.column(f"{s}{k}{c}").to_numpy(zero_copy_only=False) for c in "xyz") for k in "abc"] for s in ("a_", "b_"))
    with np.errstate(all="ignore"):
        return [TESTS[k](one, two, eps) for k in kinds]


def passing(kind: str, eps: float = 0.0):
    """Of pairs with corners ``a_ax..b_cz``, ``fa, fb`` of those that pass a test."""

    def run(batches):
        for rows in batches:
            keep = pa.array(_verdicts(rows, [kind], eps)[0])
            yield pa.RecordBatch.from_arrays([rows.column("a_fid").filter(keep), rows.column("b_fid").filter(keep)], ["fa", "fb"])

    return run


def passed(kinds: tuple[str, ...]):
    """The numbers of pairs that pass each test, a row a batch."""

    def run(batches):
        for rows in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(v.sum())], pa.int64()) for v in _verdicts(rows, kinds)], list(kinds))

    return run


def _plus(a, b):
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def _times(a, k):
    return a[0] * k, a[1] * k, a[2] * k


def closest_on_triangle(p, a, b, c):
    """As :func:`geometry.with_closest_on_triangle`: the point and its squared distance."""
    ab, ac = _minus(b, a), _minus(c, a)
    pa_, pb, pc = _minus(p, a), _minus(p, b), _minus(p, c)
    d1, d2, d3, d4, d5, d6 = _dot(ab, pa_), _dot(ac, pa_), _dot(ab, pb), _dot(ac, pb), _dot(ab, pc), _dot(ac, pc)
    vc, vb, va = d1 * d4 - d3 * d2, d5 * d2 - d1 * d6, d3 * d6 - d5 * d4
    total = va + vb + vc + EPS
    on_ab = _plus(a, _times(ab, d1 / (d1 - d3 + EPS)))
    on_ac = _plus(a, _times(ac, d2 / (d2 - d6 + EPS)))
    on_bc = _plus(b, _times(_minus(c, b), (d4 - d3) / ((d4 - d3) + (d5 - d6) + EPS)))
    face = _plus(_plus(a, _times(ab, vb / total)), _times(ac, vc / total))
    where = [(d1 <= 0) & (d2 <= 0), (d3 >= 0) & (d4 <= d3), (vc <= 0) & (d1 >= 0) & (d3 <= 0), (d6 >= 0) & (d5 <= d6), (vb <= 0) & (d2 >= 0) & (d6 <= 0), (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0)]
    at = tuple(np.select(where, [a[i], b[i], on_ab[i], c[i], on_ac[i], on_bc[i]], face[i]) for i in range(3))
    gap = _minus(p, at)
    return at, _dot(gap, gap)


def segment_distance2(p1, q1, p2, q2) -> np.ndarray:
    """As :func:`geometry.segment_distance2`."""
    clamp = lambda x: np.minimum(np.maximum(x, 0.0), 1.0)
    d1, d2, r = _minus(q1, p1), _minus(q2, p2), _minus(p1, p2)
    a, e, f, c, b = _dot(d1, d1), _dot(d2, d2), _dot(d2, r), _dot(d1, r), _dot(d1, d2)
    denom = a * e - b * b
    s = np.where(denom > EPS, clamp((b * f - c * e) / (denom + EPS)), 0.0)
    t = clamp((b * s + f) / (e + EPS))
    s = clamp((b * t - c) / (a + EPS))
    gap = _minus(_plus(p1, _times(d1, s)), _plus(p2, _times(d2, t)))
    return _dot(gap, gap)


def triangle_distance2(one, two) -> np.ndarray:
    """As :func:`geometry.with_triangle_distance2`."""
    near = np.full(len(one[0][0]), np.nan)
    for tri, points in ((two, one), (one, two)):
        for p in points:
            near = np.fmin(near, closest_on_triangle(p, *tri)[1])
    for i in range(3):
        for j in range(3):
            near = np.fmin(near, segment_distance2(one[i], one[(i + 1) % 3], two[j], two[(j + 1) % 3]))
    return near


def closest():
    """Of queries ``qid, p`` beside triangles ``fid, a, b, c``: ``qid, fid, d2``, the closest point and the triangle's normal."""

    def run(batches):
        for rows in batches:
            p, a, b, c = (tuple(rows.column(f"{k}{x}").to_numpy(zero_copy_only=False) for x in "xyz") for k in "pabc")
            with np.errstate(all="ignore"):
                at, d2 = closest_on_triangle(p, a, b, c)
                n = _cross(_minus(b, a), _minus(c, a))
                length = np.sqrt(_dot(n, n)) + 1e-20
            found = [d2, *at, *[k / length for k in n]]
            names = ["qid", "fid", "d2", *[f"{k}_{x}" for k in ("cp", "n") for x in "xyz"]]
            yield pa.RecordBatch.from_arrays([rows.column("qid"), rows.column("fid"), *[pa.array(k) for k in found]], names)

    return run


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    whole = vectors.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1)


def nearest_of_block(queries: pa.Table, refs: pa.Table, cells: int = 1 << 22) -> pa.Table:
    """``qid, rid, d2``: the nearest of ``refs`` (rid, rv) of each of ``queries`` (qid, qv), ties to the smaller id. Products of
    matrices leave those that rounding can't tell apart from the nearest; they are compared by direct differences."""
    qid, rid = queries["qid"].to_numpy(), refs["rid"].to_numpy()
    names = ["qid", "rid", "d2"]
    if not len(qid) or not len(rid):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
    q, r = _matrix(queries["qv"]), _matrix(refs["rv"])
    order = np.argsort(rid, kind="stable")
    rid, r = rid[order], r[order]
    qn, rn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", r, r)
    best, least = np.empty(len(q), np.int64), np.empty(len(q))
    step = max(1, cells // len(r))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        d = part @ (-2.0 * r.T)
        d += rn
        slack = (qn[at : at + step] + rn.max()) * (q.shape[1] + 8) * 1e-15
        i, j = np.nonzero(d <= (d.min(axis=1) + slack)[:, None])
        exact = np.zeros(len(i))
        for k in range(q.shape[1]):
            gap = part[i, k] - r[j, k]
            exact += gap * gap
        first = np.lexsort((j, exact, i))
        rows, where = np.unique(i[first], return_index=True)
        best[at + rows], least[at + rows] = j[first][where], exact[first][where]
    return pa.table([pa.array(qid), pa.array(rid[best]), pa.array(least)], names)
