"""Winding numbers against sums over all faces."""

import numpy as np
import pytest

from meshspark.operators import spatial, winding
from test_nonrigid import grid, tables


def solid(q, p, f):
    a, b, c = (p[[t[k] for t in f]][None] - q[:, None] for k in range(3))
    la, lb, lc = (np.linalg.norm(x, axis=2) for x in (a, b, c))
    det = np.einsum("qfi,qfi->qf", a, np.cross(b, c))
    den = la * lb * lc + (a * b).sum(2) * lc + (b * c).sum(2) * la + (c * a).sum(2) * lb
    return (2 * np.arctan2(det, den)).sum(axis=1) / (4 * np.pi)


def torus(n, m):
    p = np.array([[(2 + np.cos(2 * np.pi * j / m)) * np.cos(2 * np.pi * i / n), (2 + np.cos(2 * np.pi * j / m)) * np.sin(2 * np.pi * i / n), np.sin(2 * np.pi * j / m)] for i in range(n) for j in range(m)])
    at = lambda i, j: i % n * m + j % m
    return p, [t for i in range(n) for j in range(m) for t in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1)))]


def queries(spark, q):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], "vid long, x double, y double, z double")


@pytest.mark.parametrize("shape", ["torus", "open", "soup"])
def test_winding_is_the_sum_over_all_faces(spark, shape):
    rng = np.random.default_rng(4)
    p, f = torus(24, 12) if shape == "torus" else grid(14)
    if shape == "soup":  # faces that share few edges, some turned over, one twice
        f = [t if rng.random() < 0.7 else t[::-1] for t in f if rng.random() < 0.6]
        f.append(f[0])
    q = np.r_[rng.normal(size=(60, 3)) * 1.5, p[::9] + 0.01 * rng.normal(size=p[::9].shape), [[100.0, 0, 0], [2.0, 0, 0]]]
    got = np.array([r.winding for r in sorted(winding.winding_numbers(queries(spark, q), *tables(spark, p, f), leaf=8).collect())])
    assert np.abs(got - solid(q, p, f)).max() < 1e-9
    if shape == "torus":
        assert got[-1] == pytest.approx(1.0) and got[-2] == pytest.approx(0.0)


def test_large_levels_are_joined_without_broadcast(spark, monkeypatch):
    p, f = grid(8)
    q = queries(spark, np.random.default_rng(1).random((30, 3)))
    v, faces = tables(spark, p, f)
    one = sorted(winding.winding_numbers(q, v, faces, leaf=4).collect())
    monkeypatch.setattr(winding, "SMALL", 0)
    two = sorted(winding.winding_numbers(q, v, faces, leaf=4).collect())
    assert [a.qid for a in one] == [b.qid for b in two] and np.allclose([a.winding for a in one], [b.winding for b in two])


def test_no_faces_and_stacked_faces(spark):
    p, f = grid(3)
    v, faces = tables(spark, p, f)
    q = queries(spark, [[0.5, 0.5, 2.0], [0.2, 0.2, 0.05]])
    assert [r.winding for r in winding.winding_numbers(q, v, faces.where("false")).collect()] == [0.0, 0.0]
    many = [f[0]] * 200
    got = np.array([r.winding for r in sorted(winding.winding_numbers(q, *tables(spark, p, many), leaf=4).collect())])
    assert np.allclose(got, solid(np.array([[0.5, 0.5, 2.0], [0.2, 0.2, 0.05]]), p, many))


def test_signed_distance_multiplies_nothing(spark):
    p, f = torus(16, 8)
    v, faces = tables(spark, p, f)
    q = queries(spark, [[2.0, 0, 0], [0.0, 0, 0], [0, 2.2, 0.1]])
    found = winding.winding_numbers(q, v, faces, leaf=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert [r.distance < 0 for r in sorted(spatial.signed_distance(q, v, faces).collect())] == [True, False, True]
