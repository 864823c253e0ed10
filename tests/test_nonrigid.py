"""Optimal-step fit against dense solves, and its limits."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshspark.operators.topology import unique_edges
from meshspark.plans import nonrigid
from meshspark.plans.fit import map_mesh


def grid(n, seed=0):
    rng = np.random.default_rng(seed)
    p = np.array([[i / (n - 1), j / (n - 1), 0.1 * rng.random()] for i in range(n) for j in range(n)])
    f = [t for i in range(n - 1) for j in range(n - 1) for a in [i * n + j] for t in ((a, a + 1, a + n), (a + 1, a + n + 1, a + n))]
    return p, f


def tables(spark, p, f):
    v = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "vid long, x double, y double, z double")
    return v, spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "fid long, i0 long, i1 long, i2 long")


def dense(p, f, m, w, alpha, gamma):
    """The energy's rows as a matrix, and its right side."""
    edges = sorted({tuple(sorted(e)) for t in f for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))})
    a = np.zeros((4 * len(edges) + len(p), 4 * len(p)))
    for i, (u, v) in enumerate(edges):
        for k in range(4):
            g = alpha * (gamma if k == 3 else 1)
            a[4 * i + k, 4 * u + k], a[4 * i + k, 4 * v + k] = -g, g
    for i, x in enumerate(p):
        a[4 * len(edges) + i, 4 * i : 4 * i + 4] = w[i] * np.append(x, 1)
    b = np.zeros((len(a), 3))
    b[4 * len(edges) :] = w[:, None] * m
    return a, b


def collected(maps, n):
    rows = sorted(maps.collect())
    assert [r.vid for r in rows] == list(range(n))
    return np.array([r["x"] for r in rows]).reshape(n, 4, 3)


@pytest.mark.parametrize("alpha,gamma", [(200.0, 1.0), (3.0, 0.5)])
def test_solution_is_the_dense_one(spark, alpha, gamma):
    p, f = grid(4)
    rng = np.random.default_rng(1)
    m, w = p + 0.2 * rng.random(p.shape), (rng.random(len(p)) < 0.8).astype(float)
    v, faces = tables(spark, p, f)
    found = spark.createDataFrame([(i, float(w[i]), *map(float, m[i])) for i in range(len(p)) if i != 3], "vid long, weight double, mx double, my double, mz double")
    w[3] = 0.0
    rows = nonrigid.with_matches(nonrigid.neighbour_lists(v, unique_edges(faces)), found).join(nonrigid.identity_maps(v), "vid")
    maps, record = nonrigid.solve(rows, alpha, gamma, tol=1e-9, rounds=300)
    a, b = dense(p, f, m, w, alpha, gamma)
    x = collected(maps, len(p)).reshape(-1, 3)
    assert np.abs(a.T @ (b - a @ x)).max() <= 1e-7 * np.abs(a.T @ b).max()
    moved = np.einsum("nk,nkc->nc", np.c_[p, np.ones(len(p))], x.reshape(-1, 4, 3))
    expected = np.einsum("nk,nkc->nc", np.c_[p, np.ones(len(p))], np.linalg.lstsq(a, b, rcond=None)[0].reshape(-1, 4, 3))
    assert np.abs(moved - expected).max() < 1e-5 and record["rounds"] < 300


def test_product_and_residual(spark):
    p, f = grid(4)
    v, faces = tables(spark, p, f)
    rng = np.random.default_rng(2)
    x, m, w = rng.random((len(p), 12)), rng.random(p.shape), np.ones(len(p))
    maps = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vid long, x array<double>")
    found = spark.createDataFrame([(i, 1.0, *map(float, r)) for i, r in enumerate(m)], "vid long, weight double, mx double, my double, mz double")
    rows = nonrigid.with_matches(nonrigid.neighbour_lists(v, unique_edges(faces)), found).join(maps, "vid")
    got = sorted(nonrigid.with_residual(nonrigid.with_product(rows, "x", 2.0, 0.5), 2.0, 0.5).collect(), key=lambda r: r.vid)
    a, b = dense(p, f, m, w, 2.0, 0.5)
    q, r = a.T @ a @ x.reshape(-1, 3), a.T @ (b - a @ x.reshape(-1, 3))
    assert np.allclose([y["q"] for y in got], q.reshape(-1, 12))
    assert np.allclose([y["r"] for y in got], r.reshape(-1, 12))


def test_fit_follows_a_bent_target_and_leaves_far_vertices(spark):
    p, f = grid(5)
    bent = p + np.c_[np.zeros(len(p)), np.zeros(len(p)), 0.05 * p[:, 0] ** 2]
    v, faces = tables(spark, np.r_[p, [[9.0, 9.0, 9.0]]], f)
    target = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(bent)], "pid long, x double, y double, z double")
    step = nonrigid.OptimalStep(alphas=(20.0, 2.0), inner=1, threshold=0.08)
    out, _ = step.fit((v, faces), target)
    rows = sorted(out.collect())
    got = np.array([r[1:] for r in rows])
    assert np.allclose(got[-1], 9.0) and np.abs(got[:-1] - bent).max() < 0.02
    assert [r["alpha"] for r in step.history] == [20.0, 2.0] and all(r["residual"] <= 1e-6 for r in step.history)


def test_normals_gate_matches(spark):
    p, f = grid(3)
    v, faces = tables(spark, np.c_[p[:, :2], np.zeros(len(p))], f)
    side = lambda z: spark.createDataFrame([(i, float(x[0]), float(x[1]), 0.01, 0.0, 0.0, z) for i, x in enumerate(p)], "pid long, x double, y double, z double, nx double, ny double, nz double")
    step = nonrigid.OptimalStep(threshold=0.1, cosine=0.7071)
    sums = [step.matches(v, faces, side(z)).agg(F.sum("weight")).first()[0] for z in (1.0, -1.0)]
    assert sorted(sums) == [0.0, 9.0]


def test_mapping_of_a_mesh_onto_itself(spark):
    v, faces = tables(spark, *grid(4))
    out = sorted(map_mesh((v, faces), (v, faces), alphas=(5.0,), inner=1).collect())
    assert np.allclose([r[1:] for r in out], [r[1:] for r in sorted(v.collect())], atol=1e-6)


def test_a_vertex_without_edges_and_match_keeps_its_map(spark):
    p, f = grid(3)
    v, faces = tables(spark, np.r_[p, [[9.0, 9.0, 9.0]]], f)
    found = v.where("vid < 9").selectExpr("vid", "1.0D AS weight", "x AS mx", "y AS my", "z + 0.1D AS mz")
    rows = nonrigid.with_matches(nonrigid.neighbour_lists(v, unique_edges(faces)), found).join(nonrigid.identity_maps(v), "vid")
    maps = collected(nonrigid.solve(rows, 2.0, rounds=0)[0], 10)
    assert np.array_equal(maps[9], np.eye(4)[:, :3]) and not np.allclose(maps[0], np.eye(4)[:, :3])


def test_what_is_not_solved_is_no_result(spark):
    p, f = grid(4)
    v, faces = tables(spark, p, f)
    bent = lambda z: v.selectExpr("vid", "1.0D AS weight", "x AS mx", "y AS my", f"{z} AS mz")
    rows = lambda found: nonrigid.with_matches(nonrigid.neighbour_lists(v, unique_edges(faces)), found).join(nonrigid.identity_maps(v), "vid")
    with pytest.raises(nonrigid.NotSettled):
        nonrigid.solve(rows(bent("z + x * x")), 2.0, rounds=0)
    with pytest.raises(nonrigid.NotSettled):
        nonrigid.solve(rows(bent("double('nan')")), 2.0, rounds=2)
    flat, record = nonrigid.solve(rows(bent("0.0D")), 2.0)  # nothing on the right side of a column
    assert record["residual"] <= 1e-6 and np.isfinite(collected(flat, 16)).all()


def test_a_block_is_solved_as_if_all_others_were_zero():
    p, f = grid(5)
    rng = np.random.default_rng(4)
    w = (rng.random(len(p)) < 0.7).astype(float)
    a, _ = dense(p, f, p, w, 3.0, 0.5)
    whole = (a.T @ a).reshape(len(p), 4, len(p), 4)
    near = [[int(j) for j in range(len(p)) if j != i and np.abs(whole[i, :, j]).max() > 0] for i in range(len(p))]
    vid = rng.permutation(len(p))[:15]  # in any order, some neighbours elsewhere
    r = rng.random((15, 4, 3))
    degree = np.array([float(len(near[i])) for i in vid])
    u = nonrigid._block_inverse(r, vid, pa.array([near[i] for i in vid], pa.list_(pa.int64())), degree, np.c_[p, np.ones(len(p))][vid], w[vid], np.array([9.0, 9.0, 9.0, 9.0 * 0.25]))
    own = whole[vid][:, :, vid].reshape(60, 60)
    left = r.reshape(60, 3) - own @ u.reshape(60, 3)
    assert (np.linalg.norm(left, axis=0) <= 1.01 * nonrigid.BLOCK_TOL * np.linalg.norm(r.reshape(60, 3), axis=0)).all()
