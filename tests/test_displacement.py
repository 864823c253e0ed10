"""Gradients against differences of the losses, optimizer steps against a loop, and bursts that must not cross."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.functions import geometry as G
from meshspark.operators import gradients, metrics, objective
from meshspark.operators.topology import corners, triangles, unique_edges
from meshspark.plans import displacement
from meshspark.plans.fit import FitConfig
from test_nonrigid import grid, tables


def field(df, n):
    out = np.zeros((n, 3))
    for r in df.collect():
        out[r.vid] += (r.gx, r.gy, r.gz)
    return out


def slope(loss, p, at, k, h=1e-5):
    up, down = p.copy(), p.copy()
    up[at, k] += h
    down[at, k] -= h
    return (loss(up) - loss(down)) / (2 * h)


def two_sheets(n=3, gap=0.03, seed=3):
    p, f = grid(n)
    rng = np.random.default_rng(seed)
    p = p + 0.05 * rng.normal(size=p.shape)  # no two features at one distance
    q = p + [0.21, 0.17, gap] + 0.01 * rng.random(p.shape)
    return np.r_[p * [1, 1, 0.3], q * [1, 1, 0.3]], f + [tuple(i + len(p) for i in t) for t in f]


def test_closest_features_are_those_of_the_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6, 3))
    x[:20, 3:] += 3 * rng.normal(size=(20, 1, 3))
    rows = [(i, *map(float, t.reshape(-1))) for i, t in enumerate(x)]
    names = [f"{s}{k}{c}" for s in "st" for k in "abc" for c in "xyz"]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{n} double" for n in names))
    got = G.with_triangle_distance2(df, corners("s"), corners("t"), "d").orderBy("i")
    d2, w = gradients.closest_features(x)
    assert np.allclose(d2, [r.d for r in got.collect()], atol=1e-9)
    assert np.allclose((np.einsum("nk,nki->ni", w, x) ** 2).sum(axis=1), d2) and np.allclose(w[:, :3].sum(axis=1), 1) and np.allclose(w[:, 3:].sum(axis=1), -1)


@pytest.mark.parametrize("term", ["collision", "sheet", "inversion", "laplacian"])
def test_gradients_are_slopes_of_the_losses(spark, term):
    p, f = two_sheets()
    v, faces = tables(spark, p, f)
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(8, 16) if (a + b) % 3], "fa long, fb long")
    sheets = pairs.withColumns({"ux": F.lit(0.0), "uy": F.lit(0.6), "uz": F.lit(0.8), "margin": F.lit(0.15)})
    rng = np.random.default_rng(7)
    known = p + 0.3 * rng.normal(size=p.shape)
    reference = triangles(tables(spark, known, f)[0], faces).select("fid", *G.face_normal(*corners()).named("n"), G.doubled_area(*corners()).alias("area2")).cache()
    edges = unique_edges(faces).cache()
    table = lambda q: tables(spark, q, f)[0]
    loss, found = {
        "collision": (lambda q: objective.collision_barrier(pairs, table(q), faces, 0.2).first().loss, lambda: gradients.collision(pairs, v, faces, 0.2)),
        "sheet": (lambda q: objective.sheet_barrier(sheets, table(q), faces).first().loss, lambda: gradients.sheet(sheets, v, faces)),
        "inversion": (lambda q: sum(objective.inversion_barrier(table(q), faces, reference, 0.5, 0.9).first()), lambda: gradients.inversion(v, faces, reference, len(f), flip=0.5, part=0.9)),
        "laplacian": (lambda q: objective.edge_laplacian(table(q), edges).first().loss, lambda: gradients.edge_laplacian(v, edges, edges.count())),
    }[term]
    got = field(gradients.total(found()), len(p))
    assert np.abs(got).max() > 1e-3
    for at, k in [(4, 0), (4, 2), (13, 1)]:
        assert got[at, k] == pytest.approx(slope(loss, p, at, k), rel=2e-3, abs=1e-6)


def test_data_gradient(spark):
    p, f = grid(3)
    rng = np.random.default_rng(2)
    q, n, w = p + 0.1 * rng.normal(size=p.shape), rng.normal(size=p.shape), (rng.random(9) < 0.7).astype(float)
    m = spark.createDataFrame([(i, float(w[i]), *map(float, q[i]), *map(float, n[i])) for i in range(9)], "vid long, weight double, qx double, qy double, qz double, nx double, ny double, nz double")
    got = field(gradients.data(tables(spark, p, f)[0], m, 9, fit=2.0, plane=3.0), 9)
    off = p - q
    assert np.allclose(got, w[:, None] * (4 * off + 6 * (off * n).sum(1, keepdims=True) * n) / 9)


def test_adam_steps_are_those_of_a_loop_and_begin_anew(spark):
    v, _ = tables(spark, *grid(3))
    rng = np.random.default_rng(5)
    state = gradients.moments(v)
    d, m, s, w, t = (np.zeros((9, 3)) for _ in range(5))
    lr, decay, b1, b2 = 0.1, 0.5, 0.9, 0.999
    for k in range(4):
        g = rng.normal(size=(9, 3)) * (4 - k)
        state = gradients.adam_step(state, spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(g)], "vid long, gx double, gy double, gz double"), lr, decay=decay)
        t += 1
        m, s = b1 * m + (1 - b1) * g, b2 * s + (1 - b2) * g * g
        w = np.maximum(w, s)
        d = d * (1 - lr * decay) - lr * (m / (1 - b1**t)) / (np.sqrt(w / (1 - b2**t)) + 1e-8)
        if k == 1:
            state = gradients.reset(state, v.where("vid < 3"))
            for x in (m, s, w, t):
                x[:3] = 0
    got = {r.vid: (r.dx, r.dy, r.dz) for r in state.collect()}
    assert np.allclose([got[i] for i in range(9)], d)


def test_stages():
    assert [displacement.stage_of(0, i, 6, 3) for i in range(6)] == [0, 0, 1, 1, 2, 2] and displacement.stage_of(1, 0, 6, 3) == 2 and displacement.stage_of(0, 0, 1, 3) == 2


class Small(displacement.DisplacementFit):
    inner, outer, first_inner, lr = 2, 2, 2, 0.02
    mask_tau, laplacian, plane = (1e9,), (0.05,), (0.5,)
    match_every, refresh_every, check_every = 1, 2, 1
    collision_weight, collision_tau, sheet_weight, sheet_tau, wall_tau, inversion_weight = 0.5, 20.0, 0.5, 20.0, 400.0, 0.01


def test_bursts_keep_progress_and_only_crossing_regions_go_back(spark):
    p, f = grid(4)
    flat = p * [1, 1, 0]
    shell, faces = np.r_[flat, flat + [0.013, 0.017, 0.2]], f + [tuple(i + 16 for i in t) for t in f]
    fit = Small(tables(spark, shell, faces), tables(spark, flat, f), FitConfig(rigid=False))
    fit.setup()
    before = fit.state
    # a corner of the lower sheet pierces the upper one, and the far corner moves freely
    move = F.when(F.col("vid") == 0, 0.4 * fit.scale).when(F.col("vid") == 15, -0.1).otherwise(0.0)
    fit.state = before.withColumns({"dz": move, "mz": F.lit(1.0)})
    assert fit.accept(before) > 0
    got = {r.vid: (r.dz, r.mz, r.b1) for r in fit.state.collect()}
    assert got[0][:2] == (0.0, 0.0) and got[15][:2] == (-0.1, 1.0)
    assert fit.weights["sheet"] == 1.0 and fit.sheets.count() > 0 and fit.fresh_pairs(before).isEmpty()
    # both sheets are drawn to the lower one
    fit.state = before
    fit.cycle(0)
    assert metrics.new_pairs(metrics.self_intersections(fit.now, fit.faces), fit.baseline).isEmpty()
    assert fit.history[-1]["data"] < fit.history[0]["data"] and len(fit.history) == 2
