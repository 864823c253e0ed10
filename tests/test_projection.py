"""Projection that keeps walls apart: against a loop over vertices, and by its laws."""

import numpy as np
from pyspark.sql import functions as F

from meshspark import queries_fit
from meshspark.operators import guard, metrics, spatial
from meshspark.plans import fit
from meshspark.sources import fixtures
from test_nonrigid import grid, tables


def shell(spark, gap, n=4):
    """Two flat sheets ``gap`` apart, as one mesh."""
    p, f = grid(n)
    p = p * [1, 1, 0]
    return tables(spark, np.r_[p, p + [0, 0, gap]], f + [tuple(i + len(p) for i in t) for t in f])


def test_caps_follow_the_thickness(spark):
    v, f = shell(spark, 0.1)
    caps = {r.vid: r for r in fit.wall_caps(v, f, step=0.2, most=0.5, part=0.5, gap=0.04).collect()}
    eps = 0.05 / 3  # rays start a twentieth of the median edge off their face
    for r in caps.values():
        assert 0.05 - eps <= r.cap <= 0.05 + 1e-9 and 0.03 - eps <= r.allowance <= 0.03 + 1e-9
    assert np.allclose([caps[0].dx, caps[0].dy, caps[0].dz], [0, 0, 1]) and np.isclose(caps[16].dz, -1)
    far = fit.wall_caps(v, f, step=0.2, most=0.01, part=0.5, gap=0.04).collect()
    assert all(r.cap == 0.2 and np.isinf(r.allowance) and r.dx == r.dy == r.dz == 0 for r in far)


def test_capped_projection_is_that_of_a_loop(spark):
    v, f = shell(spark, 0.1)
    flat, faces = grid(3)
    target = tables(spark, flat * [1, 1, 0] + [0, 0, 0.3], faces)
    now = v.select("vid", "x", "y", (F.col("z") + 0.02).alias("z"))
    caps = spark.createDataFrame([(i, [0.05, float("inf")][i % 2], [0.01, 0.04, float("inf")][i % 3], 0.0, 0.6, 0.8) for i in range(32)], "vid long, cap double, allowance double, dx double, dy double, dz double")
    got = {r.vid: r for r in fit.capped_projection(now, v, target, caps).collect()}
    rest = {r.vid: np.array([r.x, r.y, r.z]) for r in v.collect()}
    d = np.array([0.0, 0.6, 0.8])
    for i, r in rest.items():
        p = r + [0, 0, 0.02]
        step = np.array([p[0], p[1], 0.3]) - p
        length = np.linalg.norm(step)
        m = p + step * min([0.05, np.inf][i % 2] / length, 1)
        m = m - d * max((m - r) @ d - [0.01, 0.04, np.inf][i % 3], 0)
        assert np.allclose([got[i].x, got[i].y, got[i].z], m) and np.isclose(got[i].distance, length)


def test_sides_of_a_wall_that_move_at_once_do_not_pass_each_other(spark):
    v, f = shell(spark, 0.1)
    low = F.col("vid") < 16
    # each side goes farther than half the gap: neither meets where the other was, but they would swap
    over = v.select("vid", (F.col("x") + F.when(low, 0.013).otherwise(0.0)).alias("x"), "y", (F.col("z") + F.when(low, 0.08).otherwise(-0.08)).alias("z"))
    now, taken = guard.settled(v, v, over, f, rounds=6)
    assert taken > 0 and spatial.segment_hits(metrics.trajectories(v, now), now, f).isEmpty()
    same, none = guard.settled(v, v, over, f, least=1.0)
    assert none == 0 and same.join(over, ["vid", "x", "y", "z"]).count() == 32


def test_sweeps_end_when_nothing_moves_and_keep_the_gap(spark):
    v, f = shell(spark, 0.1)
    flat, faces = grid(3)
    target = tables(spark, flat * [1, 1, 0] + [0, 0, 0.05], faces)
    run = fit.ProjectionFit((v, f), target, fit.FitConfig(rigid=False, step_tau=200.0, wall_tau=1000.0, gap_tau=80.0, max_sweeps=12))
    run.fit_and_evaluate(use_vertices=True)
    z = {r.vid: r.z for r in run.result()[0].collect()}
    left = min(z[i + 16] - z[i] for i in range(16))
    assert 80 * run.tau / run.scale - 1e-6 <= left < 0.1
    assert len(run.history) < 12 and run.history[-1]["moving"] == 0 or run.history[-1]["mean_move"] < run.history[0]["mean_move"]
    assert set(run.history[0]) == {"level", "iter", "mean_move", "max_move", "moving", "clamped", "mean_distance"}


def test_empty_and_single_faces(spark):
    v, f = shell(spark, 0.1)
    caps = fit.wall_caps(v, f.limit(0), step=0.2, most=0.5, part=0.5, gap=0.1)
    assert caps.count() == 32 and caps.where("cap <> 0.2").isEmpty()
    now, taken = guard.settled(v, v, v, f)
    assert taken == 0 and now.count() == 32


def test_moves_of_the_query_are_taken_back_before_the_field_that_stands(spark):
    sf = "/root/testdata/sf0.001"
    fields = [{r.vid: r.z for r in fixtures.height_field(spark, sf, k)[0].collect()} for k in range(3)]
    taken = 0
    got = {r.vid: r.z for r in queries_fit.opt7_settled_moves(spark, sf).collect()}
    assert got.keys() == fields[0].keys()
    for i, z in got.items():
        a, way = fields[0][i], 0.2 * (fields[1][i] - fields[0][i])
        t = (fields[2][i] - a) / way  # the fields' vertices are above each other
        part = max(np.ceil(t * 128) - 1, 0) / 128 if 0 <= t <= 1 else 1.0
        taken += part < 1
        assert abs(z - (a + way * part)) < 1e-6
    assert taken > 5
