"""Disc samples against a loop; restored states; scans among faces; regions; run folders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.operators import locate, metrics, state, topology
from meshspark.plans import fit
from meshspark.sources import mesh_files
from test_nonrigid import grid, tables


def test_first_come_is_a_loop_by_rank(spark):
    rng = np.random.default_rng(8)
    p = rng.random((80, 2))
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    near = spark.createDataFrame([(u, v, float(d2[u, v])) for u in range(80) for v in range(u + 1, 80)], "u long, v long, d2 double")
    points = spark.range(80).withColumnRenamed("id", "pid")
    kept = []
    for i in range(80):
        if all(d2[i, k] >= 0.15**2 for k in kept):
            kept.append(i)
    got = [r.pid for r in mesh_files.first_come(points, near, 0.15).orderBy("pid").collect()]
    assert got == kept


def test_poisson_samples_are_apart_and_all_there(spark):
    p, f = grid(4)
    v, faces = tables(spark, p * [1, 1, 0], f)
    out, radius = mesh_files.poisson_samples(v, faces, 30, seed=2, halvings=3)
    x = np.array([(r.x, r.y, r.z) for r in out.orderBy("pid").collect()])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)[np.triu_indices(30, 1)]
    assert len(x) == 30 and radius > 0.5 * np.sqrt(2 / np.sqrt(3) / 30) and d.min() >= radius
    none, zero = mesh_files.poisson_samples(v, faces.limit(0), 30)
    assert none.isEmpty() and zero == 0.0


def test_states_come_back_from_attributes(spark):
    inf = float("inf")
    rows = [(0, True, 0, inf, 0.5, -1), (1, False, 3, 0.25, 0.125, 2), (2, False, 4, 1.0, 0.0, 1)]
    s = spark.createDataFrame(rows, "vid long, optimizable boolean, blocked_count int, resid_prev double, resid_drop_ema double, last_refine int")
    back = state.restored_state(state.state_attributes(s), s).orderBy("vid").collect()
    assert [tuple(r) for r in back] == rows
    ends = spark.createDataFrame([(7, 0, 1), (8, 1, 2)], "vid long, e0 long, e1 long")
    got = [tuple(r) for r in state.midpoint_state(s, ends).orderBy("vid").collect()]
    assert got == [(7, True, 0, inf, 0.3125, 1), (8, False, 4, 0.625, 0.0625, 2)]  # 3.5 to even; half of 1 rounded up
    assert state.restored_state(state.state_attributes(s.limit(0)), s).isEmpty()


def test_scan_among_faces(spark):
    p = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0.2, 0.2, -1), (0.3, 0.2, 1), (0.2, 0.3, 1), (0.1, 0.5, -1), (0.2, 0.5, 1), (0.1, 0.6, 1)]
    v, f = tables(spark, p, [(0, 1, 2), (3, 4, 5), (6, 7, 8)])
    pick = lambda *ids: f.where(F.col("fid").isin(*ids)).select("fid")
    pairs = lambda **o: sorted(tuple(r) for r in metrics.self_intersections(v, f, **o).collect())
    assert pairs() == [(0, 1), (0, 2)] and pairs(query=pick(1)) == [(0, 1)]
    assert pairs(query=pick(0, 1), among=True) == [(0, 1)] and pairs(query=pick(1, 2), among=True) == []
    assert pairs(query=f.select("fid").limit(0), among=True) == [] and pairs(query=f.select("fid").limit(0)) == []


@pytest.mark.parametrize("criterion", ["mean", "sag"])
def test_regions_lose_small_components_and_grow(spark, criterion):
    p, f = grid(6)
    p = p * [1, 1, 0]
    v, faces = tables(spark, p, f)
    target = tables(spark, *[np.array([[-1, -1, 0], [3, -1, 0], [-1, 3, 0.0]]), [(0, 1, 2)]])
    bent = v.withColumn("z", F.when(F.col("vid") == 14, 0.5).otherwise(0.0)) if criterion == "mean" else v
    adjacency = topology.face_adjacency(faces)
    if criterion == "sag":  # corners lie on the target, nothing sags
        assert locate.localize(bent, faces, target[0].withColumnRenamed("vid", "pid"), target, adjacency, 0.01, "sag", rings=1).isEmpty()
        return
    find = lambda **o: {r.fid for r in locate.localize(bent, faces, target[0].withColumnRenamed("vid", "pid"), target, adjacency, 0.01, "mean", **o).collect()}
    core = {i for i, t in enumerate(f) if 14 in t}
    assert find() == core and find(at_least=len(core) + 1, rings=1) == set()
    ring = core | {b for a, b in topology.both_ways(adjacency, "fa", "fb").collect() if a in core}
    assert find(at_least=len(core), rings=1) == ring


def test_run_folder_tells_whether_it_is_clean(spark, tmp_path):
    p, f = grid(3)
    flat = p * [1, 1, 0]
    shell = tables(spark, np.r_[flat, flat + [0.013, 0.017, 0.2]], f + [tuple(i + 9 for i in t) for t in f])
    run = fit.RelaxedFit(shell, tables(spark, flat, f), fit.FitConfig(rigid=False))
    run.setup()
    path = run.save(str(tmp_path / "a"), {"chamfer_l1": 0.5})
    assert path.endswith("/fitted_mesh.ply") and json.loads(spark.read.text(f"{tmp_path}/a/metrics.json").first()[0]) == {"chamfer_l1": 0.5}
    got, _ = mesh_files.read_mesh(spark, path)
    assert got.count() == 18 and np.allclose([(r.x, r.y, r.z) for r in got.orderBy("vid").collect()][:9], flat)
    run.now = run.now.withColumn("z", F.when(F.col("vid") == 4, 0.4 * run.scale).otherwise(F.col("z")))
    path = run.save(str(tmp_path / "b"))
    assert path.endswith("/fitted_mesh_unverified.ply")
    report = json.loads(spark.read.text(f"{tmp_path}/b/trajectory_report.json").first()[0])
    assert not report["clean"] and report["new_pairs"] > 0 and not mesh_files.exists(spark, f"{tmp_path}/b/metrics.json")
