import random

import pytest
from pyspark.sql import functions as F

from meshspark.operators import constraints, crop, guard, locate, metrics, objective, refine, spatial, state, topology
from meshspark.plans import evaluate, fit
from meshspark.sources import mesh_files


def mesh(spark, v, f):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "vid long, x double, y double, z double"), spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "fid long, i0 long, i1 long, i2 long")


FAN = [(0, 1, 2), (0, 2, 3)]
QUAD = [(0, 0), (1, 0), (0, 1), (1, 1)]
TETRA = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]


def grid(n, z=0.0, shift=0):
    v = [(i / (n - 1), j / (n - 1), z) for i in range(n) for j in range(n)]
    f = []
    for i in range(n - 1):
        for j in range(n - 1):
            a = i * n + j + shift
            f += [(a, a + 1, a + n), (a + 1, a + n + 1, a + n)]
    return v, f


def pairs_of(df):
    return {tuple(r) for r in df.collect()}


def test_edges_and_adjacency(spark):
    _, f = mesh(spark, [(0, 0, 0)] * 4, FAN)
    assert topology.unique_edges(f).count() == 5
    assert pairs_of(topology.face_adjacency(f)) == {(0, 1)}
    lists = {r.vid: r.fids for r in topology.vertex_face_lists(f).collect()}
    assert lists[0] == [0, 1] and lists[1] == [0]


def test_shared_vertices_and_rings(spark):
    _, f = mesh(spark, [(0, 0, 0)] * 7, [*FAN, (4, 5, 6)])
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "fa long, fb long")
    assert {(r.fa, r.fb): r.shared for r in topology.pairs_sharing_vertex(pairs, f).collect()} == {(0, 1): True, (0, 2): False}
    adj = topology.face_adjacency(f)
    mask = spark.createDataFrame([(0,)], "fid long")
    assert {r.id for r in topology.dilate(mask, adj).collect()} == {0, 1}
    parts = {r.fid: (r.label, r.size) for r in topology.face_components(f.select("fid"), adj).collect()}
    assert parts == {0: (0, 2), 1: (0, 2), 2: (2, 1)}


@pytest.mark.parametrize("marked,nv,nf", [([0], 7, 10), ([0, 1, 2, 3], 10, 16), ([], 4, 4)])
def test_subdivision(spark, marked, nv, nf):
    v, f = mesh(spark, *TETRA)
    v = v.withColumn("rx", F.col("x") + 10)
    nvs, nfs = refine.subdivide(v, f, spark.createDataFrame([(m,) for m in marked], "fid long"), ("rx",))
    assert (nvs.count(), nfs.count()) == (nv, nf)
    assert topology.boundary_edges(nfs).count() == 0
    assert topology.euler_number(nvs, nfs).first().euler == 2
    directed = [(a, b) for r in nfs.collect() for a, b in ((r.i0, r.i1), (r.i1, r.i2), (r.i2, r.i0))]
    assert len(set(directed)) == len(directed) and {(b, a) for a, b in directed} == set(directed)
    assert all(abs(r.rx - r.x - 10) < 1e-12 for r in nvs.collect())


def test_candidates_between_sheets(spark):
    for z, hits in (((0.02,) * 4, False), ((-0.01, 0.01, -0.01, 0.01), True)):
        v = [(*p, 0) for p in QUAD] + [(*p, h) for p, h in zip(QUAD, z, strict=True)]
        m = mesh(spark, v, [(0, 1, 2), (1, 3, 2), (4, 5, 6), (5, 7, 6)])
        near = pairs_of(spatial.knn_collision_candidates(*m, k=4, margin=0.05))
        assert near and all((a < 2) != (b < 2) for a, b in near)
        assert pairs_of(spatial.collision_candidates(*m, 0.05)) >= near
        assert (metrics.self_intersections(*m, predicate="moller").count() > 0) is hits
        # the default is strict: where the sheets cross, every edge meets the other sheet on one of its edges
        assert metrics.self_intersections(*m).count() == 0
    shifted = [(*p, 0) for p in QUAD] + [(x + 0.13, y + 0.07, h) for (x, y), h in zip(QUAD, (-0.01, 0.01, -0.01, 0.01), strict=True)]
    crossing = pairs_of(metrics.self_intersections(*mesh(spark, shifted, [(0, 1, 2), (1, 3, 2), (4, 5, 6), (5, 7, 6)])))
    assert crossing and all(a < 2 <= b for a, b in crossing)


SHEET = [(-1, -1, 0), (1, -1, 0), (-1, 1, 0), (1, 1, 0), (-0.2, -0.2, 1)], [(0, 1, 2), (1, 3, 2)]


def moved(spark, v, vid, to):
    return v.select("vid", *[F.when(F.col("vid") == vid, float(t)).otherwise(F.col(c)).alias(c) for c, t in zip("xyz", to, strict=True)])


def test_segment_against_mesh(spark):
    v, f = mesh(spark, *SHEET)
    segs = metrics.trajectories(v, moved(spark, v, 4, (-0.2, -0.2, -1)))
    assert pairs_of(spatial.segment_hits(segs, v, f).select("sid", "fid")) == {(4, 0)}
    one = spark.createDataFrame([(1,)], "fid long")
    assert spatial.segment_hits(segs, v, f, scope=one).count() == 0
    slide = metrics.trajectories(v, moved(spark, v, 0, (-0.9, -0.9, 0)))
    assert spatial.segment_hits(slide, v, f).count() == 0
    flags = {r.sid: r.crosses for r in spatial.crossing_segments(segs, v, f).collect()}
    assert flags == {4: True}
    now = guard.at_fraction(v, moved(spark, v, 4, (-0.2, -0.2, -1)), guard.earliest_safe(v, moved(spark, v, 4, (-0.2, -0.2, -1)), v, f))
    assert 0 < now.where("vid = 4").first().z < 0.01
    half = guard.largest_safe(v, moved(spark, v, 4, (-0.2, -0.2, -1)), v, f).first().alpha
    assert 0 < half < 0.5
    assert metrics.trajectory_report(spatial.segment_hits(segs, v, f)).first().clean is False


def test_earliest_of_two_sheets(spark):
    v = [(*p, z) for z in (0.25, 0.75) for p in ((-1, -1), (2, -1), (-1, 2))]
    m = mesh(spark, v, [(0, 1, 2), (3, 4, 5)])
    segs = spark.createDataFrame([(0, None, 0.1, 0.1, 0.0, 0.1, 0.1, 1.0)], "sid long, owner_vid long, px double, py double, pz double, qx double, qy double, qz double")
    hits = spatial.segment_hits(segs, *m)
    first = spatial.earliest_hits(segs, hits).first()
    assert hits.count() == 2 and abs(first.t - 0.25) < 1e-9 and first.fid == 0


def test_front_selection(spark):
    rows = lambda t: spark.createDataFrame(list(enumerate(t, 10)), "vid long, t double")
    assert {(r.vid, r.alpha) for r in guard.advancing_front(rows([None, 0.3, None, 0.7])).collect()} == {(10, 1.0), (12, 1.0)}
    assert {(r.vid, r.alpha) for r in guard.advancing_front(rows([0.2, 0.3, 0.9, 0.88])).collect()} == {(12, 0.9), (13, 0.88)}


def test_gate_and_relaxation_leave_no_new_pairs(spark):
    v0, f0 = grid(4, 0.0)
    v1, f1 = grid(4, 0.3, 16)
    rest, f = mesh(spark, v0 + v1, f0 + f1)
    goal = rest.withColumn("z", F.when(F.col("vid") == 5, 0.6).otherwise(F.col("z")))
    base = metrics.self_intersections(rest, f)
    assert base.count() == 0 and metrics.self_intersections(goal, f).count() > 0
    now, pinned = guard.pin_gate(rest, goal, f, topology.unique_edges(f), base)
    assert metrics.self_intersections(now, f).count() == 0 and pinned.count() > 0
    now, alpha = guard.penetration_relax(rest, goal, f, base)
    assert metrics.self_intersections(now, f).count() == 0 and 0 < alpha.where("vid = 5").first().alpha < 1


def test_wall_thickness(spark):
    v = [(*p, 0) for p in QUAD] + [(*p, 0.05) for p in QUAD]
    m = mesh(spark, v, [(0, 1, 2), (1, 3, 2), (4, 5, 6), (5, 7, 6)])
    t = sorted(r.thickness for r in spatial.vertex_thickness(*m, 0.5, 0.005).collect())
    assert abs(t[len(t) // 2] - 0.05) < 0.01
    assert spatial.wall_pairs(*m, 0.5).count() == 2


def test_nearest_by_cells_is_exact(spark):
    rng = random.Random(7)
    points = lambda n: spark.createDataFrame([(i, rng.random(), rng.random() ** 3, 10 * rng.random()) for i in range(n)], "pid long, x double, y double, z double").cache()
    q, r = points(80), points(300)
    far = q.union(spark.createDataFrame([(1000, 50.0, 50.0, 50.0)], q.schema))
    want = pairs_of(spatial.nearest(far, r, 3).select("qid", "rid", "nth"))
    assert pairs_of(spatial.nearest(far, r, 3, broadcast_rows=0).select("qid", "rid", "nth")) == want and len(want) == 243


def test_closest_on_mesh_by_cells_is_exact(spark):
    m = mesh(spark, *grid(6))
    rng = random.Random(9)
    q = spark.createDataFrame([(i, rng.uniform(-1, 2), rng.uniform(-1, 2), rng.uniform(-1, 1)) for i in range(60)], "vid long, x double, y double, z double").cache()
    one = {r.qid: round(r.d2, 9) for r in spatial.closest_on_mesh(q, *m).collect()}
    assert {r.qid: round(r.d2, 9) for r in spatial.closest_on_mesh(q, *m, broadcast_rows=0).collect()} == one
    tetra = mesh(spark, *TETRA)
    inside = spark.createDataFrame([(0, 0.1, 0.1, 0.1), (1, 1.0, 1.0, 1.0)], "vid long, x double, y double, z double")
    d = {r.qid: r.distance for r in spatial.signed_distance(inside, *tetra).collect()}
    assert abs(d[0] + 0.1) < 1e-9 and d[1] > 0


def test_crop(spark):
    m = mesh(spark, *grid(6))
    v, f = crop.crop(*m, crop.normalized_boxes([{"center": (0.25, 0.25, 0), "edge": 0.5}]))
    assert all(r.x <= 0.5 and r.y <= 0.5 for r in v.collect()) and f.agg(F.max("i0")).first()[0] < v.count()
    assert sorted(r.vid for r in v.collect()) == list(range(v.count()))
    assert crop.normalized_boxes(None) == []


def test_sag(spark):
    errors = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.001), (1, 0.0, 0.0, 0.03, 0.2), (2, 0.1, 0.1, 0.1, 0.1)], "fid long, d0 double, d1 double, d2v double, middle double")
    assert [r.fid for r in locate.sagging(errors, 0.05).collect()] == [1]
    assert [r.fid for r in locate.above_mean(errors, 0.05).collect()] == [1]
    assert {r.k: r.n_sag for r in locate.sag_ladder(errors, 0.05).collect()}[1] == 1


def test_states(spark):
    v, _ = mesh(spark, [(0, 0, 0)] * 4, [])
    tau, s = 0.01, state.initial_state(v)
    rows = [(i, r * tau, w * tau, a * tau) for i, (r, w, a) in enumerate(zip((5, 5, 0.1, 5), (0.2, 0.2, 0.2, 0), (0, 0.2, 0, 0), strict=True))]
    moves = spark.createDataFrame(rows, "vid long, resid double, intended double, actual double")
    for _ in range(3):
        s = state.next_state(s, moves, tau)
    got = {r.vid: r.optimizable for r in s.collect()}
    assert got == {0: False, 1: True, 2: True, 3: True}
    mid = state.midpoint_state(s, spark.createDataFrame([(9, 0, 1)], "vid long, e0 long, e1 long")).first()
    assert mid.optimizable and mid.blocked_count == 0


def test_series(spark):
    rows = [("r", i, float(v)) for i, v in enumerate([10, 8, 6, 4, 2, 1, 1, 1, 1, 1, 1, 1])]
    got = state.plateau(spark.createDataFrame(rows, "run_id string, step long, value double"), by=["run_id"], order=["step"]).orderBy("step").collect()
    assert [r.plateaued for r in got] == [False] * 11 + [True]
    log = state.SeriesLog(spark)
    log.add("a", 1.0)
    log.add("a", 2.0)
    log.add("b", 3.0, 7)
    assert {(r.name, r.step, r.value) for r in log.table().collect()} == {("a", 0, 1.0), ("a", 1, 2.0), ("b", 7, 3.0)}


def test_constraints(spark):
    v, _ = mesh(spark, [(0, 0, 0)] * 5, [])
    groups = constraints.VertexGroups()
    assert not groups.is_valid()
    groups.add(1, v.where("vid = 2"))
    groups.add(1, v.where("vid = 3"))
    assert {r.vid: r.group_id for r in groups.of(v).collect()} == {0: 2, 1: 3, 2: 1, 3: 1, 4: 6}
    fixed = constraints.FixedVertices()
    for z in (1.0, 2.0):
        fixed.add(v.where("vid = 1").withColumn("z", F.lit(z)))
    assert fixed.get().first().z == 2.0
    with pytest.raises(ValueError):
        constraints.TargetPoints().add(v.select("vid"))


def test_losses(spark):
    v, f = mesh(spark, *grid(4))
    e = topology.unique_edges(f)
    d = v.select("vid", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.col("vid") * 0.1).alias("z"))
    value = objective.edge_laplacian(d, e).first().loss
    g = {r.vid: r.gz for r in objective.edge_laplacian_gradient(d, e).collect()}
    up = d.withColumn("z", F.when(F.col("vid") == 5, F.col("z") + 1e-6).otherwise(F.col("z")))
    assert abs((objective.edge_laplacian(up, e).first().loss - value) / 1e-6 - g[5]) < 1e-4
    pairs = spark.createDataFrame([(0, 17)], "fa long, fb long")
    assert objective.collision_barrier(pairs, v, f, 0.01).first().loss == 0
    ref = topology.face_geometry(v, f).select("fid", "nx", "ny", "nz", "area2")
    assert tuple(objective.inversion_barrier(v, f, ref).first()) == (0, 0)


def test_files(spark, tmp_path):
    v, f = mesh(spark, *TETRA)
    for kind in ("obj", "ply"):
        path = str(tmp_path / f"m.{kind}")
        assert mesh_files.write_mesh(v, f, path)
        part = next((tmp_path / f"m.{kind}").glob("part-*"))
        single = tmp_path / f"one.{kind}"
        single.write_text(("1 2 3\n" if kind == "obj" else "") + part.read_text())
        rv, rf = mesh_files.read_mesh(spark, str(single))
        assert pairs_of(rv.select("vid", "x", "y", "z")) == pairs_of(v) and pairs_of(rf.select("fid", "i0", "i1", "i2")) == pairs_of(f)
    (tmp_path / "g.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty int Group\nelement face 1\nproperty list uchar int vertex_indices\nproperty float w\nend_header\n0 0 0 1\n1 0 0 2\n0 1 0 2\n3 0 1 2 0.5\n")
    rv, rf = mesh_files.read_mesh(spark, str(tmp_path / "g.ply"))
    assert [r.vertex_Group for r in rv.orderBy("vid").collect()] == [1, 2, 2] and rf.first().face_w == 0.5
    assert mesh_files.read_mesh(spark, str(tmp_path / "none.obj")) is None


def test_samples(spark):
    m = mesh(spark, *grid(5))
    s = mesh_files.surface_samples(*m, 500, 3)
    assert s.count() == 500 and s.select("sid").distinct().count() == 500
    p = mesh_files.sample_points(s, *m)
    assert p.where("x < 0 OR x > 1 OR y < 0 OR y > 1 OR z <> 0").count() == 0
    quarter = p.where("x < 0.5 AND y < 0.5").count()
    assert 95 < quarter < 155
    same = evaluate.evaluate_meshes(m, m, use_vertices=True).first()
    assert same.f1 == 1 and same.chamfer_l1 == 0


def test_icp_and_arap(spark):
    rng = random.Random(1)
    t = spark.createDataFrame([(i, rng.random(), rng.random(), rng.random()) for i in range(80)], "pid long, x double, y double, z double").cache()
    import numpy as np

    c, s = np.cos(0.05), np.sin(0.05)
    turn = np.array([[c, -s, 0, 0.02], [s, c, 0, 0.01], [0, 0, 1, 0], [0, 0, 0, 1]])
    m = fit.icp(fit.transformed(t, turn), t, threshold=0.5)
    assert np.allclose((m @ turn)[:3, :3] / np.cbrt(np.linalg.det((m @ turn)[:3, :3])), np.eye(3), atol=2e-2)
    v, f = mesh(spark, *grid(4))
    v = v.withColumn("z", F.col("vid") % 3 * 0.1)
    e = topology.unique_edges(f)
    turned = fit.transformed(v.withColumnRenamed("vid", "pid"), turn).withColumnRenamed("pid", "vid")
    for r in fit.local_rotations(v, turned, e).collect():
        assert np.allclose(np.array(r.r).reshape(3, 3), turn[:3, :3], atol=1e-6)
    out = {r.vid: (r.x, r.y, r.z) for r in fit.arap_step(turned, v, e).collect()}
    assert all(np.allclose(out[r.vid], (r.x, r.y, r.z), atol=1e-6) for r in turned.collect())


def test_projection_fit(spark):
    source, target = mesh(spark, *grid(4, 0.1)), mesh(spark, *grid(6))
    run = fit.ProjectionFit(source, target, fit.FitConfig(step_tau=500.0, max_sweeps=2, rigid=False))
    (v, _), record = run.fit_and_evaluate(use_vertices=True)
    assert record["kept"] == "fitted" and all(abs(r.z) < 1e-6 for r in v.collect())


def test_self_aware_step_stops_before_the_mesh(spark):
    v, f = mesh(spark, *SHEET)
    low = mesh(spark, [(-1, -1, -1), (1, -1, -1), (-1, 1, -1)], [(0, 1, 2)])
    out = {r.vid: r for r in fit.self_aware_step(v, f, low).collect()}
    assert 0 < out[4].z < 0.01 and out[4].alpha < 1


def test_streamed_plateau(spark, tmp_path):
    from meshspark.streaming.history import stream_plateau

    rows = [("r", i, float(v)) for i, v in enumerate([10, 8, 6, 4, 2, 1, 1, 1, 1, 1, 1, 1])]
    spark.createDataFrame(rows, "run_id string, step long, value double").write.parquet(str(tmp_path / "in"))
    out = stream_plateau(spark.readStream.schema("run_id string, step long, value double").parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("plateau").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.plateaued for r in spark.sql("SELECT * FROM plateau ORDER BY step").collect()] == [False] * 11 + [True]
