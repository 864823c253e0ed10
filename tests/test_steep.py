"""Steep faces on fine grids: what a join makes grows with the mesh, and results stay those of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.functions import geometry
from meshspark.operators import guard, metrics, spatial
from meshspark.operators.topology import corners, triangles, unique_edges
from meshspark.plans import diagnose


def steep(spark, w, seed=1, tall=0.3):
    """A grid over the unit square with heights at random."""
    z = np.random.default_rng(seed).normal(size=w * w) * tall
    v = [(i, float(i // w) / (w - 1), float(i % w) / (w - 1), float(z[i])) for i in range(w * w)]
    f = []
    for i in range(w - 1):
        for j in range(w - 1):
            a = i * w + j
            f += [(len(f), a, a + 1, a + w), (len(f) + 1, a + 1, a + w + 1, a + w)]
    return spark.createDataFrame(v, "vid long, x double, y double, z double"), spark.createDataFrame(f, "fid long, i0 long, i1 long, i2 long")


def test_cells_of_steep_faces_hold_no_more_of_them_on_finer_grids(spark):
    most = []
    for w in (10, 30):
        boxes = spatial.triangle_boxes(triangles(*steep(spark, w)))
        size = spatial.cell_sizes(boxes)
        held = spatial.in_cells(boxes, size, spatial.levels(boxes, size)).groupBy(*spatial.CELL).count()
        most.append(held.agg(F.sum(F.col("count") * F.col("count"))).first()[0] / (2 * (w - 1) ** 2))  # pairs that meet, a face
    assert most[1] <= 1.5 * most[0], most


def test_nearest_vectors_by_blocks_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    q, r = rng.normal(size=(50, 6)), rng.normal(size=(70, 6))
    r[40] = r[11]  # a tie goes to the smaller id
    q[5] = r[11]
    table = lambda rows: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "pid long, v array<double>")
    got = {x.qid: (x.rid, round(x.d2, 9)) for x in spatial.nearest_vectors(table(q), table(r), block=16).collect()}
    d = ((q[:, None] - r[None]) ** 2).sum(-1)
    assert got == {i: (int(k.argmin()), round(float(k.min()), 9)) for i, k in enumerate(d)} and got[5][0] == 11


def test_rays_in_stretches_find_the_first_walls_of_whole_rays(spark, monkeypatch):
    m = steep(spark, 8, tall=0.1)
    parts, whole = [], spatial._pierced
    monkeypatch.setattr(spatial, "_pierced", lambda *a, part=(0.0, 1.0), **o: parts.append(part) or whole(*a, part=part, **o))
    got = {r.fid: (r.side, r.partner, round(r.thickness, 9)) for r in spatial.wall_hits(*m, 3.0).collect()}
    assert len(parts) > 1
    monkeypatch.setattr(spatial, "_pierced", lambda *a, part=(0.0, 1.0), **o: whole(*a, **o))
    assert got == {r.fid: (r.side, r.partner, round(r.thickness, 9)) for r in spatial.wall_hits(*m, 3.0).collect()}


def test_interval_test_by_numpy_is_that_of_the_expressions(spark):
    v, f = steep(spark, 6)
    two = v.selectExpr("vid + 36", "x", "y", "z * 0.7 + 0.05"), f.selectExpr("fid + 50", "i0 + 36", "i1 + 36", "i2 + 36")
    flat = spark.createDataFrame([(80 + i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(5, 5), (6, 5), (5, 6), (5.1, 5.1), (6.1, 5.1), (5.1, 6.1)])], "vid long, x double, y double, z double")
    of = spark.createDataFrame([(200, 80, 81, 82), (201, 83, 84, 85)], "fid long, i0 long, i1 long, i2 long")
    m = v.union(two[0]).union(flat), f.union(two[1]).union(of)
    pairs = spatial.face_pairs(*m, 0.02).localCheckpoint()
    tested = geometry.with_intersection(pairs, corners("a_"), corners("b_"), "hit", coplanar=False)
    apart = spatial.pair_distances(tested.where("hit IS NULL")).where(F.col("d2") <= geometry.COPLANAR)
    expected = {tuple(r) for r in tested.where("hit").select("a_fid", "b_fid").union(apart.select("fa", "fb")).collect()}
    assert {tuple(r) for r in spatial.detect(pairs, "moller").collect()} == expected
    assert (200, 201) in expected and 10 < len(expected) < pairs.count()
    counts = diagnose.predicates(*m)
    assert counts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # candidates are made and read once
    assert counts.first().moller >= counts.first().penetrate == spatial.detect(spatial.face_pairs(*m)).count()


def test_pairs_of_active_faces_are_made_once_and_in_order(spark):
    m = steep(spark, 7)
    every = spatial.face_pairs(*m, 0.02).select("a_fid", "b_fid", "a_az", "b_az").collect()
    active = spark.createDataFrame([(i,) for i in (3, 4, 5, 30, 31, 31)], "fid long")
    got = spatial.face_pairs(*m, 0.02, active=active)
    assert "a_fid, b_fid" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(got.select("a_fid", "b_fid", "a_az", "b_az").collect()) == sorted(r for r in every if {r[0], r[1]} & {3, 4, 5, 30, 31})


def test_scans_of_a_gate_after_the_first_are_of_the_faces_it_moved(spark, monkeypatch):
    v, f = steep(spark, 8)
    w = v.count()
    rest = v.withColumn("z", F.lit(0.0)).union(v.selectExpr("vid + 64", "x", "y", "0.4D"))
    now = v.union(v.selectExpr("vid + 64", "x", "y", "0.5D - z"))
    both = f.union(f.selectExpr("fid + 98", "i0 + 64", "i1 + 64", "i2 + 64"))
    base, edges = metrics.self_intersections(rest, both), unique_edges(both)
    asked, plain = [], metrics.self_intersections
    monkeypatch.setattr(metrics, "self_intersections", lambda *a, query=None, **o: asked.append(query) or plain(*a, query=query, **o))
    held = guard.pin_gate(rest, now, both, edges, base, rings=0)
    assert w == 64 and len(asked) > 2 and asked[0] is None and all(0 < q.count() < 196 for q in asked[1:])
    monkeypatch.setattr(metrics, "self_intersections", lambda *a, query=None, **o: plain(*a, **o))
    whole = guard.pin_gate(rest, now, both, edges, base, rings=0)
    assert all(sorted(a.collect()) == sorted(b.collect()) for a, b in zip(held, whole, strict=True))


def test_reports_read_their_pairs_once(spark):
    m = steep(spark, 4)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([(0, 9), (1, 9), (2, 11)], "fa long, fb long").mapInArrow(counted, "fa long, fb long")
    assert metrics.intersection_report(pairs, m[1]).first()[:2] == (3, 5) and read.value == 3
    assert metrics.compared_to_baseline(pairs, pairs.limit(0)).first()[:4] == (3, 5, 3, 5) and read.value <= 6
    gap = guard.centroid_gap(pairs, *m, 0.1)
    assert "percentile" not in gap._jdf.queryExecution().executedPlan().toString()
    d = sorted(guard.centroid_gap(pairs.where(f"fa = {i}"), *m, 0.1).first().median for i in range(3))
    assert abs(gap.first().median - d[1]) < 1e-12 and guard.centroid_gap(pairs.where("fa > 5"), *m, 0.1).first().median is None


def test_moves_on_finer_grids_meet_no_more_faces_and_cross_none(spark):
    met = []
    for w in (10, 30):
        v, f = steep(spark, w)
        to = v.select("vid", "x", "y", (F.col("z") * 0.5 + 0.1).alias("z"))
        boxes = spatial.triangle_boxes(triangles(to, f))
        size = spatial.cell_sizes(boxes)
        known = spatial.levels(boxes, size)
        walked = spatial._segments_in_cells(metrics.trajectories(v, to), size, known, 0.0)
        met.append(walked.select(*spatial.CELL).join(spatial.in_cells(boxes, size, known).select(*spatial.CELL), list(spatial.CELL)).count() / w**2)
    assert met[1] <= 1.5 * met[0], met
    v, f = steep(spark, 6)
    to = v.select("vid", "x", "y", (F.col("z") * 0.5 + 0.1).alias("z"))
    now, taken = guard.settled(v, v, to, f)
    assert taken == 0 and sorted(map(tuple, now.collect())) == sorted(map(tuple, to.collect()))
