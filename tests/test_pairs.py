"""Pairs of near faces found by numpy within cells: the same as all pairs, and rows only where they are the result."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_steep import steep

from meshspark.functions import geometry as G
from meshspark.functions import tiles
from meshspark.operators import constraints, gradients, spatial
from meshspark.operators.topology import corners


def sheets(spark, w=9):
    """Two steep sheets through each other, a corner of one without height."""
    v, f = steep(spark, w)
    two = steep(spark, w, seed=2, tall=0.2)
    v = v.union(two[0].selectExpr(f"vid + {w * w}", "x", "y", f"IF(vid = {w + 3}, NULL, z)"))
    return v, f.union(two[1].selectExpr(f"fid + {2 * (w - 1) ** 2}", *[f"i{k} + {w * w}" for k in range(3)]))


def plain(m, gap):
    return spatial.face_pairs(*m, gap)


@pytest.mark.parametrize("crowded", [16_384, 40])
def test_pairs_within_cells_are_those_of_the_join(spark, monkeypatch, crowded):
    monkeypatch.setattr(spatial, "CROWDED", crowded)
    m = sheets(spark)
    for gap in (0.0, 0.05):
        got = sorted(map(tuple, spatial.visited(spatial.face_boxes(*m, gap), tiles.Ids()).collect()))
        assert got == sorted(map(tuple, plain(m, gap).select("a_fid", "b_fid").collect())) and len(got) > 100
    assert spatial.visited(spatial.face_boxes(m[0], m[1].limit(0)), tiles.Ids()).isEmpty()


def test_sheet_pairs_are_not_shuffled(spark):
    m = sheets(spark)
    for opposite in (False, True):
        made = constraints.sheet_pairs(*m, 0.05, opposite=opposite)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
        both = plain(m, 0.05)
        if opposite:
            both = both.where(G.face_normal(*corners("a_")).dot(G.face_normal(*corners("b_"))) < -0.3)
        axis = (G.centroid(*corners("b_")) - G.centroid(*corners("a_"))).unit()
        expected = both.select(F.col("a_fid").alias("fa"), F.col("b_fid").alias("fb"), *axis.named("u"))
        key = lambda r: r[:2]
        assert sorted(map(tuple, made.collect()), key=key) == sorted(map(tuple, expected.collect()), key=key)
        assert opposite or made.where("ux IS NULL").count() > 0


def written(monkeypatch):
    rows, save = [], gradients.saved
    monkeypatch.setattr(gradients, "saved", lambda df: rows.append(save(df)) or rows[-1])
    return rows


def summed(parts):
    return {r.vid: np.array(r[1:]) for r in gradients.total(parts).collect()}


def same(got, expected):
    assert got.keys() == expected.keys() and got
    assert max(np.abs(got[k] - expected[k]).max() for k in got) < 1e-14


def test_sheet_gradient_is_that_of_its_pairs_and_writes_rows_of_faces(spark, monkeypatch):
    m = sheets(spark, 12)
    near = spatial.collision_candidates(*m, 0.2)
    pairs = near.withColumns({"ux": F.lit(0.0), "uy": F.lit(0.6), "uz": F.lit(0.8), "margin": F.lit(0.3)})
    expected = summed(gradients.sheet(pairs, *m, 2.0))
    rows = written(monkeypatch)
    same(summed(gradients.sheet_between(*m, 0.2, (0.0, 0.6, 0.8), 0.3, 2.0)), expected)
    assert len(rows) == 1 and rows[0].count() < 20 * m[1].count() < near.count()


@pytest.mark.parametrize("margin", [0.02, 0.2])
def test_collision_gradient_is_that_of_its_pairs_and_writes_rows_of_faces(spark, monkeypatch, margin):
    v, f = sheets(spark, 12)
    m = v.where("z IS NOT NULL"), f
    expected = summed(gradients.collision(spatial.collision_candidates(*m, margin), *m, margin, 2.0))
    rows = written(monkeypatch)
    same(summed(gradients.collision_within(*m, margin, 2.0)), expected)
    assert len(rows) == 1 and rows[0].count() < 60 * f.count()


def test_closest_pairs_are_the_first_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CROWDED", 100)
    m = sheets(spark, 12)
    d = (G.centroid(*corners("a_")) - G.centroid(*corners("b_"))).norm2()
    every = sorted(plain(m, 0.1).select(F.coalesce(d, F.lit(float("inf"))), "a_fid", "b_fid").collect())
    assert every[-1][0] == float("inf")
    for k in (0, 1, 50, len(every) - 1, len(every) + 5):
        got = spatial.collision_candidates(*m, 0.1, max_pairs=k)
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[1:]) for r in every[:k])
