import itertools
import math
import random

import numpy as np
import pytest

from meshspark.functions import geometry as G
from meshspark.functions.vec import Vec
from meshspark.operators.topology import corners

A = ((-1, -1, 0), (1, -1, 0), (0, 1, 0))


def row(spark, **vectors):
    flat = {f"{k}{c}": float(v) for k, xyz in vectors.items() for c, v in zip("xyz", xyz, strict=True)}
    return spark.createDataFrame([tuple(flat.values())], list(flat))


def pair(spark, one, two):
    return row(spark, **{f"{t}_{k}": v for t, tri in (("a", one), ("b", two)) for k, v in zip("abc", tri, strict=True)})


@pytest.mark.parametrize("p,d2", [((0.25, 0.25, 2), 4.0), ((0, 0, 0), 0.0), ((0.5, -1, 0), 1.0), ((2, 0, 0), 1.0), ((1, 1, 0), 0.5), ((-1, 0.5, 0), 1.0), ((0, 3, 0), 4.0)])
def test_point_triangle(spark, p, d2):
    df = row(spark, p=p, a=(0, 0, 0), b=(1, 0, 0), c=(0, 1, 0))
    assert abs(G.with_closest_on_triangle(df, Vec.of("p"), *corners()).first().d2 - d2) < 1e-9


@pytest.mark.parametrize("z,d2", [(0, 0.0), (2, 4.0)])
def test_segments(spark, z, d2):
    df = row(spark, p=(-1, 0, 0), q=(1, 0, 0), r=(0, -1, z), s=(0, 1, z))
    got = df.select(G.segment_distance2(*[Vec.of(k) for k in "pqrs"]).alias("d")).first().d
    assert abs(got - d2) < 1e-6


@pytest.mark.parametrize("other,hit", [(((0, 0, -1), (0, 0, 1), (0.5, 0.5, 1)), True), (((0, 0, 5), (0, 0, 7), (0.5, 0.5, 6)), False), (A, True), (((5, 5, 0), (7, 5, 0), (6, 7, 0)), False), (((0, 0, 0.1), (0, 0, 1.1), (0.5, 0.5, 1.1)), False)])
def test_interval_intersection(spark, other, hit):
    assert G.with_intersection(pair(spark, A, other), corners("a_"), corners("b_"), "hit").first().hit is hit


def test_triangle_distance(spark):
    df = pair(spark, A, ((0, 0, 0.1), (0, 0, 1.1), (0.5, 0.5, 1.1)))
    assert abs(G.with_triangle_distance2(df, corners("a_"), corners("b_")).first().tri_d2 - 0.01) < 1e-9


@pytest.mark.parametrize("one,two,hit", [
    (A, ((0, 0, -0.5), (0, 0, 0.5), (0.3, 0, 0)), True),
    (((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((0, 0, 1e-5), (1, 0, 1e-5), (0, 1, 1e-5)), False),
    (((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((0, 0, 0), (0, 0, 0.5), (0.5, 0.5, 0.5)), False),
])
def test_penetration(spark, one, two, hit):
    assert G.with_penetration(pair(spark, one, two), corners("a_"), corners("b_"), "hit").first().hit is hit


@pytest.mark.parametrize("q,hit", [((0, -0.2, 0), False), ((0, -0.2, 0.2), True)])
def test_strict_edge_crossing(spark, q, hit):
    df = row(spark, p=(0, -0.2, -0.5), q=q, a=A[0], b=A[1], c=A[2])
    assert G.with_edge_cross(df, Vec.of("p"), Vec.of("q"), *corners(), out="hit").first().hit is hit


@pytest.mark.parametrize("p,q,hit", [((0.25, 0.25, -0.5), (0.25, 0.25, 0.5), True), ((0.8, 0.8, -0.5), (0.8, 0.8, 0.5), False), ((0.25, 0.25, 0.5), (0.25, 0.25, 1.5), False), ((-1, 0.25, 0), (2, 0.25, 0), False)])
def test_pierce(spark, p, q, hit):
    df = row(spark, p=p, q=q, a=(0, 0, 0), b=(1, 0, 0), c=(0, 1, 0))
    assert G.with_pierce(df, Vec.of("p"), Vec.of("q"), *corners()).first().hit is hit


def test_pierce_parameter_and_window(spark):
    df = row(spark, p=(0, 0, 1), q=(0, 0, -1), a=(-1, -1, 0), b=(1, -1, 0), c=(-1, 1, 0))
    assert abs(G.with_pierce(df, Vec.of("p"), Vec.of("q"), *corners(), t="t").first().t - 0.5) < 1e-9
    df = row(spark, p=(0, 0, 0), q=(0, 0, 1), a=(-1, -1, 0), b=(1, -1, 0), c=(-1, 1, 0))
    for lo, hit in ((0.0, True), (1e-3, False)):
        assert G.with_pierce(df, Vec.of("p"), Vec.of("q"), *corners(), t_lo=lo).first().hit is hit


def test_random_closest_points(spark):
    rng = random.Random(5)
    rows = [tuple(rng.uniform(-1, 1) for _ in range(12)) for _ in range(60)]
    df = spark.createDataFrame(rows, [f"{k}{c}" for k in "pabc" for c in "xyz"])
    got = G.with_closest_on_triangle(df, Vec.of("p"), *corners()).collect()
    grid = [(u / 60, v / 60) for u, v in itertools.product(range(61), repeat=2) if u + v <= 60]
    for r in got:
        p, a, b, c = (np.array([r[f"{k}{x}"] for x in "xyz"]) for k in "pabc")
        best = min(float(((a + u * (b - a) + v * (c - a) - p) ** 2).sum()) for u, v in grid)
        assert r.d2 <= best + 1e-9 and math.sqrt(best) - math.sqrt(r.d2) < 0.06


def test_frames_and_caps(spark):
    df = row(spark, p=(3, 4, 0), r=(0, 0, 0), d=(1, 0, 0))
    v = Vec.of("p")
    there = G.from_frame(G.to_frame(v, (1, 1, 1), 0.5), (1, 1, 1), 0.5)
    short, kept = G.clamp_norm(v, 1.0), G.inward_cap(v, Vec.of("r"), Vec.of("d"), Vec.of("p").x * 0 + 1.0)
    got = df.select(*there.named("t"), *short.named("s"), *kept.named("k")).first()
    assert (got.tx, got.ty, got.tz) == (3, 4, 0) and abs(got.sx - 0.6) < 1e-12 and (got.kx, got.ky) == (1, 4)
    assert G.box_of((0, 0, 0), 2.0) == ((-1, -1, -1), (1, 1, 1))
