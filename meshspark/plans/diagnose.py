"""Diagnoses of intersections and moves: one-row or few-row aggregates over the same tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vec import Vec
from ..operators import guard, metrics, spatial
from ..operators.topology import CORNERS, corners
from .fit import projected

WINDOWS = (0.0, 1e-8, 1e-6, 1e-4)


def crossings_by_window(hits: DataFrame, windows: tuple[float, ...] = WINDOWS) -> DataFrame:
    """``t_lo``, crossings from that parameter on, and the first of them: one pass over the hits."""
    one = hits.agg(*[f.alias(f"{n}{i}") for i, w in enumerate(windows) for n, f in (("n", F.sum((F.col("t") >= w).cast("long"))), ("t", F.min(F.when(F.col("t") >= w, F.col("t")))))])
    rows = [F.struct(F.lit(w).alias("t_lo"), F.coalesce(f"n{i}", F.lit(0)).alias("n"), F.col(f"t{i}").alias("t_min")) for i, w in enumerate(windows)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def predicates(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: pairs by the interval test and by strict penetration among the same candidates."""
    return spatial.detected(spatial.face_pairs(vertices, faces), ("moller", "penetrate"))


def partner_pierced(pairs: DataFrame, before: DataFrame, after: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: pairs, and the share where a corner's move pierces the partner as it stood before."""
    both = spatial.gathered(pairs, before, faces)
    ends = after.select(F.col("vid"), *Vec.of().named("q"))
    corner = []
    for mine, other in (("a_", "b_"), ("b_", "a_")):
        for k, i in zip("abc", CORNERS, strict=True):
            corner.append(F.struct(F.col(f"{mine}{i}").alias("vid"), *Vec.of(f"{mine}{k}").named("p"), *[v for o, c in zip("abc", corners(other), strict=True) for v in c.named(o)]))
    each = both.select("a_fid", "b_fid", F.explode(F.array(*corner)).alias("c")).select("a_fid", "b_fid", "c.*").join(ends, "vid")
    hit = G.with_pierce(each, Vec.of("p"), Vec.of("q"), *corners()).groupBy("a_fid", "b_fid").agg(F.max(F.col("hit").cast("int")).alias("hit"))
    return hit.agg(F.count("*").alias("n"), F.avg("hit").alias("share"))


def shared_targets(pairs: DataFrame, vertices: DataFrame, faces: DataFrame, target: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row: share of pairs whose corners have a closest target face in common, and the mean cosine
    of their normals with the shares under -0.5 and over 0.5."""
    prim = spatial.closest_on_mesh(vertices, *target).select(F.col("qid").alias("vid"), F.col("fid").alias("prim"))
    of_face = faces.select("fid", F.explode(F.array(*CORNERS)).alias("vid")).join(prim, "vid").groupBy("fid").agg(F.collect_set("prim").alias("prims"))
    both = spatial.gathered(pairs, vertices, faces)
    cosine = G.face_normal(*corners("a_")).dot(G.face_normal(*corners("b_")))
    both = both.select("a_fid", "b_fid", cosine.alias("cosine")).join(of_face.toDF("a_fid", "pa"), "a_fid").join(of_face.toDF("b_fid", "pb"), "b_fid")
    return both.agg(F.avg(F.arrays_overlap("pa", "pb").cast("double")).alias("sharing"), F.avg("cosine").alias("mean_cosine"), F.avg((F.col("cosine") < -0.5).cast("double")).alias("opposed"), F.avg((F.col("cosine") > 0.5).cast("double")).alias("aligned"))


def sides(pairs: DataFrame, vertices: DataFrame, faces: DataFrame, target: tuple[DataFrame, DataFrame], tau: float) -> DataFrame:
    """One row: share of pairs with centroids on opposite sides of the target, and on one side within half ``tau``."""
    g = faces.select("fid")
    mid = spatial.triangles(vertices, faces).select("fid", *G.centroid(*corners()).named()).join(g, "fid")
    d = spatial.signed_distance(mid, *target, query_id="fid").select("qid", "distance")
    near = spatial.gathered(pairs, vertices, faces).select("a_fid", "b_fid", (G.centroid(*corners("a_")) - G.centroid(*corners("b_"))).norm().alias("gap"))
    both = near.join(d.toDF("a_fid", "da"), "a_fid").join(d.toDF("b_fid", "db"), "b_fid")
    opposite = F.col("da") * F.col("db") < 0
    return both.agg(F.avg(opposite.cast("double")).alias("opposite"), F.avg((~opposite & (F.col("gap") < 0.5 * tau)).cast("double")).alias("same_side_close"))


def with_and_without_pullback(vertices: DataFrame, faces: DataFrame, target: tuple[DataFrame, DataFrame], baseline: DataFrame) -> DataFrame:
    """A row for a projection as it is and one for it pulled back: crossings of the moves and new intersections."""
    goal = projected(vertices, target).select("vid", "x", "y", "z")
    rows = []
    for tag, now in (("off", goal), ("on", guard.resolve_trajectory(vertices, goal, faces))):
        hits = metrics.trajectory_report(spatial.segment_hits(metrics.trajectories(vertices, now), now, faces, t_lo=1e-4)).select("n_vertices", "n_pairs")
        fresh = metrics.new_pairs(metrics.self_intersections(now, faces), baseline).agg(F.count("*").alias("n_new_pairs"))
        rows.append(hits.crossJoin(fresh).select(F.lit(tag).alias("pullback"), "*"))
    return reduce(DataFrame.unionByName, rows)
