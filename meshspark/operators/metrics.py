"""Frames, Chamfer distances, F1, and intersection and trajectory reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import Vec
from . import spatial
from .topology import face_components, min_labels, saved

FILL = 0.9  # of a unit that the longest box edge takes after normalization
TAU_PARTS = 2048


def bounds(points: DataFrame) -> DataFrame:
    """One row: center and longest edge of the bounding box."""
    box = points.agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"])
    return box.select(*[((F.col(f"lo{c}") + F.col(f"hi{c}")) / 2.0).alias(f"c{c}") for c in "xyz"], F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"]).alias("length"))


def frame(points: DataFrame) -> tuple[tuple, float, float]:
    """Center, scale and longest edge of the frame that ``points`` define; scale 1 for a degenerate one."""
    r = bounds(points).first()
    length = r["length"] or 0.0
    return (r["cx"], r["cy"], r["cz"]), (FILL / length if length > 1e-12 else 1.0), length


def directional(source: DataFrame, target: DataFrame, tau: float, *, source_id: str = "pid", target_id: str = "pid") -> DataFrame:
    """One row: mean squared and plain nearest distance, and the share strictly under ``tau``."""
    d = spatial.nearest(source, target, query_id=source_id, ref_id=target_id)
    return d.agg(F.avg("d2").alias("l2"), F.avg(F.sqrt("d2")).alias("l1"), F.avg((F.col("d2") < tau * tau).cast("double")).alias("near"))


def evaluate_points(source: DataFrame, target: DataFrame, tau: float) -> DataFrame:
    """One row: Chamfer terms of both directions and their sums, precision, recall and F1 at ``tau``."""
    fit = directional(source, target, tau).toDF("fit_error_l2", "fit_error_l1", "precision")
    cov = directional(target, source, tau).toDF("cov_error_l2", "cov_error_l1", "recall")
    both = fit.crossJoin(cov)  # one row each
    p, r = F.col("precision"), F.col("recall")
    return both.withColumns({"chamfer_l2": F.col("fit_error_l2") + F.col("cov_error_l2"), "chamfer_l1": F.col("fit_error_l1") + F.col("cov_error_l1"), "f1": F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)})


def evaluate_boxes(source: DataFrame, target: DataFrame, boxes: list[dict], tau: float) -> DataFrame:
    """A row for each box with the metrics of the points inside it; null where a side has none."""
    from .crop import crop_points

    out = None
    for b in boxes:
        row = evaluate_points(crop_points(source, b), crop_points(target, b), tau).select(F.lit(b["name"]).alias("box"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def self_intersections(vertices: DataFrame, faces: DataFrame, *, predicate: str = "penetrate", inflate: float = 0.0, cell: float | None = None, query: DataFrame | None = None, among: bool = False, exclude_ring: int = 1, adjacency: DataFrame | None = None) -> DataFrame:
    """``fa < fb`` of all crossing face pairs; with ``query`` (fid) those with at least one face in it, or ``among`` its faces
    only: what such a scan costs follows the query and not the mesh. An empty query has none."""
    from .topology import face_adjacency, within_hops

    if among and query is not None:
        faces, query = faces.join(query.toDF("fid").distinct(), "fid", "left_semi"), None
    found = spatial.detect(spatial.face_pairs(vertices, faces, inflate, cell, query), predicate)
    if exclude_ring > 1:
        found = within_hops(found, adjacency if adjacency is not None else face_adjacency(faces), exclude_ring)
    return found


def new_pairs(pairs: DataFrame, baseline: DataFrame) -> DataFrame:
    return pairs.join(baseline, ["fa", "fb"], "left_anti")


def pair_faces(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("fa", "fb")).alias("fid")).distinct()


def intersection_report(pairs: DataFrame, faces: DataFrame, adjacency: DataFrame | None = None) -> DataFrame:
    """One row: pairs, faces and their share, regions of adjacent faces and the largest of them."""
    pairs = saved(pairs)  # read more than once
    hit = saved(pair_faces(pairs)) if adjacency is not None else pair_faces(pairs)
    one = pairs.agg(F.count("*").alias("n_pairs")).crossJoin(hit.agg(F.count("*").alias("n_faces"))).crossJoin(faces.agg(F.count("*").alias("total")))  # one row each
    one = one.withColumn("face_fraction", F.col("n_faces") / F.greatest("total", F.lit(1)))
    if adjacency is not None:
        parts = face_components(hit, adjacency)
        one = one.crossJoin(parts.agg(F.countDistinct("label").alias("n_regions"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_region")))
    return one.drop("total")


def compared_to_baseline(pairs: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: total and new pairs and faces."""
    pairs = saved(pairs)  # read more than once
    fresh = saved(new_pairs(pairs, baseline))
    row = lambda p, n: p.agg(F.count("*").alias(f"{n}_pairs")).crossJoin(pair_faces(p).agg(F.count("*").alias(f"{n}_faces")))
    return row(pairs, "total").crossJoin(row(fresh, "new"))


def trajectories(reference: DataFrame, moved: DataFrame) -> DataFrame:
    """Segments from the reference to the moved position of every vertex that moved."""
    r = reference.select("vid", *Vec.of().named("p"))
    m = moved.select("vid", *Vec.of().named("q"))
    both = r.join(m, "vid").where((Vec.of("q") - Vec.of("p")).norm2() > 0)
    return both.select(F.col("vid").alias("sid"), F.col("vid").alias("owner_vid"), *[f"{k}{c}" for k in "pq" for c in "xyz"])


def trajectory_report(hits: DataFrame) -> DataFrame:
    """One row: vertices and faces with crossings, crossings, the first parameter, and whether all is clean."""
    return hits.agg(F.countDistinct("sid").alias("n_vertices"), F.count("*").alias("n_pairs"), F.countDistinct("fid").alias("n_faces"), F.min("t").alias("t_min")).withColumn("clean", F.col("n_pairs") == 0)


def vertex_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return min_labels(vertices.select(F.col("vid").alias("node")), edges.toDF("u", "v")).toDF("vid", "label")
