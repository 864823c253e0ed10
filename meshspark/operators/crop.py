"""Crops of meshes to boxes, with dense new ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vec import Vec
from .topology import CORNERS, corners, dense_rank_ids, triangles

Box = dict


def normalized_boxes(boxes=None, center=None, edge=None, mode: str = "all") -> list[Box]:
    """Box settings as a list of dicts ``name, center, edge, mode``: from dicts, (center, edge[, mode])
    tuples, or one center and edge."""
    if not boxes:
        return [{"name": "box0", "center": tuple(center), "edge": edge, "mode": mode}] if center is not None and edge is not None else []
    out = []
    for i, b in enumerate(boxes):
        b = b if isinstance(b, dict) else dict(zip(("center", "edge", "mode"), b))  # noqa: B905
        out.append({"name": b.get("name") or f"box{i}", "center": tuple(b["center"]), "edge": b["edge"], "mode": b.get("mode", mode)})
    return out


def in_frame(box: Box, center: tuple, scale: float) -> Box:
    edge = box["edge"]
    scaled = tuple(e * scale for e in edge) if isinstance(edge, (tuple, list)) else edge * scale
    return box | {"center": tuple((c - o) * scale for c, o in zip(box["center"], center, strict=True)), "edge": scaled}


def _kept(box: Box) -> Column:
    lo, hi = G.box_of(box["center"], box["edge"])
    a, b, c = corners()
    if box.get("mode", "all") == "centroid":
        return G.in_box(G.centroid(a, b, c), lo, hi)
    return G.in_box(a, lo, hi) & G.in_box(b, lo, hi) & G.in_box(c, lo, hi)


def crop(vertices: DataFrame, faces: DataFrame, boxes: list[Box]) -> tuple[DataFrame, DataFrame]:
    """Faces inside any of the boxes (all corners, or the centroid, by the box's mode) and their
    vertices; ids are dense in the old order, the old ones stay as ``old_vid, old_fid``."""
    keep = reduce(lambda x, y: x | y, [_kept(b) for b in boxes])
    inside = triangles(vertices, faces).where(keep).select(F.col("fid").alias("old_fid"), *CORNERS)
    used = inside.select(F.explode(F.array(*CORNERS)).alias("vid")).distinct()
    v = dense_rank_ids(vertices.join(used, "vid", "left_semi").withColumnRenamed("vid", "old_vid"), ["old_vid"], "vid")
    f = dense_rank_ids(inside, ["old_fid"], "fid")
    for c in CORNERS:
        f = f.join(v.select(F.col("old_vid").alias(c), F.col("vid").alias(f"new_{c}")), c)
    return v, f.select("fid", *[F.col(f"new_{c}").alias(c) for c in CORNERS], "old_fid")


def crop_points(points: DataFrame, box: Box) -> DataFrame:
    return points.where(G.in_box(Vec.of(), *G.box_of(box["center"], box["edge"])))
