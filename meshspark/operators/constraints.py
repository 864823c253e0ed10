"""Constraint tables: targets, fixed vertices, groups, sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import tiles
from ..functions.vec import Vec
from ..schema import require
from . import spatial
from .topology import corners, group_ids, shuffled


class TargetPoints:
    """Point sets that add up."""

    columns: tuple[str, ...] = ("x", "y", "z")

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def add(self, rows: DataFrame) -> bool:
        require(rows, *self.columns)
        if rows.isEmpty():
            return False
        self.parts.append(rows.select(*self.columns))
        return True

    def is_valid(self) -> bool:
        return bool(self.parts)

    def get(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.parts) if self.parts else None


class TargetVertices(TargetPoints):
    """Vertices and where they should go."""

    columns = ("vid", "x", "y", "z")


class FixedVertices(TargetPoints):
    """Vertices held at a position; the last entry of a vertex wins."""

    columns = ("vid", "x", "y", "z")

    def get(self) -> DataFrame | None:
        if not self.parts:
            return None
        every = reduce(DataFrame.unionByName, [p.withColumn("seq", F.lit(i)) for i, p in enumerate(self.parts)])
        return every.groupBy("vid").agg(F.max_by(F.struct("x", "y", "z"), "seq").alias("p")).select("vid", "p.*")


class VertexGroups:
    """Groups of vertices that move together; adding to a group again joins the ids."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def add(self, group_id: int, vids: DataFrame) -> None:
        self.parts.append(vids.select("vid", F.lit(group_id).cast("long").alias("group_id"), F.lit(len(self.parts)).alias("seq")))

    def is_valid(self) -> bool:
        return bool(self.parts)

    def of(self, vertices: DataFrame) -> DataFrame:
        """``vid, group_id`` of every vertex."""
        if not self.parts:
            return vertices.select("vid", F.col("vid").alias("group_id"))
        return group_ids(vertices, reduce(DataFrame.unionByName, self.parts))


def identity_groups(groups: DataFrame) -> DataFrame:
    """``g, r, t``: identity rotation and no translation for each group id."""
    return groups.select("g", F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("r"), F.array(*[F.lit(0.0)] * 3).alias("t"))


def deform(vertices: DataFrame, vertex_groups: DataFrame, groups: DataFrame) -> DataFrame:
    """``R x + t`` of each vertex by its group (``vid, g``)."""
    both = vertices.join(shuffled(vertex_groups), "vid").join(groups, "g")
    r, t = (lambda i: F.get("r", F.lit(i))), (lambda i: F.get("t", F.lit(i)))
    return both.select("vid", *[(r(3 * i) * F.col("x") + r(3 * i + 1) * F.col("y") + r(3 * i + 2) * F.col("z") + t(i)).alias(c) for i, c in enumerate("xyz")])


def snap_landmarks(vertices: DataFrame, vertex_groups: DataFrame, groups: DataFrame, fixed: DataFrame) -> DataFrame:
    """Groups moved so that their fixed vertex (the largest id of several) lands on its position."""
    now = deform(vertices, vertex_groups, groups)
    off = now.select("vid", *Vec.of().named("p")).join(fixed.select("vid", *Vec.of().named("q")), "vid").join(shuffled(vertex_groups), "vid")
    d = Vec.of("q") - Vec.of("p")
    step = off.select("g", "vid", F.array(d.x, d.y, d.z).alias("d")).groupBy("g").agg(F.max_by("d", "vid").alias("d"))
    return groups.join(step, "g", "left").select("g", "r", F.when(F.col("d").isNull(), F.col("t")).otherwise(F.zip_with("t", "d", lambda a, b: a + b)).alias("t"))


def sheet_pairs(vertices: DataFrame, faces: DataFrame, gap: float, *, opposite: bool = False, cosine: float = -0.3, max_pairs: int | None = None) -> DataFrame:
    """``fa, fb, ux, uy, uz``: faces within ``gap`` (opposite normals only, if asked) and the unit axis between their centroids."""
    if max_pairs is None:
        boxes = spatial.face_boxes(vertices, faces, gap)
        if opposite:
            boxes = boxes.withColumns(G.face_normal(*corners()).columns("n"))
        return spatial.visited(boxes, tiles.Axes(cosine if opposite else None))
    found = spatial.collision_candidates(vertices, faces, gap, max_pairs=max_pairs)
    both = spatial.gathered(found, vertices, faces)
    a, b = corners("a_"), corners("b_")
    if opposite:
        both = both.where(G.face_normal(*a).dot(G.face_normal(*b)) < cosine)
    return both.select(F.col("a_fid").alias("fa"), F.col("b_fid").alias("fb"), *(G.centroid(*b) - G.centroid(*a)).unit().named("u"))


def sheet_constraints(vertices: DataFrame, faces: DataFrame, most: float, margin: float) -> DataFrame:
    """Wall pairs with axis and margin: nine tenths of the clean separation, ``margin`` at most, 0 at least."""
    both = spatial.gathered(spatial.wall_pairs(vertices, faces, most), vertices, faces)
    across = G.centroid(*corners("b_")) - G.centroid(*corners("a_"))
    return both.select(F.col("a_fid").alias("fa"), F.col("b_fid").alias("fb"), *across.unit().named("u"), F.greatest(F.least(F.lit(margin), 0.9 * across.norm()), F.lit(0.0)).alias("margin"))


def capped_append(old: DataFrame, new: DataFrame, cap: int, seq: str = "seq") -> DataFrame:
    """Both tables' rows, the latest ``cap`` by ``seq``."""
    return old.unionByName(new).orderBy(F.desc(seq)).limit(cap)


def farthest_target(vertices: DataFrame, fixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: the largest distance from a fixed position to its nearest target point."""
    d = spatial.nearest(fixed.select(F.col("vid").alias("pid"), "x", "y", "z"), targets)
    return d.agg(F.sqrt(F.max("d2")).alias("farthest"))


def camera_poses(points: DataFrame, fov: float = 60.0) -> DataFrame:
    """Six views of the bounding box: ``view, distance`` and eye position."""
    box = points.agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"])
    size = {c: F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"}
    mid = {c: (F.col(f"hi{c}") + F.col(f"lo{c}")) / 2.0 for c in "xyz"}
    diagonal = F.sqrt(sum((s * s for s in size.values()), F.lit(0.0)))
    rows = []
    for axis, (u, v) in {"x": "yz", "y": "xz", "z": "xy"}.items():
        far = F.greatest(0.5 * F.greatest(size[u], size[v]) * 1.5 / F.tan(F.radians(F.lit(fov / 2))), 0.8 * diagonal)
        for sign in (1.0, -1.0):
            rows.append(F.struct(F.lit(f"{'+' if sign > 0 else '-'}{axis}").alias("view"), far.alias("distance"), *[(mid[c] + (far * sign if c == axis else F.lit(0.0))).alias(f"e{c}") for c in "xyz"]))
    return box.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def stiffness_colors(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vid, value``: sums of edge ``stiffness`` at each vertex, scaled to 0..1."""
    sums = edges.select(F.explode(F.array("e0", "e1")).alias("vid"), "stiffness").groupBy("vid").agg(F.sum("stiffness").alias("s"))
    ends = sums.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return vertices.select("vid").join(sums.crossJoin(ends), "vid", "left").select("vid", F.coalesce((F.col("s") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0)).alias("value"))


