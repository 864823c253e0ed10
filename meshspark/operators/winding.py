"""Generalized winding numbers of meshes, exact, without visiting all faces.

Faces are sorted into the cells of an octree by their centroids. The solid angle of the faces of a cell, seen from
outside their box, is that of any other surface with the same boundary within the box: here a fan from the
box's middle to the edges that faces of the cell leave open. A cell of n faces has about the root of n such edges, and
none if its faces are closed. So a query point opens only cells whose box holds it, and takes the others of
their parent by their fans; the faces of the last cells that hold it are summed one by one.

Everything is equi-joins on cell numbers, a level at a time; the boxes and fans of a level are computed from those of the
next finer one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vec import Vec
from .topology import CORNERS, SALTS, corners, saved, triangles

#: Rows of a level's boxes or fans up to which they are broadcast.
SMALL = 20_000


def cells(vertices: DataFrame, faces: DataFrame, *, leaf: int = 32) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """The faces with their finest ``cell``, and for each level from the root on ``(boxes, fans)``: ``cell, parent, lo.., hi..``
    and ``cell, n, o.., p.., q..`` (a triangle of the fan, counted ``n`` times). ``leaf``: faces of a finest cell, about."""
    tri = saved(triangles(vertices, faces))
    mid = G.centroid(*corners())
    lo, hi = G.box(*corners())
    ends = tri.agg(F.count("*"), *[f(getattr(mid, c)) for c in "xyz" for f in (F.min, F.max)], *[F.avg(getattr(hi, c) - getattr(lo, c)) for c in "xyz"]).first()
    n, low = ends[0], [ends[1 + 2 * i] or 0.0 for i in range(3)]
    size = max([(ends[2 + 2 * i] or 0.0) - (ends[1 + 2 * i] or 0.0) for i in range(3)] + [1e-300])
    depth = min(max(0, math.ceil(math.log(max(n, 1) / leaf, 4))), 20)  # a surface meets about four of a cell's eight parts
    parts = 1 << depth
    # a cell's number is its place on each axis, of 21 bits each
    at = [F.least(F.greatest(F.floor((getattr(mid, c) - low[i]) / size * parts), F.lit(0)), F.lit(parts - 1)) for i, c in enumerate("xyz")]
    # no cell is shorter than twice the faces on an axis: it would not part tall ones, but mix neighbours' and leave their edges open
    tall = [next((k for k in range(depth) if size / parts * 2**k >= 2 * (ends[7 + i] or 0.0)), depth) for i in range(3)]
    at = [F.shiftright(a.cast("long"), k) for a, k in zip(at, tall, strict=True)]
    tri = saved(tri.withColumn("cell", F.shiftleft(at[0].cast("long"), 42).bitwiseOR(F.shiftleft(at[1].cast("long"), 21)).bitwiseOR(at[2].cast("long"))))
    boxes = saved(tri.select("cell", *lo.named("lo"), *hi.named("hi")).groupBy("cell").agg(*[F.min(f"lo{c}").alias(f"lo{c}") for c in "xyz"], *[F.max(f"hi{c}").alias(f"hi{c}") for c in "xyz"]))
    side = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.when(F.col(a) < F.col(b), 1).otherwise(-1).alias("n"))
    edges = tri.select("cell", F.explode(F.array(side("i0", "i1"), side("i1", "i2"), side("i2", "i0"))).alias("e")).select("cell", "e.*").where("u <> v")
    edges = saved(edges.groupBy("cell", "u", "v").agg(F.sum("n").alias("n")).where("n <> 0"))
    parent = F.shiftright(F.col("cell"), 1).bitwiseAND(F.lit(0x0FFFFF | 0x0FFFFF << 21 | 0x0FFFFF << 42))
    point = lambda k, p: vertices.select(F.col("vid").alias(k), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    found = []
    for level in range(depth, -1, -1):
        middle = boxes.select("cell", *[((F.col(f"lo{c}") + F.col(f"hi{c}")) / 2).alias(f"o{c}") for c in "xyz"])
        fans = edges.join(middle, "cell").join(point("u", "p"), "u").join(point("v", "q"), "v").drop("u", "v")
        found.append((boxes.withColumn("parent", parent), fans))
        if level:
            boxes = saved(boxes.groupBy(parent.alias("cell")).agg(*[F.min(f"lo{c}").alias(f"lo{c}") for c in "xyz"], *[F.max(f"hi{c}").alias(f"hi{c}") for c in "xyz"]))
            edges = saved(edges.groupBy(parent.alias("cell"), "u", "v").agg(F.sum("n").alias("n")).where("n <> 0"))
    return tri, found[::-1]


def _met(asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``asked`` beside ``rows`` of the same ``key``. A few rows are broadcast; of many, each is sent to several
    places, among which the queries of a cell are dealt."""
    if rows.count() <= SMALL:
        return asked.join(F.broadcast(rows), key)
    salted = rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return asked.withColumn("_salt", F.pmod(F.xxhash64("qid"), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def winding_numbers(queries: DataFrame, vertices: DataFrame, faces: DataFrame, *, query_id: str = "vid", leaf: int = 32) -> DataFrame:
    """``qid, winding`` of every query point (once each): the faces' signed solid angles over 4 pi. 1 inside a closed
    outward mesh, 0 outside; between on open ones. A mesh without faces gives 0 everywhere."""
    tri, levels = cells(vertices, faces, leaf=leaf)
    q = saved(queries.select(F.col(query_id).alias("qid"), *[F.col(c).cast("double").alias(f"s{c}") for c in "xyz"]))
    p = Vec.of("s")
    inside = F.lit(True)
    for c in "xyz":
        # a box holds its surface, and a little more
        slack = (F.col(f"hi{c}") - F.col(f"lo{c}")) * 1e-9 + 1e-12
        inside = inside & (F.col(f"s{c}") >= F.col(f"lo{c}") - slack) & (F.col(f"s{c}") <= F.col(f"hi{c}") + slack)
    opened, sums = q.withColumn("parent", F.lit(0).cast("long")), []
    for boxes, fans in levels:
        met = _met(opened, boxes, "parent").withColumn("inside", inside).select("qid", "sx", "sy", "sz", "cell", "inside")
        met = saved(met)
        angle = F.col("n") * G.solid_angle(p, Vec.of("o"), Vec.of("p"), Vec.of("q"))
        sums.append(_met(met.where("NOT inside"), saved(fans), "cell").select("qid", angle.alias("angle")).groupBy("qid").agg(F.sum("angle").alias("angle")))
        opened = met.where("inside").select("qid", "sx", "sy", "sz", F.col("cell").alias("parent"))
    last = opened.withColumnRenamed("parent", "cell")
    sums.append(_met(last, tri.select("cell", *[f"{k}{c}" for k in "abc" for c in "xyz"]), "cell").select("qid", G.solid_angle(p, *corners()).alias("angle")).groupBy("qid").agg(F.sum("angle").alias("angle")))
    whole = sums[0]
    for more in sums[1:]:
        whole = whole.unionByName(more)
    whole = whole.groupBy("qid").agg((F.sum("angle") / (4 * math.pi)).alias("w"))
    return q.select("qid").join(whole, "qid", "left").select("qid", F.coalesce("w", F.lit(0.0)).alias("winding"))
