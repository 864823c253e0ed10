"""Conforming subdivision of marked faces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topology import CORNERS, dense_rank_ids, face_edges, saved


def _children(code: int) -> list[tuple[int, int, int]]:
    """Corner numbers of the children of a face whose split edges are the bits of ``code``; 0 to 2
    are its corners, 3 to 5 the midpoints of edges (0,1), (1,2), (2,0). Winding is kept."""
    split = [k for k in range(3) if code >> k & 1]
    if not split:
        return [(0, 1, 2)]
    if len(split) == 3:
        return [(0, 3, 5), (3, 1, 4), (5, 4, 2), (3, 4, 5)]
    if len(split) == 1:
        a = split[0]
        b, c, m = (a + 1) % 3, (a + 2) % 3, 3 + a
        return [(a, m, c), (m, b, c)]
    whole = ({0, 1, 2} - set(split)).pop()  # the edge that stays; the corner across it is cut off
    a, b, tip = whole, (whole + 1) % 3, (whole + 2) % 3
    on_b, on_a = 3 + b, 3 + tip  # midpoints of edges (b, tip) and (tip, a)
    return [(on_b, tip, on_a), (b, on_b, on_a), (b, on_a, a)]


def subdivide(vertices: DataFrame, faces: DataFrame, marked: DataFrame, attributes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """New vertices and faces (with ``parent``): all edges of marked faces (fid) are split.

    Midpoints get ids from ``max(vid) + 1`` on in the order of their edges, and means of the ends'
    coordinates and attributes. Faces that share a split edge are cut to fit.
    """
    chosen = faces.join(marked.toDF("fid").distinct(), "fid", "left_semi")
    split = face_edges(chosen).select("e0", "e1").distinct()
    top = vertices.agg(F.coalesce(F.max("vid"), F.lit(-1))).first()[0]
    middle = saved(dense_rank_ids(split, ["e0", "e1"], "mid", top + 1))
    kept = ("x", "y", "z", *attributes)
    end = lambda e: vertices.select(F.col("vid").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in kept])
    added = middle.join(end("e0"), "e0").join(end("e1"), "e1").select(F.col("mid").alias("vid"), *[((F.col(f"e0_{c}") + F.col(f"e1_{c}")) / 2.0).alias(c) for c in kept])
    new_vertices = vertices.select("vid", *kept).unionByName(added)
    on_face = face_edges(faces).join(middle, ["e0", "e1"]).groupBy("fid").agg(*[F.max(F.when(F.col("k") == k, F.col("mid"))).alias(f"m{k}") for k in range(3)])
    coded = faces.select("fid", *CORNERS).join(on_face, "fid", "left")
    code = sum((F.when(F.col(f"m{k}").isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(3)), F.lit(0))
    point = [F.col(c) for c in (*CORNERS, "m0", "m1", "m2")]
    cases = None
    for n in range(8):
        made = F.array(*[F.struct(F.lit(i).alias("nth"), *[point[p].alias(c) for p, c in zip(child, CORNERS, strict=True)]) for i, child in enumerate(_children(n))])
        cases = F.when(F.col("code") == n, made) if cases is None else cases.when(F.col("code") == n, made)
    out = coded.withColumn("code", code).withColumn("child", F.explode(cases)).select(F.col("fid").alias("parent"), "child.*")
    return new_vertices, dense_rank_ids(out, ["parent", "nth"], "fid").select("fid", *CORNERS, "parent")
