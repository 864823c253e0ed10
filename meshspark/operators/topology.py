"""Connectivity of triangle meshes as joins and aggregations over explicit ids."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vec import Vec

CORNERS = ("i0", "i1", "i2")
#: Places that a row which many others join is sent to.
SALTS = 16


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; the folder of ``spark.checkpoint.dir``, or a temporary one where it is unset."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="meshspark-"))
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: tables of a row a vertex or face, which loops join every round, would each time be
    gathered at the driver while they are small enough, and what it gets grows with the mesh."""
    return df.hint("merge")


def triangles(vertices: DataFrame, faces: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Faces with the coordinates of their corners: ``ax..cz``, and ``a_<c>, b_<c>, c_<c>`` of extra columns."""
    out = faces.select("fid", *CORNERS)
    for k, corner in zip("abc", CORNERS, strict=True):
        own = vertices.select(F.col("vid").alias(corner), *[F.col(c).alias(f"{k}{c}") for c in "xyz"], *[F.col(c).alias(f"{k}_{c}") for c in extra])
        out = out.join(own, corner)
    return out.select("fid", *CORNERS, *[f"{k}{c}" for k in "abc" for c in "xyz"], *[f"{k}_{c}" for k in "abc" for c in extra])


def corners(prefix: str = "") -> list[Vec]:
    return [Vec.of(f"{prefix}{k}") for k in "abc"]


def vertex_faces(faces: DataFrame) -> DataFrame:
    """``vid, fid``, one row for each corner's face."""
    return faces.select(F.explode(F.array_distinct(F.array(*CORNERS))).alias("vid"), "fid")


def vertex_face_lists(faces: DataFrame) -> DataFrame:
    return vertex_faces(faces).groupBy("vid").agg(F.sort_array(F.collect_list("fid")).alias("fids"))


def face_edges(faces: DataFrame) -> DataFrame:
    """``fid, k, e0, e1``: the edges (0,1), (1,2), (2,0) of every face with e0 < e1."""
    edge = lambda k, a, b: F.struct(F.lit(k).alias("k"), F.least(a, b).alias("e0"), F.greatest(a, b).alias("e1"))
    return faces.select("fid", F.explode(F.array(edge(0, "i0", "i1"), edge(1, "i1", "i2"), edge(2, "i2", "i0"))).alias("e")).select("fid", "e.*")


def unique_edges(faces: DataFrame) -> DataFrame:
    return face_edges(faces).select("e0", "e1").distinct()


def dense_rank_ids(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Adds gapless ids in the given order. Rows are ranged first, so the order is never sorted in one task."""
    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    ranged = saved(ranged)
    sums = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_nth", nth).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_nth") - 1 + start).cast("long")).drop("_part", "_nth", "_before")


def edge_ids(faces: DataFrame) -> DataFrame:
    """``eid, e0, e1`` in lexicographic order."""
    return dense_rank_ids(unique_edges(faces), ["e0", "e1"], "eid").select("eid", "e0", "e1")


def face_edge_index(faces: DataFrame) -> DataFrame:
    """``fid, k, eid``."""
    return face_edges(faces).join(edge_ids(faces), ["e0", "e1"]).select("fid", "k", "eid")


def face_adjacency(faces: DataFrame) -> DataFrame:
    """``fa, fb``: faces that follow each other, by id, among those of an edge."""
    follow = F.lead("fid").over(Window.partitionBy("e0", "e1").orderBy("fid"))
    return face_edges(faces).select("fid", follow.alias("fb")).where("fb IS NOT NULL").select(F.col("fid").alias("fa"), "fb")


def boundary_edges(faces: DataFrame) -> DataFrame:
    return face_edges(faces).groupBy("e0", "e1").agg(F.count("*").alias("n")).where("n = 1").select("e0", "e1")


def boundary_vertices(faces: DataFrame) -> DataFrame:
    return boundary_edges(faces).select(F.explode(F.array("e0", "e1")).alias("vid")).distinct()


def boundary_loops(faces: DataFrame) -> DataFrame:
    """``vid, loop``: boundary vertices by the least vertex of their loop."""
    e = boundary_edges(faces)
    return min_labels(boundary_vertices(faces).toDF("node"), e.toDF("u", "v")).toDF("vid", "loop")


def euler_number(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: counts of vertices, edges, faces, and V - E + F."""
    n = lambda df, c: df.agg(F.count("*").alias(c))  # noqa: E731  one row each
    one = n(vertices, "n_vertices").crossJoin(n(unique_edges(faces), "n_edges")).crossJoin(n(faces, "n_faces"))
    return one.withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))


def shares_vertex(a: str = "a_", b: str = "b_") -> Column:
    out = F.lit(False)
    for p in CORNERS:
        for q in CORNERS:
            out = out | (F.col(f"{a}{p}") == F.col(f"{b}{q}"))
    return out


def pairs_sharing_vertex(pairs: DataFrame, faces: DataFrame) -> DataFrame:
    """``fa, fb, shared``."""
    side = lambda n, p: faces.select(F.col("fid").alias(n), *[F.col(c).alias(f"{p}{c}") for c in CORNERS])
    return pairs.join(side("fa", "a_"), "fa").join(side("fb", "b_"), "fb").select("fa", "fb", shares_vertex().alias("shared"))


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))


def dilate(mask: DataFrame, links: DataFrame, rings: int = 1) -> DataFrame:
    """``id`` of the mask and all within ``rings`` links. ``links`` has two id columns."""
    near = both_ways(links, *links.columns)
    out = mask.toDF("id").distinct()
    for _ in range(rings):
        out = out.union(near.join(out, near["u"] == out["id"]).select(F.col("v").alias("id"))).distinct()
    return out


def min_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, label``: connected components, named by their least node. Labels jump to the label of
    their label each round, so rounds grow with the logarithm of the diameter; each is checkpointed."""
    near = saved(both_ways(edges, "u", "v").distinct())
    now = saved(nodes.select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        least = near.join(now, near["v"] == now["node"]).groupBy("u").agg(F.min("label").alias("l"))
        hooked = now.join(least, now["node"] == least["u"], "left").select("node", F.least("label", F.coalesce("l", "label")).alias("label"), F.col("label").alias("old"))
        hooked = saved(hooked)
        # a label may stand for most nodes: only labels that move on are joined, and each is sent to SALTS places
        used = hooked.select("label").distinct()
        up = hooked.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("up")).join(used, "label", "left_semi")
        up = up.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = hooked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        after = saved(salted.join(up, ["label", "salt"], "left").select("node", F.coalesce("up", "label").alias("label"), "old"))
        changed = not after.where("label <> old").isEmpty()
        now = after.select("node", "label")
        if not changed:
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def face_components(mask: DataFrame, adjacency: DataFrame) -> DataFrame:
    """``fid, label, size`` of the masked faces, joined through adjacent masked faces."""
    nodes = mask.toDF("node").distinct()
    inner = adjacency.toDF("u", "v").join(nodes.toDF("u"), "u", "left_semi").join(nodes.toDF("v"), "v", "left_semi")
    named = min_labels(nodes, inner.select("u", "v"))
    size = named.groupBy("label").agg(F.count("*").alias("size"))
    return named.join(size, "label").select(F.col("node").alias("fid"), "label", "size")


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``vid, nx, ny, nz``: area-weighted; vertices without faces have zeros."""
    a, b, c = corners()
    cross = triangles(vertices, faces).select(*CORNERS, *(b - a).cross(c - a).named("n"))
    sums = cross.select(F.explode(F.array(*CORNERS)).alias("vid"), "nx", "ny", "nz").groupBy("vid").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"])
    n = Vec.of("n")
    out = vertices.select("vid").join(sums, "vid", "left").select("vid", *[F.coalesce(f"n{k}", F.lit(0.0)).alias(f"n{k}") for k in "xyz"])
    return out.select("vid", *(n / (n.norm() + 1e-12)).named("n"))


def vertex_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    count = both_ways(edges, "e0", "e1").groupBy(F.col("u").alias("vid")).agg(F.count("*").alias("degree"))
    return vertices.select("vid").join(count, "vid", "left").select("vid", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbour_sums(values: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """``vid`` and the sums of columns over its neighbours."""
    near = both_ways(edges, "e0", "e1")
    return near.join(values, near["v"] == values["vid"]).groupBy(F.col("u").alias("vid")).agg(*[F.sum(c).alias(c) for c in columns])


def face_means(values: DataFrame, faces: DataFrame, column: str) -> DataFrame:
    """``fid`` and the mean of a vertex column over its corners."""
    each = faces.select("fid", F.posexplode(F.array(*CORNERS)).alias("k", "vid")).join(values.select("vid", column), "vid")
    return each.groupBy("fid").agg((F.sum(column) / 3.0).alias(column))


def one_face(faces: DataFrame) -> DataFrame:
    """``vid, fid``: one incident face a vertex, of its highest corner place, the largest id of those."""
    each = faces.select("fid", F.posexplode(F.array(*CORNERS)).alias("k", "vid"))
    return each.groupBy("vid").agg(F.max_by("fid", F.struct("k", "fid")).alias("fid"))


def directed_laplacian(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``vid, degree, lx, ly, lz`` with five directed entries a face (2 to 1 is not one of them);
    repeated entries add up."""
    pairs = [("i0", "i1"), ("i1", "i2"), ("i2", "i0"), ("i0", "i2"), ("i1", "i0")]
    entries = faces.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("e")).select("e.*")
    near = entries.join(shuffled(vertices.select(F.col("vid").alias("v"), "x", "y", "z")), "v").groupBy("u").agg(F.count("*").alias("degree"), *[F.sum(c).alias(f"s{c}") for c in "xyz"])
    out = vertices.join(shuffled(near), vertices["vid"] == near["u"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.select("vid", "degree", *[(F.col("degree") * F.col(c) - F.coalesce(f"s{c}", F.lit(0.0))).alias(f"l{c}") for c in "xyz"])


def within_hops(pairs: DataFrame, adjacency: DataFrame, hops: int) -> DataFrame:
    """Pairs more than ``hops`` links apart on the face graph; all of them for ``hops <= 1``."""
    if hops <= 1:
        return pairs
    near = both_ways(adjacency, "fa", "fb").distinct()
    reach = pairs.select("fa", F.col("fa").alias("at")).distinct()
    for _ in range(hops):
        reach = reach.union(reach.join(near, reach["at"] == near["u"]).select("fa", F.col("v").alias("at"))).distinct()
    return pairs.join(reach.withColumnRenamed("at", "fb"), ["fa", "fb"], "left_anti")


def group_ids(vertices: DataFrame, groups: DataFrame) -> DataFrame:
    """``vid, group_id``: listed vertices get their group (the last entry by ``seq`` wins), every
    other one a group of its own from ``max(group) + 1 + vid`` on."""
    last = groups.groupBy("vid").agg(F.max_by("group_id", "seq").alias("g"))
    top = groups.agg(F.coalesce(F.max("group_id"), F.lit(-1)).alias("top"))
    return vertices.select("vid").join(last, "vid", "left").crossJoin(F.broadcast(top)).select("vid", F.coalesce("g", F.col("top") + 1 + F.col("vid")).cast("long").alias("group_id"))


def group_edges(vertex_groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends lie in different groups, with both groups' dense numbers ``g0, g1``."""
    dense = dense_rank_ids(vertex_groups.select("group_id").distinct(), ["group_id"], "g")
    of = vertex_groups.join(dense, "group_id").select("vid", "g")
    out = edges.join(of.toDF("e0", "g0"), "e0").join(of.toDF("e1", "g1"), "e1")
    return out.where("g0 <> g1").select("e0", "e1", "g0", "g1")


def face_geometry(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``fid``, doubled area, unit normal, centroid, bounding radius and box."""
    a, b, c = corners()
    lo, hi = G.box(a, b, c)
    return triangles(vertices, faces).select("fid", G.doubled_area(a, b, c).alias("area2"), *G.face_normal(a, b, c).named("n"), *G.centroid(a, b, c).named("m"), G.bounding_radius(a, b, c).alias("radius"), *lo.named("lo"), *hi.named("hi"))
