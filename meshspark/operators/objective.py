"""Loss terms as one-row aggregates, and closed-form gradients where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vec import Vec
from . import spatial
from .topology import both_ways, corners, directed_laplacian, shuffled, triangles

def masked_sum(pairs: DataFrame, most: float = 0.04) -> DataFrame:
    """Sum of squared distances (columns p*, q*) where they are under ``most``."""
    d2 = (Vec.of("p") - Vec.of("q")).norm2()
    return pairs.agg(F.coalesce(F.sum(F.when(d2 < most * most, d2)), F.lit(0.0)).alias("loss"))

def masked_mean(d2: DataFrame, most: float | None = None, value: Column | None = None) -> DataFrame:
    """Mean of ``value`` (the squared distance ``d2`` by default) where ``d2`` is under ``most``
    squared; of all rows if none is."""
    v = F.col("d2") if value is None else value
    return d2.agg((F.avg(v) if most is None else F.coalesce(F.avg(F.when(F.col("d2") < most * most, v)), F.avg(v))).alias("loss"))

def symmetric_chamfer(source: DataFrame, target: DataFrame, most: float | None = None) -> DataFrame:
    fit = masked_mean(spatial.nearest(source, target), most).toDF("fit")
    return fit.crossJoin(masked_mean(spatial.nearest(target, source), most).toDF("coverage"))  # one row each

def matched(source: DataFrame, target: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Source points ``p*`` beside their nearest target ``q*`` with ``d2`` and more target columns."""
    near = spatial.nearest(source, target)
    s = source.select(F.col("pid").alias("qid"), *Vec.of().named("p"))
    t = target.select(F.col("pid").alias("rid"), *Vec.of().named("q"), *columns)
    return near.join(shuffled(s), "qid").join(shuffled(t), "rid")

def point_to_plane(source: DataFrame, target: DataFrame, most: float | None = None) -> DataFrame:
    """Mean squared distance to the target's tangent planes (normals ``nx..``)."""
    m = matched(source, target, ("nx", "ny", "nz"))
    along = (Vec.of("p") - Vec.of("q")).dot(Vec.of("n"))
    return masked_mean(m, most, along * along)

def _edge_ends(values: DataFrame, edges: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    side = lambda e, p: values.select(F.col("vid").alias(e), *[F.col(c).alias(f"{p}{c}") for c in columns])
    return edges.join(side("e0", "u_"), "e0").join(side("e1", "v_"), "e1")

def edge_laplacian(displacement: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean over edges of the squared difference of displacements (x, y, z)."""
    both = _edge_ends(displacement, edges, ("x", "y", "z"))
    return both.agg(F.avg((Vec.of("u_") - Vec.of("v_")).norm2()).alias("loss"))

def edge_laplacian_gradient(displacement: DataFrame, edges: DataFrame) -> DataFrame:
    """``vid, gx, gy, gz`` of :func:`edge_laplacian`: 2/E times the sum of differences to neighbours."""
    n = edges.count()
    near = both_ways(edges, "e0", "e1")
    own = displacement.select(F.col("vid").alias("u"), *Vec.of().named("p"))
    other = displacement.select(F.col("vid").alias("v"), *Vec.of().named("q"))
    d = Vec.of("p") - Vec.of("q")
    sums = near.join(own, "u").join(other, "v").select("u", *d.named("d")).groupBy(F.col("u").alias("vid")).agg(*[(F.sum(f"d{c}") * (2.0 / max(n, 1))).alias(f"g{c}") for c in "xyz"])
    return displacement.select("vid").join(sums, "vid", "left").select("vid", *[F.coalesce(f"g{c}", F.lit(0.0)).alias(f"g{c}") for c in "xyz"])

def chamfer_gradient(source: DataFrame, target: DataFrame, weight: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Gradients of the sum of squared nearest distances for both sides: 2 (x - nn), and its negative summed at the match."""
    m = matched(source, target)
    g = (Vec.of("p") - Vec.of("q")) * (2.0 * weight)
    own = m.select(F.col("qid").alias("pid"), *g.named("g"))
    other = m.select("rid", *g.named("g")).groupBy(F.col("rid").alias("pid")).agg(*[(-F.sum(f"g{c}")).alias(f"g{c}") for c in "xyz"])
    return own, other

def laplacian(vertices: DataFrame, faces: DataFrame, source: DataFrame) -> DataFrame:
    """Mean squared difference of the directed Laplacian to ``source`` (vid, lx, ly, lz)."""
    now = directed_laplacian(vertices, faces).join(source.select("vid", *Vec.of("l").named("s")), "vid")
    return now.agg(F.avg((Vec.of("l") - Vec.of("s")).norm2() / 3.0).alias("loss"))

def stiffness(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sums of squared differences of rotations ``r`` (array of 9) and translations ``t``
    (array of 3) over edges ``g0, g1`` between groups."""
    side = lambda g, p: groups.select(F.col("g").alias(g), F.col("r").alias(f"{p}r"), F.col("t").alias(f"{p}t"))
    both = edges.join(side("g0", "u_"), "g0").join(side("g1", "v_"), "g1")
    diff = lambda n: F.aggregate(F.zip_with(f"u_{n}", f"v_{n}", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return both.agg(F.coalesce(F.sum(diff("r")), F.lit(0.0)).alias("rotation"), F.coalesce(F.sum(diff("t")), F.lit(0.0)).alias("translation"))

def target_l1(vertices: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean absolute coordinate difference of vertices to their targets (vid, x, y, z)."""
    both = vertices.select("vid", *Vec.of().named("p")).join(targets.select("vid", *Vec.of().named("q")), "vid")
    d = Vec.of("p") - Vec.of("q")
    return both.agg(F.avg((F.abs(d.x) + F.abs(d.y) + F.abs(d.z)) / 3.0).alias("loss"))

def _barrier(rows: DataFrame, gap: Column, margin: Column) -> DataFrame:
    short = F.greatest(margin - gap, F.lit(0.0))
    return rows.agg((F.coalesce(F.sum(short * short), F.lit(0.0)) / F.greatest(F.coalesce(F.sum((short > 0).cast("long")), F.lit(0)), F.lit(1))).alias("loss"))

def collision_barrier(pairs: DataFrame, vertices: DataFrame, faces: DataFrame, margin: float) -> DataFrame:
    """Squared shortfall of triangle distances under ``margin``, by the number of short pairs."""
    both = spatial.pair_distances(spatial.gathered(pairs, vertices, faces))
    return _barrier(both, F.sqrt(F.col("d2") + 1e-18), F.lit(margin))

def sheet_barrier(pairs: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Squared shortfall of the signed separation along ``ux, uy, uz`` under ``margin`` of each pair."""
    both = spatial.gathered(pairs.select("fa", "fb"), vertices, faces).join(pairs.select(F.col("fa").alias("a_fid"), F.col("fb").alias("b_fid"), "ux", "uy", "uz", "margin"), ["a_fid", "b_fid"])
    gap = (G.centroid(*corners("b_")) - G.centroid(*corners("a_"))).dot(Vec.of("u"))
    return _barrier(both, gap, F.col("margin"))

def inversion_barrier(vertices: DataFrame, faces: DataFrame, reference: DataFrame, flip: float = 0.0, part: float = 0.1) -> DataFrame:
    """One row: mean squared shortfall of normals against the reference (fid, nx.., area2) and of areas."""
    a, b, c = corners()
    now = triangles(vertices, faces).select("fid", *G.face_normal(a, b, c).named("m"), G.doubled_area(a, b, c).alias("now2")).join(reference, "fid")
    turn = F.greatest(flip - Vec.of("m").dot(Vec.of("n")), F.lit(0.0))
    small = F.greatest(part * F.col("area2") - F.col("now2"), F.lit(0.0)) / (F.col("area2") + 1e-20)
    return now.agg(F.avg(turn * turn).alias("flip_loss"), F.avg(small * small).alias("area_loss"))

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("CORNERS",)]
