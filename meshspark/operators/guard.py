"""Moves that do not cross: safe steps, advancing fronts, relaxation and pin gates.

Driver loops here run one query a round over checkpointed tables and end on counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vec import Vec
from . import metrics, spatial
from .topology import CORNERS, both_ways, corners, dilate, saved, vertex_faces


def _moves(ref: DataFrame, proposed: DataFrame) -> DataFrame:
    return metrics.trajectories(ref, proposed)


def at_fraction(ref: DataFrame, proposed: DataFrame, alpha: DataFrame) -> DataFrame:
    """Vertices at ``ref + alpha (proposed - ref)``; 1 where alpha has no row."""
    both = ref.select("vid", *Vec.of().named("p")).join(proposed.select("vid", *Vec.of().named("q")), "vid").join(alpha.select("vid", "alpha"), "vid", "left")
    a = F.coalesce("alpha", F.lit(1.0))
    exact = F.coalesce(F.col("alpha"), F.lit(1.0)) == 1.0
    p, q = Vec.of("p"), Vec.of("q")
    out = p + (q - p) * a
    return both.select("vid", *[F.when(exact, getattr(q, c)).otherwise(getattr(out, c)).alias(c) for c in "xyz"])


def earliest_safe(ref: DataFrame, proposed: DataFrame, vertices: DataFrame, faces: DataFrame, *, clearance: float = 1e-3, distance: bool = False, t_lo: float = 0.0, scope: DataFrame | None = None) -> DataFrame:
    """``vid, alpha, t, fid``: the fraction of each move up to its first crossing, less a clearance
    (in parameter, or as a ``distance``; a move without length gets 0); 1 where nothing is crossed."""
    segs = _moves(ref, proposed)
    first = spatial.earliest_hits(segs, spatial.segment_hits(segs, vertices, faces, t_lo=t_lo, scope=scope))
    length = segs.select("sid", (Vec.of("q") - Vec.of("p")).norm().alias("len"))
    back = F.when(F.col("len") > 1e-20, clearance / F.nullif(F.col("len"), F.lit(0.0))) if distance else F.lit(clearance)
    alpha = F.when(F.col("t").isNull(), F.lit(1.0)).otherwise(F.coalesce(F.greatest(F.least(F.col("t") - back, F.lit(1.0)), F.lit(0.0)), F.lit(0.0)))
    return first.join(length, "sid").select(F.col("sid").alias("vid"), alpha.alias("alpha"), "t", "fid")


def largest_safe(ref: DataFrame, proposed: DataFrame, vertices: DataFrame, faces: DataFrame, *, bisect: int = 6, scope: DataFrame | None = None) -> DataFrame:
    """``vid, alpha`` by bisection on the candidates of the full segments: the last fraction that
    crosses nothing. For straight moves that is the first crossing rounded down to halvings, so the
    rounds are one expression over the first crossing of each segment."""
    segs = _moves(ref, proposed)
    first = spatial.earliest_hits(segs, spatial.segment_hits(segs, vertices, faces, scope=scope))
    t = F.greatest(F.col("t"), F.lit(0.0))
    cells = float(2**bisect)
    down = F.greatest(F.ceil(t * cells) - 1, F.lit(0)) / cells
    return first.select(F.col("sid").alias("vid"), F.when(F.col("t").isNull(), F.lit(1.0)).otherwise(down).alias("alpha"))


def advancing_front(hits: DataFrame, slack: float = 0.05) -> DataFrame:
    """``vid, alpha`` of the vertices that may move now: those with no crossing (1); if all have
    one, those within ``slack`` of the latest."""
    top = hits.agg(F.max(F.col("t").isNull().cast("int")).alias("free"), F.max("t").alias("best"))
    both = hits.crossJoin(top)  # one row on the right
    chosen = F.when(F.col("free") == 1, F.col("t").isNull()).otherwise(F.col("t") >= F.col("best") * (1 - slack))
    return both.where(chosen).select("vid", F.coalesce("t", F.lit(1.0)).alias("alpha"))


def batch_pullback(ref: DataFrame, current: DataFrame, target: DataFrame, front: DataFrame, faces: DataFrame, *, clearance: float = 1e-3, t_lo: float = 1e-4, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """The front planted at its fractions and taken back where it crosses the mesh it is part of:
    new positions and final fractions (``vid, alpha``)."""
    alpha = saved(front.select("vid", "alpha"))
    for _ in range(rounds):
        planted = saved(_planted(current, ref, target, alpha))
        segs = _moves(ref, planted).join(alpha.select(F.col("vid").alias("sid")), "sid", "left_semi")
        first = saved(spatial.earliest_hits(segs, spatial.segment_hits(segs, planted, faces, t_lo=t_lo)).where("t IS NOT NULL").select(F.col("sid").alias("vid"), "t"))
        if first.isEmpty():
            return planted, alpha
        alpha = saved(alpha.join(first, "vid", "left").select("vid", F.when(F.col("t").isNull(), F.col("alpha")).otherwise(F.greatest(F.col("t") * F.col("alpha") - clearance, F.lit(0.0))).alias("alpha")))
    return saved(_planted(current, ref, target, alpha)), alpha


def _planted(current: DataFrame, ref: DataFrame, target: DataFrame, alpha: DataFrame) -> DataFrame:
    moved = at_fraction(ref, target, alpha).join(alpha.select("vid"), "vid", "left_semi")
    return current.select("vid", "x", "y", "z").join(moved.select("vid"), "vid", "left_anti").unionByName(moved)


def front_advance(ref: DataFrame, current: DataFrame, target: DataFrame, faces: DataFrame, *, rounds: int = 64, clearance: float = 1e-3, t_lo: float = 1e-4) -> DataFrame:
    """Positions after fronts advanced in turn: select, plant, pull back, freeze."""
    left, now = saved(ref.select("vid")), saved(current.select("vid", "x", "y", "z"))
    for _ in range(rounds):
        if left.isEmpty():
            break
        segs = _moves(ref, target).join(left.toDF("sid"), "sid", "left_semi")
        first = spatial.earliest_hits(segs, spatial.segment_hits(segs, now, faces, t_lo=t_lo)).select(F.col("sid").alias("vid"), "t")
        front = saved(advancing_front(first))
        if front.isEmpty():
            break
        now, _ = batch_pullback(ref, now, target, front, faces, clearance=clearance, t_lo=t_lo)
        left = saved(left.join(front, "vid", "left_anti"))
    return now


def penetration_relax(ref: DataFrame, target: DataFrame, faces: DataFrame, baseline: DataFrame, *, backoff: float = 0.5, least: float = 1e-3, rounds: int = 40, finishing: int = 8, locked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``ref + alpha (target - ref)`` without new penetrating pairs, and the fractions.

    All start at 1; each round shrinks the fractions of unlocked vertices on new pairs (to 0 under
    ``least``); finishing rounds set offenders to 0.
    """
    start = ref.select("vid", F.lit(1.0).alias("alpha"))
    if locked is not None:
        start = start.join(locked.select("vid").withColumn("_l", F.lit(True)), "vid", "left").select("vid", F.when(F.col("_l"), 0.0).otherwise(1.0).alias("alpha"))
    alpha, baseline = saved(start), saved(baseline)
    for k in range(rounds + finishing):
        now = saved(at_fraction(ref, target, alpha))
        fresh = saved(metrics.new_pairs(metrics.self_intersections(now, faces), baseline))
        if fresh.isEmpty():
            return now, alpha
        hit = metrics.pair_faces(fresh).join(faces, "fid").select(F.explode(F.array(*CORNERS)).alias("vid")).distinct().withColumn("_h", F.lit(True))
        less = F.col("alpha") * backoff if k < rounds else F.lit(0.0)
        alpha = saved(alpha.join(hit, "vid", "left").select("vid", F.when(F.col("_h").isNull(), F.col("alpha")).when(less < least, F.lit(0.0)).otherwise(less).alias("alpha")))
    return saved(at_fraction(ref, target, alpha)), alpha


def pin_gate(rest: DataFrame, current: DataFrame, faces: DataFrame, edges: DataFrame, baseline: DataFrame, *, rings: int = 1, rounds: int = 16) -> tuple[DataFrame, DataFrame]:
    """Positions without new penetrating pairs, by setting ever more vertices back to rest: those on
    new pairs and ``rings`` around them; and the pinned vertices (``vid``)."""
    now, pinned, moved, baseline = saved(current.select("vid", "x", "y", "z")), None, None, saved(baseline)
    for _ in range(rounds):
        # a pair whose faces kept their places since the last scan was no new one then, or its vertices would have been pinned
        fresh = saved(metrics.new_pairs(metrics.self_intersections(now, faces, query=moved), baseline))
        if fresh.isEmpty():
            break
        hit = metrics.pair_faces(fresh).join(faces, "fid").select(F.explode(F.array(*CORNERS)).alias("vid")).distinct()
        hit = dilate(hit, edges, rings).toDF("vid")
        fresh_pins = saved(hit if pinned is None else hit.join(pinned, "vid", "left_anti"))
        moved = vertex_faces(faces).join(fresh_pins, "vid", "left_semi").select("fid").distinct()
        pinned = fresh_pins if pinned is None else saved(pinned.union(fresh_pins))
        held = rest.select("vid", "x", "y", "z").join(pinned, "vid", "left_semi")
        now = saved(now.join(pinned, "vid", "left_anti").unionByName(held))
    return now, pinned if pinned is not None else current.select("vid").limit(0)


def resolve_trajectory(ref: DataFrame, proposed: DataFrame, faces: DataFrame, *, rounds: int = 8, clearance: float = 1e-3) -> DataFrame:
    """Moves taken back until none crosses the moved mesh, or for ``rounds``."""
    now = saved(proposed.select("vid", "x", "y", "z"))
    for _ in range(rounds):
        alpha = saved(earliest_safe(ref, now, now, faces, clearance=clearance, t_lo=1e-4))
        if alpha.where("alpha < 1").isEmpty():
            break
        now = saved(at_fraction(ref, now, alpha))
    return now


def settled(ref: DataFrame, before: DataFrame, proposed: DataFrame, faces: DataFrame, *, least: float = 0.0, rounds: int = 3, bisect: int = 7) -> tuple[DataFrame, int]:
    """Positions whose movers (farther than ``least`` from ``before``) are taken back on their ways from ``ref`` until none crosses the
    mesh as it then stands, or for ``rounds``; and how often one was."""
    now, taken = saved(proposed.select("vid", "x", "y", "z")), 0
    was = before.select("vid", *Vec.of().named("p"))
    for _ in range(rounds):
        movers = now.join(was, "vid").where((Vec.of() - Vec.of("p")).norm() > least).select("vid")
        back = saved(largest_safe(ref.join(movers, "vid", "left_semi"), now, now, faces, bisect=bisect).where("alpha < 1"))
        n = back.count()
        if not n:
            break
        taken += n
        now = saved(at_fraction(ref, now, back))
    return now, taken


def smooth(displacement: DataFrame, edges: DataFrame, weight: float = 0.5) -> DataFrame:
    """Displacements moved by ``weight`` towards the mean of their neighbours'."""
    near = both_ways(edges, "e0", "e1")
    mean = near.join(displacement, near["v"] == displacement["vid"]).groupBy(F.col("u").alias("vid")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    return displacement.join(mean, "vid", "left").select("vid", *[(F.col(c) + weight * (F.coalesce(f"m{c}", F.col(c)) - F.col(c))).alias(c) for c in "xyz"])


def centroid_gap(pairs: DataFrame, vertices: DataFrame, faces: DataFrame, tau: float) -> DataFrame:
    """One row: mean and median centroid distance of face pairs, and the share under half ``tau``."""
    d = saved(spatial.gathered(pairs, vertices, faces).select((G.centroid(*corners("a_")) - G.centroid(*corners("b_"))).norm().alias("d")))
    median = F.lit(spatial.exact_quantile(d, "d", 0.5)).cast("double")
    return d.agg(F.avg("d").alias("mean"), median.alias("median"), F.avg((F.col("d") < 0.5 * tau).cast("double")).alias("close"))
