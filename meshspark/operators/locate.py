"""Where a fit is bad: vertex and face errors, and the regions worth refining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vec import Vec
from . import spatial
from .topology import CORNERS, corners, dilate, face_components, face_means, triangles


def fit_error(vertices: DataFrame, targets: DataFrame) -> DataFrame:
    """``vid, error``: distance to the nearest target point."""
    return spatial.nearest(vertices, targets, query_id="vid", ref_id="pid").select(F.col("qid").alias("vid"), F.sqrt("d2").alias("error"))


def coverage_error(vertices: DataFrame, targets: DataFrame) -> DataFrame:
    """``vid, error``: the largest distance among target points whose nearest vertex it is, else 0."""
    far = spatial.nearest(targets, vertices, query_id="pid", ref_id="vid").groupBy(F.col("rid").alias("vid")).agg(F.max(F.sqrt("d2")).alias("error"))
    return vertices.select("vid").join(far, "vid", "left").select("vid", F.coalesce("error", F.lit(0.0)).alias("error"))


def face_error(vertices: DataFrame, faces: DataFrame, targets: DataFrame) -> DataFrame:
    """``fid, error``: the larger of the means of fit and coverage errors."""
    fit = face_means(fit_error(vertices, targets), faces, "error").withColumnRenamed("error", "fit")
    cov = face_means(coverage_error(vertices, targets), faces, "error").withColumnRenamed("error", "coverage")
    return fit.join(cov, "fid").select("fid", F.greatest("fit", "coverage").alias("error"))


def high_error(errors: DataFrame, tau: float, mult: float = 2.0, quantile: float = 0.9, max_faces: int | None = None) -> tuple[DataFrame, float]:
    """Faces strictly over the larger of ``mult * tau`` and the quantile (the worst ``max_faces`` of
    them), and that threshold."""
    q = spatial.exact_quantile(errors, "error", quantile) if quantile > 0 else None
    threshold = max(mult * tau, q or 0.0)
    found = errors.where(F.col("error") > threshold)
    return (found if max_faces is None else found.orderBy(F.desc("error"), "fid").limit(max_faces)).select("fid"), threshold


def cleaned(mask: DataFrame, adjacency: DataFrame, at_least: int, rings: int) -> DataFrame:
    """The mask without components of fewer than ``at_least`` faces, grown by ``rings``."""
    kept = mask if at_least <= 1 else face_components(mask, adjacency).where(F.col("size") >= at_least).select("fid")
    return dilate(kept, adjacency, rings).toDF("fid") if rings else kept


def high_error_region(vertices: DataFrame, faces: DataFrame, targets: DataFrame, adjacency: DataFrame, tau: float, *, mult: float = 2.0, quantile: float = 0.9, at_least: int = 4, rings: int = 1, max_faces: int | None = None) -> DataFrame:
    return cleaned(high_error(face_error(vertices, faces, targets), tau, mult, quantile, max_faces)[0], adjacency, at_least, rings)


def plateau_region(vertices: DataFrame, faces: DataFrame, targets: DataFrame, adjacency: DataFrame, state: DataFrame, level: int, tau: float, *, mult: float = 2.0, quantile: float = 0.9, drop_tau: float = 0.02, blocked: float = 0.5, cooldown: int = 1, at_least: int = 4, rings: int = 1, max_faces: int | None = None) -> DataFrame:
    """High-error faces that no longer improve, are not blocked and were not refined just now."""
    from .state import face_state

    errors = face_error(vertices, faces, targets)
    found, _ = high_error(errors, tau, mult, quantile)
    ready = face_state(state, faces, tau, drop_tau, blocked).where(F.col("plateau") & ~F.col("blocked") & (level - F.col("last_refine") >= cooldown))
    found = found.join(ready, "fid", "left_semi")
    if max_faces is not None:
        found = found.join(errors, "fid").orderBy(F.desc("error"), "fid").limit(max_faces).select("fid")
    return cleaned(found, adjacency, at_least, rings)


def centroid_errors(vertices: DataFrame, faces: DataFrame, target_vertices: DataFrame, target_faces: DataFrame) -> DataFrame:
    """``fid, d0, d1, d2v, middle``: distances of corners and centroid to the target surface."""
    at = spatial.closest_on_mesh(vertices, target_vertices, target_faces).select(F.col("qid").alias("vid"), F.sqrt("d2").alias("d"))
    middle = triangles(vertices, faces).select("fid", *G.centroid(*corners()).named())
    far = spatial.closest_on_mesh(middle, target_vertices, target_faces, query_id="fid").select(F.col("qid").alias("fid"), F.sqrt("d2").alias("middle"))
    out = faces.select("fid", *CORNERS)
    for c, n in zip(CORNERS, ("d0", "d1", "d2v"), strict=True):
        out = out.join(at.select(F.col("vid").alias(c), F.col("d").alias(n)), c)
    return out.join(far, "fid").select("fid", "d0", "d1", "d2v", "middle")


_ENDS = ("d0", "d1", "d2v")


def sagging(errors: DataFrame, tau: float, *, mult: float = 1.0, centroid_mult: float = 1.0, quantile: float = 0.0, max_faces: int | None = None) -> DataFrame:
    """``fid, sag``: faces whose centroid is farther than the mean of their corners by more than the
    threshold, and by itself farther than ``centroid_mult * tau``."""
    sags = errors.withColumn("sag", G.sag([F.col(c) for c in _ENDS], F.col("middle")))
    threshold = mult * tau
    if quantile > 0:
        threshold = max(threshold, spatial.exact_quantile(sags, "sag", quantile) or 0.0)
    found = sags.where((F.col("sag") > threshold) & (F.col("middle") > centroid_mult * tau))
    return (found if max_faces is None else found.orderBy(F.desc("sag"), "fid").limit(max_faces)).select("fid", "sag")


def ratio_sagging(errors: DataFrame, tau: float, *, ratio: float = 1.2, centroid_mult: float = 1.0, floor_tau: float = 0.25, max_faces: int | None = None) -> DataFrame:
    found = errors.withColumn("ratio", G.sag_ratio([F.col(c) for c in _ENDS], F.col("middle"), floor_tau * tau)).where((F.col("ratio") > ratio) & (F.col("middle") > centroid_mult * tau))
    return (found if max_faces is None else found.orderBy(F.desc("ratio"), "fid").limit(max_faces)).select("fid", "ratio")


def above_mean(errors: DataFrame, tau: float, *, mult: float = 1.0, at_least_tau: float = 0.0, max_faces: int | None = None) -> DataFrame:
    mean = errors.agg(F.avg("middle").alias("mean"))
    found = errors.crossJoin(mean).where((F.col("middle") > mult * F.col("mean")) & (F.col("middle") > at_least_tau * tau))  # one row on the right
    return (found if max_faces is None else found.orderBy(F.desc("middle"), "fid").limit(max_faces)).select("fid", "middle")


def sag_ladder(errors: DataFrame, tau: float, steps: tuple[int, ...] = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)) -> DataFrame:
    """``k``, and counts and percent of faces with sag over ``k * tau``, and with the centroid over it as well."""
    sags = errors.withColumn("sag", G.sag([F.col(c) for c in _ENDS], F.col("middle")))
    over = [((F.col("sag") > k * tau).cast("long"), ((F.col("sag") > k * tau) & (F.col("middle") > k * tau)).cast("long")) for k in steps]
    one = sags.agg(F.count("*").alias("n"), *[F.sum(x).alias(f"{n}{k}") for k, xs in zip(steps, over, strict=True) for n, x in zip(("s", "b"), xs, strict=True)])
    row = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("n_sag"), F.col(f"b{k}").alias("n_both")) for k in steps]))
    return one.select("n", row.alias("r")).select("r.k", "r.n_sag", "r.n_both", (100.0 * F.col("r.n_sag") / F.greatest("n", F.lit(1))).alias("pct_sag"))


def localize(vertices: DataFrame, faces: DataFrame, targets: DataFrame, target_mesh: tuple[DataFrame, DataFrame] | None, adjacency: DataFrame, tau: float, criterion: str = "error", **options) -> DataFrame:
    """Faces (fid) by criterion: ``mean``, ``ratio``, ``sag`` (of the surface), ``plateau`` or ``error``. Components of fewer than
    ``at_least`` faces go and the rest grows by ``rings``; by the surface that is 1 and 0 if not given."""
    if criterion in ("mean", "ratio", "sag"):
        at_least, rings = options.pop("at_least", 1), options.pop("rings", 0)
        errors = centroid_errors(vertices, faces, *target_mesh)
        found = {"mean": above_mean, "ratio": ratio_sagging, "sag": sagging}[criterion](errors, tau, **options)
        return cleaned(found.select("fid"), adjacency, at_least, rings)
    return (plateau_region if criterion == "plateau" else high_error_region)(vertices, faces, targets, adjacency, tau=tau, **options)


def moved(vertices: DataFrame, reference: DataFrame, tau: float, most: int | None = None) -> DataFrame:
    """``vid`` of vertices that moved more than ``tau``; with ``most`` the ones that moved most."""
    both = vertices.select("vid", *Vec.of().named("p")).join(reference.select("vid", *Vec.of().named("q")), "vid").withColumn("m", (Vec.of("p") - Vec.of("q")).norm())
    far = both.where(F.col("m") > tau)
    return (far if most is None else far.orderBy(F.desc("m"), "vid").limit(most)).select("vid")


def active_faces(vertices: DataFrame, reference: DataFrame, faces: DataFrame, tau: float, adjacency: DataFrame, most: int | None = None) -> DataFrame:
    """``fid`` of faces with a corner that moved more than ``tau`` (the ``most`` movers), and one ring around."""
    far = moved(vertices, reference, tau, most)
    hit = faces.select("fid", F.explode(F.array(*CORNERS)).alias("vid")).join(far, "vid", "left_semi").select("fid").distinct()
    return dilate(hit, adjacency, 1).toDF("fid")
