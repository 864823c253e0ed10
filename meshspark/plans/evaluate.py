"""Evaluations from files or tables: distances, self-intersections, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, spatial
from ..operators.topology import face_adjacency
from ..sources import mesh_files

Mesh = tuple[DataFrame, DataFrame]


def as_points(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("vid").alias("pid"), "x", "y", "z")


def evaluate_meshes(source: Mesh, target: Mesh, *, samples: int = 2_000_000, seed: int = 0, use_vertices: bool = False) -> DataFrame:
    """One row of Chamfer terms and F1 at L/2048 of the target, over samples or vertices."""
    _, _, length = metrics.frame(target[0])
    tau = length / metrics.TAU_PARTS
    if use_vertices:
        s, t = as_points(source[0]), as_points(target[0])
    else:
        s = mesh_files.sample_points(mesh_files.surface_samples(*source, samples, seed), *source)
        t = mesh_files.sample_points(mesh_files.surface_samples(*target, samples, seed + 1), *target)
    return metrics.evaluate_points(s, t, tau).withColumns({"tau": F.lit(tau), "length": F.lit(length)})


def evaluate_files(spark: SparkSession, source: str, target: str, **options) -> DataFrame:
    s, t = mesh_files.read_mesh(spark, source), mesh_files.read_mesh(spark, target)
    if s is None or t is None:
        raise FileNotFoundError(source if s is None else target)
    return evaluate_meshes(s, t, **options)


def intersections_of_file(spark: SparkSession, path: str, *, inflate_tau: float = 0.0, exclude_ring: int = 1, dump: str | None = None) -> DataFrame:
    """One row: pairs, faces, share and regions of a mesh file's self-intersections."""
    mesh = mesh_files.read_mesh(spark, path)
    if mesh is None:
        raise FileNotFoundError(path)
    v, f = mesh
    _, _, length = metrics.frame(v)
    pairs = metrics.self_intersections(v, f, inflate=inflate_tau * length / metrics.TAU_PARTS, exclude_ring=exclude_ring)
    if dump:
        pairs.write.mode("overwrite").parquet(dump)
    return metrics.intersection_report(pairs, f, face_adjacency(f))


def trajectories_of_files(spark: SparkSession, moved: str, reference: str, *, inflate_tau: float = 0.0) -> DataFrame:
    """One row: crossings of the straight moves from the reference's vertices to the moved ones'."""
    m, r = mesh_files.read_mesh(spark, moved), mesh_files.read_mesh(spark, reference)
    if m is None or r is None:
        raise FileNotFoundError(moved if m is None else reference)
    if m[0].count() != r[0].count() or m[1].count() != r[1].count():
        raise ValueError("meshes differ in their numbers of vertices or faces")
    _, _, length = metrics.frame(r[0])
    hits = spatial.segment_hits(metrics.trajectories(r[0], m[0]), *m, inflate=inflate_tau * length / metrics.TAU_PARTS)
    return metrics.trajectory_report(hits)


def main(argv: list[str] | None = None) -> None:
    """``python -m meshspark.plans.evaluate distance|intersections|trajectory PATH [REFERENCE]``."""
    import argparse

    p = argparse.ArgumentParser()
    p.add_argument("what", choices=("distance", "intersections", "trajectory"))
    p.add_argument("path")
    p.add_argument("reference", nargs="?")
    p.add_argument("--samples", type=int, default=2_000_000)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--use-vertices", action="store_true")
    p.add_argument("--inflate-tau", type=float, default=0.0)
    p.add_argument("--exclude-ring", type=int, default=1)
    p.add_argument("--dump-pairs")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "distance":
        out = evaluate_files(spark, a.path, a.reference, samples=a.samples, seed=a.seed, use_vertices=a.use_vertices)
    elif a.what == "intersections":
        out = intersections_of_file(spark, a.path, inflate_tau=a.inflate_tau, exclude_ring=a.exclude_ring, dump=a.dump_pairs)
    else:
        out = trajectories_of_files(spark, a.path, a.reference, inflate_tau=a.inflate_tau)
    for k, x in out.first().asDict().items():
        print(f"{k}: {x}")


if __name__ == "__main__":
    main()
