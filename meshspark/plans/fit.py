"""Fits: rigid and non-rigid alignment as driver loops over checkpointed tables.

Each round is a query over tables of vertices; what the driver holds is a handful of scalars (and
for the rigid fit the 3x3 moments of the matches).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vec import Vec
from ..operators import guard, locate, metrics, objective, spatial, state
from ..operators.refine import subdivide
from ..operators.topology import both_ways, face_adjacency, saved, unique_edges, vertex_degrees, vertex_normals
from ..session import ship
from ..sources import mesh_files
from .affine import AffineMapper
from .evaluate import Mesh, as_points, evaluate_meshes
from .nonrigid import OptimalStep


def transformed(points: DataFrame, m: np.ndarray) -> DataFrame:
    out = G.rigid(Vec.of(), m.tolist())
    return points.withColumns({f"_{c}": getattr(out, c) for c in "xyz"}).drop("x", "y", "z").withColumnsRenamed({f"_{c}": c for c in "xyz"})


def box_alignment(source: DataFrame, target: DataFrame) -> np.ndarray:
    """The 4x4 matrix that brings the source's box to the target's diagonal and center."""
    ends = [p.agg(*[f(c) for f in (F.min, F.max) for c in "xyz"]).first() for p in (source, target)]
    lo, hi = np.array([e[:3] for e in ends], float), np.array([e[3:] for e in ends], float)
    size = np.linalg.norm(hi - lo, axis=1)
    scale = size[1] / size[0] if size[0] > 0 else 1.0
    m = np.eye(4)
    m[:3, :3] *= scale
    m[:3, 3] = (lo[1] + hi[1]) / 2 - scale * (lo[0] + hi[0]) / 2
    return m


def rigid_step(matches: DataFrame) -> np.ndarray:
    """Least-squares rotation and translation of ``p`` onto ``q``: sums in Spark, one SVD here."""
    p, q = [F.col(f"p{c}") for c in "xyz"], [F.col(f"q{c}") for c in "xyz"]
    r = matches.agg(F.count("*"), *[F.sum(x) for x in p], *[F.sum(x) for x in q], *[F.sum(a * b) for a in p for b in q]).first()
    n = r[0]
    if n < 3:
        return np.eye(4)
    mp, mq = np.array(r[1:4]) / n, np.array(r[4:7]) / n
    cov = np.array(r[7:16]).reshape(3, 3) - n * np.outer(mp, mq)
    u, _, vt = np.linalg.svd(cov)
    d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
    out = np.eye(4)
    out[:3, :3] = vt.T @ d @ u.T
    out[:3, 3] = mq - out[:3, :3] @ mp
    return out


def plane_step(matches: DataFrame) -> np.ndarray:
    """Linearized point-to-plane step (target normals ``nx..``): 27 sums in Spark, one 6x6 solve here."""
    p, q, n = Vec.of("p"), Vec.of("q"), Vec.of("n")
    c = p.cross(n)
    row, rhs = [c.x, c.y, c.z, n.x, n.y, n.z], (q - p).dot(n)
    at = [(i, j) for i in range(6) for j in range(i, 6)]
    r = matches.agg(F.count("*"), *[F.sum(row[i] * row[j]) for i, j in at], *[F.sum(row[i] * rhs) for i in range(6)]).first()
    if r[0] < 6:
        return np.eye(4)
    a, b = np.zeros((6, 6)), np.array(r[22:28], float)
    for (i, j), v in zip(at, r[1:22], strict=True):
        a[i, j] = a[j, i] = v
    x = np.linalg.lstsq(a, b, rcond=None)[0]
    angle = np.linalg.norm(x[:3])
    out = np.eye(4)
    if angle > 0:
        k = x[:3] / angle
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        out[:3, :3] = np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross
    out[:3, 3] = x[3:]
    return out


def icp(source: DataFrame, target: DataFrame, *, threshold: float = 0.02, rounds: int = 30, tol: float = 1e-6) -> np.ndarray:
    """The 4x4 matrix of a box alignment followed by ICP within ``threshold``; to planes if both
    sides have normals, else to points."""
    planes = {"nx", "ny", "nz"} <= set(source.columns) & set(target.columns)
    m = box_alignment(source, target)
    last = None
    for _ in range(rounds):
        now = transformed(source.select("pid", "x", "y", "z"), m)
        near = saved(objective.matched(now, target, ("nx", "ny", "nz") if planes else ()).where(F.col("d2") <= threshold * threshold))
        n, error = near.agg(F.count("*"), F.avg("d2")).first()
        if not n or last is not None and abs(last - error) < tol * max(last, 1e-30):
            break
        last = error
        m = (plane_step if planes else rigid_step)(near) @ m
    return m


def local_rotations(rest: DataFrame, current: DataFrame, edges: DataFrame) -> DataFrame:
    """``vid, r`` (9 numbers, row by row): the rotation that best carries each vertex's rest edges to
    its current ones. Covariances are sums; the SVDs run on Arrow batches."""
    ship(rest.sparkSession)
    near = both_ways(edges, "e0", "e1")
    side = lambda df, k, p: df.select(F.col("vid").alias(k), *Vec.of().named(p))
    both = near.join(side(rest, "u", "ru"), "u").join(side(rest, "v", "rv"), "v").join(side(current, "u", "cu"), "u").join(side(current, "v", "cv"), "v")
    a, b = Vec.of("rv") - Vec.of("ru"), Vec.of("cv") - Vec.of("cu")
    names = [f"s{i}{j}" for i in "xyz" for j in "xyz"]
    sums = both.groupBy(F.col("u").alias("vid")).agg(*[F.sum(getattr(a, n[1]) * getattr(b, n[2])).alias(n) for n in names])

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            u, _, vt = np.linalg.svd(pdf[names].to_numpy().reshape(-1, 3, 3))
            d = np.ones((len(u), 3))
            d[:, 2] = np.sign(np.linalg.det(np.einsum("nji,nkj->nik", vt, u)))
            r = np.einsum("nji,nj,nkj->nik", vt, d, u)
            yield pd.DataFrame({"vid": pdf["vid"].to_numpy(), "r": list(r.reshape(-1, 9))})

    return sums.mapInPandas(solve, "vid long, r array<double>")


def arap_step(current: DataFrame, rest: DataFrame, edges: DataFrame, *, weight: float = 1.0, pinned: DataFrame | None = None) -> DataFrame:
    """One damped step towards as-rigid-as-possible positions; pinned vertices stay."""
    rot = saved(local_rotations(rest, current, edges))
    near = both_ways(edges, "e0", "e1")
    side = lambda df, k, p: df.select(F.col("vid").alias(k), *Vec.of().named(p))
    both = near.join(side(rest, "u", "ru"), "u").join(side(rest, "v", "rv"), "v").join(side(current, "v", "cv"), "v")
    both = both.join(rot.toDF("u", "r0"), "u").join(rot.toDF("v", "r1"), "v")
    x = Vec.of("ru") - Vec.of("rv")
    r = lambda i: (F.get("r0", F.lit(i)) + F.get("r1", F.lit(i))) / 2.0
    target = [getattr(Vec.of("cv"), c) + r(3 * i) * x.x + r(3 * i + 1) * x.y + r(3 * i + 2) * x.z for i, c in enumerate("xyz")]
    mean = both.groupBy(F.col("u").alias("vid")).agg(*[F.avg(t).alias(f"t{c}") for t, c in zip(target, "xyz", strict=True)])
    out = current.select("vid", "x", "y", "z").join(mean, "vid", "left")
    held = F.lit(False)
    if pinned is not None:
        out, held = out.join(pinned.select("vid", F.lit(True).alias("_pin")), "vid", "left"), F.col("_pin").isNotNull()
    return out.select("vid", *[F.when(held | F.col(f"t{c}").isNull(), F.col(c)).otherwise((1 - weight) * F.col(c) + weight * F.col(f"t{c}")).alias(c) for c in "xyz"])


def projected(vertices: DataFrame, target: Mesh, cap: float | None = None) -> DataFrame:
    """``vid, x, y, z, distance``: vertices moved to their closest target point, at most ``cap`` far."""
    near = spatial.closest_on_mesh(vertices, *target)
    both = vertices.select("vid", *Vec.of().named("p")).join(near, F.col("vid") == F.col("qid"))
    step = Vec.of("cp_") - Vec.of("p")
    if cap is not None:
        step = G.clamp_norm(step, cap)
    return both.select("vid", *(Vec.of("p") + step).named(), F.sqrt("d2").alias("distance"))


def self_aware_step(vertices: DataFrame, faces: DataFrame, target: Mesh, *, clearance: float = 1e-3, t_lo: float = 1e-4) -> DataFrame:
    """``vid, x, y, z, alpha``: each vertex goes towards its closest target point up to just before
    its path first meets the mesh as it stands. One query, no loop."""
    goal = projected(vertices, target)
    alpha = guard.earliest_safe(vertices, goal, vertices, faces, clearance=clearance, t_lo=t_lo)
    out = guard.at_fraction(vertices, goal, alpha)
    return out.join(alpha.select("vid", "alpha"), "vid", "left").select("vid", "x", "y", "z", F.coalesce("alpha", F.lit(1.0)).alias("alpha"))


@dataclass
class FitConfig:
    """Settings of :class:`ProjectionFit` and :class:`ClampedFit`; ``*_tau`` are in units of L/2048."""

    step_tau: float = 1.0
    max_sweeps: int = 24
    least_tau: float = 0.02
    wall_tau: float = 30.0
    wall_part: float = 0.5
    gap_tau: float = 0.5
    guard_rounds: int = 3
    bisect: int = 7
    smooth: float = 0.0
    smooth_rounds: int = 1
    window: int = 3
    rel_tol: float = 0.05
    patience: int = 2
    levels: int = 0
    refine_mult: float = 2.0
    refine_quantile: float = 0.9
    guard: bool = True
    gate_rings: int = 1
    gate_rounds: int = 16
    step_frac: float = 0.5
    laplacian: float = 0.0
    stiffness: float = 0.5
    steps: int = 4
    rigid: bool = True
    eval_samples: int = 2_000_000
    seed: int = 0


@dataclass
class Fit:
    """A source mesh on its way to a target: both in the target's frame, with a record of steps."""

    source: Mesh
    target: Mesh
    config: FitConfig = field(default_factory=FitConfig)
    history: list[dict] = field(default_factory=list)
    refinements: list[dict] = field(default_factory=list)

    def setup(self) -> None:
        self.center, self.scale, self.length = metrics.frame(self.target[0])
        into = lambda v: v.select("vid", *G.to_frame(Vec.of(), self.center, self.scale).named())
        self.goal = (saved(into(self.target[0])), saved(self.target[1]))
        v = into(self.source[0])
        if self.config.rigid:
            m = icp(as_points(v), as_points(self.goal[0]))
            v = transformed(v, m)
        self.rest, self.faces = saved(v.select("vid", "x", "y", "z")), saved(self.source[1].select("fid", "i0", "i1", "i2"))
        self.now = self.rest
        self.tau = self.length / metrics.TAU_PARTS * self.scale
        self._topology()

    def _topology(self) -> None:
        self.edges = saved(unique_edges(self.faces))
        self.adjacency = saved(face_adjacency(self.faces))
        self.baseline = saved(metrics.self_intersections(self.rest, self.faces)) if self.config.guard else None

    def gate(self) -> None:
        if self.config.guard:
            self.now, _ = guard.pin_gate(self.rest, self.now, self.faces, self.edges, self.baseline, rings=self.config.gate_rings, rounds=self.config.gate_rounds)

    def refine(self, criterion: str = "error", **options) -> int:
        """Splits the faces that the criterion finds, with rest positions carried along; their number."""
        region = saved(locate.localize(self.now, self.faces, as_points(self.goal[0]), self.goal, self.adjacency, self.tau, criterion, **options))
        n = region.count()
        self.refinements.append({"criterion": criterion, "marked": n, "faces": self.faces.count()})
        if n:
            both = self.now.join(self.rest.select("vid", *Vec.of().named("r")), "vid")
            v, f = subdivide(both, self.faces, region, ("rx", "ry", "rz"))
            v = saved(v)
            self.now, self.rest, self.faces = v.select("vid", "x", "y", "z"), v.select("vid", *[F.col(f"r{c}").alias(c) for c in "xyz"]), saved(f.select("fid", "i0", "i1", "i2"))
            self._topology()
        return n

    def result(self) -> Mesh:
        return self.now.select("vid", *G.from_frame(Vec.of(), self.center, self.scale).named()), self.faces

    def evaluate(self, mesh: Mesh | None = None, **options) -> dict:
        return evaluate_meshes(mesh or self.result(), self.target, samples=self.config.eval_samples, seed=self.config.seed, **options).first().asDict()

    def fit_and_evaluate(self, **options) -> tuple[Mesh, dict]:
        """The fitted mesh if its Chamfer distance is no worse than the rigid one's, else that; and both records."""
        self.setup()
        start = (self.rest.select("vid", *G.from_frame(Vec.of(), self.center, self.scale).named()), self.faces)
        self.fit()
        fitted, baseline = self.evaluate(**options), self.evaluate(start, **options)
        kept = fitted["chamfer_l1"] <= baseline["chamfer_l1"]
        return (self.result() if kept else start), {"fitted": fitted, "baseline": baseline, "kept": "fitted" if kept else "baseline"}

    def report(self) -> dict:
        """Counts of the fitted mesh's new crossings, and whether it is ``clean``."""
        baseline = self.baseline if self.baseline is not None else metrics.self_intersections(self.rest, self.faces)
        fresh = saved(metrics.new_pairs(metrics.self_intersections(self.now, self.faces), baseline))
        n = fresh.count()
        return {"new_pairs": n, "new_faces": metrics.pair_faces(fresh).count(), "clean": n == 0}

    def save(self, path: str, record: dict | None = None) -> str:
        """Writes the run's folder; the path of the fitted mesh, whose name tells whether its report is clean. Beside it are the
        mesh at rest, of the same faces, and records: the report, the metrics given, settings, history and refinements."""
        spark, report = self.now.sparkSession, self.report()
        out = f"{path}/{'fitted_mesh' if report['clean'] else 'fitted_mesh_unverified'}.ply"
        mesh_files.write_mesh(*self.result(), out, overwrite=True)
        start = self.rest.select("vid", *G.from_frame(Vec.of(), self.center, self.scale).named())
        mesh_files.write_mesh(start, self.faces, f"{path}/trajectory_reference_mesh.ply", overwrite=True)
        records = {"trajectory_report": report, "config": asdict(self.config), "history": self.history, "refine_log": self.refinements}
        mesh_files.write_bundle(path, {}, records | ({"metrics": record} if record is not None else {}), spark)
        return out

    def fit(self) -> None:
        raise NotImplementedError


def wall_caps(vertices: DataFrame, faces: DataFrame, *, step: float, most: float, part: float, gap: float) -> DataFrame:
    """``vid, cap, allowance, dx, dy, dz``: how far a vertex may go at once (``step``, or a part of its wall's thickness),
    and in all towards the wall's other side: half of what is left of the thickness when both sides keep ``gap`` between them."""
    t = F.col("thickness")
    rows = spatial.vertex_thickness(vertices, faces, most)
    return rows.select("vid", F.least(F.lit(float(step)), part * t).alias("cap"), F.greatest((t - gap) * 0.5, F.lit(0.0)).alias("allowance"), "dx", "dy", "dz")


def capped_projection(vertices: DataFrame, rest: DataFrame, target: Mesh, caps: DataFrame) -> DataFrame:
    """``vid, x, y, z, distance``: vertices moved towards their closest target point within their :func:`wall_caps`; what
    they go from rest towards their wall's other side stays within the allowance."""
    near = spatial.closest_on_mesh(vertices, *target).withColumnRenamed("qid", "vid")
    rows = vertices.select("vid", *Vec.of().named("p")).join(near, "vid").join(rest.select("vid", *Vec.of().named("r")), "vid").join(caps, "vid")
    moved = Vec.of("p") + G.clamp_norm(Vec.of("cp_") - Vec.of("p"), F.col("cap"))
    rows = rows.select("vid", *moved.named("m"), *[f"{k}{c}" for k in "rd" for c in "xyz"], "allowance", F.sqrt("d2").alias("distance"))
    return rows.select("vid", *G.inward_cap(Vec.of("m"), Vec.of("r"), Vec.of("d"), F.col("allowance")).named(), "distance")


class ProjectionFit(Fit):
    """Sweeps of closest-point projection, capped by walls, until the mean distance no longer falls or nothing moves, then
    refinement; a last gate pins what would cross to rest.

    Walls are measured at rest, once a level. Movers are taken back along their way from rest until none crosses the mesh as it
    then stands, so two sides of a wall that move at once cannot pass each other.
    """

    def caps(self) -> DataFrame:
        c, tau = self.config, self.tau
        return saved(wall_caps(self.rest, self.faces, step=c.step_tau * tau, most=c.wall_tau * tau, part=c.wall_part, gap=c.gap_tau * tau))

    def sweep(self, caps: DataFrame) -> dict:
        """Moves all vertices once; means and counts of the sweep, lengths in tau."""
        c, before = self.config, self.now
        least = c.least_tau * self.tau
        goal = saved(capped_projection(before, self.rest, self.goal, caps))
        moved, clamped = goal.select("vid", "x", "y", "z"), 0
        if c.guard:
            moved, clamped = guard.settled(self.rest, before, moved, self.faces, least=least, rounds=c.guard_rounds, bisect=c.bisect)
        for _ in range(c.smooth_rounds if c.smooth else 0):
            d = moved.join(self.rest.select("vid", *Vec.of().named("r")), "vid").select("vid", *[(F.col(k) - F.col(f"r{k}")).alias(k) for k in "xyz"])
            d = guard.smooth(d, self.edges, c.smooth)
            moved = d.join(self.rest.select("vid", *Vec.of().named("r")), "vid").select("vid", *[(F.col(k) + F.col(f"r{k}")).alias(k) for k in "xyz"])
        self.now = saved(moved)
        went = self.now.select("vid", *Vec.of().named("q")).join(before.select("vid", *Vec.of().named("p")), "vid").join(goal.select("vid", "distance"), "vid")
        m = (Vec.of("q") - Vec.of("p")).norm()
        mean, far, moving, off = went.agg(F.avg(m), F.max(m), F.sum((m > least).cast("long")), F.avg("distance")).first()
        return {"mean_move": (mean or 0.0) / self.tau, "max_move": (far or 0.0) / self.tau, "moving": moving or 0, "clamped": clamped, "mean_distance": (off or 0.0) / self.tau}

    def fit(self) -> None:
        c = self.config
        for level in range(c.levels + 1):
            means: list[float] = []
            flats = 0
            caps = self.caps()
            for _ in range(c.max_sweeps):
                row = self.sweep(caps)
                means.append(row["mean_distance"])
                self.history.append({"level": level, "iter": len(means), **row})
                if not row["moving"]:
                    break
                w = c.window
                if len(means) >= 2 * w:
                    old, new = sum(means[-2 * w : -w]) / w, sum(means[-w:]) / w
                    flats = flats + 1 if (old - new) / (abs(old) + 1e-12) < c.rel_tol else 0
                    if flats >= c.patience:
                        break
            if level < c.levels and not self.refine("error", mult=c.refine_mult, quantile=c.refine_quantile):
                break
        self.gate()


class StepwiseFit(Fit):
    """A few steps of a share of the distance each, with as-rigid-as-possible relaxation and a guard
    on the whole motion from rest."""

    def fit(self) -> None:
        c = self.config
        for step in range(c.steps):
            goal = saved(projected(self.now, self.goal))
            both = self.now.select("vid", *Vec.of().named("p")).join(goal, "vid")
            moved = saved(both.select("vid", *[(F.col(f"p{k}") + c.step_frac * (F.col(k) - F.col(f"p{k}"))).alias(k) for k in "xyz"]))
            if c.stiffness:
                moved = saved(arap_step(moved, self.rest, self.edges, weight=c.stiffness))
            self.now = guard.resolve_trajectory(self.rest, moved, self.faces, rounds=4) if c.guard else moved
            self.history.append({"step": step, "mean_distance": goal.agg(F.avg("distance")).first()[0]})
        self.gate()


class ClampedFit(Fit):
    """Gradient steps of half the squared distance to the target and an edge term, clamped to a share
    of each vertex's distance and pulled back before they cross; stalled vertices drop out."""

    def setup(self) -> None:
        super().setup()
        self.state = saved(state.initial_state(self.rest))

    def fit(self) -> None:
        c = self.config
        for step in range(c.steps):
            goal = saved(projected(self.now, self.goal))
            d = self.now.join(self.rest.select("vid", *Vec.of().named("r")), "vid").select("vid", *[(F.col(k) - F.col(f"r{k}")).alias(k) for k in "xyz"])
            pull = self.now.select("vid", *Vec.of().named("p")).join(goal, "vid").join(self.state.select("vid", "optimizable"), "vid")
            raw = [F.when(F.col("optimizable"), F.col(k) - F.col(f"p{k}")).otherwise(0.0) for k in "xyz"]
            if c.laplacian:
                pull = pull.join(objective.edge_laplacian_gradient(d, self.edges), "vid")
                raw = [r - c.laplacian * F.col(f"g{k}") for r, k in zip(raw, "xyz", strict=True)]
            move = G.clamp_norm(Vec(*raw), c.step_frac * F.col("distance"))
            moved = saved(pull.select("vid", *(Vec.of("p") + move).named(), "distance", move.norm().alias("intended")))
            before = self.now
            self.now = guard.resolve_trajectory(self.rest, moved, self.faces) if c.guard else saved(moved.select("vid", "x", "y", "z"))
            went = self.now.select("vid", *Vec.of().named("q")).join(before.select("vid", *Vec.of().named("p")), "vid").select("vid", (Vec.of("q") - Vec.of("p")).norm().alias("actual"))
            self.state = saved(state.next_state(self.state, moved.select("vid", F.col("distance").alias("resid"), "intended").join(went, "vid"), self.tau))
            sums = moved.join(went, "vid").agg(F.avg("distance"), F.sum("intended"), F.sum("actual")).first()
            self.history.append({"step": step, "mean_distance": sums[0], "intended": sums[1], "actual": sums[2]})
        self.gate()


class RelaxedFit(Fit):
    """Projections whose fractions shrink on new penetrations, each followed by refinement of the
    faces that stay farther off than the mean; ``locked`` keeps settled vertices."""

    locked: bool = False

    def fit(self) -> None:
        c = self.config
        for step in range(c.steps):
            goal = saved(projected(self.now, self.goal))
            anchor = self.now if self.locked else self.rest
            held = goal.where(F.col("distance") <= self.tau).select("vid") if self.locked else None
            self.now, alpha = guard.penetration_relax(anchor, goal.select("vid", "x", "y", "z"), self.faces, self.baseline, locked=held)
            self.history.append({"step": step, "mean_distance": goal.agg(F.avg("distance")).first()[0], "mean_alpha": alpha.agg(F.avg("alpha")).first()[0]})
            if step < c.levels:
                self.refine("mean")


def map_mesh(source: Mesh, target: Mesh, *, nonrigid: bool = True, **options) -> DataFrame:
    """Source vertices after rigid alignment and, if asked, the optimal-step fit to the target's vertices."""
    t = as_points(target[0])
    m = icp(as_points(source[0]), t)
    v = saved(transformed(source[0].select("vid", "x", "y", "z"), m))
    return OptimalStep(**options).fit((v, source[1]), t)[0] if nonrigid else v


def with_normals(mesh: Mesh) -> DataFrame:
    return as_points(mesh[0]).join(vertex_normals(*mesh).withColumnRenamed("vid", "pid"), "pid")


class GroupMapper:
    """Builds and runs the affine mapping of vertex groups onto target points and target vertices, with landmarks."""

    def __init__(self, source: Mesh, target: DataFrame | None = None) -> None:
        from ..operators.constraints import FixedVertices, TargetPoints, TargetVertices, VertexGroups

        self.source = source
        self.points, self.targets, self.groups, self.fixed = TargetPoints(), TargetVertices(), VertexGroups(), FixedVertices()
        if target is not None:
            self.points.add(target)
        self.log: list[dict] = []

    def add_points(self, rows: DataFrame) -> GroupMapper:
        self.points.add(rows)
        return self

    def add_targets(self, rows: DataFrame) -> GroupMapper:
        self.targets.add(rows)
        return self

    def add_group(self, group_id: int, vids: DataFrame) -> GroupMapper:
        self.groups.add(group_id, vids)
        return self

    def add_fixed(self, rows: DataFrame) -> GroupMapper:
        self.fixed.add(rows)
        return self

    def map(self, *, rigid: bool = True, **settings) -> DataFrame:
        """``vid, x, y, z`` of the deformed source; settings are those of :class:`AffineMapper`."""
        from ..operators.constraints import deform
        from ..operators.topology import dense_rank_ids

        v, f = self.source
        points = self.points.get()
        if points is not None:
            points = dense_rank_ids(points.distinct(), ["x", "y", "z"], "pid")
        if rigid and points is not None:
            v = saved(transformed(v.select("vid", "x", "y", "z"), icp(as_points(v), points)))
        of = self.groups.of(v)
        dense = dense_rank_ids(of.select("group_id").distinct(), ["group_id"], "g")
        vertex_groups = saved(of.join(dense, "group_id").select("vid", "g"))
        params = AffineMapper(**settings).run((v, f), vertex_groups, points=points, targets=self.targets.get(), fixed=self.fixed.get(), log=self.log)
        return deform(v, vertex_groups, params)
