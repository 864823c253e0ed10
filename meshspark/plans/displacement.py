"""The displacement fit: bursts of Adam steps on all loss terms, each accepted region by region.

After a burst, faces that newly cross form regions of adjacent faces. Only these go back to where the burst began, with their
moments at zero; if a region still crosses, it alone grows by a ring and goes back again, and regions that are clean stay
as they are. All else keeps its progress. Barriers stiffen on every crossing, and the pairs that
crossed become sheet constraints.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vec import Vec
from ..operators import constraints, gradients, guard, metrics, objective, spatial
from ..operators.topology import CORNERS, corners, dilate, face_components, saved, triangles, vertex_normals
from .evaluate import as_points
from .fit import Fit


def stage_of(level: int, i: int, n: int, stages: int) -> int:
    """The stage of iteration ``i`` of ``n``: stages of even parts on the first level, the last one on others."""
    if level:
        return stages - 1
    return int(np.clip(np.searchsorted(np.linspace(0, n, stages + 1).astype(int), i, side="right") - 1, 0, stages - 1))


class DisplacementFit(Fit):
    """Settings are attributes. ``*_tau`` are in units of L/2048; schedules have a value for each stage."""

    inner: int = 20
    outer: int = 60
    first_inner: int = 4
    lr: float = 2e-4
    decay: float = 0.0
    fit_weight: float = 1.0
    mask_tau: tuple[float, ...] = (64.0, 32.0, 16.0)
    laplacian: tuple[float, ...] = (200.0, 100.0, 50.0)
    plane: tuple[float, ...] = (0.0, 0.5, 1.0)
    normal_cosine: float | None = None
    match_every: int = 4
    refresh_every: int = 10
    check_every: int = 5
    collision_weight: float = 0.0
    collision_tau: float = 0.5
    collision_cap: int | None = None
    sheet_weight: float = 0.0
    sheet_tau: float = 0.5
    wall_tau: float = 4.0
    sheet_cap: int = 1_000_000
    inversion_weight: float = 0.0
    backoff: float = 2.0
    most_weight: float = 1e6
    regrow: int = 8

    def setup(self) -> None:
        super().setup()
        normals = vertex_normals(*self.goal)
        self.target = saved(as_points(self.goal[0]).join(normals.select(F.col("vid").alias("pid"), "nx", "ny", "nz"), "pid"))
        self.begin()

    def begin(self) -> None:
        """State and counts of a level."""
        self.state = saved(gradients.moments(self.rest))
        both = self.now.join(self.rest.select("vid", *Vec.of().named("r")), "vid")
        now = both.select("vid", *[(F.col(c) - F.col(f"r{c}")).alias(f"n{c}") for c in "xyz"])
        self.state = saved(self.state.join(now, "vid").withColumns({f"d{c}": F.col(f"n{c}") for c in "xyz"}).drop("nx", "ny", "nz"))
        self.n, self.n_edges, self.n_faces = self.rest.count(), self.edges.count(), self.faces.count()
        self.weights = {"collision": self.collision_weight, "sheet": self.sheet_weight}
        a, b, c = corners()
        self.reference = saved(triangles(self.now, self.faces).select("fid", *G.face_normal(a, b, c).named("n"), G.doubled_area(a, b, c).alias("area2")))
        self.sheets = None
        if self.sheet_weight:
            self.sheets = saved(constraints.sheet_constraints(self.rest, self.faces, self.wall_tau * self.tau, self.sheet_tau * self.tau).withColumn("seq", F.lit(0).cast("long")))
        self.refresh()

    def refresh(self) -> None:
        """Candidate pairs of the collision barrier, from where the mesh is; with a cap the closest ones. Sheets keep their axes from rest."""
        self.pairs = saved(spatial.collision_candidates(self.positions(), self.faces, self.collision_tau * self.tau, max_pairs=self.collision_cap)) if self.collision_weight else None

    def positions(self, state: DataFrame | None = None) -> DataFrame:
        both = self.rest.select("vid", *Vec.of().named("r")).join((self.state if state is None else state).select("vid", "dx", "dy", "dz"), "vid")
        return both.select("vid", *[(F.col(f"r{c}") + F.col(f"d{c}")).alias(c) for c in "xyz"])

    def match(self, most: float) -> None:
        """``vid, weight, q*, n*``: nearest target points; those within ``most`` count, if their normals agree enough."""
        now = saved(self.positions())
        m = objective.matched(as_points(now), self.target, ("nx", "ny", "nz")).withColumnRenamed("qid", "vid")
        counts = F.col("d2") < most * most
        if self.normal_cosine is not None:
            m = m.join(vertex_normals(now, self.faces).select("vid", *Vec.of("n").named("s")), "vid")
            counts = counts & (Vec.of("s").dot(Vec.of("n")) > self.normal_cosine)
        self.matches = saved(m.select("vid", counts.cast("double").alias("weight"), *Vec.of("q").named("q"), *Vec.of("n").named("n")))

    def gradient(self, now: DataFrame, laplacian: float, plane: float) -> DataFrame:
        d = self.state.select("vid", *[F.col(f"d{c}").alias(c) for c in "xyz"])
        parts = [gradients.data(now, self.matches, self.n, fit=self.fit_weight, plane=plane), gradients.edge_laplacian(d, self.edges, self.n_edges, laplacian)]
        if self.pairs is not None:
            parts.append(gradients.collision(self.pairs, now, self.faces, self.collision_tau * self.tau, self.weights["collision"]))
        if self.sheets is not None:
            parts.append(gradients.sheet(self.sheets, now, self.faces, self.weights["sheet"]))
        if self.inversion_weight:
            parts.append(gradients.inversion(now, self.faces, self.reference, self.n_faces, weight=self.inversion_weight))
        return gradients.total(*parts)

    def burst(self, steps: int, laplacian: float, plane: float) -> float:
        """``steps`` Adam steps on fixed matches; the data term where the last one began."""
        now = self.positions()
        for _ in range(steps):
            now = self.positions()
            self.state = saved(gradients.adam_step(self.state, self.gradient(now, laplacian, plane), self.lr, decay=self.decay))
        off = Vec.of("p") - Vec.of("q")
        both = now.select("vid", *Vec.of().named("p")).join(self.matches, "vid")
        along = off.dot(Vec.of("n"))
        return (both.agg(F.sum(F.col("weight") * (self.fit_weight * off.norm2() + plane * along * along))).first()[0] or 0.0) / max(self.n, 1)

    def fresh_pairs(self, since: DataFrame) -> DataFrame:
        """New crossings. Faces that have not moved since ``since``, which had none, are not scanned against each other."""
        moved = self.state.select("vid", *Vec.of("d").named("p")).join(since.select("vid", *Vec.of("d").named("q")), "vid").where((Vec.of("p") - Vec.of("q")).norm2() > 0).select("vid")
        each = self.faces.select("fid", F.explode(F.array(*CORNERS)).alias("vid"))
        active = saved(each.join(moved, "vid", "left_semi").select("fid").distinct())
        return saved(metrics.new_pairs(metrics.self_intersections(self.positions(), self.faces, query=active), self.baseline))

    def accept(self, since: DataFrame) -> int:
        """Takes regions that newly cross back to ``since``, until nothing crosses; the number of pairs that did."""
        region, first = None, 0
        for k in range(self.regrow + 1):
            fresh = self.fresh_pairs(since)
            n = fresh.count()
            if not n:
                return first
            if not k:
                first = n
                self.stiffen(fresh)
            if k == self.regrow:
                break
            bad = metrics.pair_faces(fresh)
            if region is not None:  # regions that still cross go back whole, and grow
                labels = saved(face_components(region, self.adjacency))
                again = labels.join(bad, "fid", "left_semi").select("label").distinct()
                bad = bad.unionByName(labels.join(again, "label", "left_semi").select("fid"))
            grown = dilate(bad, self.adjacency, 1).toDF("fid")
            region = saved(grown if region is None else region.unionByName(grown).distinct())
            vids = self.faces.join(region, "fid", "left_semi").select(F.explode(F.array(*CORNERS)).alias("vid"))
            self.state = saved(gradients.reset(self.state, vids, since))
        self.state = saved(gradients.reset(self.state, self.state.select("vid"), since))
        return first

    def stiffen(self, fresh: DataFrame) -> None:
        """Heavier barriers; the pairs that crossed are kept apart as they were at rest, in place of the oldest constraints."""
        self.weights = {k: min(w * self.backoff, self.most_weight) for k, w in self.weights.items()}
        if self.sheets is None:
            return
        top = (self.sheets.agg(F.max("seq")).first()[0] or 0) + 1
        both = spatial.gathered(fresh, self.rest, self.faces)
        across = G.centroid(*corners("b_")) - G.centroid(*corners("a_"))
        new = both.select(F.col("a_fid").alias("fa"), F.col("b_fid").alias("fb"), *across.unit().named("u"), F.least(F.lit(self.sheet_tau * self.tau), 0.9 * across.norm()).alias("margin"), F.lit(top).cast("long").alias("seq"))
        kept = self.sheets.join(new.select("fa", "fb"), ["fa", "fb"], "left_anti")
        self.sheets = saved(constraints.capped_append(kept, new.select(*kept.columns), self.sheet_cap))

    def report(self) -> dict:
        """Of ways from rest that cross the fitted mesh; those are what decides here."""
        segs = metrics.trajectories(self.rest, self.now)
        ways = metrics.trajectory_report(spatial.segment_hits(segs, self.now, self.faces)).first().asDict()
        return super().report() | ways

    def cycle(self, level: int) -> None:
        """Bursts until the data term is flat, or ``outer`` of them. Ends on a state without new crossings."""
        c, safe = self.config, self.state
        values: list[float] = []
        flats = 0
        for i in range(self.outer):
            stage = stage_of(level, i, self.outer, len(self.mask_tau))
            if i and i % self.refresh_every == 0:
                self.refresh()
            if i % self.match_every == 0:
                self.match(self.mask_tau[stage] * self.tau)
            values.append(self.burst(self.inner if i else self.first_inner, self.laplacian[stage], self.plane[stage]))
            w = c.window
            if len(values) >= 2 * w:
                old, new = sum(values[-2 * w : -w]), sum(values[-w:])
                flats = flats + 1 if (old - new) / (abs(old) + 1e-12) < c.rel_tol else 0
            flat = flats >= c.patience and level < c.levels
            crossed = 0
            if c.guard and (i % self.check_every == 0 or flat or i == self.outer - 1):
                crossed = self.accept(safe)
                if crossed:
                    self.refresh()
                safe = self.state
            self.history.append({"level": level, "iter": i, "stage": stage, "data": values[-1], "crossed": crossed, **{f"{k}_weight": v for k, v in self.weights.items()}})
            if flat:
                break
        self.now = saved(self.positions())
        if c.guard:
            self.now = guard.resolve_trajectory(self.rest, self.now, self.faces, rounds=4)

    def fit(self) -> None:
        c = self.config
        for level in range(c.levels + 1):
            if level:
                if not self.refine("error", mult=c.refine_mult, quantile=c.refine_quantile):
                    break
                self.begin()
            self.cycle(level)
        self.gate()
