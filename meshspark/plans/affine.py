"""The affine mapping of vertex groups: AdamW on a rotation block and a translation a group.

A group's parameters are one array of twelve (nine of the linear part row by row, then the translation). The loss is the sum of
squared distances to matched targets within reach, the stiffness over vertex edges between groups, the mean squared change of
the directed Laplacian and the mean absolute distance of vertices to targets given for them. Vertex gradients are summed to
groups before they are shuffled; landmarks are put back in place after every step. A step is one written table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import Vec
from ..operators import constraints, gradients, metrics, objective
from ..operators.topology import both_ways, directed_laplacian, saved, shuffled, unique_edges
from .evaluate import Mesh, as_points

SIZE = 12


def _each(*arrays: str | Column, by) -> Column:
    """An array of ``by`` of the arrays' elements at each place."""
    rows = F.arrays_zip(*[(F.col(a) if isinstance(a, str) else a).alias(f"a{i}") for i, a in enumerate(arrays)])
    return F.transform(rows, lambda r: by(*[r[f"a{i}"] for i in range(len(arrays))]))


def _sums(values: Column) -> Column:
    return F.array(*[F.sum(F.get(values, F.lit(i))) for i in range(SIZE)])


def _zeros() -> Column:
    return F.array(*[F.lit(0.0)] * SIZE)


def parts(params: DataFrame) -> DataFrame:
    """``g, r, t`` of parameters ``g, x``."""
    return params.select("g", F.slice("x", 1, 9).alias("r"), F.slice("x", 10, 3).alias("t"))


def initial(groups: DataFrame) -> DataFrame:
    """Identity parameters ``x`` of each group ``g``, moments ``m, v, w`` (of which ``w`` is the largest ``v``) at zero, and the
    decayed powers of steps made."""
    made = constraints.identity_groups(groups.select("g").distinct()).select("g", F.concat("r", "t").alias("x"))
    return made.select("g", "x", *[_zeros().alias(k) for k in "mvw"], F.lit(1.0).alias("b1"), F.lit(1.0).alias("b2"))


def group_links(vertex_groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``u, v, n``: neighbouring groups, both ways, and the vertex edges between them."""
    side = lambda e, g: shuffled(vertex_groups.select(F.col("vid").alias(e), F.col("g").alias(g)))
    between = edges.join(side("e0", "u"), "e0").join(side("e1", "v"), "e1").where("u <> v")
    return both_ways(between, "u", "v").groupBy("u", "v").agg(F.count("*").alias("n"))


def stiffness_gradient(params: DataFrame, links: DataFrame, weight: float) -> DataFrame:
    """``g, d``: of ``weight`` times the squared differences over all vertex edges between groups."""
    side = lambda g, x: params.select(F.col("g").alias(g), F.col("x").alias(x))
    both = links.join(side("u", "xu"), "u").join(side("v", "xv"), "v")
    off = _each("xu", "xv", by=lambda a, b: a - b)
    return both.select("u", F.transform(off, lambda d: d * 2.0 * weight * F.col("n")).alias("d")).groupBy(F.col("u").alias("g")).agg(_sums(F.col("d")).alias("d"))


def laplacian_gradient(vertices: DataFrame, faces: DataFrame, source: DataFrame, n: int, weight: float) -> DataFrame:
    """``vid, gx, gy, gz``: of ``weight`` times the mean squared difference of the directed Laplacian to ``source``, over ``n`` vertices."""
    now = saved(directed_laplacian(vertices, faces).join(shuffled(source.select("vid", *Vec.of("l").named("s"))), "vid").select("vid", "degree", *((Vec.of("l") - Vec.of("s")) * (2.0 * weight / (3.0 * max(n, 1)))).named("g")))
    pairs = [("i0", "i1"), ("i1", "i2"), ("i2", "i0"), ("i0", "i2"), ("i1", "i0")]
    entries = faces.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("e")).select("e.*")
    other = entries.join(shuffled(now.withColumnRenamed("vid", "u")), "u").select(F.col("v").alias("vid"), *[(-F.col(f"g{c}")).alias(f"g{c}") for c in "xyz"])
    return now.select("vid", *[(F.col("degree") * F.col(f"g{c}")).alias(f"g{c}") for c in "xyz"]).unionByName(other)


def target_gradient(vertices: DataFrame, targets: DataFrame, n: int, weight: float) -> DataFrame:
    """``vid, gx, gy, gz``: of ``weight`` times the mean absolute coordinate difference to ``n`` targets (vid, x, y, z)."""
    both = vertices.select("vid", *Vec.of().named("p")).join(shuffled(targets.select("vid", *Vec.of().named("q"))), "vid")
    return both.select("vid", *[(F.signum(F.col(f"p{c}") - F.col(f"q{c}")) * (weight / (3.0 * max(n, 1)))).alias(f"g{c}") for c in "xyz"])


def distance_gradient(vertices: DataFrame, matches: DataFrame, most: float, weight: float) -> DataFrame:
    """``vid, gx, gy, gz``: of ``weight`` times the sum of squared distances to matches (vid, qx, qy, qz) nearer than ``most``."""
    both = vertices.select("vid", *Vec.of().named("p")).join(shuffled(matches), "vid")
    off = Vec.of("p") - Vec.of("q")
    return both.where(off.norm2() < most * most).select("vid", *(off * (2.0 * weight)).named("g"))


def to_groups(vertex_gradient: DataFrame, vertices: DataFrame, vertex_groups: DataFrame) -> DataFrame:
    """``g, d``: a vertex gradient carried to its group's parameters."""
    rows = vertex_gradient.join(shuffled(vertices.select("vid", *Vec.of().named("s"))), "vid").join(shuffled(vertex_groups), "vid")
    d = F.array(*[F.col(f"g{a}") * F.col(f"s{b}") for a in "xyz" for b in "xyz"], *[F.col(f"g{a}") for a in "xyz"])
    return rows.select("g", d.alias("d")).groupBy("g").agg(_sums(F.col("d")).alias("d"))


def adamw(state: DataFrame, gradient: DataFrame, lr: float, *, decay: float = 0.01, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> DataFrame:
    """One step with decoupled decay and the largest second moment; a group without gradient has zero. Its gradient tables add up."""
    b1, b2 = betas
    summed = gradient.groupBy("g").agg(_sums(F.col("d")).alias("d"))
    rows = state.join(summed, "g", "left").withColumns({"d": F.coalesce("d", _zeros()), "b1": F.col("b1") * b1, "b2": F.col("b2") * b2})
    rows = rows.withColumns({"m": _each("m", "d", by=lambda m, d: b1 * m + (1 - b1) * d), "v": _each("v", "d", by=lambda v, d: b2 * v + (1 - b2) * d * d)})
    rows = rows.withColumn("w", _each("w", "v", by=F.greatest))
    step = lambda x, m, w: x * (1 - lr * decay) - lr * (m / (1 - F.col("b1"))) / (F.sqrt(w / (1 - F.col("b2"))) + eps)
    return rows.withColumn("x", _each("x", "m", "w", by=step)).select(*state.columns)


@dataclass
class AffineMapper:
    """Settings and run of the mapping. ``stiffness`` has a value for each stage; a stage ends after the outer round of its
    milestone. Target points, target vertices, groups and fixed vertices are those given; what is not given has no term."""

    inner: int = 50
    outer: int = 200
    first_inner: int = 4
    milestones: tuple[int, ...] = (50, 80, 100, 110, 120, 130, 140, 150)
    stiffness: tuple[float, ...] = (50.0, 20.0, 5.0, 2.0, 0.8, 0.5, 0.35, 0.2, 0.0)
    most: float = 0.04
    distance: float = 1.0
    laplacian: float = 1.0
    target: float = 1.0
    lr: float = 1e-4
    decay: float = 0.01

    def losses(self, now: DataFrame, state: DataFrame, matches: DataFrame | None, targets: DataFrame | None, faces: DataFrame, source: DataFrame, links: DataFrame, stiffness: float) -> dict:
        """The value of each term as it enters the loss."""
        out = {"distance": 0.0, "rotation": 0.0, "translation": 0.0, "laplacian": 0.0, "target": 0.0}
        if matches is not None:
            off = (Vec.of("p") - Vec.of("q")).norm2()
            both = now.select("vid", *Vec.of().named("p")).join(shuffled(matches), "vid")
            out["distance"] = self.distance * (both.agg(F.sum(F.when(off < self.most * self.most, off))).first()[0] or 0.0)
        if stiffness:
            x = state.select("g", "x")
            both = links.where("u < v").join(x.toDF("u", "xu"), "u").join(x.toDF("v", "xv"), "v").select("n", _each("xu", "xv", by=lambda a, b: (a - b) * (a - b)).alias("d"))
            total = lambda a, b: F.sum(F.col("n") * F.aggregate(F.slice("d", a, b), F.lit(0.0), lambda s, e: s + e))
            r, t = both.agg(total(1, 9), total(10, 3)).first()
            out |= {"rotation": stiffness * (r or 0.0), "translation": stiffness * (t or 0.0)}
        if self.laplacian:
            out["laplacian"] = self.laplacian * (objective.laplacian(now, faces, source).first()[0] or 0.0)
        if targets is not None:
            out["target"] = self.target * (objective.target_l1(now, targets).first()[0] or 0.0)
        return out

    def run(self, source: Mesh, vertex_groups: DataFrame, *, points: DataFrame | None = None, targets: DataFrame | None = None, fixed: DataFrame | None = None, log: list[dict] | None = None) -> DataFrame:
        """``g, r, t``. ``log`` takes the loss terms and the Chamfer distance after each outer round."""
        rest, faces = saved(source[0].select("vid", "x", "y", "z")), saved(source[1].select("fid", "i0", "i1", "i2"))
        of = saved(vertex_groups.select("vid", "g"))
        links = saved(group_links(of, unique_edges(faces)))
        flat = saved(directed_laplacian(rest, faces))
        n, n_targets = rest.count(), targets.count() if targets is not None else 0
        targets = targets if n_targets else None
        put = lambda s: s if fixed is None else self._snapped(s, rest, of, fixed)
        place = lambda s: constraints.deform(rest, of, parts(s))
        state = saved(put(initial(of)))
        stage, matches = 0, None
        for i in range(self.outer):
            if points is not None:
                m = objective.matched(as_points(saved(place(state))), points)
                matches = saved(m.select(F.col("qid").alias("vid"), *Vec.of("q").named("q")))
            stiff = self.stiffness[min(stage, len(self.stiffness) - 1)]
            for _ in range(self.inner if i else self.first_inner):
                now = saved(place(state))
                terms = []
                if matches is not None and self.distance:
                    terms.append(distance_gradient(now, matches, self.most, self.distance))
                if self.laplacian:
                    terms.append(laplacian_gradient(now, faces, flat, n, self.laplacian))
                if targets is not None and self.target:
                    terms.append(target_gradient(now, targets, n_targets, self.target))
                grads = [to_groups(gradients.total(*terms), rest, of)] if terms else []
                if stiff:
                    grads.append(stiffness_gradient(state, links, stiff))
                every = grads[0] if grads else state.select("g", _zeros().alias("d"))
                for more in grads[1:]:
                    every = every.unionByName(more)
                state = saved(put(adamw(state, every, self.lr, decay=self.decay)))
            if log is not None:
                now = saved(place(state))
                row = {"outer": i, "stage": stage, **self.losses(now, state, matches, targets, faces, flat, links, stiff)}
                if points is not None:
                    row["chamfer_l1"] = metrics.evaluate_points(as_points(now), points, self.most).first()["chamfer_l1"]
                log.append(row)
            stage += i in self.milestones
        return parts(state)

    @staticmethod
    def _snapped(state: DataFrame, rest: DataFrame, of: DataFrame, fixed: DataFrame) -> DataFrame:
        moved = constraints.snap_landmarks(rest, of, parts(state), fixed)
        return state.drop("x").join(moved.select("g", F.concat("r", "t").alias("x")), "g").select(*state.columns)
