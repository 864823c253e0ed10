"""The affine mapping of groups against a dense loop."""

import numpy as np
import pytest

from meshspark.operators import constraints, objective, spatial
from meshspark.operators.topology import directed_laplacian
from meshspark.plans import affine, fit
from test_nonrigid import grid, tables


def dense_map(p, f, of, q, targets, fixed, c):
    """Parameters and last loss terms of the same steps in numpy."""
    n, groups = len(p), max(of) + 1
    edges = sorted({tuple(sorted(e)) for t in f for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))})
    lap = np.zeros((n, n))
    for a, b, d in f:
        for u, v in ((a, b), (b, d), (d, a), (a, d), (b, a)):
            lap[u, u] += 1
            lap[u, v] -= 1
    x = np.tile(np.r_[np.eye(3).reshape(-1), 0, 0, 0], (groups, 1))
    m, v, w = (np.zeros_like(x) for _ in range(3))
    place = lambda x: np.array([x[g, :9].reshape(3, 3) @ s + x[g, 9:] for g, s in zip(of, p)])

    def put(x):
        now = place(x)
        for i, at in sorted(fixed.items()):
            x[of[i], 9:] += at - now[i]
        return x

    x, t, stage = put(x), 0, 0
    for i in range(c.outer):
        match = q[((place(x)[:, None] - q[None]) ** 2).sum(2).argmin(1)]
        stiff = c.stiffness[stage]
        for _ in range(c.inner if i else c.first_inner):
            now = place(x)
            near = (((now - match) ** 2).sum(1) < c.most**2)[:, None]
            g = 2 * c.distance * near * (now - match) + 2 * c.laplacian / (3 * n) * lap.T @ (lap @ (now - p))
            for k, at in targets.items():
                g[k] += c.target * np.sign(now[k] - at) / (3 * len(targets))
            d = np.zeros_like(x)
            for k, s in enumerate(p):
                d[of[k]] += np.r_[np.outer(g[k], s).reshape(-1), g[k]]
            for a, b in edges:
                if of[a] != of[b]:
                    off = 2 * stiff * (x[of[a]] - x[of[b]])
                    d[of[a]] += off
                    d[of[b]] -= off
            t += 1
            m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
            w = np.maximum(w, v)
            x = put(x * (1 - c.lr * c.decay) - c.lr * (m / (1 - 0.9**t)) / (np.sqrt(w / (1 - 0.999**t)) + 1e-8))
        stage += i in c.milestones
    now = place(x)
    off = ((now - match) ** 2).sum(1)
    between = [(x[of[a]] - x[of[b]]) ** 2 for a, b in edges if of[a] != of[b]]
    losses = {"distance": c.distance * off[off < c.most**2].sum(), "rotation": stiff * sum(b[:9].sum() for b in between), "translation": stiff * sum(b[9:].sum() for b in between),
              "laplacian": c.laplacian * ((lap @ (now - p)) ** 2).mean(), "target": c.target * np.mean([np.abs(now[k] - at).mean() for k, at in targets.items()])}
    return x, losses


def test_steps_are_those_of_a_loop(spark):
    p, f = grid(4)
    rng = np.random.default_rng(4)
    p = p + 0.05 * rng.normal(size=p.shape)
    q = p + [0.05, -0.1, 0.2] + 0.1 * rng.normal(size=p.shape)
    of = [i // 6 for i in range(16)]
    targets, fixed = {3: rng.normal(size=3), 12: rng.normal(size=3)}, {7: p[7] + 0.1}
    c = affine.AffineMapper(inner=3, outer=3, first_inner=2, milestones=(0, 1), stiffness=(0.5, 0.2, 0.1), most=0.25, laplacian=0.7, target=0.3, lr=0.02, decay=0.1)
    at = lambda rows: spark.createDataFrame([(i, *map(float, x)) for i, x in rows], "vid long, x double, y double, z double")
    mesh = tables(spark, p, f)
    points = at(enumerate(q)).withColumnRenamed("vid", "pid")
    log = []
    got = c.run(mesh, spark.createDataFrame(list(enumerate(of)), "vid long, g long"), points=points, targets=at(targets.items()), fixed=at(fixed.items()), log=log)
    want, losses = dense_map(p, f, of, q, targets, fixed, c)
    assert np.allclose([[*r.r, *r.t] for r in got.orderBy("g").collect()], want, atol=1e-8)
    assert [r["stage"] for r in log] == [0, 1, 2] and log[-1]["chamfer_l1"] > 0
    for k, value in losses.items():
        assert log[-1][k] == pytest.approx(value, rel=1e-6), k


def test_mapper_without_terms_and_with_targets_alone(spark):
    p, f = grid(3)
    mesh = tables(spark, p, f)
    same = fit.GroupMapper(mesh).map(outer=1, first_inner=1, decay=0.0)
    assert np.allclose([(r.x, r.y, r.z) for r in same.orderBy("vid").collect()], p)
    up = spark.createDataFrame([(i, float(p[i][0]), float(p[i][1]), float(p[i][2]) + 1) for i in range(9)], "vid long, x double, y double, z double")
    mapper = fit.GroupMapper(mesh).add_group(1, mesh[0].select("vid")).add_targets(up)
    out = mapper.map(outer=2, inner=4, lr=0.05, decay=0.0)
    assert all(r.z > p[r.vid][2] for r in out.collect()) and mapper.log[-1]["target"] < mapper.log[0]["target"]


def test_steps_gather_no_table_of_vertices_at_the_driver(spark, monkeypatch):
    v = spark.range(400).selectExpr("id AS vid", "floor(id / 20) / 19.0D AS x", "id % 20 / 19.0D AS y", "sin(id) AS z")
    f = spark.range(379).selectExpr("id AS fid", "id AS i0", "id + 1 AS i1", "id + 20 AS i2")
    of, points = v.selectExpr("vid", "vid % 7 AS g"), v.withColumnRenamed("vid", "pid")
    monkeypatch.setattr(spatial, "nearest", lambda s, t: s.selectExpr("pid AS qid", "pid AS rid", "0.0D AS d2"))
    matches = objective.matched(points, points)
    flat = directed_laplacian(v, f)
    made = {
        "matches": matches, "laplacian": flat, "links": affine.group_links(of, f.selectExpr("i0 AS e0", "i1 AS e1")),
        "gradient": affine.to_groups(affine.laplacian_gradient(v, f, flat, 400, 1.0), v, of),
        "distance": affine.distance_gradient(v, matches.selectExpr("qid AS vid", "qx", "qy", "qz"), 1.0, 1.0),
        "target": affine.target_gradient(v, v, 400, 1.0),
    }
    sent = {k for k, d in made.items() if "Broadcast" in d._jdf.queryExecution().executedPlan().toString()}
    assert not sent, sent
    posed = constraints.deform(v, of, constraints.identity_groups(of.select("g").distinct()))
    assert posed._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") <= 1  # groups may be
