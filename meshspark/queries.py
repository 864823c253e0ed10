"""Queries of the mesh operators over the test tables, each with the same result in plain SQL.

Names begin with the identifiers of the operator inventory. Fixture tables are derived from
``embeddings`` (see :mod:`meshspark.sources.fixtures`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions.vec import Vec
from .operators import constraints, crop, guard, locate, metrics, objective, refine, spatial, state, topology
from .operators.topology import CORNERS
from .plans import diagnose, fit
from .plans.evaluate import as_points
from .sources import fixtures

TAU = 0.05
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# SQL pieces -------------------------------------------------------------------------------------

_CLOUDS = """
s AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings WHERE label < 5),
t AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings WHERE label >= 5),
st AS (SELECT s.pid AS qid, t.pid AS rid, (s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y)+(s.z-t.z)*(s.z-t.z) AS d2 FROM s, t),
fwd AS (SELECT qid, min(d2) AS d2 FROM st GROUP BY qid), bwd AS (SELECT rid AS qid, min(d2) AS d2 FROM st GROUP BY rid)"""

_W = "w AS (SELECT floor(sqrt(count(*)))::BIGINT AS w FROM embeddings)"


def _field(name: str, component: int, shift: int = 0) -> str:
    return f"""
{name}v AS (SELECT vec_id + {shift} * w * w AS vid, (vec_id // w) / (w - 1)::DOUBLE AS x, (vec_id % w) / (w - 1)::DOUBLE AS y, embedding[{component + 1}]::DOUBLE AS z FROM embeddings, w WHERE vec_id < w * w),
{name}c AS (SELECT i.i AS id, (i.i // (w - 1)) * w + i.i % (w - 1) + {shift} * w * w AS a, w FROM w, (SELECT vec_id AS i FROM embeddings) i WHERE i.i < (w - 1) * (w - 1)),
{name}f AS (SELECT id * 2 + {shift} * 2 * (w - 1) * (w - 1) AS fid, a AS i0, a + 1 AS i1, a + w AS i2 FROM {name}c UNION ALL SELECT id * 2 + 1 + {shift} * 2 * (w - 1) * (w - 1), a + 1, a + w + 1, a + w FROM {name}c)"""


def _tri(name: str, v: str, f: str, more: str = "") -> str:
    cols = ", ".join(f'{k}.{c} AS "{k}{c}"' for k in "abc" for c in "xyz")
    return f"{name} AS (SELECT fid, i0, i1, i2, {cols}{more} FROM {f} JOIN {v} a ON a.vid = i0 JOIN {v} b ON b.vid = i1 JOIN {v} c ON c.vid = i2)"


_MESH = f"{_W}, {_field('m', 0)}"
_TARGET = _field("g", 1)
_SHELL = _MESH + "," + _field("n", 2, 1) + ",\nv AS (SELECT * FROM mv UNION ALL SELECT * FROM nv), f AS (SELECT * FROM mf UNION ALL SELECT * FROM nf), " + _tri("tri", "v", "f")
_EDGES = "fe AS (SELECT fid, 0 AS k, least(i0,i1) AS e0, greatest(i0,i1) AS e1 FROM mf UNION ALL SELECT fid, 1, least(i1,i2), greatest(i1,i2) FROM mf UNION ALL SELECT fid, 2, least(i2,i0), greatest(i2,i0) FROM mf), e AS (SELECT DISTINCT e0, e1 FROM fe)"
_ADJ = "adj AS (SELECT fid AS fa, fb FROM (SELECT fid, lead(fid) OVER (PARTITION BY e0, e1 ORDER BY fid) AS fb FROM fe) WHERE fb IS NOT NULL)"


def _dot(a: str, b: str) -> str:
    return "(" + "+".join(f"({a.replace('#', c)})*({b.replace('#', c)})" for c in "xyz") + ")"


_LINKED = "(a.i0=b.i0 OR a.i0=b.i1 OR a.i0=b.i2 OR a.i1=b.i0 OR a.i1=b.i1 OR a.i1=b.i2 OR a.i2=b.i0 OR a.i2=b.i1 OR a.i2=b.i2)"


def _boxes(a: str = "a", b: str = "b") -> str:
    lo = lambda t, c: f'least({t}.a{c},{t}."b{c}",{t}.c{c})'
    hi = lambda t, c: f'greatest({t}.a{c},{t}."b{c}",{t}.c{c})'
    return " AND ".join(f"{lo(a, c)} <= {hi(b, c)} AND {lo(b, c)} <= {hi(a, c)}" for c in "xyz")


def _cross_row(p: str, q: str, tri: str) -> str:
    """det, u, v, t of segment p-q (column patterns) and a triangle's columns."""
    e1 = {c: f'({tri}."b{c}"-{tri}.a{c})' for c in "xyz"}
    e2 = {c: f"({tri}.c{c}-{tri}.a{c})" for c in "xyz"}
    d = {c: f"({q.replace('#', c)}-{p.replace('#', c)})" for c in "xyz"}
    s = {c: f"({p.replace('#', c)}-{tri}.a{c})" for c in "xyz"}
    x = lambda a, b: {"x": f"({a['y']}*{b['z']}-{a['z']}*{b['y']})", "y": f"({a['z']}*{b['x']}-{a['x']}*{b['z']})", "z": f"({a['x']}*{b['y']}-{a['y']}*{b['x']})"}
    dot = lambda a, b: "(" + "+".join(f"{a[c]}*{b[c]}" for c in "xyz") + ")"
    h, qq = x(d, e2), x(s, e1)
    det = dot(e1, h)
    return det, f"((1.0::DOUBLE/{det})*{dot(s, h)})", f"((1.0::DOUBLE/{det})*{dot(d, qq)})", f"((1.0::DOUBLE/{det})*{dot(e2, qq)})"


def _penetrates(one: str, two: str) -> str:
    tests = []
    for edge, tri in ((one, two), (two, one)):
        for p, q in (("a", "b"), ("b", "c"), ("c", "a")):
            det, u, v, t = _cross_row(f'{edge}."{p}#"', f'{edge}."{q}#"', tri)
            tests.append(f"(abs({det}) > 1e-12 AND {u} > 0 AND {v} > 0 AND {u}+{v} < 1 AND {t} > 0 AND {t} < 1)")
    return " OR ".join(tests)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _r(c, n: int = 6):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


# frames and clouds ------------------------------------------------------------------------------


@query("SELECT (min(l_quantity)+max(l_quantity))/2.0 AS cx, (min(l_discount)+max(l_discount))/2.0 AS cy, (min(l_tax)+max(l_tax))/2.0 AS cz, greatest(max(l_quantity)-min(l_quantity), max(l_discount)-min(l_discount), max(l_tax)-min(l_tax)) AS length FROM lineitem")
def agg1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return metrics.bounds(points)


@query(f"""WITH {_CLOUDS}, b AS (SELECT (min(x)+max(x))/2.0 AS cx, (min(y)+max(y))/2.0 AS cy, (min(z)+max(z))/2.0 AS cz, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS l FROM t)
SELECT pid, round((x-cx)*(0.9::DOUBLE/l), 9) AS x, round((y-cy)*(0.9::DOUBLE/l), 9) AS y, round((z-cz)*(0.9::DOUBLE/l), 9) AS z FROM s, b""")
def prj3_target_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = fixtures.clouds(spark, sf_dir)
    center, scale, _ = metrics.frame(t)
    moved = G.to_frame(Vec.of(), center, scale)
    return s.select("pid", *[_r(getattr(moved, c), 9).alias(c) for c in "xyz"])


@query(f"""WITH {_CLOUDS},
a AS (SELECT avg(d2) AS fit_error_l2, avg(sqrt(d2)) AS fit_error_l1, avg((d2 < {TAU}::DOUBLE*{TAU}::DOUBLE)::INT::DOUBLE) AS p FROM fwd),
b AS (SELECT avg(d2) AS cov_error_l2, avg(sqrt(d2)) AS cov_error_l1, avg((d2 < {TAU}::DOUBLE*{TAU}::DOUBLE)::INT::DOUBLE) AS r FROM bwd)
SELECT round(fit_error_l2,9) AS fit_error_l2, round(fit_error_l1,9) AS fit_error_l1, round(p,9) AS "precision", round(cov_error_l2,9) AS cov_error_l2, round(cov_error_l1,9) AS cov_error_l1, round(r,9) AS recall,
round(fit_error_l2+cov_error_l2,9) AS chamfer_l2, round(fit_error_l1+cov_error_l1,9) AS chamfer_l1, round(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0 END,9) AS f1 FROM a, b""")
def met3_chamfer_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = metrics.evaluate_points(*fixtures.clouds(spark, sf_dir), TAU)
    return row.select(*[_r(c, 9).alias(c) for c in row.columns])


@query(f"WITH {_CLOUDS} SELECT qid, rid, round(d2, 9) AS d2, nth FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, rid)::INT AS nth FROM st) WHERE nth <= 4")
def jn3_nearest_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = fixtures.clouds(spark, sf_dir)
    return spatial.nearest(s, t, 4).select("qid", "rid", _r("d2", 9).alias("d2"), "nth")


@query(f"WITH {_CLOUDS} SELECT qid, rid, round(d2, 9) AS d2, nth FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, rid)::INT AS nth FROM st) WHERE nth <= 2")
def jn2_nearest_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join without a broadcast: cells of growing size until every result is certain."""
    s, t = fixtures.clouds(spark, sf_dir)
    return spatial.nearest(s, t, 2, broadcast_rows=0).select("qid", "rid", _r("d2", 9).alias("d2"), "nth")


@query(f"""WITH {_CLOUDS}, m AS (SELECT qid, rid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, rid) AS n FROM st) WHERE n = 1),
j AS (SELECT m.rid AS pid, 2*(s.x-t.x) AS gx, 2*(s.y-t.y) AS gy, 2*(s.z-t.z) AS gz FROM m JOIN s ON s.pid = qid JOIN t ON t.pid = rid)
SELECT pid, round(-sum(gx),9) AS gx, round(-sum(gy),9) AS gy, round(-sum(gz),9) AS gz FROM j GROUP BY pid""")
def jn4_chamfer_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g = objective.chamfer_gradient(*fixtures.clouds(spark, sf_dir))
    return g.select("pid", *[_r(f"g{c}", 9).alias(f"g{c}") for c in "xyz"])


@query(f"""WITH {_CLOUDS} SELECT round(coalesce(avg(d2) FILTER (d2 < 0.0025::DOUBLE), avg(d2)),9) AS fit, (SELECT round(coalesce(avg(d2) FILTER (d2 < 0.0025::DOUBLE), avg(d2)),9) FROM bwd) AS coverage FROM fwd""")
def obj3_masked_chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = objective.symmetric_chamfer(*fixtures.clouds(spark, sf_dir), most=0.05)
    return row.select(_r("fit", 9).alias("fit"), _r("coverage", 9).alias("coverage"))


_BOXES = [{"name": "low", "center": (-0.1, 0.0, 0.0), "edge": (0.3, 2.0, 2.0), "mode": "all"}, {"name": "high", "center": (0.1, 0.0, 0.0), "edge": (0.3, 2.0, 2.0), "mode": "all"}]


def _box_sql(name: str, lo: str, hi: str) -> str:
    return f"""SELECT '{name}' AS box, (SELECT round(avg(sqrt(d2)),9) FROM (SELECT min(d2) AS d2 FROM st JOIN s ON s.pid = qid JOIN t ON t.pid = rid WHERE s.x BETWEEN {lo} AND {hi} AND t.x BETWEEN {lo} AND {hi} GROUP BY qid)) AS fit_error_l1,
(SELECT round(avg(sqrt(d2)),9) FROM (SELECT min(d2) AS d2 FROM st JOIN s ON s.pid = qid JOIN t ON t.pid = rid WHERE s.x BETWEEN {lo} AND {hi} AND t.x BETWEEN {lo} AND {hi} GROUP BY rid)) AS cov_error_l1"""


@query(f"WITH {_CLOUDS} {_box_sql('low', '-0.25::DOUBLE', '0.05::DOUBLE')} UNION ALL {_box_sql('high', '-0.05::DOUBLE', '0.25::DOUBLE')}")
def met6_metrics_by_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.evaluate_boxes(*fixtures.clouds(spark, sf_dir), _BOXES, TAU)
    return rows.select("box", _r("fit_error_l1", 9).alias("fit_error_l1"), _r("cov_error_l1", 9).alias("cov_error_l1"))


# topology ---------------------------------------------------------------------------------------


@query(f"WITH {_MESH}, {_EDGES} SELECT e0, e1 FROM e")
def msh1_unique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.unique_edges(fixtures.height_field(spark, sf_dir)[1])


@query(f"WITH {_MESH} SELECT vid, string_agg(fid::VARCHAR, ',' ORDER BY fid) AS fids FROM (SELECT i0 AS vid, fid FROM mf UNION ALL SELECT i1, fid FROM mf UNION ALL SELECT i2, fid FROM mf) GROUP BY vid")
def msh2_vertex_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.vertex_face_lists(fixtures.height_field(spark, sf_dir)[1]).select("vid", F.array_join("fids", ",").alias("fids"))


@query(f"WITH {_MESH}, {_EDGES}, {_ADJ} SELECT fa, fb FROM adj")
def msh3_face_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.face_adjacency(fixtures.height_field(spark, sf_dir)[1])


@query(f"WITH {_MESH}, {_EDGES} SELECT e0, e1 FROM fe GROUP BY e0, e1 HAVING count(*) = 1")
def msh4_boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.boundary_edges(fixtures.height_field(spark, sf_dir)[1])


@query(f"WITH {_MESH}, {_EDGES}, {_ADJ}, b AS (SELECT fa AS u, fb AS v FROM adj UNION SELECT fb, fa FROM adj), r0 AS (SELECT fid FROM mf WHERE fid % 97 = 0), r1 AS (SELECT fid FROM r0 UNION SELECT v FROM b JOIN r0 ON u = fid), r2 AS (SELECT fid FROM r1 UNION SELECT v FROM b JOIN r1 ON u = fid) SELECT fid FROM r2")
def msh5_dilated_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.height_field(spark, sf_dir)[1]
    return topology.dilate(f.where("fid % 97 = 0").select("fid"), topology.face_adjacency(f), 2).toDF("fid")


@query(f"WITH {_MESH}, p AS (SELECT a.fid AS fa, b.fid AS fb FROM mf a JOIN mf b ON b.fid IN (a.fid + 1, a.fid + 2, a.fid + 7)) SELECT fa, fb, {_LINKED} AS shared FROM p JOIN mf a ON a.fid = fa JOIN mf b ON b.fid = fb")
def msh6_shared_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.height_field(spark, sf_dir)[1]
    pairs = f.select(F.col("fid").alias("fa"), F.explode(F.array(F.col("fid") + 1, F.col("fid") + 2, F.col("fid") + 7)).alias("fb"))
    return topology.pairs_sharing_vertex(pairs.join(f.select(F.col("fid").alias("fb")), "fb", "left_semi"), f)


_MASK = "(fid % 7) < 3"


@query(f"""WITH RECURSIVE {_MESH}, {_EDGES}, {_ADJ}, n AS (SELECT fid FROM mf WHERE {_MASK}), b AS (SELECT fa AS u, fb AS v FROM adj WHERE fa IN (FROM n) AND fb IN (FROM n) UNION SELECT fb, fa FROM adj WHERE fa IN (FROM n) AND fb IN (FROM n)),
reach AS (SELECT fid, fid AS label FROM n UNION SELECT b.v, reach.label FROM reach JOIN b ON b.u = reach.fid WHERE reach.label < b.v),
l AS (SELECT fid, min(label) AS label FROM reach GROUP BY fid) SELECT fid, label, count(*) OVER (PARTITION BY label) AS size FROM l""")
def msh7_face_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.height_field(spark, sf_dir)[1]
    return topology.face_components(f.where(_MASK).select("fid"), topology.face_adjacency(f))


@query(f"WITH {_MESH}, {_EDGES}, n AS (SELECT *, row_number() OVER (ORDER BY e0, e1) - 1 AS eid FROM e) SELECT fid, k, eid FROM fe JOIN n USING (e0, e1)")
def msh8_face_edge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.face_edge_index(fixtures.height_field(spark, sf_dir)[1])


@query(f"WITH {_MESH}, {_EDGES} SELECT (SELECT count(*) FROM mv) AS n_vertices, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM mf) AS n_faces, (SELECT count(*) FROM mv) - (SELECT count(*) FROM e) + (SELECT count(*) FROM mf) AS euler")
def msh_euler_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.euler_number(*fixtures.height_field(spark, sf_dir))


@query(f"""WITH {_MESH}, {_EDGES}, s AS (SELECT DISTINCT e0, e1 FROM fe WHERE fid % 11 = 0), m AS (SELECT e0, e1, (SELECT max(vid) FROM mv) + row_number() OVER (ORDER BY e0, e1) AS mid FROM s)
SELECT vid, round(x,9) AS x, round(y,9) AS y, round(z,9) AS z FROM mv UNION ALL SELECT mid, round((a.x+b.x)/2,9), round((a.y+b.y)/2,9), round((a.z+b.z)/2,9) FROM m JOIN mv a ON a.vid = e0 JOIN mv b ON b.vid = e1""")
def msh9_subdivided_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    nv, _ = refine.subdivide(v, f, f.where("fid % 11 = 0").select("fid"))
    return nv.select("vid", *[_r(c, 9).alias(c) for c in "xyz"])


@query(f"""WITH {_MESH}, {_EDGES}, s AS (SELECT DISTINCT e0, e1 FROM fe WHERE fid % 11 = 0), k AS (SELECT fid, count(s.e0) AS n FROM fe LEFT JOIN s USING (e0, e1) GROUP BY fid)
SELECT fid AS parent, n + 1 AS children FROM k""")
def msh9_children_by_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    _, nf = refine.subdivide(v, f, f.where("fid % 11 = 0").select("fid"))
    return nf.groupBy("parent").agg(F.count("*").alias("children"))


_N = _tri("tr", "mv", "mf", ", (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS nz")


@query(f"""WITH {_MESH}, {_N}, q AS (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT unnest([i0,i1,i2]) AS vid, nx, ny, nz FROM tr) GROUP BY vid)
SELECT vid, round(coalesce(nx/(sqrt(nx*nx+ny*ny+nz*nz)+1e-12),0),6) AS nx, round(coalesce(ny/(sqrt(nx*nx+ny*ny+nz*nz)+1e-12),0),6) AS ny, round(coalesce(nz/(sqrt(nx*nx+ny*ny+nz*nz)+1e-12),0),6) AS nz FROM mv LEFT JOIN q USING (vid)""")
def agg2_vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.vertex_normals(*fixtures.height_field(spark, sf_dir)).select("vid", *[_r(f"n{c}").alias(f"n{c}") for c in "xyz"])


@query(f"WITH {_MESH}, {_EDGES} SELECT mv.vid, count(e.e0) AS degree FROM mv LEFT JOIN e ON vid = e0 OR vid = e1 GROUP BY mv.vid")
def agg4_vertex_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    return topology.vertex_degrees(v, topology.unique_edges(f))


@query(f"WITH {_MESH} SELECT fid, round((a.z+b.z+c.z)/3.0,9) AS z FROM mf JOIN mv a ON a.vid=i0 JOIN mv b ON b.vid=i1 JOIN mv c ON c.vid=i2")
def agg5_face_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    return topology.face_means(v, f, "z").select("fid", _r("z", 9).alias("z"))


@query(f"""WITH {_MESH}, d AS (SELECT i0 AS u, i1 AS w FROM mf UNION ALL SELECT i1, i2 FROM mf UNION ALL SELECT i2, i0 FROM mf UNION ALL SELECT i0, i2 FROM mf UNION ALL SELECT i1, i0 FROM mf),
k AS (SELECT u, count(*) AS degree, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM d JOIN mv ON vid = d.w GROUP BY u)
SELECT vid, coalesce(degree,0) AS degree, round(coalesce(degree,0)*x-coalesce(sx,0),6) AS lx, round(coalesce(degree,0)*y-coalesce(sy,0),6) AS ly, round(coalesce(degree,0)*z-coalesce(sz,0),6) AS lz FROM mv LEFT JOIN k ON u = vid""")
def agg11_directed_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.directed_laplacian(*fixtures.height_field(spark, sf_dir)).select("vid", "degree", *[_r(f"l{c}").alias(f"l{c}") for c in "xyz"])


@query(f"WITH {_MESH} SELECT vid, arg_max(fid, k * 10000000 + fid) AS fid FROM (SELECT i0 AS vid, 0 AS k, fid FROM mf UNION ALL SELECT i1, 1, fid FROM mf UNION ALL SELECT i2, 2, fid FROM mf) GROUP BY vid")
def agg12_one_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.one_face(fixtures.height_field(spark, sf_dir)[1])


@query(f"""WITH {_MESH}, {_N} SELECT fid, round(sqrt(nx*nx+ny*ny+nz*nz),9) AS area2, round(nx/(sqrt(nx*nx+ny*ny+nz*nz)+1e-20),6) AS nx, round(nz/(sqrt(nx*nx+ny*ny+nz*nz)+1e-20),6) AS nz, round((az+bz+cz)/3.0,9) AS mz, least(az,bz,cz) AS loz, greatest(az,bz,cz) AS hiz FROM tr""")
def geo13_face_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = topology.face_geometry(*fixtures.height_field(spark, sf_dir))
    return g.select("fid", _r("area2", 9).alias("area2"), _r("nx").alias("nx"), _r("nz").alias("nz"), _r("mz", 9).alias("mz"), "loz", "hiz")


# spatial joins and intersections ----------------------------------------------------------------


@query(f"WITH {_SHELL} SELECT a.fid AS fa, b.fid AS fb FROM tri a JOIN tri b ON a.fid < b.fid AND {_boxes()} WHERE NOT {_LINKED}")
def jn10_box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.face_pairs(*fixtures.double_shell(spark, sf_dir)).select(F.col("a_fid").alias("fa"), F.col("b_fid").alias("fb"))


_HITS = f"WITH {_SHELL}, hit AS (SELECT a.fid AS fa, b.fid AS fb FROM tri a JOIN tri b ON a.fid < b.fid AND {_boxes()} WHERE NOT {_LINKED} AND ({_penetrates('a', 'b')}))"


@query(f"{_HITS} SELECT fa, fb FROM hit")
def msh10_self_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.self_intersections(*fixtures.double_shell(spark, sf_dir))


@query(f"{_HITS}, k AS (SELECT fa AS fid FROM hit UNION SELECT fb FROM hit) SELECT (SELECT count(*) FROM hit) AS n_pairs, (SELECT count(*) FROM k) AS n_faces, round((SELECT count(*) FROM k) / (SELECT count(*) FROM f)::DOUBLE, 9) AS face_fraction")
def agg13_intersection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.double_shell(spark, sf_dir)
    r = metrics.intersection_report(metrics.self_intersections(v, f), f)
    return r.withColumn("face_fraction", _r("face_fraction", 9))


@query(f"{_HITS} SELECT fa, fb FROM hit WHERE fa % 2 = 1 OR fb % 2 = 1")
def jn16_new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersections beyond a baseline, here the pairs of even faces."""
    pairs = topology.saved(metrics.self_intersections(*fixtures.double_shell(spark, sf_dir)))
    return metrics.new_pairs(pairs, pairs.where("fa % 2 = 0 AND fb % 2 = 0"))


def _trajectory(spark: SparkSession, sf_dir: str):
    ref, f = fixtures.height_field(spark, sf_dir, 0)
    goal, _ = fixtures.height_field(spark, sf_dir, 1)
    sheet = fixtures.height_field(spark, sf_dir, 2)
    segs = metrics.trajectories(ref, goal).withColumn("owner_vid", F.lit(None).cast("long"))
    return ref, goal, f, sheet, segs


_DET, _U, _V, _T = _cross_row("p.#", "q.#", "tri")
_SEG = f"""WITH {_MESH},{_TARGET},{_field('h', 2)}, {_tri('tri', 'hv', 'hf')},
hits AS (SELECT p.vid AS sid, fid, {_T} AS t FROM mv p JOIN gv q ON p.vid = q.vid AND p.z <> q.z JOIN tri ON p.x BETWEEN least(ax,bx,cx) AND greatest(ax,bx,cx) AND p.y BETWEEN least(ay,"by",cy) AND greatest(ay,"by",cy)
 WHERE abs({_DET}) >= 1e-9 AND {_U} >= -1e-9 AND {_V} >= -1e-9 AND {_U}+{_V} <= 1+1e-9 AND {_T} BETWEEN -1e-9 AND 1+1e-9)"""


@query(f"{_SEG} SELECT sid, fid, round(t, 6) AS t FROM hits")
def jn14_trajectory_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, sheet, segs = _trajectory(spark, sf_dir)
    return spatial.segment_hits(segs, *sheet).select("sid", "fid", _r("t").alias("t"))


@query(f"{_SEG}, m AS (SELECT sid, min(t) AS t FROM hits GROUP BY sid) SELECT p.vid AS sid, round(t, 6) AS t FROM mv p JOIN gv q ON p.vid = q.vid AND p.z <> q.z LEFT JOIN m ON m.sid = p.vid")
def jn15_earliest_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, sheet, segs = _trajectory(spark, sf_dir)
    return spatial.earliest_hits(segs, spatial.segment_hits(segs, *sheet)).select("sid", _r("t").alias("t"))


@query(f"{_SEG} SELECT count(DISTINCT sid) AS n_vertices, count(DISTINCT fid) AS n_faces, count(*) AS n_pairs, round(min(t),6) AS t_min, count(*) = 0 AS clean FROM hits")
def agg15_trajectory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, sheet, segs = _trajectory(spark, sf_dir)
    return metrics.trajectory_report(spatial.segment_hits(segs, *sheet)).withColumn("t_min", _r("t_min"))


@query(f"{_SEG}, m AS (SELECT sid, min(t) AS t FROM hits GROUP BY sid) SELECT p.vid AS vid, round(CASE WHEN t IS NULL THEN 1 ELSE greatest(least(t - 0.001, 1), 0) END, 6) AS alpha FROM mv p JOIN gv q ON p.vid = q.vid AND p.z <> q.z LEFT JOIN m ON m.sid = p.vid")
def grd3_safe_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, goal, _, (sv, sf), _ = _trajectory(spark, sf_dir)
    apart = 10 * ref.count()  # the sheet's ids are apart from the movers'
    sv, sf = sv.withColumn("vid", F.col("vid") + apart), sf.select("fid", *[(F.col(c) + apart).alias(c) for c in CORNERS])
    return guard.earliest_safe(ref, goal, sv, sf).select("vid", _r("alpha").alias("alpha"))


@query(f"{_SEG}, m AS (SELECT p.vid, min(t) AS t FROM mv p LEFT JOIN hits ON sid = vid GROUP BY p.vid), g AS (SELECT max((t IS NULL)::INT) AS free, max(t) AS best FROM m) SELECT vid, round(coalesce(t, 1), 6) AS alpha FROM m, g WHERE CASE WHEN free = 1 THEN t IS NULL ELSE t >= best * 0.95 END")
def flt7_advancing_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, _, _, sheet, segs = _trajectory(spark, sf_dir)
    first = ref.select("vid").join(spatial.earliest_hits(segs, spatial.segment_hits(segs, *sheet)).select(F.col("sid").alias("vid"), "t"), "vid", "left")
    return guard.advancing_front(first).select("vid", _r("alpha").alias("alpha"))


@query(f"WITH {_MESH}, {_tri('tri', 'mv', 'mf')}, x AS (SELECT greatest(greatest(ax,bx,cx)-least(ax,bx,cx), greatest(ay,\"by\",cy)-least(ay,\"by\",cy), greatest(az,bz,cz)-least(az,bz,cz)) AS e FROM tri) SELECT round(greatest(quantile_cont(e, 0.9), 1e-9), 9) AS cell FROM x WHERE e > 0")
def srt2_cell_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spatial.triangle_boxes(topology.triangles(*fixtures.height_field(spark, sf_dir)))
    return spark.createDataFrame([(spatial.cell_size(boxes, exact=True),)], "cell double").select(_r("cell", 9).alias("cell"))


_INSIDE = " AND ".join(f"{k}.x BETWEEN 0.2 AND 0.7 AND {k}.y BETWEEN 0.2 AND 0.7" for k in "abc")


@query(f"""WITH {_MESH}, k AS (SELECT fid, i0, i1, i2 FROM mf JOIN mv a ON a.vid=i0 JOIN mv b ON b.vid=i1 JOIN mv c ON c.vid=i2 WHERE {_INSIDE}),
u AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS n FROM (SELECT i0 AS vid FROM k UNION SELECT i1 FROM k UNION SELECT i2 FROM k))
SELECT row_number() OVER (ORDER BY fid) - 1 AS fid, a.n AS i0, b.n AS i1, c.n AS i2, fid AS old_fid FROM k JOIN u a ON a.vid = i0 JOIN u b ON b.vid = i1 JOIN u c ON c.vid = i2""")
def flt4_cropped_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = crop.crop(*fixtures.height_field(spark, sf_dir), [{"center": (0.45, 0.45, 0.0), "edge": (0.5, 0.5, 100.0), "mode": "all"}])
    return f


@query("SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.015 AND 0.045 AND l_tax BETWEEN 0.015 AND 0.065")
def geo20_points_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return points.where(G.in_box(Vec.of(), (10.0, 0.015, 0.015), (20.0, 0.045, 0.065)))


# surfaces and localization ----------------------------------------------------------------------


@query()
def jn7_closest_on_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = fixtures.height_field(spark, sf_dir, 0)
    found = spatial.closest_on_mesh(v, *fixtures.height_field(spark, sf_dir, 1))
    return found.select("qid", _r("d2", 9).alias("d2"), *[_r(f"cp_{c}").alias(f"cp_{c}") for c in "xyz"])


@query(f"""WITH {_MESH},{_TARGET}, d AS (SELECT a.vid AS v, b.vid AS t, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM mv a, gv b),
fit AS (SELECT v AS vid, sqrt(min(d2)) AS e FROM d GROUP BY v), near AS (SELECT t, v, d2 FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d2, v) AS n FROM d) WHERE n = 1), cov AS (SELECT v AS vid, max(sqrt(d2)) AS e FROM near GROUP BY v),
fe2 AS (SELECT fid, greatest((a.e+b.e+c.e)/3.0, (coalesce(x.e,0)+coalesce(y.e,0)+coalesce(z.e,0))/3.0) AS err FROM mf JOIN fit a ON a.vid=i0 JOIN fit b ON b.vid=i1 JOIN fit c ON c.vid=i2 LEFT JOIN cov x ON x.vid=i0 LEFT JOIN cov y ON y.vid=i1 LEFT JOIN cov z ON z.vid=i2)
SELECT fid, round(err,6) AS error FROM fe2 WHERE err > greatest({2 * TAU}, (SELECT quantile_cont(err, 0.9) FROM fe2))""")
def loc1_high_error_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir, 0)
    errors = locate.face_error(v, f, as_points(fixtures.height_field(spark, sf_dir, 1)[0]))
    found, _ = locate.high_error(errors, TAU)
    return errors.join(found, "fid", "left_semi").select("fid", _r("error").alias("error"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.centroid_errors(*fixtures.height_field(spark, sf_dir, 0), *fixtures.height_field(spark, sf_dir, 1))


@query()
def loc3_sagging_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.sagging(_errors(spark, sf_dir), 0.005).select("fid", _r("sag").alias("sag"))


@query()
def loc4_ratio_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.ratio_sagging(_errors(spark, sf_dir), 0.005).select("fid", _r("ratio").alias("ratio"))


@query()
def loc5_above_mean_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.above_mean(_errors(spark, sf_dir), 0.005).select("fid", _r("middle").alias("middle"))


@query()
def exp1_sag_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.sag_ladder(_errors(spark, sf_dir), 0.001)


@query()
def jn8_signed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = fixtures.clouds(spark, sf_dir)
    shell = fixtures.height_field(spark, sf_dir, 1)
    return spatial.signed_distance(s, *shell, query_id="pid").select("qid", _r("distance").alias("distance"), _r("winding").alias("winding"))


@query()
def jn9_wall_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.wall_hits(*fixtures.double_shell(spark, sf_dir), 0.5)
    return found.select("fid", "side", "partner", _r("thickness").alias("thickness"))


# series and states ------------------------------------------------------------------------------

_SERIES = "w AS (SELECT event_type AS run_id, ts, event_id, value, row_number() OVER o AS nth, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS prev, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS cur FROM events WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id))"


@query(f"""WITH {_SERIES}, f AS (SELECT *, nth >= 6 AND coalesce((prev-cur)/(abs(prev)+1e-12) < 0.05, false) AS flat FROM w), g AS (SELECT *, sum((NOT flat)::INT) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
h AS (SELECT *, sum(flat::INT) OVER (PARTITION BY run_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS flats FROM g)
SELECT run_id, event_id, round(prev,6) AS prev, round(cur,6) AS cur, flat, flats::BIGINT AS flats, flats >= 2 AS plateaued FROM h""")
def win1_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = state.plateau(fixtures.history(spark, sf_dir), by=["run_id"], order=["ts", "event_id"])
    return p.select("run_id", "event_id", _r("prev").alias("prev"), _r("cur").alias("cur"), "flat", "flats", "plateaued")


@query("""SELECT event_type AS run_id, max_by(event_id, ts) AS event_id, round(max_by(value, ts), 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY event_type""")
def exp4_last_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fixtures.history(spark, sf_dir).withColumn("step", F.struct("ts", "event_id"))
    return state.last_steps(h, values=["event_id", "value"]).select("run_id", "event_id", _r("value").alias("value"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice > 1e-9 THEN 100.0::DOUBLE * (1.0::DOUBLE - (l_extendedprice * (1 - l_discount)) / l_extendedprice) ELSE 0 END, 6) AS clip_pct FROM lineitem""")
def exp2_clip_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("intended"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("actual"))
    return state.clip_percent(h).select("l_orderkey", "l_linenumber", _r("clip_pct").alias("clip_pct"))


@query(f"""WITH {_MESH}, st AS (SELECT vid, abs(z) AS resid, abs(z) * 0.5 AS intended, CASE WHEN vid % 3 = 0 THEN 0.0 ELSE abs(z) * 0.4 END AS actual FROM mv)
SELECT vid, true AS optimizable, CASE WHEN intended > 0.02 * {TAU} AND resid > {TAU} AND (actual < 0.02 * {TAU} OR actual < 0.1 * intended) THEN 1 ELSE 0 END::INT AS blocked_count, round(resid, 9) AS resid_prev FROM st""")
def sta2_state_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = fixtures.height_field(spark, sf_dir)
    moves = v.select("vid", F.abs("z").alias("resid"), (F.abs("z") * 0.5).alias("intended"), F.when(F.col("vid") % 3 == 0, 0.0).otherwise(F.abs("z") * 0.4).alias("actual"))
    return state.next_state(state.initial_state(v), moves, TAU).select("vid", "optimizable", "blocked_count", _r("resid_prev", 9).alias("resid_prev"))


# objectives, constraints, moves -----------------------------------------------------------------


@query(f"WITH {_MESH}, {_EDGES} SELECT round(avg((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 9) AS loss FROM e JOIN mv a ON a.vid = e0 JOIN mv b ON b.vid = e1")
def obj5_edge_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    return objective.edge_laplacian(v, topology.unique_edges(f)).select(_r("loss", 9).alias("loss"))


@query(f"WITH {_MESH}, {_EDGES}, b AS (SELECT e0 AS u, e1 AS v FROM e UNION ALL SELECT e1, e0 FROM e), n AS (SELECT count(*) AS n FROM e), g AS (SELECT u, sum(p.z-q.z) AS gz FROM b JOIN mv p ON p.vid = u JOIN mv q ON q.vid = v GROUP BY u) SELECT u AS vid, round(gz*(2.0::DOUBLE/n), 9) AS gz FROM g, n")
def obj5_edge_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    return objective.edge_laplacian_gradient(v, topology.unique_edges(f)).select("vid", _r("gz", 9).alias("gz"))


@query(f"WITH {_MESH},{_TARGET} SELECT round(avg((abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z))/3.0), 9) AS loss FROM mv a JOIN gv b USING (vid) WHERE vid % 5 = 0")
def obj8_target_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = fixtures.height_field(spark, sf_dir)
    t, _ = fixtures.height_field(spark, sf_dir, 1)
    return objective.target_l1(v, t.where("vid % 5 = 0")).select(_r("loss", 9).alias("loss"))


@query(f"WITH {_MESH}, g AS (SELECT vid, max_by(gid, seq) AS gid FROM (SELECT vid, 3 AS gid, 0 AS seq FROM mv WHERE vid % 10 = 0 UNION ALL SELECT vid, 5, 1 FROM mv WHERE vid % 15 = 0) GROUP BY vid) SELECT mv.vid, coalesce(gid, 6 + mv.vid)::BIGINT AS group_id FROM mv LEFT JOIN g ON g.vid = mv.vid")
def con4_vertex_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = fixtures.height_field(spark, sf_dir)
    groups = constraints.VertexGroups()
    groups.add(3, v.where("vid % 10 = 0"))
    groups.add(5, v.where("vid % 15 = 0"))
    return groups.of(v)


@query(f"WITH {_MESH} SELECT vid, CASE WHEN vid % 6 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS x FROM mv WHERE vid % 2 = 0 OR vid % 6 = 0")
def con3_fixed_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = fixtures.height_field(spark, sf_dir)
    fixed = constraints.FixedVertices()
    for step, x in ((2, 1.0), (6, 2.0)):
        fixed.add(v.where(F.col("vid") % step == 0).select("vid", F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    return fixed.get().select("vid", "x")


@query(f"WITH {_CLOUDS} SELECT pid, round(x*least(0.1::DOUBLE/(sqrt(x*x+y*y+z*z)+1e-20),1),9) AS x, round(z*least(0.1::DOUBLE/(sqrt(x*x+y*y+z*z)+1e-20),1),9) AS z FROM s")
def prj4_clamped_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = fixtures.clouds(spark, sf_dir)
    v = G.clamp_norm(Vec.of(), 0.1)
    return s.select("pid", _r(v.x, 9).alias("x"), _r(v.z, 9).alias("z"))


@query()
def opt14_self_aware_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir, 0)
    out = fit.self_aware_step(v, f, fixtures.height_field(spark, sf_dir, 1))
    return out.select("vid", *[_r(c).alias(c) for c in ("x", "y", "z", "alpha")])


@query()
def opt1_rigid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix that brings a turned and shifted copy of a cloud back to it."""
    _, t = fixtures.clouds(spark, sf_dir)
    turn = np.array([[0.99875026, -0.04997917, 0.0, 0.01], [0.04997917, 0.99875026, 0.0, -0.02], [0.0, 0.0, 1.0, 0.03], [0, 0, 0, 1]])
    m = fit.icp(fit.transformed(t, turn), t, threshold=0.5, rounds=10)
    return spark.createDataFrame([(i, *[float(x) for x in row]) for i, row in enumerate(m)], "row int, m0 double, m1 double, m2 double, m3 double")


@query()
def grd7_pin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New intersections that a gate leaves behind: none."""
    v, f = fixtures.double_shell(spark, sf_dir)
    rest = v.withColumn("z", F.when(F.col("vid") < v.count() / 2, F.lit(0.0)).otherwise(F.lit(0.2)))
    base = topology.saved(metrics.self_intersections(rest, f))
    moved = v.select("vid", "x", "y", (F.col("z") * 0.6 + F.when(F.col("vid") < v.count() / 2, 0.0).otherwise(0.2)).alias("z"))
    now, pinned = guard.pin_gate(rest, moved, f, topology.unique_edges(f), base)
    left = metrics.new_pairs(metrics.self_intersections(now, f), base)
    return left.agg(F.count("*").alias("n_new_pairs")).crossJoin(pinned.agg(F.count("*").alias("n_pinned")))



@query("""WITH s AS (SELECT vec_id, embedding FROM embeddings WHERE label < 5), t AS (SELECT vec_id, embedding FROM embeddings WHERE label >= 5),
d AS (SELECT s.vec_id AS qid, t.vec_id AS rid, list_sum(list_transform(list_zip(s.embedding, t.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d2 FROM s, t)
SELECT qid, rid, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, rid) AS n FROM d) WHERE n = 1""")
def jn5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.embeddings(spark, sf_dir)
    s = e.where("label < 5").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("v"))
    t = e.where("label >= 5").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("v"))
    return spatial.nearest_vectors(s, t).select("qid", "rid", _r("d2").alias("d2"))


@query("""WITH s AS (SELECT vec_id, embedding FROM embeddings WHERE label < 5), t AS (SELECT vec_id, embedding FROM embeddings WHERE label >= 5),
d AS (SELECT s.vec_id AS qid, t.vec_id AS rid, list_sum(list_transform(list_zip(s.embedding, t.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d2 FROM s, t)
SELECT qid, rid, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, rid) AS n FROM d) WHERE n = 1""")
def jn5_nearest_vectors_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.embeddings(spark, sf_dir)
    s = e.where("label < 5").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("v"))
    t = e.where("label >= 5").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("v"))
    return spatial.nearest_vectors(s, t).select("qid", "rid", _r("d2").alias("d2"))


@query(f"WITH {_MESH},{_TARGET}, d AS (SELECT a.vid AS v, b.vid AS t, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM mv a, gv b) SELECT v AS vid, round(sqrt(min(d2)), 9) AS error FROM d GROUP BY v")
def agg6_fit_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = fixtures.height_field(spark, sf_dir, 0)
    return locate.fit_error(v, as_points(fixtures.height_field(spark, sf_dir, 1)[0])).select("vid", _r("error", 9).alias("error"))


@query(f"""WITH {_MESH},{_TARGET}, d AS (SELECT a.vid AS v, b.vid AS t, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM mv a, gv b),
n AS (SELECT t, v, d2 FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d2, v) AS n FROM d) WHERE n = 1) SELECT mv.vid, round(coalesce(max(sqrt(d2)), 0), 9) AS error FROM mv LEFT JOIN n ON n.v = mv.vid GROUP BY mv.vid""")
def agg7_coverage_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = fixtures.height_field(spark, sf_dir, 0)
    return locate.coverage_error(v, as_points(fixtures.height_field(spark, sf_dir, 1)[0])).select("vid", _r("error", 9).alias("error"))


@query(f"{_SEG} SELECT w AS t_lo, count(t) FILTER (t >= w) AS n, round(min(t) FILTER (t >= w), 6) AS t_min FROM hits, (VALUES (0.0::DOUBLE), (1e-8::DOUBLE), (1e-6::DOUBLE), (1e-4::DOUBLE)) x(w) GROUP BY w")
def exp5_crossings_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, sheet, segs = _trajectory(spark, sf_dir)
    return diagnose.crossings_by_window(spatial.segment_hits(segs, *sheet)).withColumn("t_min", _r("t_min"))


@query(f"WITH {_MESH} SELECT fid, avg(b) < 0.02 * {TAU} AS plateau, avg(o) > 0.5 AS blocked, max(l)::INT AS last_refine FROM (SELECT fid, vid, (vid % 4)::DOUBLE * 0.0005 AS b, (vid % 3 = 0)::INT AS o, vid % 5 AS l FROM (SELECT fid, unnest([i0, i1, i2]) AS vid FROM mf)) GROUP BY fid")
def agg9_face_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    s = state.initial_state(v).withColumns({"resid_drop_ema": (F.col("vid") % 4).cast("double") * 0.0005, "optimizable": F.col("vid") % 3 != 0, "last_refine": (F.col("vid") % 5).cast("int")})
    return state.face_state(s, f, TAU)


@query(f"WITH {_MESH}, {_EDGES}, g AS (SELECT vid, CASE WHEN vid % 2 = 0 THEN 1 ELSE 2 + vid END AS gid FROM mv), k AS (SELECT gid, row_number() OVER (ORDER BY gid) - 1 AS g FROM (SELECT DISTINCT gid FROM g)) SELECT e0, e1, a.g AS g0, b.g AS g1 FROM e JOIN g x ON x.vid = e0 JOIN g y ON y.vid = e1 JOIN k a ON a.gid = x.gid JOIN k b ON b.gid = y.gid WHERE a.g <> b.g")
def msh12_group_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    groups = constraints.VertexGroups()
    groups.add(1, v.where("vid % 2 = 0"))
    return topology.group_edges(groups.of(v), topology.unique_edges(f))


@query(f"{_HITS}, k AS (SELECT fa AS fid FROM hit UNION SELECT fb FROM hit), n AS (SELECT * FROM hit WHERE fa % 2 = 1 OR fb % 2 = 1) SELECT (SELECT count(*) FROM hit) AS total_pairs, (SELECT count(*) FROM k) AS total_faces, (SELECT count(*) FROM n) AS new_pairs, (SELECT count(*) FROM (SELECT fa FROM n UNION SELECT fb FROM n)) AS new_faces")
def agg14_compared_to_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = topology.saved(metrics.self_intersections(*fixtures.double_shell(spark, sf_dir)))
    return metrics.compared_to_baseline(pairs, pairs.where("fa % 2 = 0 AND fb % 2 = 0"))


@query()
def exp5f_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the interval test and by strict penetration."""
    return diagnose.predicates(*fixtures.double_shell(spark, sf_dir))


@query()
def src6_surface_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import mesh_files

    m = fixtures.height_field(spark, sf_dir)
    return mesh_files.sample_points(mesh_files.surface_samples(*m, 2000, 1), *m).select("pid", *[_r(c).alias(c) for c in "xyz"])
