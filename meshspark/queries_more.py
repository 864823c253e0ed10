"""More queries of the mesh operators, and SQL for those that :mod:`meshspark.queries` leaves without.

Surface distances in SQL take the least of a triangle's plane, where the foot lies inside, and its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions.vec import Vec
from .operators import constraints, crop, guard, locate, metrics, objective, refine, spatial, state, topology
from .operators.topology import CORNERS
from .plans.evaluate import as_points
from .queries import _ADJ, _EDGES, _HITS, _LINKED, _MESH, _SEG, _SHELL, _TARGET, ORACLE_SQL, TAU, _cross_row, _r, _tri, _trajectory, query
from .sources import fixtures

# SQL pieces -------------------------------------------------------------------------------------


def _v(pattern: str) -> dict[str, str]:
    return {c: pattern.replace("#", c) for c in "xyz"}


def _minus(a: dict, b: dict) -> dict:
    return {c: f"({a[c]}-{b[c]})" for c in "xyz"}


def _dot(a: dict, b: dict) -> str:
    return "(" + "+".join(f"{a[c]}*{b[c]}" for c in "xyz") + ")"


def _cross(a: dict, b: dict) -> dict:
    return {"x": f"({a['y']}*{b['z']}-{a['z']}*{b['y']})", "y": f"({a['z']}*{b['x']}-{a['x']}*{b['z']})", "z": f"({a['x']}*{b['y']}-{a['y']}*{b['x']})"}


def _closest(name: str, points: str, key: str, tri: str) -> str:
    """CTEs that end in ``name`` (key, d2, cpx, cpy, cpz, fid): the closest of the triangles ``tri`` to each point."""
    p, (a, b, c) = _v("p.#"), (_v(f't."{k}#"') for k in "abc")
    parts = []
    for i, (u, w) in enumerate(((a, b), (b, c), (c, a))):
        parts.append(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_dot(_minus(p, u), _minus(w, u))}/({_dot(_minus(w, u), _minus(w, u))}+1e-20))) AS s{i}")
    n = _cross(_minus(b, a), _minus(c, a))
    parts.append(f"{_dot(_cross(_minus(b, a), _minus(p, a)), n)}/{_dot(n, n)} AS gg")
    parts.append(f"{_dot(_cross(_minus(p, a), _minus(c, a)), n)}/{_dot(n, n)} AS bb")
    on = [{x: f't."{u}{x}"+s{i}*(t."{w}{x}"-t."{u}{x}")' for x in "xyz"} for i, (u, w) in enumerate(("ab", "bc", "ca"))]
    face = {x: f't.a{x}+bb*(t."b{x}"-t.a{x})+gg*(t.c{x}-t.a{x})' for x in "xyz"}
    row = lambda at: "{'d2': " + "+".join(f"(({at[x]})-p.{x})*(({at[x]})-p.{x})" for x in "xyz") + ", " + ", ".join(f"'{x}': {at[x]}" for x in "xyz") + "}"
    best = "least(" + ", ".join(row(o) for o in on) + f", CASE WHEN bb >= 0 AND gg >= 0 AND bb + gg <= 1 THEN {row(face)} END)"
    return f"""{name}_s AS (SELECT p.{key} AS key, t.fid, {', '.join(parts)} FROM {points} p, {tri} t),
{name}_m AS (SELECT s.key, min({{'m': {best}, 'fid': s.fid}}) AS m FROM {name}_s s JOIN {points} p ON p.{key} = s.key JOIN {tri} t ON t.fid = s.fid GROUP BY s.key),
{name} AS (SELECT key, m.m.d2 AS d2, m.m.x AS cpx, m.m.y AS cpy, m.m.z AS cpz, m.fid AS fid FROM {name}_m)"""


_G = _tri("gt", "gv", "gf")
_CE = f"""{_MESH},{_TARGET}, {_G}, {_closest('cl', 'mv', 'vid', 'gt')},
mid AS (SELECT fid, (a.x+b.x+c.x)/3.0 AS x, (a.y+b.y+c.y)/3.0 AS y, (a.z+b.z+c.z)/3.0 AS z FROM mf JOIN mv a ON a.vid=i0 JOIN mv b ON b.vid=i1 JOIN mv c ON c.vid=i2), {_closest('cm', 'mid', 'fid', 'gt')},
ce AS (SELECT mf.fid, sqrt(a.d2) AS d0, sqrt(b.d2) AS d1, sqrt(c.d2) AS d2v, sqrt(m.d2) AS middle FROM mf JOIN cl a ON a.key=i0 JOIN cl b ON b.key=i1 JOIN cl c ON c.key=i2 JOIN cm m ON m.key=mf.fid),
sg AS (SELECT *, greatest(middle-(d0+d1+d2v)/3.0, 0) AS sag, middle/greatest((d0+d1+d2v)/3.0, 0.25*0.005) AS ratio FROM ce)"""

ORACLE_SQL["jn7_closest_on_mesh"] = f"WITH {_MESH},{_TARGET}, {_G}, {_closest('cl', 'mv', 'vid', 'gt')} SELECT key AS qid, round(d2,9) AS d2, round(cpx,6) AS cp_x, round(cpy,6) AS cp_y, round(cpz,6) AS cp_z FROM cl"
ORACLE_SQL["loc3_sagging_faces"] = f"WITH {_CE} SELECT fid, round(sag,6) AS sag FROM sg WHERE sag > 0.005 AND middle > 0.005"
ORACLE_SQL["loc4_ratio_faces"] = f"WITH {_CE} SELECT fid, round(ratio,6) AS ratio FROM sg WHERE ratio > 1.2 AND middle > 0.005"
ORACLE_SQL["loc5_above_mean_faces"] = f"WITH {_CE} SELECT fid, round(middle,6) AS middle FROM ce WHERE middle > (SELECT avg(middle) FROM ce)"
ORACLE_SQL["exp1_sag_ladder"] = f"""WITH {_CE}, k AS (SELECT unnest([1,2,3,4,6,8,12,16,24,32])::INT AS k) SELECT k, count(*) FILTER (sag > k*0.001) AS n_sag, count(*) FILTER (sag > k*0.001 AND middle > k*0.001) AS n_both,
100.0::DOUBLE*count(*) FILTER (sag > k*0.001)/count(*) AS pct_sag FROM sg, k GROUP BY k"""

_P, _ABC = _v("p.#"), [_v(f't."{k}#"') for k in "abc"]
_A, _B, _C = (_minus(k, _P) for k in _ABC)
_LEN = [f"sqrt({_dot(k, k)})" for k in (_A, _B, _C)]
_ANGLE = f"2.0*atan2({_dot(_A, _cross(_B, _C))}, {_LEN[0]}*{_LEN[1]}*{_LEN[2]}+{_dot(_A, _B)}*{_LEN[2]}+{_dot(_B, _C)}*{_LEN[0]}+{_dot(_C, _A)}*{_LEN[1]})"
_CLOUD = "s AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings WHERE label < 5)"
ORACLE_SQL["jn8_signed_distance"] = f"""WITH {_MESH},{_TARGET}, {_CLOUD}, {_G}, {_closest('cl', 's', 'pid', 'gt')}, wn AS (SELECT p.pid, sum({_ANGLE})/(4*3.141592653589793::DOUBLE) AS w FROM s p, gt t GROUP BY p.pid)
SELECT key AS qid, round(CASE WHEN w > 0.5 THEN -sqrt(d2) ELSE sqrt(d2) END, 6) AS distance, round(w, 6) AS winding FROM cl JOIN wn ON pid = key"""

_WD, _WU, _WV, _WT = _cross_row("r.p#", "r.q#", "tri")
_NRM = _cross(_minus(_v('"b#"'), _v("a#")), _minus(_v("c#"), _v("a#")))
def _wall(most: float) -> str:
    return f"""WITH {_SHELL}, ee AS (SELECT DISTINCT least(u,w) AS e0, greatest(u,w) AS e1 FROM (SELECT i0 AS u, i1 AS w FROM f UNION ALL SELECT i1, i2 FROM f UNION ALL SELECT i2, i0 FROM f)),
eps AS (SELECT 0.05::DOUBLE*quantile_cont(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 0.5) AS e FROM ee JOIN v a ON a.vid = e0 JOIN v b ON b.vid = e1),
nn AS (SELECT fid, (ax+"bx"+cx)/3.0 AS mx, (ay+"by"+cy)/3.0 AS my, (az+"bz"+cz)/3.0 AS mz, {', '.join(f'{_NRM[c]} AS n{c}' for c in 'xyz')} FROM tri),
un AS (SELECT fid, mx, my, mz, {', '.join(f'n{c}/(sqrt(nx*nx+ny*ny+nz*nz)+1e-20) AS n{c}' for c in 'xyz')} FROM nn),
r AS (SELECT fid AS face, side, {', '.join(f'm{c}+n{c}*side*e AS p{c}, m{c}+n{c}*side*(e+{most}) AS q{c}' for c in 'xyz')} FROM un, eps, (SELECT unnest([1.0::DOUBLE, -1.0]) AS side)),
wh AS (SELECT face, side, tri.fid, {_WT}*{most} AS thickness FROM r JOIN tri ON tri.fid <> face AND {' AND '.join(f'least(p{c},q{c}) <= greatest(a{c},"b{c}",c{c}) AND greatest(p{c},q{c}) >= least(a{c},"b{c}",c{c})' for c in 'xyz')}
 WHERE abs({_WD}) >= 1e-9 AND {_WU} >= -1e-9 AND {_WV} >= -1e-9 AND {_WU}+{_WV} <= 1+1e-9 AND {_WT} BETWEEN -1e-9 AND 1+1e-9),
wall AS (SELECT face AS fid, arg_min(side, thickness) AS side, arg_min(fid, thickness) AS partner, min(thickness) AS thickness FROM wh WHERE thickness < {most} GROUP BY face)"""


_WALL = _wall(0.5)
ORACLE_SQL["jn9_wall_thickness"] = f"{_wall(0.5)} SELECT fid, side, partner, round(thickness,6) AS thickness FROM wall"


def _two(spark: SparkSession, sf_dir: str):
    """Source and target height fields."""
    return fixtures.height_field(spark, sf_dir, 0), fixtures.height_field(spark, sf_dir, 1)


# walls and candidates ---------------------------------------------------------------------------


@query(f"{_WALL}, pr AS (SELECT DISTINCT least(fid,partner) AS fa, greatest(fid,partner) AS fb FROM wall) SELECT fa, fb FROM pr JOIN f a ON a.fid = fa JOIN f b ON b.fid = fb WHERE NOT {_LINKED}")
def jn9_wall_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.wall_pairs(*fixtures.double_shell(spark, sf_dir), 0.5)


@query(f"{_WALL} SELECT f.fid, round(least(coalesce(thickness, 9.0), 9.0),6) AS thickness, coalesce(side, 0.0) AS side FROM f LEFT JOIN wall ON wall.fid = f.fid")
def jn9_face_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.face_thickness(*fixtures.double_shell(spark, sf_dir), 0.5)
    return found.select("fid", _r(F.least("thickness", F.lit(9.0))).alias("thickness"), "side")


@query(f"""{_WALL}, ev AS (SELECT unnest([i0,i1,i2]) AS vid, f.fid FROM f), vs AS (SELECT ev.vid, min(thickness) AS t, sum(nx*coalesce(side,0)) AS sx, sum(ny*coalesce(side,0)) AS sy, sum(nz*coalesce(side,0)) AS sz FROM ev LEFT JOIN wall ON wall.fid = ev.fid JOIN un ON un.fid = ev.fid GROUP BY ev.vid)
SELECT v.vid, round(coalesce(t, 9.0),6) AS thickness, round(coalesce(sx/(sqrt(sx*sx+sy*sy+sz*sz)+1e-20),0),5) AS dx, round(coalesce(sz/(sqrt(sx*sx+sy*sy+sz*sz)+1e-20),0),5) AS dz FROM v LEFT JOIN vs ON vs.vid = v.vid""")
def agg8_vertex_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.vertex_thickness(*fixtures.double_shell(spark, sf_dir), 0.5)
    return found.select("vid", _r(F.least("thickness", F.lit(9.0))).alias("thickness"), _r("dx", 5).alias("dx"), _r("dz", 5).alias("dz"))


_NEARBOX = " AND ".join(f'least(a.a{c},a."b{c}",a.c{c})-0.02::DOUBLE <= greatest(b.a{c},b."b{c}",b.c{c})+0.02::DOUBLE AND least(b.a{c},b."b{c}",b.c{c})-0.02::DOUBLE <= greatest(a.a{c},a."b{c}",a.c{c})+0.02::DOUBLE' for c in "xyz")


@query(f"WITH {_SHELL} SELECT a.fid AS fa, b.fid AS fb FROM tri a JOIN tri b ON a.fid < b.fid AND {_NEARBOX} WHERE NOT {_LINKED}")
def jn12_collision_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.collision_candidates(*fixtures.double_shell(spark, sf_dir), 0.02)


_CG = {c: f'(a.a{c}+a."b{c}"+a.c{c}-b.a{c}-b."b{c}"-b.c{c})/3.0' for c in "xyz"}


@query(f"""WITH {_SHELL}, cm AS (SELECT fid, i0, i1, i2, (ax+"bx"+cx)/3.0 AS x, (ay+"by"+cy)/3.0 AS y, (az+"bz"+cz)/3.0 AS z, sqrt(greatest({', '.join('+'.join(f'("{k}{c}"-(a{c}+"b{c}"+c{c})/3.0)*("{k}{c}"-(a{c}+"b{c}"+c{c})/3.0)' for c in 'xyz') for k in 'abc')})) AS r FROM tri),
kn AS (SELECT a.fid AS q, b.fid AS p, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM cm a, cm b), k9 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS n FROM kn) WHERE n <= 9 AND q <> p)
SELECT DISTINCT least(q,p) AS fa, greatest(q,p) AS fb FROM k9 JOIN cm a ON a.fid = q JOIN cm b ON b.fid = p WHERE sqrt(d2) < a.r + b.r + 0.01 AND NOT {_LINKED}""")
def jn11_knn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.knn_collision_candidates(*fixtures.double_shell(spark, sf_dir), 8, 0.01)


@query(f"{_SEG} SELECT p.vid AS sid, p.vid IN (SELECT sid FROM hits) AS crosses FROM mv p JOIN gv q ON p.vid = q.vid AND p.z <> q.z")
def jn14_crossing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, sheet, segs = _trajectory(spark, sf_dir)
    return spatial.crossing_segments(segs, *sheet)


_GN = "gn AS (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT unnest([i0,i1,i2]) AS vid, " + ", ".join(f"{_NRM[c]} AS n{c}" for c in "xyz") + " FROM gt) GROUP BY vid), gu AS (SELECT vid, " + ", ".join(f"n{c}/(sqrt(nx*nx+ny*ny+nz*nz)+1e-12) AS n{c}" for c in "xyz") + " FROM gn)"
_NEAR = "dd AS (SELECT a.vid AS v, b.vid AS t, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM mv a, gv b), nr AS (SELECT v, t, d2 FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY d2, t) AS n FROM dd) WHERE n = 1)"


@query(f"WITH {_MESH},{_TARGET}, {_G}, {_GN}, {_GN.replace('gn', 'mn').replace('gu', 'mu').replace('gt', 'mt')}, {_NEAR} SELECT v AS vid, t AS tid, round(d2,9) AS d2, (d2 < 0.0025::DOUBLE AND m.nx*g.nx+m.ny*g.ny+m.nz*g.nz > 0.5)::INT::DOUBLE AS weight FROM nr JOIN mu m ON m.vid = v JOIN gu g ON g.vid = t".replace(f"{_G},", f"{_G}, {_tri('mt', 'mv', 'mf')},"))
def jn17_gated_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v, f), (tv, tf) = _two(spark, sf_dir)
    target = spatial.normals_of(tv, tf).withColumnRenamed("vid", "pid")
    return spatial.gated_matches(spatial.normals_of(v, f), target, 0.05, 0.5).select("vid", "tid", _r("d2", 9).alias("d2"), "weight")


# masks and motion -------------------------------------------------------------------------------

_MOTION = "mo AS (SELECT vid, abs(g.z-m.z) AS d FROM mv m JOIN gv g USING (vid))"


@query(f"WITH {_MESH},{_TARGET}, {_MOTION} SELECT vid FROM (SELECT vid, row_number() OVER (ORDER BY d DESC, vid) AS n FROM mo WHERE d > {TAU}) WHERE n <= 40")
def flt2_most_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v, _), (t, _) = _two(spark, sf_dir)
    return locate.moved(t, v, TAU, 40)


@query(f"WITH {_MESH},{_TARGET}, {_EDGES}, {_ADJ}, {_MOTION}, far AS (SELECT vid FROM mo WHERE d > 0.25), h AS (SELECT fid FROM mf WHERE i0 IN (FROM far) OR i1 IN (FROM far) OR i2 IN (FROM far)) SELECT fid FROM h UNION SELECT fb FROM adj WHERE fa IN (FROM h) UNION SELECT fa FROM adj WHERE fb IN (FROM h)")
def flt1_active_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v, f), (t, _) = _two(spark, sf_dir)
    return locate.active_faces(t, v, f, 0.25, topology.face_adjacency(f))


_IN2 = " OR ".join("(" + " AND ".join(f"{k}.x BETWEEN {lo} AND {hi} AND {k}.y BETWEEN 0.1 AND 0.6" for k in "abc") + ")" for lo, hi in (("0.05", "0.4"), ("0.61", "0.99")))


@query(f"""WITH {_MESH}, k AS (SELECT fid, i0, i1, i2 FROM mf JOIN mv a ON a.vid=i0 JOIN mv b ON b.vid=i1 JOIN mv c ON c.vid=i2 WHERE {_IN2}), u AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS n FROM (SELECT i0 AS vid FROM k UNION SELECT i1 FROM k UNION SELECT i2 FROM k))
SELECT row_number() OVER (ORDER BY fid) - 1 AS fid, a.n AS i0, b.n AS i1, c.n AS i2, fid AS old_fid FROM k JOIN u a ON a.vid = i0 JOIN u b ON b.vid = i1 JOIN u c ON c.vid = i2""")
def flt5_cropped_to_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop to a union of boxes given as tuples and as settings."""
    boxes = crop.normalized_boxes([((0.225, 0.35, 0.0), (0.35, 0.5, 100.0)), {"center": (0.8, 0.35, 0.0), "edge": (0.38, 0.5, 100.0)}])
    return crop.crop(*fixtures.height_field(spark, sf_dir), boxes)[1]


@query(f"WITH {_MESH}, b AS (SELECT vid FROM mv WHERE (x-0.5)*2.0 BETWEEN -0.5 AND 0.5 AND (y-0.25)*2.0 BETWEEN -0.25 AND 0.75) SELECT vid FROM b")
def flt9_points_in_frame_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box that is moved into a frame keeps the points that it keeps outside."""
    box = crop.in_frame({"name": "b", "center": (0.5, 0.375, 0.0), "edge": (0.5, 0.5, 1000.0)}, (0.5, 0.25, 0.0), 2.0)
    v, _ = fixtures.height_field(spark, sf_dir)
    at = G.to_frame(Vec.of(), (0.5, 0.25, 0.0), 2.0)
    return crop.crop_points(v.select("vid", *at.named()), box).select("vid")


@query(f"WITH {_MESH}, {_EDGES}, {_ADJ}, b AS (SELECT fa AS u, fb AS v FROM adj UNION SELECT fb, fa FROM adj), p AS (SELECT a.fid AS fa, c.fid AS fb FROM mf a JOIN mf c ON c.fid IN (a.fid + 1, a.fid + 2, a.fid + 5)), r1 AS (SELECT fid AS o, fid AS w FROM mf UNION SELECT u, v FROM b), r2 AS (SELECT o, w FROM r1 UNION SELECT o, v FROM r1 JOIN b ON u = r1.w) SELECT fa, fb FROM p ANTI JOIN r2 ON o = fa AND r2.w = fb")
def flt6_pairs_beyond_two_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.height_field(spark, sf_dir)[1]
    pairs = f.select(F.col("fid").alias("fa"), F.explode(F.array(F.col("fid") + 1, F.col("fid") + 2, F.col("fid") + 5)).alias("fb")).join(f.select(F.col("fid").alias("fb")), "fb", "left_semi")
    return topology.within_hops(pairs.select("fa", "fb"), topology.face_adjacency(f), 2)


@query(f"WITH RECURSIVE {_MESH}, {_EDGES}, bd AS (SELECT e0, e1 FROM fe GROUP BY e0, e1 HAVING count(*) = 1), n AS (SELECT e0 AS u, e1 AS w FROM bd UNION SELECT e1, e0 FROM bd), reach AS (SELECT u AS vid, u AS l FROM n UNION SELECT n.w, reach.l FROM reach JOIN n ON n.u = reach.vid WHERE reach.l < n.w) SELECT vid, min(l) AS loop FROM reach GROUP BY vid")
def msh4_boundary_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.boundary_loops(fixtures.height_field(spark, sf_dir)[1])


@query(f"WITH {_MESH}, {_EDGES}, m0 AS (SELECT vid FROM mv WHERE vid % 61 = 0), b AS (SELECT e0 AS u, e1 AS v FROM e UNION SELECT e1, e0 FROM e), m1 AS (SELECT vid FROM m0 UNION SELECT v FROM b WHERE u IN (FROM m0)), m2 AS (SELECT vid FROM m1 UNION SELECT v FROM b WHERE u IN (FROM m1)) SELECT vid FROM m2")
def msh5b_dilated_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    return topology.dilate(v.where("vid % 61 = 0").select("vid"), topology.unique_edges(f), 2).toDF("vid")


# refinement -------------------------------------------------------------------------------------

#: Children of a face by the bits of its split edges; 0 to 2 are corners, 3 to 5 midpoints of edges (0,1), (1,2), (2,0).
_CUTS = {
    0: [(0, 1, 2)], 1: [(0, 3, 2), (3, 1, 2)], 2: [(1, 4, 0), (4, 2, 0)], 4: [(2, 5, 1), (5, 0, 1)], 3: [(3, 1, 4), (0, 3, 4), (0, 4, 2)], 6: [(4, 2, 5), (1, 4, 5), (1, 5, 0)],
    5: [(5, 0, 3), (2, 5, 3), (2, 3, 1)], 7: [(0, 3, 5), (3, 1, 4), (5, 4, 2), (3, 4, 5)],
}
_CHILDREN = "CASE code " + " ".join(f"WHEN {k} THEN [" + ", ".join("[" + ", ".join(("i0", "i1", "i2", "m0", "m1", "m2")[x] for x in child) + "]" for child in v) + "]" for k, v in _CUTS.items()) + " END"


@query(f"""WITH {_MESH}, {_EDGES}, s AS (SELECT DISTINCT e0, e1 FROM fe WHERE fid % 11 = 0 OR fid % 17 = 3), m AS (SELECT e0, e1, (SELECT max(vid) FROM mv) + row_number() OVER (ORDER BY e0, e1) AS mid FROM s),
o AS (SELECT fid, max(mid) FILTER (k = 0) AS m0, max(mid) FILTER (k = 1) AS m1, max(mid) FILTER (k = 2) AS m2 FROM fe JOIN m USING (e0, e1) GROUP BY fid),
c AS (SELECT mf.fid AS parent, {_CHILDREN} AS ch FROM (SELECT mf.*, m0, m1, m2, (m0 IS NOT NULL)::INT + 2*(m1 IS NOT NULL)::INT + 4*(m2 IS NOT NULL)::INT AS code FROM mf LEFT JOIN o USING (fid)) mf),
k AS (SELECT parent, unnest(ch) AS t, generate_subscripts(ch, 1) AS nth FROM c) SELECT row_number() OVER (ORDER BY parent, nth) - 1 AS fid, parent, t[1] AS i0, t[2] AS i1, t[3] AS i2 FROM k""")
def msh9_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child face with its corners, for faces with one, two and three split edges."""
    v, f = fixtures.height_field(spark, sf_dir)
    return refine.subdivide(v, f, f.where("fid % 11 = 0 OR fid % 17 = 3").select("fid"))[1].select("fid", "parent", *CORNERS)


@query(f"""WITH {_MESH}, {_EDGES}, st AS (SELECT vid, vid % 3 <> 0 AS o, vid % 4 AS b, abs(z) AS p, abs(z)*0.5 AS m, vid % 5 AS l FROM mv)
SELECT e0 * 100000 + e1 AS vid, a.o OR c.o AS optimizable, CASE WHEN a.o OR c.o THEN 0 ELSE round_even((a.b+c.b)/2.0, 0)::INT END AS blocked_count, round((a.p+c.p)/2,9) AS resid_prev, round((a.m+c.m)/2,9) AS resid_drop_ema, ceil((a.l+c.l)/2.0)::INT AS last_refine FROM e JOIN st a ON a.vid = e0 JOIN st c ON c.vid = e1""")
def sta3_midpoint_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    held = v.select("vid", (F.col("vid") % 3 != 0).alias("optimizable"), (F.col("vid") % 4).cast("int").alias("blocked_count"), F.abs("z").alias("resid_prev"), (F.abs("z") * 0.5).alias("resid_drop_ema"), (F.col("vid") % 5).cast("int").alias("last_refine"))
    out = state.midpoint_state(held, topology.unique_edges(f).withColumn("vid", F.col("e0") * 100000 + F.col("e1")))
    return out.select("vid", "optimizable", "blocked_count", _r("resid_prev", 9).alias("resid_prev"), _r("resid_drop_ema", 9).alias("resid_drop_ema"), F.col("last_refine").cast("int").alias("last_refine"))


@query(f"WITH {_MESH}, {_EDGES}, b AS (SELECT e0 AS u, e1 AS v FROM e UNION ALL SELECT e1, e0 FROM e) SELECT u AS vid, round(sum(z),9) AS z FROM b JOIN mv ON vid = v GROUP BY u")
def agg3_neighbour_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    return topology.neighbour_sums(v, topology.unique_edges(f), ["z"]).select("vid", _r("z", 9).alias("z"))


@query(f"WITH {_MESH}, {_EDGES}, b AS (SELECT e0 AS u, e1 AS v FROM e UNION ALL SELECT e1, e0 FROM e), g AS (SELECT u, avg(z) AS m FROM b JOIN mv ON vid = v GROUP BY u) SELECT vid, round(z + 0.5*(m - z),9) AS z FROM mv JOIN g ON u = vid")
def opt6_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    return guard.smooth(v, topology.unique_edges(f)).select("vid", _r("z", 9).alias("z"))


@query(f"WITH {_MESH}, st AS (SELECT abs(z) AS e, CASE WHEN vid % 4 = 1 THEN 1 ELSE 0 END AS w FROM mv) SELECT round(avg(e) FILTER (w > 0),9) AS mean_error, round(max(e) FILTER (w > 0),9) AS max_error FROM st")
def agg10_step_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = fixtures.height_field(spark, sf_dir)
    out = state.step_fit_error(v.select(F.abs("z").alias("error"), F.when(F.col("vid") % 4 == 1, 1.0).otherwise(0.0).alias("weight")))
    return out.select(_r("mean_error", 9).alias("mean_error"), _r("max_error", 9).alias("max_error"))


# moves ------------------------------------------------------------------------------------------


@query(f"{_SEG}, m AS (SELECT sid, min(t) AS t FROM hits GROUP BY sid) SELECT p.vid AS vid, CASE WHEN t IS NULL THEN 1.0 ELSE greatest(ceil(greatest(t,0)*64.0)-1, 0)/64.0 END::DOUBLE AS alpha FROM mv p JOIN gv q ON p.vid = q.vid AND p.z <> q.z LEFT JOIN m ON m.sid = p.vid")
def grd2_largest_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, goal, sv, sf = _apart(spark, sf_dir)
    return guard.largest_safe(ref, goal, sv, sf)


@query(f"{_SEG}, m AS (SELECT sid, min(t) AS t FROM hits GROUP BY sid) SELECT p.vid AS vid, round(CASE WHEN t IS NULL THEN 1 ELSE greatest(least(t - 0.01::DOUBLE/abs(q.z-p.z), 1), 0) END, 6) AS alpha FROM mv p JOIN gv q ON p.vid = q.vid AND p.z <> q.z LEFT JOIN m ON m.sid = p.vid")
def grd5_safe_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, goal, sv, sf = _apart(spark, sf_dir)
    return guard.earliest_safe(ref, goal, sv, sf, clearance=0.01, distance=True).select("vid", _r("alpha").alias("alpha"))


def _apart(spark: SparkSession, sf_dir: str):
    """Moves from one field to another, and a sheet whose vertex ids are apart from the movers'."""
    ref, goal, _, (sv, sf), _ = _trajectory(spark, sf_dir)
    apart = 10 * ref.count()
    return ref, goal, sv.withColumn("vid", F.col("vid") + apart), sf.select("fid", *[(F.col(c) + apart).alias(c) for c in CORNERS])


@query(f"WITH {_MESH},{_TARGET} SELECT vid, round(m.z + (g.z - m.z) * (vid % 5)/4.0,9) AS z FROM mv m JOIN gv g USING (vid)")
def prj6_at_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v, _), (t, _) = _two(spark, sf_dir)
    return guard.at_fraction(v, t, v.select("vid", ((F.col("vid") % 5) / 4.0).alias("alpha"))).select("vid", _r("z", 9).alias("z"))


@query(f"WITH {_MESH},{_TARGET} SELECT vid, round(abs(g.z-m.z),9) AS motion FROM mv m JOIN gv g USING (vid)")
def prj7_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v, _), (t, _) = _two(spark, sf_dir)
    both = v.select("vid", *Vec.of().named("p")).join(t.select("vid", *Vec.of().named("q")), "vid")
    return both.select("vid", _r((Vec.of("q") - Vec.of("p")).norm(), 9).alias("motion"))


@query(f"WITH {_MESH},{_TARGET}, e AS (SELECT vid, m.x, m.z, g.z AS pz, greatest((g.z-m.z)*0.6 - 0.01::DOUBLE, 0) AS e FROM mv m JOIN gv g USING (vid)) SELECT vid, round(x - 0.8::DOUBLE*e,9) AS x, round(pz - 0.6::DOUBLE*e,9) AS z FROM e")
def prj11_inward_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v, _), (t, _) = _two(spark, sf_dir)
    both = v.select("vid", *Vec.of().named("p")).join(t.select("vid", *Vec.of().named("q")), "vid")
    out = G.inward_cap(Vec.of("q"), Vec.of("p"), Vec.lit(0.8, 0.0, 0.6), F.lit(0.01))
    return both.select("vid", _r(out.x, 9).alias("x"), _r(out.z, 9).alias("z"))


@query(f"WITH {_MESH},{_TARGET}, b AS (SELECT (min(z)+max(z))/2.0 AS c, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS l FROM mv) SELECT vid, round((z-c)*(0.9::DOUBLE/l),9) AS inside, round(z,9) AS back FROM mv, b")
def prj2_self_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh in its own frame and back."""
    v, _ = fixtures.height_field(spark, sf_dir)
    center, scale, _ = metrics.frame(v)
    inside = G.to_frame(Vec.of(), center, scale)
    return v.select("vid", _r(inside.z, 9).alias("inside"), _r(G.from_frame(inside, center, scale).z, 9).alias("back"))


# distances --------------------------------------------------------------------------------------

_SG = "p AS (SELECT vid, m.x, m.y, m.z, g.z AS gz FROM mv m JOIN gv g USING (vid)), sg AS (SELECT a.vid, a.x AS px, a.y AS py, a.z AS pz, b.x AS ax, b.y AS ay, b.z AS az, c.x AS cx, c.y AS cy, c.gz AS cz FROM p a JOIN p b ON b.vid = a.vid + 3 JOIN p c ON c.vid = a.vid + 40)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vertex beside the segment from the third vertex after it to the fortieth's target."""
    (v, _), (t, _) = _two(spark, sf_dir)
    b = v.select((F.col("vid") - 3).alias("vid"), *Vec.of().named("a"))
    c = t.select((F.col("vid") - 40).alias("vid"), *Vec.of().named("c"))
    return v.select("vid", *Vec.of().named("p")).join(b, "vid").join(c, "vid")


@query(f"WITH {_MESH},{_TARGET}, {_SG}, s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px-ax)*(cx-ax)+(py-ay)*(cy-ay)+(pz-az)*(cz-az))/((cx-ax)*(cx-ax)+(cy-ay)*(cy-ay)+(cz-az)*(cz-az)+1e-20))) AS s FROM sg) SELECT vid, round(ax+s*(cx-ax),9) AS x, round(az+s*(cz-az),9) AS z FROM s")
def geo2_closest_on_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = G.closest_on_segment(Vec.of("p"), Vec.of("a"), Vec.of("c"))
    return _segments(spark, sf_dir).select("vid", _r(at.x, 9).alias("x"), _r(at.z, 9).alias("z"))


@query(f"WITH {_MESH}, {_tri('tri', 'mv', 'mf')} SELECT fid, round(sqrt(greatest({', '.join('+'.join(f'({k}{c}-(a{c}+bb{c}+c{c})/3.0)*({k}{c}-(a{c}+bb{c}+c{c})/3.0)' for c in 'xyz') for k in ('a', 'bb', 'c'))})),9) AS radius, least(fid, (fid*7) % 1000) * 100000 + greatest(fid, (fid*7) % 1000) AS key FROM (SELECT *, bx AS bbx, \"by\" AS bby, bz AS bbz FROM tri)")
def geo16_radius_and_pair_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    tri = topology.triangles(*fixtures.height_field(spark, sf_dir))
    return tri.select("fid", _r(G.bounding_radius(*topology.corners()), 9).alias("radius"), G.pair_key(F.col("fid"), (F.col("fid") * 7) % 1000, 100000).alias("key"))


@query(f"WITH {_MESH} SELECT vid, round((1+z)*sin(radians(y*180))*cos(radians(x*360)),9) AS x, round((1+z)*sin(radians(y*180))*sin(radians(x*360)),9) AS y, round((1+z)*cos(radians(y*180)),9) AS z FROM mv")
def vis2_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = fixtures.height_field(spark, sf_dir)
    at = G.spherical(1 + F.col("z"), F.col("x") * 360, F.col("y") * 180)
    return v.select("vid", *[_r(getattr(at, c), 9).alias(c) for c in "xyz"])


def _views() -> str:
    rows = []
    for axis, (u, w) in {"x": "yz", "y": "xz", "z": "xy"}.items():
        far = f"greatest(0.5*greatest(s{u},s{w})*1.5/tan(radians(30.0::DOUBLE)), 0.8*sqrt(sx*sx+sy*sy+sz*sz))"
        for sign in "+-":
            rows.append(f"SELECT '{sign}{axis}' AS \"view\", round({far},9) AS distance, " + ", ".join(f"round(m{c}{f'{sign}{far}' if c == axis else ''},9) AS e{c}" for c in "xyz") + " FROM b")
    return " UNION ALL ".join(rows)


@query(f"WITH {_CLOUD}, b AS (SELECT {', '.join(f'max({c})-min({c}) AS s{c}, (max({c})+min({c}))/2.0 AS m{c}' for c in 'xyz')} FROM s) {_views()}")
def vis3_camera_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = constraints.camera_poses(fixtures.clouds(spark, sf_dir)[0])
    return out.select("view", *[_r(c, 9).alias(c) for c in ("distance", "ex", "ey", "ez")])


@query(f"WITH {_MESH}, {_EDGES}, st AS (SELECT unnest([e0, e1]) AS vid, abs(a.z-b.z) AS s FROM e JOIN mv a ON a.vid = e0 JOIN mv b ON b.vid = e1), q AS (SELECT vid, sum(s) AS s FROM st GROUP BY vid) SELECT vid, round((s-(SELECT min(s) FROM q))/(SELECT max(s)-min(s) FROM q),9) AS value FROM q")
def vis4_stiffness_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    z = lambda e: v.select(F.col("vid").alias(e), F.col("z").alias(f"{e}z"))
    edges = topology.unique_edges(f).join(z("e0"), "e0").join(z("e1"), "e1").select("e0", "e1", F.abs(F.col("e0z") - F.col("e1z")).alias("stiffness"))
    return constraints.stiffness_colors(v, edges).select("vid", _r("value", 9).alias("value"))


@query(f"WITH {_MESH},{_TARGET}, {_NEAR} SELECT round(sqrt(max(d2)),9) AS farthest FROM nr WHERE v % 9 = 0")
def vis5_farthest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v, _), (t, _) = _two(spark, sf_dir)
    return constraints.farthest_target(v, v.where("vid % 9 = 0"), as_points(t)).select(_r("farthest", 9).alias("farthest"))


# losses -----------------------------------------------------------------------------------------


@query(f"WITH {_MESH},{_TARGET} SELECT round(sum((m.z-g.z)*(m.z-g.z)) FILTER ((m.z-g.z)*(m.z-g.z) < 0.0016::DOUBLE),9) AS loss FROM mv m JOIN gv g USING (vid)")
def obj1_masked_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v, _), (t, _) = _two(spark, sf_dir)
    pairs = v.select("vid", *Vec.of().named("p")).join(t.select("vid", *Vec.of().named("q")), "vid")
    return objective.masked_sum(pairs).select(_r("loss", 9).alias("loss"))


@query(f"WITH {_MESH},{_TARGET}, {_G}, {_GN}, {_NEAR}, a AS (SELECT d2, (m.x-g.x)*u.nx+(m.y-g.y)*u.ny+(m.z-g.z)*u.nz AS s FROM nr JOIN mv m ON m.vid = v JOIN gv g ON g.vid = t JOIN gu u ON u.vid = t) SELECT round(avg(s*s) FILTER (d2 < 0.01::DOUBLE),9) AS loss FROM a")
def obj4_point_to_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v, _), (tv, tf) = _two(spark, sf_dir)
    target = spatial.normals_of(tv, tf).withColumnRenamed("vid", "pid")
    return objective.point_to_plane(as_points(v), target, 0.1).select(_r("loss", 9).alias("loss"))


def _lap(name: str, v: str) -> str:
    return f"""{name}k AS (SELECT u, count(*) AS d, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM ld JOIN {v} ON vid = ld.w GROUP BY u), {name} AS (SELECT vid, coalesce(d,0)*x-coalesce(sx,0) AS lx, coalesce(d,0)*y-coalesce(sy,0) AS ly, coalesce(d,0)*z-coalesce(sz,0) AS lz FROM {v} LEFT JOIN {name}k ON u = vid)"""


@query(f"WITH {_MESH},{_TARGET}, ld AS (SELECT i0 AS u, i1 AS w FROM mf UNION ALL SELECT i1, i2 FROM mf UNION ALL SELECT i2, i0 FROM mf UNION ALL SELECT i0, i2 FROM mf UNION ALL SELECT i1, i0 FROM mf), {_lap('la', 'mv')}, {_lap('lb', 'gv')} SELECT round(avg(((a.lx-b.lx)*(a.lx-b.lx)+(a.ly-b.ly)*(a.ly-b.ly)+(a.lz-b.lz)*(a.lz-b.lz))/3.0),6) AS loss FROM la a JOIN lb b USING (vid)")
def obj6_laplacian_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v, f), (t, _) = _two(spark, sf_dir)
    return objective.laplacian(t, f, topology.directed_laplacian(v, f)).select(_r("loss").alias("loss"))


@query(f"WITH {_MESH}, {_EDGES} SELECT round(sum(204.0*(a.z-b.z)*(a.z-b.z)),6) AS rotation, round(sum((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)),6) AS translation FROM e JOIN mv a ON a.vid = e0 JOIN mv b ON b.vid = e1")
def obj7_stiffness(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.height_field(spark, sf_dir)
    groups = v.select(F.col("vid").alias("g"), F.array(*[F.col("z") * float(i) for i in range(9)]).alias("r"), F.array("x", "y", "z").alias("t"))
    out = objective.stiffness(groups, topology.unique_edges(f).toDF("g0", "g1"))
    return out.select(_r("rotation").alias("rotation"), _r("translation").alias("translation"))


@query(f"WITH {_SHELL}, pr AS (SELECT 0.05::DOUBLE - ((b.az+b.bz+b.cz)-(a.az+a.bz+a.cz))/3.0 AS s FROM tri a JOIN tri b ON b.fid = a.fid + (SELECT 2*(w-1)*(w-1) FROM w)) SELECT round(sum(greatest(s,0)*greatest(s,0))/greatest(count(*) FILTER (s > 0),1),9) AS loss FROM pr")
def obj10_sheet_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.double_shell(spark, sf_dir)
    half = f.count() // 2
    pairs = f.where(F.col("fid") < half).select(F.col("fid").alias("fa"), (F.col("fid") + half).alias("fb"), F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(1.0).alias("uz"), F.lit(0.05).alias("margin"))
    return objective.sheet_barrier(pairs, v, f).select(_r("loss", 9).alias("loss"))


_FN = "(SELECT fid, " + ", ".join(f"{_NRM[c]} AS n{c}" for c in "xyz") + " FROM {})"


@query(f"""WITH {_MESH},{_TARGET}, {_tri('mt', 'mv', 'mf')}, {_tri('gt', 'gv', 'mf')}, a AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM {_FN.format('mt')}), b AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM {_FN.format('gt')}),
j AS (SELECT greatest(0.5::DOUBLE - (a.nx*b.nx+a.ny*b.ny+a.nz*b.nz)/((a.l+1e-20)*(b.l+1e-20)), 0) AS t, greatest(0.9::DOUBLE*a.l - b.l, 0)/(a.l+1e-20) AS s FROM a JOIN b USING (fid)) SELECT round(avg(t*t),9) AS flip_loss, round(avg(s*s),9) AS area_loss FROM j""")
def obj11_inversion_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v, f), (t, _) = _two(spark, sf_dir)
    reference = topology.face_geometry(v, f).select("fid", "nx", "ny", "nz", "area2")
    out = objective.inversion_barrier(t, f, reference, flip=0.5, part=0.9)
    return out.select(_r("flip_loss", 9).alias("flip_loss"), _r("area_loss", 9).alias("area_loss"))


# constraints ------------------------------------------------------------------------------------

_TURN = (0.6, -0.8, 0.0, 0.8, 0.6, 0.0, 0.0, 0.0, 1.0)


def _posed(spark: SparkSession, sf_dir: str):
    v, _ = fixtures.height_field(spark, sf_dir)
    of = v.select("vid", (F.col("vid") % 7).alias("g"))
    step = F.col("g").cast("double")
    groups = constraints.identity_groups(of.select("g").distinct()).select("g", F.when(F.col("g") % 2 == 1, F.array(*[F.lit(x) for x in _TURN])).otherwise(F.col("r")).alias("r"), F.array(step, step * 0.5, F.lit(0.25)).alias("t"))
    return v, of, groups


_POSED = "po AS (SELECT vid, CASE WHEN vid % 7 % 2 = 1 THEN 0.6*x-0.8*y ELSE x END + vid % 7 AS x, CASE WHEN vid % 7 % 2 = 1 THEN 0.8*x+0.6*y ELSE y END + (vid % 7)*0.5 AS y, z + 0.25 AS z FROM mv)"


@query(f"WITH {_MESH}, {_POSED} SELECT vid, round(x,9) AS x, round(y,9) AS y, round(z,9) AS z FROM po")
def prj5_group_deform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.deform(*_posed(spark, sf_dir)).select("vid", *[_r(c, 9).alias(c) for c in "xyz"])


@query(f"WITH {_MESH}, {_POSED}, o AS (SELECT vid % 7 AS g, arg_max(1.0::DOUBLE - x, vid) AS dx, arg_max(2.0::DOUBLE - y, vid) AS dy, arg_max(3.0::DOUBLE - z, vid) AS dz FROM po WHERE vid IN (8, 15, 23) GROUP BY vid % 7) SELECT vid, round(x+coalesce(dx,0),9) AS x, round(y+coalesce(dy,0),9) AS y, round(z+coalesce(dz,0),9) AS z FROM po LEFT JOIN o ON g = vid % 7")
def con8_snapped_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, of, groups = _posed(spark, sf_dir)
    fixed = v.where("vid IN (8, 15, 23)").select("vid", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    return constraints.deform(v, of, constraints.snap_landmarks(v, of, groups, fixed)).select("vid", *[_r(c, 9).alias(c) for c in "xyz"])


@query(f"WITH {_SHELL}, pr AS (SELECT a.fid AS fa, b.fid AS fb, {', '.join(f'-({_CG[c]}) AS d{c}' for c in 'xyz')} FROM tri a JOIN tri b ON a.fid < b.fid AND {_NEARBOX} WHERE NOT {_LINKED}) SELECT fa, fb, round(dx/(sqrt(dx*dx+dy*dy+dz*dz)+1e-20),6) AS ux, round(dz/(sqrt(dx*dx+dy*dy+dz*dz)+1e-20),6) AS uz FROM pr")
def con9_sheet_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.sheet_pairs(*fixtures.double_shell(spark, sf_dir), 0.02).select("fa", "fb", _r("ux").alias("ux"), _r("uz").alias("uz"))


@query(f"""{_WALL}, pr AS (SELECT DISTINCT least(fid,partner) AS fa, greatest(fid,partner) AS fb FROM wall), ax AS (SELECT a.fid AS fa, b.fid AS fb, {', '.join(f'-({_CG[c]}) AS d{c}' for c in 'xyz')} FROM pr JOIN tri a ON a.fid = fa JOIN tri b ON b.fid = fb WHERE NOT {_LINKED})
SELECT fa, fb, round(dz/(sqrt(dx*dx+dy*dy+dz*dz)+1e-20),6) AS uz, round(greatest(least(0.02::DOUBLE, 0.9*sqrt(dx*dx+dy*dy+dz*dz)),0),9) AS margin FROM ax""")
def con10_sheet_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.sheet_constraints(*fixtures.double_shell(spark, sf_dir), 0.5, 0.02).select("fa", "fb", _r("uz").alias("uz"), _r("margin", 9).alias("margin"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings WHERE label < 5 UNION ALL SELECT vec_id, embedding[1]::DOUBLE FROM embeddings WHERE label < 2")
def con1_target_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point sets that add up; here ids stand in for heights to tell rows apart."""
    e = fixtures.embeddings(spark, sf_dir).select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("vec_id").cast("double").alias("z"))
    held = constraints.TargetPoints()
    for most in (5, 2, 0):
        held.add(e.where(F.col("label") < most))
    return held.get().select(F.col("z").cast("long").alias("vec_id"), "x")


@query(f"WITH {_MESH} SELECT vid, z FROM mv WHERE vid % 3 = 0 UNION ALL SELECT vid, z + 1 FROM mv WHERE vid % 9 = 0")
def con2_target_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = fixtures.height_field(spark, sf_dir)
    held = constraints.TargetVertices()
    held.add(v.where("vid % 3 = 0"))
    held.add(v.where("vid % 9 = 0").withColumn("z", F.col("z") + 1))
    return held.get().select("vid", "z")


@query(f"WITH {_MESH}, a AS (SELECT vid AS seq, z FROM mv WHERE vid % 2 = 0 UNION ALL SELECT vid + 1000, z FROM mv WHERE vid % 5 = 0) SELECT seq, z FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS n FROM a) WHERE n <= 150")
def set6_capped_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = fixtures.height_field(spark, sf_dir)
    old = v.where("vid % 2 = 0").select(F.col("vid").alias("seq"), "z")
    return constraints.capped_append(old, v.where("vid % 5 = 0").select((F.col("vid") + 1000).alias("seq"), "z"), 150)


# series and diagnoses ---------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_type AS run_id, count(*) AS n, arg_min(value, event_id) AS r0, arg_max(value, event_id) AS r1 FROM events GROUP BY event_type), d AS (SELECT *, CASE WHEN n > 1 AND r0 > 0 AND r1 > 0 THEN 1 - pow(r1/r0, 1.0::DOUBLE/(n-1)) END AS rate FROM e)
SELECT run_id, n, round(rate,9) AS rate, round(CASE WHEN rate > 0 AND rate < 1 THEN ln(1.0::DOUBLE/r0)/ln(1-rate) + 1 END,3) AS steps FROM d""")
def exp3_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.decay(fixtures.history(spark, sf_dir), step="event_id")
    return out.select("run_id", "n", _r("rate", 9).alias("rate"), _r("steps", 3).alias("steps"))


@query(f"{_HITS}, d AS (SELECT sqrt({'+'.join(f'({_CG[c]})*({_CG[c]})' for c in 'xyz')}) AS d FROM hit JOIN tri a ON a.fid = fa JOIN tri b ON b.fid = fb) SELECT round(avg(d),9) AS mean, round(quantile_cont(d, 0.5),9) AS median, round(avg((d < 0.025::DOUBLE)::INT),9) AS close FROM d")
def exp5b_centroid_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = fixtures.double_shell(spark, sf_dir)
    out = guard.centroid_gap(metrics.self_intersections(v, f), v, f, TAU)
    return out.select(*[_r(c, 9).alias(c) for c in ("mean", "median", "close")])


@query("""WITH e AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step FROM events),
n AS (SELECT name, count(*) AS n, max(value) AS top FROM e GROUP BY name)
SELECT 'run' AS run_id, name, step, value FROM e UNION ALL SELECT 'run', name, n + 3, top FROM n""")
def snk5_series_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of events as series that count by name, then for each name a step that is set and its largest value; a muted log holds none."""
    events = fixtures.history(spark, sf_dir).withColumnRenamed("run_id", "name")
    log, mute = state.SeriesLog(spark), state.SeriesLog(spark, mute=True)
    for each in (log, mute):
        each.extend(events, ["ts", "event_id"])
    for name, top in events.groupBy("name").agg(F.max("value")).collect():  # a row a name
        log.set_step(name, log.step(name) + 3)
        log.add(name, top)
        mute.add(name, top)
    return log.table().unionByName(mute.table())


@query(f"WITH {_CE}, m AS (SELECT fid, middle FROM ce WHERE ratio > 1.2 AND middle > 0.005) SELECT fid FROM m".replace("FROM ce WHERE ratio", "FROM sg WHERE ratio"))
def loc6_localized(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v, f), target = _two(spark, sf_dir)
    return locate.localize(v, f, as_points(target[0]), target, topology.face_adjacency(f), 0.005, "ratio")


