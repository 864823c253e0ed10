"""Mesh files: OBJ and PLY in and out, GLB in, and deterministic surface samples."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vec import Vec
from ..operators.topology import CORNERS, corners, dense_rank_ids, saved, triangles
from .binary_mesh import ply_head, read_binary_ply, read_glb


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``at, value`` of a text file's lines: ``at`` ascends from 0 without gaps. Files are read by Spark
    only, in splits; a line stands by its split's place in the file and its own in the split."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.rtrim("value", F.lit("\r")).alias("value"))
    rows = saved(rows)
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    # a row for each split of the file
    before = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), ["file", "block"]).select((F.col("before") + F.col("nth") - F.col("first")).alias("at"), "value")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    return dense_rank_ids(rows, ["at"], name)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines ``v x y z`` and ``f a b c`` (1-based, ``a/b/c`` allowed, polygons as fans); others are ignored."""
    rows = lines(spark, path).withColumn("w", F.split(F.trim("value"), r"\s+"))
    v = _numbered(rows.where((F.get("w", F.lit(0)) == "v") & (F.size("w") >= 4)).select("at", *[F.get("w", F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate("xyz")]), "vid")
    f = rows.where((F.get("w", F.lit(0)) == "f") & (F.size("w") >= 4))
    f = f.select("at", F.transform(F.slice("w", 2, 1 << 20), lambda x: F.substring_index(x, "/", 1).try_cast("long") - 1).alias("i"))
    f = f.select("at", "i", F.explode(F.sequence(F.lit(1), F.size("i") - 2)).alias("k"))
    f = f.select((F.col("at") * (1 << 20) + F.col("k")).alias("at"), F.get("i", F.lit(0)).alias("i0"), F.get("i", F.col("k")).alias("i1"), F.get("i", F.col("k") + 1).alias("i2"))
    return v.select("vid", "x", "y", "z"), _numbered(f, "fid").select("fid", *CORNERS)


def ply_header(spark: SparkSession, path: str) -> dict:
    """Counts, property names in order, and the header's length of an ASCII PLY file."""
    head = [r["value"].strip() for r in lines(spark, path).orderBy("at").limit(512).collect()]
    if not head or head[0] != "ply" or "format ascii 1.0" not in head or "end_header" not in head:
        raise ValueError(f"{path} is no ASCII PLY file")
    out: dict = {"length": head.index("end_header") + 1, "counts": {}, "props": {}}
    element = None
    for line in head[: out["length"]]:
        w = line.split()
        if w[:1] == ["element"]:
            element = w[1]
            out["counts"][element], out["props"][element] = int(w[2]), []
        elif w[:1] == ["property"] and element:
            out["props"][element].append((w[-1], w[1] == "list"))
    return out


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces with their other properties as columns ``vertex_<name>`` and ``face_<name>``,
    found by their place in the header. Short rows are skipped."""
    head = ply_header(spark, path)
    rows = lines(spark, path).where(F.col("at") >= head["length"]).withColumn("w", F.split(F.trim("value"), r"\s+")).withColumn("n", F.col("at") - head["length"])
    start = 0
    tables = {}
    for element, count in head["counts"].items():
        tables[element] = rows.where((F.col("n") >= start) & (F.col("n") < start + count)).withColumn("id", F.col("n") - start)
        start += count
    names = [n for n, _ in head["props"]["vertex"]]
    v = tables["vertex"].where(F.size("w") >= len(names))
    at = lambda n: F.get("w", F.lit(names.index(n))).try_cast("double")
    v = v.select(F.col("id").cast("long").alias("vid"), *[at(c).alias(c) for c in "xyz"], *[at(n).alias(f"vertex_{n}") for n in names if n not in "xyz"])
    if "face" not in tables:
        return v, spark.createDataFrame([], "fid long, i0 long, i1 long, i2 long")
    props = [n for n, is_list in head["props"]["face"] if not is_list]
    n = F.get("w", F.lit(0)).try_cast("int")
    f = tables["face"].where(F.size("w") >= 1 + n + len(props)).select(F.col("id").cast("long").alias("fid"), *[F.get("w", F.lit(i + 1)).try_cast("long").alias(c) for i, c in enumerate(CORNERS)], *[F.get("w", 1 + n + i).try_cast("double").alias(f"face_{p}") for i, p in enumerate(props)])
    return v, f


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Vertices and faces of an OBJ, PLY (ASCII or binary) or GLB file, or of a folder with Parquet tables; None if it is missing."""
    if not exists(spark, path):
        return None
    if path.endswith(".glb"):
        return read_glb(spark, qualified(spark, path))
    if path.endswith(".ply"):
        binary = not is_folder(spark, path) and (ply_head(qualified(spark, path))["format"] or "").startswith("binary")
        return read_binary_ply(spark, qualified(spark, path)) if binary else read_ply(spark, path)
    if path.endswith(".obj"):
        return read_obj(spark, path)
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/faces")


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Writes a folder of Parquet tables, or for ``.obj`` and ``.ply`` a folder with one text file.
    What exists stays unless ``overwrite``; Spark's commit makes the folder whole or absent."""
    spark = vertices.sparkSession
    if exists(spark, path) and not overwrite:
        return True
    if path.endswith((".obj", ".ply")):
        ply = path.endswith(".ply")
        number = lambda c: F.col(c).cast("string")
        v = vertices.select(F.lit(1).alias("part"), F.col("vid").alias("id"), F.concat_ws(" ", *([] if ply else [F.lit("v")]), *map(number, "xyz")).alias("value"))
        f = faces.select(F.lit(2).alias("part"), F.col("fid").alias("id"), F.concat_ws(" ", F.lit("3" if ply else "f"), *[(F.col(c) + (0 if ply else 1)).cast("string") for c in CORNERS]).alias("value"))
        out = v.unionByName(f)
        if ply:
            head = ["ply", "format ascii 1.0", f"element vertex {vertices.count()}", "property double x", "property double y", "property double z", f"element face {faces.count()}", "property list uchar int vertex_indices", "end_header"]
            out = out.unionByName(spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "part int, id long, value string"))
        out.repartitionByRange(1, "part", "id").sortWithinPartitions("part", "id").select("value").write.mode("overwrite").text(path)
        return True
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    faces.write.mode("overwrite").parquet(f"{path}/faces")
    return True


def write_bundle(path: str, tables: dict[str, DataFrame], records: dict[str, dict], spark: SparkSession) -> None:
    """One folder for a run: tables as Parquet, records as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    for name, record in records.items():
        spark.createDataFrame([(json.dumps(record, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}.json")


def write_step(vertices: DataFrame, step: int, path: str) -> None:
    vertices.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").parquet(path)


def _unit(seed: int, which: int, sid) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(which), sid), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def surface_samples(vertices: DataFrame, faces: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``sid, fid, b0, b1, b2``: faces drawn with probability proportional to area (evenly if all are
    degenerate) and barycentric weights, by hashes of the seed and the sample's number.

    A sample's place on the whole area is stratified: sample i falls within the i-th of ``n`` parts,
    so faces find their samples by arithmetic instead of a join on ranges.
    """
    a, b, c = corners()
    area = triangles(vertices, faces).select("fid", ((b - a).cross(c - a).norm() / 2.0).alias("area"))
    area = saved(area)
    total, count = area.agg(F.coalesce(F.sum("area"), F.lit(0.0)), F.count("*")).first()
    if total <= 1e-20:
        area, total = area.withColumn("area", F.lit(1.0)), float(count)
    ranged = saved(area.repartitionByRange("fid").withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum("area").alias("s"))
    before = sums.select("_part", F.coalesce(F.sum("s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    upto = F.col("before") + F.sum("area").over(Window.partitionBy("_part").orderBy("fid").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.join(F.broadcast(before), "_part").withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("area"))
    first, last = F.floor(F.col("lo") / total * n), F.floor(F.col("hi") / total * n)
    drawn = placed.withColumn("sid", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1)))))
    at = (F.col("sid") + _unit(seed, 0, F.col("sid"))) / n * total
    drawn = drawn.where((at >= F.col("lo")) & (at < F.col("hi")))
    r1, r2 = F.sqrt(_unit(seed, 1, F.col("sid"))), _unit(seed, 2, F.col("sid"))
    return drawn.select("sid", "fid", (1 - r1).alias("b0"), (r1 * (1 - r2)).alias("b1"), (r1 * r2).alias("b2"))


def sample_points(samples: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``pid, x, y, z`` and unit face normals of samples on a mesh."""
    from ..functions.geometry import face_normal

    a, b, c = corners()
    both = samples.join(triangles(vertices, faces), "fid")
    p = a * F.col("b0") + b * F.col("b1") + c * F.col("b2")
    return both.select(F.col("sid").alias("pid"), *p.named(), *face_normal(a, b, c).named("n"))


def thinned(points: DataFrame, radius: float) -> DataFrame:
    """Points no closer than about ``radius``: the least id of each cell of that size stays, unless a
    kept point with a smaller id lies within ``radius`` in a neighbouring cell."""
    cells = [F.floor(F.col(c) / radius).alias(f"c{c}") for c in "xyz"]
    one = points.select("pid", "x", "y", "z", *cells).groupBy("cx", "cy", "cz").agg(F.min(F.struct("pid", "x", "y", "z")).alias("m")).select("cx", "cy", "cz", "m.*")
    near = one.select(F.col("pid").alias("o"), *Vec.of().named("o"), "cx", "cy", "cz")
    for c in "xyz":
        near = near.withColumn(f"c{c}", F.explode(F.array(F.col(f"c{c}") - 1, F.col(f"c{c}"), F.col(f"c{c}") + 1)))
    beaten = one.join(near, ["cx", "cy", "cz"]).where((F.col("o") < F.col("pid")) & ((Vec.of() - Vec.of("o")).norm2() < radius * radius)).select("pid").distinct()
    return points.join(one.select("pid"), "pid", "left_semi").join(beaten, "pid", "left_anti")


def first_come(points: DataFrame, near: DataFrame, radius: float) -> DataFrame:
    """``pid`` of the points that stay where, in order of ``rank``, each takes the place of all later ones within ``radius``.
    ``near`` are pairs ``u, v, d2`` with u's rank the lower. A point whose lower neighbours are all gone stays, and its
    neighbours go; that is one round, and a few rounds by the logarithm of the points decide all."""
    pairs = saved(near.where(F.col("d2") < radius * radius).select("u", "v"))
    kept = points.select("pid").join(pairs.select(F.col("v").alias("pid")), "pid", "left_anti")
    while not pairs.isEmpty():
        waiting = pairs.select(F.col("v").alias("u")).distinct()
        first = saved(pairs.select("u").distinct().join(waiting, "u", "left_anti"))
        gone = saved(pairs.join(first, "u", "left_semi").select("v").distinct())
        left = saved(pairs.join(first, "u", "left_anti").join(gone, "v", "left_anti").join(gone.withColumnRenamed("v", "u"), "u", "left_anti"))
        # points that no pair holds back any more
        free = pairs.select(F.col("v").alias("pid")).distinct().join(gone.withColumnRenamed("v", "pid"), "pid", "left_anti").join(left.select(F.col("v").alias("pid")), "pid", "left_anti")
        kept, pairs = saved(kept.unionByName(free)), left
    return kept


def poisson_samples(vertices: DataFrame, faces: DataFrame, n: int, seed: int = 0, *, over: int = 5, halvings: int = 5) -> tuple[DataFrame, float]:
    """``pid, x, y, z, nx, ny, nz`` of ``n`` samples no two of which are closer than the radius, and that radius.

    ``over`` times as many uniform samples take places in the order of a hash. The radius is the largest, to so many halvings
    of that of the densest packing of ``n`` discs in the area, that leaves ``n`` of them; those of the lowest ranks stay.
    Samples are evenly dense, so a point meets a bounded number of others within it.
    """
    a, b, c = corners()
    area = triangles(vertices, faces).agg(F.sum((b - a).cross(c - a).norm() / 2.0)).first()[0] or 0.0
    drawn = sample_points(surface_samples(vertices, faces, over * n, seed), vertices, faces)
    points = saved(dense_rank_ids(drawn.withColumn("_h", F.xxhash64(F.lit(seed), F.lit(3), "pid")), ["_h", "pid"], "rank").drop("_h", "pid").withColumnRenamed("rank", "pid"))
    most = (2.0 * area / (3.0**0.5 * max(n, 1))) ** 0.5
    if most == 0.0 or n < 1:
        return points.where(F.col("pid") < n).select("pid", "x", "y", "z", "nx", "ny", "nz"), 0.0
    cells = [F.floor(F.col(c) / most).alias(f"c{c}") for c in "xyz"]
    own = points.select(F.col("pid").alias("v"), *Vec.of().named("q"), *cells)
    other = points.select(F.col("pid").alias("u"), *Vec.of().named("p"), *cells)
    for c in "xyz":
        other = other.withColumn(f"c{c}", F.explode(F.array(F.col(f"c{c}") - 1, F.col(f"c{c}"), F.col(f"c{c}") + 1)))
    near = other.join(own, ["cx", "cy", "cz"]).where("u < v").select("u", "v", (Vec.of("p") - Vec.of("q")).norm2().alias("d2"))
    near = saved(near.where(F.col("d2") < most * most))
    radius, kept = 0.0, points.select("pid")
    for k in range(1, halvings + 1):
        wider = radius + most / 2.0**k
        found = first_come(points, near, wider)
        if found.count() >= n:
            radius, kept = wider, found
    out = dense_rank_ids(points.join(kept, "pid", "left_semi").withColumnRenamed("pid", "_at"), ["_at"], "pid")
    return out.where(F.col("pid") < n).select("pid", "x", "y", "z", "nx", "ny", "nz"), radius
