"""Binary mesh files: a data source of fixed-length records that splits by byte offsets, and readers of
binary PLY and GLB on top of it.

A file's header says where its records lie. The driver reads that header alone; tasks read stretches of
records, each from its own offset. Files are reached through Arrow's file systems, by path or address.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators.topology import CORNERS
from ..session import ship

#: Names of PLY number types.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
#: Component types and element sizes of glTF accessors.
GLTF_TYPES, GLTF_SIZES = {5120: "i1", 5121: "u1", 5122: "i2", 5123: "u2", 5125: "u4", 5126: "f4"}, {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}


def open_path(path: str):
    """A file by path or address."""
    where, at = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    return where.open_input_file(at)


class Stretch(InputPartition):
    """Records ``first`` to ``last`` (without it) of a segment."""

    def __init__(self, segment: int, first: int, last: int) -> None:
        self.segment, self.first, self.last = segment, first, last


class FixedRecords(DataSource):
    """Records of a fixed length at known offsets of a file: ``id`` and one column a field.

    Options: ``path``; ``columns``, a JSON list of (name, "long" or "double"); ``segments``, a JSON list of objects
    with ``offset, stride, count, id`` (of the first record), ``fields`` (for each column: type as in numpy and
    place in the record), and maybe ``add`` (to be added to each value) or ``matrix`` (4x4, for x, y, z in the first three
    columns); ``bytes``, how many a task reads (16 MB)."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> StructType:
        kinds = {"long": LongType(), "double": DoubleType()}
        return StructType([StructField("id", LongType()), *[StructField(n, kinds[k]) for n, k in json.loads(self.options["columns"])]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FixedRecordsReader(self.options)


class FixedRecordsReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.columns = json.loads(options["columns"])
        self.segments = json.loads(options["segments"])
        self.bytes = int(options.get("bytes", 16 << 20))

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for i, s in enumerate(self.segments):
            step = max(1, self.bytes // s["stride"])
            found += [Stretch(i, a, min(a + step, s["count"])) for a in range(0, s["count"], step)]
        return found or [Stretch(-1, 0, 0)]

    def read(self, partition):
        if partition.segment < 0:
            return
        s = self.segments[partition.segment]
        wide = s["stride"]
        dtype = np.dtype({"names": [f"f{i}" for i in range(len(s["fields"]))], "formats": [f for f, _ in s["fields"]], "offsets": [at for _, at in s["fields"]], "itemsize": wide})
        with open_path(self.path) as file:
            for a in range(partition.first, partition.last, 1 << 16):
                b = min(a + (1 << 16), partition.last)
                # the last record of a stretch of interleaved fields may end before its stride does
                raw = file.read_at((b - a - 1) * wide + max(at + np.dtype(f).itemsize for f, at in s["fields"]), s["offset"] + a * wide)
                rows = np.frombuffer(raw.ljust((b - a) * wide, b"\0"), dtype)
                values = [rows[f"f{i}"].astype(np.int64 if k == "long" else np.float64) + s.get("add", 0) for i, (_, k) in enumerate(self.columns)]
                if "matrix" in s:
                    m = np.array(s["matrix"], float)
                    values[:3] = m[:3, :3] @ np.stack(values[:3]) + m[:3, 3:]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b) + s["id"]), *[pa.array(v) for v in values]], ["id", *[n for n, _ in self.columns]])


def fixed_records(spark: SparkSession, path: str, columns: list[tuple[str, str]], segments: list[dict], task_bytes: int = 16 << 20) -> DataFrame:
    """The records of all ``segments`` (see :class:`FixedRecords`)."""
    ship(spark)
    spark.dataSource.register(FixedRecords)
    return spark.read.format("fixed_records").options(path=path, columns=json.dumps(columns), segments=json.dumps(segments), bytes=str(task_bytes)).load()


# --- PLY -----------------------------------------------------------------------------------------


def ply_head(path: str) -> dict:
    """``format, length`` (bytes of the header), and ``elements``: name, count and properties (name, type, type of a list's count)."""
    with open_path(path) as file:
        raw, end = b"", -1
        while end < 0:
            more = file.read(1 << 16)
            raw += more
            end = raw.find(b"end_header")
            if not more or not raw.startswith(b"ply"):
                break
    after = raw.find(b"\n", end)
    if end < 0 or after < 0:
        raise ValueError(f"{path} is no PLY file")
    out: dict = {"format": None, "length": after + 1, "elements": []}
    for line in raw[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            out["format"] = w[1]
        elif w[:1] == ["element"]:
            out["elements"].append((w[1], int(w[2]), []))
        elif w[:1] == ["property"] and out["elements"]:
            out["elements"][-1][2].append((w[-1], w[-2], w[2] if w[1] == "list" else None))
    return out


def _columns(properties, base: str) -> list[tuple[str, str]]:
    return [(n if n in "xyz" else f"{base}_{n}", "double") for n, _, _ in properties]


def _plain(properties, order: str, at: int = 0) -> tuple[list, int]:
    """Fields of scalar properties from ``at`` on, and where they end."""
    fields = []
    for _, kind, _ in properties:
        t = np.dtype(order + PLY_TYPES[kind])
        fields.append((t.str, at))
        at += t.itemsize
    return fields, at


def read_binary_ply(spark: SparkSession, path: str, task_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a binary PLY file of either byte order, with other properties as ``vertex_<name>``
    and ``face_<name>``. Triangles are read as records of one length, in parallel; where faces have other numbers of
    corners (or a face more of them), one task walks over the counts first, and polygons become fans."""
    head = ply_head(path)
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}[head["format"]]
    offset, v, f = head["length"], None, None
    with open_path(path) as file:
        size = file.size()
    for name, count, properties in head["elements"]:
        lists = [p for p in properties if p[2] is not None]
        if not lists:
            fields, stride = _plain(properties, order)
            if name == "vertex":
                v = fixed_records(spark, path, _columns(properties, "vertex"), [{"offset": offset, "stride": stride, "count": count, "id": 0, "fields": fields}], task_bytes).withColumnRenamed("id", "vid")
            offset += stride * count
            continue
        if name != "face" or len(lists) > 1 or properties[0] != lists[0]:
            raise ValueError(f"{path}: element {name} has lists that this reader does not know")
        n_type, i_type = np.dtype(order + PLY_TYPES[lists[0][2]]), np.dtype(order + PLY_TYPES[lists[0][1]])
        more, stride = _plain(properties[1:], order, n_type.itemsize + 3 * i_type.itemsize)
        corner = [(i_type.str, n_type.itemsize + k * i_type.itemsize) for k in range(3)]
        columns = [("n", "long"), *[(c, "long") for c in CORNERS], *[(f"face_{p[0]}", "double") for p in properties[1:]]]
        segment = {"offset": offset, "stride": stride, "count": count, "id": 0, "fields": [(n_type.str, 0), *corner, *more]}
        if offset + stride * count <= size:
            f = fixed_records(spark, path, columns, [segment], task_bytes)
        # read as triangles, a file of other faces shows counts that are not 3 (the first of them is a true count)
        if f is None or not f.where("n <> 3").isEmpty():
            f = _polygons(spark, path, offset, count, n_type, i_type, stride - 3 * i_type.itemsize - n_type.itemsize, [p[0] for p in properties[1:]], more)
        f = f.withColumnRenamed("id", "fid").drop("n")
        break
    if v is None:
        raise ValueError(f"{path} has no vertices")
    if f is None:
        f = spark.createDataFrame([], "fid long, i0 long, i1 long, i2 long")
    return v, f


def _polygons(spark: SparkSession, path: str, offset: int, count: int, n_type: np.dtype, i_type: np.dtype, tail: int, names: list[str], more: list) -> DataFrame:
    """``id, i0, i1, i2`` and other properties of faces of any number of corners, as fans. One task reads the counts
    and notes where every 65,536th face begins; the faces from each such place are read by tasks of their own."""
    ship(spark)
    base = more[0][1] if more else 0
    types = [(t, at - base) for t, at in more]

    def sizes(file, at: int, n: int):
        """Corner counts and offsets of ``n`` faces from ``at`` on."""
        data, start = b"", at
        for _ in range(n):
            if at + n_type.itemsize > start + len(data):
                data, start = file.read_at(1 << 20, at), at
            if len(data) < at - start + n_type.itemsize:
                raise ValueError(f"{path} ends within its faces")
            k = int(np.frombuffer(data, n_type, 1, at - start)[0])
            yield k, at
            at += n_type.itemsize + k * i_type.itemsize + tail
            if at > start + len(data):
                data = b""

    def walk(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                with open_path(path) as file:
                    firsts, fans = [], 0
                    for i, (k, at) in enumerate(sizes(file, offset, count)):
                        if i % (1 << 16) == 0:
                            firsts.append((i, at, fans))
                        fans += max(k - 2, 0)
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in firsts], pa.int64()) for j in range(3)], ["first", "at", "fans"])

    def read(batches):
        for batch in batches:
            for first, at, fid in zip(*(batch.column(c).to_pylist() for c in ("first", "at", "fans")), strict=True):
                out, extra = [], [[] for _ in names]
                with open_path(path) as file:
                    for k, begins in sizes(file, at, min(1 << 16, count - first)):
                        raw = file.read_at(k * i_type.itemsize + tail, begins + n_type.itemsize)
                        corner = np.frombuffer(raw, i_type, k).tolist()
                        own = [float(np.frombuffer(raw, t, 1, k * i_type.itemsize + place)[0]) for t, place in types]
                        for j in range(1, k - 1):
                            out.append((fid, corner[0], corner[j], corner[j + 1]))
                            fid += 1
                            for values, value in zip(extra, own, strict=True):
                                values.append(value)
                yield pa.RecordBatch.from_arrays([*[pa.array([x[j] for x in out], pa.int64()) for j in range(4)], *[pa.array(x, pa.float64()) for x in extra]], ["id", *CORNERS, *[f"face_{n}" for n in names]])

    places = spark.range(0, 1, 1, 1).mapInArrow(walk, "first long, at long, fans long")
    dealt = places.repartition(max(1, count >> 16), "first")
    return dealt.mapInArrow(read, "id long, i0 long, i1 long, i2 long" + "".join(f", `face_{n}` double" for n in names))


# --- GLB -----------------------------------------------------------------------------------------


def glb_head(path: str) -> tuple[dict, int]:
    """The JSON part of a GLB file, and where its binary part begins."""
    with open_path(path) as file:
        magic, version, _ = struct.unpack("<4sII", file.read(12))
        if magic != b"glTF" or version != 2:
            raise ValueError(f"{path} is no GLB file of version 2")
        length, kind = struct.unpack("<I4s", file.read(8))
        if kind != b"JSON":
            raise ValueError(f"{path} does not begin with its JSON part")
        head = json.loads(file.read(length))
    return head, 20 + length + 8


def _local(node: dict) -> np.ndarray:
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    m = np.eye(4)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    m[:3, :3] *= np.array(node.get("scale", (1, 1, 1)), float)
    m[:3, 3] = node.get("translation", (0, 0, 0))
    return m


def _placed(head: dict) -> list[tuple[int, np.ndarray]]:
    """Meshes of the scene with the matrices of their nodes, parents' first."""
    nodes = head.get("nodes", [])
    if not nodes:
        return [(i, np.eye(4)) for i in range(len(head.get("meshes", [])))]
    children = {c for n in nodes for c in n.get("children", [])}
    scenes = head.get("scenes")
    roots = scenes[head.get("scene", 0)].get("nodes", []) if scenes else [i for i in range(len(nodes)) if i not in children]
    found, todo = [], [(i, np.eye(4)) for i in reversed(roots)]
    while todo:
        i, above = todo.pop()
        m = above @ _local(nodes[i])
        if "mesh" in nodes[i]:
            found.append((nodes[i]["mesh"], m))
        todo += [(c, m) for c in reversed(nodes[i].get("children", []))]
    return found


def read_glb(spark: SparkSession, path: str, task_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the scene of a GLB file: the triangles of all its meshes, where their nodes put them, with
    ids in the order of nodes. Primitives of points, lines, strips and fans are left out; so are sparse accessors and other files."""
    head, start = glb_head(path)
    points, triples, plain, vid, fid = [], [], [], 0, 0

    def accessor(i: int) -> tuple[int, int, np.dtype, dict]:
        a = head["accessors"][i]
        view = head["bufferViews"][a["bufferView"]]
        t = np.dtype("<" + GLTF_TYPES[a["componentType"]])
        return start + view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride", t.itemsize * GLTF_SIZES[a["type"]]), t, a

    for mesh, m in _placed(head):
        for part in head["meshes"][mesh]["primitives"]:
            if part.get("mode", 4) != 4 or "POSITION" not in part["attributes"]:
                continue
            at, stride, t, a = accessor(part["attributes"]["POSITION"])
            points.append({"offset": at, "stride": stride, "count": a["count"], "id": vid, "fields": [(t.str, k * t.itemsize) for k in range(3)], "matrix": m.tolist()})
            if "indices" in part:
                at, _, t, b = accessor(part["indices"])
                triples.append({"offset": at, "stride": 3 * t.itemsize, "count": b["count"] // 3, "id": fid, "add": vid, "fields": [(t.str, k * t.itemsize) for k in range(3)]})
                fid += b["count"] // 3
            else:
                plain.append((fid, vid, a["count"] // 3))
                fid += a["count"] // 3
            vid += a["count"]
    v = fixed_records(spark, path, [(c, "double") for c in "xyz"], points, task_bytes).withColumnRenamed("id", "vid")
    f = fixed_records(spark, path, [(c, "long") for c in CORNERS], triples, task_bytes).withColumnRenamed("id", "fid")
    for first, base, n in plain:
        f = f.unionByName(spark.range(n).select((F.col("id") + first).alias("fid"), *[(F.col("id") * 3 + base + k).alias(c) for k, c in enumerate(CORNERS)]))
    return v, f
