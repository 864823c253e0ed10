"""Binary mesh files against the same meshes in ASCII or in memory."""

import json
import struct

import numpy as np
import pytest

from meshspark.sources import binary_mesh, mesh_files
from test_nonrigid import grid


def ply(path, p, f, kind, group=True, polygons=None):
    """The mesh with vertex property Group (int) and face property w (double), in one of three formats."""
    order = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": None}[kind]
    faces = polygons or [list(t) for t in f]
    head = f"ply\nformat {kind} 1.0\ncomment c\nelement vertex {len(p)}\nproperty float x\nproperty float y\nproperty float z\nproperty int Group\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nproperty double w\nend_header\n"
    with open(path, "wb") as out:
        out.write(head.encode())
        for i, x in enumerate(np.float32(p)):
            out.write(struct.pack(f"{order}fffi", *x, i % 3) if order else (" ".join(repr(float(c)) for c in x) + f" {i % 3}\n").encode())
        for i, t in enumerate(faces):
            out.write(struct.pack(f"{order}B{len(t)}id", len(t), *t, i / 2) if order else f"{len(t)} {' '.join(map(str, t))} {i / 2}\n".encode())


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("kind", ["binary_little_endian", "binary_big_endian"])
def test_binary_ply_is_read_like_ascii(spark, tmp_path, kind):
    p, f = grid(7)
    ply(tmp_path / "a.ply", p, f, "ascii")
    ply(tmp_path / "b.ply", p, f, kind)
    one, two = (mesh_files.read_mesh(spark, str(tmp_path / n)) for n in ("a.ply", "b.ply"))
    assert rows(one[0]) == rows(two[0]) and rows(one[1]) == rows(two[1]) and len(rows(two[1])) == 72
    v, faces = binary_mesh.read_binary_ply(spark, str(tmp_path / "b.ply"), task_bytes=200)
    assert v.rdd.getNumPartitions() > 3 and faces.rdd.getNumPartitions() > 3
    assert rows(v) == rows(two[0]) and rows(faces) == rows(two[1])


def test_polygons_become_fans(spark, tmp_path):
    p, _ = grid(4)
    ply(tmp_path / "q.ply", p, None, "binary_little_endian", polygons=[[0, 1, 5, 4], [1, 2, 6], [2, 3, 7, 6, 5], [8, 9]])
    _, f = mesh_files.read_mesh(spark, str(tmp_path / "q.ply"))
    got = [(r.fid, r.i0, r.i1, r.i2, r.face_w) for r in f.orderBy("fid").collect()]
    assert got == [(0, 0, 1, 5, 0.0), (1, 0, 5, 4, 0.0), (2, 1, 2, 6, 0.5), (3, 2, 3, 7, 1.0), (4, 2, 7, 6, 1.0), (5, 2, 6, 5, 1.0)]


def test_points_alone_and_broken_files(spark, tmp_path):
    (tmp_path / "p.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty double x\nproperty double y\nproperty double z\nend_header\n" + struct.pack("<6d", 1, 2, 3, 4, 5, 6))
    v, f = mesh_files.read_mesh(spark, str(tmp_path / "p.ply"))
    assert rows(v) == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)] and f.count() == 0
    (tmp_path / "x.ply").write_bytes(b"plx\n")
    with pytest.raises(ValueError, match="no PLY file"):
        mesh_files.read_mesh(spark, str(tmp_path / "x.ply"))
    (tmp_path / "x.glb").write_bytes(b"glTF" + bytes(40))
    with pytest.raises(ValueError, match="no GLB file"):
        mesh_files.read_mesh(spark, str(tmp_path / "x.glb"))
    assert mesh_files.read_mesh(spark, str(tmp_path / "absent.glb")) is None


def glb(path, p, f):
    """One mesh twice, under a turned node with a scaled child; interleaved positions; a second primitive without indices."""
    inter = b"".join(struct.pack("<3f", *x) + b"\xff" * 4 for x in np.float32(p))
    index = np.array(f, "<u2").tobytes()
    index += b"\0" * (-len(index) % 4)
    loose = np.float32(p[:6]).tobytes()
    binary = inter + index + loose
    head = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}],
        "nodes": [{"mesh": 0, "rotation": [0, 0, 2**-0.5, 2**-0.5], "children": [1]}, {"mesh": 0, "scale": [2, 2, 2], "translation": [0, 0, 1]}, {"mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}, {"attributes": {"POSITION": 2}}, {"attributes": {"POSITION": 2}, "mode": 1}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(p), "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 3 * len(f), "type": "SCALAR"}, {"bufferView": 2, "componentType": 5126, "count": 6, "type": "VEC3"}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": len(inter), "byteStride": 16}, {"buffer": 0, "byteOffset": len(inter), "byteLength": len(index)}, {"buffer": 0, "byteOffset": len(inter) + len(index), "byteLength": len(loose)}],
        "buffers": [{"byteLength": len(binary)}],
    }
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 4)
    path.write_bytes(struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(binary)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(binary), b"BIN\0") + binary)


def test_glb_scene(spark, tmp_path):
    p, f = grid(5)
    glb(tmp_path / "a.glb", p, f)
    v, faces = mesh_files.read_mesh(spark, str(tmp_path / "a.glb"))
    got, n = np.array(rows(v.select("vid", "x", "y", "z")))[:, 1:], len(p)
    turn = lambda q: np.c_[-q[:, 1], q[:, 0], q[:, 2]]
    q = np.float32(p).astype(float)
    one = np.r_[q, q[:6]]
    assert np.allclose(got, np.r_[turn(one), turn(2 * one + [0, 0, 1])], atol=1e-6)
    own = lambda base, first: [(first + i, *(base + k for k in t)) for i, t in enumerate(f)] + [(first + len(f) + i, *(base + n + 3 * i + k for k in range(3))) for i in range(2)]
    assert [tuple(r) for r in faces.orderBy("fid").collect()] == own(0, 0) + own(n + 6, len(f) + 2)
    small = binary_mesh.read_glb(spark, str(tmp_path / "a.glb"), task_bytes=64)
    assert rows(small[0]) == rows(v) and rows(small[1]) == rows(faces) and small[0].rdd.getNumPartitions() > 6
