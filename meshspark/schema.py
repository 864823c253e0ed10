"""Canonical tables. Every row has an explicit id: nothing depends on row order."""

from __future__ import annotations

from pyspark.sql import DataFrame



VERTICES = "vid long, x double, y double, z double"
FACES = "fid long, i0 long, i1 long, i2 long"
POINTS = "pid long, x double, y double, z double"
SEGMENTS = "sid long, owner_vid long, px double, py double, pz double, qx double, qy double, qz double"
SAMPLES = "sid long, fid long, b0 double, b1 double, b2 double"
FIT_STATE = "vid long, optimizable boolean, blocked_count int, resid_prev double, resid_drop_ema double, last_refine int"


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` if it has the columns, else a ValueError that names the missing ones."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def is_mesh(vertices: DataFrame | None, faces: DataFrame | None) -> bool:
    """Whether both tables are there and there is a vertex."""
    return vertices is not None and faces is not None and not vertices.isEmpty()
