"""Point clouds and meshes derived from the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def clouds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source (labels under 5) and target points: the first three components."""
    at = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")]
    e = embeddings(spark, sf_dir)
    pick = lambda cond: e.where(cond).select(F.col("vec_id").alias("pid"), *at)
    return pick("label < 5"), pick("label >= 5")


def width(spark: SparkSession, sf_dir: str) -> int:
    return int(embeddings(spark, sf_dir).count() ** 0.5)


def height_field(spark: SparkSession, sf_dir: str, component: int = 0, shift: int = 0) -> tuple[DataFrame, DataFrame]:
    """A grid over the unit square whose heights are an embedding component; ids start at ``shift * W^2``."""
    w = width(spark, sf_dir)
    i, j = F.floor(F.col("vec_id") / w), F.col("vec_id") % w
    v = embeddings(spark, sf_dir).where(F.col("vec_id") < w * w)
    v = v.select((F.col("vec_id") + shift * w * w).alias("vid"), (i / float(w - 1)).alias("x"), (j / float(w - 1)).alias("y"), F.get("embedding", F.lit(component)).cast("double").alias("z"))
    cells = spark.range((w - 1) * (w - 1)).select((F.floor(F.col("id") / (w - 1)) * w + F.col("id") % (w - 1) + shift * w * w).alias("a"), F.col("id"))
    a, b, c, d = F.col("a"), F.col("a") + 1, F.col("a") + w, F.col("a") + w + 1
    tri = lambda k, p, q, r: F.struct(F.lit(k).alias("k"), p.alias("i0"), q.alias("i1"), r.alias("i2"))
    f = cells.select("id", F.explode(F.array(tri(0, a, b, c), tri(1, b, d, c))).alias("t"))
    return v, f.select((F.col("id") * 2 + F.col("t.k") + shift * 2 * (w - 1) * (w - 1)).alias("fid"), "t.i0", "t.i1", "t.i2")


def double_shell(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two height fields (components 0 and 2) that cross each other, as one mesh."""
    v0, f0 = height_field(spark, sf_dir, 0)
    v1, f1 = height_field(spark, sf_dir, 2, 1)
    return v0.unionByName(v1), f0.unionByName(f1)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, ts, event_id, value``: the event values as one series for each type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("run_id"), "ts", "event_id", "value")
