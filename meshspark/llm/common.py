"""Helpers that the operators share: input tables, shared storage, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: A word is a run of bytes other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where the session
    names none, as in local tests, a temporary folder becomes the checkpoint folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    own = tempfile.mkdtemp(prefix="meshspark-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a narrow table (cleaned up by Spark when unused)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, rows: int, salts: int = 32) -> DataFrame:
    """``left`` joined with ``right`` (one row a key), where a key may hold a large part of ``left``.

    Keys with a thousandth of the ``rows`` of left or more (a thousand such keys at most, which are broadcast) are sent to
    ``salts`` places, by the column ``by``; all others go where they would."""
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(rows // 1000, 100)).select(key, F.lit(salts).alias("_salts"))
    hot = F.broadcast(hot)
    one = left.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    two = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return one.join(two, [key, "_salt"]).drop("_salt")


def ready(spark: SparkSession, rows: int = 4096, size: int = 1 << 20) -> None:
    """Ready a session for Python operators: the package is shipped to executors, and Arrow batches
    hold at most ``rows`` rows and end at ``size`` bytes, so very long texts stand alone in their memory.

    Both are settings of the session, read when a query runs; smaller ones stay."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key, str(most + 1)).rstrip("b"))
        if now > most or now <= 0:
            spark.conf.set(key, str(most))


def words_in(text: Column) -> Column:
    """Number of words in ``text``; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
