"""Sharding by sampled splitters: shards of near equal bytes.

A record's key is the hash of its text followed by a hash of its id, so equal texts stand
together. A sample drawn with probability proportional to size gives splitters at its quantiles;
records are dealt to the ranges between them, and exact sums of the ranges place each record
within the whole order, which is cut where a shard is full. A group of equal texts goes where its
first record falls, unless it is too large for that: then it is subdivided.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ready, text_or_empty

#: Low bits of a key come from the id, the others from the text.
ID_BITS = 20


def _splitters(keyed: DataFrame, total: int, ranges: int, draws: int) -> np.ndarray:
    """At most ``ranges - 1`` boundaries from about ``ranges * draws`` drawn keys (a bound for the driver)."""
    rate = ranges * draws / max(total, 1)
    u = (F.pmod(F.xxhash64("key", "id", F.lit(17)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    # a record of more than one draw's bytes counts as often as draws fall on it
    hits = F.floor(F.col("size") * rate) + (u < F.col("size") * rate - F.floor(F.col("size") * rate)).cast("long")
    drawn = keyed.select("key", hits.alias("n")).where("n > 0").toPandas()
    if drawn.empty:
        return np.empty(0, np.int64)
    keys = np.sort(np.repeat(drawn["key"].to_numpy(np.int64), np.minimum(drawn["n"].to_numpy(), draws * ranges)))
    cuts = keys[np.unique(np.linspace(0, len(keys), ranges + 1).astype(np.int64)[1:-1])]
    text = cuts >> ID_BITS
    hot = np.isin(text, text[1:][text[1:] == text[:-1]])  # one text fills whole ranges: split it by id
    return np.unique(np.where(hot, cuts, text << ID_BITS))


def shard(
    docs: DataFrame, shards: int = 24, *, doc_id: str = "doc_id", text: str = "text", overhead: int = 8, ranges_per_shard: int = 64,
    draws: int = 24, group_part: float = 0.05,
) -> DataFrame:
    """``id, size, text_crc32, shard, slot`` for every row; shards are 0 to ``shards - 1``.

    Null texts have the size ``overhead`` and form one group with empty ones; null ids and repeated
    rows are placed like any other; an empty table gives an empty one. Groups of equal texts of up
    to ``group_part`` of a shard stay in one shard. ``slot`` numbers a shard's rows from 0.
    """
    ready(docs.sparkSession)
    raw = text_or_empty(F.col(text))
    low = F.pmod(F.xxhash64(F.col(doc_id), F.lit(3)), F.lit(1 << ID_BITS))
    key = F.shiftleft(F.shiftright(F.xxhash64(raw), ID_BITS), ID_BITS).bitwiseOR(low)
    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), (F.octet_length(raw).cast("long") + overhead).alias("size"), F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"), key.alias("key"))
    keyed = cut(keyed)
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bounds = _splitters(keyed, total, shards * ranges_per_shard, draws)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

    ranged = keyed.withColumn("range", range_of("key"))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    # one row a range: shards * ranges_per_shard at most
    start = sums.select("range", F.coalesce(F.sum("bytes").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    order = Window.partitionBy("range").orderBy("key", "id")
    group = Window.partitionBy("range", F.shiftright("key", ID_BITS))
    at = ranged.withColumn("own", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    at = at.withColumn("own_group", F.min("own").over(group)).withColumn("group_bytes", F.sum("size").over(group))
    at = at.join(F.broadcast(start), "range")
    together = F.col("group_bytes") <= group_part * total / shards
    base = F.col("start") + F.when(together, F.col("own_group") + F.col("group_bytes") / 2.0).otherwise(F.col("own") + F.col("size") / 2.0)
    placed = at.withColumn("shard", F.least(F.floor(base * (shards / max(total, 1))), F.lit(shards - 1)).cast("int"))
    placed = cut(placed.select("id", "size", "text_crc32", "key", "range", "shard"))
    parts = placed.groupBy("shard", "range").agg(F.count("*").alias("rows"))
    # at most ranges + shards rows: a range spans several shards only where it is cut
    offset = parts.select("shard", "range", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("shard", "range").orderBy("key", "id", "size"))
    return placed.withColumn("nth", nth).join(F.broadcast(offset), ["shard", "range"]).select("id", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"))
