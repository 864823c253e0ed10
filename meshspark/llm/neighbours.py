"""Approximate nearest neighbours by inner product over shifted Hilbert orderings.

Vectors are lifted so that the largest inner product is the least distance (one more coordinate
makes all norms equal), projected at random to a few dimensions, shifted, and ordered along a
Hilbert curve, for several projections and shifts. Each ordering is range-partitioned by Spark and
numbered; a query is compared with the rows in a window around its place in every ordering, block
by block, and the best of all orderings are merged.

The window is measured, not fixed: a bounded sample of queries is compared with all rows, and the
window is the ``target`` quantile of the distance, in the ordering where it is least, between a
query and its true neighbours. Where vectors have structure windows are short; where they have
none, as for vectors uniform on a sphere of many dimensions, they grow with the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, written


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with ``bits``-bit coordinates (n, dims), by
    Skilling's exchange of axes: all points step together."""
    x = [c.astype(np.int64) for c in cells.T]
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = np.int64(1) << level, (np.int64(1) << level) - 1
        for i in range(dims):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(up, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1, (np.int64(1) << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ turn) >> level) & 1
    return key


class Curves:
    """Projections, scales and shifts of all orderings, fitted on a sample of lifted vectors."""

    def __init__(self, sample: np.ndarray, norm: float, curves: int, dims: int, bits: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.norm, self.bits = norm, bits
        full = sample.shape[1] + 1
        self.axes = [np.linalg.qr(rng.standard_normal((full, min(dims, full))))[0] for _ in range(curves)]
        lifted = self.lift(sample, False)
        self.centre = [(lifted @ a).mean(axis=0) for a in self.axes]
        self.width = [np.maximum((lifted @ a).std(axis=0), 1e-12) * 8 for a in self.axes]
        self.shift = [rng.uniform(0.25, 0.75, a.shape[1]) for a in self.axes]

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def keys(self, x: np.ndarray, query: bool) -> list[np.ndarray]:
        lifted, top = self.lift(x, query), (1 << self.bits) - 1
        return [hilbert_keys(np.clip((((lifted @ a) - c) / w + s) * (top + 1), 0, top).astype(np.int64), self.bits) for a, c, w, s in zip(self.axes, self.centre, self.width, self.shift, strict=True)]


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed the same way wherever a row stands."""
    return (rows * query).sum(axis=1)


def best(query: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (ids, scores) among rows, ties to smaller ids; ``rough`` products choose what is summed exactly."""
    other = ids != own
    n = int(other.sum())
    if n > k:
        limit = np.partition(rough[other], n - k)[n - k]
        other &= rough >= limit - 1e-9 * max(1.0, abs(float(limit)))
    at = np.flatnonzero(other)
    score = exact_scores(query, rows[at])
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at][order], score[order]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, v``: rows with an id and a vector that is not null or zero and has finite components, of the commonest length."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    rows = rows.where(~bad & F.exists(v, lambda x: x != 0))
    dims = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size(v) == (dims["d"] if dims else 0))


def _truth(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> dict[int, list[int]]:
    """Exact neighbours of a bounded number of queries: every task sends its best."""

    def run(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _matrix(b.column(1)), b.column(0).to_numpy()
            rough = q @ x.T
            for j in range(len(ids)):
                i, s = best(q[j], ids[j], x, own, rough[j], k)
                if j in held:
                    i, s = np.concatenate([held[j][0], i]), np.concatenate([held[j][1], s])
                    o = np.lexsort((i, -s))[:k]
                    i, s = i[o], s[o]
                held[j] = (i, s)
        for j, (i, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), ids[j])), pa.array(i), pa.array(s)], ["q", "id", "s"])

    found = rows.mapInArrow(run, "q long, id long, s double").distinct()
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))
    out: dict[int, list[int]] = {}
    for r in found.withColumn("nth", nth).where(F.col("nth") <= k).collect():
        out.setdefault(r["q"], []).append(r["id"])
    return out


def search(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, curves: int = 8, dims: int = 8, bits: int = 7,
    target: float = 0.96, fit_rows: int = 4096, measured: int = 64, largest_block: int = 1 << 16, seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by ``every`` its ``k``
    nearest others found, by inner product of the original vectors.

    Null, zero and non-finite vectors, null ids and vectors of another length than most take no
    part; rows that repeat an id are one candidate, with the least of their vectors; equal vectors tie to the smaller id; an empty
    table gives an empty one. The curves are fitted on ``fit_rows`` rows at most and the window on
    ``measured`` queries at most, chosen by a hash of the id; all rows are ordered and searched.
    """
    spark = vectors.sparkSession
    ready(spark, 2048)
    rows = written(usable(vectors, vec_id, vector).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kinds = {f.name: f.dataType for f in rows.schema}
    total, norm = rows.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()
    if not total:
        return empty
    pick = F.xxhash64("id", F.lit(seed))
    sample = rows.orderBy(pick).limit(fit_rows).toPandas()
    shape = Curves(np.array(sample["v"].tolist(), np.float64), float(norm), curves, dims, bits, seed)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = _matrix(b.column(1)), b.column(0).to_numpy()
            asks = ids % every == 0
            for c, key in enumerate(shape.keys(x, False)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(key), b.column(0), pa.array(np.zeros(len(x), bool)), b.column(1)], ["curve", "key", "id", "ask", "v"])
            if asks.any():
                some = pa.array(asks)
                for c, key in enumerate(shape.keys(x[asks], True)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.array(key), b.column(0).filter(some), pa.array(np.ones(len(key), bool)), b.column(1).filter(some)], ["curve", "key", "id", "ask", "v"])

    kind = kinds["v"].simpleString()
    order = ["curve", "key", "id", "ask"]
    lined = rows.mapInArrow(keyed, f"curve int, key long, id long, ask boolean, v {kind}").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def numbered(batches):
        seen = np.zeros(curves, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            curve, data = b.column(1).to_numpy(), ~b.column(4).to_numpy(zero_copy_only=False)
            local = np.empty(len(curve), np.int64)
            for c in np.unique(curve).tolist():
                own = curve == c
                upto = np.cumsum(data[own])
                local[own] = seen[c] + upto - data[own]
                seen[c] += upto[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), b.column(5), pa.array(local)], ["part", "curve", "id", "ask", "v", "local"])

    lined = lined.select(F.spark_partition_id().alias("part"), *order, "v").mapInArrow(numbered, f"part int, curve int, id long, ask boolean, v {kind}, local long")
    lined = written(lined, "orderings")
    sums = lined.where("NOT ask").groupBy("curve", "part").agg(F.count("*").alias("n")).toPandas().sort_values(["curve", "part"])
    # a row for each curve and partition; a partition without rows of a curve may hold its queries
    grid = pd.DataFrame([(c, p) for c in range(curves) for p in range(parts)], columns=["curve", "part"]).merge(sums, how="left", on=["curve", "part"])
    grid["n"] = grid["n"].fillna(0)
    grid["before"] = grid.groupby("curve")["n"].cumsum() - grid["n"]
    offsets = spark.createDataFrame([(int(c), int(p), int(x)) for c, p, x in zip(grid["curve"], grid["part"], grid["before"], strict=True)], "curve int, part int, before long")
    ranked = lined.join(F.broadcast(offsets), ["curve", "part"]).withColumn("place", F.col("local") + F.col("before"))

    asked = rows.where(F.col("id") % every == 0).orderBy(pick).limit(measured).toPandas()
    if asked.empty:
        return empty
    truth = _truth(rows, asked["id"].to_numpy(np.int64), np.array(asked["v"].tolist(), np.float64), k)
    wanted = sorted({i for x in truth.values() for i in x} | set(truth))
    at: dict[tuple[int, bool], np.ndarray] = {}
    for r in ranked.join(F.broadcast(spark.createDataFrame([(i,) for i in wanted] or [(0,)], "id long")), "id").select("curve", "id", "ask", "place").collect():
        at.setdefault((r["id"], r["ask"]), np.zeros(curves, np.int64))[r["curve"]] = r["place"]
    gaps = [int(np.abs(at[q, True] - at[i, False]).min()) for q, found in truth.items() for i in found]
    window = int(np.quantile(gaps, target)) + 1 if gaps else total
    block = int(np.clip(window // 2, 1024, largest_block))
    crowd = -(-(2 * window + 2 * block) // every // 4096) or 1  # parts of the queries that meet a block

    data = ranked.where("NOT ask").select("curve", F.floor(F.col("place") / block).alias("block"), "id", "v", F.explode(F.sequence(F.lit(0), F.lit(crowd - 1))).alias("part"))
    reach = F.sequence(F.floor(F.greatest(F.col("place") - window, F.lit(0)) / block), F.floor(F.least(F.col("place") + window, F.lit(total - 1)) / block))
    asks = ranked.where("ask").select("curve", F.explode(reach).alias("block"), "id", "v", F.pmod(F.xxhash64("id"), F.lit(crowd)).cast("int").alias("part"))
    asks = asks.toDF(*[f"ask_{c}" for c in asks.columns])  # a cogroup needs sides without common columns

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            x, ids, q, own = _matrix(left["v"]), left["id"].to_numpy(), _matrix(right["ask_v"]), right["ask_id"].to_numpy()
            for a in range(0, len(q), 256):
                rough = q[a : a + 256] @ x.T
                for j in range(len(rough)):
                    i, s = best(q[a + j], own[a + j], x, ids, rough[j], k)
                    for column, value in zip(out, (np.full(len(i), own[a + j]), i, s), strict=True):
                        column.append(value)
        return pa.table([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    keys = ["curve", "block", "part"]
    met = data.groupBy(*keys).cogroup(asks.groupBy(*[f"ask_{c}" for c in keys])).applyInArrow(meet, "query_id long, vec_id long, score double")
    merged = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", nth.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
