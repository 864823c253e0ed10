"""Ranked lexical search by MaxScore over the shards of an inverted index.

``build_index`` inverts documents where they are read: each task gathers texts up to a size and writes
their postings as a segment, without a shuffle. A segment has one row a term (``docs`` and
``tfs`` as little-endian 32-bit numbers, ``docs`` as steps between ordinals) and one row without a
term that holds the ids and lengths of its documents. Segments are the shards: their size is
bounded whatever the corpus.

``search`` sends the postings of the terms asked for to one task a segment. There each item's terms
are ordered by the largest score they give in the segment. The terms of the least bounds, as long as
the sum of these is under the score to beat, are non-essential: documents that hold only such terms can't
qualify. The lists of the others are merged, a block of documents at a time, and the non-essential ones are
probed from the largest bound down, only for documents that can still reach the score to beat, which
rises from block to block. A first wave over few segments gives the others a score to begin with.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ready, written

#: Letters of terms: digits, A-Z, a-z and all bytes of letters beyond U+007F. All else separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_INDEX = "segment long, term string, n_docs long, n_terms long, docs binary, tfs binary, ids array<long>"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats; null has none."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = 16 << 20, segment_docs: int = 1 << 16) -> DataFrame:
    """The index of all ``docs`` as a written table. A segment ends with the document that brings it to
    ``segment_bytes`` of text or ``segment_docs`` rows; a very long text is one segment at most longer."""

    def invert(number: int, ids: list, flat: list, lengths: list):
        """Postings of one segment, as batches."""
        known: dict[bytes, int] = {}
        term = np.fromiter((known.setdefault(w, len(known)) for w in flat), np.int64, len(flat))
        where = np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
        key, tf = np.unique(term * len(ids) + where, return_counts=True)
        term, where = key // max(len(ids), 1), (key % max(len(ids), 1)).astype("<i4")
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        step = np.diff(where, prepend=0).astype("<i4")
        step[starts] = where[starts]
        n = np.diff(np.append(starts, len(key)))
        offsets = np.append(starts, len(key)).astype(np.int64) * 4
        names = pa.array([w.decode("utf-8") for w in known], pa.string())
        lists = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in (step, tf.astype("<i4"))]
        none = pa.nulls(len(n), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number)), names, pa.array(n, pa.int64()), pa.array(np.add.reduceat(tf, starts) if len(n) else n, pa.int64()), *lists, none], ["segment", "term", "n_docs", "n_terms", "docs", "tfs", "ids"])
        own = np.array(lengths, "<i4")
        yield pa.RecordBatch.from_pylist([{"segment": number, "term": None, "n_docs": int((own > 0).sum()), "n_terms": int(own.sum(dtype=np.int64)), "docs": own.tobytes(), "tfs": None, "ids": ids}], schema=pa.schema([("segment", pa.int64()), ("term", pa.string()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("docs", pa.binary()), ("tfs", pa.binary()), ("ids", pa.list_(pa.int64()))]))

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        ids, flat, lengths, size = [], [], [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = terms_of(t)
                ids.append(d)
                flat += own
                lengths.append(len(own))
                size += len(t or "")
                if size >= segment_bytes or len(ids) >= segment_docs:
                    yield from invert(number, ids, flat, lengths)
                    number += 1
                    ids, flat, lengths, size = [], [], [], 0
        if ids:
            yield from invert(number, ids, flat, lengths)

    ready(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return written(source.mapInArrow(run, _INDEX), "index")


class Shard:
    """The postings of one segment for the terms asked for, with their scores."""

    def __init__(self, table: pa.Table, weights: dict[str, int], n: int, total: int, k: int) -> None:
        self.lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.most: dict[str, int] = {}
        self.kth: dict[str, int] = {}
        rows = table.select(["term", "docs", "tfs"]).to_pylist()
        head = next(i for i, r in enumerate(rows) if r["term"] is None)
        self.ids = table["ids"][head].as_py()
        lengths = np.frombuffer(rows[head]["docs"], "<i4").astype(np.int64)
        norm = 100 - 50 + (50 * lengths * n) // max(total, 1)
        for r in rows:
            if r["term"] in weights and r["term"] is not None:
                docs, tf = np.cumsum(np.frombuffer(r["docs"], "<i4")), np.frombuffer(r["tfs"], "<i4").astype(np.int64)
                score = weights[r["term"]] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[docs]))
                self.lists[r["term"]] = docs, score
                self.most[r["term"]] = int(score.max())
                self.kth[r["term"]] = int(np.partition(score, -k)[-k]) if len(score) >= k else 0

    def top(self, terms: list[str], k: int, floor: int, block: int = 8192) -> tuple[np.ndarray, np.ndarray, int]:
        """Ordinals and scores of the documents that may be among the ``k`` best, and how many postings were read.

        Documents under ``floor`` and of score 0 are left out; all those that tie with the last are kept."""
        terms = sorted((t for t in terms if t in self.lists), key=lambda t: (self.most[t], t))
        bound = np.cumsum([self.most[t] for t in terms]) if terms else np.zeros(0, np.int64)
        lists = [self.lists[t] for t in terms]
        least = max([floor, 1] + [self.kth[t] for t in terms])
        found, scores, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for low in range(0, len(self.ids), block):
            split = int(np.searchsorted(bound, least, side="left"))  # bounds under the score to beat
            if split == len(terms):
                break
            total, seen = np.zeros(block, np.int64), np.zeros(block, bool)
            for docs, score in lists[split:]:
                a, b = np.searchsorted(docs, (low, low + block))
                total[docs[a:b] - low] += score[a:b]
                seen[docs[a:b] - low] = True
                read += int(b - a)
            at = np.flatnonzero(seen)
            for i in range(split - 1, -1, -1):
                at = at[total[at] + bound[i] >= least]
                if not len(at):
                    break
                docs, score = lists[i]
                place = np.minimum(np.searchsorted(docs, at + low), len(docs) - 1)
                hit = docs[place] == at + low
                total[at[hit]] += score[place[hit]]
                read += len(at)
            at = at[total[at] >= least]
            found, scores = np.append(found, at + low), np.append(scores, total[at])
            if len(scores) > k:
                least = max(least, int(np.partition(scores, -k)[-k]))
                keep = scores >= least
                found, scores = found[keep], scores[keep]
        return found, scores, read


def _best(found: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """The ``k`` best rows of each item: of its parts first, so that an item's rows don't meet in one task at once."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(salts))
    for by in (["item_id", part], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found


def _search_block(index: DataFrame, block: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` for the items of one block (``item_id, term, weight``)."""
    spark = index.sparkSession
    asked = block.toArrow()
    weights = dict(zip(asked["term"].to_pylist(), asked["weight"].to_pylist(), strict=True))
    items: dict[int | None, list[str]] = {}
    for item, term in zip(asked["item_id"].to_pylist(), asked["term"].to_pylist(), strict=True):
        items.setdefault(item, []).append(term)
    shared = spark.sparkContext.broadcast((weights, items))
    wanted = F.broadcast(block.select("term", F.lit(True).alias("wanted")).distinct())
    postings = index.select("segment", "term", "docs", "tfs", "ids").join(wanted, "term", "left").where("term IS NULL OR wanted").drop("wanted")

    def ranked(floors):
        def run(key, table):
            weights, items = shared.value
            least = floors.value
            shard = Shard(table, weights, n, total, k)
            out_item, out_id, out_score = [], [], []
            for item, terms in items.items():
                at, score, _ = shard.top(terms, k, least.get(item, 0))
                # equal scores go by ascending id, nulls last
                best = sorted(zip((-score).tolist(), (math.inf if shard.ids[i] is None else shard.ids[i] for i in at.tolist()), strict=True))[:k]
                out_item += [item] * len(best)
                out_id += [None if d == math.inf else d for _, d in best]
                out_score += [-s for s, _ in best]
            return pa.table({"item_id": pa.array(out_item, pa.int64()), "doc_id": pa.array(out_id, pa.int64()), "score": pa.array(out_score, pa.int64())})

        return run

    first = F.pmod(F.xxhash64("segment"), F.lit(16)) == 0
    none = spark.sparkContext.broadcast({})
    wave = cut(_best(postings.where(first).groupBy("segment").applyInArrow(ranked(none), "item_id long, doc_id long, score long"), k))
    floors = {r["item_id"]: r["score"] for r in wave.where(F.col("rank") == k).select("item_id", "score").collect()}  # a number an item of the block
    rest = postings.where(~first).groupBy("segment").applyInArrow(ranked(spark.sparkContext.broadcast(floors)), "item_id long, doc_id long, score long")
    return _best(wave.drop("rank").unionByName(rest), k)


def search(index: DataFrame, items: DataFrame, *, item_id: str = "item_id", text: str = "text", k: int = 50, block_terms: int = 1_000_000) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of score above 0 for every item.

    Items are a stated set of queries; they are asked in blocks of about ``block_terms`` (item, term) pairs, which is
    what a block's broadcast holds. Items without terms have no rows. Rows that repeat an item's id are one item with the
    terms of all. Documents of a null id count and rank like others, behind equal scores; repeated documents
    are each ranked. An empty index gives no rows; other columns play no part.
    """
    spark = index.sparkSession
    ready(spark)

    def split(batches):
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted({w.decode("utf-8") for w in terms_of(t)})
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array(own, pa.string())], ["item_id", "term"])

    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).mapInArrow(split, "item_id long, term string").distinct()
    asked = cut(asked)
    n, total = index.where("term IS NULL").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = index.where("term IS NOT NULL").select("term", "n_docs").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighed = cut(asked.join(df, "term").select("item_id", "term", weight.alias("weight")))
    blocks = math.ceil(weighed.count() / block_terms)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        block = weighed.where(F.pmod(F.xxhash64("item_id", F.lit(7)), F.lit(blocks)) == b)
        if not block.isEmpty():
            out = out.unionByName(_search_block(index, block, n, total, k).withColumn("rank", F.col("rank").cast("int")))
    return out


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 50) -> DataFrame:
    """The index of ``docs`` built and asked for all ``items``. Null and empty texts hold no term and
    are not counted in N; very long texts are read whole."""
    return search(build_index(docs), items, k=k)


#: The same for ``documents`` and ``benchmark``.
SQL = r"""
WITH found AS (
    SELECT row, doc_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents)
),
lengths AS (SELECT row, doc_id, count(*) AS n FROM found GROUP BY row, doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
tfs AS (SELECT row, term, count(*) AS tf FROM found GROUP BY row, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (
    SELECT DISTINCT item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
),
scored AS (
    SELECT a.item_id, l.doc_id, l.row, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
        * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * l.n * docs) // total))))::BIGINT AS score
    FROM asked a JOIN dfs USING (term) JOIN tfs t USING (term) JOIN lengths l ON l.row = t.row, corpus
    GROUP BY a.item_id, l.doc_id, l.row
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
