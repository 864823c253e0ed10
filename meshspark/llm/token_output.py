"""Token ids as binary blocks under a canonical length-limited Huffman code.

A stored table has two parts. ``code`` holds (id, bits) for every id that occurs; the code words
follow from the lengths. ``blocks`` holds one binary block a row, each readable alone:

    magic "TIDB", u16 version, u16 longest code, u32 documents, u32 ids, u64 index of the first
    id, u32 ids between checkpoints; then i64 document ids, u8 null flags, u32 ids per document,
    u16 bits between checkpoints, which stand at every so many ids, and the bits (big-endian words
    of 32).

Decoding looks up the next ``longest`` bits in one table and runs from all checkpoints of a block
at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path
from .common import ready, shared_dir, text_or_empty, written

HEADER = struct.Struct("<4sHHIIQI")
LONGEST = 18
BLOCK_IDS = 1 << 16
EVERY = 64


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(longest):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        levels.append(at < len(leaves))
        both = both[at]
        both = both[: len(both) // 2 * 2]
        packages = both[0::2] + both[1::2]
    need = 2 * len(leaves) - 2
    for leaf in reversed(levels):
        own = int(leaf[:need].sum())
        out[order[:own]] += 1
        need = 2 * (need - own)
    return out


class Code:
    """Canonical code words for given lengths: ascending by (length, id)."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        bits = self.lengths[order]
        self.longest = int(bits.max()) if len(bits) else 1
        room = np.int64(1) << (self.longest - bits)
        first = np.cumsum(room) - room
        self.words = np.zeros(len(lengths), np.uint64)
        self.words[order] = (first >> (self.longest - bits)).astype(np.uint64)
        # for every value of the next bits: the id and, in the low byte, its length
        self.found = np.ones(1 << self.longest, np.uint64)
        self.found[: int(room.sum())] = np.repeat(order << 8 | bits, room).astype(np.uint64)

    def encode(self, ids: np.ndarray, every: int = EVERY) -> tuple[np.ndarray, bytes]:
        """Bit offsets of every ``every``-th id, and the bits."""
        if not len(ids):
            return np.empty(0, np.uint32), b""
        bits = self.lengths[ids]
        if not bits.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(bits)
        starts = ends - bits
        wide = self.words[ids] << (64 - (starts & 31) - bits).astype(np.uint64)
        word = starts >> 5
        runs = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros((int(ends[-1]) + 31) // 32 + 1, np.uint64)
        out[word[runs]] += np.add.reduceat(wide >> np.uint64(32), runs)
        out[word[runs] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), runs)
        return starts[::every].astype(np.uint32), out[: (int(ends[-1]) + 31) // 32].astype(">u4").tobytes()

    def decode(self, n: int, checkpoints: np.ndarray, bits: bytes, every: int) -> np.ndarray:
        if not n:
            return np.empty(0, np.uint32)
        u = np.uint64
        words = np.concatenate([np.frombuffer(bits, ">u4").astype(u), np.zeros(every * self.longest // 32 + 3, u)])
        pairs = words[:-1] << u(32) | words[1:]
        at, out = checkpoints.astype(u), np.empty((every, len(checkpoints)), u)
        mask, top, five, low = u((1 << self.longest) - 1), u(64 - self.longest), u(5), u(31)
        for k in range(every):
            found = self.found[pairs[at >> five] >> (top - (at & low)) & mask]
            out[k] = found
            at += found & u(255)
        return (out.T.reshape(-1)[:n] >> u(8)).astype(np.uint32)


def to_block(code: Code, doc_ids: list, lengths: np.ndarray, ids: np.ndarray, start: int, every: int = EVERY) -> bytes:
    points, bits = code.encode(ids, every)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = HEADER.pack(b"TIDB", 1, code.longest, len(doc_ids), len(ids), start, every)
    return b"".join([head, known.tobytes(), null.tobytes(), lengths.astype("<u4").tobytes(), np.diff(points.astype(np.int64), prepend=0).astype("<u2").tobytes(), bits])


def from_block(code: Code, data: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """Document ids, ids per document, all ids, and the index of the first."""
    magic, version, longest, n_docs, n, start, every = HEADER.unpack_from(data)
    if magic != b"TIDB" or version != 1 or longest != code.longest:
        raise ValueError("not a block of this table")
    at = HEADER.size
    known = np.frombuffer(data, "<i8", n_docs, at)
    null = np.frombuffer(data, np.uint8, n_docs, at := at + 8 * n_docs)
    lengths = np.frombuffer(data, "<u4", n_docs, at := at + n_docs).astype(np.int64)
    gaps = np.frombuffer(data, "<u2", -(-n // every), at := at + 4 * n_docs)
    ids = code.decode(n, np.cumsum(gaps, dtype=np.int64), data[at + 2 * len(gaps) :], every)
    return [None if z else d for d, z in zip(known.tolist(), null.tolist(), strict=True)], lengths, ids, start


def _id_blocks(docs: DataFrame, doc_id: str, text: str, path: str, end_id: int, block_ids: int, parts: int, kind: str) -> DataFrame:
    """Raw ids in ascending order of document id (null last, ties by a hash of the text), in blocks."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(F.col(text)).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_last(), F.col("h")]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "text")

    def run(batches):
        made = encoder(path)
        doc_ids, lengths, ids, held, start, part, block = [], [], [], 0, 0, 0, 0

        def out():
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int64()), "start": pa.array([start], pa.int64()), "n": pa.array([len(flat)], pa.int64()), "docs": pa.array([doc_ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())), "ids": pa.array([flat.astype(kind).tobytes()], pa.binary())}
            )

        for b in batches:
            part = b.column(0)[0].as_py() if b.num_rows else part
            flat, per = made.encode(b.column(2).to_pylist())
            for d, own in zip(b.column(1).to_pylist(), np.split(flat, np.cumsum(per)[:-1]), strict=True):
                if held and held + len(own) + 1 > block_ids:
                    yield out()
                    start, block = start + held, block + 1
                    doc_ids, lengths, ids, held = [], [], [], 0
                doc_ids.append(d)
                lengths.append(len(own) + 1)
                ids += [own, np.array([end_id], np.uint32)]
                held += len(own) + 1
        if held:
            yield out()

    return placed.mapInArrow(run, "part int, block long, start long, n long, docs array<long>, lengths array<long>, ids binary")


def _ids_in(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write_tokens(docs: DataFrame, where: str, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS, every: int = EVERY, parts: int | None = None) -> None:
    """Encode all texts, each ended by ``end_id``, and store them under ``where`` in ascending id order.

    Null texts are empty (one id); a document longer than a block has a block of its own; null ids
    come last; repeated rows stay; an empty table stores an empty one. Other columns play no part.
    The driver holds counts by id (the vocabulary's size) and a total for each partition.
    """
    spark = docs.sparkSession
    ready(spark)
    path = vocabulary or vocabulary_path()
    kind = "<u2" if _ids_in(path) <= 1 << 16 else "<u4"
    blocks = written(_id_blocks(docs, doc_id, text, path, end_id, block_ids, parts or int(spark.conf.get("spark.sql.shuffle.partitions")), kind), "ids", compression="lz4")

    def count(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            for x in b.column(0):
                own = np.bincount(np.frombuffer(x.as_buffer(), kind))
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counted = blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    totals = blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toPandas()
    first = dict(zip(totals["part"].tolist(), (totals["n"].cumsum() - totals["n"]).tolist(), strict=True))
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{where}/code")

    def pack(batches):
        code = Code(lengths)
        for b in batches:
            data = []
            for part, start, docs_, own, raw in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), strict=True):
                data.append(to_block(code, docs_, np.array(own, np.int64), np.frombuffer(raw.as_buffer(), kind), first[part] + start, every))
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["data"])

    packed = blocks.select("part", "start", "docs", "lengths", "ids").mapInArrow(pack, "data binary")
    packed.write.option("compression", "none").parquet(f"{where}/blocks")


def read_tokens(spark: SparkSession, where: str, *, raw: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, and with ``raw`` its ``ids``."""
    table = spark.read.parquet(f"{where}/code").toPandas()
    lengths = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.int64)
    lengths[table["id"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def unpack(batches):
        code = Code(lengths)
        for b in batches:
            for x in b.column(0):
                docs_, own, ids, start = from_block(code, x.as_buffer().to_pybytes())
                ends = np.cumsum(own)
                flat = memoryview(ids.astype("<u4").tobytes())
                bytes_ = [flat[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), own.tolist(), strict=True)]
                columns = [pa.array(docs_, pa.int64()), pa.array(start + ends - own, pa.int64()), pa.array(own, pa.int64()), pa.array([zlib.crc32(x) for x in bytes_], pa.int64())]
                if raw:
                    columns.append(pa.array([bytes(x) for x in bytes_], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids"][: len(columns)])

    return spark.read.schema("data binary").parquet(f"{where}/blocks").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * raw)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Store ``docs`` in a new table of the shared folder and read it back."""
    spark = docs.sparkSession
    where = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, where, **options)
    return read_tokens(spark, where)
