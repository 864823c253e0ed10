"""WARC archives: written by tasks, and read back by byte ranges that split between gzip members.

A record is one gzip member. Writers stream members to files named at random in a folder that driver and
executors share, and what they wrote stands in a manifest that Spark commits: files of lost or repeated
tasks are not in it.

The reader deals byte ranges of the files to tasks. A task looks for the gzip magic in its range and
tries each place: what inflates to a WARC header, then to as many bytes as the header says, with the member's
check sum right, is a member, and belongs to the task if it starts inside its range, wherever it ends.
The search goes on behind it. Starts and ends form an index. A payload can itself hold an archive
that was not compressed again, whose members look real to a range that starts amid them; so members must tile
their file, each starting where the one before ends, and a file where they don't is walked from its
first byte.
"""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ready, shared_dir, spread_join, text_or_empty, written

MAGIC = b"\x1f\x8b\x08"
_CHUNK, _AHEAD = 1 << 15, 1 << 20
_DATE = "2024-01-01T00:00:00Z"

RECORD = "path string, offset long, record_type string, record_id string, refers_to string, uri string, page_id long, digest string, payload binary"


def _open(path: str):
    """The file system of a path or address, and the path there."""
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


# --- writing -------------------------------------------------------------------------------------


def _one_line(value: str) -> str:
    """A header's value: characters that would end its line are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(fields: dict[str, str | None], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member. Fields that are None are left out."""
    head = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields.items() if v is not None)
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()) + press.compress(block) + press.compress(b"\r\n\r\n") + press.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """A page as a response, or as a revisit of the page ``refers_to`` (which has the same payload)."""
    revisit = refers_to is not None
    kind = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}:{digest}>"}
    if revisit:
        kind |= {"WARC-Refers-To": f"<urn:page:{refers_to}:{digest}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    rest = {"WARC-Date": _DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}", "Page-ID": None if page_id is None else str(page_id), "Content-Type": "application/http;msgtype=response"}
    return member(kind | rest, head if revisit else head + payload, level)


def write_archives(records: DataFrame, folder: str, *, level: int = 6, roll: int = 1 << 30) -> DataFrame:
    """``path, records, bytes`` of the files written from ``page_id, url, payload, digest, refers_to``.

    A task writes one file after another of about ``roll`` bytes. Files begin with a warcinfo record."""
    spark = records.sparkSession
    ready(spark)
    where, top = _open(folder)
    where.create_dir(top, recursive=True)

    def run(batches):
        out, path, n, size = None, None, 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns, strict=True):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    where, at = _open(path)
                    out = where.open_output_stream(at, compression=None)
                    info = b"software: pages\r\nformat: WARC File Format 1.1\r\n"
                    size += out.write(member({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": _DATE, "Content-Type": "application/warc-fields"}, info, level))
                size += out.write(page_member(*row, level))
                n += 1
                if size >= roll:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])

    rows = records.select("page_id", "url", "payload", "digest", "refers_to")
    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def page_records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: pages whose payload of ``least`` bytes or more is that of a page
    of smaller id refer to the smallest such id."""
    payload = F.encode(text_or_empty(F.col(html).cast("string")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = cut(rows.where(F.length("payload") >= least).select("page_id", "digest"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").select("digest", "first")
    # only ids of copies are looked up, not whole pages: a payload may be that of a third of all pages
    copies = spread_join(narrow, first, "digest", "page_id", narrow.count()).where("page_id IS NULL OR page_id > first").distinct()
    copies = copies.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
    return rows.join(copies, rows["page_id"].eqNullSafe(copies["_page"]) & (rows["digest"] == copies["_digest"]), "left").drop("_page", "_digest")


# --- reading -------------------------------------------------------------------------------------


class _Window:
    """Bytes of a file from a place on, read as they are asked for."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.at, self.data = at, self.file.read_at(min(max(n, _AHEAD), self.size - at), at)
        return self.data[at - self.at : at - self.at + n]


def _inflate(window: _Window, start: int, sink, most_head: int = 1 << 16) -> tuple[int, bytes, int] | None:
    """End, header and block length of the member at ``start``; None if there is none. ``sink`` takes the block's bytes."""
    press, head, length, done, at = zlib.decompressobj(31), b"", -1, 0, start
    try:
        while not press.eof:
            raw = window.get(at, _CHUNK)
            if not raw:
                return None
            at += len(raw)
            more = True
            while more and not press.eof:
                got = press.decompress(raw, 1 << 20)
                raw = press.unconsumed_tail
                more = bool(raw) or len(got) == 1 << 20
                if length < 0:
                    head += got
                    if not b"WARC/".startswith(head[:5]) and not head.startswith(b"WARC/"):
                        return None
                    cut_at = head.find(b"\r\n\r\n")
                    if cut_at < 0:
                        if len(head) > most_head:
                            return None
                        continue
                    head, got = head[: cut_at + 4], head[cut_at + 4 :]
                    said = re.search(rb"(?mi)^content-length:[ \t]*(\d+)[ \t]*\r$", head)
                    if not said:
                        return None
                    length = int(said[1])
                if sink is not None and done < length:
                    sink(got[: length - done])
                done += len(got)
            if press.eof:
                at -= len(press.unused_data)
    except zlib.error:
        return None
    return (at, head, length) if length >= 0 and done == length + 4 else None


def _members(window: _Window, low: int, high: int):
    """Start and end of the members that start in ``[low, high)``."""
    at = low
    while at < high:
        block = window.get(at, min(_CHUNK, high - at + len(MAGIC) - 1))
        found = block.find(MAGIC)
        if found < 0:
            at += max(len(block) - len(MAGIC) + 1, 1)
            continue
        at += found
        if at >= high:
            return
        member = _inflate(window, at, None)
        if member is None:
            at += 1
        else:
            yield at, member[0]
            at = member[0]


def _walk(window: _Window):
    """Start and end of all members of a file, from its first byte on."""
    at = 0
    while at < window.size:
        member = _inflate(window, at, None)
        if member is None:
            raise ValueError(f"no WARC record at byte {at}")
        yield at, member[0]
        at = member[0]


def archive_index(files: DataFrame, *, range_bytes: int = 4 << 20) -> DataFrame:
    """``path, offset, end`` of every record in ``files`` (``path, length``), from ranges of ``range_bytes``.

    A file that is not whole records from its first byte to its last is an error. Empty files have none."""
    ready(files.sparkSession)

    def scan(batches):
        for batch in batches:
            for path, size, low in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "low")), strict=True):
                where, at = _open(path)
                with where.open_input_file(at) as file:
                    own = list(_members(_Window(file, size), low, min(low + range_bytes, size)))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(own), pa.string()), pa.array([x for x, _ in own], pa.int64()), pa.array([y for _, y in own], pa.int64())], ["path", "offset", "end"])

    def walk(batches):
        for batch in batches:
            for path, size in zip(*(batch.column(c).to_pylist() for c in ("path", "length")), strict=True):
                where, at = _open(path)
                with where.open_input_file(at) as file:
                    for x, y in _walk(_Window(file, size)):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([x], pa.int64()), pa.array([y], pa.int64())], ["path", "offset", "end"])

    files = cut(files.select("path", "length"))
    parts = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("low"))
    n = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / range_bytes)), F.lit(0))).first()[0]
    least = files.sparkSession.sparkContext.defaultParallelism
    dealt = parts.repartition(max(1, min(int(n), max(4 * least, int(n) // 16))), "path", "low")
    index = written(dealt.mapInArrow(scan, "path string, offset long, end long"), "members")
    # members tile a file if their bytes add up to it and each but the first starts at an end
    ends = index.select("path", F.col("end").alias("offset"), F.lit(1).alias("after"))
    begins = index.select("path", "offset", F.lit(0).alias("after")).unionByName(ends).groupBy("path", "offset").agg(F.sum("after").alias("ends"), F.count("*").alias("met"))
    joints = begins.groupBy("path").agg(F.sum((F.col("met") != 2 * F.col("ends")).cast("int")).alias("loose"))
    sums = index.groupBy("path").agg(F.sum(F.col("end") - F.col("offset")).alias("bytes"))
    whole = files.where("length > 0").join(sums, "path", "left").join(joints, "path", "left")
    # loose are the first start and the last end alone
    bad = cut(whole.where("coalesce(bytes, 0) <> length OR loose <> 2").select("path", "length"))
    if bad.isEmpty():
        return index
    again = written(bad.repartition(max(1, min(bad.count(), 4 * least)), "path").mapInArrow(walk, "path string, offset long, end long"), "members")
    return index.join(bad.select("path"), "path", "left_anti").unionByName(again)


def _parsed(head: bytes, block: bytes) -> dict:
    """Columns of a record."""
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    payload = block
    if fields.get(b"content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    page = fields.get(b"page-id", "")
    return {
        "record_type": fields.get(b"warc-type"), "record_id": fields.get(b"warc-record-id"), "refers_to": fields.get(b"warc-refers-to"), "uri": fields.get(b"warc-target-uri"),
        "page_id": int(page) if re.fullmatch(r"-?\d+", page) else None, "digest": fields.get(b"warc-payload-digest"), "payload": payload,
    }


def read_records(index: DataFrame, *, task_bytes: int = 32 << 20, batch_bytes: int = 4 << 20) -> DataFrame:
    """The records of an index: ``path, offset, record_type, record_id, refers_to, uri, page_id, digest, payload``.

    The payload is what follows the HTTP header, or the whole block of records that hold none. That of a
    revisit is empty."""
    ready(index.sparkSession)
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64())] + [(c, pa.string()) for c in ("record_type", "record_id", "refers_to", "uri")] + [("page_id", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])

    def run(batches):
        file, window, name, rows, size = None, None, None, [], 0
        for batch in batches:
            for path, offset, end in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "end")), strict=True):
                if path != name:
                    if file is not None:
                        file.close()
                    where, at = _open(path)
                    name, file = path, where.open_input_file(at)
                    window = _Window(file, file.size())
                parts: list[bytes] = []
                found = _inflate(window, offset, parts.append)
                if found is None or found[0] != end:
                    raise ValueError(f"{path}: record at byte {offset} has changed")
                block = b"".join(parts)
                rows.append({"path": path, "offset": offset} | _parsed(found[1], block))
                size += len(block)
                if size >= batch_bytes or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if file is not None:
            file.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    total = index.agg(F.coalesce(F.sum(F.col("end") - F.col("offset")), F.lit(0))).first()[0]
    # tasks read stretches of about equal bytes, whatever the number of records there
    dealt = index.select("path", "offset", "end").repartition(max(1, -(-total // task_bytes) * 2), "path", F.floor(F.col("offset") / (task_bytes // 4)))
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(run, RECORD)


def archives(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, length`` of the files at ``paths`` (folders and patterns too), listed by Spark."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length")


def resolved(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of responses and revisits, a revisit with
    size and digest of the response that it names by its record id (where that isn't there: without size, its own digest)."""
    size, digest = F.length("payload").cast("long"), F.sha2("payload", 256)
    known = records.where("record_type IN ('response', 'revisit')").withColumn("said", F.regexp_extract("digest", "^sha256:(.*)$", 1))
    narrow = written(known.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "record_id", F.coalesce("refers_to", F.lit("")).alias("refers_to"), "said"), "records")
    own = narrow.where("record_type = 'response'")
    named = own.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("target"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d")).dropDuplicates(["refers_to"])
    again = narrow.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "said", F.xxhash64("page_id", "record_id").alias("row"))
    named = again.select("refers_to").distinct().join(named, "refers_to", "left")
    again = spread_join(again, named, "refers_to", "row", narrow.count())
    again = again.select("page_id", F.col("n").alias("payload_bytes"), F.coalesce("d", "said").alias("payload_digest"), "record_type", F.col("target").alias("refers_to"))
    return own.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(again)


def round_trip(pages: DataFrame, *, range_bytes: int = 4 << 20, level: int = 6) -> DataFrame:
    """``pages`` written as archives and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null html is an empty payload, very long ones are one record. Rows with a null url have no address; a row with a null id
    revisits a page of equal payload that has an id, else it is a response. Rows that repeat the smallest id of equal
    payloads are all responses. An empty table gives an empty one; other columns play no part.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(page_records(pages), folder, level=level)
    files = manifest.select("path", F.col("bytes").alias("length"))
    return resolved(read_records(archive_index(files, range_bytes=range_bytes)))


#: The same for ``pages``.
SQL = """
WITH sized AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM sized)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND coalesce(page_id > first, first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND coalesce(page_id > first, first IS NOT NULL) THEN first END AS refers_to
FROM firsts
"""
