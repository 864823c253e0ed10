"""Spelling variants, ranked search and WARC archives against plain loops and exact round trips."""

import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.llm import lexical, spelling, warc

from conftest import SCHEMA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))


# --- spelling variants ---------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, found in by.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(by[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


def variant_rows():
    rng = np.random.default_rng(3)
    base = ["national", "straße", "élevage", "überall", "aaaaaaaa", "naÿveté", "fö×rmat÷on", "banananana"]
    rows = []
    for i in range(150):
        own = []
        for _ in range(40):
            w = base[rng.integers(len(base)) if rng.random() < 0.5 else 0]
            if rng.random() < 0.12:
                at = rng.integers(len(w) + 1)
                kind = rng.integers(3)
                c = "abné"[rng.integers(4)]
                w = w[:at] + ("" if kind == 0 else c) + w[at + (kind != 1) :]
            own.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(own) + ". Łódźkowska 東京東京東京東京 NATIONAL"))
    return rows + [(None, "national nationak nationak"), (500, None), (501, ""), (502, "x" * 300_000), (503, "x" * 300_000), (3, rows[3][1])]


def test_variants_are_those_of_a_plain_loop(spark):
    rows = variant_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit(7) for c in ("word", "n", "near", "form")})
    assert collected(spelling.variants(docs), "word", "form", "root", "n", "n_near", "form_n") == sorted(brute_variants(rows), key=lambda t: tuple((x is None, x) for x in t))


def test_variants_of_empty_tables(spark, none):
    assert spelling.variants(none).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")).count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    words = {"a" * 7: 2, "a" * 8: 20, "a" * 9: 200, "a" * 10: 2000}
    # doc ids are sought for which no word loses a letter
    free = [d for d in range(3000) if all(zlib.crc32(f"{d}:{w}".encode()) % 31 for w in words)]
    rows = [(free[i], " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    found = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {"a" * n: ("a" * (n + 1) if n < 10 else None, "a" * 10) for n in range(7, 11)}


@pytest.mark.parametrize("most", [1, 12, 1 << 20])
@pytest.mark.parametrize("word", ["banana", "aab", "zz", "abc", "a"])
def test_neighbourhood_is_whole_and_distinct(word, most):
    alphabet = np.frombuffer(b"abcnz", np.uint8)
    letters = np.frombuffer(word.encode(), np.uint8).reshape(1, -1)
    own, hashes = [], []
    for kind, start, h, wanted in spelling.neighbourhood(letters, alphabet, most):
        hit = np.nonzero(wanted)
        letter = alphabet[hit[2]] if len(hit) > 2 else np.zeros(len(hit[0]), np.uint8)
        own += [spelling._candidate(word.encode(), kind, int(p) + start, int(c)) for p, c in zip(hit[1], letter)]
        hashes += h[hit].tolist()
    expected = {word[:i] + word[i + 1 :] for i in range(len(word))}
    expected |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abcnz" if c != word[i]}
    expected |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abcnz"}
    assert len(own) == len(set(own)) and set(own) == expected
    assert hashes == [int(spelling._hashed(np.frombuffer(w.encode(), np.uint8).reshape(1, -1))[0]) for w in own]


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = [r for r in variant_rows() if len(r[1] or "") < 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = spelling.vocabulary(docs)
    every = {(r["word"], r["near"]) for r in spelling.near_words(words).collect()}
    monkeypatch.setattr(spelling, "_bitmap", lambda words, n: np.full(1 << 10, 255, np.uint8))
    assert {(r["word"], r["near"]) for r in spelling.near_words(words).collect()} == every and every


# --- ranked search -------------------------------------------------------------------------------


def brute_search(docs, items, k=50):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [Counter(w.translate(LOWER) for w in pattern.findall(t or "")) for _, t in docs]
    length = [sum(c.values()) for c in terms]
    n, total = sum(x > 0 for x in length), sum(length)
    df = Counter(w for c in terms for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= {w.translate(LOWER) for w in pattern.findall(t or "")}
    out = []
    for i, own in asked.items():
        scored = []
        for (d, _), c, size in zip(docs, terms, length):
            m = 100 - 50 + (50 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in own if c[w])
            if score > 0:
                scored.append((-score, math.inf if d is None else d))
        out += [(i, rank, None if d == math.inf else d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


def search_rows(texts):
    docs = [(r[0], r[1]) for r in texts] + [(None, "ba ke rare1"), (None, None), (7, texts[7][1]), (300, "rare1 " * 70), (301, "RARE1 éà 42"), (302, "rare1é")]
    items = [(i, " ".join((texts[i][1] or "").split()[:40])) for i in range(0, 60, 4)]
    items += [(100, None), (101, "..."), (102, "the of and"), (103, "rare1 Rare1 RARE1"), (104, "42 éà nowhere"), (None, "rare1 the"), (103, "edit5 suro"), (105, texts[60][1])]
    return docs, items


@pytest.mark.parametrize("size", [(16 << 20, 1 << 16), (4000, 1 << 16), (16 << 20, 3)])
def test_search_is_that_of_a_plain_loop(spark, texts, size):
    docs, items = search_rows(texts)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("term", "segment", "ids", "score", "df")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x"))
    index = lexical.build_index(table, segment_bytes=size[0], segment_docs=size[1])
    for k in (50, 3):
        assert collected(lexical.search(index, asked, k=k), "item_id", "rank", "doc_id", "score") == brute_search(docs, items, k)


def test_search_in_blocks_of_items(spark, texts):
    docs, items = search_rows(texts)
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    found = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k=5, block_terms=150)
    assert collected(found, "item_id", "rank", "doc_id", "score") == brute_search(docs, items, 5)


def test_search_of_empty_tables(spark, none):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked_search(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lexical.ranked_search(docs, items.where("false")).count() == 0


def test_terms_that_cannot_qualify_are_only_probed():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n = 20_000
    every, some = np.arange(n), np.sort(rng.choice(n, 60, replace=False))
    step = lambda x: np.diff(x, prepend=0).astype("<i4").tobytes()
    table = pa.table({"term": [None, "common", "rare"], "docs": pa.array([np.full(n, 10, "<i4").tobytes(), step(every), step(some)], pa.binary()), "tfs": pa.array([None, np.ones(n, "<i4").tobytes(), np.ones(60, "<i4").tobytes()], pa.binary()), "ids": [list(range(n)), None, None]})
    shard = lexical.Shard(table, {"common": 1, "rare": 900}, n, 10 * n, 50)
    at, score, read = shard.top(["common", "rare"], 50, 0)
    assert read == 120 and set(at) == set(some) and (np.diff(score) == 0).all()


# --- archives ------------------------------------------------------------------------------------


def brute_records(rows):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            first[raw] = min(first.get(raw, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        to = first.get(raw)
        revisit = to is not None and (page is None or page > to)
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


def page_rows():
    long = "<p>" + "straße " * 40
    rows = [(i, f"http://h{i % 3}/{i}", f"<html>{'page %d ' % (i % 9) * (i % 40)}</html>") for i in range(120)]
    rows += [(200 + i, "http://copies/ \r\nX-Bad: 1", long) for i in range(50)]
    rows += [(None, None, long), (None, "u", "only null " * 20), (300, None, None), (301, "", ""), (302, "u", "x" * 99), (303, "u", "x" * 99), (304, "u", "x" * 100), (305, "u", "x" * 100)]
    rows += [(310, "u", "".join(chr(33 + (i * i) % 7919 % 90) for i in range(400_000))), (200, "again", long), (320, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9)]
    return rows


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumns({c: F.lit("x") for c in ("digest", "payload", "refers_to", "path", "first")})
    for size in (4 << 20, 1000):
        assert collected(warc.round_trip(pages, range_bytes=size), *COLUMNS) == brute_records(rows)


def test_archives_of_an_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_files_are_plain_gzip_and_addresses_stay_on_their_line(spark, tmp_path):
    rows = page_rows()
    folder = str(tmp_path / "w")
    made = warc.write_archives(warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)), folder, roll=20_000)
    files = made.collect()
    assert sum(r["records"] for r in files) == len(rows) and len(files) > 2
    plain = b"".join(gzip.open(r["path"]).read() for r in files)
    assert plain.count(b"WARC-Type: response") + plain.count(b"WARC-Type: revisit") == len(rows) and b"\r\nX-Bad" not in plain
    found = warc.read_records(warc.archive_index(warc.archives(spark, folder), range_bytes=5000)).where("record_type <> 'warcinfo'")
    assert sorted(r["uri"] or "" for r in found.select("uri").collect()) == sorted((u or "").replace("\r", "%0D").replace("\n", "%0A").strip() for _, u, _ in rows)


def nested_archive():
    """Members among which one holds, uncompressed, an archive of its own; and where each starts."""
    noise = np.random.default_rng(1).integers(0, 256, 3000, np.uint8).tobytes() + warc.MAGIC * 50
    inner = b"".join(warc.member({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:inner:{i}>"}, b"inner %d" % i) for i in range(30))
    blocks = [b"first", noise, inner, b"", b"x" * 90_000]
    members = [warc.member({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:outer:{i}>"}, b, level=0 if b in (noise, inner) else 6) for i, b in enumerate(blocks)]
    return blocks, members


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_members_inside_a_payload_are_no_records(spark, tmp_path, size):
    blocks, members = nested_archive()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    index = warc.archive_index(warc.archives(spark, str(tmp_path)), range_bytes=size)
    starts = np.cumsum([0] + [len(m) for m in members])
    assert collected(index, "offset", "end") == list(zip(starts[:-1].tolist(), starts[1:].tolist()))
    assert [r["payload"] for r in warc.read_records(index).orderBy("offset").collect()] == blocks


def test_broken_archives_are_errors(spark, tmp_path):
    _, members = nested_archive()
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(members)[:-9])
    with pytest.raises(Exception, match="no WARC record at byte"):
        warc.archive_index(warc.archives(spark, str(tmp_path))).count()


def test_revisits_of_absent_responses_keep_their_digest(spark):
    schema = "page_id long, record_type string, record_id string, refers_to string, digest string, payload binary"
    rows = [(1, "revisit", "a", "gone", "sha256:ab", b""), (2, "revisit", "b", None, "sha256:cd", b""), (3, "response", "c", None, None, b"xy")]
    found = warc.resolved(spark.createDataFrame(rows, schema))
    assert collected(found, *COLUMNS) == [(1, None, "ab", "revisit", None), (2, None, "cd", "revisit", None), (3, 2, hashlib.sha256(b"xy").hexdigest(), "response", None)]
