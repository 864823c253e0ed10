"""Groups of spelling variants by full neighbourhood generation.

Every word emits all its distinct deletions, replacements and insertions over the alphabet that the
vocabulary shows, and these candidates are hash-joined with the vocabulary: what joins is near, and no
distance is computed. A word of ten letters has about a thousand candidates, so they are made as
numbers first (the hash of a candidate follows from the word's prefix and suffix hashes), and only
those that a bitmap of the vocabulary's hashes lets pass become strings and are shuffled. The bitmap
has 32 bits a word and a fixed largest size; where it is full it lets more pass, and the
join stays exact. No candidate is met by more words than a neighbourhood holds, so no key is hot.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ready, written
from .words import mixed

#: Letters of words: A-Z, a-z and U+00C0..U+00FF; in Latin-1 each is one byte. All else separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20241103).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

#: Bits of the bitmap that one task gathers, and of the whole bitmap at most (128 MB).
SEGMENT_BITS, MOST_BITS = 1 << 20, 1 << 30


def misspelt(doc_id: int | None, word: bytes, every: int) -> bytes:
    """``word`` (Latin-1) without one letter, where the crc32 of ``<doc_id>:<word>`` is divisible by ``every``."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":"))
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, every: int = 31, flush: int = 200_000) -> DataFrame:
    """``word, n``: the words of at least ``least_length`` letters and ``least_count`` occurrences in whole texts.

    Words are counted in each task before the shuffle, ``flush`` distinct ones at a time."""

    def run(batches):
        total: Counter = Counter()

        def out():
            names = pa.array([w.decode("latin-1") for w in total], pa.string())
            found = pa.RecordBatch.from_arrays([names, pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return found

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # letters beyond U+00FF become "?", which separates
                own = Counter(w for w in (t or "").encode("latin-1", "replace").translate(_TABLE).split() if len(w) >= least_length)
                for w, n in own.items():
                    w = misspelt(d, w, every)
                    if len(w) >= least_length:
                        total[w] += n
                if len(total) >= flush:
                    yield out()
        if total:
            yield out()

    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _letters(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _weights(length: int) -> np.ndarray:
    """Powers of the base: of the last letter first."""
    return np.cumprod(np.array([1] + [_BASE] * length, np.uint64), dtype=np.uint64)


def _hashed(letters: np.ndarray) -> np.ndarray:
    power = _weights(letters.shape[1])
    return (_LETTER[letters] * power[letters.shape[1] - 1 :: -1][: letters.shape[1]]).sum(axis=1, dtype=np.uint64)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a bitmap of ``bits`` (a power of two) for each hash."""
    h = mixed(hashes)
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def _by_length(words: list[str]):
    """For each length: positions of its words, and their letters."""
    raw = [w.encode("latin-1") for w in words]
    lengths = np.array([len(w) for w in raw])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, _letters([raw[i] for i in at])


def neighbourhood(letters: np.ndarray, alphabet: np.ndarray, most: int = 1 << 20):
    """The distinct neighbours of words of one length, as ``(kind, first place, hashes, wanted)``: arrays over word,
    place (from the first one on) and, but for deletions, letter of the alphabet, of about ``most`` numbers, so
    very long words take no more memory. ``wanted`` marks one of each set of equal candidates: a letter is deleted or
    inserted only where the letter before is another one."""
    k, n = letters.shape
    power = _weights(n + 1)
    own = _LETTER[letters] * power[n - 1 :: -1][:n]
    before = np.zeros((k, n + 1), np.uint64)
    np.cumsum(own, axis=1, dtype=np.uint64, out=before[:, 1:])
    whole = before[:, -1:]
    new = _LETTER[alphabet]
    same = np.zeros((k, n + 1), bool)  # as the letter before
    same[:, 1:n] = letters[:, 1:] == letters[:, :-1]
    step = max(1, most // max(k * len(alphabet), 1))
    for a in range(0, n + 1, step):
        b = min(a + step, n)
        yield "deletion", a, before[:, a:b] * np.uint64(_INVERSE) + whole - before[:, a + 1 : b + 1], ~same[:, a:b]
        at = power[n - 1 - np.arange(a, b)]
        yield "replacement", a, (whole - own[:, a:b])[:, :, None] + at[None, :, None] * new[None, None, :], letters[:, a:b, None] != alphabet
        b = min(a + step, n + 1)
        at = power[n - np.arange(a, b)]
        other = np.ones((k, b - a, len(alphabet)), bool)
        first = max(a, 1)
        other[:, first - a :] = letters[:, first - 1 : b - 1, None] != alphabet
        yield "insertion", a, (before[:, a:b] * np.uint64(_BASE) + whole - before[:, a:b])[:, :, None] + at[None, :, None] * new[None, None, :], other


def _candidate(word: bytes, kind: str, at: int, letter: int) -> str:
    middle = b"" if kind == "deletion" else bytes((letter,))
    return (word[:at] + middle + word[at + (kind != "insertion") :]).decode("latin-1")


def _bitmap(words: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the words' hashes, gathered a segment a task: its size is bounded by ``MOST_BITS``."""
    bits = SEGMENT_BITS
    while bits < min(32 * n, MOST_BITS):
        bits *= 2

    def places(batches):
        for batch in batches:
            for _, letters in _by_length(batch.column(0).to_pylist()):
                at = np.concatenate(_places(_hashed(letters), bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at // SEGMENT_BITS), pa.array(at % SEGMENT_BITS)], ["segment", "place"])

    def gathered(key, table):
        own = np.zeros(SEGMENT_BITS, bool)
        own[table["place"].to_numpy()] = True
        return pa.table({"segment": [key[0].as_py()], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    found = words.select("word").mapInArrow(places, "segment long, place long").groupBy("segment").applyInArrow(gathered, "segment long, bits binary").toArrow()
    whole = np.zeros((bits // SEGMENT_BITS, SEGMENT_BITS // 8), np.uint8)
    for i, own in zip(found["segment"].to_pylist(), found["bits"].to_pylist(), strict=True):
        whole[i] = np.frombuffer(own, np.uint8)
    return whole.reshape(-1)


def near_words(words: DataFrame, *, block: int = 256) -> DataFrame:
    """``word, near, near_n`` for all pairs of ``words`` (``word, n``; each once) that differ by one inserted, deleted
    or replaced letter, in both directions."""
    spark = words.sparkSession
    n = words.count()
    alphabet = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").distinct().toPandas()["letter"]  # letters of Latin-1: 256 at most
    alphabet = np.array(sorted(ord(c) for c in alphabet), np.uint8)
    shared = spark.sparkContext.broadcast(_bitmap(words, n))

    def run(batches):
        bitmap = shared.value
        bits = len(bitmap) * 8

        def known(place):
            return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                names = batch.column(0).slice(at, block).to_pylist()
                raw = [w.encode("latin-1") for w in names]
                who, candidates = [], []
                for rows, letters in _by_length(names):
                    for kind, start, hashes, wanted in neighbourhood(letters, alphabet):
                        hit = np.nonzero(wanted)
                        one, two = _places(hashes[hit], bits)
                        first = np.flatnonzero(known(one))
                        first = first[known(two[first])]
                        hit = [x[first] for x in hit]
                        letter = alphabet[hit[2]] if len(hit) > 2 else np.zeros(len(first), np.uint8)
                        for i, place, c in zip(rows[hit[0]].tolist(), (hit[1] + start).tolist(), letter.tolist(), strict=True):
                            who.append(names[i])
                            candidates.append(_candidate(raw[i], kind, place, c))
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(candidates, pa.string())], ["word", "near"])

    candidates = words.select("word").mapInArrow(run, "word string, near string")
    return candidates.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words with a form, by doubling: counts grow tenfold along a chain, so chains are short."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = cut(now.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return now
        now = step.drop("moved")


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, every: int = 31, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary.

    A word's ``form`` is the near word of largest count (ties: the first in code-point order) where that is
    ``ratio`` times its own or more; ``root`` is the last of the chain of forms, the word itself without one.
    Null and empty texts have no words, very long ones are read whole. A row with a null id
    hashes as an empty id. Repeated rows count again; an empty table gives an empty one; other columns
    play no part.
    """
    ready(docs.sparkSession)
    words = written(vocabulary(docs, doc_id=doc_id, text=text, least_length=least_length, least_count=least_count, every=every), "vocabulary")
    pairs = near_words(words)
    found = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    enough = F.col("form_n") >= ratio * F.col("n")
    joined = written(joined.select("word", F.when(enough, F.col("form")).alias("form"), "n", "n_near", F.when(enough, F.col("form_n")).alias("form_n")), "forms")
    roots = _roots(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same for ``documents``. crc32 goes byte by byte with a table made by its rule (polynomial 0xEDB88320). Two
#: words of one length are near if they are equal without the letter at one place, others if one is the other without a letter.
SQL = r"""
WITH RECURSIVE bits(v, c, k) AS (
    SELECT i, i, 0 FROM range(256) t(i)
    UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL
),
hashed AS (
    SELECT run, n, xor(list_reduce(
        list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT),
        lambda a, b: xor(t[xor(a, b) % 256 + 1], a >> 8), 4294967295::BIGINT), 4294967295) AS h
    FROM runs, crc
),
spelt AS (
    SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS form, max(n) AS form_n FROM near GROUP BY word),
formed AS (
    SELECT w.word, CASE WHEN form_n >= 10 * w.n THEN form END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word
),
chain(word, upto) AS (
    SELECT word, word FROM formed
    UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.upto = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.upto AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed l ON l.word = c.upto WHERE l.form IS NULL
"""
