"""Near-duplicate documents by MinHash, banding, verification on full sets and components.

Documents of equal shingle sets form a class, and only its least document is compared. Each set
has ``bands * rows`` minima under universal hashes; sets that agree in a whole band share a
bucket. A bucket of a few sets gives all its pairs. A large one gives each member paired with its
least; where that leaves the members of such buckets in several components, those outside the
largest are compared with all others, in blocks, so no link between members of a bucket is lost. A link needs ``percent`` of the union to be shared, counted on the
full sets. The largest miss of banding is that of a pair just at the limit: (1 - 0.75^4)^32, six
in a million with the defaults.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ready, spread_join, written
from .components import components
from .words import mixed, shingle_sets

_SEED = 971
SALTS = 32


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signature_rows(docs: DataFrame, doc_id: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """``id, n, hi, lo, bands, sig``: set size, a 128-bit hash of the set, bucket keys, and 16 bits of each minimum."""
    n_hashes = bands * rows

    def run(batches):
        a, b = _hashes(n_hashes)
        band = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            sets, n = shingle_sets(batch.column(1), k)
            full = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[full]
            low = np.empty((n_hashes, len(full)), np.uint64)
            if len(full):
                for i in range(n_hashes):
                    low[i] = np.minimum.reduceat(sets * a[i] + b[i], starts)
            low = mixed(low)
            keys = np.zeros((len(full), bands), np.uint64)
            for r in range(rows):
                keys = mixed(keys + low[r::rows].T + band * np.uint64(r + 1))
            hi, lo = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(full):
                hi[full], lo[full] = np.add.reduceat(mixed(sets + band[0]), starts), np.add.reduceat(mixed(sets ^ band[0]), starts)
            offsets = np.zeros(len(n) + 1, np.int32)
            offsets[1:] = np.cumsum(np.where(n > 0, bands, 0))
            sig = (low.T & np.uint64(0xFFFF)).astype("<u2")
            raw: list = [None] * len(n)
            for i, j in enumerate(full.tolist()):
                raw[j] = sig[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64))), pa.array(raw, pa.binary())],
                ["id", "n", "hi", "lo", "bands", "sig"],
            )

    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n long, hi long, lo long, bands array<long>, sig binary")


def _alike(pairs: DataFrame, sigs: DataFrame, least: float, n: int) -> DataFrame:
    """Pairs whose signatures agree in ``least`` of their places or more; the least member of a large
    bucket is in many of the ``n`` pairs."""
    one = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    two = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    both = spread_join(pairs.join(two, "b"), one, "a", "b", n).select("a", "b", "sa", "sb")

    def run(batches):
        for x in batches:
            if x.num_rows:
                s, t = (np.frombuffer(b"".join(x.column(c).to_pylist()), "<u2").reshape(x.num_rows, -1) for c in (2, 3))
                yield x.select([0, 1]).filter(pa.array((s == t).mean(axis=1) >= least))

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, n: int) -> DataFrame:
    """The pairs that share ``percent`` of their union, counted on the sets of the whole texts."""
    one, two = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = spread_join(pairs.join(two, "b"), one, "a", "b", n).select("a", "b", "ta", "tb")

    def run(batches):
        for x in batches:
            ids = {}
            for c in (0, 1):
                for i, d in enumerate(x.column(c).to_pylist()):
                    ids.setdefault(d, (c + 2, i))
            where = [[i for c, i in ids.values() if c == s] for s in (2, 3)]
            column = pa.concat_arrays([x.column(2).take(pa.array(where[0], pa.int32())), x.column(3).take(pa.array(where[1], pa.int32()))])
            names = [d for s in (2, 3) for d, (c, _) in ids.items() if c == s]
            flat, n = shingle_sets(column, k)
            sets = dict(zip(names, np.split(flat, np.cumsum(n)[:-1]), strict=True))
            keep = []
            for p, q in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                s, t = sets[p], sets[q]
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(s) + len(t) - shared))
            yield x.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _links_between(few: pa.Table, many: pa.Table, k: int, percent: int, least: float) -> pa.Table:
    """True links between two blocks of members in different components, one for each member of
    ``few`` and component of ``many``. Pairs whose signatures agree enough are counted exactly:
    shared shingles are a product of membership matrices, a slice of the shingles at a time."""
    none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    if not few.num_rows or not many.num_rows:
        return none
    sig = [np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(t.num_rows, -1) for t in (few, many)]
    ids, label, size = ([t[c].to_numpy() for t in (few, many)] for c in ("id", "label", "n"))
    near = np.stack([(sig[1] == s).mean(axis=1) for s in sig[0]]) >= least
    near &= label[0][:, None] != label[1][None, :]
    near &= 100 * np.minimum(size[0][:, None], size[1][None, :]) >= percent * np.maximum(size[0][:, None], size[1][None, :])
    rows = [np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))]
    if not len(rows[0]):
        return none
    flat, owner = [], []
    for t, at in zip((few, many), rows, strict=True):
        sets, n = shingle_sets(t["text"].combine_chunks().take(pa.array(at)), k)
        flat.append(sets)
        owner.append(np.repeat(np.arange(len(at)), n))
    both = np.intersect1d(flat[0], flat[1])
    shared = np.zeros((len(rows[0]), len(rows[1])), np.float32)
    for i in range(0, len(both), 8192):
        part = both[i : i + 8192]
        member = []
        for sets, own, at in zip(flat, owner, rows, strict=True):
            place = np.minimum(np.searchsorted(part, sets), len(part) - 1)
            hit = part[place] == sets
            m = np.zeros((len(at), len(part)), np.float32)
            m[own[hit], place[hit]] = 1
            member.append(m)
        shared += member[0] @ member[1].T
    shared = shared.astype(np.int64)
    total = size[0][rows[0]][:, None] + size[1][rows[1]][None, :] - shared
    i, j = np.nonzero(near[np.ix_(*rows)] & (shared > 0) & (100 * shared >= percent * total))
    i, j = rows[0][i], rows[1][j]
    _, first = np.unique(np.stack([i, label[1][j]]), axis=1, return_index=True)
    return pa.table({"u": pa.array(ids[0][i[first]]), "v": pa.array(ids[1][j[first]])})


def _unresolved(large: DataFrame, labels: DataFrame, texts: DataFrame, sigs: DataFrame, k: int, percent: int, least: float) -> DataFrame | None:
    """Links among members of large buckets that are not in one component yet; None if there are no
    such members.

    Large buckets that share members form a group. In each group the members outside its largest
    component are compared with all members, a block of both at a time; each pair of members is
    compared once, however many buckets it shares.
    """
    star = large.select(F.col("head.id").alias("u"), F.col("id").alias("v"))
    groups = components(star).withColumnRenamed("component", "grp")
    named = groups.join(labels, "node", "left").select(F.col("node").alias("id"), "grp", F.coalesce("component", "node").alias("label"))
    sizes = cut(named.groupBy("grp", "label").agg(F.count("*").alias("c")))
    major = sizes.groupBy("grp").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.sum("c").alias("c"), (F.sum("c") - F.max("c")).alias("minor")).where("minor > 0")
    if major.isEmpty():
        return None
    chosen = named.join(major, "grp").withColumns({"few": F.ceil(F.col("minor") / 64).cast("int"), "many": F.ceil(F.col("c") / 256).cast("int")})
    rows = written(chosen.join(sigs, "id").join(texts, "id"), "members")
    own = ["id", "label", "n", "sig", "text"]
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = rows.where("label <> major").select("grp", part("few").alias("f"), every("many").alias("m"), *own)
    many = rows.select("grp", part("many").alias("m"), every("few").alias("f"), *own)
    keys = ["grp", "f", "m"]
    return few.groupBy(*keys).cogroup(many.groupBy(*keys)).applyInArrow(lambda x, y: _links_between(x, y, k, percent, least), "u long, v long")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, few: int = 16, least: float = 0.58,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    ``least`` is the agreement of signatures under which a pair is not verified: with 128 minima
    more than four standard deviations under 0.75. Very long texts count with all their shingles. Null and empty texts and texts without words
    have no shingles and are linked with nothing; rows with a null id are kept, linked with
    nothing, and have a null component; repeated rows share a component (all are ``kept`` alike);
    an empty table gives an empty one; other columns play no part.
    """
    ready(docs.sparkSession)
    signed = written(signature_rows(docs, doc_id, text, k, bands, rows), "signatures")
    known = signed.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = known.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    classes = cut(classes)
    # a class may hold a third of all rows: its one row is sent to SALTS places
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    heads = known.select("id", "n", "hi", "lo", "bands", salt).join(salted, ["hi", "lo", "salt"], "left").where("rep IS NULL OR rep = id")
    dealt = heads.select("id", "n", F.explode("bands").alias("key"))
    shared = dealt.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("head")).where("c > 1")
    members = written(dealt.join(shared, "key"), "buckets")
    small = members.where(F.col("c") <= few).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("id", "n"))).alias("all"))
    small = small.select(F.posexplode("all").alias("i", "x"), "all").select("x", F.explode(F.slice("all", F.col("i") + 2, few)).alias("y"))
    star = members.where(F.col("c") > few).select(F.col("head").alias("x"), F.struct("id", "n").alias("y"))
    sized = small.union(star).where((F.col("x.id") != F.col("y.id")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
    pairs = sized.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    sigs = signed.select("id", "n", "sig").where("id IS NOT NULL AND sig IS NOT NULL").dropDuplicates(["id"])
    # whole texts are shuffled once, for the members of shared buckets only from here on
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    texts = written(texts.join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "candidates")
    pairs = cut(pairs)
    close = cut(_alike(pairs, sigs, least, pairs.count()))
    edges = cut(_verified(close, texts, k, percent, close.count()))
    found = components(edges.toDF("u", "v"))
    more = _unresolved(members.where(F.col("c") > few), found, texts, sigs, k, percent, least)
    if more is not None:
        found = components(edges.toDF("u", "v").union(more))
    label = found.withColumnRenamed("node", "rep")
    of_class = classes.join(label, "rep", "left").withColumn("whole", F.coalesce("component", "rep")).select("hi", "lo", "whole").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = signed.select("id", "n", "hi", "lo", salt).join(of_class, ["hi", "lo", "salt"], "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    linked = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("whole", "component", "id"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), linked.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each group; of rows that repeat a kept id all stay."""
    drop = near_duplicates(docs, doc_id=doc_id, **options).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(drop, F.col(doc_id).cast("long") == F.col("_gone"), "left_anti")
