"""SpotSigs document fingerprints with DataFrame functions only.

A signature is a chain of content words that follows a common word (an anchor). The set of
signature hashes of a text is its fingerprint; likeness is the Jaccard similarity of two sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es hat ich im ist mit nach nicht sich sie sind und von vor war wie wird zu zum zur "
    "al como con del el ella ellos era es esta este fue las lo los mas muy no para pero por se sin sobre su sus una y ya"
).split()

CHAIN = 3
_MARK = "\u0001"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column, *, chain: int = CHAIN, anchors: tuple[str, ...] | list[str] = ANCHORS) -> Column:
    """The sorted distinct 32-bit hashes of the text's signatures.

    Words are runs of letters and digits of the lower-cased text. Where anchors follow each other
    the chain after the run counts once; a chain at the end may be shorter. A text with words but
    no anchor that a content word follows has the chains from each of its words; a text without
    words has one signature, of the whole text; an empty or null text has none.
    """
    plain = F.lower(text_or_empty(text))
    words = F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    # an anchor becomes a mark on the word after it
    marked = F.replace(F.array_join(F.transform(words, lambda x: F.when(x.isin(*anchors), F.lit(_MARK)).otherwise(x)), " "), F.lit(f"{_MARK} "), F.lit(_MARK))

    def chains(w: Column) -> Column:
        content = F.transform(w, lambda x: F.ltrim(x, F.lit(_MARK)))
        at = F.filter(F.transform(w, lambda x, i: F.when(x.startswith(_MARK), i)), lambda i: i.isNotNull())
        return bound(content, lambda c: F.transform(F.filter(at, lambda i: F.get(c, i) != ""), lambda i: F.hash(F.slice(c, i + 1, chain))))

    def every(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - chain + 1, F.lit(1))), lambda i: F.hash(F.slice(w, i, chain)))

    found = F.array_distinct(bound(F.split(marked, " "), chains))
    none = F.when(plain == "", F.array().cast("array<int>")).when(F.size(words) > 0, F.array_distinct(every(words))).otherwise(F.array(F.hash(plain)))
    return F.sort_array(bound(found, lambda f: F.when(F.size(f) > 0, f).otherwise(none)))


def as_text(found: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a signature, in ascending order."""
    return F.array_join(F.transform(found, lambda h: F.substring(F.hex(h.cast("long") + F.lit(1 << 32)), -8, 8)), "")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two fingerprints. The ratio of their lengths bounds it from above:
    a pair whose bound is under ``at_least`` is 0 without a comparison. Two empty ones are alike (1)."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)).cast("double")
    value = both / (F.size(a) + F.size(b) - both)
    return F.when(high == 0, F.lit(1.0)).when(a == b, F.lit(1.0)).when((low == 0) | (low < at_least * high), F.lit(0.0)).otherwise(value)


def similar_pairs(prints: DataFrame, *, key: str = "doc_id", found: str = "found", at_least: float = 0.75) -> DataFrame:
    """Pairs ``a < b`` of different fingerprints with a likeness of ``at_least`` or more, and
    ``members`` (key, class): rows of equal fingerprints form one class, named by its least key.

    Classes are partitioned by set length (lengths in one or neighbouring partitions only can be
    alike enough) and meet on a signature among each set's first ``size - ceil(at_least * size) + 1``
    in order of rarity, which two alike sets must share.
    """
    members = prints.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(found).alias("found"))
    classes = members.groupBy("found").agg(F.min("key").alias("class")).where(F.size("found") > 0)
    tokens = classes.select("class", F.explode("found").alias("sig"))
    counts = tokens.groupBy("sig").agg(F.count("*").alias("n"))
    ordered = tokens.join(counts, "sig").groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "sig"))), lambda x: x["sig"]).alias("sigs"))
    size = F.size("sigs")
    part = F.floor(F.log(size.cast("double")) / F.log(F.lit(1.0 / at_least))).cast("int")
    prefix = F.slice("sigs", 1, (size - F.ceil(size * at_least) + 1).cast("int"))
    left = ordered.select("class", part.alias("part"), F.explode(prefix).alias("sig"), size.alias("n"))
    right = left.select(F.col("class").alias("b"), "sig", F.col("n").alias("nb"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    near = left.join(right, ["part", "sig"]).where((F.least("n", "nb") >= at_least * F.greatest("n", "nb")) & (F.col("class") != F.col("b")))
    near = near.select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b")).distinct()
    sets = classes.select("class", "found")
    both = near.join(sets.withColumnRenamed("class", "a").withColumnRenamed("found", "fa"), "a").join(sets.withColumnRenamed("class", "b").withColumnRenamed("found", "fb"), "b")
    return both.withColumn("likeness", likeness(F.col("fa"), F.col("fb"), at_least)).where(F.col("likeness") >= at_least).select("a", "b", "likeness")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter (rounded down, code points) replaced by the first as many of
    ``following``, or all it has."""
    part = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - part), F.substring(following, F.lit(1), part))


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ranges: int = 256, range_bytes: int = 1 << 26) -> DataFrame:
    """``id, text, found, next_text, next_found``: each document beside the next by ascending id
    (null ids last, ties by a hash of the text; the first follows the last).

    Ids are dealt to ``ranges`` between approximate quantiles, each cut into equal spans until one holds
    about ``range_bytes`` of text, so texts are shuffled once and no range grows with the table. The first
    document of each range also goes to the range before, where it ends the order.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(F.col(text)).alias("text"))
    found = rows.agg(F.percentile_approx("id", [i / ranges for i in range(ranges + 1)], 20 * ranges), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cuts = sorted(set(found[0] or []))
    fine = max(16, -(-found[1] // (ranges * range_bytes)))
    h = F.xxhash64("text")
    if cuts:
        edges = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
        k = F.least(F.greatest(F.size(F.filter(edges, lambda e: e <= F.col("id"))), F.lit(1)), F.lit(max(1, len(cuts) - 1)))
        lo, hi = F.get(edges, k - 1), F.coalesce(F.get(edges, k), F.get(edges, k - 1))
        step = F.least(F.greatest(F.floor((F.col("id") - lo) / ((hi - lo + 1) / float(fine))), F.lit(0)), F.lit(fine - 1))
        known = k * fine + step
    else:
        known = F.lit(0)
    spread = (F.shiftright(h, 54) + 512).cast("long")  # ids that are null: 1024 ranges of the hash
    place = F.when(F.col("id").isNull(), F.lit((len(cuts) + 2) * fine) + spread).otherwise(known).cast("long")
    rows = rows.withColumn("h", h).withColumn("bucket", place)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    heads = rows.groupBy("bucket").agg(first.alias("head"))
    # a row for each range that has documents
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.partitionBy())
    heads = heads.select(F.coalesce(F.lag("bucket").over(order), last).alias("before"), F.col("head.id").alias("head_id"), F.col("head.h").alias("head_h"))
    rows = rows.withColumn("found", signatures(F.col("text")))
    match = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    both = rows.join(F.broadcast(heads), match, "left")
    sent = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("ghost")), F.struct(F.col("before").alias("at"), F.lit(True).alias("ghost")))
    )
    dealt = both.select("id", "text", "h", "found", F.explode(sent).alias("to")).select("id", "text", "h", "found", "to.at", "to.ghost")
    # hash partitioning by the range; within it ids ascend and the next range's first stands last
    seq = Window.partitionBy("at").orderBy("ghost", F.col("id").asc_nulls_last(), "h")
    paired = dealt.withColumn("next", F.lead(F.struct("text", "found")).over(seq)).where(~F.col("ghost"))
    return paired.select("id", "text", "found", F.col("next.text").alias("next_text"), F.col("next.found").alias("next_found"))


def fingerprint_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likenesses.

    Null texts are empty; very long texts are fingerprinted whole. A single document is its own next.
    Repeated rows each give a row, and rows of one id stand in the order of a hash of their texts; null
    ids come last. An empty table gives none; other columns play no part.
    """
    rows = with_next(docs, doc_id=doc_id, text=text).withColumn("changed", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("changed_found", signatures(F.col("changed")))
    return rows.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"), as_text(F.col("found")).alias("fingerprint"),
        as_text(F.col("changed_found")).alias("edited_fingerprint"), likeness(F.col("found"), F.col("changed_found")).alias("near_edited"), likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )
