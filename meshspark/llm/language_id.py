"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

The text's log likelihoods come from runs of three characters, learnt from rows that declare
their language, and from common words and letters of each language, which hold where few or no
rows declare one. Host priors are smoothed in levels (host, address suffix, all rows) from
expected counts, which grouped aggregation sums over the texts' own posteriors. The fused
posterior adds the declared markup language and the suffix as noisy observations. ``und`` stands
for any other language or none.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ready, text_or_empty

LANGUAGES = ("en", "fr", "de", "es", "und")

#: Common words of each language.
COMMON = {
    "en": "the of and to in is that it was for on are with as at be this have from by not or had an they which you were her all she there would their we him been has when who will more if out so",
    "fr": "le la les de des du et un une est que qui dans pour pas sur au aux avec ce il elle ne se plus par je vous nous mais ou son sa ses leur cette sont été",
    "de": "der die das den dem des und ist in zu von mit sich auf für nicht ein eine einer einem einen es auch als an er sie wie bei nach aus um am im noch war über zum zur",
    "es": "el la los las de del y en que un una es por con para no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay",
}
#: Letters that are frequent in one language and rare or absent in the others.
LETTERS = {"fr": "èêçàùâîôœ", "de": "äöüß", "es": "ñíóú¿¡"}
#: Country suffixes of addresses.
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es"}

HIT, OTHER_HIT, UNKNOWN = 0.3, 0.02, 1e-4  # shares of common words in a language and in other text; an average other word
LETTER = (0.02, 0.0005)
TRUST = 40.0  # hits after which further ones add little: words of a text are not independent
SALTS = 16

CLASSES = 64  # of characters: 0 any but letters, 1-26 a-z, 27-59 U+00DF-U+00FF, 60 other Latin letters, 61 other letters
END, EACH = 1 / 6, 1 / 36  # chances under ``und`` that a word ends, and of any one class of letters
SMOOTH = (20000.0, 64.0, 64.0)  # pseudo-counts: of ``und`` in one character's chances, of these in two characters', of those in three's
NOISE = 0.2  # share of runs of any text that follow no language: names, code, markup
FEW = 500  # rows learnt from at which the characters of a language tell half as much as those of many rows
INDEPENDENT = 0.3  # share of the evidence of characters that is not told by their neighbours
STEP = 1 << 18  # characters of a text at a time

_WORD = re.compile(r"[^\W\d_]+")


def _table() -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Log likelihood ratios of each common word, and of any other word, against an unknown one."""
    lists = {k: v.split() for k, v in COMMON.items()}
    every = sorted({w for v in lists.values() for w in v})
    table = {}
    for w in every:
        row = [np.log(HIT / len(lists[k]) / ((1 - HIT) * UNKNOWN)) if k in lists and w in lists[k] else 0.0 for k in LANGUAGES[:-1]]
        table[w] = np.array([*row, np.log(OTHER_HIT / len(every) / ((1 - HIT) * UNKNOWN))])
    return table, np.array([0.0] * (len(LANGUAGES) - 1) + [np.log((1 - OTHER_HIT) / (1 - HIT))])


@cache
def _classes() -> np.ndarray:
    """The class of each character of the basic plane; those beyond it count as no letters."""
    out = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else c - 0xDF + 27 if 0xDF <= c <= 0xFF else 60 if c < 0x250 else 61
    return out


def grams(low: str):
    """Indices ``(a * 64 + b) * 64 + c`` of all runs of three classes of a lower-cased text between two ends, in blocks."""
    last = np.zeros(2, np.int64)
    for at in range(0, len(low) + 1, STEP):
        own = np.frombuffer(low[at : at + STEP].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.where(own < 0x10000, _classes()[own & 0xFFFF], 0).astype(np.int64)
        own = np.concatenate([last, own, np.zeros(int(at + STEP > len(low)), np.int64)])
        yield (own[:-2] * CLASSES + own[1:-1]) * CLASSES + own[2:]
        last = own[-2:]


def gram_weights(low: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of a text and their weights: in sixteenths, the binary logarithm of one more than their number,
    so a text that repeats itself teaches little."""
    blocks = [np.unique(b, return_counts=True) for b in grams(low)]
    own, at = np.unique(np.concatenate([b for b, _ in blocks]), return_inverse=True)
    n = np.bincount(at, np.concatenate([k for _, k in blocks]))
    return own, np.rint(16 * np.log2(1 + n)).astype(np.int64)


def character_gains(counts: np.ndarray) -> np.ndarray:
    """Log chances of each run's last character after the two before, against ``und``, from the weights of runs (languages, 64 ** 3)."""
    n = counts.reshape(-1, CLASSES, CLASSES, CLASSES).astype(float)
    n[:, :, 0, 0] = 0  # between words
    base = np.full(CLASSES, EACH)
    base[0] = END
    one, two = n.sum((1, 2)), n.sum(1)
    p1 = (one + SMOOTH[0] * base) / (one.sum(1, keepdims=True) + SMOOTH[0])
    p2 = (two + SMOOTH[1] * p1[:, None]) / (two.sum(2, keepdims=True) + SMOOTH[1])
    p3 = (n + SMOOTH[2] * p2[:, None]) / (n.sum(3, keepdims=True) + SMOOTH[2])
    gains = np.log((1 - NOISE) * p3 / base + NOISE)
    gains[:, :, 0, 0] = 0
    return np.ascontiguousarray(gains.reshape(len(n), -1).T.astype(np.float32))


def learn_characters(source: DataFrame, fit_rows: int) -> np.ndarray | None:
    """Gains of characters from rows ``declared, key, text_hash, text`` that declare one of the languages; None without such rows.

    Of each run the largest weight that one row gives is left out, so no row vouches for itself.

    About ``fit_rows`` of them are read, by a hash of id and text; the counts that reach the driver are at most 64 ** 3 a language."""
    labelled = source.where(F.col("declared").isin(*LANGUAGES[:-1]))
    labels = {r.declared: r["count"] for r in labelled.groupBy("declared").count().collect()}  # four numbers
    if not labels:
        return None
    part = min(1.0, fit_rows / sum(labels.values()))
    share = F.pmod(F.xxhash64("key", "text_hash"), F.lit(1 << 30)) < int(part * (1 << 30))

    def run(batches):
        counts, most = np.zeros((2, len(LANGUAGES) - 1, CLASSES**3), np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own, weights = gram_weights(text.lower())
                at = LANGUAGES.index(lang), own
                counts[at] += weights
                most[at] = np.maximum(most[at], weights)
        lang, gram = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(gram.astype(np.int32)), pa.array(counts[lang, gram]), pa.array(most[lang, gram])], ["lang", "gram", "n", "most"])

    found = labelled.where(share).select("declared", "text").mapInArrow(run, "lang int, gram int, n long, most long").groupBy("lang", "gram").agg((F.sum("n") - F.max("most")).alias("n")).where("n > 0").toArrow()
    counts = np.zeros((len(LANGUAGES) - 1, CLASSES**3))
    counts[found["lang"].to_numpy(), found["gram"].to_numpy()] = found["n"].to_numpy() / 16
    rows = np.array([labels.get(k, 0) * part for k in LANGUAGES[:-1]], np.float32)
    return character_gains(counts) * (rows / (rows + FEW))


def text_evidence(texts: list[str], gains: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log likelihoods (n, languages) and the number of words of each text.

    ``gains`` (runs of three characters, languages but ``und``) adds what characters tell."""
    table, other = _table()
    names = {w: i + 1 for i, w in enumerate(table)}
    weights = np.vstack([other, *table.values()])
    out, words = np.zeros((len(texts), len(LANGUAGES))), np.zeros(len(texts), np.int64)
    gain = np.log(LETTER[0] / LETTER[1])
    for i, t in enumerate(texts):
        low = t.lower()
        found = _WORD.findall(low)
        words[i] = n = len(found)
        at = np.fromiter((names.get(w, 0) for w in found), np.int64, n)
        counts = np.bincount(at, minlength=len(weights))
        total = counts @ weights
        marks = 0
        if not low.isascii():
            for k, letters in LETTERS.items():
                m = sum(map(low.count, letters))
                total[LANGUAGES.index(k)] += gain * m
                marks += m
        hits = n + marks
        if gains is not None and n:
            total[:-1] += INDEPENDENT * sum(gains[block].sum(0, dtype=float) for block in grams(low))
        out[i] = total * (TRUST / (TRUST + hits))
    return out, words


def host_of(address: Column) -> Column:
    """The lower-cased host of an address, without user, port and a leading ``www.``; null if there is none."""
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def markup_language(html: Column) -> Column:
    """The language that the first ``html`` tag declares; null if none does."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """Markup without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"<[^>]*+>", " ")


def identify(
    rows: DataFrame, *, key: str = "doc_id", text: Column | str = "text", declared: Column | str | None = None, address: Column | str | None = None, host: Column | str | None = None,
    sure: float = 0.5, host_weight: float = 20.0, suffix_weight: float = 50.0, declared_right: float = 0.9, suffix_right: float = 0.6,
    fit_rows: int = 20_000,
) -> DataFrame:
    """``key, text_hash, lang, confidence, accepted, declared, n_words`` for every row.

    ``host`` names the host directly where there is no address. Evidence that is null says
    nothing. A row is accepted if its text has words, its best language is not ``und`` and its
    posterior reaches ``sure``; null and empty texts are ``und``. Rows of no host share one. Null
    keys and repeated rows are judged like any other; an empty table gives an empty one. Very long
    texts are read whole, by blocks. Characters are learnt from about ``fit_rows`` of the rows that
    declare a language (a bounded sample, by a hash); all other counts cover all rows. Of languages
    that tie, the first in ``LANGUAGES`` is given.
    """
    ready(rows.sparkSession)
    column = lambda c: F.col(c) if isinstance(c, str) else F.lit(None).cast("string") if c is None else c
    own = text_or_empty(column(text))
    site = F.coalesce(host_of(column(address)), column(host))
    source = rows.select(
        F.col(key).cast("long").alias("key"), F.substring(F.lower(column(declared)), 1, 2).alias("declared"), F.coalesce(site, F.lit("")).alias("host"),
        F.when(site.contains("."), F.substring_index(site, ".", -1)).otherwise(F.lit("")).alias("suffix"), F.xxhash64(own).alias("text_hash"), own.alias("text"),
    )

    gains = rows.sparkSession.sparkContext.broadcast(learn_characters(source, fit_rows))  # 4 MB

    def run(batches):
        for b in batches:
            ll, n = text_evidence(b.column(5).to_pylist(), gains.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(n), *(pa.array(ll[:, j]) for j in range(len(LANGUAGES)))], [*b.schema.names[:5], "n", *(f"ll_{k}" for k in LANGUAGES)])

    seen = source.mapInArrow(run, "key long, declared string, host string, suffix string, text_hash long, n long, " + ", ".join(f"ll_{k} double" for k in LANGUAGES))
    seen = cut(seen)
    top = F.greatest(*[F.col(f"ll_{k}") for k in LANGUAGES])
    raised = {k: F.exp(F.col(f"ll_{k}") - top) for k in LANGUAGES}
    whole = sum(raised.values(), F.lit(0.0))
    # only texts with words tell anything about their host
    expected = [F.sum(F.when(F.col("n") > 0, raised[k] / whole).otherwise(0.0)).alias(k) for k in LANGUAGES]
    hosts = seen.groupBy("suffix", "host").agg(*expected)
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(k).alias(f"s_{k}") for k in LANGUAGES])
    every = suffixes.agg(*[F.coalesce(F.sum(f"s_{k}"), F.lit(0.0)) for k in LANGUAGES]).first()  # five numbers
    count = lambda p: sum((F.col(f"{p}{k}") for k in LANGUAGES), F.lit(0.0))
    prior = {}
    for k, n in zip(LANGUAGES, every, strict=True):
        general = F.lit((n + 1.0) / (sum(every) + len(LANGUAGES)))
        middle = (F.col(f"s_{k}") + suffix_weight * general) / (count("s_") + suffix_weight)
        prior[k] = (F.col(k) + host_weight * middle) / (count("") + host_weight)
    smooth = hosts.join(suffixes, "suffix").select("suffix", "host", *[F.log(prior[k]).alias(f"p_{k}") for k in LANGUAGES])
    salted = smooth.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = seen.withColumn("salt", F.pmod(F.xxhash64("key", "text_hash"), F.lit(SALTS)).cast("int")).join(salted, ["suffix", "host", "salt"])
    known = F.col("declared").isin(*LANGUAGES[:-1])
    wrong = 1 - declared_right

    def observed(k: str) -> Column:
        if k == "und":
            said = F.when(known, F.lit(np.log(0.5 / 4))).otherwise(F.lit(np.log(0.5)))
        else:
            said = F.when(F.col("declared") == k, F.lit(np.log(declared_right))).when(known, F.lit(np.log(wrong / 4))).otherwise(F.lit(np.log(wrong / 4)))
        ends = [s for s, of in SUFFIXES.items() if of == k]
        place = F.when(F.col("suffix").isin(*SUFFIXES), F.when(F.col("suffix").isin(*ends), F.lit(np.log(suffix_right))).otherwise(F.lit(np.log((1 - suffix_right) / 4)))).otherwise(F.lit(0.0)) if ends else F.when(F.col("suffix").isin(*SUFFIXES), F.lit(np.log(0.2))).otherwise(F.lit(0.0))
        return F.when(F.col("declared").isNull(), F.lit(0.0)).otherwise(said) + place

    scored = both.withColumns({f"q_{k}": F.col(f"ll_{k}") + F.col(f"p_{k}") + observed(k) for k in LANGUAGES})
    most = F.greatest(*[F.col(f"q_{k}") for k in LANGUAGES])
    name = F.coalesce(*[F.when(F.col(f"q_{k}") == most, F.lit(k)) for k in LANGUAGES])
    share = F.lit(1.0) / sum((F.exp(F.col(f"q_{k}") - most) for k in LANGUAGES), F.lit(0.0))
    lang = F.when(F.col("n") > 0, name).otherwise(F.lit("und"))
    named = scored.select("key", "text_hash", lang.alias("lang"), share.alias("confidence"), "declared", F.col("n").alias("n_words"))
    return named.withColumn("accepted", (F.col("lang") != "und") & (F.col("confidence") >= sure))


def identify_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents: the column ``lang`` is what they declare, ``source`` is their host."""
    return identify(docs, declared="lang", host="source", **options)


def identify_pages(pages: DataFrame, **options) -> DataFrame:
    """Web pages: the markup declares the language, the address has suffix and host."""
    return identify(pages, key="page_id", text=visible_text(F.col("html")), declared=markup_language(F.col("html")), address="url", **options)


def accepted_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without those that are rejected, in their columns."""
    gone = identify_documents(docs, **options).where("NOT accepted").select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_key")) & (F.xxhash64(text_or_empty(F.col("text"))) == F.col("_hash"))
    return docs.join(gone, same, "left_anti")
