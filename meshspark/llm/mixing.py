"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every document gets an exponential key ``-ln(u) / quality``; within its source documents are
taken in ascending key order until the source's token budget is reached, which is sampling
without replacement with probability proportional to quality. Whole epochs of a source come
first, the keys decide only about the remaining fraction of an epoch.

Prefix sums never sort a source in one task: keys fall into ``buckets`` ranges by a fixed
monotone rule, sums of the ranges give offsets, and only the rows of one (source, range) meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, words_in


def quality_weight(text: Column, size: Column) -> Column:
    """Documents whose mean word length is far from six characters weigh less (0 < w <= 1)."""
    mean = F.length(text).cast("double") / F.greatest(size, F.lit(1)).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.abs(mean - 6.0) / 6.0)


def uniform(seed: int, *parts: Column) -> Column:
    """A uniform number in (0, 1) from the MD5 of the parts; the same on every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    whole = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double")
    return (whole + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (src, src_null, source_size) with ``target``: shares of ``share`` times all words
    by weight, stopped at ``most`` times the source's size, the excess reshared by weight.

    With sources in ascending order of cap per weight, those that stop are a prefix; the first
    that does not stop fixes the level for all after it. One row a source meets here.
    """
    order = Window.orderBy("src_null", "src")
    ranked = sizes.withColumn("nth", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before, every = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (share * F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    stepped = ranked.withColumn("level", level).withColumn("place", F.row_number().over(filled))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    stepped = stepped.withColumn("first_free", F.min(free).over(every))
    stopped = F.col("first_free").isNull() | (F.col("place") < F.col("first_free.place"))
    return stepped.select("src", "src_null", "source_size", F.when(stopped, F.col("cap")).otherwise(F.col("first_free.level") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5, most: float = 2.0, buckets: int = 1024, seed: int = 7, carry: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``, and with ``carry`` the
    input row as struct ``row``.

    Null texts have size 0 and are never taken; null sources are one source, ordered last; rows
    repeated in full tie and are taken in any order among themselves (the outcome is the same);
    an empty table gives an empty table. Other input columns play no part, whatever their names.
    The document at the end of the budget is taken if that brings the source nearer its target.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if carry else docs.select(F.struct(F.col(doc_id), F.col(text), F.col(source)).alias("row"))
    inner = {c: F.col(f"row.`{c}`") for c in (doc_id, text, source)}
    size, raw = words_in(inner[text]), text_or_empty(inner[text])
    keyed = held.withColumn("size", size).withColumn(
        "key", -F.log(uniform(seed, F.coalesce(inner[doc_id].cast("string"), F.lit("")), raw)) / quality_weight(raw, F.col("size"))
    )
    keyed = keyed.select(
        *(["row"] if carry else []), inner[doc_id].alias("id"), "size", "key", inner[source].isNull().alias("src_null"), text_or_empty(inner[source].cast("string")).alias("src"),
        F.floor(buckets * (F.col("key") / (1 + F.col("key")))).cast("int").alias("bucket"),
    )
    sums = keyed.groupBy("src_null", "src", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(sums.groupBy("src_null", "src").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    before = Window.partitionBy("src_null", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(goal, ["src_null", "src"])
    placed = placed.select("src_null", "src", "bucket", "offset", "source_size", "target")
    within = Window.partitionBy("src_null", "src", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = keyed.join(placed, ["src_null", "src", "bucket"]).withColumn("upto", F.col("offset") + F.sum("size").over(within))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    more = (F.col("upto") - F.col("size") / 2.0) <= rest
    taken = (epochs * F.col("size") + F.when(more & (epochs < most), F.col("size")).otherwise(F.lit(0))).cast("long")
    return chosen.select(*(["row"] if carry else []), F.col("id").alias(doc_id), "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every input row as often as it is taken (0, 1 or 2 times), in its columns."""
    taken = mix(docs, carry=True, **options)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return taken.withColumn("n", times).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


#: DuckDB SQL for :func:`mix` over documents with the default parameters.
SQL = r"""
WITH base AS (
  SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(coalesce(text, ''))::DOUBLE AS chars,
         (CAST('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
keyed AS (
  SELECT *, -ln(u) / (1.0 / (1.0 + abs(chars / greatest(size, 1)::DOUBLE - 6.0) / 6.0)) AS key FROM base),
ranked AS (
  SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src IS NULL, src) - 1 AS nth FROM base GROUP BY src),
weighed AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0, 1.0], (nth % 3 + 1)::BIGINT) AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, nth) AS place,
    (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM weighed),
goal AS (
  SELECT src, source_size,
    CASE WHEN f.place IS NULL OR levels.place < f.place THEN cap ELSE f.level * weight END AS target
  FROM levels LEFT JOIN (SELECT place, level FROM levels WHERE level * weight <= cap ORDER BY place LIMIT 1) f ON true),
summed AS (
  SELECT k.*, g.source_size, g.target, sum(size) OVER (PARTITION BY k.src ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs
  FROM keyed k JOIN goal g ON k.src IS NOT DISTINCT FROM g.src)
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN upto - size / 2.0::DOUBLE <= target - epochs * source_size AND epochs < 2 THEN size ELSE 0 END)::BIGINT AS taken
FROM summed
"""
