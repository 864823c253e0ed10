"""The queries ``opN_<name>`` over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, lexical, lm, minhash, mixing, neighbours, packing, sharding, spelling, spotsigs, token_counts, token_output, warc
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "lang", "confidence", "declared", "n_words", "accepted")


def op1_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages, where markup, address suffix and host in levels are evidence too."""
    found = language_id.identify_pages(table(spark, sf_dir, "pages"))
    return found.select(F.col("key").alias("page_id"), "lang", "confidence", "declared", "n_words", "accepted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_report(table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_language_id, op1_language_id_pages, op2_token_counts, op3_near_duplicates, op4_mixing, op5_token_output, op6_packing, op7_fingerprints, op8_lm_scores, op9_neighbours, op10_sharding, op11_spelling_variants, op12_ranked_search, op13_warc)}

ORACLE_SQL = {"op4_mixing": mixing.SQL, "op11_spelling_variants": spelling.SQL, "op12_ranked_search": lexical.SQL, "op13_warc": warc.SQL}
