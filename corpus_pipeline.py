"""A corpus from documents: language ID, near-duplicates, mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what its
stage keeps, in the columns of documents (the last one: packed pieces).

Rows with null ids, null sources or null languages are judged by their other columns. Null and empty
texts and texts without words are rejected by the first stage; very long texts are read whole.
Repeated rows share a fate: copies of a text under several ids leave the least id, and rows that repeat one
id stay together. Ties go to the smaller id. An empty table passes through empty; columns of other
names are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshspark.llm import language_id, minhash, mixing, packing
from meshspark.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without words or of none of the languages go."""
    return language_id.accepted_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates."""
    return minhash.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a document taken twice has its pieces twice."""
    return packing.pack(docs)


STAGES = [("language ID", identify_language), ("near-duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: The stages after the first are beyond SQL (components, a linear program); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
