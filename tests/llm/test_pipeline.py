from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_documents import brute_targets, words
from tests_llm_brute import brute_fingerprint, brute_pipeline

import corpus_pipeline
from meshspark.llm import packing, spotsigs


@pytest.mark.parametrize("name", ["docs", "clashing"])
def test_stages(spark, request, texts, name):
    docs = request.getfixturevalue(name)
    want = brute_pipeline(texts)
    columns = docs.columns
    for (stage, function), keep in zip(corpus_pipeline.STAGES[:2], want, strict=True):
        docs = function(spark, docs, "")
        assert docs.columns == columns
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == keep, stage
    # the mix: each document 0, 1 or 2 times, each source within a document of its target
    by_id = {r[0]: r for r in texts}
    sizes, largest = defaultdict(int), defaultdict(int)
    for d in want[1]:
        n = len(words(by_id[d][1]))
        sizes[by_id[d][3]] += n
        largest[by_id[d][3]] = max(largest[by_id[d][3]], n)
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == columns
    times = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert set(times) <= set(want[1]) and max(times.values()) <= 2
    taken = defaultdict(int)
    for d, k in times.items():
        taken[by_id[d][3]] += k * len(words(by_id[d][1]))
    for source, target in brute_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6


def test_whole_run(spark, texts, tmp_path):
    """All stages over a written table: every piece of what the mix takes is packed once for each time, without
    overlaps or gaps; null ids and columns, repeats and a clashing name are there."""
    rows = [*texts, (None, "a sentence without an id that is long enough to keep", None, None, None), texts[3], texts[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("sequence_id", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    plain = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pieces(docs).collect())
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(at) <= -(-sum(r.length for r in got) // 2048) * 1.05 + 2


def test_empty_table(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_fingerprints_hold_the_chains_of_a_plain_loop(spark):
    """As many signatures as distinct chains, and equal ones for equal chains, whatever the text around them."""
    anchors = set(spotsigs.ANCHORS)
    rows = ["the quick brown fox and a lazy dog", "The quick, brown FOX!", "of the of night train", "and", "the", "x of y", "le chat noir et le chien blanc dort ici"]
    got = [r.f for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(spotsigs.signatures(F.col("t")).alias("f")).collect()]
    want = [brute_fingerprint(t, anchors) for t in rows]
    for found, chains in zip(got, want, strict=True):
        if chains:
            assert len(found) == len(chains)
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            if a and b:
                assert len(set(got[i]) & set(got[j])) == len(a & b), (i, j)
