import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from meshspark import queries, queries_more  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a, b = (d[names].sort_values(names).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-6, atol=1e-8)


def test_every_source_vector_has_a_nearest_one(spark):
    import numpy as np

    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    s, t = e[e.label < 5], e[e.label >= 5].sort_values("vec_id")
    x = np.stack(t.embedding.to_numpy()).astype(float)
    want = {q: int(t.vec_id.iloc[((x - np.asarray(v, float)) ** 2).sum(axis=1).argmin()]) for q, v in zip(s.vec_id, s.embedding, strict=True)}
    got = queries.QUERIES["jn5_nearest_vectors_whole"](spark, SF).collect()
    assert len(got) == len(want) and {r.qid: r.rid for r in got} == want
