import math

import numpy as np
import pytest

from meshspark.llm import neighbours


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    order = np.argsort(neighbours.hilbert_keys(cells, bits))
    assert sorted(neighbours.hilbert_keys(cells, bits).tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def brute(rows, k, every=20):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        s = (x * good[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_search(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8))
    rows = [(i, (centres[i % 12] + 0.2 * rng.standard_normal(8)).tolist()) for i in range(900)]
    rows += [(900 + i, rows[3][1]) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2020, [math.nan] + [1.0] * 7), (2040, [None] + [1.0] * 7), (2060, [math.inf] + [1.0] * 7), (2080, [1.0] * 5), (None, [1.0] * 8)]
    d = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, place string")
    got: dict[int, list] = {}
    for r in neighbours.search(d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20)
    assert set(got) == set(want)
    hit = 0
    for q, found in want.items():
        assert [x[0] for x in got[q]] == list(range(1, len(found) + 1))
        assert [x[1:] for x in got[q]] == sorted([x[1:] for x in got[q]], key=lambda x: (-x[1], x[0]))
        exact = dict(brute_all(rows, q))
        assert all(s == exact[i] for _, i, s in got[q])
        hit += len({x[1] for x in got[q]} & {x[0] for x in found})
    assert hit >= 0.9 * sum(map(len, want.values()))


def brute_all(rows, q):
    own = np.array(dict(rows)[q], float)
    return [(i, float((np.array(v, float)[None] * own).sum(axis=1)[0])) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    two = neighbours.search(spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 1.0])], schema)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in two] == [(0, 1, 7, 0.5)]
    assert neighbours.search(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.search(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
