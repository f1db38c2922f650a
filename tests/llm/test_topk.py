import random

import numpy as np
import pytest

from tagloom.llm.topk import search_block, slice_block, top_k

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def brute(vectors, queries, k=5):
    def usable(rows):
        out = []
        for i, v in rows:
            if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
                continue
            out.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
        return out

    answers = []
    for q, v in usable(queries):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable(vectors) if i != q and len(w) == len(v))
        answers += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(answers)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def vectors(n, dim, seed=3):
    rng = random.Random(seed)
    out = [(i, [rng.choice([rng.gauss(0, 0.2), 0.125, -3.0]) for _ in range(dim)]) for i in range(n)]
    out += [(100 + i, out[100][1]) for i in range(5, 40)]  # ties
    return out


def test_against_brute_force(spark):
    rows = vectors(400, 6)
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] + [0.0] * 5), (1150, [float("inf")] + [0.0] * 5),
             (None, [1.0] * 6), (1200, [0.5, 0.25]), (1201, [0.75, -0.25]), (1250, []), (1251, []), (1300, [-9.0] * 6),
             (1350, [0.0] * 6)]
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    for options in ({}, {"block_rows": 30, "query_block": 2}):
        assert sorted(map(tuple, top_k(frame(spark, rows), **options).collect())) == brute(rows, asked)


def test_own_queries_and_few_rows(spark):
    rows, asked = vectors(140, 4)[:3], [(7, [1.0, -1.0, 0.5, 0.0])]
    out = top_k(frame(spark, rows), frame(spark, asked), k=10)
    assert sorted(map(tuple, out.collect())) == brute(rows, asked, 10)


def test_empty_table(spark):
    assert top_k(frame(spark, [])).collect() == []


def test_block_of_equal_rows():
    v = np.full((70, 3), -5)
    low, bits, slices = slice_block(v)
    who, found, score = search_block(np.array([[-2, 3, 0]]), np.array([4]), np.arange(70), low, bits, slices, 3)
    assert found.tolist() == [0, 1, 2] and score.tolist() == [-5] * 3


def test_large_components(spark):
    """Sums of products go beyond a long while rows are compared, the scores that are returned do not."""
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([
        (200000.0, -3.0, 1e6), (1e12, 0.5, -2.0), (-1e13, 1.0, 0.0), (0.25, 0.25, 0.25), (-131072.0, 7.0, 1e6), (4e6, -4e6, 3.0)])]
    rows += [(50, [0.5, 1.0, -0.25]), (100, [-1.5, 1e4, 2.0])]
    asked = [r for r in rows if r[0] in (50, 100)]
    out = top_k(frame(spark, rows), frame(spark, asked), k=3)
    assert sorted(map(tuple, out.collect())) == brute(rows, asked, 3)


def test_scores_beyond_a_long(spark):
    low, bits, slices = slice_block(np.array([[1 << 60, 0], [-(1 << 60), 5], [3, 4]]))
    q = np.array([[-8, 1]])
    who, found, score = search_block(np.array([[0, 1]]), np.array([9]), np.arange(3), low, bits, slices, 2)
    assert list(zip(found.tolist(), score.tolist())) == [(1, 5), (2, 4)]
    with pytest.raises(OverflowError, match="long"):
        search_block(q, np.array([9]), np.arange(3), low, bits, slices, 2)
