"""Codes against a plain search over all entries, in exact integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from tagloom.llm import equal_average as ea
from tagloom.llm.queries import ORACLES, QUERIES
from tests.llm.common import rows
from tests.oracle import compare, connect

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
    T.StructField("v", T.StringType()), T.StructField("code", T.LongType()), T.StructField("known", T.LongType())])


def frame(spark, data):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in data], VECTORS)


def plain(data, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error, digest by brute force."""
    fine = [(i, v, label) for i, v, label in data if v and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not fine:
        return []
    size = len(fine[0][1])
    fine = [r for r in fine if len(r[1]) == size]
    d = size // parts
    ints = [[[math.floor(256 * Fraction(x)) for x in v[p * d:(p + 1) * d]] for p in range(parts)] for _, v, _ in fine]
    books = [[ints[e][p] for e in range(min(entries, len(ints)))] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], c)), e) for e, c in enumerate(books[p])) for p in range(parts)] for x in ints]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[p] for x, f in zip(ints, found) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    errors = [sum(f[0] for f in row) for row in found]
    sums = {}
    for (_, _, label), error in zip(fine, errors):
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted([(r[0], bytes(f[1] for f in row).hex(), error, sums[r[2]], digest)
                   for r, row, error in zip(fine, found, errors)], key=repr)


def vectors(seed, n, size=32, spread=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(0, spread) for _ in range(size)] for _ in range(n)]


def got(df):
    return rows(df.select("vec_id", "code", "error", "label_error", "codebooks_sha256"))


@pytest.mark.parametrize("spread", [0.004, 0.2, 40.0])
def test_equals_brute_force(spark, spread):
    data = [(i, v, None if i % 3 == 0 else i % 4) for i, v in enumerate(vectors(1, 200, spread=spread))]
    assert got(ea.compress(frame(spark, data).repartition(5))) == plain(data)


def test_ties_repeated_rows_nulls_and_clashing_names(spark):
    rng = random.Random(2)
    data = [(rng.choice([None, *range(150)]), [rng.choice([0.0, 0.004, -0.004]) for _ in range(16)], 1) for _ in range(300)]
    data += data[:40]
    bad = [(900, None, 1), (901, [], 1), (902, [None] * 16, 1), (903, [float("nan")] + [0.0] * 15, 1),
           (904, [float("inf")] + [0.0] * 15, None), (905, [0.5] * 32, 1)]
    assert got(ea.compress(frame(spark, data + bad).repartition(4))) == plain(data)


def test_few_and_no_vectors(spark):
    data = [(5, vectors(3, 1)[0], None), (3, vectors(4, 1)[0], None)]
    assert got(ea.compress(frame(spark, data))) == plain(data)
    assert got(ea.compress(frame(spark, data[:1]))) == plain(data[:1])
    assert got(ea.compress(frame(spark, []))) == []
    assert got(ea.compress(frame(spark, [(1, None, 2)]))) == []
    with pytest.raises(ValueError):
        ea.compress(frame(spark, [(1, [1.0] * 17, 2)]))


def test_components_of_any_size(spark):
    """Large components are counted exactly; an equal vector is its own entry with error 0."""
    data = [(i, [x * 1e6 for x in v], i % 2) for i, v in enumerate(vectors(5, 90, 16))]
    assert got(ea.compress(frame(spark, data).repartition(3))) == plain(data)
    huge = [(i, [3e38 * (-1) ** i] * 16, None) for i in range(2)]
    assert got(ea.compress(frame(spark, huge))) == plain(huge)
    huge = [(i, [1.7e308] * 16, None) for i in range(70)]
    assert got(ea.compress(frame(spark, huge))) == plain(huge)
    with pytest.raises(Exception):
        ea.compress(frame(spark, [(i, [1e30 * i] * 16, None) for i in range(200)]), entries=2).collect()


def test_search_stops_only_strictly_beyond():
    """At an equal bound an entry with a smaller number may tie: (1, 1) is as far from (0, 0) and from (2, 2)."""
    books = ea.Codebooks(np.array([[[2, 2], [0, 0], [9, 9]]]), True)
    search = ea.EqualAverage(books)
    code, dist = search.nearest(np.array([[[1, 1]], [[0, 0]], [[9, 9]]]))
    assert code.ravel().tolist() == [0, 1, 2] and dist.ravel().tolist() == [2, 0, 0]


def test_search_skips_entries():
    rng = np.random.default_rng(1)
    books = ea.Codebooks(rng.integers(-500, 500, (1, 64, 4)), True)
    x = rng.integers(-500, 500, (500, 1, 4))
    search = ea.EqualAverage(books)
    code, dist = search.nearest(x)
    full = ((x - books.values[0][None]) ** 2).sum(axis=2)
    assert (code.ravel() == full.argmin(axis=1)).all() and (dist.ravel() == full.min(axis=1)).all()
    assert search.compared < 0.8 * full.size


@pytest.mark.parametrize("value", [0, 1, -1, 1 << 24, -(1 << 24) - 1, 12345678901234567890123, -98765432109876543210])
def test_limbs(value):
    digits = ea.limbs(value, 6)
    assert sum(d * ea.LIMB**i for i, d in enumerate(digits)) == value and all(0 <= d < ea.LIMB for d in digits[:-1])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    name = "op12_equal_average_codes"
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None
