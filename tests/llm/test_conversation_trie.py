"""Nodes against a plain trie of Python tuples, with pieces, shards and chunks of any size."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tagloom.llm import conversation_trie as ct
from tagloom.llm.double_array import DoubleArray, subtree_sums
from tagloom.llm.queries import ORACLES, QUERIES
from tests.llm.common import rows
from tests.oracle import compare, connect

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("part", T.LongType()),
    T.StructField("q", T.LongType())])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in data], TURNS)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def sequences(data, rebuild=True):
    own = {}
    for c, turn, role, text in data:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    if not rebuild:
        return own
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + ts[h:]
    return out


def plain(seqs):
    members = {}
    for c, ts in seqs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, cs in members.items():
        under = [p for p in members if p[:len(path)] == path]
        kids = {p for p in under if len(p) == len(path) + 1}
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(seqs[c]) == len(path)))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids),
                    sum(not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in under) for p in under),
                    sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return rows(df.select(*COLUMNS))


def conversations(seed, n, longest=9, kinds=3):
    rng = random.Random(seed)
    data = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            data.append((c, rng.choice([None, t, t, t]), rng.choice(["user", None]), rng.choice(["a", "é" * 3, "", None, str(rng.randrange(kinds))])))
    return data


SIZES = [(4096, 200_000, 1 << 16), (3, 200_000, 1 << 16), (4096, 12, 20), (2, 10, 1), (1, 5, 1)]


@pytest.mark.parametrize("piece,shard,chunk", SIZES)
def test_rebuilt_equals_plain(spark, piece, shard, chunk):
    data = conversations(piece, 60) + [(None, 1, "user", "a"), (7, 3, "user", "a"), (7, 3, "user", "a"), (-7, 1, "user", "z"), (-4, 0, "u", "q")]
    found = ct.prefix_trie(*ct.rebuilt(ct.numbered(frame(spark, data).repartition(5))), ct.Sizes(piece, shard, chunk))
    assert got(found) == plain(sequences(data))


@pytest.mark.parametrize("piece,shard", [(4096, 200_000), (4, 30), (7, 8)])
def test_one_conversation_and_one_first_turn_hold_a_third(spark, piece, shard):
    data = [(3, t, "user", str(t % 4)) for t in range(60)] + [(4, t, "user", str(t % 4)) for t in range(40)]
    data += [(10 + c, t, "user", x) for c in range(40) for t, x in enumerate(["same", "same too", str(c % 6)])]
    data += [(100 + c, t, "user", "copy") for c in range(30) for t in range(2)]
    found = ct.prefix_trie(*ct.plain(ct.numbered(frame(spark, data).repartition(6))), ct.Sizes(piece, shard))
    assert got(found) == plain(sequences(data, False))


def test_conversations_without_turns_left_and_no_conversations(spark):
    data = [(c, 0, "user", "only") for c in range(30) if c % 5]
    found = got(ct.prefix_trie(*ct.rebuilt(ct.numbered(frame(spark, data)))))
    assert found == plain(sequences(data)) and any(r[1] == 0 and r[7] != ct.EMPTY_SHA256 for r in found)
    alone = [(c, 0, "user", "only") for c in range(1, 30) if zlib.crc32(str(c).encode()) % 9 and c % 5][:1]
    found = got(ct.prefix_trie(*ct.rebuilt(ct.numbered(frame(spark, alone)))))
    assert found == plain(sequences(alone)) and found[0][4:7] == (0, 1, 0)
    assert got(ct.prefix_trie(*ct.rebuilt(ct.numbered(frame(spark, []))))) == []
    assert got(ct.prefix_trie(*ct.rebuilt(ct.numbered(frame(spark, [(None, 1, "a", "b")]))))) == []


def test_a_conversation_over_many_partitions_is_numbered(spark):
    data = [(5, t, "user", "same") for t in range(500)] + [(c, 0, "user", "x") for c in range(20) if c != 5]
    data += [(5, None, "user", "null first")]
    df = ct.numbered(frame(spark, data).repartition(7))
    found = sorted((r.conv_id, r.idx, r.key) for r in df.collect())
    assert [r[1] for r in found if r[0] == 5] == list(range(1, 502)) and len(found) == len(data)
    assert found[[r[0] for r in found].index(5)][2] == digest("user", "null first")


@pytest.mark.parametrize("seed", range(6))
def test_double_array(seed):
    rng = np.random.default_rng(seed)
    n_symbols = int(rng.integers(1, 60))
    seqs = [list(rng.integers(0, n_symbols, rng.integers(0, 8))) for _ in range(int(rng.integers(0, 300)))]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in seqs]))).astype(np.int64)
    trie = DoubleArray(np.array([x for s in seqs for x in s], np.int64), offsets, n_symbols)
    nodes = {tuple(s[:d]) for s in seqs for d in range(len(s) + 1)} | {()}
    assert len(trie.states()) == len(nodes)
    at = {}
    for path in nodes:
        state = np.zeros(1, np.int64)
        for x in path:
            state = trie.step(state, np.array([x]))
        assert state[0] >= 0 and trie.depth[state[0]] == len(path)
        at[path] = int(state[0])
        for x in range(n_symbols):
            assert (trie.step(state, np.array([x]))[0] >= 0) == ((*path, x) in nodes)
    assert len(set(at.values())) == len(nodes)
    assert all(trie.paths[offsets[i] + d] == at[tuple(s[:d + 1])] for i, s in enumerate(seqs) for d in range(len(s)))


def test_double_array_is_dense():
    """Children of one state stand together, so the arrays are hardly larger than the trie."""
    rng = np.random.default_rng(1)
    seqs = [[0, int(rng.integers(1, 5000)), *rng.integers(0, 20000, 6)] for _ in range(4000)]
    offsets = np.arange(len(seqs) + 1) * 8
    trie = DoubleArray(np.array(seqs).ravel(), offsets, 20000)
    assert trie._top < 2 * len(trie.states())


def test_subtree_sums():
    parent, depth = np.array([-1, 0, 0, 1, 1, 4]), np.array([0, 1, 1, 2, 2, 3])
    assert subtree_sums(parent, depth, np.array([1, 2, 3, 4, 5, 6]))[0].tolist() == [21, 17, 3, 4, 11, 6]


def test_query(spark):
    name, sf = "op13_conversation_trie", "/root/testdata/sf0.001"
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None
