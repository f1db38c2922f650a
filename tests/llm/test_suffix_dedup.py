import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm.merge import LoserTree, decode, front_code
from tagloom.llm.suffix_dedup import _merged, _part, kept_hash, remove_repeats, union

from .common import frame, prose, rows


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(d, mask) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out.append((len(d), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(spark, docs, **options):
    df = remove_repeats(frame(spark, docs), **options)
    return rows(df.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", kept_hash().alias("sha")))


def expected(docs, length):
    return sorted(((d[0], *x) for d, x in zip(docs, brute([d[1] for d in docs], length))), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = [prose(i, 60) for i in range(12)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(40):  # passages of many lengths at many places, with changes inside
        a, b = rng.choice(base), rng.choice(base)
        cut = rng.randrange(len(a))
        part = a[cut:cut + rng.randrange(10, 120)]
        docs.append((100 + i, b[:rng.randrange(50)] + part + b[rng.randrange(len(b)):]))
    docs += [(None, base[0]), (None, base[0]), (None, None), (3, base[3]), (3, base[3]), (900, ""), (901, "x" * 400),
             (902, "ab" * 150), (903, "é" * 90), (904, "short")]
    assert found(spark, docs, length=40, gram=12) == expected(docs, 40)
    assert found(spark, docs, length=40, gram=12, bucket_bytes=100, flush=50, run_rows=5) == expected(docs, 40)


def test_long_text_and_hot_passage(spark):
    rng = random.Random(1)
    passage = prose(99, 40)
    docs = [(i, prose(1000 + i, 8) + passage + prose(2000 + i, 8)) for i in range(300)]
    docs.append((999, " ".join(str(rng.random()) for _ in range(20_000)) + passage))
    assert found(spark, docs) == expected(docs, 200)


def test_whole_characters(spark):
    docs = [(0, "é" * 30 + "tail"), (1, "x" + "é" * 30)]
    out = {r[0]: r for r in remove_repeats(frame(spark, docs), length=21, gram=8, whole_characters=True)
           .select("doc.doc_id", "kept", "n_removed").collect()}
    assert all(bytes(r[1]).decode() is not None and r[2] % 2 == 0 for r in out.values())


def test_empty_table(spark):
    assert found(spark, []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=6, max_size=6), max_size=12), max_size=7))
def test_loser_tree_merges_and_knows_prefixes(runs):
    coded = []
    for run in runs:
        table = np.frombuffer(b"".join(sorted(run)), np.uint8).reshape(-1, 6) if run else np.zeros((0, 6), np.uint8)
        lcps, tails = front_code(table)
        coded.append(decode(lcps, tails.tobytes(), 6))
    merged = list(LoserTree(coded))
    assert [s for _, _, s in merged] == sorted(s for run in runs for s in run)
    for (_, _, a), (lcp, _, b) in zip(merged, merged[1:]):
        assert a[:lcp] == b[:lcp] and (lcp == 6 or a[lcp] != b[lcp])


def test_gram_must_fit(spark):
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, []), length=10, gram=11)


def test_copies_of_a_text_are_dealt_to_all_parts():
    spans = np.zeros((10_000, 5), np.uint64)
    spans[:, 0], spans[:, 1], spans[:, 2] = np.arange(10_000), 1, 77
    assert np.bincount(_part(spans, 16), minlength=16).max() < 1000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 1), st.integers(0, 60), st.integers(1, 20)), max_size=40))
def test_merged_spans(found):
    """Every document has the union of its spans, however often they come, and no span more."""
    got = _merged(np.array([(a, b, c, s, s + n) for a, b, c, s, n in found], np.uint64).reshape(-1, 5))
    want = []
    for doc in {f[:3] for f in found}:
        mine = sorted((s, s + n) for *d, s, n in found if tuple(d) == doc)
        starts, ends = union(np.array([s for s, _ in mine]), np.array([e for _, e in mine]))
        want += [(*doc, *x) for x in zip(starts.tolist(), ends.tolist())]
    assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_many_copies_with_and_without_ids(spark):
    docs = [(i, prose(7, 60)) for i in range(120)] + [(None, prose(7, 60))] * 60 + [(500 + i, prose(100 + i, 40)) for i in range(20)]
    assert found(spark, docs, length=40, gram=12, bucket_bytes=2000) == expected(docs, 40)
