import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm.mixing import mix, one_period, phases, whole_weights
from tagloom.llm.queries import QUERIES

from .common import frame


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 60), min_size=1))
def test_less_than_one_block_off(weights):
    total, got = sum(weights.values()), Counter()
    for slot, s in enumerate(one_period(weights)):
        got[s] += 1
        assert all(abs(got[x] - Fraction(w * (slot + 1), total)) < 1 for x, w in weights.items())
    assert got == Counter(weights)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 90), min_size=1), st.integers(6, 40))
def test_phases_place_every_block_once(blocks, period):
    plan = phases(blocks, {s: 1 + i for i, s in enumerate(blocks)}, period)
    slots = []
    for s, n in blocks.items():
        mine = [p for p in plan if s in p.weights]
        for b in range(n):
            slots.append([p for p in mine if p.first[s] <= b][-1].slot(s, b))
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_whole_weights():
    assert whole_weights({"a": 0.5, "b": 0.25, "c": 0.25}, 10) in ({"a": 5, "b": 3, "c": 2}, {"a": 5, "b": 2, "c": 3})
    assert whole_weights({"a": 1e9, "b": 1}, 10) == {"a": 9, "b": 1}


@pytest.mark.parametrize("bucket_rows", [50_000, 20])
def test_mix(spark, bucket_rows):
    rng = random.Random(1)
    docs = [(i, f"t{i}", None, rng.choice(["big", "big", "big", "small", None])) for i in range(600)]
    docs += [(None, None, None, "big"), (None, None, None, "big"), (7, "t7", None, "small"), (7, "t7", None, "small")]
    weights = {"big": 1.0, "small": 2.0}
    rows = mix(frame(spark, docs), weights, block_rows=10, bucket_rows=bucket_rows).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter((d[0], d[1], d[3]) for d in docs)
    assert rows[0].__fields__[-4:] == ["mix_source", "mix_block", "mix_slot", "mix_place"]
    blocks, slots = defaultdict(list), defaultdict(set)
    for r in rows:
        blocks[r.mix_source, r.mix_block].append(r.mix_place)
        slots[r.mix_slot].add((r.mix_source, r.mix_block))
    assert all(sorted(p) == list(range(len(p))) for p in blocks.values()) and all(len(x) == 1 for x in slots.values())
    assert sorted(slots) == list(range(len(blocks)))
    order = [next(iter(slots[i]))[0] for i in range(len(slots))]
    shares, got = {"big": Fraction(1, 4), "small": Fraction(1, 2), "": Fraction(3, 8)}, Counter()
    total = Fraction(9, 2)
    shares = {"big": 1 / total, "small": 2 / total, "": Fraction(3, 2) / total}
    first = min(max(i for i, s in enumerate(order) if s == x) for x in shares)
    for i, s in enumerate(order[:first]):
        got[s] += 1
        assert all(abs(got[x] - w * (i + 1)) < Fraction(11, 10) for x, w in shares.items())


def test_query_against_brute_force(spark):
    """Every slot goes to the waiting source that is due first, by the definition of the schedule."""
    rows = QUERIES["op4_pfair_mixing"](spark, "/root/testdata/sf0.1").collect()
    documents = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source").collect()}
    assert {r.doc_id: r.mix_source for r in rows} == documents and len(rows) == len(documents)
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.mix_source, r.mix_block, r.mix_slot].append(r.mix_place)
    order = [s for s, _, _ in sorted(blocks, key=lambda b: b[2])]
    assert [b[2] for b in sorted(blocks, key=lambda b: b[2])] == list(range(len(blocks)))
    sizes = Counter(documents.values())
    assert Counter(order) == {s: -(-n // 64) for s, n in sizes.items()}
    assert all(sorted(p) == list(range(len(p))) for p in blocks.values())
    left, weights = Counter(order), {s: Fraction(1, len(sizes)) for s in sizes}
    got: Counter = Counter()
    for i, s in enumerate(order):
        if min(left.values()) == 0:
            break
        left[s] -= 1
        got[s] += 1
        assert all(abs(got[x] - w * (i + 1)) < 1 for x, w in weights.items())


def test_empty_table_and_bad_weights(spark):
    assert mix(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        mix(frame(spark, [(1, "a", None, "s")]), {"s": 0.0})


@pytest.mark.parametrize("weights", [dict.fromkeys("abc", 1), {"a": 0.9999, "b": 0.0001}, {"a": 0.1, "b": 0.2, "c": 0.7},
                                     {f"s{i}": 1 for i in range(1500)}])
def test_exact_weights(weights):
    """Less than one block off the weights as given, however long a phase is."""
    n = max(3, 100_000 // len(weights))
    plan = phases(dict.fromkeys(weights, n), weights)
    exact = {s: Fraction(w) for s, w in weights.items()}
    total, p = sum(exact.values()), plan[0]
    for s, w in exact.items():
        for b in range(next((x.first[s] for x in plan[1:] if s in x.first), n)):
            slot = p.slot(s, b)
            # Before its slot a source has b blocks, after it b + 1.
            assert -1 < b - slot * w / total and (b + 1) - (slot + 1) * w / total < 1


def test_phases_end_where_a_source_runs_out():
    """A phase that is no whole period places every block once, too."""
    rng = random.Random(2)
    for _ in range(200):
        blocks = {s: rng.randrange(0, 60) for s in "abcdef"[:rng.randrange(1, 7)]}
        plan = phases(blocks, {s: rng.choice([1, 2, 0.1, 0.3, 1e-4]) for s in blocks})
        slots = [[p for p in plan if s in p.weights and p.first[s] <= b][-1].slot(s, b) for s, n in blocks.items() for b in range(n)]
        assert sorted(slots) == list(range(sum(blocks.values())))


@pytest.mark.parametrize("weights", [None, {"s0": 0.5, "s1": 0.3, "s2": 0.2}])
def test_mix_stays_with_unrounded_weights(spark, weights):
    """Blocks of one row: the schedule is longer than a thousand slots, and than a run of slots."""
    rows = mix(frame(spark, [(i, f"t{i}", None, f"s{i % 3}") for i in range(3 * 1500)]), weights, block_rows=1).collect()
    order = [r.mix_source for r in sorted(rows, key=lambda r: r.mix_slot)]
    assert [r.mix_slot for r in sorted(rows, key=lambda r: r.mix_slot)] == list(range(4500))
    shares = {s: Fraction(weights[s]) if weights else Fraction(1) for s in ("s0", "s1", "s2")}
    total, got = sum(shares.values()), Counter()
    for i, s in enumerate(order):
        if max(got.values(), default=0) == 1500:
            break
        got[s] += 1
        assert all(abs(got[x] - w * (i + 1) / total) < 1 for x, w in shares.items())
    assert i >= 2999


def test_more_sources_than_a_thousand(spark):
    rows = mix(frame(spark, [(i, f"t{i}", None, f"s{i % 1100}") for i in range(2200)]), block_rows=1).collect()
    order = [r.mix_source for r in sorted(rows, key=lambda r: r.mix_slot)]
    assert len(set(order[:1100])) == len(set(order[1100:])) == 1100
