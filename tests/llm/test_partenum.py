import random

import numpy as np
import pytest

from tagloom.llm.components import components
from pyspark.sql import functions as F

from tagloom.llm.partenum import (
    DIGEST, SKETCHES, Bands, Sketches, candidates, close_links, jaccard_components, similar_to, sketch, sketch_words)

from .common import frame, prose, rows


def shingles(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, n, num, den):
    sets = [shingles(t, n) for _, t in docs]
    roots = list(range(len(docs)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is None or docs[j][0] is None or not sets[i] or not sets[j]:
                continue
            if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                roots[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(root(i), []).append(d)
    out = [(d, len(s), None if d is None else min(groups[root(i)])) for i, ((d, _), s) in enumerate(zip(docs, sets))]
    return sorted(out, key=repr)


def pick(df):
    return rows(df.select("doc_id", "n_shingles", "component_id"))


def changed(rng, text, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in text.split())


def documents():
    rng = random.Random(11)
    base = [prose(i, rng.choice([3, 6, 12, 40, 150])) for i in range(30)]
    docs = list(enumerate(base))
    for i in range(170):
        docs.append((100 + i, changed(rng, rng.choice(base), rng.choice([0, 0.005, 0.01, 0.02, 0.05]))))
    chain = prose(500, 80)
    for i in range(30):  # each link holds, the ends are far apart
        w = chain.split()
        w[rng.randrange(len(w))] = f"c{i}"
        chain = " ".join(w)
        docs.append((400 - i, chain))
    docs += [(None, base[0]), (None, None), (700, None), (701, ""), (702, " \n\t"), (703, "One"), (704, "one"), (705, "two words"),
             (5, base[6]), (5, base[5]), (706, prose(9000, 8000)), (707, prose(9000, 8000) + " end")]
    return docs


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100)])
def test_against_brute_force(spark, n, num, den):
    docs = documents()
    assert pick(jaccard_components(frame(spark, docs), n, num, den)) == brute(docs, n, num, den)


def test_large_clusters_in_blocks(spark):
    docs = documents()
    found = jaccard_components(frame(spark, docs), 4, 85, 100, task_shingles=400, bucket_bytes=2000)
    assert pick(found) == brute(docs, 4, 85, 100)


@pytest.mark.parametrize("task_shingles", [300, 3000])
def test_large_clusters_of_several_components(spark, task_shingles):
    """One origin with very many near copies, others whose copies are near to each other but not to it, chains between them."""
    rng = random.Random(5)
    origin = prose(77, 60)
    docs = [(i, changed(rng, origin, 0.01)) for i in range(60)]
    far = changed(rng, origin, 0.04)
    docs += [(100 + i, changed(rng, far, 0.008)) for i in range(40)]
    step = origin
    for i in range(25):
        w = step.split()
        w[rng.randrange(len(w))] = f"s{i}"
        step = " ".join(w[:60 + i])
        docs.append((300 + i, step + f" end{i}" * (i % 3)))
    docs += [(400 + i, origin) for i in range(20)]
    found = jaccard_components(frame(spark, docs).repartition(5), 4, 85, 100, task_shingles=task_shingles, bucket_bytes=4000)
    assert pick(found) == brute(docs, 4, 85, 100)


def test_similar_to():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(200)]
    for pivot in sets[:20]:
        got = similar_to(pivot, np.concatenate(sets), np.array([len(x) for x in sets]), 3, 5)
        assert got.tolist() == [5 * len(np.intersect1d(pivot, x)) >= 3 * len(np.union1d(pivot, x)) for x in sets]


def test_unlike_sets_of_one_group_are_not_linked():
    """Sets that share a signature but nothing else are told apart, though a group holds sketches of two lengths."""
    rng, bands = np.random.default_rng(1), Bands(80, 100)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(200, 400)).astype(np.uint64)) for _ in range(400)]
    sets += [np.append(x[5:], x[:3]) for x in sets[:40]]
    sizes = np.array([len(x) for x in sets])
    words = sketch_words(sizes, bands)
    drawn = Sketches(sizes, words, np.concatenate([sketch(x, int(w)) for x, w in zip(sets, words)]), bands)
    assert len(set(words.tolist())) == 2
    links = close_links(np.zeros(len(sets), np.uint64), np.arange(len(sets)), drawn)
    assert {(i, 400 + i) for i in range(40)} <= {tuple(sorted(x)) for x in links.tolist()} and len(links) <= 42


def test_copies_are_dealt_over_all_groups(spark):
    """Copies of one text, and texts without words, do not meet in one group; a task sends one sketch of them."""
    text, bands = prose(1, 30), Bands(85, 100)
    docs = spark.createDataFrame([(i, (text if i % 2 else "").encode()) for i in range(3000)], "doc_id long, text binary").withColumn("key", F.xxhash64("text")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = candidates(docs, 4, bands, 16).select("*", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    digests = [r.p for r in found if r.kind == DIGEST]
    assert len(digests) == 3000 and sum(r.kind == SKETCHES for r in found) == 1
    assert max(digests.count(p) for p in set(digests)) < 1500


def test_empty_table(spark):
    assert pick(jaccard_components(frame(spark, []))) == []


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for num, den in ((85, 100), (80, 100), (1, 2)):
        bands = Bands(num, den)
        for _ in range(150):
            common = rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64) * np.uint64(2)
            most = len(common) * (den - num) // num
            left = int(rng.integers(0, most + 1))
            more = np.unique(rng.integers(0, 1 << 63, most, dtype=np.uint64)) * np.uint64(2) + np.uint64(1)
            a, b = np.unique(np.concatenate((common, more[:left]))), np.unique(np.concatenate((common, more[left:])))
            if len(np.setxor1d(a, b)):
                assert len(np.intersect1d(bands.signatures(a), bands.signatures(b)))


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (7, 6), (7, 6)]
    links += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    up = {}
    for a, b in links:
        up.setdefault(a, a), up.setdefault(b, b)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    touched = {x for a, b in links if a != b for x in (a, b)}
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert rows(found) == sorted(((x, root(x)) for x in touched), key=repr)
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []
