"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its word shingles. Set sizes fall into bands such that similar sets lie in the same band or in
neighbouring ones; in a band, sets of Jaccard similarity t differ in at most k shingles. The shingle domain (64-bit
hashes) is cut into parts and every part into subparts. Two sets that differ in at most k places must agree on all but
``spare`` subparts of some part, so each set emits a signature for every choice of the other subparts: sets that agree
there share one. Pairs that share a signature are first held against their parity sketches: a set is folded into a bit
vector by exclusive or, so two sketches never differ in more bits than the sets in shingles, and a pair whose sketches
differ too much is out for certain. The pairs left over form clusters, within which sets are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, hot_join, mix64, saved, text_bytes
from .components import components
from .shingles import shingle_sets

DIGEST, SIGNATURES, GROUPS, SKETCHES = 0, 1, 2, 3
#: Sets of every band of a large cluster with which all of the band and its neighbours are compared first.
PIVOTS = 4
#: Up to so many candidate documents are sent to the texts; more are joined with them by a shuffle.
SENT_ROWS = 1 << 17
CHUNK_SCHEMA = "bucket int, kind int, x binary, y binary, z binary, w binary"
FOUND_SCHEMA = "kind int, a long, b long, n long, given boolean, key long, sketch binary"


class Bands:
    """Size bands and the number of differing shingles of similar sets, for similarity of at least num / den."""

    def __init__(self, num: int, den: int, subparts: int = 2, spare: int = 1, least: int = 3):
        self.num, self.den, self.subparts, self.spare, self.least = num, den, subparts, spare, least
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(self.low[-1] * den // num + 1)
        self.starts = np.array(self.low, np.int64)
        self.chosen = list(combinations(range(subparts), subparts - spare))
        self.cuts: dict[int, tuple[int, int, np.ndarray]] = {}

    def differing(self, instance: int) -> int:
        """Most differing shingles of two similar sets that are no larger than the band's largest."""
        return 2 * (self.low[instance + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def parts(self, instance: int) -> tuple[int, int, np.ndarray]:
        """Number of parts, how many of them similar sets can fail to agree in, and the borders of all subparts."""
        if instance not in self.cuts:
            failing = self.differing(instance) // (self.spare + 1)
            n = failing + 1 + -(-(failing + 1) * 3 // 20)
            m = n * self.subparts
            self.cuts[instance] = n, failing, np.arange(m, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // m)
        return self.cuts[instance]

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """All signatures of a set (sorted distinct hashes): for its own band and the next one."""
        band = int(np.searchsorted(self.starts, len(shingles), "right")) - 1
        mixed = np.concatenate(([np.uint64(0)], np.cumsum(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)))))
        out = [self._instance(shingles, mixed, i) for i in (band, band + 1)]
        return np.unique(np.concatenate(out))

    def _instance(self, shingles: np.ndarray, mixed: np.ndarray, instance: int) -> np.ndarray:
        if not self.differing(instance):  # only equal sets are similar, and these are one set already
            return np.zeros(0, np.uint64)
        n, failing, borders = self.parts(instance)
        at = np.append(np.searchsorted(shingles, borders), len(shingles))
        sums = (mixed[at[1:]] - mixed[at[:-1]]).reshape(n, self.subparts)
        counts = np.diff(at).reshape(n, self.subparts)
        values, sizes = [], []
        for j, chosen in enumerate(self.chosen):
            values.append(sums[:, chosen].sum(axis=1, dtype=np.uint64) ^ np.uint64((j + 1) << 56))
            sizes.append(counts[:, chosen].sum(axis=1))
        values, sizes = np.stack(values, 1), np.stack(sizes, 1)
        names = mix64(np.arange(n, dtype=np.uint64) + np.uint64((instance + 1) << 40))
        values = mix64(values ^ names[:, None])
        # Signatures of few shingles are shared by chance. A part that has one is left out, as long as similar sets
        # must still agree in another part; if that is not sure, all signatures stay.
        poor = (sizes < self.least).any(axis=1)
        return (values if poor.sum() >= n - failing else values[~poor]).ravel()


class Forest:
    """Union-find over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return higher
            self.up = higher


def set_hash(shingles: np.ndarray) -> int:
    """A 64-bit name of a set (as a signed number)."""
    total = np.array([mix64(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)
    return int(mix64(total).view(np.int64)[0])


def sketch_words(size: np.ndarray, bands: Bands) -> np.ndarray:
    """Length of the sketches (in 64-bit words, a power of 2): at least three bits per shingle that may differ, and 64 more.

    Sketches of sets that have nothing in common differ in half their bits, give or take the root; the 64 keep that
    away from what may differ also for small sets.
    """
    bits = 6 * size * (bands.den - bands.num) // (bands.den + bands.num) + 64
    return 1 << np.ceil(np.log2(np.maximum(1, bits / 64))).astype(np.int64)


def sketch(shingles: np.ndarray, words: int) -> np.ndarray:
    """Parity of the number of shingles that fall on each bit."""
    places = (mix64(shingles + np.uint64(0x3C6EF372FE94F82B)) & np.uint64(64 * words - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=64 * words) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


class Sketches:
    """Nodes with their sizes and sketches; sketches of different lengths are compared at the shorter one."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, flat: np.ndarray, bands: Bands):
        self.sizes, self.words, self.bands = sizes, words, bands
        begin = np.concatenate(([0], np.cumsum(words)))[:-1]
        self.rows, self.row_of = {}, {}
        longer, owners = np.zeros((0, 0), np.uint64), np.zeros(0, np.int64)
        for w in sorted(set(words.tolist()), reverse=True):
            while len(owners) and longer.shape[1] > w:
                half = longer.shape[1] // 2
                longer = longer[:, :half] ^ longer[:, half:]
            own = np.flatnonzero(words == w)
            mine = flat[begin[own][:, None] + np.arange(w)]
            longer = np.concatenate((longer, mine)) if len(owners) else mine
            owners = np.concatenate((owners, own))
            row_of = np.full(len(sizes), -1)
            row_of[owners] = np.arange(len(owners))
            self.rows[w], self.row_of[w] = longer, row_of

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs may be similar, by sizes and sketches."""
        num, den = self.bands.num, self.bands.den
        out = np.zeros(len(a), bool)
        shorter = np.minimum(self.words[a], self.words[b])
        for w in set(shorter.tolist()):
            at = np.flatnonzero(shorter == w)
            x, y = self.row_of[w][a[at]], self.row_of[w][b[at]]
            differ = np.concatenate([
                np.bitwise_count(self.rows[w][x[i:i + 65536]] ^ self.rows[w][y[i:i + 65536]]).sum(axis=1, dtype=np.int64)
                for i in range(0, len(at), 65536)])
            n, m = self.sizes[a[at]], self.sizes[b[at]]
            out[at] = ((differ * (den + num) <= (n + m) * (den - num))
                       & (np.minimum(n, m) * den >= np.maximum(n, m) * num))
        return out


    def close_rows(self, members: np.ndarray, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
        """For the members ``first`` to ``last - 1`` of a group those behind them that may be similar (places in the group)."""
        num, den = self.bands.num, self.bands.den
        w = int(self.words[members].min())
        rows, sizes = self.rows[w][self.row_of[w][members[first:]]], self.sizes[members[first:]]
        few = last - first
        for a in range(0, len(rows), 4096):
            differ = np.zeros((few, len(rows[a:a + 4096])), np.int64)
            for k in range(w):
                differ += np.bitwise_count(rows[:few, k, None] ^ rows[None, a:a + 4096, k])
            n, m = sizes[:few, None], sizes[None, a:a + 4096]
            close = ((differ * (den + num) <= (n + m) * (den - num))
                     & (np.minimum(n, m) * den >= np.maximum(n, m) * num))
            for i in np.flatnonzero(close.any(axis=1)).tolist():
                hit = np.flatnonzero(close[i]) + a
                hit = hit[hit > i]
                if len(hit):
                    yield first + i, first + hit


def close_links(sigs: np.ndarray, nodes: np.ndarray, sketches: Sketches) -> np.ndarray:
    """Links (rows of two node numbers) that connect all close pairs of nodes with a common signature."""
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    if len(sigs):
        fresh = np.concatenate(([True], (sigs[1:] != sigs[:-1]) | (nodes[1:] != nodes[:-1])))
        sigs, nodes = sigs[fresh], nodes[fresh]
    begin = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1]))) if len(sigs) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begin, len(sigs)))
    two = begin[counts == 2]
    pairs = np.unique(np.stack((nodes[two], nodes[two + 1]), 1), axis=0)
    out = [pairs[sketches.close(pairs[:, 0], pairs[:, 1])]]
    forest = Forest(len(sketches.sizes))
    for a, b in out[0].tolist():
        forest.join(a, b)
    for start, n in sorted(zip(begin[counts > 2].tolist(), counts[counts > 2].tolist()), key=lambda x: x[1]):
        members = nodes[start:start + n]
        roots = np.array([forest.root(i) for i in members.tolist()])
        for i in range(0, n, 64):
            # Nodes that are connected already need not be compared, so families of near copies are soon done with.
            if (roots == roots[0]).all():
                break
            for row, hit in sketches.close_rows(members, i, min(i + 64, n)):
                hit = hit[roots[hit] != roots[row]]
                # A group is compared at its shortest sketch; what passes there, at the longest that each pair has.
                hit = hit[sketches.close(np.full(len(hit), members[row]), members[hit])]
                if len(hit):
                    joined, one = np.unique(roots[hit], return_index=True)
                    out.append(np.stack((np.full(len(one), members[row]), members[hit[one]]), 1))
                    for other in joined.tolist():
                        forest.join(int(roots[row]), other)
                    roots[np.isin(roots, np.append(joined, roots[row]))] = forest.root(int(roots[row]))
    return np.unique(np.concatenate(out), axis=0)


def shared_groups(sigs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, node) of all nodes that share a signature with others; signatures of the same nodes are one group."""
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    if len(sigs):
        fresh = np.concatenate(([True], (sigs[1:] != sigs[:-1]) | (nodes[1:] != nodes[:-1])))
        sigs, nodes = sigs[fresh], nodes[fresh]
    begin = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1]))) if len(sigs) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begin, len(sigs)))
    begin, counts = begin[counts > 1], counts[counts > 1]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(nodes))))
    groups = mix64(sums[begin + counts] - sums[begin] + counts.astype(np.uint64)).view(np.int64)
    groups, one = np.unique(groups, return_index=True)
    begin, counts = begin[one], counts[one]
    places = np.repeat(begin - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    return np.repeat(groups, counts), nodes[places]


def candidates(docs: DataFrame, n: int, bands: Bands, buckets: int, flush: int = 1 << 18) -> DataFrame:
    """What is known of ``doc_id, key, text`` after one pass, in two kinds of rows.

    Digests: ``a`` doc_id, ``b`` node, ``n`` set size, ``key`` of the text. Sketches: ``b`` node, ``n``, its sketch, once per node. Groups: ``a``
    group, ``b`` node, for nodes that share a signature. Only numbers travel with a signature; most are of one node and
    end here. Documents are dealt by id, so copies of a text do not meet; a task sends the sketch of a node once.
    """
    def chunks(kind: int, key: np.ndarray, columns: list[np.ndarray], sketches: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key, kind="stable")
        cuts = np.searchsorted(key[order], np.arange(buckets + 1))
        rows = []
        for k in range(buckets):
            mine = order[cuts[k]:cuts[k + 1]]
            if len(mine):
                fields = [c[mine].tobytes() for c in columns]
                if sketches:
                    fields.append(b"".join(sketches[i] for i in mine))
                rows.append((k, *fields, *[None] * (4 - len(fields))))
        if rows:
            columns = [*zip(*rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array([kind] * len(rows), pa.int32()),
                 *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "kind", "x", "y", "z", "w"])

    def emit(sigs: list, nodes: list) -> Iterator[pa.RecordBatch]:
        if sigs:
            sig = np.concatenate(sigs)
            owner = np.repeat(np.array(nodes, np.int64), [len(x) for x in sigs])
            yield from chunks(SIGNATURES, (sig % np.uint64(buckets)).astype(np.int64), [sig, owner])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, seen, held = [], [], set(), 0
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            ids = batch.column("doc_id")
            digest, fresh, drawn = np.zeros((batch.num_rows, 2), np.int64), [], []
            for i, shingles in enumerate(shingle_sets(data, offsets, n)):
                if not len(shingles):
                    continue
                node = set_hash(shingles)
                digest[i] = node, len(shingles)
                if node in seen or not ids[i].is_valid:
                    continue
                seen.add(node)
                fresh.append(i)
                drawn.append(sketch(shingles, int(sketch_words(np.array(len(shingles)), bands))).tobytes())
                found = bands.signatures(shingles)
                if len(found):
                    sigs.append(found)
                    nodes.append(node)
                    held += len(found)
                if held >= flush:
                    yield from emit(sigs, nodes)
                    sigs, nodes, seen, held = [], [], set(), 0
            given = np.array([x.is_valid for x in ids], np.int64)
            doc_ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * given
            spread = (mix64(doc_ids.view(np.uint64) + np.arange(len(ids), dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64)
            keys = batch.column("key").to_numpy()
            yield from chunks(DIGEST, spread, [doc_ids, digest[:, 0], digest[:, 1] * 2 + given, keys])
            new = digest[fresh]
            yield from chunks(SKETCHES, new[:, 0] % buckets, [new[:, 0], new[:, 1]], drawn)
        yield from emit(sigs, nodes)

    def meet(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()

        def column(kind: int, name: str, dtype: type) -> np.ndarray:
            found = [np.frombuffer(table.column(name)[int(i)].as_buffer(), dtype) for i in np.flatnonzero(kinds == kind)]
            return np.concatenate([np.zeros(0, dtype), *found])

        doc, node, size, key = (column(DIGEST, c, np.int64) for c in "xyzw")
        named, large = (column(SKETCHES, c, np.int64) for c in "xy")
        begin, flat = np.concatenate(([0], np.cumsum(sketch_words(large, bands)))), column(SKETCHES, "z", np.uint64)
        one = np.unique(named, return_index=True)[1]
        drawn = [flat[begin[i]:begin[i + 1]].tobytes() for i in one]
        group, member = shared_groups(column(SIGNATURES, "x", np.uint64), column(SIGNATURES, "y", np.int64))
        counts, none = [len(doc), len(group), len(one)], np.zeros(len(one), np.int64)
        return pa.table({
            "kind": pa.array(np.repeat(np.array([DIGEST, GROUPS, SKETCHES], np.int32), counts)),
            "a": pa.array(np.concatenate((doc, group, none))), "b": pa.array(np.concatenate((node, member, named[one]))),
            "n": pa.array(np.concatenate((size // 2, np.zeros(len(group), np.int64), large[one]))),
            "given": pa.array(np.concatenate((size % 2 == 1, np.ones(len(group) + len(one), bool)))),
            "key": pa.array(np.concatenate((key, np.zeros(len(group) + len(one), np.int64)))),
            "sketch": pa.array([None] * (len(doc) + len(group)) + drawn, pa.binary())})

    return docs.mapInArrow(read, CHUNK_SCHEMA).groupBy("bucket").applyInArrow(meet, FOUND_SCHEMA)


def close_pairs(found: DataFrame, bands: Bands, buckets: int) -> DataFrame:
    """Links (``a, b``, nodes) that connect all nodes of a group whose sketches are close."""
    sketches = found.filter(F.col("kind") == SKETCHES).select("b", "n", "sketch")
    groups = found.filter(F.col("kind") == GROUPS).select(F.col("a").alias("group"), "b").distinct()
    rows = groups.join(sketches, "b").select(F.pmod("group", F.lit(buckets)).cast("int").alias("bucket"), "group", "b", "n", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        group, node, size = (table.column(c).to_numpy() for c in ("group", "b", "n"))
        names, one, number = np.unique(node, return_index=True, return_inverse=True)
        flat = np.frombuffer(b"".join(table.column("sketch").take(pa.array(one)).to_pylist()), np.uint64)
        links = names[close_links(group, number, Sketches(size[one], sketch_words(size[one], bands), flat, bands))]
        return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})

    return rows.groupBy("bucket").applyInArrow(compare, "a long, b long")


def linked(sets: list[np.ndarray], num: int, den: int, known: np.ndarray | None = None) -> np.ndarray:
    """Component (smallest index) of every set; sets come in order of size. Pairs of one component are not compared.

    Sets with equal numbers in ``known`` are in one component from the start.
    """
    forest, m = Forest(len(sets)), len(sets)
    if known is not None:
        order = np.argsort(known, kind="stable")
        for a, b in zip(order[:-1][known[order[1:]] == known[order[:-1]]], order[1:][known[order[1:]] == known[order[:-1]]]):
            forest.join(int(a), int(b))
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    shingles = np.concatenate(sets)
    order = np.argsort(shingles, kind="stable")
    _, code, counts = np.unique(shingles[order], return_inverse=True, return_counts=True)
    lists, begin = owner[order], np.concatenate(([0], np.cumsum(counts)))
    codes = np.empty(len(shingles), np.int64)
    codes[order] = code
    first = np.concatenate(([0], np.cumsum(sizes)))
    low = np.searchsorted(sizes, -(-sizes * num // den))  # smaller sets are too small to be similar
    for x in range(1, m):
        if low[x] >= x:
            continue
        roots = forest.roots()
        if (roots[low[x]:x] == roots[x]).all():
            continue
        mine = codes[first[x]:first[x + 1]]
        mine = mine[counts[mine] > 1]
        if not len(mine):
            continue
        width = counts[mine]
        places = np.repeat(begin[mine] - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
        common = np.bincount(lists[places], minlength=m)[low[x]:x]
        similar = np.flatnonzero(common * den >= num * (sizes[low[x]:x] + sizes[x] - common)) + low[x]
        for y in np.unique(roots[similar]):
            forest.join(int(y), x)
    return forest.roots()


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_name: str = "doc_id",
                       text_name: str = "text", bucket_bytes: int = 1 << 23, task_shingles: int = 1 << 21) -> DataFrame:
    """``doc_id, n_shingles, component_id, doc_key, root`` for every row: documents link if num/den of their shingles are common.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A set holds the distinct runs of ``n`` words;
    a text of fewer words is one shingle. Null texts and texts without words are empty sets: they link with nothing and
    are their own component. ``component_id`` is the smallest doc_id that links lead to. ``doc_key`` (xxhash64 of the text's bytes)
    tells rows with one id apart, ``root`` names the component also where ids repeat (null: empty or without id). Equal sets are one node, named
    by a 64-bit hash, so copies cost nothing. Rows that repeat an id are judged by their own text. Rows without an id
    get their set size and no component, and link nothing. An empty table gives an empty table; only id and text are
    read.

    Candidates form clusters; a cluster of up to ``task_shingles`` shingles is compared in one task. Of larger ones all sets are
    first compared with a few; most are connected by that. What is not connected with the most is cut into blocks by set
    size and hash and meets the blocks of all others of neighbouring sizes.
    """
    rows = docs.select(F.col(id_name).cast("long").alias("doc_id"), text_bytes(text_name).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = rows.select("doc_id", F.xxhash64("text").alias("key"), "text")
    bands = Bands(num, den)
    buckets = max(16, -(-size // bucket_bytes))
    found = saved(candidates(rows, n, bands, buckets), "signatures")
    digest = found.filter(F.col("kind") == DIGEST).select(
        F.when(F.col("given"), F.col("a")).alias("doc_id"), F.col("b").alias("node"), F.col("n"), F.col("key").alias("doc_key"))
    part = digest.filter("doc_id IS NOT NULL AND n > 0")
    nodes = part.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("n").alias("n"))
    labels = _compare(rows, nodes, components(close_pairs(found, bands, buckets)), n, bands, task_shingles)
    named = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = saved(named, "nodes")
    roots = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    alone, several = roots.filter("members = 1"), roots.filter("members > 1")
    known = hot_join(named, several, ["root"], "members").select("node", "component_id", "copies", "root")
    known = known.unionByName(named.join(alone, "root").select("node", "component_id", "copies", "root"))
    outside = digest.filter("doc_id IS NULL OR n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "doc_key", F.lit(None).cast("long").alias("root"))
    return hot_join(part, known, ["node"], "copies").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "doc_key", "root").unionByName(outside)


def _compare(rows: DataFrame, nodes: DataFrame, clusters: DataFrame, n: int, bands: Bands, task_shingles: int) -> DataFrame:
    """``node, root``: exact components within the candidate clusters (``node, root``)."""
    members = saved(clusters.withColumnRenamed("root", "cluster").join(nodes, "node"), "members")
    weight = members.groupBy("cluster").agg(F.sum("n").alias("weight"))
    any_large = bool(weight.filter(F.col("weight") > task_shingles).take(1))
    band = F.size(F.filter(F.array(*map(F.lit, bands.low)), lambda low: low <= F.col("n")))
    placed = members.join(weight, "cluster").select(
        F.col("first_id").alias("doc_id"), "node", "cluster", (F.col("weight") <= task_shingles).alias("whole"), band.alias("band"))
    few = members.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    placed = F.broadcast(placed) if few else placed.hint("shuffle_hash")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            wanted = batch.column("node").to_numpy()
            out, keep = [], []
            for i, shingles in enumerate(shingle_sets(data, offsets, n)):
                if len(shingles) and set_hash(shingles) == wanted[i]:
                    out.append(shingles.tobytes())
                    keep.append(i)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("cluster", "node", "whole", "band")),
                                              pa.array(out, pa.binary())], names=["cluster", "node", "whole", "band", "shingles"])

    with_text = rows.join(placed, "doc_id").select("cluster", "node", "whole", "band", "text")
    found = with_text.mapInArrow(sets, "cluster long, node long, whole boolean, band int, shingles binary")
    num, den = bands.num, bands.den
    if any_large:
        found = saved(found, "sets")

    def compare(table: pa.Table) -> pa.Table:
        ids, picked = _picked(table)
        return pa.table({"node": pa.array(ids), "root": pa.array(ids[linked(picked, num, den)])})

    pairs = found.filter("whole").select("cluster", "node", "shingles").groupBy("cluster").applyInArrow(compare, "node long, root long")
    if not any_large:
        return pairs
    # A repeated id gives a set more than once.
    large = found.filter("NOT whole").dropDuplicates(["node"]).withColumn("n", F.length("shingles") / 8)
    return pairs.unionByName(_compare_large(saved(large, "large"), bands, task_shingles))


def _picked(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nodes of a group and their sets, in order of size."""
    named = {node: i for i, node in enumerate(table.column("node").to_pylist())}  # copies of a repeated id: once
    picked = [(node, np.frombuffer(table.column("shingles")[i].as_buffer(), np.uint64)) for node, i in named.items()]
    picked.sort(key=lambda x: (len(x[1]), x[0]))
    return np.array([x[0] for x in picked], np.int64), [x[1] for x in picked]


def similar_to(pivot: np.ndarray, flat: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the sets that stand one after another in ``flat`` are similar to ``pivot`` (sorted)."""
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    hits = np.concatenate(([0], np.cumsum(pivot[at] == flat)))
    ends = np.cumsum(sizes)
    common = hits[ends] - hits[ends - sizes]
    return common * den >= num * (sizes + len(pivot) - common)


def _compare_large(large: DataFrame, bands: Bands, task_shingles: int) -> DataFrame:
    """``node, root`` of clusters that do not fit one task (``cluster, band, node, n, shingles``, one row per node).

    Similar sets are of the same band or of neighbouring ones. A block meets the pivots of these; then only sets outside the
    largest component so found have pairs left to compare, with each other and with that component's blocks.
    """
    num, den = bands.num, bands.den
    on = ["cluster", "band"]
    counts = large.groupBy(*on).agg(F.ceil(F.sum("n") / task_shingles).cast("int").alias("blocks"))
    blocks = counts.select("cluster", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    least = F.min(F.struct(F.xxhash64("node"), "node")).alias("first")
    pivots = large.groupBy(*on, F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("slot")).agg(least).select(F.col("first.node").alias("node"))
    # A few sets per band and cluster, for each of the blocks that they meet.
    sets = large.join(pivots, "node").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    sent = sets.join(blocks, on).select(*on, "block", "node", "shingles", F.lit(True).alias("pivot"))
    mine = hot_join(large, counts.join(large.groupBy(*on).agg(F.count("*").alias("n_rows")), on), on, "n_rows").select(
        *on, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", "shingles", F.lit(False).alias("pivot"))

    def meet(table: pa.Table) -> pa.Table:
        marks = table.column("pivot").to_numpy(zero_copy_only=False)
        ids, texts = table.column("node").to_numpy(), table.column("shingles")
        held = np.flatnonzero(~marks)
        out = [np.zeros((0, 2), np.int64)]
        if len(held):
            flat = np.concatenate([np.frombuffer(texts[int(i)].as_buffer(), np.uint64) for i in held])
            sizes = np.array([len(texts[int(i)].as_buffer()) // 8 for i in held])
            for p in np.flatnonzero(marks):
                close = similar_to(np.frombuffer(texts[int(p)].as_buffer(), np.uint64), flat, sizes, num, den)
                hit = ids[held[close]]
                out.append(np.stack((hit, np.full(len(hit), ids[p])), 1))
        links = np.concatenate(out)
        return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})

    links = saved(sent.unionByName(mine).groupBy(*on, "block").applyInArrow(meet, "a long, b long"), "pivots")
    first = components(links)
    named = large.select("cluster", "node", "n").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = saved(named, "first")
    heavy = named.groupBy("cluster", "root").agg(F.sum("n").alias("n")).groupBy("cluster").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    if not heavy.take(1):
        return named.select("node", "root")
    # Band q has the codes 2 q (sets of the largest component) and 2 q + 1 (the others).
    rest = large.join(named.select("node", "root"), "node").join(F.broadcast(heavy) if heavy.limit(SENT_ROWS + 1).count() <= SENT_ROWS else heavy, "cluster")
    rest = saved(rest.select("cluster", "node", "n", "root", "shingles", (
        2 * F.col("band") + (F.col("root") != F.col("main")).cast("int")).alias("code")), "rest")
    blocks = (rest.groupBy("cluster", "code").agg(F.ceil(2 * F.sum("n") / task_shingles).cast("int").alias("blocks"), F.count("*").alias("n_rows"))
              .groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("code", "blocks"))).alias("blocks"), F.sum("n_rows").alias("n_rows")))
    rest = hot_join(rest, blocks, ["cluster"], "n_rows")
    here, of = F.col("code"), F.col("blocks")
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("node"), of[here]).cast("int"))

    def every(code: Column) -> Column:
        return F.when(of[code].isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), of[code] - 1))

    def keys(low: Column, high: Column, code: Column, upward: bool) -> Column:
        """Keys of this block with all blocks of ``code``; the lower code and its block come first."""
        return F.transform(every(code), lambda j: F.concat_ws(":", "cluster", low, high, *(("mine", j) if upward else (j, "mine"))))

    same = F.transform(every(here), lambda j: F.concat_ws(":", "cluster", here, here, F.least("mine", j), F.greatest("mine", j)))
    others = F.concat(same, keys(here, here + 2, here + 2, True), keys(here - 2, here, here - 2, False),
                      *[keys(here + d, here, here + d, False) for d in (-3, -1)], keys(here, here + 1, here + 1, True))
    most = F.concat(keys(here, here + 1, here + 1, True), keys(here, here + 3, here + 3, True), keys(here - 1, here, here - 1, False))
    dealt = rest.select("node", "root", "shingles", F.explode(F.when(here % 2 == 1, others).otherwise(most)).alias("key"))

    def compare(table: pa.Table) -> pa.Table:
        ids, picked = _picked(table)
        root_of = dict(zip(table.column("node").to_pylist(), table.column("root").to_pylist()))
        known = np.array([root_of[i] for i in ids.tolist()], np.int64)
        return pa.table({"a": pa.array(ids), "b": pa.array(ids[linked(picked, num, den, known)])})

    more = dealt.groupBy("key").applyInArrow(compare, "a long, b long").filter("a <> b")
    joined = components(more.unionByName(named.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return named.select("node", "root").join(joined.withColumnRenamed("root", "last"), "node", "left").select(
        "node", F.coalesce("last", "root").alias("root"))
