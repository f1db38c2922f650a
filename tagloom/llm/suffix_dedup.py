"""Removal of repeated strings: a distributed merge sort of suffixes.

Of every string of ``length`` bytes one place is its anchor, chosen by content, so equal strings have equal anchors.
Only the suffixes at anchors are sorted; a suffix is followed by the bytes in front of its anchor, read backward, since a
repeated string may begin before the anchor.

1. Every task hashes its anchors' grams and surroundings. Anchors meet by gram hash (64 bits); those that are alone
   cannot lie in a repeated string, and those with equal surroundings are repeated as a whole. Copies within a task are
   settled there, so a passage of very many documents arrives once per task, and the spans of a document as few rows.
2. The rest, whose surroundings agree in part, is sorted: tasks send front-coded sorted runs, loser trees merge them
   without comparing known prefixes again, and the common prefixes that come out tell which strings are repeated.
3. The spans found are brought together per document and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Anchors
from .common import buffers, mix64, saved, text_bytes, whole_row
from .merge import LoserTree, decode, front_code

ANCHORS, SPANS, WANTED = 0, 1, 2
CHUNK_SCHEMA = "bucket int, kind int, part int, data binary"
#: A document within numpy rows: id, whether it has one, and the key of its text.
DOC = 3


def _chunks(kind: int, rows: np.ndarray, buckets: np.ndarray, parts: np.ndarray, count: int) -> Iterator[pa.RecordBatch]:
    """Rows of 64-bit numbers, packed by bucket; all rows of a chunk of spans or wishes are of one part too."""
    if not len(rows):
        return
    key = buckets.astype(np.int64) * count + parts
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
    yield pa.RecordBatch.from_arrays(
        [pa.array((key[cuts[:-1]] // count).astype(np.int32)), pa.array(np.full(len(cuts) - 1, kind, np.int32)),
         pa.array((key[cuts[:-1]] % count).astype(np.int32)),
         pa.array([rows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
        names=["bucket", "kind", "part", "data"])


def _rows(table: pa.Table, kind: int, width: int) -> np.ndarray:
    kinds = table.column("kind").to_numpy()
    found = [np.frombuffer(table.column("data")[int(i)].as_buffer(), np.uint64) for i in np.flatnonzero(kinds == kind)]
    return np.concatenate(found).reshape(-1, width) if found else np.zeros((0, width), np.uint64)


def _part(rows: np.ndarray, count: int) -> np.ndarray:
    """By id and text, so copies of a text are dealt to all parts."""
    return (mix64(rows[:, 2] ^ mix64(rows[:, 0])) % np.uint64(count)).astype(np.int64)


def _merged(spans: np.ndarray) -> np.ndarray:
    """The spans of every document as disjoint ones; rows equal in id and text have the same spans, and so count once."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, DOC], spans[:, 0], spans[:, 1], spans[:, 2]))]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], (spans[1:, :DOC] != spans[:-1, :DOC]).any(axis=1)))), len(spans))
    # Documents one behind the other on a common axis: one union does for all of them.
    starts, ends = spans[:, DOC].astype(np.int64), spans[:, DOC + 1].astype(np.int64)
    longest = np.maximum.reduceat(ends, cuts[:-1])
    shift = np.repeat(np.concatenate(([0], np.cumsum(longest + 1)[:-1])), np.diff(cuts))
    begin, end = union(starts + shift, ends + shift)
    first = np.searchsorted(starts + shift, begin)
    return np.column_stack((spans[first, :DOC], (begin - shift[first]).astype(np.uint64), (end - shift[first]).astype(np.uint64)))


def _settle(found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of anchors with equal surroundings, one anchor of each surroundings, and how many there are.

    ``found`` has rows of (document, gram hash, hash of the surroundings, anchor, first, last, repeated already).
    """
    order = np.lexsort((found[:, DOC + 1], found[:, DOC]))
    found = found[order]
    same = (found[1:, DOC:DOC + 2] == found[:-1, DOC:DOC + 2]).all(axis=1) if len(found) else np.zeros(0, bool)
    begin = np.flatnonzero(np.concatenate(([True], ~same))) if len(found) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begin, len(found)))
    several = np.repeat(counts > 1, counts)
    spans = np.column_stack((found[several][:, :DOC], found[several][:, DOC + 3], found[several][:, DOC + 4] + np.uint64(length)))
    one = found[begin].copy()
    one[:, DOC + 5] |= (counts > 1).astype(np.uint64)
    return spans, one, counts


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 40, bucket_bytes: int = 1 << 23,
                   flush: int = 1 << 17, run_rows: int = 1 << 15) -> DataFrame:
    """``doc_id, doc_key, starts, ends``: for every document with repeated strings its maximal removed runs (int64 bytes).

    ``docs`` has doc_id (long) and text (binary); ``doc_key`` is the hash of the text, which tells rows with null or
    repeated ids apart. Rows equal in both hold repeated strings like any other copies.
    """
    anchors = Anchors(length, gram)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text")
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(16, -(-size // bucket_bytes))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            spans, one, _ = _settle(np.concatenate(held), length)
            spans = _merged(spans)
            part = _part(spans, count)
            yield from _chunks(SPANS, spans, part, part, count)
            yield from _chunks(ANCHORS, one, (one[:, DOC] % np.uint64(count)).astype(np.int64), np.zeros(len(one), np.int64), count)

        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            given = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False).astype(np.uint64)
            keys = batch.column("doc_key").to_numpy().view(np.uint64)
            for i in range(batch.num_rows):
                if offsets[i + 1] - offsets[i] < length:
                    continue
                found = anchors.contexts(data[offsets[i]:offsets[i + 1]])
                own = np.empty((len(found), DOC + 6), np.uint64)
                own[:, 0], own[:, 1], own[:, 2], own[:, DOC:DOC + 5], own[:, DOC + 5] = ids[i], given[i], keys[i], found, 0
                held.append(own)
                n += len(own)
                if n >= flush:
                    yield from emit()
                    held.clear()
                    n = 0
        if held:
            yield from emit()

    def meet(table: pa.Table) -> pa.Table:
        spans = [_rows(table, SPANS, DOC + 2)]
        found = _rows(table, ANCHORS, DOC + 6)
        repeated = found[found[:, DOC + 5] == 1]
        spans.append(np.column_stack((repeated[:, :DOC], repeated[:, DOC + 3], repeated[:, DOC + 4] + np.uint64(length))))
        more, one, _ = _settle(found, length)
        spans.append(more)
        # Of grams with different surroundings all are needed: some to be judged, the others to be compared with.
        change = np.concatenate(([True], one[1:, DOC] != one[:-1, DOC])) if len(one) else np.zeros(0, bool)
        group = np.cumsum(change) - 1
        sizes = np.bincount(group, minlength=0)
        unsure = np.bincount(group, weights=(one[:, DOC + 5] == 0), minlength=0) > 0
        wanted = one[(sizes[group] > 1) & unsure[group]] if len(one) else one
        out = []
        for kind, rows in ((SPANS, _merged(np.concatenate(spans))), (WANTED, np.delete(wanted, DOC + 1, axis=1))):
            part = _part(rows, count)
            out += _chunks(kind, rows, part, part, count)
        return pa.Table.from_batches(out) if out else table.slice(0, 0)

    first = saved(keyed.mapInArrow(find, CHUNK_SCHEMA).groupBy("bucket").applyInArrow(meet, CHUNK_SCHEMA), "anchors")
    wanted = _by_document(first.filter(F.col("kind") == WANTED), WANTED, DOC + 5, "wanted")
    second = keyed.join(wanted.hint("shuffle_hash"), [keyed.doc_id.eqNullSafe(wanted.doc_id), keyed.doc_key == wanted.doc_key])
    second = second.select("text", "wanted")
    width = length + anchors.reach - 1 + 4

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, owners, n = [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            s, o = np.concatenate(strings), np.concatenate(owners)
            bucket = (o[:, DOC] % np.uint64(count)).astype(np.int64)
            order = np.lexsort((np.ascontiguousarray(s).view(f"S{width}").ravel(), bucket))
            s, o, bucket = s[order], o[order], bucket[order]
            cuts = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
            coded = [front_code(s[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([x.tobytes() for x, _ in coded], pa.binary()),
                 pa.array([x.tobytes() for _, x in coded], pa.binary()),
                 pa.array([o[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                names=["bucket", "lcps", "tails", "owners"])

        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            for i in range(batch.num_rows):
                mine = np.frombuffer(batch.column("wanted")[i].as_buffer(), np.uint64).reshape(-1, DOC + 5)
                for a in range(0, len(mine), run_rows):
                    part = mine[a:a + run_rows]
                    strings.append(surroundings(data[offsets[i]:offsets[i + 1]], part[:, DOC + 1:DOC + 4].astype(np.int64),
                                                length, anchors.reach))
                    owners.append(part)
                    n += len(part)
                    if n >= run_rows:
                        yield from emit()
                        strings.clear()
                        owners.clear()
                        n = 0
        if n:
            yield from emit()

    def merge(table: pa.Table) -> pa.Table:
        lcps, tails, owners = (table.column(c) for c in ("lcps", "tails", "owners"))
        runs = [decode(np.frombuffer(lcps[i].as_buffer(), np.uint16), tails[i].as_py(), width) for i in range(table.num_rows)]
        rows = [np.frombuffer(owners[i].as_buffer(), np.uint64).reshape(-1, DOC + 5) for i in range(table.num_rows)]
        at, out = [0] * len(runs), []
        strings, shared, who = [], [], []

        def judge() -> None:
            own = np.array([rows[r][i] for r, i in who])
            low, high = repeated_offsets(np.frombuffer(b"".join(strings), np.uint8).reshape(-1, width),
                                         np.array(shared), length, anchors.reach)
            hit = (high >= 0) & (own[:, DOC + 4] == 0)
            place = own[hit, DOC + 1].astype(np.int64)
            spans = np.column_stack((own[hit, :DOC], (place - high[hit]).astype(np.uint64),
                                     (place - low[hit] + length).astype(np.uint64)))
            spans = _merged(spans)
            part = _part(spans, count)
            out.extend(_chunks(SPANS, spans, part, part, count))

        for lcp, run, string in LoserTree(runs):
            if lcp < gram and len(strings) >= 1 << 14:
                judge()
                strings, shared, who = [], [], []
            strings.append(string)
            shared.append(lcp if len(strings) > 1 else 0)
            who.append((run, at[run]))
            at[run] += 1
        if strings:
            judge()
        return pa.Table.from_batches(out) if out else _empty()

    merged = second.mapInArrow(sort, "bucket int, lcps binary, tails binary, owners binary") \
        .groupBy("bucket").applyInArrow(merge, CHUNK_SCHEMA)
    spans = first.filter(F.col("kind") == SPANS).unionByName(merged)
    return _by_document(spans, SPANS, DOC + 2, "spans")


def _empty() -> pa.Table:
    return pa.table({"bucket": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "part": pa.array([], pa.int32()),
                     "data": pa.array([], pa.binary())})


def _by_document(chunks: DataFrame, kind: int, width: int, name: str) -> DataFrame:
    """Chunks of one kind, brought together per document: ``doc_id, doc_key`` and its rows (spans: disjoint, in order)."""
    def gather(table: pa.Table) -> pa.Table:
        rows = _rows(table, kind, width)
        rows = rows[np.lexsort((rows[:, DOC], rows[:, 0], rows[:, 1], rows[:, 2]))]
        change = (rows[1:, :DOC] != rows[:-1, :DOC]).any(axis=1)
        cuts = np.append(np.flatnonzero(np.concatenate(([True], change))), len(rows))
        parts = [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        if kind == SPANS:
            parts = [np.column_stack(union(p[:, DOC].astype(np.int64), p[:, DOC + 1].astype(np.int64))) for p in parts]
        docs = rows[cuts[:-1]]
        ids = pa.array(docs[:, 0].view(np.int64) if len(docs) else [], pa.int64(), mask=docs[:, 1] == 0)
        return pa.table({"doc_id": ids, "doc_key": pa.array(np.ascontiguousarray(docs[:, 2]).view(np.int64)),
                         name: pa.array([p.tobytes() for p in parts], pa.binary())})

    return chunks.select("part", "kind", "data").groupBy("part").applyInArrow(gather, f"doc_id long, doc_key long, {name} binary")


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans from spans in order of their starts; touching ones become one."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    fresh = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)
    return starts[fresh], reach[last]


def surroundings(data: np.ndarray, places: np.ndarray, length: int, reach: int) -> np.ndarray:
    """Sort keys of anchors (anchor, first, last start): the suffix, the bytes before it backward, and both extents."""
    at, first, last = places.T
    n = len(data) - 1
    right = at[:, None] + np.arange(length)
    left = at[:, None] - 1 - np.arange(reach - 1)
    out = np.zeros((len(at), length + reach - 1 + 4), np.uint8)
    out[:, :length] = np.where(right < (last + length)[:, None], data[np.minimum(right, n)], 0)
    out[:, length:length + reach - 1] = np.where(left >= first[:, None], data[np.maximum(left, 0)], 0)
    for i, x in enumerate((at - first, at - last)):
        # The digits are never zero, as trailing zeros do not count in numpy's byte strings.
        out[:, length + reach - 1 + 2 * i] = x // 255 + 1
        out[:, length + reach + 2 * i] = x % 255 + 1
    return out


def repeated_offsets(keys: np.ndarray, shared: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance before the anchor at which a repeated string starts (-1: none).

    ``keys`` are sorted, ``shared`` their common prefixes with the key before. At a distance o the strings of keys that
    share length - o bytes of suffix stand together; they are equal if the o bytes before the anchors are.
    """
    n = len(keys)
    far = (keys[:, -4].astype(np.int64) - 1) * 255 + keys[:, -3] - 1
    near = (keys[:, -2].astype(np.int64) - 1) * 255 + keys[:, -1] - 1
    low, high = np.full(n, -1), np.full(n, -1)
    before = np.zeros(n, np.uint64)
    for o in range(reach):
        if o:
            before = mix64(before + keys[:, length + o - 1] + np.uint64(1))
        use = np.flatnonzero((near <= o) & (o <= far))
        if len(use) < 2:
            continue
        right = np.cumsum(shared < length - o).astype(np.uint64)
        name = mix64(right + np.uint64(0x632BE59BD9B4E019))[use] ^ before[use]
        order = np.argsort(name, kind="stable")
        name = name[order]
        equal = name[1:] == name[:-1]
        hit = use[order[np.concatenate((equal, [False])) | np.concatenate(([False], equal))]]
        low[hit] = np.where(low[hit] < 0, o, low[hit])
        high[hit] = o
    return low, high


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 40, id_name: str = "doc_id", text_name: str = "text",
                   whole_characters: bool = False, **options) -> DataFrame:
    """All columns of ``docs`` under ``doc`` (a struct), and what was removed: every byte of a repeated string.

    A string of ``length`` bytes is repeated if it starts anywhere else too, in the same document or another; strings may
    overlap themselves, but never cross documents. Columns: ``doc, kept`` (binary), ``n_bytes, n_removed, n_spans``
    (longs). With ``whole_characters`` a character of UTF-8 that is covered in part stays.

    A null text is empty. Every row counts as a document, so two equal rows are copies of each other; null and repeated
    ids are no special case. An empty table gives an empty table. Columns of ``docs`` may have any names.
    """
    rows = docs.select(whole_row(docs).alias("doc"), F.col(id_name).cast("long").alias("doc_id"),
                       text_bytes(text_name).alias("text"))
    spans = repeated_spans(rows.select("doc_id", "text"), length, gram, **options)
    keyed = rows.withColumn("doc_key", F.xxhash64("text"))
    joined = keyed.join(spans.hint("shuffle_hash"), [keyed.doc_id.eqNullSafe(spans.doc_id), keyed.doc_key == spans.doc_key],
                        "left").select(keyed.doc, keyed.text, spans.spans)
    schema = joined.select("doc", F.col("text").alias("kept")).schema.add("n_bytes", "long").add("n_removed", "long") \
        .add("n_spans", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, figures = [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data = text.as_py()
                removed, last, parts, n = 0, 0, [], 0
                if spans.is_valid:
                    for start, end in np.frombuffer(spans.as_buffer(), np.int64).reshape(-1, 2).tolist():
                        if whole_characters:
                            while start < end and data[start] & 0xC0 == 0x80:
                                start += 1
                            while end < len(data) and start < end and data[end] & 0xC0 == 0x80:
                                end -= 1
                        if start < end:
                            parts.append(data[last:start])
                            removed, last, n = removed + end - start, end, n + 1
                parts.append(data[last:])
                kept.append(b"".join(parts))
                figures.append((len(data), removed, n))
            columns = [*zip(*figures)] or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(cut, schema)


def kept_hash(name: str = "kept"):
    return F.sha2(F.col(name), 256)
