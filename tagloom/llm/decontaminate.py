"""Benchmark decontamination on a positional inverted index.

Documents are dealt into segments; a segment stores for every term the positions at which it stands, in one numbering
over all its documents (with gaps in between, so that no phrase runs from one document into the next). A phrase is looked
up per segment: the offset-adjusted position lists of its words are intersected, rarest word first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, saved, span_hashes, text_bytes, translated, word_spans, words_table

WORDS = words_table("alnum")
INDEX_SCHEMA = "segment string, term binary, positions binary, ids array<long>, n_words array<long>"
FOUND_SCHEMA = ("segment string, place int, doc_id long, n_words long, spans array<struct<start:int,end:int>>, "
                "items array<string>")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class Segment:
    """Documents of about the same number of bytes in all, and the places of their words."""

    def __init__(self, name: str, gap: int, terms: np.ndarray | None):
        self.name, self.gap, self.terms = name, gap, terms
        self.ids, self.n_words, self.next = [], [], 0
        self.hashes, self.places, self.spelled, self.size = [], [], {}, 0

    def add(self, ids: list[int | None], data: np.ndarray, offsets: np.ndarray) -> None:
        data = translated(data, WORDS)
        starts, ends, rows = word_spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        counts = np.bincount(rows, minlength=len(ids))
        begin = self.next + np.concatenate(([0], np.cumsum(counts + self.gap)))
        first = np.concatenate(([0], np.cumsum(counts)))
        places = np.arange(len(starts)) - first[rows] + begin[rows]
        if self.terms is not None:
            at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1) if len(self.terms) else None
            keep = self.terms[at] == hashes if at is not None else np.zeros(len(hashes), bool)
            hashes, places, starts, ends = hashes[keep], places[keep], starts[keep], ends[keep]
        _, where = np.unique(hashes, return_index=True)
        for i in where:
            self.spelled.setdefault(int(hashes[i]), data[starts[i]:ends[i]].tobytes())
        self.hashes.append(hashes)
        self.places.append(places.astype(np.int32))
        self.ids += ids
        self.n_words += counts.tolist()
        self.next = int(begin[-1])
        self.size += len(data)

    def rows(self) -> pa.RecordBatch:
        hashes, places = np.concatenate(self.hashes), np.concatenate(self.places)
        order = np.argsort(hashes, kind="stable")
        hashes, places = hashes[order], places[order]
        begin = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, int)
        cuts = [*begin.tolist(), len(hashes)]
        terms = [None, *(self.spelled[int(hashes[i])] for i in begin)]
        lists = [None, *(places[a:b].tobytes() for a, b in zip(cuts, cuts[1:]))]
        rest = [None] * len(begin)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.name] * len(terms)), pa.array(terms, pa.binary()), pa.array(lists, pa.binary()),
             pa.array([self.ids, *rest], pa.list_(pa.int64())), pa.array([self.n_words, *rest], pa.list_(pa.int64()))],
            names=["segment", "term", "positions", "ids", "n_words"])


def build_index(docs: DataFrame, terms: Iterable[bytes] | None = None, id_name: str = "doc_id", text_name: str = "text",
                segment_bytes: int = 1 << 24, gap: int = 10) -> DataFrame:
    """The positional index: per segment a row with its documents (term null) and a row per term with its positions.

    ``gap`` unused positions stand behind each document; phrases may have that many words. With ``terms`` only their
    postings are stored.
    """
    chosen = None
    if terms is not None:
        chosen = np.unique(np.array([_hash(t) for t in terms], np.uint64))
    step = 1 << 21

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, segment = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            ids, a = batch.column("doc_id").to_pylist(), 0
            while a < batch.num_rows:
                b = int(np.searchsorted(offsets, offsets[a] + step, "right")) - 1
                b = min(max(b, a + 1), batch.num_rows)
                if segment is None:
                    segment = Segment(f"{part}-{number}", gap, chosen)
                segment.add(ids[a:b], data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                if segment.size >= segment_bytes:
                    yield segment.rows()
                    segment, number = None, number + 1
                a = b
        if segment is not None:
            yield segment.rows()

    rows = docs.select(F.col(id_name).cast("long").alias("doc_id"), text_bytes(text_name).alias("text"))
    return rows.mapInArrow(build, INDEX_SCHEMA)


def _hash(term: bytes) -> int:
    return int(span_hashes(np.frombuffer(term, np.uint8), np.array([0]), np.array([len(term)]))[0])


@dataclass
class Phrases:
    """Distinct word sequences, and the items each belongs to."""

    vocabulary: list[bytes]
    sequences: list[np.ndarray]
    items: list[list[str]]

    @staticmethod
    def windows(rows: Iterable[tuple[str | None, str | None]], window: int) -> Phrases:
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in rows:
            found = words(text)
            for i in range(max(1, len(found) - window + 1) if found else 0):
                owners[tuple(found[i:i + window])].update([] if item is None else [item])
        vocabulary = sorted({w for seq in owners for w in seq})
        number = {w: i for i, w in enumerate(vocabulary)}
        return Phrases(vocabulary, [np.array([number[w] for w in seq]) for seq in owners], [sorted(x) for x in owners.values()])


def exact_places(lists: list[np.ndarray], sequence: np.ndarray) -> np.ndarray:
    """Where a sequence starts: offset-adjusted lists are intersected from the shortest one upward."""
    order = sorted(range(len(sequence)), key=lambda i: len(lists[sequence[i]]))
    found = lists[sequence[order[0]]].astype(np.int64) - order[0]
    for i in order[1:]:
        if not len(found):
            break
        places = lists[sequence[i]]
        at = np.searchsorted(places, found + i)
        found = found[places[np.minimum(at, len(places) - 1)] == found + i]
    return found


def near_spans(lists: list[np.ndarray], sequence: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Shortest stretches of at most ``reach`` words that hold every word of a sequence, in any order."""
    terms = sorted(set(sequence.tolist()), key=lambda t: len(lists[t]))
    around = lists[terms[0]].astype(np.int64)
    events = []
    for t in terms:
        places = lists[t].astype(np.int64)
        low, high = np.searchsorted(around, places - reach, "right"), np.searchsorted(around, places + reach, "left")
        events += [(int(p), t) for p in places[high > low]]
    last: dict[int, int] = {}
    out: list[tuple[int, int]] = []
    for p, t in sorted(events):
        last[t] = p
        start = min(last.values())
        if len(last) == len(terms) and p - start < reach and not (out and out[-1][0] == start):
            out.append((start, p + 1))
    return out


def search(index: DataFrame, phrases: Phrases, near: int | None = None, all_documents: bool = True) -> DataFrame:
    """Documents of an index with the word spans and items of the phrases found in them.

    Without ``near`` a phrase is found word for word, else wherever all its words stand within ``near`` words.
    """
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(phrases)
    terms = spark.createDataFrame([(bytearray(w),) for w in phrases.vocabulary], "term binary")
    known = index.filter(F.col("term").isNull()).unionByName(
        index.filter(F.col("term").isNotNull()).join(F.broadcast(terms), "term", "left_semi"))

    def look(table: pa.Table) -> pa.Table:
        wanted = shared.value
        number = {w: i for i, w in enumerate(wanted.vocabulary)}
        lists = [np.zeros(0, np.int32)] * len(number)
        names, data, ids, n_words = (table.column(c) for c in ("term", "positions", "ids", "n_words"))
        for i in range(table.num_rows):
            if names[i].is_valid:
                lists[number[names[i].as_py()]] = np.frombuffer(data[i].as_buffer(), np.int32)
            else:
                ids_here, counts = ids[i].as_py(), np.array(n_words[i].as_py(), np.int64)
        gap = 10 if near is None else max(10, near)
        begin = np.concatenate(([0], np.cumsum(counts + gap)))
        have = np.array([len(x) > 0 for x in lists])
        spans, items = defaultdict(set), defaultdict(set)
        for sequence, owners in zip(wanted.sequences, wanted.items):
            if not have[sequence].all():
                continue
            if near is None:
                found = [(int(p), int(p) + len(sequence)) for p in exact_places(lists, sequence)]
            else:
                found = near_spans(lists, sequence, near)
            if found:
                rows = np.searchsorted(begin, [a for a, _ in found], "right") - 1
                for (a, b), r in zip(found, rows.tolist()):
                    spans[r].add((a - int(begin[r]), b - int(begin[r])))
                    items[r].update(owners)
        places = range(len(ids_here)) if all_documents else sorted(spans)
        segment = table.column("segment")[0].as_py()
        return pa.table({
            "segment": pa.array([segment] * len(places), pa.string()), "place": pa.array(places, pa.int32()),
            "doc_id": pa.array([ids_here[r] for r in places], pa.int64()),
            "n_words": pa.array([int(counts[r]) for r in places], pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in sorted(spans.get(r, ()))] for r in places],
                              pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "items": pa.array([sorted(items.get(r, ())) for r in places], pa.list_(pa.string()))})

    return known.groupBy("segment").applyInArrow(look, FOUND_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, near: int | None = None,
                  id_name: str = "doc_id", text_name: str = "text", item_name: str = "item_id", item_text: str = "text",
                  block_bytes: int = 1 << 24, segment_bytes: int = 1 << 24) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items`` for every row of ``docs``.

    Words are runs of digits, letters and bytes from 0x80, with A-Z lower-cased. A window is ``window`` consecutive words
    of an item; an item of fewer words is one window. ``spans`` are the word ranges hit, ``items`` the ids found.
    ``items_sha256`` is over the ids sorted as strings and joined by commas (the empty string if there are none).
    Null texts, empty ones and those without words have no words: such items are never found, such documents never hit.
    An item without id marks words, but is not listed; rows that share an id are one item. Rows of ``docs`` are judged
    one by one, so null and repeated ids stay as they are. Empty tables are fine. Only ids and texts are read.

    The benchmark is searched in blocks of about ``block_bytes`` of text, which bounds what a task is sent. If it is one
    block, the index holds just its words.
    """
    if window > 10 and near is None:
        raise ValueError("windows have at most 10 words")
    items = benchmark.select(F.col(item_name).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    first: Phrases | None = None

    def block(b: int) -> Phrases:
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        return Phrases.windows(((r.item_id, r.text) for r in rows.toLocalIterator()), window)

    if blocks == 1:
        first = block(0)
    gap = max(10, near or 0)
    index = build_index(docs, first.vocabulary if first else None, id_name, text_name, segment_bytes, gap)
    index = saved(index, "postings")
    if first:
        found = search(index, first, near)
    else:
        parts = [search(index, block(b), near, all_documents=b == 0) for b in range(blocks)]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("segment", "place").agg(
            F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    hit = F.aggregate(F.array_sort("spans"), start, lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["upto"]))).alias("n"),
        F.greatest(s["upto"], x["end"]).alias("upto")), lambda s: s["n"].cast("long"))
    names = F.array_sort("items")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans",
        names.alias("items"))
