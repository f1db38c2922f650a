"""Quality rules: word counts and repetition, and compression ratios held against bands that depend on the length.

A text that Zstandard makes much smaller than prose of its length repeats itself; one that it can hardly make smaller is no
prose. Both the whole text and each chunk of fixed size are compressed. The limits are parameters and the same for every
table; nothing is learnt from the data. One pass without a shuffle; what a task holds is bounded by one batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, mix64, pieces, span_hashes, text_bytes, translated, word_spans, words_table

SYMBOLS = b"#*$%&|<>"
_WORDS = words_table("visible", lower=False)
_IS_SYMBOL = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SYMBOLS, np.uint8))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = (", ".join(f"{c} long" for c in COUNTS) +
          ", base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, reason string, kept boolean")


@dataclass(frozen=True)
class Band:
    """Texts (or chunks) of up to ``upto`` bytes: the least and the greatest ratio of compressed to plain bytes."""

    upto: float
    low: float
    high: float


#: Short texts have less to repeat, and a frame adds some bytes to every text.
BANDS = (Band(128, 0.35, 2.0), Band(256, 0.30, 1.2), Band(512, 0.28, 0.95), Band(1024, 0.26, 0.85), Band(2048, 0.24, 0.78),
         Band(4096, 0.22, 0.74), Band(16384, 0.20, 0.70), Band(65536, 0.18, 0.67), Band(float("inf"), 0.16, 0.65))


@dataclass(frozen=True)
class Rules:
    """A document is kept with at least ``min_words`` words, at most ``max_repeats`` percent of them in repeated windows,
    a ratio within its band, and at most ``max_bad`` percent of its bytes in chunks whose ratio is outside theirs."""

    min_words: int = 50
    max_repeats: int = 50
    window: int = 3
    bands: Sequence[Band] = BANDS
    chunk_bytes: int = 4096
    max_bad: int = 25
    level: int = 3

    def limits(self, size: int) -> Band:
        return next(b for b in self.bands if size <= b.upto)


def repeated(keys: np.ndarray, rows: np.ndarray, first: bool) -> np.ndarray:
    """Marks keys that are there twice or more in their row; without ``first`` the first of equal ones is not marked."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    k, r = keys[order], rows[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    marked = np.zeros(len(keys), bool)
    marked[order[1:][same]] = True
    if first:
        marked[order[:-1][same]] = True
    return marked


def text_counts(data: np.ndarray, offsets: np.ndarray, window: int = 3) -> dict[str, np.ndarray]:
    """``COUNTS`` for every row of a buffer. Equal words and lines are told by 64-bit hashes."""
    n = len(offsets) - 1
    blanks = translated(data, _WORDS)
    starts, ends, rows = word_spans(blanks, offsets)

    def per_row(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(at[marks], minlength=n).astype(np.int64)

    # Code points: bytes that do not continue a character. A string has whole characters only.
    leads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[data])))
    chars = np.bincount(rows, weights=leads[ends] - leads[starts], minlength=n).astype(np.int64)

    hashes = span_hashes(data, starts, ends)
    repeats = np.zeros(n, np.int64)
    if len(starts) >= window:
        last = len(starts) - window + 1
        keys = np.zeros(last, np.uint64)
        for i in range(window):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + last])
        inside = np.flatnonzero(rows[:last] == rows[window - 1:])
        twice = inside[repeated(keys[inside], rows[inside], first=True)]
        covered = np.zeros(len(starts), bool)
        for i in range(window):
            covered[twice + i] = True
        repeats = per_row(covered, rows)

    # Lines end at line feeds and at the ends of rows.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    line_starts = line_starts[line_starts < len(data)]
    stops = np.concatenate((line_starts[1:], [len(data)]))
    # The line feed itself is no part of a line.
    stops = stops - (data[stops - 1] == 10) if len(stops) else stops
    line_rows = np.searchsorted(offsets, line_starts, "right") - 1
    worded = np.searchsorted(starts, line_starts) < np.searchsorted(starts, stops)
    line_starts, stops, line_rows = line_starts[worded], stops[worded], line_rows[worded]
    copies = repeated(span_hashes(data, line_starts, stops), line_rows, first=False)
    return {
        "n_words": np.bincount(rows, minlength=n).astype(np.int64), "word_chars": chars,
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]], "n_dup_lines": per_row(copies, line_rows),
        "n_repeat_words": repeats}


def compression(text: memoryview, rules: Rules, press: zstandard.ZstdCompressor) -> tuple[float | None, int, int, str | None]:
    """Ratio of the whole text, its chunks, those outside their band, and the rule it breaks (or none)."""
    size = len(text)
    if not size:
        return None, 0, 0, "empty"

    def beyond(part: memoryview) -> tuple[float, str | None]:
        ratio, band = len(press.compress(part)) / len(part), rules.limits(len(part))
        return ratio, "repetitive" if ratio < band.low else "incompressible" if ratio > band.high else None

    ratio, why = beyond(text)
    chunks = [text[i:i + rules.chunk_bytes] for i in range(0, size, rules.chunk_bytes)]
    # A text of one chunk has been compressed already.
    bad = [c for c in chunks if beyond(c)[1]] if len(chunks) > 1 else chunks if why else []
    if not why and 100 * sum(map(len, bad)) > rules.max_bad * size:
        why = "chunks"
    return ratio, len(chunks), len(bad), why


def judge(docs: DataFrame, rules: Rules = Rules(), text_name: str = "text", piece_bytes: int = 1 << 20) -> DataFrame:
    """Every row of ``docs`` as ``doc`` (a struct, so names cannot clash) with the counts, ratio, reason and verdict.

    A null text is an empty one: no words, no ratio, not kept. ``reason`` is the first rule that a text breaks: ``short``,
    ``repeated`` (these two are ``base_failed``), ``repetitive``, ``incompressible`` or ``chunks``; null if it is kept. Texts
    are compressed whole, however long; ``piece_bytes`` of texts are counted together. Rows are judged one by one, so repeated ones get equal results; an empty table
    gives an empty table.
    """
    if rules.bands[-1].upto != float("inf") or [b.upto for b in rules.bands] != sorted(b.upto for b in rules.bands):
        raise ValueError("bands must ascend and the last one must have no end")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_bytes(f"`{text_name}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=rules.level, write_checksum=False, write_content_size=False)
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            counts = [text_counts(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], rules.window)
                      for a, b in pieces(offsets, piece_bytes)]
            found = {c: np.concatenate([x[c] for x in counts]) if counts else np.zeros(0, np.int64) for c in COUNTS}
            short = found["n_words"] < rules.min_words
            failed = short | (100 * found["n_repeat_words"] > rules.max_repeats * found["n_words"])
            view = memoryview(data.data) if len(data) else memoryview(b"")
            pressed = [compression(view[offsets[i]:offsets[i + 1]], rules, press) for i in range(len(failed))]
            why = ["short" if s else "repeated" if f else p[3] for s, f, p in zip(short, failed, pressed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *[pa.array(found[c]) for c in COUNTS], pa.array(failed),
                 pa.array([p[0] for p in pressed], pa.float64()), pa.array([p[1] for p in pressed], pa.int64()),
                 pa.array([p[2] for p in pressed], pa.int64()), pa.array(why, pa.string()),
                 pa.array([w is None for w in why], pa.bool_())],
                names=["doc", *COUNTS, "base_failed", "ratio", "n_chunks", "n_bad_chunks", "reason", "kept"])

    return rows.mapInArrow(work, T.StructType([rows.schema["doc"], *T.StructType.fromDDL(SCHEMA).fields]))
