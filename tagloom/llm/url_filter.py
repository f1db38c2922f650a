"""URL filter: all glob rules at once over every URL, as a bit-parallel automaton.

The positions of all patterns are packed into one bit vector of as many 64-bit words as needed. One step per URL byte
shifts the vector, keeps the bits whose pattern position accepts the byte, and lets positions in front of a ``*`` stay
alive. numpy carries the vectors of many URLs through a step together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, pieces, text_bytes

#: Stands between host and path in a canonical URL: no byte of UTF-8 text has this value.
BORDER = 0xFF
ANY, STAR = ord("?"), ord("*")


@dataclass(frozen=True)
class Rule:
    """A host (with all its subdomains) and the start of a path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> bytes:
        return b"*." + _plain(self.host) + bytes([BORDER]) + _plain(self.path) + b"*"


def _plain(text: str) -> bytes:
    out = text.encode()
    if STAR in out or ANY in out:
        raise ValueError(f"a rule's host and path are plain text: {text!r}")
    return out


class GlobAutomaton:
    """Patterns of bytes with ``*`` (any run) and ``?`` (any byte) that must match a whole string."""

    def __init__(self, globs: Sequence[bytes]):
        self.n = len(globs)
        places: list[tuple[int, int | None]] = []  # (pattern, byte); None accepts all bytes
        stay, fresh, always, first, last = [], [], [], [], []
        self.empty = np.zeros(self.n, bool)  # patterns of stars alone
        self.void = np.zeros(self.n, bool)  # the pattern of no characters
        for k, glob in enumerate(globs):
            body = [c for c in glob if c != STAR]
            if not body:
                self.empty[k], self.void[k] = bool(glob), not glob
                continue
            start, at = len(places), -1
            for c in glob:
                if c == STAR:
                    if at < 0:
                        always.append(start)
                    else:
                        stay.append(start + at)
                else:
                    at += 1
                    places.append((k, None if c == ANY else c))
            fresh.append(start)
            first.append(start)
            last.append((k, start + at))
        self.words = max(1, -(-len(places) // 64))
        self.accept = np.zeros((256, self.words), np.uint64)
        for i, (_, c) in enumerate(places):
            bit = np.uint64(1 << (i % 64))
            if c is None:
                self.accept[:, i // 64] |= bit
            else:
                self.accept[c, i // 64] |= bit
        self.stay, self.always, self.fresh = (self._mask(x) for x in (stay, always, fresh))
        self.last = last

    def _mask(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in places:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which string matches which pattern: bool, strings x patterns."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = offsets[:-1][order], lengths[order]
        state = np.zeros((len(order), self.words), np.uint64)
        alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
        start = self.always | self.fresh
        for i, n in enumerate(alive):
            old = state[:n]
            new = old << np.uint64(1)
            new[:, 1:] |= old[:, :-1] >> np.uint64(63)
            new &= ~self.fresh  # a pattern's last position never runs into the next pattern
            new |= start if i == 0 else self.always
            new &= self.accept[data[begin[:n] + i]]
            new |= old & self.stay
            state[:n] = new
        out = np.zeros((len(order), self.n), bool)
        for k, at in self.last:
            out[order, k] = (state[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1) > 0
        out |= self.empty
        out |= self.void & (np.diff(offsets) == 0)[:, None]
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    # (?s) lets a dot match line breaks; the lazy head stops at the first "://".
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_name: str = "page_id",
                url_name: str = "url", step_bytes: int = 1 << 22) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row: the longest rule that fits decides, else ``default``.

    Of rules of equal length the one listed first wins. A null url, one without ``://`` and an empty one have an empty
    host and path, so no rule fits. Ids may be null or repeated: every row is judged by itself. Other columns are not
    read, so their names do not matter. Very long URLs cost one step per byte.
    """
    host, path = host_and_path(F.col(url_name))
    ranked = sorted(rules, key=lambda r: -len(r.name.encode()))
    automaton = GlobAutomaton([r.glob for r in ranked])
    names = np.array([r.name for r in ranked] + [None], object)
    verdicts = np.array([r.verdict for r in ranked] + [default], object)
    rows = pages.select(F.col(id_name).alias("page_id"), host.alias("host"), path.alias("path"))
    schema = rows.withColumns({c: F.lit(None).cast("string") for c in ("rule", "verdict")}).schema
    rows = rows.withColumn("_url", F.concat(F.lit(b"."), text_bytes("host"), F.lit(bytes([BORDER])), text_bytes("path")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("_url"))
            for a, b in pieces(offsets, step_bytes):
                fits = automaton.match(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                best = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked)) if ranked else np.zeros(b - a, int)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("page_id", "host", "path")),
                     pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())],
                    names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(judge, schema)
