"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed independently. A skippable frame at the end of a bundle holds the
seek table (compressed and plain size of every frame, in the public seekable format), so any frame can be read alone.
The index maps a record to bundle, frame and offset within the frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_folder
from .common import buffers, hot_join, text_bytes

# Fixed values of the seekable format: magic of the skippable frame, magic of the footer.
SKIPPABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
# Fixed values of WARC 1.1.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"

INDEX_SCHEMA = "page_id long, bundle string, frame int, frame_at long, frame_size long, at long, size long"
RECORD_SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                 "refers_to long, payload binary")


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(path.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit carries the digest and size of the payload, not the payload."""
    body = b"" if revisit else payload
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    head = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID_PREFIX}{_name(page_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-X-Payload-Length: {len(payload)}"]
    if url is not None:
        broken = "\r" in url or "\n" in url
        head += [f"WARC-Target-URI: {_one_line(url) if broken else url}", *["WARC-X-Escaped-URI: yes"] * broken]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{_name(refers_to)}>"]
    head.append(f"Content-Length: {len(http) + len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _number(text: str) -> int | None:
    name = text.strip("<>").removeprefix(ID_PREFIX)
    return None if name == "none" else int(name)


def _one_line(url: str) -> str:
    """Header values hold no line breaks."""
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _back(url: str) -> str:
    return url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def read_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at an offset, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    size = int(head["Content-Length"])
    block = data[end + 4:end + 4 + size]
    body = block[block.index(b"\r\n\r\n") + 4:]
    revisit = head["WARC-Type"] == "revisit"
    return {
        "page_id": _number(head["WARC-Record-ID"]),
        "url": _back(head["WARC-Target-URI"]) if "WARC-X-Escaped-URI" in head else head.get("WARC-Target-URI"),
        "payload_bytes": int(head["WARC-X-Payload-Length"]) if revisit else len(body),
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(body),
        "record_type": head["WARC-Type"], "refers_to": _number(head["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else body}, end + 4 + size + 4


class Bundle:
    """Writes records into frames, and the seek table at the end."""

    def __init__(self, path: str, frame_bytes: int, level: int):
        fs, place = _open(path)
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        self.path, self.frame_bytes = path, frame_bytes
        self.out = fs.open_output_stream(place, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.at, self.pending, self.size = 0, [], 0
        self.waiting: list[tuple[int | None, int, int]] = []

    def add(self, page_id: int | None, record: bytes) -> list[tuple]:
        """Index rows of the frame that this record closed, if any."""
        self.waiting.append((page_id, self.size, len(record)))
        self.pending.append(record)
        self.size += len(record)
        return self.flush() if self.size >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.pending:
            return []
        frame = self.zstd.compress(b"".join(self.pending))
        self.out.write(frame)
        rows = [(p, self.path, len(self.frames), self.at, len(frame), at, n) for p, at, n in self.waiting]
        self.frames.append((len(frame), self.size))
        self.at += len(frame)
        self.pending, self.waiting, self.size = [], [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()
        return rows


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the footer."""
    end = file.size()
    file.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != FOOTER_MAGIC or flags:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * n)
    sizes = np.frombuffer(file.read(8 * n), "<u4").reshape(n, 2).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(sizes[:, 0])))
    return [(int(at[i]), int(sizes[i, 0]), int(sizes[i, 1])) for i in range(n)]


def read_frame(file: pa.NativeFile, at: int, size: int) -> bytes:
    file.seek(at)
    return zstandard.ZstdDecompressor().decompress(file.read(size))


def with_revisits(pages: DataFrame, id_name: str, payload_name: str, min_bytes: int) -> DataFrame:
    """Adds ``refers_to``: null for a response, else the smallest id with an equal payload.

    Payloads are equal if SHA-256 and length are. Small payloads never refer to others.
    """
    rows = pages.select("*", F.struct(F.sha2(text_bytes(payload_name), 256).alias("sha"),
                                      F.length(text_bytes(payload_name)).alias("n")).alias("_payload"))
    groups = (rows.select(id_name, "_payload").filter(F.col("_payload.n") >= min_bytes).groupBy("_payload")
              .agg(F.min(id_name).alias("_first"), F.count("*").alias("_rows")))
    large = hot_join(rows.filter(F.col("_payload.n") >= min_bytes), groups, ["_payload"], "_rows")
    later = F.when(F.col("_first").isNotNull() & ~F.col(id_name).eqNullSafe(F.col("_first")), F.col("_first"))
    small = rows.filter(F.col("_payload.n") < min_bytes).withColumn("refers_to", F.lit(None).cast("long"))
    found = large.withColumn("refers_to", later).drop("_first", "_rows")
    return (found if min_bytes <= 0 else found.unionByName(small)).drop("_payload")


def write_warc(pages: DataFrame, folder: str | None = None, id_name: str = "page_id", url_name: str = "url",
               payload_name: str = "html", min_revisit_bytes: int = 0, frame_bytes: int = 1 << 20,
               bundle_bytes: int = 1 << 28, level: int = 3) -> DataFrame:
    """Write one record per row into bundles below ``folder`` (shared storage) and return the saved index.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the one with the smallest id is a response, the
    others are revisits of it; rows that repeat the smallest id are responses too, and so is every row of a group without
    any id. A null payload is empty; null ids and urls are kept as null. Every attempt of a task writes bundles of its
    own, and the index names only those of the attempts that count. A record longer than a frame is a frame of its own.
    An empty table gives an empty index and no bundle. Columns other than the three are not read.
    """
    folder = folder or work_folder(pages.sparkSession, "warc")
    chosen = pages.select(F.col(id_name).cast("long").alias("page_id"), F.col(url_name).alias("url"),
                          text_bytes(payload_name).alias("payload"))
    ready = with_revisits(chosen, "page_id", "payload", min_revisit_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        bundle, rows, number = None, [], 0
        for batch in batches:
            ids, urls, payloads, refers = (batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))
            for i in range(batch.num_rows):
                refers_to = refers[i].as_py()
                if bundle is None:
                    bundle = Bundle(f"{folder}/part-{attempt:06d}-{number:04d}-{uuid.uuid4().hex[:8]}.warc.zst",
                                    frame_bytes, level)
                page_id = ids[i].as_py()
                rows += bundle.add(page_id, make_record(page_id, urls[i].as_py(), payloads[i].as_py(), refers_to,
                                                        refers_to is not None))
                if bundle.at >= bundle_bytes:
                    rows += bundle.close()
                    bundle, number = None, number + 1
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        if bundle is not None:
            rows += bundle.close()
        if rows:
            yield _batch(rows)

    path = f"{folder}/index"
    ready.mapInArrow(write, INDEX_SCHEMA).write.parquet(path)
    return pages.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
    names = ["page_id", "bundle", "frame", "frame_at", "frame_size", "at", "size"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


#: Most tasks in which an archive is read back.
MOST_TASKS = 20_000


def read_warc(index: DataFrame, payload: bool = False) -> DataFrame:
    """Every record of the bundles the index names; frames are found through the seek tables of the bundles.

    Every bundle is a task of its own, up to ``MOST_TASKS``. A bundle that is named more than once is read once, an empty index
    gives no records, and a bundle that is gone is an error.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("bundle").to_pylist():
                fs, place = _open(path)
                with fs.open_input_file(place) as file:
                    for at, size, _ in seek_table(file):
                        data, where, out = read_frame(file, at, size), 0, []
                        while where < len(data):
                            record, where = read_record(data, where)
                            out.append(record)
                        yield _records(out, payload)

    bundles = index.select("bundle").distinct()
    # The names are short, but each stands for a bundle to be read: dealt out one by one, however few bytes they have.
    return bundles.repartition(max(1, min(bundles.count(), MOST_TASKS))).mapInArrow(read, RECORD_SCHEMA)


def lookup(index: DataFrame, ids: DataFrame, id_name: str = "page_id") -> DataFrame:
    """The records of some ids: only their frames are read."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, place = _open(row["bundle"])
                with fs.open_input_file(place) as file:
                    data = read_frame(file, row["frame_at"], row["frame_size"])
                yield _records([read_record(data, row["at"])[0]], True)

    wanted = index.join(ids.select(F.col(id_name).alias("page_id")).distinct(), "page_id", "left_semi")
    return wanted.mapInArrow(read, RECORD_SCHEMA)


def _records(rows: list[dict], payload: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[c] if payload or c != "payload" else None for r in rows], k) for c, k in kinds.items()],
        names=list(kinds))


def archive_pages(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write, read back, and return ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``."""
    return read_warc(write_warc(pages, folder, **options)).drop("payload")


def columns_of() -> list[Column]:
    return [F.col(c) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")]
