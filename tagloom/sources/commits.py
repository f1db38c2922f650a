"""Answers that tasks put away while a wave of calls is running.

A wave is cut into slices of units by a hash of their keys. A task that has called all units of a slice writes their answers
as one file, under a name that says which wave and slice it is. A task that comes to a slice whose file is there, be it
in a second attempt after a lost executor or in a run that was started again, takes the answers from it and calls nothing.
Files appear whole or not at all: they are written beside their place and moved there. The wave's own table is still
written by Spark; these files only save calls.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SliceLog:
    """The files of one wave below ``folder`` (shared storage that ``pyarrow.fs`` can open)."""

    folder: str

    def _place(self, number: int) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (
            fs.LocalFileSystem(), self.folder)
        return system, f"{path}/slice-{number:08d}.parquet"

    def read(self, number: int) -> pa.Table | None:
        """The answers of a slice, or None if it has not been put away."""
        system, path = self._place(number)
        if system.get_file_info(path).type != fs.FileType.File:
            return None
        with system.open_input_file(path) as file:
            return pq.read_table(file)

    def write(self, number: int, answers: pa.Table) -> None:
        system, path = self._place(number)
        beside = f"{path}.{uuid.uuid4().hex}.part"
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(beside) as file:
            pq.write_table(answers, file)
        system.move(beside, path)


def slice_number(keys: Sequence[str | Column], slices: int) -> Column:
    """Slice of a unit: a function of its keys alone, whatever the partitions."""
    return F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")


def by_slice(batches: Iterator[pa.RecordBatch], column: str | None, size: int) -> Iterator[tuple[int | None, pa.RecordBatch]]:
    """Rows that follow one another with one slice number, however the batches are cut; without a column, ``size`` rows at a time."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    if column is None:
        for batch in batches:
            yield from ((None, batch.slice(i, size)) for i in range(0, batch.num_rows, size))
        return
    now = None
    for batch in batches:
        numbers = batch.column(column).to_pylist()
        at = 0
        for i in range(len(numbers) + 1):
            if i == len(numbers) or numbers[i] != now:
                if i > at:
                    held.append(batch.slice(at, i - at))
                    at = i
                if i < len(numbers):
                    if held:
                        yield now, whole()
                        held = []
                    now = numbers[i]
    if held:
        yield now, whole()
