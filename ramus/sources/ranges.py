"""Data sources that read one large file by byte ranges: binary CSR graphs, words.

A task gets a range of a bounded length and finds by itself where its rows begin, so a file
of any size is read by many tasks, none of which holds more than its range. Paths are
those of a local or mounted folder, or URIs that pyarrow's file systems know (hdfs, s3, gs);
other stores are read by :mod:`ramus.sources.files`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Entries or bytes of a task, by default.
ENTRIES, BYTES = 1 << 22, 1 << 23
BATCH, STARTS = 1 << 16, 1 << 20
HEAD = 3
# What belongs to a word, by what separates words.
WORDS = {"space": rb"[^ \t\r\n\x00]", "not_alphanum": rb"[A-Za-z0-9]", "not_alpha": rb"[A-Za-z]"}


def _opened(path: str) -> BinaryIO:
    path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" not in path:
        return open(path, "rb")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _length(file: BinaryIO) -> int:
    file.seek(0, os.SEEK_END)
    return file.tell()


def _at(file: BinaryIO, first: int, n: int) -> np.ndarray:
    """n little-endian int32 from number ``first`` of the file."""
    file.seek(4 * first)
    data = file.read(4 * n)
    if len(data) < 4 * n:
        raise ValueError("the file is shorter than its header tells")
    return np.frombuffer(data, "<i4").astype(np.int64)


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _cut(first: int, last: int, step: int) -> list[InputPartition]:
    if step < 1:
        raise ValueError("a task's share has to be positive")
    return [Range(k, min(k + step, last)) for k in range(first, last, step)] or [Range(first, first)]


class CsrReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.share = options["path"], int(options.get("entries", ENTRIES))

    def partitions(self) -> list[InputPartition]:
        with _opened(self.path) as file:
            rows, _, entries = _at(file, 0, HEAD)
            if _length(file) < 4 * (HEAD + rows + 1 + entries):
                raise ValueError(f"{self.path} is shorter than its header tells")
        return _cut(0, int(entries), self.share)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with _opened(self.path) as file:
            rows = int(_at(file, 0, 1)[0])
            # The last row that starts at the range's first entry or before it, by bisection in the file.
            row, high = 0, rows
            while high - row > 1:
                middle = (row + high) // 2
                if _at(file, HEAD + middle, 1)[0] <= partition.first:
                    row = middle
                else:
                    high = middle
            place = partition.first
            while place < partition.last:
                if row >= rows:
                    raise ValueError("the starts of the rows end before the entries")
                starts = np.clip(_at(file, HEAD + row, min(STARTS, rows - row) + 1), place, partition.last)
                n = int(starts[-1]) - place
                u = np.repeat(np.arange(row, row + len(starts) - 1), np.diff(starts))
                v = _at(file, HEAD + rows + 1 + place, n)
                for k in range(0, n, BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(u[k : k + BATCH]), pa.array(v[k : k + BATCH])], ["u", "v"])
                place, row = place + n, row + len(starts) - 1


class BinaryCsr(DataSource):
    """u, v of one int32 file: rows, columns, entries, rows + 1 starts, targets. Option entries: targets of a task."""

    @classmethod
    def name(cls) -> str:
        return "binary_csr"

    def schema(self) -> str:
        return "u long, v long"

    def reader(self, schema: object) -> DataSourceReader:
        return CsrReader(dict(self.options))


class WordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.share = options["path"], int(options.get("bytes", BYTES))
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None
        if options.get("separators", "space") not in WORDS:
            raise ValueError(f"separators are one of {tuple(WORDS)}")
        self.letter = WORDS[options.get("separators", "space")]

    def _end(self, file: BinaryIO) -> int:
        size = _length(file)
        return size if self.last is None else min(self.last, size)

    def partitions(self) -> list[InputPartition]:
        with _opened(self.path) as file:
            return _cut(self.first, max(self._end(file), self.first), self.share)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        letter, word = re.compile(self.letter), re.compile(self.letter + b"+")
        with _opened(self.path) as file:
            end = self._end(file)
            # A word belongs to the range that it starts in: the one that runs in is left out, the last is read to its end.
            inside = partition.first > self.first
            file.seek(partition.first - inside)
            data = file.read(partition.last - partition.first + inside)
            to, tail = partition.last, [data]
            while to < end and tail[-1] and letter.match(tail[-1][-1:]):
                more = file.read(min(BATCH, end - to))
                stop = next((k for k in range(len(more)) if not letter.match(more[k : k + 1])), len(more))
                to += len(more)
                tail.append(more[:stop])
                if stop < len(more):
                    break
            data = b"".join(tail)
        skip = len(word.match(data)[0]) if inside and word.match(data) else 0
        base, at, words = partition.first - inside, [], []
        for found in word.finditer(data, skip):
            if base + found.start() >= partition.last:
                break
            at.append(base + found.start())
            words.append(found[0].decode("utf-8", "replace"))
            if len(at) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words, pa.string())], ["at", "word"])
                at, words = [], []
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words, pa.string())], ["at", "word"])


class Words(DataSource):
    """at (byte offset), word of one file. Options: separators (space, not_alphanum, not_alpha), first and last byte, bytes of a task.

    Bytes first to last - 1 are read as if they were the file. Bytes that aren't UTF-8 become U+FFFD.
    """

    @classmethod
    def name(cls) -> str:
        return "words"

    def schema(self) -> str:
        return "at long, word string"

    def reader(self, schema: object) -> DataSourceReader:
        return WordReader(dict(self.options))


def _read(spark: SparkSession, source: type[DataSource], path: str, **options: object) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name())
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load(path)


def csr_by_ranges(spark: SparkSession, path: str, entries: int = ENTRIES) -> DataFrame:
    """u, v of a binary CSR file, ``entries`` targets to a task."""
    return _read(spark, BinaryCsr, path, entries=entries)


def words_by_ranges(spark: SparkSession, path: str, separators: str = "space", first: int = 0, last: int | None = None, share: int = BYTES) -> DataFrame:
    """at, word of bytes first to last - 1 of a file, ``share`` bytes to a task; order by ``at`` for the file's order."""
    return _read(spark, Words, path, separators=separators, first=first, last=last, bytes=share)
