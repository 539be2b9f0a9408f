"""Vectorised text helpers for Arrow batches inside Spark tasks.

Every function takes one Arrow string column and works on its byte buffer with
numpy, so a task never loops over characters. Nulls read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once; a single longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20

_ASCII = np.arange(256, dtype=np.uint8)
#: `[^\x20\x09-\x0D]+`
NON_SPACE = ~((_ASCII == 0x20) | ((_ASCII >= 0x09) & (_ASCII <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lowered
LOWER_ALNUM = ((_ASCII >= 0x30) & (_ASCII <= 0x39)) | ((_ASCII >= 0x61) & (_ASCII <= 0x7A)) | (_ASCII >= 0x80)
_FOLD = _ASCII.copy()
_FOLD[0x41:0x5B] += 0x20


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // limit
        cut = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        for a, b in zip(cut, [*cut[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 byte offsets."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"") if column.null_count else column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ints(column: pa.Array, null: int = 0) -> np.ndarray:
    return pc.fill_null(column, null).to_numpy(zero_copy_only=False)


def binary_array(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


class Words:
    """The words of each text of a column.

    ``begin`` and ``end`` are byte places in ``raw``; the words of text i are
    ``per_text[i]`` to ``per_text[i + 1]``. ``ids`` number the distinct words of
    the column, which ``vocabulary`` holds (exact, by Arrow's dictionary encoding).
    """

    def __init__(self, column: pa.Array, is_word: np.ndarray = NON_SPACE, fold: bool = False):
        raw, offsets = flat(column)
        if fold:
            raw = _FOLD[raw]
        inside = is_word[raw]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < len(raw)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.raw, self.offsets = raw, offsets
        self.begin = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.per_text = np.searchsorted(self.begin, offsets)
        self._inside = inside
        self._ids = self._vocabulary = None

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.per_text)

    @property
    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.per_text) - 1), self.counts)

    def as_array(self) -> pa.Array:
        return binary_array(self.raw[self._inside], np.concatenate([[0], np.cumsum(self.end - self.begin)]))

    def _encode(self) -> None:
        coded = self.as_array().dictionary_encode()
        self._ids, self._vocabulary = coded.indices.to_numpy(), coded.dictionary

    @property
    def ids(self) -> np.ndarray:
        if self._ids is None:
            self._encode()
        return self._ids

    @property
    def vocabulary(self) -> pa.Array:
        if self._vocabulary is None:
            self._encode()
        return self._vocabulary


def spaced(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """The words with a space after each, and the n + 1 places where they start."""
    raw, offsets = flat(words)
    out = np.full(len(raw) + len(words), 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(len(words)), np.diff(offsets))] = raw
    return out.tobytes(), offsets + np.arange(len(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each (non-null) byte string, the same in every task."""
    raw, offsets = flat(words)
    length = np.diff(offsets)
    out = np.zeros(len(length), np.uint64)
    if len(raw):
        power = np.full(int(length.max()), _BASE)
        power[0] = 1
        power = np.multiply.accumulate(power)
        place = np.arange(len(raw)) - np.repeat(offsets[:-1], length)
        some = length > 0
        out[some] = np.add.reduceat(_BYTE[raw] * power[place], offsets[:-1][some])
    return mix(out + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours; len(x) - width + 1 values."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
