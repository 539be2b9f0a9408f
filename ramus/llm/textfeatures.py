"""Hashed sparse features of whole texts, for the classifiers. Inputs: the text alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ramus.llm.arrowtext import LOWER_ALNUM, Words, binary_array, hashes

# Character classes of word shapes: 1 lower, 2 upper, 3 digit, 4 beyond ASCII; punctuation stays itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B], _SHAPE[0x41:0x5B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = 1, 2, 3, 4


def slots(hashed: np.ndarray, size: int) -> np.ndarray:
    return (hashed % np.uint64(size)).astype(np.int64)


def _csr(text: np.ndarray, slot: np.ndarray, weight: np.ndarray, texts: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summed weights of each (text, slot): text bounds, slots, weights."""
    key = text * size + slot
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(weight, head) if len(head) else weight
    return np.searchsorted(key[head] // size, np.arange(texts + 1)), key[head] % size, total


def lexical(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with A-Z lowered, letters and digits only: text bounds, slots, counts."""
    words = Words(column, LOWER_ALNUM, fold=True)
    if not len(words):
        return np.zeros(len(column) + 1, np.int64), np.empty(0, np.int64), np.empty(0)
    slot = slots(hashes(words.vocabulary), size)[words.ids]
    return _csr(words.text_of, slot, np.ones(len(words)), len(column), size)


def stylistic(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word shapes, words, and how much a text repeats itself; weights are shares of the text.

    Slots: hashes of (kind, value). Shapes squeeze runs of one class, so that
    "Abc," and "Abcdef," agree; repetition enters as the share of words that were
    seen before and of words equal to the one before, in steps of a tenth.
    """
    words = Words(column)
    n, texts = len(words), len(column)
    if not n:
        return np.zeros(texts + 1, np.int64), np.empty(0, np.int64), np.empty(0)
    flat_bytes = words.as_array()
    offsets = np.frombuffer(flat_bytes.buffers()[1], np.int64)
    shape = _SHAPE[np.frombuffer(flat_bytes.buffers()[2], np.uint8)]
    new = np.ones(len(shape), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[offsets[:-1]] = True
    squeezed = binary_array(shape[new], np.concatenate([[0], np.cumsum(new)])[offsets]).dictionary_encode()
    seed = np.uint64(0x51ED270B)
    by_shape = slots(hashes(squeezed.dictionary) + seed, size)[squeezed.indices.to_numpy()]
    by_word = slots(hashes(words.vocabulary), size)[words.ids]
    text, counts = words.text_of, np.maximum(words.counts, 1)
    share = 1.0 / counts[text]
    # Repetition.
    pair = text * (int(words.ids.max()) + 1) + words.ids
    distinct = np.bincount(np.unique(pair) // (int(words.ids.max()) + 1), minlength=texts)
    again = 1 - distinct / counts
    same = np.zeros(n, bool)
    same[1:] = (words.ids[1:] == words.ids[:-1]) & (text[1:] == text[:-1])
    stutter = np.bincount(text, same, texts) / counts
    # A short text repeats less: what is expected grows with the logarithm of its length.
    some = words.counts > 0
    rows = np.flatnonzero(some)
    steps = np.concatenate([np.minimum((again[some] * 10).astype(int), 9), 10 + np.minimum((stutter[some] * 10).astype(int), 9), 20 + np.minimum(np.log2(counts[some]).astype(int), 19)])
    marks = slots(hashes(pa.array([b"repeat %d" % i for i in range(40)], pa.large_binary())), size)
    all_text = np.concatenate([text, text, rows, rows, rows])
    all_slot = np.concatenate([by_shape, by_word, marks[steps]])
    weight = np.concatenate([share, 0.3 * share, np.full(2 * len(rows), 0.5), np.full(len(rows), 0.1)])
    return _csr(all_text, all_slot, weight, texts, size)


