"""Substring dedup by super-k-mers of words.

A window is ``window`` consecutive words of one text. Each window has a
minimiser: the smallest hash of the ``minimiser``-word grams in it. Consecutive
windows with one minimiser travel as one packed string (a super-k-mer) to the
minimiser's bucket, so that each word is sent about three times and not once for
each window. Equal windows have equal minimisers and so meet in one bucket, where
sorting counts them exactly, on the words themselves.

Skew: a task drops a super-k-mer of a later document when it has seen the same
string in an earlier one (its verdict is known without the bucket), so a passage
that a third of all documents hold sends one string for each chunk of input, not
one for each document. Only intervals of word places return to the documents. Grams
that would draw more than ``SHARE`` of all windows come last in the order of minimisers,
so that rarer grams deal their windows to other buckets; a window of frequent grams
alone goes by a hash of all its words. Grams are counted over all texts, in slots by a
part of their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramus.llm.arrowtext import Words, chunks, hashes, ints, mix, sliding_min, spaced
from ramus.llm.shared import LAST, Safe, row_keys, without

#: Text in a task's chunk, and packed super-k-mers aimed at in one bucket.
MAP_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
#: Grams are counted in slots by 16 bits of their hash; those of a slot with this share of all windows, some seven
#: times a slot's mean, count as frequent.
SLOTS, PARTS, SHARE = 1 << 16, 8, 1e-4


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram & np.uint64(SLOTS - 1)).astype(np.int64)


def _pack(arrays: list[np.ndarray], tail: bytes = b"") -> bytes:
    """int64 arrays of one length by byte planes, which compress well, and a tail."""
    n = len(arrays[0])
    planes = [np.ascontiguousarray(np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(n, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=6).compress(b"".join([np.int64(n).tobytes(), *planes, tail]))


def _unpack(data: bytes, count: int) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    planes = (np.frombuffer(data, np.uint8, 8 * n, 8 + 8 * n * i).reshape(8, n) for i in range(count))
    return [np.ascontiguousarray(p.T).view("<i8").reshape(n) for p in planes], data[8 + 8 * n * count :]


def super_kmers(words: Words, window: int, minimiser: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and minimiser of each super-k-mer: 63 bits of a hash, and the highest bit for those in ``frequent`` slots."""
    n = len(words)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    word = hashes(words.vocabulary)[words.ids]
    gram = word[: n - minimiser + 1].copy()
    for i in range(1, minimiser):
        gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + word[i : n - minimiser + 1 + i])
    gram >>= np.uint64(1)
    if frequent is not None:
        gram[frequent[_slot(gram)]] |= np.uint64(1 << 63)
    least = sliding_min(gram, window - minimiser + 1)
    text = words.text_of
    whole = text[: n - window + 1] == text[window - 1 :]
    # Windows of frequent grams only go by a hash of all their words.
    at = np.flatnonzero(whole & (least >> np.uint64(63) == 1))
    if len(at):
        every = word[at]
        for i in range(1, window):
            every = mix(every * np.uint64(0x9E3779B97F4A7C15) + word[at + i])
        least[at] = every | np.uint64(1 << 63)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1 : n - window + 1] != text[: n - window])
    first = np.flatnonzero(new & whole)
    group = np.cumsum(new & whole)[whole] - 1
    return first, np.bincount(group, minlength=len(first)) + window - 1, least[first]


def _drawn(batches: Iterator[pa.RecordBatch], window: int, minimiser: int) -> Iterator[pa.RecordBatch]:
    """Windows that the grams of each slot draw in a task's texts, in ``PARTS`` rows."""
    n = np.zeros(SLOTS, np.int64)
    for batch in chunks(batches, limit=MAP_BYTES):
        _, length, least = super_kmers(Words(batch.column("text")), window, minimiser)
        n += np.bincount(_slot(least), length - window + 1, SLOTS).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int64()), pa.array([x.tobytes() for x in n.reshape(PARTS, -1)], pa.binary())], ["part", "n"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist()):
            n[part] = n.get(part, 0) + np.frombuffer(data, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array([x.tobytes() for x in n.values()], pa.binary())], ["part", "n"])


def frequent_slots(docs: DataFrame, window: int, minimiser: int, share: float) -> np.ndarray:
    """Which slots of grams draw ``share`` of all windows or more. docs: text."""
    drawn = docs.select("text").mapInArrow(lambda b: _drawn(b, window, minimiser), "part long, n binary")
    n = np.zeros((PARTS, SLOTS // PARTS), np.int64)
    # PARTS rows, whatever the corpus.
    for row in drawn.repartition("part").mapInArrow(_added, "part long, n binary").collect():
        n[row.part] = np.frombuffer(row.n, np.int64)
    return (n.ravel() > 0) & (n.ravel() >= share * n.sum())


def _to_buckets(batches: Iterator[pa.RecordBatch], window: int, minimiser: int, buckets: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=MAP_BYTES):
        words = Words(batch.column("text"))
        first, length, least = super_kmers(words, window, minimiser, frequent)
        if not len(first):
            continue
        text = np.searchsorted(words.per_text, first, side="right") - 1
        order, uid, sum_ = (ints(batch.column(c))[text] for c in ("key", "uid", "sum"))
        start = first - words.per_text[text]
        joined, at = spaced(words.as_array())
        strings = [joined[a : b - 1] for a, b in zip(at[first].tolist(), at[first + length].tolist())]
        same = pa.array(strings, pa.large_binary()).dictionary_encode().indices.to_numpy()
        earliest = np.full(int(same.max()) + 1, LAST)
        np.minimum.at(earliest, same, order)
        known = order > earliest[same]
        rows: list[tuple[int, bytes]] = []
        if known.any():
            rows.append((-1 - int(order[known][0] % 65536), _pack([order[known], uid[known], sum_[known], start[known], (start + length)[known]])))
        bucket = (mix(least) % np.uint64(buckets)).astype(np.int64)
        left = np.flatnonzero(~known)
        left = left[np.lexsort((least[left], bucket[left]))]
        cut = np.flatnonzero(np.diff(bucket[left], prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(left)]):
            own = left[a:b]
            rows.append((int(bucket[own[0]]), _pack([order[own], uid[own], sum_[own], start[own]], b"\n".join([strings[i] for i in own.tolist()]))))
        for i in range(0, len(rows), 512):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 512]], pa.int64()), pa.array([r[1] for r in rows[i : i + 512]], pa.binary())], ["bucket", "data"])


def repeated(parts: list[bytes], window: int) -> list[np.ndarray]:
    """Key, uid, sum, first and end word of the runs of windows that an earlier document has, in one bucket."""
    got = [_unpack(p, 4) for p in parts]
    order, uid, sum_, start = (np.concatenate([g[0][i] for g in got]) for i in range(4))
    words = Words(pa.array([g[1] for g in got], pa.large_binary()))
    # Super-k-mers end at a line feed or at the end of their part.
    stop = np.append(words.raw, 10)[words.end] == 10
    stop[words.per_text[1:] - 1] = True
    entry = np.concatenate([[0], np.cumsum(stop)[:-1]])
    ids, have = words.ids.astype(np.int64), 1
    while have < window:
        step = min(have, window - have)
        ids, have = pd.factorize(ids[:-step] * (int(ids.max()) + 1) + ids[step:])[0].astype(np.int64), have + step
    whole = np.flatnonzero(entry[: len(ids)] == entry[window - 1 :])
    ids, entry = ids[whole], entry[whole]
    place = whole - np.concatenate([[0], np.flatnonzero(stop)[:-1] + 1])[entry]
    by = np.lexsort((order[entry], ids))
    head = np.flatnonzero(np.diff(ids[by], prepend=-1))
    earliest = np.repeat(order[entry][by][head], np.diff(np.append(head, len(by))))
    late = np.zeros(len(ids), bool)
    late[by] = order[entry][by] > earliest
    # Neighbouring late windows of a super-k-mer make one interval.
    at = np.flatnonzero(late)
    if not len(at):
        return [np.empty(0, np.int64)] * 5
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (entry[at][1:] != entry[at][:-1])
    a, b = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    e = entry[a]
    return [order[e], uid[e], sum_[e], start[e] + place[a], start[e] + place[b] + window]


def _in_buckets(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    now, parts = None, []

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["key", "uid", "sum", "first", "end"])

    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
            if bucket < 0:
                yield out(_unpack(data.as_py(), 5)[0])
                continue
            if bucket != now and parts:
                yield out(repeated(parts, window))
                parts = []
            now = bucket
            parts.append(data.as_py())
    if parts:
        yield out(repeated(parts, window))


def repeated_spans(docs: DataFrame, window: int = 13, minimiser: int = 3, share: float = SHARE) -> DataFrame:
    """Word intervals to remove: key, uid, sum, first, end. docs: key, uid, sum, text (see :func:`row_keys`)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, 3 * size // BUCKET_BYTES)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_slots(docs, window, minimiser, share))
    packed = docs.select("key", "uid", "sum", "text").mapInArrow(lambda b: _to_buckets(b, window, minimiser, buckets, frequent.value), "bucket long, data binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _in_buckets(b, window), "key long, uid long, sum long, first long, end long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        words = Words(batch.column("text"))
        gone = np.zeros(len(words) + 1, np.int64)
        spans = batch.column("spans")
        if len(flat := pc.list_flatten(spans)):
            text = pc.list_parent_indices(spans).to_numpy()
            base = words.per_text[text]
            np.add.at(gone, base + flat.field(0).to_numpy(), 1)
            np.add.at(gone, base + flat.field(1).to_numpy(), -1)
        gone = np.cumsum(gone)[:-1] > 0
        kept_per_text = np.concatenate([[0], np.cumsum(~gone)])[words.per_text]
        joined, at = spaced(words.as_array().filter(pa.array(~gone)))
        kept = [joined[a : max(a, b - 1)] for a, b in zip(at[kept_per_text[:-1]].tolist(), at[kept_per_text[1:]].tolist())]
        removed = words.counts - np.diff(kept_per_text)
        yield pa.RecordBatch.from_arrays([
            batch.column("rec"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pc.if_else(pa.array(removed > 0), pa.array(kept, pa.binary()).cast(pa.string()), batch.column("text").cast(pa.string())),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        ], ["rec", "n_words", "n_removed", "kept", "cleaned", "kept_sha256"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, minimiser: int = 3, keep: list[str] | None = None, share: float = SHARE) -> DataFrame:
    """One row per input row: rec (struct of ``keep``, by default all columns but the text), n_words, n_removed, kept (the
    kept words joined by one space), cleaned (the text itself where nothing is removed,
    else kept), kept_sha256.

    A word goes if it is in a window whose word sequence also starts in a row with
    a smaller id. Null and blank texts have no words. Rows with the same id don't
    remove each other's words; a null id counts as larger than all others, and as
    equal to other null ids. Texts shorter than the window stay whole. An empty
    table gives no rows. The input's columns may have any names. Rows with one id are told
    apart by 128 bits of hashes of id and text.
    """
    t = Safe(docs, without(docs, text_col) if keep is None else keep)
    text = F.coalesce(t.col(text_col), F.lit(""))
    keyed = t.rows.select(*row_keys(t.rows, t.col(id_col), text), text.alias("text"), t.rec)
    spans = repeated_spans(keyed, window, minimiser, share).groupBy("key", "uid", "sum").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    joined = keyed.join(spans.hint("shuffle_hash"), ["key", "uid", "sum"], "left").select("rec", "text", F.coalesce("spans", F.array().cast("array<struct<first:long,end:long>>")).alias("spans"))
    return t.out(joined.mapInArrow(_cut, t.schema("n_words long, n_removed long, kept string, cleaned string, kept_sha256 string")))
