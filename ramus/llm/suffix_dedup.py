"""Byte-level dedup by run-length indexes of the passages that a corpus repeats.

A window is ``window`` consecutive bytes of one text, and its minimiser the least hash of
the ``gram``-byte strings in it. Equal windows have equal minimisers, so a window can
only be repeated if its minimiser is. Four steps, each dealt by a hash:

1. Texts are dealt into parts. A part sends each of its minimisers (48 bits) once to the
   minimiser's bucket, which answers the parts that hold a repeated one.
2. Parts send the strings of neighbouring windows that share a repeated minimiser to its
   bucket; the same string of a later place in the part has its verdict at once.
3. A bucket indexes the earliest string of each minimiser by a run-compressed
   Burrows-Wheeler transform with text places sampled at the ends of its runs, streams all
   its different strings through the index from their last byte to their first, and so has their
   matching statistics. Strings that the index doesn't cover are indexed in turn, all at
   once, and streamed again. Matches of ``window`` bytes are marked with the class of
   the matched place, and a class's earliest place is not removed.
4. Parts cut the marked bytes.

Repetitive corpora: what is sorted are the earliest strings and the different ones, once
each; copies are streamed or merged. What is sent grows with the repeated share of
the text, not with the number of copies in a part. Parts and buckets have bounded sizes
whatever the corpus; a long text is worked on in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramus.llm.arrowtext import _BYTE, binary_array, flat, ints, mix, sliding_min
from ramus.llm.shared import Safe, row_keys, without
from ramus.llm.substring_dedup import _pack, _unpack

#: Text of a part, window starts worked on at once, text whose repeated strings fall in one bucket.
PART_BYTES, BLOCK, BUCKET_BYTES = 8 << 20, 2 << 20, 8 << 20
#: Minimisers of one bucket, and windows of one string at most (a run of one byte has one minimiser all along).
BUCKET_GRAMS, STRING_WINDOWS = 4 << 20, 1024
#: Strings of a bucket that are indexed at once; one minimiser's stay together.
BATCH_BYTES = 2 << 20
LOW = np.uint64((1 << 48) - 1)
_ODD = 0xD6E8FEB86659FD93
_KEYS = ["key", "uid", "sum"]


def grams(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place, by prefix sums modulo 2^64."""
    n = len(raw)
    power, inverse = np.full(n, np.uint64(_ODD)), np.full(n, np.uint64(pow(_ODD, -1, 1 << 64)))
    power[0] = inverse[0] = 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * np.multiply.accumulate(power), out=total[1:])
    return mix((total[size:] - total[:-size]) * np.multiply.accumulate(inverse)[: n - size + 1])


def super_kmers(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First byte, number of bytes and minimiser of the strings of neighbouring windows with one minimiser, block by block;
    and whether the minimiser may stand in the string more than once, as in texts with a period."""
    n = len(raw) - window + 1
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        hashed, span = grams(raw[a : b + window - 1], gram), window - gram + 1
        least = sliding_min(hashed, span)
        # Places that are some window's minimum, and those of them that repeat the one before.
        padded = np.zeros(len(least) + 2 * (span - 1), np.uint64)
        padded[span - 1 : span - 1 + len(least)] = least
        minimal = np.flatnonzero(~sliding_min(~padded, span) == hashed)
        twice = np.zeros(len(hashed) + 1, np.int64)
        twice[minimal[1:][(hashed[minimal[1:]] == hashed[minimal[:-1]]) & (np.diff(minimal) <= span)] + 1] = 1
        twice = np.cumsum(twice)
        text = np.searchsorted(offsets, np.array([a, b - 1]), side="right") - 1
        whole = np.ones(b - a, bool)
        for end in offsets[text[0] + 1 : text[1] + 2].tolist():
            whole[max(end - window + 1 - a, 0) : max(end - a, 0)] = False
        new = np.ones(b - a, bool)
        new[1:] = (least[1:] != least[:-1]) | ~whole[:-1]
        place = np.arange(b - a)
        new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % STRING_WINDOWS == 0
        first = np.flatnonzero(new & whole)
        if len(first):
            group = np.cumsum(new & whole)[whole] - 1
            count = np.bincount(group, minlength=len(first))
            yield a + first, count + window - 1, least[first], twice[first + count + span - 1] > twice[first]


class Index:
    """Run-length Burrows-Wheeler index of strings.

    Rows are the sorted suffixes of all strings, each with its end, ends in the order of the
    strings. Of the transform only runs are kept: symbol, first row and the row that its
    first row is mapped to, and the text places of each run's first and last row.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int):
        m, n = len(offsets) - 1, len(raw)
        length = np.diff(offsets)
        # Symbols: 0 is an end, bytes count from 1.
        self.text = np.zeros(n + m + window, np.int16)
        string = np.repeat(np.arange(m), length)
        self.text[np.arange(n) + string] = raw.astype(np.int16) + 1
        self.begin = offsets[:-1] + np.arange(m)
        ends = offsets[1:] + np.arange(m)
        end_of = np.repeat(ends, length + 1)
        size = n + m
        rows, self.least = self._sorted(size, ends, end_of, window)
        before = np.zeros(size, np.int16)
        inside = np.ones(size, bool)
        inside[self.begin] = False
        before[inside] = self.text[np.flatnonzero(inside) - 1]
        self._compress(before[rows], rows)

    def _sorted(self, size: int, ends: np.ndarray, end_of: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The places in suffix order by prefix doubling, and of each place with a whole window the least place with that window."""
        key, depth = np.zeros(size, np.int64), 7
        for k in range(depth):
            # Nothing of the next string: ends are 0, and what follows an end is 0 too.
            at = np.minimum(np.arange(size) + k, end_of)
            key = key * 257 + self.text[at]
        key[ends] = np.arange(len(ends)) - len(ends)
        order = np.argsort(key, kind="stable")
        rank = self._ranks(order, key[order])
        least = np.arange(size)
        done = False
        while True:
            if not done and 2 * depth > window:
                least, done = self._classes(rank, end_of, depth, window), True
            # Only places that still tie are sorted again.
            sorted_rank = rank[order]
            tied = np.zeros(size, bool)
            same = sorted_rank[1:] == sorted_rank[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            slot = np.flatnonzero(tied)
            if not len(slot):
                break
            at = order[slot]
            far = rank[np.minimum(at + depth, end_of[at])]
            by = np.lexsort((far, rank[at]))
            at, far = at[by], far[by]
            own = rank[at]
            order[slot] = at
            head = np.ones(len(at), bool)
            head[1:] = (own[1:] != own[:-1]) | (far[1:] != far[:-1])
            # A rank is the first slot of its ties.
            rank = rank.copy()
            rank[at] = slot[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
            depth *= 2
        return order, least

    @staticmethod
    def _ranks(order: np.ndarray, key: np.ndarray) -> np.ndarray:
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
        return rank

    @staticmethod
    def _classes(rank: np.ndarray, end_of: np.ndarray, depth: int, window: int) -> np.ndarray:
        """``depth`` bytes are ranked; two such ranks that overlap tell windows apart."""
        least = np.arange(len(rank))
        place = np.flatnonzero(np.arange(len(rank)) + window <= end_of)
        if not len(place):
            return least
        counted = np.bincount(rank, minlength=len(rank))
        place = place[counted[rank[place]] > 1]
        own = rank[place] * len(rank) + rank[place + (window - depth)]
        by = np.argsort(own, kind="stable")
        head = np.flatnonzero(np.diff(own[by], prepend=-1))
        # Stable: the first of each class is its least place.
        least[place[by]] = np.repeat(place[by][head], np.diff(np.append(head, len(by))))
        return least

    def _compress(self, last: np.ndarray, rows: np.ndarray) -> None:
        start = np.flatnonzero(np.diff(last, prepend=-1))
        self.start, self.symbol = start, last[start].astype(np.int64)
        size = np.diff(np.append(start, len(last)))
        of_symbol = np.bincount(last, minlength=257)
        below = np.concatenate([[0], np.cumsum(of_symbol)[:-1]])
        # Rows of one symbol keep their order when they are mapped.
        by = np.argsort(self.symbol, kind="stable")
        upto = np.cumsum(size[by]) - size[by]
        self.mapped = np.empty(len(start), np.int64)
        self.mapped[by] = upto - (np.cumsum(of_symbol) - of_symbol)[self.symbol[by]] + below[self.symbol[by]]
        self.first, self.last, self.size = rows[start], rows[start + size - 1], size
        # Runs in the order of (symbol, run), to find a symbol's next run.
        self.by_symbol, self.keys = by, self.symbol[by] * len(start) + by

    def agreeing(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from places a and b agree, up to ``most``; ends agree with nothing."""
        out = np.zeros(len(a), np.int64)
        open_ = np.flatnonzero(most > 0)
        step = np.arange(16)
        while len(open_):
            x = np.minimum(a[open_, None] + out[open_, None] + step, len(self.text) - 1)
            y = np.minimum(b[open_, None] + out[open_, None] + step, len(self.text) - 1)
            same = (self.text[x] == self.text[y]) & (self.text[x] > 0)
            run = np.where(same.all(1), 16, same.argmin(1))
            out[open_] += run
            open_ = open_[(run == 16) & (out[open_] < most[open_])]
        return np.minimum(out, most)

    def stream(self, raw: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
        """For each byte of the strings the least place in the index where the window from it stands, or -1.

        All strings go at once, byte by byte from their ends. A row stands for the
        longest match; a symbol that isn't its run's leads to the nearest run of that symbol
        above or below, whichever agrees longer, and the sampled place there. Lengths are
        counted up to ``window``.
        """
        length = np.diff(offsets)
        found = np.full(len(raw), -1)
        by = np.argsort(-length, kind="stable")
        length, end = length[by], offsets[1:][by]
        n = len(by)
        row, place, have = np.zeros(n, np.int64), np.full(n, self.first[0]), np.zeros(n, np.int64)
        # With the longest first, those that have bytes left are a prefix.
        longer = np.searchsorted(-length, -np.arange(1, (length[0] if n else 0) + 1), side="right")
        n_runs = len(self.start)
        for step, active in enumerate(longer.tolist()):
            at = end[:active] - 1 - step
            c = raw[at].astype(np.int64) + 1
            k = np.searchsorted(self.start, row[:active], side="right") - 1
            fits = self.symbol[k] == c
            own = row[:active]
            within = own - self.start[k]
            off = np.flatnonzero(~fits)
            place[:active] -= 1
            have[:active] += 1
            if len(off):
                want = c[off]
                next_ = np.searchsorted(self.keys, want * n_runs + k[off])
                below, above = np.minimum(next_, n_runs - 1), np.maximum(next_ - 1, 0)
                run_b, run_a = self.by_symbol[below], self.by_symbol[above]
                has_b = (next_ < n_runs) & (self.symbol[run_b] == want)
                has_a = (next_ > 0) & (self.symbol[run_a] == want)
                here, most = place[off] + 1, have[off] - 1
                fit_b = np.where(has_b, self.agreeing(here, self.first[run_b], np.where(has_b, most, 0)), -1)
                fit_a = np.where(has_a, self.agreeing(here, self.last[run_a], np.where(has_a, most, 0)), -1)
                up = fit_a > fit_b
                k[off] = np.where(up, run_a, run_b)
                within[off] = np.where(up, self.size[run_a] - 1, 0)
                none = ~has_a & ~has_b
                place[off] = np.where(up, self.last[run_a], self.first[run_b]) - 1
                have[off] = np.maximum(fit_a, fit_b) + 1
                if none.any():
                    # The symbol occurs nowhere: start anew at any row.
                    lost = off[none]
                    k[lost], within[lost], have[lost] = 0, 0, 0
                    place[lost] = self.first[0]
            row[:active] = self.mapped[k] + within
            if len(off) and none.any():
                row[lost] = 0
            np.minimum(have[:active], window, out=have[:active])
            long = np.flatnonzero(have[:active] == window)
            found[at[long]] = self.least[place[long]]
        return found


def marked(key: np.ndarray, ident: np.ndarray, start: np.ndarray, raw: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrence, first and end byte in it of the runs of windows that stand earlier, among a bucket's strings.

    An occurrence is a string of row ``ident`` with id ``key`` from byte ``start`` on. A window is
    late if a row with a smaller key has it, or its own row at a smaller place.
    """
    coded = binary_array(raw, offsets).dictionary_encode()
    text, (raw, offsets) = coded.indices.to_numpy().astype(np.int64), flat(coded.dictionary)
    length = np.diff(offsets)
    # Whole strings that stand earlier: later keys, and later places of the row that is first in order.
    by = np.lexsort((start, ident, key, text))
    head = np.flatnonzero(np.diff(text[by], prepend=-1))
    counts = np.diff(np.append(head, len(by)))
    earliest = np.empty(len(length), np.int64)
    earliest[text[by][head]] = key[by][head]
    again = np.zeros(len(by), bool)
    again[1:] = (text[by][1:] == text[by][:-1]) & (key[by][1:] == key[by][:-1]) & (ident[by][1:] == ident[by][:-1])
    late = np.zeros(len(by), bool)
    late[by] = (key[by] > np.repeat(key[by][head], counts)) | again & (start[by] > np.concatenate([[0], start[by][:-1]]))
    same_place = np.zeros(len(by), bool)
    same_place[by] = again & ~late[by]
    out = [(np.flatnonzero(late), np.zeros(late.sum(), np.int64), length[text[late]])]
    rest = np.flatnonzero(~late & ~same_place)
    # Strings by minimiser; of strings with one minimiser that no other string has, nothing is left to find.
    least, many = _minimisers(raw, offsets, gram)
    group = pd.factorize(least)[0]
    chosen = np.flatnonzero((np.bincount(group)[group] > 1) | many)
    order = chosen[np.lexsort((chosen, earliest[chosen], group[chosen]))]
    # Equal windows have equal minimisers, so groups are indexed apart, some at a time.
    lead = np.ones(len(order), bool)
    lead[1:] = group[order][1:] != group[order][:-1]
    heads = np.flatnonzero(lead)
    batch = np.cumsum(length[order])[np.append(heads[1:], len(order)) - 1] // BATCH_BYTES if len(order) else heads
    cuts = heads[np.flatnonzero(np.diff(batch, prepend=-1))].tolist()
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        out.append(_late_windows(key, ident, start, text, rest, raw, offsets, order[a:b], lead[a:b], window))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def _minimisers(raw: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each string's grams, and whether it stands there more than once; some strings at a time."""
    least, many = [], []
    cuts = np.searchsorted(offsets, np.arange(0, offsets[-1], BATCH_BYTES))
    for a, b in zip(cuts, [*cuts[1:], len(offsets) - 1]):
        if a == b:
            continue
        own = offsets[a : b + 1] - offsets[a]
        hashed = grams(raw[offsets[a] : offsets[b]], gram)
        for k in range(1, gram):
            hashed[(own[1:] - k)[own[1:] - k < len(hashed)]] = 0xFFFFFFFFFFFFFFFF
        low = np.minimum.reduceat(hashed, own[:-1])
        least.append(low)
        many.append(np.add.reduceat((hashed == np.repeat(low, np.diff(own))[: len(hashed)]).astype(np.int64), own[:-1]) > 1)
    return (np.concatenate(least), np.concatenate(many)) if least else (np.empty(0, np.uint64), np.empty(0, bool))


def _late_windows(key: np.ndarray, ident: np.ndarray, start: np.ndarray, text: np.ndarray, rest: np.ndarray, raw: np.ndarray, offsets: np.ndarray, order: np.ndarray, lead: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of late windows among the occurrences ``rest`` of the strings ``order``, of which ``lead`` are indexed first."""
    sub_raw, sub_offsets = _picked(raw, offsets, order)
    index = Index(*_picked(raw, offsets, order[lead]), window)
    classes = index.stream(sub_raw, sub_offsets, window)
    missed = _window_starts(sub_offsets, window) & (classes < 0)
    if missed.any():
        novel = np.flatnonzero(np.add.reduceat(missed.astype(np.int64), sub_offsets[:-1]) > 0)
        more_raw, more_offsets = _picked(sub_raw, sub_offsets, novel)
        second = Index(more_raw, more_offsets, window).stream(more_raw, more_offsets, window)
        at = np.repeat(sub_offsets[novel] - more_offsets[:-1], np.diff(more_offsets)) + np.arange(len(more_raw))
        fill = missed[at]
        classes[at[fill]] = second[fill] + len(index.text)
    # Windows of each occurrence of these strings.
    of = np.full(len(offsets) - 1, -1)
    of[order] = np.arange(len(order))
    occ = rest[of[text[rest]] >= 0]
    s = of[text[occ]]
    n = np.diff(sub_offsets)[s] - window + 1
    owner = np.repeat(np.arange(len(occ)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    label = classes[sub_offsets[s][owner] + offset]
    where = start[occ][owner] + offset
    k, i = key[occ][owner], ident[occ][owner]
    by = np.lexsort((where, i, k, label))
    label, where, k, i = label[by], where[by], k[by], i[by]
    head = np.flatnonzero(np.diff(label, prepend=-1))
    later = k > np.repeat(k[head], np.diff(np.append(head, len(by))))
    own = np.zeros(len(by), bool)
    own[1:] = (label[1:] == label[:-1]) & (k[1:] == k[:-1]) & (i[1:] == i[:-1])
    # The first place of a row in a class: what follows at a larger place is late.
    later |= where > where[np.maximum.accumulate(np.where(own, 0, np.arange(len(by))))]
    flag = np.zeros(len(by), bool)
    flag[by] = later
    at = np.flatnonzero(flag)
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (owner[at][1:] != owner[at][:-1])
    a, b = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return occ[owner[a]], offset[a], offset[b] + window


def _window_starts(offsets: np.ndarray, window: int) -> np.ndarray:
    starts = np.ones(offsets[-1], bool)
    for k in range(1, window):
        starts[offsets[1:] - k] = False
    return starts


def _picked(raw: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat(binary_array(raw, offsets).take(pa.array(which)))


def _rows(columns: dict[str, pa.DataType], values: list) -> pa.Table:
    return pa.table([pa.array(v, t) for v, t in zip(values, columns.values())], names=list(columns))


_TO_BUCKET = {"bucket": pa.int64(), "part": pa.int64(), "data": pa.binary()}


def _send_grams(part: pa.Table, window: int, gram: int, buckets: int) -> pa.Table:
    """A part's different minimisers for each bucket, with those that it has more than once."""
    raw, offsets = flat(part.column("text").combine_chunks())
    found = [np.concatenate([least, least[twice]]) for _, _, least, twice in super_kmers(raw, offsets, window, gram)]
    if not found:
        return _rows(_TO_BUCKET, [[], [], []])
    hashed, counts = np.unique(np.concatenate(found), return_counts=True)
    bucket = (mix(hashed) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    hashed, counts, bucket = hashed[by], counts[by], bucket[by]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    own = part.column("part")[0].as_py()
    data = [_pack([(hashed[a:b] & LOW).astype(np.int64), (counts[a:b] > 1).astype(np.int64)]) for a, b in zip(cut, [*cut[1:], len(bucket)])]
    return _rows(_TO_BUCKET, [bucket[cut], [own] * len(cut), data])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    now, parts, held = None, [], []
    for batch in batches:
        for bucket, part, data in zip(batch.column("bucket").to_pylist(), batch.column("part").to_pylist(), batch.column("data")):
            if bucket != now and held:
                yield now, parts, held
                parts, held = [], []
            now = bucket
            parts.append(part)
            held.append(data.as_py())
    if held:
        yield now, parts, held


def _answer_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each part its minimisers that occur more than once."""
    for _, parts, held in _by_bucket(batches):
        got = [_unpack(d, 2)[0] for d in held]
        hashed, twice = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        number = pd.factorize(hashed)[0]
        often = np.bincount(number, 1 + twice)[number] > 1
        ends = np.cumsum([len(g[0]) for g in got])[:-1]
        own = [(p, x[f]) for p, x, f in zip(parts, np.split(hashed, ends), np.split(often, ends)) if f.any()]
        for i in range(0, len(own), 256):
            some = own[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int64()), pa.array([_pack([x]) for _, x in some], pa.binary())], ["part", "data"])


def _send_strings(part: pa.Table, often: pa.Table, window: int, gram: int, buckets: int) -> pa.Table:
    """A part's strings with repeated minimisers for each bucket; those that the part itself has earlier go as verdicts (bucket < 0)."""
    if not part.num_rows or not often.num_rows:
        return _rows(_TO_BUCKET, [[], [], []])
    own = part.column("part")[0].as_py()
    known = np.unique(np.concatenate([_unpack(d.as_py(), 1)[0][0] for d in often.column("data")]))
    raw, offsets = flat(part.column("text").combine_chunks())
    first, length, least = [], [], []
    for a, n, m, _ in super_kmers(raw, offsets, window, gram):
        low = (m & LOW).astype(np.int64)
        kept = known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low
        first.append(a[kept])
        length.append(n[kept])
        least.append(m[kept])
    if not first or not sum(map(len, first)):
        return _rows(_TO_BUCKET, [[], [], []])
    first, length, least = np.concatenate(first), np.concatenate(length), np.concatenate(least)
    text = np.searchsorted(offsets, first, side="right") - 1
    keys = [ints(part.column(c).combine_chunks())[text] for c in _KEYS]
    start = first - offsets[text]
    # Bytes of the strings, gathered once.
    at = np.concatenate([[0], np.cumsum(length)])
    bytes_ = raw[np.repeat(first - at[:-1], length) + np.arange(at[-1])]
    same = binary_array(bytes_, at).dictionary_encode().indices.to_numpy()
    by = np.lexsort((start, keys[2], keys[1], keys[0], same))
    head = np.flatnonzero(np.diff(same[by], prepend=-1))
    k = keys[0][by]
    late = k > np.repeat(k[head], np.diff(np.append(head, len(by))))
    equal = np.zeros(len(by), bool)
    equal[1:] = (same[by][1:] == same[by][:-1]) & (k[1:] == k[:-1]) & (keys[1][by][1:] == keys[1][by][:-1]) & (keys[2][by][1:] == keys[2][by][:-1])
    later = equal & (start[by] > np.concatenate([[0], start[by][:-1]]))
    # A run of places of one row: its first isn't late; a repeated row's same place is sent once.
    done, drop = np.zeros(len(by), bool), np.zeros(len(by), bool)
    done[by], drop[by] = late | later, equal & ~later
    begin = np.maximum.accumulate(np.where(equal, 0, np.arange(len(by))))
    done[by] |= equal & (start[by] > start[by][begin])
    out = [[], [], []]

    def send(bucket: int, which: np.ndarray, tail: bytes = b"") -> None:
        out[0].append(bucket)
        out[1].append(own)
        out[2].append(_pack([*(x[which] for x in keys), start[which], length[which]], tail))

    if done.any():
        send(-1 - own, np.flatnonzero(done))
    bucket = (mix(least) % np.uint64(buckets)).astype(np.int64)
    left = np.flatnonzero(~done & ~drop)
    left = left[np.lexsort((least[left], bucket[left]))]
    strings = memoryview(np.ascontiguousarray(bytes_))
    cut = np.flatnonzero(np.diff(bucket[left], prepend=-1)).tolist()
    for a, b in zip(cut, [*cut[1:], len(left)]):
        which = left[a:b]
        send(int(bucket[which[0]]), which, b"".join(strings[at[i] : at[i + 1]] for i in which.tolist()))
    return _rows(_TO_BUCKET, out)


_SPANS = "part long, key long, uid long, sum long, first long, end long"


def _mark_strings(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SPANS.split(", ")]

    def out(values: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names)

    for bucket, parts, held in _by_bucket(batches):
        if bucket < 0:
            for part, data in zip(parts, held):
                key, uid, sum_, start, length = _unpack(data, 5)[0]
                yield out([np.full(len(key), part), key, uid, sum_, start, start + length])
            continue
        got = [_unpack(d, 5) for d in held]
        key, uid, sum_, start, length = (np.concatenate([g[0][j] for g in got]) for j in range(5))
        part = np.repeat(parts, [len(g[0][0]) for g in got])
        raw = np.frombuffer(b"".join(g[1] for g in got), np.uint8)
        del got
        ident = pd.MultiIndex.from_arrays([key, uid, sum_]).factorize()[0] if uid.any() or sum_.any() else pd.factorize(key)[0]
        which, first, end = marked(key, ident, start, raw, np.concatenate([[0], np.cumsum(length)]), window, gram)
        yield out([part[which], key[which], uid[which], sum_[which], start[which] + first, start[which] + end])


def _cut(part: pa.Table, spans: pa.Table, schema: pa.Schema) -> pa.Table:
    raw, offsets = flat(part.column("text").combine_chunks())
    gone = np.zeros(len(raw) + 1, np.int64)
    if spans.num_rows and part.num_rows:
        rows = pd.DataFrame({c: ints(part.column(c).combine_chunks()) for c in _KEYS} | {"base": offsets[:-1]})
        found = pd.DataFrame({c: ints(spans.column(c).combine_chunks()) for c in [*_KEYS, "first", "end"]}).merge(rows, on=_KEYS)
        np.add.at(gone, (found["base"] + found["first"]).to_numpy(), 1)
        np.add.at(gone, (found["base"] + found["end"]).to_numpy(), -1)
    gone = np.cumsum(gone)[:-1] > 0
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
    # Runs end with their text.
    edge = np.zeros(len(raw), bool)
    edge[1:] = gone[:-1]
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = False
    begin = np.flatnonzero(gone & ~edge)
    edge = np.zeros(len(raw), bool)
    edge[:-1] = gone[1:]
    edge[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(gone & ~edge) + 1
    n_spans = np.diff(np.searchsorted(begin, offsets))
    text = np.repeat(np.arange(part.num_rows), n_spans)
    pairs = pa.StructArray.from_arrays([pa.array(begin - offsets[text], pa.int64()), pa.array(end - offsets[text], pa.int64())], ["first", "end"])
    left = raw[~gone]
    at = offsets - np.concatenate([[0], np.cumsum(removed)])
    kept = memoryview(np.ascontiguousarray(left))
    digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    columns = [part.column("rec").combine_chunks(), pa.array(np.diff(offsets)), pa.array(removed), pa.array(n_spans), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]), pa.int32()), pairs), binary_array(left, at).cast(pa.binary()), pa.array(digests, pa.string())]
    return pa.Table.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, schema)], schema=schema)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, gram: int = 32, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: rec (struct of ``keep``, by default all columns but the text), n_bytes, n_removed,
    n_spans, spans (first and end byte of the removed runs), kept (the bytes left), kept_sha256.

    A byte goes if it is in a string of ``window`` bytes that also starts in a row with a
    smaller id, or earlier in its own text; such strings may overlap. Null and empty texts
    have no bytes; texts shorter than the window stay whole. Rows with the same id don't
    remove each other's bytes, repeated rows get the same result; a null id counts as
    larger than all others and as equal to other null ids. An empty table gives no rows.
    Columns may have any names. ``kept`` needn't be valid UTF-8, since bytes are cut.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if not 7 <= gram < window or window < 14:
        raise ValueError("7 <= gram < window and 14 <= window")
    t = Safe(docs, without(docs, text_col) if keep is None else keep)
    text = F.coalesce(t.col(text_col).cast("string"), F.lit(""))
    size = t.rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts, buckets = max(8, size // PART_BYTES), max(64, size // BUCKET_BYTES)
    gram_buckets = max(64, size // 32 // BUCKET_GRAMS)
    part = F.pmod(F.xxhash64(*_KEYS), F.lit(parts)).alias("part")
    # Dealt once; the three steps that take whole parts read one exchange.
    dealt = t.rows.select(*row_keys(t.rows, t.col(id_col), text), text.alias("text"), t.rec).select(part, *_KEYS, "text", "rec").groupBy("part")
    to_bucket = "bucket long, part long, data binary"
    in_order = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    asked = dealt.applyInArrow(lambda p: _send_grams(p, window, gram, gram_buckets), to_bucket)
    often = in_order(asked).mapInArrow(_answer_grams, "part long, data binary")
    sent = dealt.cogroup(often.groupBy("part")).applyInArrow(lambda p, o: _send_strings(p, o, window, gram, buckets), to_bucket)
    spans = in_order(sent).mapInArrow(lambda b: _mark_strings(b, window, gram), _SPANS)
    schema = t.schema("n_bytes long, n_removed long, n_spans long, spans array<struct<first:long,end:long>>, kept binary, kept_sha256 string")
    arrow = to_arrow_schema(schema)
    return t.out(dealt.cogroup(spans.groupBy("part")).applyInArrow(lambda p, s: _cut(p, s, arrow), schema))
