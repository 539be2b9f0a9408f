"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their log scores come from a public model file; nothing is trained.
White space becomes the marker U+2581 with one marker before the text. No piece has
a marker after another character, so no piece crosses from a word to a marker, and
the best segmentation of a text is that of its (markers, word) segments one after
the other. The distinct segments of a chunk are segmented together: numpy walks the
double array from all their bytes at once, then the Viterbi step runs over all
segments, one byte at a time. A segment of over LONG bytes (text without spaces) is
walked by itself in windows, in time and memory linear in its length.

Characters that no piece covers become their byte pieces (byte fallback).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramus.llm.arrowtext import binary_array, chunks, flat
from ramus.llm.shared import Safe, without
from ramus.llm.token_files import crc32

MARKER = "▁".encode()
#: Below the least score of a piece, for a character that has none.
UNKNOWN_PENALTY = 10.0
#: Segments are padded to a multiple of CLASS_STEP bytes; those over LONG bytes are done one by one, WINDOW bytes at a time.
CLASS_STEP, LONG, WINDOW = 8, 512, 1 << 16


class DoubleArray:
    """A trie in two arrays: the child of s by byte c is base[s] + c + 1 if check says so. value: the key's number or -1."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 16
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        lowest = 1
        todo = [(0, 0, len(order), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[order[lo]]) == depth:
                value[state] = order[lo]
                while lo < hi and len(keys[order[lo]]) == depth:
                    lo += 1
            if lo == hi:
                base[state] = -1
                continue
            groups: list[tuple[int, int, int]] = []
            for i in range(lo, hi):
                c = keys[order[i]][depth]
                if groups and groups[-1][0] == c:
                    groups[-1] = (c, groups[-1][1], i + 1)
                else:
                    groups.append((c, i, i + 1))
            codes = np.array([g[0] + 1 for g in groups])
            at = max(0, lowest - int(codes[0]))
            while True:
                while at + 512 + 257 >= len(check):
                    more = len(check)
                    base, check, value = np.append(base, np.zeros(more, np.int64)), np.append(check, np.full(more, -1)), np.append(value, np.full(more, -1))
                # The first of 512 places where all the children fit.
                free = (check[np.arange(at, at + 512)[:, None] + codes] < 0).all(axis=1)
                if free.any():
                    at += int(free.argmax())
                    break
                at += 512
            base[state] = at
            check[at + codes] = state
            # Nearly full stretches aren't searched again.
            while check[lowest] >= 0 or (check[lowest : lowest + 512] >= 0).mean() > 0.9:
                lowest += 1
            todo.extend((at + c + 1, a, b, depth + 1) for c, a, b in groups)
        last = int(np.flatnonzero(check >= 0).max()) + 258
        self.base, self.check, self.value = base[:last].astype(np.int32), check[:last].astype(np.int32), value[:last].astype(np.int32)
        self.depth = max(map(len, keys), default=0)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children and which of them exist."""
        base = self.base[state]
        child = np.where(base >= 0, base + byte + 1, 0)
        return child, (base >= 0) & (self.check[child] == state)


@dataclass
class Model:
    pieces: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray  # 0 ordinary, 1 byte, 2 control or unknown
    add_marker: bool = True

    def __post_init__(self):
        ordinary = np.flatnonzero(self.kinds == 0)
        self.trie = DoubleArray([self.pieces[i] for i in ordinary])
        self.ordinary = ordinary.astype(np.int32)
        self.byte_id = np.full(256, -1, np.int32)
        for i in np.flatnonzero(self.kinds == 1):
            self.byte_id[int(self.pieces[i][3:5], 16)] = i
        self.floor = float(self.scores[ordinary].min()) - UNKNOWN_PENALTY
        for p in (self.pieces[i] for i in ordinary):
            if MARKER in p.lstrip(MARKER) if p.strip(MARKER) else False:
                raise ValueError(f"piece {p!r} has a marker after another character")


_models: dict[str, Model] = {}


def load(path: str) -> Model:
    """A model file's pieces and scores, once in a worker."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kinds = np.array([1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in range(n)])
        _models[path] = Model([sp.id_to_piece(i).encode() for i in range(n)], np.array([sp.get_score(i) for i in range(n)]), kinds)
    return _models[path]


def viterbi(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all byte strings, one after the other, and the n + 1 places where each one's start.

    Of two best segmentations the one with the longer last piece wins. Works on
    strings of one length class at a time.
    """
    length = np.diff(offsets)
    n = len(length)
    counts = np.zeros(n, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # string, place from its end, id
    klass = np.where(length > LONG, 0, -(-length // CLASS_STEP))
    for i in np.flatnonzero(length > LONG).tolist():
        ids = viterbi_long(model, raw[offsets[i] : offsets[i + 1]])
        counts[i] = len(ids)
        parts.append((np.full(len(ids), i), np.arange(len(ids))[::-1], ids))
    order = np.argsort(klass, kind="stable")
    bounds = np.flatnonzero(np.diff(klass[order], prepend=-1))
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), n]):
        most = int(klass[order[a]]) * CLASS_STEP
        if not most:
            continue
        most = int(length[order[a:b]].max())
        # Cells of the tables at once: about 4 million.
        for lo in range(a, b, max(1, 4_000_000 // (most * min(most, model.trie.depth) + 1))):
            own = order[lo : min(b, lo + max(1, 4_000_000 // (most * min(most, model.trie.depth) + 1)))]
            string, place, ids = _viterbi_class(model, raw, offsets[own], length[own], most)
            counts[own] = np.bincount(string, minlength=len(own))
            parts.append((own[string], place, ids))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(starts[-1], np.int32)
    for string, place, ids in parts:
        out[starts[string + 1] - 1 - place] = ids
    return out, starts


def _viterbi_class(model: Model, raw: np.ndarray, first: np.ndarray, length: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, depth = len(first), min(most, model.trie.depth)
    text = np.zeros((most, n), np.uint8)
    for t in range(most):
        inside = length > t
        text[t, inside] = raw[first[inside] + t]
    # piece[t, l, i]: number of the piece of l + 1 bytes that starts at byte t of string i.
    piece = np.full((most, depth, n), -1, np.int32)
    for t in range(most):
        alive = np.flatnonzero((length > t) & ((text[t] & 0xC0) != 0x80))
        state = np.zeros(len(alive), np.int64)
        for l in range(min(depth, most - t)):
            inside = length[alive] > t + l
            alive, state = alive[inside], state[inside]
            state, there = model.trie.step(state, text[t + l, alive].astype(np.int64))
            alive, state = alive[there], state[there]
            if not len(alive):
                break
            piece[t, l, alive] = model.trie.value[state]
    lead = text
    width = np.where(lead < 0x80, 1, np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, np.where(lead >= 0xC0, 2, 0))))
    score = model.scores[model.ordinary]
    best = np.full((most + 1, n), -np.inf)
    best[0] = 0
    back = np.zeros((most + 1, n), np.int16)
    chosen = np.full((most + 1, n), -1, np.int32)
    column = np.arange(n)
    for t in range(1, most + 1):
        for l in range(min(depth, t)):
            p = piece[t - l - 1, l]
            has = p >= 0
            value = np.where(has, best[t - l - 1] + score[np.where(has, p, 0)], -np.inf)
            better = (value >= best[t]) & has
            best[t, better], back[t, better], chosen[t, better] = value[better], l + 1, p[better]
        for w in range(1, min(4, t) + 1):
            own = width[t - w] == w
            # A character without a piece of its own.
            if w <= depth:
                own = own & (piece[t - w, w - 1] < 0)
            value = np.where(own, best[t - w] + model.floor, -np.inf)
            better = own & (value > best[t])
            best[t, better], back[t, better], chosen[t, better] = value[better], w, -1
    at, strings, places, ids = length.copy(), [], [], []
    place = np.zeros(n, np.int64)
    live = column[at > 0]
    while len(live):
        step, p = back[at[live], live].astype(np.int64), chosen[at[live], live]
        step = np.maximum(step, 1)
        known = p >= 0
        own = live[known]
        strings.append(own)
        places.append(place[own])
        ids.append(model.ordinary[p[known]])
        place[own] += 1
        own, width_ = live[~known], step[~known]
        for k in range(int(width_.max(initial=0))):
            some = own[width_ > k]
            strings.append(some)
            places.append(place[some])
            ids.append(model.byte_id[text[at[some] - 1 - k, some]])
            place[some] += 1
        at[live] -= step
        live = live[at[live] > 0]
    return np.concatenate(strings), np.concatenate(places), np.concatenate(ids)


def viterbi_long(model: Model, raw: np.ndarray) -> np.ndarray:
    """Ids of one byte string, with the ties of :func:`viterbi`: pieces are relaxed from each place where a character begins."""
    n, depth = len(raw), model.trie.depth
    score = model.scores[model.ordinary].tolist()
    best, back, chosen = [-np.inf] * (n + 1), np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
    best[0] = 0.0
    for low in range(0, n, WINDOW):
        starts = low + np.flatnonzero((raw[low : low + WINDOW] & 0xC0) != 0x80)
        lead = raw[starts]
        width = np.where(lead < 0x80, 1, np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2)))
        # Start, length and piece of every match, in order of start and length.
        alive, state, found = np.arange(len(starts)), np.zeros(len(starts), np.int64), []
        for l in range(depth):
            inside = starts[alive] + l < n
            alive, state = alive[inside], state[inside]
            state, there = model.trie.step(state, raw[starts[alive] + l].astype(np.int64))
            alive, state = alive[there], state[there]
            if not len(alive):
                break
            piece = model.trie.value[state]
            some = piece >= 0
            found.append((alive[some], np.full(int(some.sum()), l + 1), piece[some]))
        which, size, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        by = np.lexsort((size, which))
        bounds = np.searchsorted(which[by], np.arange(len(starts) + 1)).tolist()
        sizes, pieces = size[by].tolist(), piece[by].tolist()
        for i, (t, w) in enumerate(zip(starts.tolist(), width.tolist())):
            here, own = best[t], False
            for m in range(bounds[i], bounds[i + 1]):
                to, p = t + sizes[m], pieces[m]
                own = own or sizes[m] == w
                value = here + score[p]
                # Longer last pieces come first, as their starts do.
                if value > best[to] or value == best[to] and chosen[to] < 0:
                    best[to], back[to], chosen[to] = value, sizes[m], p
            if not own and t + w <= n and here + model.floor > best[t + w]:
                best[t + w], back[t + w], chosen[t + w] = here + model.floor, w, -1
    out, at = [], n
    while at > 0:
        step = max(1, int(back[at]))
        if chosen[at] >= 0:
            out.append(int(model.ordinary[chosen[at]]))
        else:
            out.extend(int(model.byte_id[b]) for b in raw[at - step : at][::-1])
        at -= step
    return np.array(out[::-1], np.int32)


def marked(column: pa.Array, add_marker: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with each space a marker, and one before each text that isn't empty."""
    raw, offsets = flat(column)
    space = raw == 0x20
    extra = np.zeros(len(raw), np.int64)
    extra[space] = 2
    begins = offsets[:-1][np.diff(offsets) > 0]
    lead = np.zeros(len(raw), np.int64)
    if add_marker:
        lead[begins] = 3
    ends = np.cumsum(1 + extra + lead)
    out = np.empty(int(ends[-1]) if len(raw) else 0, np.uint8)
    last = ends - 1
    out[last] = np.where(space, MARKER[2], raw)
    for k, b in enumerate(MARKER[:2]):
        out[last[space] - 2 + k] = b
    if add_marker:
        for k, b in enumerate(MARKER):
            out[last[begins] - extra[begins] - 3 + k] = b
    return out, np.concatenate([[0], ends])[offsets]


def encode(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """All ids and the n + 1 places where each text's start."""
    raw, offsets = marked(column, model.add_marker)
    n = len(raw)
    if not n:
        return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
    # A cut before each marker that doesn't follow a marker.
    is_marker = np.zeros(n, bool)
    if n > 2:
        is_marker[: n - 2] = (raw[:-2] == MARKER[0]) & (raw[1:-1] == MARKER[1]) & (raw[2:] == MARKER[2])
    cut = is_marker.copy()
    cut[3:] &= ~is_marker[:-3]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    cuts = np.append(np.flatnonzero(cut), n)
    coded = binary_array(raw, cuts).dictionary_encode()
    ids, starts = viterbi(model, *flat(coded.dictionary))
    of = coded.indices.to_numpy()
    size = np.diff(starts)[of]
    ends = np.concatenate([[0], np.cumsum(size)])
    return ids[np.repeat(starts[of] - ends[:-1], size) + np.arange(ends[-1])], ends[np.searchsorted(cuts, offsets)]


def decode(ids: np.ndarray, starts: np.ndarray, model: Model) -> list[bytes]:
    """The texts: pieces joined, byte pieces as their bytes, markers as spaces, the first one dropped."""
    table = [b"" if k == 2 else bytes([int(p[3:5], 16)]) if k == 1 else p.replace(MARKER, b" ") for p, k in zip(model.pieces, model.kinds.tolist())]
    raw, offsets = flat(pa.array(table, pa.large_binary()).take(pa.array(ids, pa.int64())))
    at = offsets[starts].tolist()
    data = raw.tobytes()
    return [data[a:b].removeprefix(b" ") if model.add_marker else data[a:b] for a, b in zip(at[:-1], at[1:])]


def _codec(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for batch in chunks(batches):
        column = batch.column("text")
        ids, starts = encode(column, model)
        decoded = decode(ids, starts, model)
        raw, offsets = flat(column)
        data, at = raw.tobytes(), offsets.tolist()
        same = [d == data[a:b] for d, a, b in zip(decoded, at[:-1], at[1:])]
        is_byte = np.concatenate([[0], np.cumsum(model.kinds[ids] == 1)])[starts]
        own, at = np.ascontiguousarray(ids, "<u4"), starts.tolist()
        crc = [crc32(own[a:b]) for a, b in zip(at[:-1], at[1:])]
        columns = [batch.column("rec"), pa.array(np.diff(starts), pa.int64()), pa.array(np.diff(is_byte), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
        names = ["rec", "n_pieces", "n_bytes", "ids_crc32", "round_trip"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())))
            columns.append(pa.array(decoded, pa.binary()).cast(pa.string()))
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names)


def sentencepiece_codec(docs: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per input row: rec (struct of ``keep``, by default all columns but the
    text), n_pieces, n_bytes (byte-fallback pieces among them), ids_crc32, round_trip
    (decoding gives the text again) and, if ``with_ids``, ids and decoded.

    A projection without a shuffle. Null and empty texts have no pieces and decode to
    the empty text. Texts that hold U+2581 themselves decode with a space in its
    place, as the marker is that character. Input columns may have any names.
    """
    t = Safe(docs, without(docs, text_col) if keep is None else keep)
    base = t.rows.select(t.rec, F.coalesce(t.col(text_col), F.lit("")).alias("text"))
    schema = t.schema("n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean" + ", ids array<int>, decoded string" * with_ids)
    return t.out(base.mapInArrow(lambda b: _codec(b, model, with_ids), schema))
