"""Token ids in binary shards of fixed-width packed blocks.

A shard holds the documents of one range of ids, in ascending order:

    magic "RMTOK002" | the blocks
    document ids | nulls among them (a byte each) | n + 1 first-id places
    blocks + 1 byte offsets of the blocks
    bits, ids in a block, documents, ids, blocks (int64 each) | magic

The index stands at the end, so a shard is written block by block as ids come.
All integers are little-endian. Each id takes the least number of bits that holds
the vocabulary (16 for 50,257 ids); a block is a whole number of 64-bit words, so
id i is found from its block's offset alone, and numpy unpacks a block in 64
column operations whatever the width.

Documents are dealt by ranges of ids before they are encoded, so the sample that
finds the ranges costs no encoding. A task writes its shard under a name of its
own attempt; only the shards of successful attempts are in the manifest, a table
with a row for each shard, which is what the reader goes by, so that lost executors
and repeated tasks do no harm. Neither writer nor reader holds a whole shard.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramus.llm.arrowtext import binary_array, chunks, flat, ints
from ramus.llm.shared import Safe
from ramus.operators.sequences import scan
from ramus.operators.storage import Tables, fresh_path

MAGIC = b"RMTOK002"
BLOCK_IDS = 4096
#: Text in a shard; bytes of segments and their ids that a Python worker remembers; ids that a reader unpacks at once.
SHARD_BYTES, CACHE_BYTES, READ_IDS = 32 << 20, 256 << 20, 1 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, padded with 0 to a multiple of 64, in ``bits`` bits each."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    columns = np.ascontiguousarray(rows.T)
    out = np.zeros((bits, len(rows)), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8", copy=False).tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of what :func:`pack` has made."""
    words = np.ascontiguousarray(np.frombuffer(data, "<u8").reshape(-1, bits).T)
    out = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        x = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[word + 1] << np.uint64(64 - shift))
        out[i] = x & mask
    return np.ascontiguousarray(out.T).reshape(-1)[:count]


class ShardWriter:
    """Packs ids block by block; keeps at most one block's ids, and the index."""

    def __init__(self, out: BinaryIO, bits: int, block: int = BLOCK_IDS):
        self.out, self.bits, self.block = out, bits, block
        self.rest, self.n_ids, self.at = np.empty(0, np.uint32), 0, 0
        self.keys: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = [np.zeros(1, np.int64)]
        out.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        blocks = -(-len(ids) // self.block)
        self.offsets.append(self.at + np.minimum(np.arange(1, blocks + 1, dtype=np.int64) * (self.block // 64 * self.bits * 8), len(data)))
        self.at += len(data)
        self.out.write(data)

    def add(self, keys: np.ndarray, nulls: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> None:
        """Documents; ends: for each the place after its last id among ``ids``."""
        self.keys.append(keys)
        self.nulls.append(nulls)
        self.ends.append(ends + self.n_ids)
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block * self.block
        if whole:
            self._put(ids[:whole])
        self.rest = ids[whole:].copy()

    def close(self) -> tuple[int, int]:
        """Writes the index; numbers of documents and ids."""
        if len(self.rest):
            self._put(self.rest)
        keys, offsets = np.concatenate(self.keys or [np.empty(0)]), np.concatenate(self.offsets)
        for part, kind in ((keys, "<i8"), (np.concatenate(self.nulls or [np.empty(0)]), "u1"), (np.concatenate([np.zeros(1), *self.ends]), "<i8"), (offsets, "<i8"), (np.array([self.bits, self.block, len(keys), self.n_ids, len(offsets) - 1]), "<i8")):
            self.out.write(part.astype(kind).tobytes())
        self.out.write(MAGIC)
        return len(keys), self.n_ids


def shard_bytes(doc_ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    """A small shard in memory."""
    out = io.BytesIO()
    writer = ShardWriter(out, bits, block)
    writer.add(doc_ids, nulls, ends, ids)
    writer.close()
    return out.getvalue()


class Shard:
    """Random access to a shard: an open file with seek and read, or its bytes."""

    def __init__(self, data: bytes | BinaryIO):
        self.file = io.BytesIO(data) if isinstance(data, bytes) else data
        size = self.file.seek(0, os.SEEK_END)
        tail = self._bytes(max(0, size - 48), size)
        if tail[40:] != MAGIC or self._bytes(0, 8) != MAGIC:
            raise ValueError("not a token shard")
        self.bits, self.block, self.n_docs, self.n_ids, blocks = np.frombuffer(tail[:40], "<i8").tolist()
        begin = size - 48 - 8 * (blocks + 1) - 8 * (self.n_docs + 1) - 9 * self.n_docs
        index, at = self._bytes(begin, size - 48), 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            at += np.dtype(kind).itemsize * count
            return np.frombuffer(index, kind, count, at - np.dtype(kind).itemsize * count)

        self.doc_ids, self.nulls = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.first, self.offsets = take("<i8", self.n_docs + 1), take("<i8", blocks + 1)

    def _bytes(self, a: int, b: int) -> bytes:
        self.file.seek(a)
        return self.file.read(b - a)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop; only the blocks that hold them are read and unpacked."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        data = self._bytes(8 + int(self.offsets[a]), 8 + int(self.offsets[b]))
        return unpack(data, self.bits, min(b * self.block, self.n_ids) - a * self.block)[start - a * self.block : stop - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))


_SPACE = np.isin(np.arange(256), [0x09, 0x0A, 0x0D, 0x20])
_CODE = np.arange(256)
_LETTER = ((_CODE >= 0x41) & (_CODE <= 0x5A)) | ((_CODE >= 0x61) & (_CODE <= 0x7A))
_PUNCT = ((_CODE >= 0x21) & (_CODE <= 0x7E)) & ~_LETTER & ~((_CODE >= 0x30) & (_CODE <= 0x39))


def segments(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where a text may be cut with no change to its byte-level BPE ids.

    Cuts lie where the tokenizer's own pattern always ends a match: before white
    space that follows a visible character, between a letter and punctuation, and
    between punctuation (no apostrophe, which starts contractions) and a letter.
    """
    n = len(raw)
    if not n:
        return np.zeros(1, np.int64)
    one, two = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    one[1:], two[2:] = raw[:-1], raw[:-2]
    # Two-byte characters from U+00C0 on are never white space; those of 0xC3 are letters but for two signs.
    latin = (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
    visible = ((one > 0x20) & (one < 0x7F)) | ((two >= 0xC3) & (two <= 0xDF) & (one >= 0x80))
    cut = (visible & _SPACE[raw]) | ((_LETTER[one] | latin) & _PUNCT[raw]) | (_PUNCT[one] & (one != 0x27) & _LETTER[raw])
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.append(np.flatnonzero(cut), n)


def around(cuts: np.ndarray, raw: np.ndarray, offsets: np.ndarray, added: re.Pattern | None) -> np.ndarray:
    """The cuts with each added token's string in a text as a segment of its own, as the tokenizer takes these out first."""
    if added is None or not added.search(data := raw.tobytes()):
        return cuts
    hits = [(a + m.start(), a + m.end()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in added.finditer(data[a:b])]
    if not hits:
        return cuts
    begin, end = np.array(hits).T
    which = np.searchsorted(begin, cuts, side="right") - 1
    inside = (which >= 0) & (cuts < end[which])
    return np.unique(np.concatenate([cuts[~inside], begin, end]))


_cache: dict[bytes, bytes] = {}
_held = 0
_tokenizers: dict = {}


def _tokenizer(path: str):
    """The tokenizer and a pattern of its added tokens."""
    global _held
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            tokens = json.load(f).get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in tokens):
            raise ValueError("an added token takes in its neighbours, so texts can't be cut beside it")
        pattern = "|".join(re.escape(t["content"]) for t in tokens)
        _tokenizers.clear()
        _cache.clear()
        _held = 0
        _tokenizers[path] = Tokenizer.from_file(path), re.compile(pattern.encode()) if pattern else None
    return _tokenizers[path]


def encode(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids, each text's followed by ``end_id``, and for each text the place after its last id.

    Each distinct segment is encoded once in a worker (until CACHE_BYTES are held).
    """
    global _held
    tokenizer, added = _tokenizer(path)
    raw, offsets = flat(column)
    cuts = around(segments(raw, offsets), raw, offsets, added)
    coded = binary_array(raw, cuts).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    if _held > CACHE_BYTES:
        _cache.clear()
        _held = 0
    new = [s for s in distinct if s not in _cache]
    for s, e in zip(new, tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in new], add_special_tokens=False)):
        _cache[s] = ids = np.array(e.ids, np.uint32).tobytes()
        # Two objects and their place in the table.
        _held += len(s) + len(ids) + 180
    found = [_cache[s] for s in distinct]
    values = np.frombuffer(b"".join(found), np.uint32)
    size = np.fromiter((len(f) // 4 for f in found), np.int64, len(found))
    first = np.cumsum(size) - size
    of = coded.indices.to_numpy()
    lengths = size[of]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    per_text = ends[np.searchsorted(cuts, offsets)]
    ids = values[np.repeat(first[of] - ends[:-1], lengths) + np.arange(ends[-1])] if len(values) else values
    stops = per_text[1:] + np.arange(1, len(offsets))
    return np.insert(ids, per_text[1:], end_id), stops


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, bits: int, where: str) -> Iterator[pa.RecordBatch]:
    writer = None
    for batch in chunks(batches):
        if writer is None:
            shard = TaskContext.get().partitionId()
            name = f"{shard:09d}-{uuid.uuid4().hex}.tok"
            fs, root = pyarrow.fs.FileSystem.from_uri(where)
            fs.create_dir(root, recursive=True)
            out = fs.open_output_stream(f"{root}/{name}")
            writer = ShardWriter(out, bits)
        own, stops = encode(batch.column("text"), path, end_id)
        writer.add(ints(batch.column("doc_id")), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False), stops, own)
    if writer is None:
        return
    n_docs, n_ids = writer.close()
    out.close()
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shard], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["name", "shard", "n_docs", "n_ids"])


def write_tokens(docs: DataFrame, where: str, tokenizer: str, vocabulary: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards in ascending order of ids; the manifest: name, shard, n_docs, n_ids, start (ids in the shards before it).

    Null ids come first, null texts are empty (the end id alone). Rows with one id
    are ordered by a hash of their text. A string of a special token in a text becomes
    that token's id, as in a plain call of the tokenizer.
    """
    t = Safe(docs)
    text = F.coalesce(t.col(text_col), F.lit(""))
    base = t.rows.select(t.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = base.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    bits = bits_for(vocabulary)
    store = Tables(docs.sparkSession, "manifest")
    shards = store.put("shards", dealt.mapInArrow(lambda b: _write(b, tokenizer, end_id, bits, where), "name string, shard long, n_docs long, n_ids long"))
    return store.put("manifest", scan(shards, "shard", "n_ids", "start"))


def _read(batches: Iterator[pa.RecordBatch], where: str, digest: Callable[[np.ndarray], int] | None) -> Iterator[pa.RecordBatch]:
    fs, root = pyarrow.fs.FileSystem.from_uri(where)
    for batch in batches:
        for name, base in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
            with fs.open_input_file(f"{root}/{name}") as file:
                shard = Shard(file)
                # Documents of about READ_IDS ids at once; a longer one is by itself.
                cuts = np.flatnonzero(np.diff(shard.first[:-1] // READ_IDS, prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), shard.n_docs]):
                    first = shard.first[a : b + 1] - shard.first[a]
                    ids = np.ascontiguousarray(shard.ids(int(shard.first[a]), int(shard.first[b])), "<u4")
                    doc = pa.array(shard.doc_ids[a:b], pa.int64(), mask=shard.nulls[a:b].astype(bool))
                    start, size = pa.array(shard.first[a:b] + base, pa.int64()), pa.array(np.diff(first), pa.int64())
                    if digest:
                        last = pa.array([digest(ids[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())], pa.int64())
                        yield pa.RecordBatch.from_arrays([doc, start, size, last], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    else:
                        last = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([doc, start, size, last], ["doc_id", "start", "n_tokens", "ids"])


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(memoryview(ids).cast("B") if len(ids) else b"")


def read_tokens(spark: SparkSession, where: str, manifest: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or with ``digest`` their ids_crc32), from the shards of the manifest."""
    last = "ids_crc32 long" if digest else "ids array<int>"
    # A task for each shard: the manifest's rows are few bytes, but stand for large files.
    shards = manifest.select("name", "start").repartition(max(1, manifest.count()))
    return shards.mapInArrow(lambda b: _read(b, where, crc32 if digest else None), f"doc_id long, start long, n_tokens long, {last}")


def token_output(docs: DataFrame, tokenizer: str, vocabulary: int = 50257, end_id: int = 0, where: str | None = None, digest: bool = True) -> DataFrame:
    """Write the documents' shards below ``where`` (by default the shared folder) and read them back.

    An empty table writes no shard and gives no rows; extra columns aren't read.
    """
    where = where or fresh_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, where, write_tokens(docs, where, tokenizer, vocabulary, end_id), digest)
