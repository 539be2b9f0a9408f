"""LM scoring by cross-entropy difference of two matched bigram models over words.

Target and background model share vocabulary, order and smoothing. The vocabulary is
every word (``[^\\x20\\x09-\\x0D]+``, unchanged) of every document and a boundary sign
before and after each text. The background is counted over all documents, the target
over those that their label marks; with the corpus grow the vocabulary and the table
of bigrams. With counts c, N tokens and V kinds of words,

    p(w) = (c(w) + 1) / (N + V),    p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU).

A document is left out of the counts of the models that score it, so that no text is
judged by a model that has seen it there. A token's loss difference is
log p_background - log p_target; a document's score is the mean over its tokens.
Below 0 it reads like the target.

No model is ever in one place. Texts are written once as blocks of word hashes. A block
sends each distinct gram once, sorted and packed, to the bucket of its hash range; a
bucket sums the blocks' counts and answers each block with the totals in the order
asked. So texts aren't shuffled, a frequent gram costs one entry a block and not one
an occurrence, and what a task holds is one block or one bucket. Grams are told
apart by 63 bits of a hash.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramus.llm.arrowtext import Words, chunks, hashes, mix
from ramus.llm.shared import Safe, without
from ramus.operators.storage import Tables

#: Weight of the lower order, in tokens. Losses of left-out texts at sf0.1 with 1, 10, 100, 300, 1000: 9.58, 8.90, 8.58, 8.56, 8.64.
MU = 100.0
#: Grams aimed at in one bucket.
BUCKET_GRAMS = 2_000_000
_BOUNDARY = mix(np.array([0x6C6D], np.uint64))[0]
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _squeeze(values: np.ndarray) -> bytes:
    """An array by byte planes, which compress well."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _open(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        words = Words(batch.column("text"))
        whole = pa.array([0, batch.num_rows], pa.int32())
        # Blocks get their numbers once: later steps read the written table.
        number = int.from_bytes(os.urandom(8), "little") >> 1
        yield pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([len(words) + int(np.count_nonzero(words.counts))], pa.int64()), pa.ListArray.from_arrays(whole, batch.column("rec")), pa.ListArray.from_arrays(whole, batch.column("id")),
            pa.array([_squeeze(hashes(words.vocabulary))], pa.binary()), pa.array([_squeeze(words.ids.astype(np.int32))], pa.binary()), pa.array([_squeeze(words.counts.astype(np.int64))], pa.binary()),
        ], ["block", "size", "rec", "ids", "words", "tokens", "counts"])


class Block:
    """Tokens of a block's texts, each text ended by the boundary sign, and the block's distinct grams.

    ``grams`` are sorted; ``one`` and ``two`` say for each token which gram its
    word and its pair with the word before are, ``before`` which gram the word before.
    The lowest bit of a gram's hash is 0 for a word and 1 for a pair.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, counts: np.ndarray):
        some = counts > 0
        self.size = counts + some
        self.text = np.repeat(np.arange(len(counts)), self.size)
        stop = np.cumsum(self.size)[some] - 1
        token = np.full(len(self.text), _BOUNDARY)
        inner = np.ones(len(token), bool)
        inner[stop] = False
        token[inner] = words[tokens]
        # The word before a text's first is the boundary, which stands at its end.
        self.previous = np.arange(len(token)) - 1
        self.previous[stop - self.size[some] + 1] = stop
        pair = mix(token[self.previous] * _PAIR + token)
        self.grams, of = np.unique(np.concatenate([token & ~np.uint64(1), pair | np.uint64(1)]), return_inverse=True)
        self.one, self.two = of[: len(token)], of[len(token) :]

    def counted(self, weight: np.ndarray | None = None) -> np.ndarray:
        """For each gram its places in the texts, or in those of weight 1."""
        each = None if weight is None else weight[self.text]
        found = np.bincount(self.one, each, len(self.grams)) + np.bincount(self.two, each, len(self.grams))
        return found.astype(np.int64)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """For each token how often its text has its word, and its pair."""
        out = []
        for gram in (self.one, self.two):
            _, of, n = np.unique(self.text * len(self.grams) + gram, return_inverse=True, return_counts=True)
            out.append(n[of])
        return out[0], out[1]

    def losses(self, count: np.ndarray, total: int, kinds: int, left_out: np.ndarray, own: tuple[np.ndarray, np.ndarray], mu: float) -> np.ndarray:
        """Mean loss of each text in the model of these counts, without the texts of ``left_out`` for themselves."""
        out = left_out[self.text].astype(np.int64)
        word, pair = count[self.one] - out * own[0], count[self.two] - out * own[1]
        context = word[self.previous]
        p = (word + 1) / (total - out * self.size[self.text] + kinds)
        p = (pair + mu * p) / (context + mu)
        return np.bincount(self.text, -np.log(p), len(self.size)) / np.maximum(self.size, 1)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, Block, np.ndarray]]:
    """Row, block and which of its texts are the target's."""
    for i in range(batch.num_rows):
        block = Block(*(_open(batch.column(c)[i].as_py(), kind) for c, kind in (("words", np.uint64), ("tokens", np.int32), ("counts", np.int64))))
        ids, targets = batch.column("ids")[i].values, batch.column("targets")[i].values
        marked = np.zeros(len(block.size), bool) if targets is None else pc.is_in(ids, targets, skip_nulls=True).to_numpy(zero_copy_only=False)
        yield i, block, marked


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    edge = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    for batch in batches:
        for i, block, marked in _read(batch):
            cut = np.concatenate([[0], np.searchsorted(block.grams, edge), [len(block.grams)]])
            n, t = block.counted(), block.counted(marked)
            full = np.flatnonzero(np.diff(cut))
            for part in np.array_split(full, len(full) // 512 + 1):
                spans = [slice(int(cut[b]), int(cut[b + 1])) for b in part]
                packed = [[_squeeze(np.diff(block.grams[s], prepend=np.uint64(0))) for s in spans], [_squeeze(n[s]) for s in spans], [_squeeze(t[s]) for s in spans]]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([batch.column("block")[i].as_py()] * len(part), pa.int64()), *(pa.array(p, pa.binary()) for p in packed)], ["bucket", "block", "grams", "n", "t"])


def _sum(bucket: int, blocks: list[int], parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    grams, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n, t = (np.bincount(of, np.concatenate([p[i] for p in parts]), len(grams)).astype(np.int64) for i in (1, 2))
    end = np.cumsum([len(p[0]) for p in parts]).tolist()
    spans = [of[a:b] for a, b in zip([0, *end], end)]
    word = (grams & np.uint64(1)) == 0
    facts = [[int(word.sum()), *[0] * (len(blocks) - 1)], [int(n[word].sum()), *[0] * (len(blocks) - 1)], [int(t[word].sum()), *[0] * (len(blocks) - 1)]]
    for lo in range(0, len(blocks), 512):
        own = slice(lo, lo + 512)
        yield pa.RecordBatch.from_arrays([
            pa.array(blocks[own], pa.int64()), pa.array([bucket] * len(blocks[own]), pa.int64()), pa.array([_squeeze(n[s]) for s in spans[own]], pa.binary()), pa.array([_squeeze(t[s]) for s in spans[own]], pa.binary()),
            *(pa.array(f[own], pa.int64()) for f in facts),
        ], ["block", "bucket", "n", "t", "kinds", "n_total", "t_total"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, blocks, parts = -1, [], []
    for batch in batches:
        for bucket, block, grams, n, t in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "grams", "n", "t"))):
            if bucket != now and parts:
                yield from _sum(now, blocks, parts)
                blocks, parts = [], []
            now = bucket
            blocks.append(block)
            parts.append((np.cumsum(_open(grams, np.uint64)), _open(n, np.int64), _open(t, np.int64)))
    if parts:
        yield from _sum(now, blocks, parts)


def _score(batches: Iterator[pa.RecordBatch], kinds: int, n_total: int, t_total: int, mu: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, block, marked in _read(batch):
            found = sorted(batch.column("found")[i].as_py() or [], key=lambda x: x["bucket"])
            n, t = (np.concatenate([np.empty(0, np.int64), *(_open(x[c], np.int64) for x in found)]) for c in ("n", "t"))
            own = block.own()
            target = block.losses(t, t_total, kinds, marked, own, mu)
            background = block.losses(n, n_total, kinds, np.ones(len(marked), bool), own, mu)
            yield pa.RecordBatch.from_arrays([batch.column("rec")[i].values, pa.array(block.size, pa.int64()), pa.array(target), pa.array(background), pa.array(target - background)], ["rec", "n_tokens", "target_loss", "background_loss", "score"])


def lm_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", target: int = 1, keep: list[str] | None = None, mu: float = MU) -> DataFrame:
    """One row per input row: rec (struct of ``keep``, by default all columns but the
    text), n_tokens (words, and one for the end), target_loss, background_loss, score
    (their difference), in nats a token.

    Target texts are those with a label equal to ``target``; rows with null ids or
    labels have none, and an id labelled twice is in if any of its labels says so.
    Each row is left out of its own models; a row that repeats another is scored
    by models that have counted the other. Without target texts the target model is
    uniform. Null and blank texts have no tokens and score 0. An empty table gives no
    rows. Columns may have any names.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "lm-score")
    t, mark = Safe(docs, without(docs, text_col) if keep is None else keep), Safe(labels)
    base = t.rows.select(t.rec, t.col(id_col).alias("id"), t.col(text_col).alias("text"))
    rec, key = (base.schema[c].dataType.simpleString() for c in ("rec", "id"))
    blocks = tables.put("blocks", base.mapInArrow(_blocks, f"block long, size long, rec array<{rec}>, ids array<{key}>, words binary, tokens binary, counts binary"))
    # Ids alone meet the labels, once for each block; blocks get the ids of their target texts.
    marked = mark.rows.filter(mark.col(label) == target).select(mark.col(id_col).cast(key).alias("id")).filter("id IS NOT NULL").distinct()
    asked = blocks.select("block", F.explode(F.array_distinct("ids")).alias("id")).filter("id IS NOT NULL")
    targets = asked.join(marked.hint("shuffle_hash"), "id", "left_semi").groupBy("block").agg(F.collect_list("id").alias("targets"))
    flagged = tables.put("flagged", blocks.join(targets.hint("shuffle_hash"), "block", "left"))
    tables.drop("blocks")
    buckets = max(32, 2 * (flagged.agg(F.sum("size")).first()[0] or 0) // BUCKET_GRAMS)
    sent = flagged.select("block", "ids", "targets", "words", "tokens", "counts").mapInArrow(lambda b: _ask(b, buckets), "bucket long, block long, grams binary, n binary, t binary")
    answers = tables.put("answers", sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "block long, bucket long, n binary, t binary, kinds long, n_total long, t_total long"))
    kinds, n_total, t_total = (x or 0 for x in answers.agg(F.sum("kinds"), F.sum("n_total"), F.sum("t_total")).first())
    found = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "t")).alias("found"))
    scored = flagged.join(found.hint("shuffle_hash"), "block", "left").select("rec", "ids", "targets", "words", "tokens", "counts", "found")
    return t.out(scored.mapInArrow(lambda b: _score(b, kinds, n_total, t_total, mu), t.schema("n_tokens long, target_loss double, background_loss double, score double")))
