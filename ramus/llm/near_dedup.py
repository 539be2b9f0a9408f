"""Near-duplicate classes by Order MinHash and banded alignment.

A text's k-mers are its runs of ``k`` words, each labelled with how often it has
occurred before. For each of ``sketches`` hash orders the ``sampled`` smallest
labelled k-mers are taken and hashed in the order in which they stand in the text.
Two texts agree in a sketch if the same k-mers are smallest and in one order, which
follows edit similarity and not only the overlap of sets.

1. Exact copies (by a 128-bit hash) become one node with one sketch.
2. Nodes with an equal sketch form a group. Each member is compared with the group's
   leader, the smallest node, so groups cost as much as they have members. Pairs are
   verified by alignment of the whole word sequences in a band as wide as the allowed
   distance. Verified links join classes (connected components).
3. A group is open while its members are of several classes. Members of open groups of
   up to SMALL nodes are compared pair by pair across classes. Members of larger ones, which
   come from k-mers that many unlike texts share, meet by their rarest words: if a pair is
   close, the first word in the order of rarity that an alignment keeps is among the rarest
   of both, at places no farther apart than the allowed distance. So no close pair of a
   group is left out, and unlike texts that share a passage rarely meet.
4. Texts so short that one edit is allowed are also looked up by their words without
   one, which finds all pairs of them.

Only ids, sketches, rare words and pairs shuffle, and the texts of nodes that can be in a
pair; a text that many pairs need is dealt to several tasks. Nothing but row counts comes
to the driver. Tables that are no longer needed are deleted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ramus.llm.arrowtext import Words, chunks, hashes, mix
from ramus.llm.shared import LAST, Safe
from ramus.operators.clustering import EDGES, components
from ramus.operators.storage import Tables

#: Members of an open group that are compared pair by pair; pairs for which one task holds a text.
SMALL, FAN = 32, 256
#: Slots that words are counted in; parts that words are dealt to; texts of a block, and blocks at most.
SLOTS, BUCKETS, BLOCK_TEXTS, BLOCKS = 1 << 16, 256, 512, 64
#: Texts of a word that meet others at once, and pairs that a task holds before it looks for equal ones.
RARE, HELD = 1024, 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


class Kmers:
    """The labelled k-mers of each text that has words. Texts of under k words have one, all of the text."""

    def __init__(self, column: pa.Array, k: int):
        words = Words(column)
        counts = words.counts
        self.some = np.flatnonzero(counts > 0)
        self.counts = np.maximum(counts[self.some] - k + 1, 1)
        self.starts = np.cumsum(self.counts) - self.counts
        self.text = np.repeat(np.arange(len(self.some)), self.counts)
        if not len(self.some):
            self.h = np.empty(0, np.uint64)
            return
        word = hashes(words.vocabulary)[words.ids]
        first = words.per_text[:-1][self.some][self.text] + np.arange(len(self.text)) - self.starts[self.text]
        last = words.per_text[1:][self.some][self.text]
        h = np.zeros(len(self.text), np.uint64)
        for i in range(k):
            inside = first + i < last
            h = np.where(inside, mix(h * _STEP + word[np.where(inside, first + i, 0)]), h)
        # The occurrence of each k-mer in its text.
        by = np.lexsort((h, self.text))
        new = np.ones(len(h), bool)
        new[1:] = (h[by][1:] != h[by][:-1]) | (self.text[by][1:] != self.text[by][:-1])
        occurrence = np.empty(len(h), np.uint64)
        occurrence[by] = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        self.h = mix(h + occurrence * _STEP)

    def smallest(self, j: int, sampled: int) -> np.ndarray:
        """Places of the ``sampled`` smallest k-mers in order j, in text order, for the texts with words; len(h) where there are too few."""
        # h is mixed already, so a product with an odd number gives another order of it.
        value = self.h * (mix(np.full(1, j + 1, np.uint64) * _STEP) | np.uint64(1))
        places = np.full((sampled, len(self.counts)), len(self.h))
        for s in range(sampled):
            at = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, self.starts), self.counts))
            head = at[np.flatnonzero(np.diff(self.text[at], prepend=-1))]
            head = head[value[head] != _MAX]
            places[s, self.text[head]] = head
            value[head] = _MAX
        places.sort(axis=0)
        return places

    def sketch(self, j: int, places: np.ndarray) -> np.ndarray:
        """A hash of j and the k-mers at the places; 0 where there is none."""
        padded, out = np.append(self.h, np.uint64(0)), np.full(places.shape[1], j + 1, np.uint64)
        for row in places:
            out = mix(out * _STEP + padded[row])
        return np.where(places[0] < len(self.h), out, np.uint64(0))


def order_min_hash(column: pa.Array, k: int, sketches: int, sampled: int) -> np.ndarray:
    """A row of sketches for each text; zeros for texts without words."""
    kmers, out = Kmers(column, k), np.zeros((len(column), sketches), np.uint64)
    for j in range(sketches) if len(kmers.some) else ():
        out[kmers.some, j] = kmers.sketch(j, kmers.smallest(j, sampled))
    return out


def full_distance(a: list[int], b: list[int]) -> int:
    """Edit distance by Myers' bit-vector algorithm (1999, in Hyyrö's form), one bit for each of a's items."""
    if not a or not b:
        return len(a) + len(b)
    mask = (1 << len(a)) - 1
    peq: dict[int, int] = {}
    for i, x in enumerate(a):
        peq[x] = peq.get(x, 0) | 1 << i
    vp, vn, out, top = mask, 0, len(a), 1 << (len(a) - 1)
    for y in b:
        x = peq.get(y, 0) | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & mask
        hp, hn = vn | (~(d0 | vp) & mask), d0 & vp
        out += bool(hp & top) - bool(hn & top)
        hp, hn = ((hp << 1) | 1) & mask, (hn << 1) & mask
        vp, vn = hn | (~(d0 | hp) & mask), d0 & hp
    return out


def band_distance(a: list[int], b: list[int], band: int) -> int | None:
    """Edit distance if it is at most ``band``, from the cells within band of the diagonal; else None.

    The band is a bit vector that slides along the diagonal (Hyyrö 2003).
    """
    if abs(len(a) - len(b)) > band:
        return None
    if len(a) <= band or len(b) <= band:
        d = full_distance(a, b)
        return d if d <= band else None
    width = 2 * band + 2
    mask, top = (1 << width) - 1, 1 << (width - 1)
    peq: dict[int, int] = {}
    for i, x in enumerate(a):
        peq[x] = peq.get(x, 0) | 1 << i
    vp, vn, out = (mask << (width - band - 1)) & mask, 0, band
    start, along, level = band + 1 - width, len(a) - band, 1 << (width - 2)
    for j, y in enumerate(b):
        bits = peq.get(y, 0)
        x = (bits >> start if start >= 0 else bits << -start) & mask
        start += 1
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp, hn = vn | (~(d0 | vp) & mask), d0 & vp
        if j < along:
            out += not d0 & top
        else:
            out += bool(hp & level) - bool(hn & level)
            level >>= 1
        d0 >>= 1
        vp, vn = hn | (~(d0 | hp) & mask), d0 & hp
    return out if out <= band else None


def close(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether 1 - edit distance / longer length is at least ``similarity``; bands of growing width."""
    longer = max(len(a), len(b))
    limit = int((1 - similarity) * longer + 1e-9)
    if longer == 0 or abs(len(a) - len(b)) > limit:
        return longer == 0
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    if not len(differ):
        return True
    head = int(differ[0])
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    x, y = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    # Each edit changes one word at most on either side.
    if max(len(x), len(y)) - sum((Counter(x) & Counter(y)).values()) > limit:
        return False
    band = min(16, limit)
    while True:
        if band_distance(x, y, band) is not None:
            return True
        if band >= limit:
            return False
        band = min(4 * band, limit)


def _sketch(batches: Iterator[pa.RecordBatch], k: int, sketches: int, sampled: int, short: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        found = order_min_hash(batch.column("text"), k, sketches, sampled).view(np.int64)
        n = Words(batch.column("text")).counts
        brief = pa.array(np.arange(len(n)), mask=(n < short[0] - 1) | (n > short[1]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * sketches, pa.int32()), pa.array(found.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h1"), batch.column("h2"), pa.array(n), batch.column("text").take(brief), lists], ["id", "h1", "h2", "n", "short", "sketch"])


def _occurrences(text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in the order of texts and words, where each word of a text begins in it, and each one's number in its text."""
    by = np.lexsort((word, text))
    new = np.ones(len(by), bool)
    new[1:] = (word[by][1:] != word[by][:-1]) | (text[by][1:] != text[by][:-1])
    first = np.flatnonzero(new)
    nth = np.empty(len(by), np.int64)
    nth[by] = np.arange(len(by)) - first[np.cumsum(new) - 1]
    return by, first, nth


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts hold a word of each slot, as one string of bytes for each task."""
    often = np.zeros(SLOTS, np.int64)
    for batch in chunks(batches):
        words = Words(batch.column("text"))
        hashed = hashes(words.vocabulary)[words.ids]
        by, first, _ = _occurrences(words.text_of, hashed)
        often += np.bincount((hashed[by[first]] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    yield pa.RecordBatch.from_arrays([pa.array([often.tobytes()], pa.binary())], ["often"])


def _rarest(batches: Iterator[pa.RecordBatch], often: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """bucket, words: for each bucket of words a string of bytes with node, root, n, w, r, lo, hi of each text's rarest
    words: how many stand before a word in the order of rarity, and the first and last of its places there."""
    for batch in chunks(batches):
        words = Words(batch.column("text"))
        text, hashed = words.text_of, hashes(words.vocabulary)[words.ids]
        rank = often[(hashed % np.uint64(SLOTS)).astype(np.int64)]
        by = np.lexsort((np.arange(len(text)), hashed, rank, text))
        nth, n = np.arange(len(by)) - words.per_text[text[by]], words.counts
        # As many as the longest text that can be close may have edits, and one.
        by = by[nth <= ((1 - similarity) / similarity * n + 1e-6).astype(np.int64)[text[by]]]
        first = np.flatnonzero(np.append(True, (hashed[by][1:] != hashed[by][:-1]) | (text[by][1:] != text[by][:-1]))[: len(by)])
        last = np.append(first[1:], len(by)) - 1
        start = np.zeros(len(n), np.int64)
        begins = np.flatnonzero(np.diff(text[by], prepend=-1))
        start[text[by[begins]]] = begins
        place, own = by - words.per_text[text[by]], text[by[first]]
        w = hashed[by[first]]
        row = np.column_stack([*(batch.column(c).to_numpy()[own] for c in ("node", "root", "n")), w.view(np.int64), first - start[own], place[first], place[last]])
        bucket = (mix(w) % np.uint64(BUCKETS)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(bucket[by], prepend=-1)), len(by)).tolist()
        packed = [row[by[k:m]].tobytes() for k, m in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[by][np.array(ends[:-1], int)]), pa.array(packed, pa.binary())], ["bucket", "words"])


def _paired(rows: pa.Table, similarity: float, blocks: int) -> pa.Table:
    """x, y, pairs: what shares a rare word here, as strings of bytes by the blocks of both."""
    every = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("words").to_pylist()]).reshape(-1, 7)
    node, root, n, w, r, lo, hi = np.ascontiguousarray(every[np.argsort(every[:, 3], kind="stable")].T)
    cuts = np.append(np.flatnonzero(np.append(True, w[1:] != w[:-1])[: len(w)]), len(w))
    block, held, out = (mix(node.view(np.uint64)) % np.uint64(blocks)).astype(np.int64), 0, [np.empty((0, 2), np.int64)]
    for c, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        for at in range(c, e if e - c > 1 else c, RARE):
            x = slice(at, min(at + RARE, e))
            y = slice(c, x.stop)
            longer, shorter = np.maximum(n[x, None], n[y]), np.minimum(n[x, None], n[y])
            d = ((1 - similarity) * longer + 1e-9).astype(np.int64)
            ok = (longer - shorter <= d) & (np.maximum(r[x, None], r[y]) <= d) & (lo[x, None] - hi[y] <= d) & (lo[y] - hi[x, None] <= d) & (root[x, None] != root[y])
            i, j = np.nonzero(ok & (np.arange(x.start, x.stop)[:, None] > np.arange(y.start, y.stop)))
            out.append(np.column_stack([i + x.start, j + y.start]))
            held += len(i)
            if held >= HELD:
                out, held = [_once(np.concatenate(out), node)], 0
    i, j = _once(np.concatenate(out), node).T
    i, j = np.where(block[i] <= block[j], i, j), np.where(block[i] <= block[j], j, i)
    cell = block[i] * blocks + block[j]
    by = np.argsort(cell, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(cell[by], prepend=-1)), len(by)).tolist()
    both = np.column_stack([node[i[by]], node[j[by]]])
    own = cell[by][np.array(ends[:-1], int)]
    return pa.table([pa.array(own // blocks), pa.array(own % blocks), pa.array([both[k:m].tobytes() for k, m in zip(ends[:-1], ends[1:])], pa.binary())], ["x", "y", "pairs"])


def _once(pairs: np.ndarray, node: np.ndarray) -> np.ndarray:
    """One of the pairs of rows for each two nodes."""
    a, b = (f(node[pairs[:, 0]], node[pairs[:, 1]]) for f in (np.maximum, np.minimum))
    by = np.lexsort((b, a))
    return pairs[by[np.append(True, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1]))[: len(by)]]]


def _pairs_of(rows: pa.Table) -> np.ndarray:
    """The pairs of one cell, each once."""
    found = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in rows.column("pairs").to_pylist() if x is not None]
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def _ends(rows: pa.Table) -> pa.Table:
    """x, y, node of a cell's pairs."""
    node = np.unique(_pairs_of(rows))
    x, y = (pa.array(np.full(len(node), rows.column(c)[0].as_py())) for c in "xy")
    return pa.table([x, y, pa.array(node)], ["x", "y", "node"])


def _meet(rows: pa.Table, similarity: float) -> pa.Table:
    """a, b of the pairs whose texts (node, text) are close. First the words that two texts have in common are counted."""
    texts, pairs = rows.filter(pc.is_valid(rows.column("node"))).sort_by("node"), _pairs_of(rows)
    node, words = texts.column("node").to_numpy(), Words(texts.column("text").combine_chunks())
    ids, at = words.ids.astype(np.int64), words.per_text
    _, _, nth = _occurrences(words.text_of, ids)
    code = np.unique(nth * (len(words.vocabulary) + 1) + ids, return_inverse=True)[1]
    mark = np.zeros(len(code) + 1, bool)
    a, b = np.ascontiguousarray(pairs.T)
    x, y = np.searchsorted(node, a), np.searchsorted(node, b)
    ok, held = np.zeros(len(a), bool), -1
    for i, (p, q) in enumerate(zip(x.tolist(), y.tolist())):
        if p != held:
            mark[:] = False
            mark[code[at[p] : at[p + 1]]] = True
            held = p
        longer = max(at[p + 1] - at[p], at[q + 1] - at[q])
        if longer - np.count_nonzero(mark[code[at[q] : at[q + 1]]]) <= int((1 - similarity) * longer + 1e-9):
            ok[i] = close(ids[at[p] : at[p + 1]], ids[at[q] : at[q + 1]], similarity)
    return pa.table([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "b_text"):
        for part in chunks([batch], "a_text"):
            n = part.num_rows
            words = Words(pa.concat_arrays([part.column("a_text"), part.column("b_text")]))
            ids, at = words.ids, words.per_text
            ok = [close(ids[at[i] : at[i + 1]], ids[at[n + i] : at[n + i + 1]], similarity) for i in range(n)]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def _named(rows: DataFrame, clash: DataFrame) -> DataFrame:
    """node: the first half of the text's hash, but where texts share it a hash of both halves."""
    return rows.join(clash, "h1", "left").withColumn("node", F.when(F.col("_many").isNull(), F.col("h1")).otherwise(F.xxhash64("h1", "h2"))).drop("_many")


def _one_edit(store: Tables, nodes: DataFrame, least: int, most: int) -> DataFrame:
    """a, b: texts of at most ``most`` words and one edit apart, the longer of ``least`` words or more; of those that
    differ in one place, each with the smallest. Exact, as such texts may share no k-mer."""
    words = nodes.filter("short IS NOT NULL").select("node", "n", F.array_remove(F.split("short", r"[\x20\x09-\x0D]+"), "").alias("w"))
    without = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.xxhash64(F.concat(F.slice("w", 1, i), F.slice("w", i + 2, F.size("w")))))
    cut = store.put("without", words.filter(F.col("n") >= least).select("node", "n", F.posexplode(without).alias("i", "h")))
    group = ["n", "i", "h"]
    changed = cut.join(cut.groupBy(*group).agg(F.min("node").alias("b")), group).filter("node <> b").select(F.col("node").alias("a"), "b")
    whole = words.select((F.col("n") + 1).alias("n"), F.col("node").alias("other"), F.xxhash64("w").alias("h"))
    added = cut.join(whole, ["n", "h"]).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).filter("a <> b")
    return changed.union(added)


def _room(similarity: float) -> Column:
    """Whether two texts of a_n and b_n words can be close: each edit changes the number of words by one at most."""
    longer = F.greatest("a_n", "b_n")
    return longer - F.least("a_n", "b_n") <= F.floor((1 - similarity) * longer + 1e-9)


def _verified(store: Tables, pairs: DataFrame, texts: DataFrame, similarity: float, name: str) -> DataFrame:
    """a, b of the pairs (a, b) whose texts are close. texts: node, text."""
    # A text that more than FAN pairs need goes to several tasks.
    fan = pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).alias("fan")).filter("fan > 1")
    dealt = pairs.select("a", "b").join(fan, "b", "left").select("a", "b", F.when(F.col("fan") > 1, F.pmod(F.xxhash64("a"), "fan")).otherwise(0).alias("deal"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")).join(fan, "b", "left").select("b", "b_text", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("fan", F.lit(1)) - 1)).alias("deal"))
    aligned = dealt.join(left, "a").join(right, ["b", "deal"]).select("a", "b", "a_text", "b_text").mapInArrow(lambda x: _verify(x, similarity), "a long, b long, ok boolean")
    return store.put(name, aligned.filter("ok").select("a", "b"))


def _merged(store: Tables, moved: DataFrame, links: DataFrame) -> DataFrame:
    """node, root of all nodes with a link. moved: the same before ``links``."""
    if moved.count() + links.count() <= EDGES:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(moved.select("node", "root"))
        return components(both).select(F.col("id").alias("node"), F.col("label").alias("root"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = store.put("known", ends.join(moved, "node", "full").select("node", F.coalesce("root", "node").alias("root")))
    of = lambda c, r: known.select(F.col("node").alias(c), F.col("root").alias(r))
    edges = store.put("edges", links.join(of("a", "u"), "a").join(of("b", "v"), "b").filter("u <> v").select("u", "v").distinct())
    label = components(edges)
    return store.put("moved", known.join(label, known["root"] == label["id"], "left").select("node", F.coalesce("label", "root").alias("root")))


def _rooted(entries: DataFrame, moved: DataFrame) -> DataFrame:
    return entries.join(moved, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _several(entries: DataFrame) -> DataFrame:
    """entries (node, n, key, root) of groups of more than one root, with size."""
    group = entries.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("size"))
    return entries.join(group.filter("_lo < _hi").select("key", "size"), "key")


def _direct(opened: DataFrame) -> DataFrame:
    """a, b, a_n, b_n: pairs of different roots in groups of up to SMALL members."""
    a, b = (opened.filter(F.col("size") <= SMALL).select("key", F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("root").alias(f"{c}_root")) for c in "ab")
    return a.join(b, (a["key"] == b["key"]) & (F.col("a") > F.col("b")) & (F.col("a_root") != F.col("b_root"))).select("a", "b", "a_n", "b_n")


def _rare(store: Tables, rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: the close pairs of different roots among rows (node, root, n, text), which share a word that is rare in both.

    Exact: at most d words of either text are outside an alignment of d edits. So of the words
    in an order of rarity and place, the first that the alignment keeps is among the d + 1
    first of both, and its places are at most d apart. The order is the same in all tasks; it
    follows how many texts hold a word of the same one of SLOTS slots. Pairs travel packed by
    blocks of texts, and a text goes once to each block that it is in pairs with.
    """
    rows = store.put("large", rows)
    blocks = min(BLOCKS, rows.count() // BLOCK_TEXTS + 1)
    often = np.zeros(SLOTS, np.int64)
    # A row of fixed size for each task; the sum is all that the driver holds.
    for part in rows.select("text").mapInArrow(_slots, "often binary").toLocalIterator():
        often += np.frombuffer(part["often"], np.int64)
    kept = rows.mapInArrow(lambda b: _rarest(b, often, similarity), "bucket long, words binary")
    pairs = store.put("paired", kept.groupBy("bucket").applyInArrow(lambda t: _paired(t, similarity, blocks), "x long, y long, pairs binary"))
    needed = pairs.groupBy("x", "y").applyInArrow(_ends, "x long, y long, node long").join(rows.select("node", "text"), "node")
    both = pairs.unionByName(needed.select("x", "y", "node", "text"), allowMissingColumns=True)
    return store.put("found", both.groupBy("x", "y").applyInArrow(lambda t: _meet(t, similarity), "a long, b long"))


def _untried(pairs: DataFrame, tried: DataFrame | None, similarity: float) -> DataFrame:
    """a, b, hi, lo of pairs (a, b, a_n, b_n) that can be close and weren't tried in either order."""
    new = pairs.filter(_room(similarity)).select("a", "b").withColumns({"hi": F.greatest("a", "b"), "lo": F.least("a", "b")}).dropDuplicates(["hi", "lo"])
    return new if tried is None else new.join(tried.select("hi", "lo"), ["hi", "lo"], "left_anti")


def _fits(similarity: float) -> Column:
    """Whether a group (key) has a member that is close enough in length: the next longer or shorter one."""
    by = W.partitionBy("key").orderBy("n", "node")
    allowed = lambda longer: F.floor((1 - similarity) * longer + 1e-9)
    up, down = F.lead("n").over(by), F.lag("n").over(by)
    return F.coalesce(up - F.col("n") <= allowed(up), F.lit(False)) | F.coalesce(F.col("n") - down <= allowed(F.col("n")), F.lit(False))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, similarity: float = 0.8, sketches: int = 32, sampled: int = 2) -> DataFrame:
    """One row per input row: doc_id (the input's id), copy_of (smallest id with the
    same text), class_id (smallest id of its near-duplicate class), n_links (verified
    links between different texts of the class), h1, h2 (hashes of its text), keeps
    (whether this row's id and text are the class's smallest).

    Null texts count as empty; all empty texts are copies of each other. A null id
    counts as larger than all others and comes back as null. Rows with one id and
    different texts are told apart. An empty table gives no rows; other columns
    aren't read.
    """
    spark = docs.sparkSession
    store = Tables(spark, "near-dedup")
    t = Safe(docs)
    text = F.coalesce(t.col(text_col), F.lit(""))
    base = t.rows.select(F.coalesce(t.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    # Lengths at which one edit is allowed.
    one = [n for n in range(1, 1000) if int((1 - similarity) * n + 1e-9) == 1] or [2, 0]
    short = one[0], one[-1]
    sketched = base.mapInArrow(lambda b: _sketch(b, k, sketches, sampled, short), "id long, h1 long, h2 long, n long, short string, sketch array<long>")
    whole = store.put("nodes", sketched.groupBy("h1", "h2").agg(F.min("id").alias("copy"), *(F.first(c).alias(c) for c in ("n", "short", "sketch"))))
    clash = store.put("clash", whole.groupBy("h1").agg(F.count("*").alias("_many")).filter("_many > 1"))
    nodes = _named(whole, clash)
    # key: a sketch, which its number j is part of.
    entries = nodes.select("node", "n", F.posexplode("sketch").alias("j", "key")).filter("key <> 0")
    groups = entries.groupBy("key").agg(F.min(F.struct("node", "n")).alias("_l"), F.max("node").alias("_last")).filter("_l.node < _last").select("key", F.col("_l.node").alias("leader"), F.col("_l.n").alias("leader_n"))
    state = store.put("state", entries.join(groups, "key"))
    led = lambda part: part.select(F.col("node").alias("a"), F.col("leader").alias("b"), F.col("n").alias("a_n"), F.col("leader_n").alias("b_n"))
    edits = _one_edit(store, nodes, *short).withColumns({"a_n": F.lit(0), "b_n": F.lit(0)})
    tried = store.put("tried", _untried(led(state.filter("node <> leader")).union(edits), None, similarity))
    # Every member that another one of its group can be close to, whatever the leader's length.
    ends = tried.select(F.explode(F.array("a", "b")).alias("node")).union(state.select("node", _fits(similarity).alias("fits")).filter("fits").select("node"))
    need = ends.distinct().join(nodes.select("node", "h1", "h2", "n", F.col("copy").alias("id")), "node")
    # By the first copy's id as well, so that not all copies of a text meet.
    texts = store.put("texts", base.join(need, ["h1", "h2", "id"]).select("node", "n", "text").dropDuplicates(["node"]))
    links = _verified(store, tried, texts, similarity, "links")
    moved = _merged(store, spark.createDataFrame([], "node long, root long"), links)
    opened = store.put("open", _several(_rooted(state.select("node", "n", "key"), moved)))
    large = opened.filter(F.col("size") > SMALL).select("node", "root").distinct().join(texts, "node")
    direct = _verified(store, store.put("new", _untried(_direct(opened), tried, similarity)), texts, similarity, "direct")
    found = direct.select("a", "b").union(_rare(store, large, similarity)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = store.put("more", found)
    moved, every = _merged(store, moved, found), links.select("a", "b").union(found)
    store.drop("texts", "state", "open", "without", "large", "paired", "found", "direct", "tried", "new", "edges", "known")
    ids = nodes.select("h1", "h2", "node", "copy")
    least = moved.join(ids.select("node", "copy"), "node").groupBy("root").agg(F.min(F.struct("copy", "node")).alias("_m"))
    held = every.join(moved, every["a"] == moved["node"]).groupBy("root").agg(F.count("*").alias("n_links"))
    classes = store.put("classes", moved.join(least, "root").join(held, "root", "left").select("node", F.col("_m.copy").alias("class"), F.col("_m.node").alias("_first"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    named = ids.join(classes, "node", "left").select("h1", "h2", "copy", F.coalesce("class", "copy").alias("class"), (F.coalesce("_first", "node") == F.col("node")).alias("_own"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    found = base.select("id", "h1", "h2").join(named, ["h1", "h2"])
    null = lambda c: F.when(c < LAST, c)
    keeps = (F.col("id") == F.col("class")) & F.col("_own")
    return found.select(null(F.col("id")).alias("doc_id"), null(F.col("copy")).alias("copy_of"), null(F.col("class")).alias("class_id"), "n_links", "h1", "h2", keeps.alias("keeps"))
