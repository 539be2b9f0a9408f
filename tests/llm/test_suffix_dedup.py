"""The run-length index and the byte-level dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ramus.llm import suffix_dedup as module
from ramus.llm.arrowtext import flat
from ramus.llm.suffix_dedup import Index, marked, suffix_dedup, super_kmers

SCHEMA = "doc_id long, text string, lang string, key string, part int"


def bytes_(strings):
    return flat(pa.array(strings, pa.large_binary()))


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcd", bytes(range(256))])
def test_index_streams_matching_statistics(alphabet):
    r = random.Random(len(alphabet))
    some = lambda a, b: bytes(r.choice(alphabet) for _ in range(r.randint(a, b)))
    for _ in range(25):
        texts, window = [some(15, 60) for _ in range(r.randint(1, 8))], r.choice([14, 15, 20])
        texts += [t[r.randint(0, 5) :] + b"x" * r.randint(0, 3) for t in texts]
        raw, offsets = bytes_(texts)
        index = Index(raw, offsets, window)
        assert len(index.start) <= len(raw) + len(texts) and (index.size > 0).all()
        asked = [some(1, 40) for _ in range(5)] + texts + [r.choice(texts)[3:] + r.choice(texts)[:20] for _ in range(6)]
        place, at = {}, 0
        for t in texts:
            for i in range(len(t) - window + 1):
                place.setdefault(t[i : i + window], at + i)
            at += len(t) + 1
        want = [place.get(t[i : i + window], -1) if i + window <= len(t) else -1 for t in asked for i in range(len(t))]
        assert index.stream(*bytes_(asked), window).tolist() == want


def test_index_compresses_what_repeats():
    r = random.Random(3)
    one = bytes(r.choice(b"abcdefgh ") for _ in range(2000))
    runs = [len(Index(*bytes_([one] * n), 100).start) for n in (1, 8)]
    assert runs[1] < 1.3 * runs[0]


def test_super_kmers_hold_every_window(monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(module, "BLOCK", 37)
    texts = [b"", b"a" * 60, b"xyz" * 30, bytes(r.choice(b"abc") for _ in range(200)), b"short", bytes(r.randrange(256) for _ in range(90))]
    raw, offsets = bytes_(texts)
    held, by = Counter(), {}
    for first, length, least, _ in super_kmers(raw, offsets, 20, 8):
        for a, n, m in zip(first.tolist(), length.tolist(), least.tolist()):
            for i in range(a, a + n - 19):
                held[i] += 1
                assert by.setdefault(raw[i : i + 20].tobytes(), m) == m
    assert held == Counter(a + i for a, t in zip(offsets.tolist(), texts) for i in range(len(t) - 19))


def brute(rows, window):
    """n_bytes, n_removed, n_spans and hash of each row."""
    order = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t, *_ in rows:
        x = (t or "").encode()
        for k in range(len(x) - window + 1):
            w = x[k : k + window]
            first[w] = min(first.get(w, order(i)), order(i))
    out = Counter()
    for i, t, *_ in rows:
        x, seen = (t or "").encode(), {}
        gone = np.zeros(len(x) + 1, np.int8)
        for k in range(len(x) - window + 1):
            w = x[k : k + window]
            if first[w] < order(i) or seen.setdefault(w, k) < k:
                gone[k : k + window] = 1
        left = bytes(b for b, g in zip(x, gone) if not g)
        out[i, len(x), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("rec.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def cases():
    r = random.Random(8)
    words = ["alpha", "Béta", "gamma,", "the", "of", "ß", "中文", "tail", "x" * 30]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(60)) for _ in range(n))
    passage, other = prose(60), prose(40)
    texts = [None, "", "a", "z" * 99, "z" * 100, "z" * 101, "z" * 400, "ab" * 300, "abc" * 90 + passage, passage, passage, prose(20) + passage[7:] + prose(30), passage[: len(passage) // 2] + other, other + " " + other, prose(3000), prose(5) + other[10:260] + passage[100:300]]
    edited = prose(150)
    texts += [edited[:k] + "!" + edited[k + 1 :] for k in (20, 300, 310, 420, 800)]
    rows = [(i * 7 % 53, t, "en", "k", i) for i, t in enumerate(texts)]
    # Null ids, one id for different texts, rows that repeat.
    rows += [(None, passage, "en", None, 1), (None, passage + other, None, "k", 2), (None, prose(40), "x", "k", 1), (3, other + passage, "en", "k", 1), (3, other + "?", "en", "k", 1), (3, other + other, "en", "k", 1)]
    return rows + [rows[9], rows[9], rows[6]]


@pytest.mark.parametrize("window,gram", [(100, 32), (40, 12)])
def test_suffix_dedup(spark, monkeypatch, window, gram):
    rows = cases()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = suffix_dedup(docs, window=window, gram=gram)
    assert found(got) == brute(rows, window)
    for row in got.select("rec.*", "spans", "kept", "n_removed").collect():
        spans = [(s.first, s.end) for s in row.spans]
        assert sum(b - a for a, b in spans) == row.n_removed and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert found(suffix_dedup(docs.withColumnRenamed("lang", "a.b").withColumnRenamed("key", "text2"), window=window, gram=gram)) == brute(rows, window)


def test_suffix_dedup_of_little(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup(empty).count() == 0
    rows = [(1, None, "", "", 1), (2, "", "", "", 1), (3, "short", "", "", 1)]
    assert found(suffix_dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 100)


def test_suffix_dedup_of_hot_passages_and_long_texts(spark):
    """A passage that most texts hold in their own surroundings, and a text of over a megabyte with a period."""
    r = random.Random(12)
    line = "this line stands in most of the documents of the whole corpus, over and over again, and is longer than a window"
    rows = [(i, " ".join(str(r.random()) for _ in range(8)) + line * (1 + i % 2) + str(i), "", "", 1) for i in range(400)]
    want = brute(rows, 100)
    long = "".join(chr(97 + r.randrange(26)) for _ in range(1000))
    rows += [(1000, long * 1500, "", "", 1)]
    want[1000, 1_500_000, 1_499_000, 1, hashlib.sha256(long.encode()).hexdigest()] += 1
    assert found(suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(6))) == want


def test_marked_by_identity():
    """Rows of one key don't remove each other's bytes; their own repeats and smaller keys do."""
    text = bytes(range(65, 91)) * 2
    raw, offsets = bytes_([text, text, text, text])
    which, first, end = marked(np.array([5, 5, 5, 9]), np.array([0, 1, 0, 2]), np.array([0, 0, 80, 0]), raw, offsets, 40, 12)
    assert sorted(zip(which.tolist(), first.tolist(), end.tolist())) == [(2, 0, 52), (3, 0, 52)]
