"""Each operator against a brute-force version on small tables with nulls, empties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ramus.llm.arrowtext import Words, hashes
from ramus.llm.decontaminate import decontaminate
from ramus.llm.license_scan import license_scan
from ramus.llm.lm_score import MU, Block, lm_score
from ramus.llm.near_dedup import band_distance, close, full_distance, near_dedup, order_min_hash
from ramus.llm.quality_knn import quality_knn
from ramus.llm.quality_rules import quality_rules
from ramus.llm.sentencepiece_codec import encode, load, sentencepiece_codec, viterbi, viterbi_long
from ramus.llm.substring_dedup import SLOTS, frequent_slots, substring_dedup, super_kmers
from ramus.llm.token_files import Shard, pack, shard_bytes, token_output, unpack
from ramus.llm.toxicity import toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, key string, rec int"
SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def texts():
    r = random.Random(5)
    words = ["alpha", "Béta", "gamma,", "delta.", "the", "of", "ß", "中文", "x|y", "tail"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(60)
    out = [None, "", "  \n\t", "one", "cc by", prose(9), passage, passage, passage + " more", prose(30) + "\n" + passage + "\n" + prose(20)]
    out += [prose(200), prose(3000), "Der " * 300, "Licensed under CC BY-NC 4.0.\nAll rights reserved. General  Public-License", "Released under the MIT License."]
    edited = prose(120).split()
    for i in range(4):
        copy = list(edited)
        copy[20 * i + 5] = f"edit{i}"
        out.append(" ".join(copy))
    return out + ["same line here\n" * 3 + prose(55), "a # $ % & | < > b\x00c"]


@pytest.fixture(scope="module")
def rows():
    made = [(i * 3 % 31, t, "en" if i % 2 else None, "s" if i % 3 else None, "k", i) for i, t in enumerate(texts())]
    # A null id, and a row twice.
    return made + [(None, made[6][1], "en", "s", "k", 1), made[7], made[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_substring_dedup(docs, rows, empty):
    order = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t, *_ in rows:
        w = SPACE.findall(t or "")
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, order(i)), order(i))
    want = Counter()
    for i, t, *_ in rows:
        w = SPACE.findall(t or "")
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < order(i):
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = substring_dedup(docs)
    assert bag(got.select("rec.doc_id", "n_words", "n_removed", "kept_sha256")) == want
    assert {r.cleaned for r in got.filter("n_removed = 0").select("cleaned").collect()} <= {t or "" for _, t, *_ in rows}
    assert substring_dedup(empty).count() == 0
    # Whatever grams count as frequent (few, all, none), the rows are the same.
    for share in (0.02, 1e-9, 2.0):
        assert bag(substring_dedup(docs, share=share).select("rec.doc_id", "n_words", "n_removed", "kept_sha256")) == want


def test_frequent_grams(spark):
    """A gram of every text is found whatever the partitions, and draws its windows no longer."""
    r = random.Random(3)
    phrases = ["of the land and", "in the name of all", "all rights of this", "as it is and was"]
    texts = [" ".join(f"{r.choice(phrases)} {r.random()}" for _ in range(40)) for _ in range(40)] + ["a " * 50, " ".join(phrases), " ".join(phrases)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    slots = frequent_slots(docs, 13, 3, 0.005)
    assert 1 <= slots.sum() <= 200
    words = Words(pa.array(texts))
    drawn = [Counter(), Counter()]
    for c, often in zip(drawn, (None, slots)):
        first, length, least = super_kmers(words, 13, 3, often)
        assert (length >= 13).all() and sum(length - 12) == sum(max(len(t.split()) - 12, 0) for t in texts)
        for k, n in zip(least.tolist(), (length - 12).tolist()):
            c[k] += n
    total = sum(drawn[0].values())
    assert all(slots[k % SLOTS] for k, n in drawn[0].items() if n >= 0.005 * total)
    assert max(drawn[1].values()) < max(drawn[0].values()) / 2
    # Equal windows keep equal minimisers.
    least = {}
    first, length, found = super_kmers(words, 13, 3, slots)
    told = [w for t in texts for w in t.split()]
    for a, n, k in zip(first.tolist(), length.tolist(), found.tolist()):
        for i in range(a, a + n - 12):
            assert least.setdefault(tuple(told[i : i + 13]), k) == k
    assert not frequent_slots(docs.limit(0), 13, 3, 0.005).any()


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = sorted(token_output(docs, path, digest=False).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t, *_ in rows)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    crc = token_output(docs, path).collect()
    assert Counter((r.start, r.ids_crc32) for r in crc) == Counter((r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got)
    assert token_output(empty, path).count() == 0


def test_token_files_read_special_strings_as_a_plain_call_does(spark):
    from tokenizers import Tokenizer

    path, r, end = public_tokenizers.path("byte_bpe_50k.json"), random.Random(6), "<|endoftext|>"
    parts = [end, end[:-1], end[1:], " ", "  ", "\n", "a", "don't", "It's", "é", "中", "12", "!", "|", "<", ">", "\t"]
    table = [f"hello {end} world", end, end * 3, f"a  {end}  b"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(600)]
    got = {x.doc_id: x.ids for x in token_output(spark.createDataFrame(list(enumerate(table)), "doc_id long, text string").repartition(2), path, digest=False).collect()}
    tokenizer = Tokenizer.from_file(path)
    assert all(got[i] == [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(table))
    assert 50256 in got[0]


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    assert (unpack(pack(ids, bits), bits, len(ids)) == ids).all()
    shard = Shard(shard_bytes(np.array([3, 4]), np.zeros(2), np.array([700, 1000]), ids, bits, 128))
    assert (shard.document(1) == ids[700:]).all() and (shard.ids(120, 300) == ids[120:300]).all() and not len(shard.ids(5, 5))


def test_license_scan(docs, rows, empty):
    want = Counter()
    for i, t, *_ in rows:
        w, at, labels = ALNUM.findall(low(t)), [], set()
        for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
    got = license_scan(docs)
    assert bag(got.select("rec.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == want
    assert {"mit-line"} <= {x for r in got.collect() for x in r.labels.split(",")}
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got.collect())
    assert license_scan(empty).count() == 0


def test_decontaminate(spark, docs, rows, empty):
    passage = rows[6][1]
    items = [(1, " ".join(passage.split()[5:40]).upper().replace("É", "é")), (2, "mit license"), (None, "nothing of this occurs"), (3, None), (4, " "), (10, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("rec", docs.sparkSession.range(1).select("id").schema and __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    windows = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    want = Counter()
    for i, t, *_ in rows:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= own
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    got = decontaminate(docs, bench)
    assert bag(got.select("rec.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want
    assert decontaminate(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate(docs, bench.limit(0)).collect())


def test_sentencepiece(docs, rows, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = load(path)
    got = sentencepiece_codec(docs, path).collect()
    assert all(r.round_trip for r in got) and Counter(r.decoded for r in got) == Counter(t or "" for _, t, *_ in rows)
    assert sentencepiece_codec(empty, path).count() == 0
    score = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k == 0}

    def best(x):
        table = [0.0] + [-np.inf] * len(x)
        for t in range(1, len(x) + 1):
            for n in range(1, min(t, model.trie.depth) + 1):
                table[t] = max(table[t], table[t - n] + score.get(x[t - n : t], -np.inf))
        return table[-1]

    for word in ["the", "unbelievable", "Straße", "aaaaaaaab", "x"]:
        ids, _ = encode(pa.array([word]), model)
        assert abs(sum(model.scores[i] for i in ids) - best(("▁" + word).encode())) < 1e-6


def test_sentencepiece_of_long_texts_without_spaces(spark):
    import time

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, r = load(path), random.Random(8)
    score = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k == 0}

    def best(text):
        x, table = text.encode(), [0.0]
        for t in range(1, len(x) + 1):
            table.append(-np.inf)
            for n in range(1, min(t, model.trie.depth) + 1):
                table[t] = max(table[t], table[t - n] + score.get(x[t - n : t], -np.inf))
            for w in range(1, min(4, t) + 1):
                own = x[t - w : t]
                if (own[0] & 0xC0) != 0x80 and len(own.decode("utf-8", "ignore")) == 1 and len(own.decode("utf-8", "ignore").encode()) == w and own not in score:
                    table[t] = max(table[t], table[t - w] + model.floor)
        return table[-1]

    def scored(ids):
        total, run = 0.0, 0
        data = b""
        for i in [*ids, -1]:
            if i >= 0 and model.kinds[i] == 1:
                data += bytes([int(model.pieces[i][3:5], 16)])
                continue
            total += len(data.decode()) * model.floor
            data = b""
            total += model.scores[i] if i >= 0 else 0.0
        return total

    parts = ["the", "ing", "zz", "é", "中", "\u2603", "\U0001f600", "\x01", "9", "=", "AbC"]
    for _ in range(30):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 60)))
        long, short = viterbi_long(model, np.frombuffer(text.encode(), np.uint8)), viterbi(model, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]
        assert long.tolist() == short.tolist() and scored(long) == pytest.approx(best(text))
    blob = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/") for _ in range(1_000_000))
    began = time.time()
    row = sentencepiece_codec(spark.createDataFrame([(1, blob + "\u2603")], "doc_id long, text string"), path).first()
    assert row.round_trip and row.decoded == blob + "\u2603" and time.time() - began < 60


def losses_by_hand(rows, marked, mu=MU):
    """Both models' mean losses of each row's words and its end, the row left out, with counters."""
    told = [SPACE.findall(r[1] or "") for r in rows]
    seqs = [[None, *w, None] if w else [] for w in told]
    word, pair = Counter(), Counter()
    for s in seqs:
        word.update(s[1:])
    kinds = len(word)
    found = []
    for own, row in zip(seqs, rows):
        means = []
        for model in (lambda r: r[0] in marked, lambda r: True):
            word, pair = Counter(), Counter()
            for s, r in zip(seqs, rows):
                if r is not row and model(r):
                    word.update(s[1:])
                    pair.update(zip(s, s[1:]))
            total = sum(word.values())
            p = [(pair[v, w] + mu * (word[w] + 1) / (total + kinds)) / (word[v] + mu) for v, w in zip(own, own[1:])]
            means.append(-sum(np.log(p)) / max(len(p), 1))
        found.append((row[0], max(len(own) - 1, 0), *means))
    return found


def test_lm_score(spark, docs, rows, empty):
    rows = [tuple(r) for r in rows]
    labels = spark.createDataFrame([(9, 1), (18, 1), (15, 1), (21, 0), (None, 1), (9, 0), (777, 1)], "doc_id long, quality int")
    got = lm_score(docs, labels).select("rec.doc_id", "n_tokens", "target_loss", "background_loss", "score").collect()
    want = losses_by_hand([list(r) for r in rows], {9, 18, 15})
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert (g.doc_id, g.n_tokens) == w[:2]
        assert (g.target_loss, g.background_loss, g.score) == pytest.approx((w[2], w[3], w[2] - w[3]))
    assert all(r.score == 0 for r in got if not r.n_tokens)
    assert lm_score(empty, labels).count() == 0 and lm_score(docs, labels.limit(0)).count() == len(rows)
    whole = lm_score(docs.withColumnRenamed("lang", "block").withColumnRenamed("key", "ids"), labels, keep=["block", "ids", "doc_id"])
    assert whole.count() == len(rows) and whole.select("rec.*").columns == ["block", "ids", "doc_id"]


def test_lm_score_sums_over_blocks(spark):
    """Many blocks and one long text against counters; a document that occurs twice has less loss than alone."""
    r = random.Random(8)
    prose = lambda n: " ".join(f"w{int(r.paretovariate(0.7)) % 5000}" for _ in range(n))
    rows = [(i, prose(r.randint(20, 200))) for i in range(60)] + [(60, prose(20_000))]
    rows += [(61, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int")
    got = {x.doc_id: x for x in lm_score(docs, labels).select("rec.doc_id", "n_tokens", "target_loss", "background_loss").collect()}
    for i, n, target, background in losses_by_hand([list(x) for x in rows], set(range(0, 60, 3))):
        assert got[i].n_tokens == n and (got[i].target_loss, got[i].background_loss) == pytest.approx((target, background))
    alone = {x.doc_id: x for x in lm_score(docs.filter("doc_id < 61"), labels, mu=MU).select("rec.doc_id", "background_loss").collect()}
    assert got[3].background_loss < alone[3].background_loss


def test_lm_score_is_a_distribution():
    """The model's probabilities of all words after a word sum to 1."""
    words = hashes(pa.array([b"a", b"b", b"c"], pa.large_binary()))
    learned = Block(words, np.array([0, 1, 2, 1, 0, 0]), np.array([4, 0, 2]))
    count, total = learned.counted(), int(learned.size.sum())
    for context in range(3):
        mass = 0.0
        for word in (0, 1, 2, None):
            asked = Block(words, np.array([context] + ([] if word is None else [word])), np.array([1 if word is None else 2]))
            n = np.array([dict(zip(learned.grams.tolist(), count.tolist())).get(g, 0) for g in asked.grams.tolist()])
            p = (n[asked.one] + 1) / (total + 4)
            mass += ((n[asked.two] + 10 * p) / (n[asked.one][asked.previous] + 10))[1]
            loss = asked.losses(n, total, 4, np.zeros(1, bool), asked.own(), 10.0)[0]
            assert loss == pytest.approx(-np.log((n[asked.two] + 10 * p) / (n[asked.one][asked.previous] + 10)).mean())
        assert mass == pytest.approx(1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_alignment():
    r = random.Random(1)
    for _ in range(800):
        a = [r.randint(0, 4) for _ in range(r.randint(0, 25))]
        b = [x if r.random() < 0.85 else r.randint(0, 9) for x in a if r.random() < 0.95] + [7] * r.randint(0, 2)
        d = distance(a, b)
        assert full_distance(a, b) == d
        assert all(band_distance(a, b, k) == (d if d <= k else None) for k in (1, 2, 4, 8))
        assert close(np.array(a, int), np.array(b, int), 0.8) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_near_dedup(docs, rows, empty):
    got = {(r.doc_id, r.h1): r for r in near_dedup(docs).collect()}
    assert len(near_dedup(docs).collect()) == len(rows)
    seen = [(i, t or "") for i, t, *_ in rows]
    distinct = sorted({t for _, t in seen})
    numbers = {w: k for k, w in enumerate(sorted({w for t in distinct for w in SPACE.findall(t)}))}
    words = {t: np.array([numbers[w] for w in SPACE.findall(t)], int) for t in distinct}
    link = {t: {u for u in distinct if len(words[t]) and len(words[u]) and close(words[t], words[u], 0.8)} | {t} for t in distinct}
    by_text = {}
    for i, t in seen:
        by_text.setdefault(t, []).append((1 << 63) - 1 if i is None else i)
    for i, t in seen:
        group, todo = set(), [t]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += link[x]
        want = min(k for x in group for k in by_text[x])
        assert [r.class_id for (k, _), r in got.items() if k == i and r.copy_of == (None if min(by_text[t]) == (1 << 63) - 1 else min(by_text[t]))][0] == want
    assert near_dedup(empty).count() == 0


def test_near_dedup_in_groups_with_another_leader(spark):
    # Texts that share a passage, in pairs; other parameters than the defaults, so that few sketches agree.
    r = random.Random(2)
    passage, table = [f"p{i}" for i in range(20)], []
    for n in range(16):
        own = [f"{n}w{k}" for k in range(40)]
        edited = list(own)
        for k in r.sample(range(40), 7):
            edited[k] = f"{n}e{k}"
        table += [" ".join(own[:20] + passage + own[20:]), " ".join(edited[:20] + passage + edited[20:])]
    sketch = order_min_hash(pa.array(table), 5, 16, 2)
    agree = {n for n in range(16) if (sketch[2 * n] == sketch[2 * n + 1]).any()}
    docs = spark.createDataFrame(list(enumerate(table)), "doc_id long, text string")
    by = {r.doc_id: r.class_id for r in near_dedup(docs, k=5, sketches=16, sampled=2).collect()}
    assert {n for n in range(16) if by[2 * n] == by[2 * n + 1]} == agree


def test_near_dedup_in_large_groups_leaves_out_no_close_pair(spark):
    """Pairs of many lengths that share a passage, so that most members can't be close to a group's leader."""
    r = random.Random(7)
    passage, table = [f"p{i}" for i in range(30)], []
    for n in range(60):
        own = [f"{n}w{k}" for k in range(40 + 4 * n)]
        edited = list(own)
        for k in r.sample(range(len(own)), int(0.18 * (len(own) + 30))):
            edited[k] = f"{n}e{k}"
        table += [" ".join(own[:20] + passage + own[20:]), " ".join(edited[:20] + passage + edited[20:])]
    sketch = order_min_hash(pa.array(table), 3, 4, 1)
    assert max(Counter(sketch[:, j].tolist()).most_common(1)[0][1] for j in range(4)) > 32
    agree = {n for n in range(60) if (sketch[2 * n] == sketch[2 * n + 1]).any()}
    docs = spark.createDataFrame(list(enumerate(table)), "doc_id long, text string")
    by = {r.doc_id: r.class_id for r in near_dedup(docs, sketches=4, sampled=1).collect()}
    assert len(set(by.values())) >= 60 and agree <= {n for n in range(60) if by[2 * n] == by[2 * n + 1]}


def test_near_dedup_finds_what_its_threshold_accepts(spark):
    r, table = random.Random(4), []
    for n in range(90):
        own = [f"{n}w{k}" for k in range(100)]
        edited = list(own)
        for k in r.sample(range(100), 10 + 5 * (n % 3)):
            edited[k] = f"{n}e{k}"
        table += [" ".join(own), " ".join(edited)]
    short = ["a b c d e", "a b X d e", "f g h i", "f g Y h i", "k l m n o p q r s", "k l m n Z p q r s", "t u v w", "t u v X", "1 2 3 4 5", "1 2 3 5 4"]
    docs = spark.createDataFrame(list(enumerate(table + short)), "doc_id long, text string")
    by = {r.doc_id: r.class_id for r in near_dedup(docs).collect()}
    assert [by[180 + i] - 180 for i in range(10)] == [0, 0, 2, 2, 4, 4, 6, 7, 8, 9]
    found = [sum(by[2 * n + 1] == by[2 * n] for n in range(q, 90, 3)) for q in range(3)]
    print("found of 30 at 0.9, 0.85, 0.8:", found)
    assert found[:2] == [30, 30] and found[2] >= 29


def test_quality_rules(docs, rows, empty):
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w = SPACE.findall(t)
        often, covered = Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if often[tuple(w[k : k + 3])] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed] += 1
    names = ["rec.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for keep in (None, ["doc_id"]):
        got = quality_rules(docs, keep=keep)
        assert bag(got.select(*names)) == want
        assert not any(r.kept and r.base_failed for r in got.collect())
    assert quality_rules(empty).count() == 0


def labelled(spark):
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("ta", "ri", "mo", "ses") for b in ("ne", "lo", "kir", "bat")]
    made = []
    for i in range(400):
        w = [r.choice(words) for _ in range(60)]
        bad, rude = i % 4 == 0, i % 5 == 1
        if rude:
            w[10] = w[30] = "idiot"
        made.append((i, (" | " if bad else " ").join(w), int(not bad), int(rude)))
    made.append((1000, None, 1, 0))
    made.append((1001, "", 0, None))
    return spark.createDataFrame(made, "doc_id long, text string, quality int, toxic int").repartition(3)


def test_classifiers(spark, empty):
    table = labelled(spark)
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "quality", "toxic")
    truth = {r.doc_id: r for r in table.collect()}
    got = quality_knn(docs, labels).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.rec.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == truth[r.rec.doc_id].quality for r in got if r.rec.doc_id < 400)
    rude = toxicity(docs, labels).collect()
    assert all(r.toxic == (truth[r.rec.doc_id].toxic == 1) for r in rude if r.rec.doc_id < 400)
    assert all(0 <= r.severity <= 2 for r in rude)
    for f in (quality_knn, toxicity):
        assert f(empty.select("doc_id", "text"), labels).count() == 0
        assert f(docs, labels.limit(0)).count() == len(truth)
