"""Names that clash, rows that share an id, and the audit of sources against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ramus.llm.decontaminate import decontaminate
from ramus.llm.license_scan import license_scan
from ramus.llm.lm_score import lm_score
from ramus.llm.near_dedup import near_dedup
from ramus.llm.quality_knn import quality_knn
from ramus.llm.quality_rules import quality_rules
from ramus.llm.sentencepiece_codec import sentencepiece_codec
from ramus.llm.shared import Safe
from ramus.llm.source_divergence import source_divergence
from ramus.llm.substring_dedup import substring_dedup
from ramus.llm.token_files import token_output
from ramus.llm.toxicity import toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
NAMES = ["a.b", "rec", "_text", "Text", "uid", "c0", "x`y", "key", "_w", "near"]
WORDS = "alpha beta gamma delta the of and to in is cc by rights".split()


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(60)), "en", "s", *(f"{c}{i}" for c in NAMES)) for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"n{k} string" for k in range(len(NAMES)))
    return spark.createDataFrame(rows, schema).toDF("doc_id", "text", "lang", "source", *NAMES)


OPERATORS = {
    "substring_dedup": lambda d, b, q: substring_dedup(d),
    "license_scan": lambda d, b, q: license_scan(d),
    "decontaminate": lambda d, b, q: decontaminate(d, b),
    "decontaminate_slim": lambda d, b, q: decontaminate(d, b, keep=["doc_id", "a.b", "rec"]),
    "sentencepiece_codec": lambda d, b, q: sentencepiece_codec(d, public_tokenizers.path("piece_bpe_32k.model")),
    "lm_score": lambda d, b, q: lm_score(d, q),
    "quality_rules": lambda d, b, q: quality_rules(d),
    "quality_rules_slim": lambda d, b, q: quality_rules(d, keep=["x`y", "a.b"]),
    "quality_knn": lambda d, b, q: quality_knn(d, q, bound=10),
    "toxicity": lambda d, b, q: toxicity(d, q, bound=10),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, clashing, name):
    bench = spark.createDataFrame([(1, "alpha beta gamma", "z")], "item_id long, text string, n string").toDF("item_id", "text", "a.b")
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2, "z") for i in range(12)], "doc_id long, quality int, toxic int, n string").toDF("doc_id", "quality", "toxic", "a.b")
    found = OPERATORS[name](clashing, bench, labels)
    rows = found.collect()
    assert len(rows) == 12
    kept = found.schema["rec"].dataType.names
    for row in rows:
        values = dict(zip(kept, row.rec))
        assert values["a.b"][:3] == "a.b" and all(values[c] == f"{c}{values['doc_id']}" for c in NAMES if c in values and "doc_id" in values)
    if "slim" not in name:
        assert [c for c in kept if c != "text"] == ["doc_id", "lang", "source", *NAMES]


def test_clashing_names_of_operators_without_rec(clashing):
    assert near_dedup(clashing).count() == 12 and token_output(clashing, public_tokenizers.path("byte_bpe_50k.json")).count() == 12
    assert source_divergence(clashing).filter("part = 'term'").count() == 0


def test_names_are_looked_up_as_written(spark):
    table = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("x", "X", "y.z")
    t = Safe(table, ["X", "y.z"])
    assert t.rows.select(t.col("x"), t.col("X"), t.col("Y.Z")).first()[:] == (1, 2, 3)
    assert t.out(t.rows.select(t.rec)).first().rec.asDict() == {"X": 2, "y.z": 3}
    with pytest.raises(ValueError):
        t.col("nothing")


def test_substring_dedup_tells_rows_with_one_id_apart(spark):
    """Many rows with a null id, or with one id: none loses words that an earlier id doesn't have."""
    r = random.Random(9)
    prose = lambda i: " ".join(f"u{i}w{k}" for k in range(14))
    passage = " ".join(r.choice(WORDS) for _ in range(20))
    rows = [(0, passage)] + [(None, prose(i)) for i in range(40_000)] + [(None, f"v{i} {passage}") for i in range(40_000)]
    rows += [(5, prose(-i)) for i in range(1, 200)] + [(5, f"{passage} q{i}") for i in range(200)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("rec.doc_id", "n_words", "n_removed")
    assert Counter(tuple(x) for x in got.collect()) == Counter({(0, 20, 0): 1, (None, 14, 0): 40_000, (None, 21, 20): 40_000, (5, 14, 0): 199, (5, 21, 20): 200})


def audited(rows, least=10, top=10):
    """The audit by plain Python's integers."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, words = lang or "", source or "", term.findall((text or "").translate(low))
        groups[lang].add(source)
        count[lang, source].update(words)
        held[lang].update(set(words))
    out = Counter()
    for lang, sources in groups.items():
        kept = sorted(w for w, n in held[lang].items() if n >= least)
        every = Counter()
        for s in sources:
            every.update({w: count[lang, s][w] for w in kept})

        def rate(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        own, q = {s: rate(count[lang, s]) for s in sources}, rate(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(own[s][w], own[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, f(own[s][w], q[w])) for w in kept if count[lang, s][w] and own[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, s, part, item, value, rank] += 1
    return out


def test_source_divergence(spark):
    r = random.Random(6)
    words = ["Alpha", "béta", "ÉTÉ", "中文", "x1y2", "tail-end", "a", "B", "ﬀ", "\U0001f600", "it's"]
    rows = []
    for i in range(260):
        source = r.choice(["web", "web", "web", "news", None, "", "Z", "é"])
        text = r.choice([None, "", " 12 !", *[" ".join(r.choice(words[(len(source or "") % 3) :]) for _ in range(r.randint(1, 40))) for _ in range(8)]])
        rows.append((i, text, r.choice(["en", "en", "de", None]), source))
    rows += [(300, None, "xx", "one"), (301, "rare word", "xx", "two"), (302, "", "xx", None), (303, "alone", "yy", "one")] + [rows[5]] * 12
    rows += [(400, "long " * 60_000 + "tail", "en", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    order = ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(tuple(x) for x in source_divergence(docs).select(*order).collect()) == audited(rows)
    assert Counter(tuple(x) for x in source_divergence(docs, min_documents=1, top=3).select(*order).collect()) == audited(rows, 1, 3)
    assert source_divergence(docs.limit(0)).count() == 0
    alone = source_divergence(docs.filter("lang = 'yy'"))
    assert alone.count() == 0 and dict(alone.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_source_divergence_of_large_counts(spark):
    """Rates beyond 64 bits: the product of the count and 10^9."""
    from pyspark.sql import functions as F

    from ramus.llm.source_divergence import _rate

    n, total, v = 9 * 10**15, 10**18, 12345
    row = spark.range(1).select(_rate(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * v)
