"""Toxicity: cumulative-link ordinal regression on sparse word features.

Severity has three grades. The labels only say whether a text is toxic, so the
grades of toxic training texts come from how dense their evidence is: 2 where the
words that mark toxic texts (log odds over the sample) are as dense as in the median
toxic text or denser, else 1. P(grade > k) = sigmoid(w x - cut_k): one weight vector
for all thresholds, with cut_0 < cut_1. The expected severity is the sum of both.

Features: the known words of a text and the beginnings of its longer words, log(1 +
count) each, scaled by their log odds, whatever the text's length, as a few words
make a long text toxic. The vocabulary is
that of a bounded sample; words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramus.llm.arrowtext import LOWER_ALNUM, Words, binary_array, chunks, flat, hashes, mix
from ramus.llm.labelled import training_texts
from ramus.llm.shared import Safe, without
from ramus.operators.storage import Tables

#: Labelled rows that the model is fitted on at most; texts of the sample that a word must be in.
BOUND, MIN_TEXTS = 6000, 4
#: Log odds that a feature must have either way to be learned.
LEAN = 0.5
#: Bytes of the beginnings of longer words that are features too, for languages that compound.
PREFIXES = (4, 6, 8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def token_hashes(vocabulary: pa.Array) -> np.ndarray:
    """For each word a row of hashes: of itself, of its beginnings of PREFIXES bytes (0 where it is shorter)."""
    raw, offsets = flat(vocabulary)
    length = np.diff(offsets)
    out = np.zeros((len(length), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = hashes(vocabulary)
    for i, p in enumerate(PREFIXES):
        some = np.flatnonzero(length > p)
        cut = raw[offsets[some][:, None] + np.arange(p)]
        out[some, 1 + i] = mix(hashes(binary_array(cut.reshape(-1), np.arange(len(some) + 1) * p)) + np.uint64(p))
    return out


def word_counts(column: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of texts, hashes (uint64) and counts of the distinct words and beginnings of words (of those in ``known``, sorted); words of each text."""
    words = Words(column, LOWER_ALNUM, fold=True)
    if not len(words):
        return np.zeros(len(column) + 1, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), words.counts
    table = token_hashes(words.vocabulary)
    if known is not None:
        table = np.where(known[np.minimum(np.searchsorted(known, table), len(known) - 1)] == table, table, 0) if len(known) else np.zeros_like(table)
    distinct, number = np.unique(table, return_inverse=True)
    number = number.reshape(table.shape)[words.ids]
    key = (words.text_of[:, None] * len(distinct) + number)[table[words.ids] != 0]
    key, count = np.unique(key, return_counts=True)
    return np.searchsorted(key // len(distinct), np.arange(len(column) + 1)), distinct[key % len(distinct)], count, words.counts


@dataclass
class Ordinal:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray  # with the log odds in them
    cuts: np.ndarray

    def margin(self, bounds: np.ndarray, hashed: np.ndarray, count: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(bounds) - 1)
        at = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
        value = np.where(self.words[at] == hashed, self.weights[at] * np.log1p(count), 0.0)
        return np.diff(np.concatenate([[0.0], np.cumsum(value)])[bounds])

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > 0) and P(grade > 1)."""
        return _sigmoid(margin[:, None] - self.cuts[None, :])


def fit(bounds: np.ndarray, hashed: np.ndarray, count: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> Ordinal:
    n = len(toxic)
    if not n or not toxic.any() or toxic.all():
        base = 8.0 if not n or not toxic.any() else -8.0
        return Ordinal(np.empty(0, np.uint64), np.empty(0), np.array([base, base + 1]))
    words, of = np.unique(hashed, return_inverse=True)
    text = np.repeat(np.arange(n), np.diff(bounds))
    often = np.bincount(of, minlength=len(words)) >= MIN_TEXTS
    number = np.cumsum(often) - 1
    known = often[of]
    words, of, text, x = words[often], number[of[known]], text[known], np.log1p(count[known])
    bad, good = np.bincount(of, toxic[text], len(words)), np.bincount(of, 1.0 - toxic[text], len(words))
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((1 - toxic).sum() + 1))
    density = np.bincount(text, (odds[of] > 2) * np.expm1(x), n) / np.maximum(sizes, 1)
    grade = np.where(toxic == 1, 1 + (density >= np.median(density[toxic == 1])), 0)
    x = x * odds[of]
    # Adam on the penalised mean log likelihood; cut_1 = cut_0 + exp(gap).
    w, theta = np.zeros(len(words)), np.array([1.0, 0.0])
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    for t in range(1, rounds + 1):
        cuts = np.array([theta[0], theta[0] + np.exp(theta[1])])
        above = _sigmoid(np.bincount(text, w[of] * x, n)[:, None] - cuts)
        upper = np.column_stack([np.ones(n), above])
        lower = np.column_stack([above, np.zeros(n)])
        p = np.maximum(np.take_along_axis(upper - lower, grade[:, None], 1)[:, 0], 1e-12)
        slope_u, slope_l = upper * (1 - upper), lower * (1 - lower)
        at_u, at_l = (np.take_along_axis(s, grade[:, None], 1)[:, 0] / p for s in (slope_u, slope_l))
        by_margin = (at_u - at_l) / n
        # upper of grade g is above cut_{g-1}, lower is above cut_g.
        by_cut = np.array([-(at_u[grade == k + 1].sum() - at_l[grade == k].sum()) / n for k in range(2)])
        gradient = np.concatenate([np.bincount(of, by_margin[text] * x, len(w)) - penalty * w, [by_cut.sum(), by_cut[1] * np.exp(theta[1])]])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, theta = w + step[:-2], theta + step[-2:]
    return Ordinal(words, w * odds, np.array([theta[0], theta[0] + np.exp(theta[1])]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        bounds, hashed, count, sizes = word_counts(batch.column("text"))
        at = pa.array(bounds, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("label"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(hashed.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(count, pa.int64()))], ["_id", "label", "size", "words", "counts"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = BOUND) -> Ordinal:
    sample = training_texts(docs, labels, label, bound)
    rows = sample.mapInArrow(_features, f"_id {dict(sample.dtypes)['_id']}, label int, size long, words array<bigint>, counts array<bigint>")
    rows = Tables(docs.sparkSession, "toxicity").put("features", rows)
    # By Arrow: a few arrays and no Python object for each row.
    texts = rows.select("_id", "label", "size").toArrow().sort_by("_id")
    toxic = (texts["label"].to_numpy() > 0).astype(float)
    if not len(texts) or not toxic.any() or toxic.all():
        return fit(np.zeros(len(texts) + 1, np.int64), np.empty(0, np.uint64), np.empty(0), texts["size"].to_numpy(), toxic)
    # Only features that are in enough texts and lean to one side come to the driver.
    each = rows.select("_id", (F.col("label") > 0).cast("int").alias("bad"), F.explode(F.arrays_zip("words", "counts")).alias("f")).select("_id", "bad", "f.words", "f.counts")
    total = each.groupBy("words").agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g")).filter(F.col("b") + F.col("g") >= MIN_TEXTS)
    lean = F.log((F.col("b") + 0.5) / (toxic.sum() + 1)) - F.log((F.col("g") + 0.5) / ((1 - toxic).sum() + 1))
    used = each.join(total.filter(F.abs(lean) >= LEAN).select("words"), "words").select("_id", "words", F.col("counts").cast("float").alias("counts")).toArrow()
    of = pc.index_in(used["_id"], texts["_id"]).to_numpy()
    order = np.lexsort((used["words"].to_numpy(), of))
    bounds = np.searchsorted(of[order], np.arange(len(texts) + 1))
    return fit(bounds, used["words"].to_numpy()[order].view(np.uint64), used["counts"].to_numpy()[order].astype(float), texts["size"].to_numpy(), toxic)


def _score(batches: Iterator[pa.RecordBatch], model: Ordinal) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        bounds, hashed, count, _ = word_counts(batch.column("text"), model.words)
        above = model.above(model.margin(bounds, hashed, count))
        grade = (above > 0.5).sum(1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("rec"), pa.array(above[:, 0]), pa.array(above.sum(1)), pa.array(grade)], ["rec", "p_toxic", "severity", "grade"])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", bound: int = BOUND, cut: float = 0.4, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: rec (struct of ``keep``, by default all columns but the
    text), p_toxic, severity (expected grade, 0 to 2), grade (0 to 2, likeliest by the
    thresholds), toxic (p_toxic >= cut; below a half, as toxic texts are rare).

    Rows whose crc32(id) mod 5 is 0 are never learned from, so that they can tell the
    accuracy. Null and empty texts have the severity of a text without known words.
    Without labels, or toxic ones, all texts are of grade 0. Input columns may have
    any names; an empty table gives no rows. Scoring is a projection.
    """
    spark, t, mark = docs.sparkSession, Safe(docs, without(docs, text_col) if keep is None else keep), Safe(labels)
    model = spark.sparkContext.broadcast(learn(t.rows.select(t.col(id_col).alias("doc_id"), t.col(text_col).alias("text")), mark.rows.select(mark.col(id_col).alias("doc_id"), mark.col(label).alias("label")), "label", bound))
    base = t.rows.select(t.rec, t.col(text_col).alias("text"))
    scored = base.mapInArrow(lambda b: _score(b, model.value), t.schema("p_toxic double, severity double, grade int"))
    return t.out(scored).withColumn("toxic", F.col("p_toxic") >= cut)
