"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled texts gives a term weighting, a truncated singular
value decomposition (randomised subspace iteration on the driver; the matrix is
bound x features) and the labelled points. Both are broadcast: features x rank and
bound x rank numbers, whatever the corpus. Every document's cosine with every
labelled point is computed exactly, in blocks, and the nearest vote with their
similarities. No shuffle of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramus.llm.arrowtext import chunks
from ramus.llm.labelled import fold_of, training_texts
from ramus.llm.shared import Safe, without
from ramus.llm.textfeatures import stylistic

#: Labelled rows that the model is fitted on at most; hashed features; latent dimensions; voters.
BOUND, FEATURES, RANK, NEIGHBOURS = 4000, 4096, 48, 25


@dataclass
class Latent:
    idf: np.ndarray
    basis: np.ndarray  # features x rank
    points: np.ndarray  # labelled rows x rank, of length 1
    labels: np.ndarray
    neighbours: int

    def project(self, bounds: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Unit vectors; 0 for texts without features."""
        out = np.zeros((len(bounds) - 1, self.basis.shape[1]))
        some = np.flatnonzero(np.diff(bounds) > 0)
        if len(some):
            for lo in range(0, len(some), 256):
                own = some[lo : lo + 256]
                a, b = bounds[own[0]], bounds[own[-1] + 1]
                out[own] = np.add.reduceat(self.basis[slots[a:b]] * (np.sqrt(weights[a:b]) * self.idf[slots[a:b]])[:, None], bounds[own] - a)
        return unit(out)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out, k = np.full(len(vectors), prior), min(self.neighbours, len(self.labels))
        for lo in range(0, len(vectors) if k else 0, 512):
            cosine = vectors[lo : lo + 512].astype(np.float32) @ self.points.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            # Squares sharpen the vote; opposite points have none.
            weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(float), 0) ** 2
            total = weight.sum(1)
            out[lo : lo + 512] = np.where(total > 1e-9, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-9), prior)
        return np.clip(out, 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int = FEATURES, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Latent:
    """rows: slots and weights of each labelled text."""
    n = len(rows)
    x = np.zeros((n, features), np.float32)
    for i, (slot, weight) in enumerate(rows):
        x[i, slot] = np.sqrt(weight)
    idf = np.log((1 + n) / (1 + (x > 0).sum(0))) + 1
    x *= idf.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    k = min(rank, max(n, 1))
    y = np.random.default_rng(0).standard_normal((features, min(k + 10, features))).astype(np.float32)
    for _ in range(4):
        y = np.linalg.qr(x.T @ (x @ y))[0] if n else y
    u, s, v = np.linalg.svd(x @ y, full_matrices=False) if n else (None, None, np.eye(y.shape[1], dtype=np.float32))
    basis = y @ v.T[:, :k]
    return Latent(idf, basis, unit(x @ basis).astype(np.float32), np.asarray(labels, float), neighbours)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        bounds, slot, weight = stylistic(batch.column("text"), FEATURES)
        at = pa.array(bounds, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("label"), pa.ListArray.from_arrays(at, pa.array(slot, pa.int64())), pa.ListArray.from_arrays(at, pa.array(weight, pa.float64()))], ["_id", "label", "slots", "weights"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = BOUND) -> Latent:
    sample = training_texts(docs, labels, label, bound)
    rows = sample.mapInArrow(_features, f"_id {dict(sample.dtypes)['_id']}, label int, slots array<bigint>, weights array<double>").toArrow().sort_by("_id")
    flat = lambda c: pc.list_flatten(rows[c].combine_chunks()).to_numpy(zero_copy_only=False)
    cuts = np.cumsum(pc.list_value_length(rows["slots"]).to_numpy())[:-1] if len(rows) else []
    return fit(list(zip(np.split(flat("slots"), cuts), np.split(flat("weights"), cuts))) if len(rows) else [], rows["label"].to_numpy().astype(float))


def _score(batches: Iterator[pa.RecordBatch], model: Latent) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        score = model.vote(model.project(*stylistic(batch.column("text"), FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column("rec"), batch.column("held_out"), pa.array(score)], ["rec", "held_out", "score"])


def quality_knn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", bound: int = BOUND, cut: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: rec (struct of ``keep``, by default all columns but the
    text), held_out, score, predicted.

    Rows whose crc32(id) mod 5 is 0 are never learned from. A score depends on the
    text alone. Null, empty and blank texts, and all texts if there are no labels,
    score the share of label 1 in the sample (0.5 without labels). Input columns may
    have any names; an empty table gives no rows.
    """
    spark, t, mark = docs.sparkSession, Safe(docs, without(docs, text_col) if keep is None else keep), Safe(labels)
    model = spark.sparkContext.broadcast(learn(t.rows.select(t.col(id_col).alias("doc_id"), t.col(text_col).alias("text")), mark.rows.select(mark.col(id_col).alias("doc_id"), mark.col(label).alias("label")), "label", bound))
    base = t.rows.select(t.rec, F.coalesce(fold_of(t.col(id_col)) == 0, F.lit(False)).alias("held_out"), t.col(text_col).alias("text"))
    scored = base.mapInArrow(lambda b: _score(b, model.value), t.schema("held_out boolean, score double"))
    return t.out(scored).withColumn("predicted", (F.col("score") >= cut).cast("int"))
