"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a whole text are the hashed distinct words, word stems (first letters), word pairs, and pairs with one
and two words between. The model is fitted by FTRL-proximal with per-coordinate learning rates and L1 sparsity on the
labelled documents of the training folds that come first by a hash, a bounded sample (see train()); its non-zero
weights - fewer than 2 ** BITS - are broadcast, and every document is scored in one pass.

Defined cases: null text counts as empty; an empty text gets the score of the bias alone; labels other than 0 and 1
are ignored; without labelled rows the bias is 0; identifiers are passed through; an empty table gives an empty
result. Labels, language, source and identifiers are never inputs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import temporary, written
from .quality import fold

BITS = 20
MASK = np.uint64((1 << BITS) - 1)
STEM = 4
MEMO_ENTRIES = 400_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: ASCII letters are lower-cased, digits and non-ASCII characters kept, all else parts words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


class Hasher:
    """Word and stem hashes with a memo of the worker, emptied when it is full."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.at: dict[bytes, int] = {}
        self.words = np.zeros(1 << 16, np.uint64)
        self.stems = np.zeros(1 << 16, np.uint64)

    def _new(self, word: bytes) -> int:
        i = len(self.at)
        if i == len(self.words):
            self.words, self.stems = np.resize(self.words, 2 * i), np.resize(self.stems, 2 * i)
        self.words[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self.stems[i] = int.from_bytes(hashlib.blake2b(b"^" + word[:STEM], digest_size=8).digest(), "little")
        self.at[word] = i
        return i

    def features(self, text: bytes) -> np.ndarray:
        """Hashed features, with repetitions."""
        if len(self.at) > MEMO_ENTRIES:
            self.clear()
        words, at = text.translate(TABLE).split(), self.at
        ids = np.fromiter((at[w] if w in at else self._new(w) for w in words), np.int64, len(words))
        h = self.words[ids]
        parts = [h, self.stems[ids]]
        for gap, mix in enumerate(MIX, 1):
            parts.append((h[:-gap] * mix) ^ h[gap:])
        return (np.concatenate(parts) & MASK).astype(np.int64)


_HASHER = Hasher()


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 5, alpha: float = 0.3, beta: float = 1.0, l1: float = 8.0, l2: float = 0.5, positive: float = 3.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the non-zero weights, and the bias. positive weighs the examples of label 1."""
    z, n, bias_z, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    order = np.random.default_rng(7)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    bias = 0.0
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at = rows[k]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = (p - labels[k]) * (positive if labels[k] else 1.0)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
    some = np.flatnonzero(np.abs(z) > l1)
    return some.astype(np.int32), weights(some).astype(np.float32), float(bias)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, sample_features: int = 48_000_000, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on the labelled rows outside the held-out fold that come first by a hash of their identifier: at most sample_rows of them, and no more than have sample_features features together (one row at least). Each row has all its features. These, not the texts, go to the one task that fits."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter((fold(F.col("doc_id"), folds) != held) & F.col("label").isin(0, 1))
    chosen = known.withColumn("place", F.xxhash64("doc_id", F.lit("sample"))).orderBy("place", "doc_id", "label").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most sample_rows of 28 bytes

    def extract(batches):
        for b in batches:
            found = [np.unique(_HASHER.features(t)).astype(np.int32) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label").cast(pa.int32()), b.column("place"), pa.array(map(len, found), pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "place", "n", "features"])

    def fit(batches):
        x, y, order = [], [], []
        for b in batches:
            lists = b.column("features")
            values, ends = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            x += [values[i:j] for i, j in zip(ends, ends[1:], strict=False)]
            y += b.column("label").to_pylist()
            order += b.column("doc_id").to_pylist()
        rank = sorted(range(len(x)), key=lambda i: (str(order[i]), len(x[i]), y[i]))
        at, w, bias = fit_ftrl([x[i] for i in rank], np.array([y[i] for i in rank], float))
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([w.tobytes()]), pa.array([bias])], ["at", "w", "bias"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    with temporary(docs.sparkSession):
        features = written(rows.select("doc_id", "label", "place", "text").mapInArrow(extract, f"doc_id {kind}, label int, place bigint, n bigint, features array<int>"), "features")
        # of rows with one place (repeated identifiers) all go in, or none; repeated rows of documents count each
        sizes = features.groupBy("place").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).orderBy("place").limit(sample_rows).collect()
        last, n_rows, total = None, 0, 0
        for r in sizes:
            n_rows, total = n_rows + r["rows"], total + r["n"]
            if last is not None and (n_rows > sample_rows or total > sample_features):
                break
            last = r["place"]
        found = None if last is None else features.filter(F.col("place") <= last).select("doc_id", "label", "features").repartition(1).mapInArrow(fit, "at binary, w binary, bias double").first()
    if found is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(found["at"], np.int32), np.frombuffer(found["w"], np.float32), found["bias"]


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7, folds: int = 3, held: int = 1, sample_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= cut)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows, folds=folds, held=held, id_col=id_col, text_col=text_col, label_col=label_col))

    def run(batches):
        at, values, bias = model.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = values
        for b in batches:
            scores = np.empty(len(b))
            for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                f = _HASHER.features(t)
                scores[i] = weights[np.unique(f[weights[f] != 0])].sum(dtype=np.float64) + bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(scores, -30, 30))))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
