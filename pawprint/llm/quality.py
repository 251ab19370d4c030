"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Whole texts become STATISTICS, each on a logarithmic scale. The moments of both classes are summed by Spark over all
labelled rows of the training folds; each class covariance is shrunk towards the pooled diagonal, and its Cholesky
factor is kept in the model. The score is the logistic of the difference of both classes' log densities and priors,
written as column expressions of Mahalanobis distances.

Defined cases: null text counts as empty; an empty text has all statistics 0 and is scored like any other; labels
other than 0 and 1 are ignored, and every row of a repeated label counts; identifiers are passed through; without
labelled rows of both classes all scores are the only class's share, or 0.5; an empty table gives an empty result.
Labels, language, source and identifiers are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, without, worker_cache, written

STATISTICS = ["words", "word_length", "upper", "exclaims", "symbols", "bars", "digits", "stops", "lines", "repeats", "distinct", "same_lines", "brackets"]
# Byte classes of the statistics.
OTHER, LOWER, UPPER, EXCLAIM, SYMBOL, BAR, DIGIT, STOP, LINE, BRACKET, N_CLASSES = range(11)
SLICE_BYTES = 2 << 20


def _byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.int64)
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("!?", EXCLAIM), ("#$%&*@^~=+\\", SYMBOL), ("|", BAR), ("0123456789", DIGIT), (".", STOP), ("\n", LINE), ("<>{}[]", BRACKET)):
        table[list(chars.encode())] = kind
    return table


CLASS_OF = _byte_classes()


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    doc = np.repeat(np.arange(n), sizes)
    counts = np.bincount(doc * N_CLASSES + CLASS_OF[np.frombuffer(b"".join(texts), np.uint8)], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    words = np.zeros((n, 4))
    for i, t in enumerate(texts):
        w = t.split()
        lines = [x for x in t.split(b"\n") if x]
        words[i] = len(w), len(set(w)), sum(map(bytes.__eq__, w, w[1:])), len(lines) - len(set(lines))
    each = np.maximum(words[:, 0], 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER], 1)
    out = np.empty((n, len(STATISTICS)))
    out[:, 0] = np.log1p(words[:, 0])
    out[:, 1] = np.log1p(sizes / each)
    share = [counts[:, UPPER] / letters, counts[:, EXCLAIM] / each, counts[:, SYMBOL] / each, counts[:, BAR] / each, counts[:, DIGIT] / each, counts[:, STOP] / each, counts[:, LINE] / each, words[:, 2] / each, words[:, 1] / each, words[:, 3] / np.maximum(counts[:, LINE] + 1, 1), counts[:, BRACKET] / each]
    out[:, 2:] = np.log1p(20 * np.stack(share, axis=1))
    out[sizes == 0] = 0
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATISTICS of whole texts."""

    def run(batches):
        worker_cache("quality")
        for b in batches:
            texts, lo = b.column(1).cast(pa.binary()).to_pylist(), 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= SLICE_BYTES):
                    held += len(texts[hi])
                    hi += 1
                x = statistics(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["doc_id", *STATISTICS])
                lo = hi

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass
class Discriminant:
    """Means, Cholesky factors of the shrunk covariances and log priors of classes 0 and 1."""

    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    log_priors: list[float] = field(default_factory=list)
    only: float = 0.5

    @classmethod
    def fit(cls, rows: DataFrame, label: str = "label", shrinkage: float = 0.3, floor: float = 0.02) -> Discriminant:
        """From the class moments of rows: a fixed number of sums, whatever the number of rows."""
        d = len(STATISTICS)
        pairs = list(combinations_with_replacement(range(d), 2))
        sums = [F.count(F.lit(1)).alias("n"), *(F.sum(s).alias(s) for s in STATISTICS), *(F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"m{i}_{j}") for i, j in pairs)]
        found = {r[label]: r for r in rows.filter(F.col(label).isin(0, 1)).groupBy(label).agg(*sums).collect()}
        if len(found) < 2:
            return cls(only=float(next(iter(found), 0.5)))
        n, means, covs = [], [], []
        for k in (0, 1):
            r = found[k]
            mean = np.array([r[s] for s in STATISTICS]) / r["n"]
            second = np.zeros((d, d))
            for i, j in pairs:
                second[i, j] = second[j, i] = r[f"m{i}_{j}"] / r["n"]
            n.append(r["n"])
            means.append(mean)
            covs.append(second - np.outer(mean, mean))
        pooled = np.diag(np.diag(n[0] * covs[0] + n[1] * covs[1]) / sum(n)) + floor * np.eye(d)
        factors = [np.linalg.cholesky((1 - shrinkage) * c + shrinkage * pooled) for c in covs]
        return cls(means, factors, [float(np.log(x / sum(n))) for x in n])

    def score(self) -> Column:
        """The probability of class 1 of a row of STATISTICS."""
        if not self.factors:
            return F.lit(self.only)
        density = []
        for mean, factor, prior in zip(self.means, self.factors, self.log_priors, strict=True):
            whiten = np.linalg.inv(factor)
            distance = F.lit(0.0)
            for i in range(len(STATISTICS)):
                z = F.lit(0.0)
                for j in range(i + 1):
                    z = z + (F.col(STATISTICS[j]) - float(mean[j])) * float(whiten[i, j])
                distance = distance + z * z
            density.append(F.lit(prior - float(np.log(np.diag(factor)).sum())) - distance / 2)
        apart = F.greatest(F.least(density[1] - density[0], F.lit(500.0)), F.lit(-500.0))
        return F.lit(1.0) / (F.exp(-apart) + 1)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the identifier's text, modulo folds."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= cut). Learns from labelled rows outside the held-out fold."""
    with arrow_batches(docs.sparkSession):
        table = written(document_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter((fold(F.col("doc_id"), folds) != held) & F.col("label").isNotNull())
    model = Discriminant.fit(table.join(known, "doc_id"))
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return table.select("doc_id", held_out.alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that the classifier rejects, all columns kept. Rows with one identifier go only if all of them are rejected."""
    scores = quality_scores(docs, labels, cut, id_col=id_col, text_col=text_col)
    gone = scores.groupBy("doc_id").agg(F.max("predicted").alias("p")).filter("p = 0 and doc_id is not null").select("doc_id")
    return without(docs, written(gone, "rejected"), [docs[id_col]], 32)
