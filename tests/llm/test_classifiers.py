"""Quality and toxicity: held-out accuracy, folds, edge cases."""

import zlib

import numpy as np
import pytest

from pawprint.llm.quality import STATISTICS, Discriminant, document_statistics, drop_rejected, quality_scores
from pawprint.llm.queries import QUERIES
from pawprint.llm.toxicity import fit_ftrl, toxicity_scores

LARGER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("query, label, folds, held, cut, least", [("op2_quality", "quality", 5, 0, 0.3, 0.97), ("op7_toxicity", "toxic", 3, 1, 0.7, 0.93)])
def test_held_out_accuracy(spark, query, label, folds, held, cut, least):
    got = QUERIES[query](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % folds == held for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= cut)).all()
    out = got[got.held_out]
    assert (out[label] == out.predicted).mean() >= least
    clean = out[out[label] == (1 if label == "quality" else 0)]
    assert (clean[label] == clean.predicted).mean() >= 0.98


def edge_docs(spark):
    rows = [(i, None if i == 0 else "" if i == 1 else "word " * 30_000 if i == 2 else f"plain words here {i}." if i % 2 else "JUNK!! " * 9, 1.0, 0) for i in range(40)] + [(None, "x", 1.0, 0), (5, "plain", 1.0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score double, label int")


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, int(i % 2 == 0)) for i in range(3, 40)] + [(4, None, None), (None, 1, 1), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    none = labels.limit(0)
    for f in (quality_scores, toxicity_scores):
        assert f(docs, labels).count() == 42 and f(docs, none).count() == 42 and f(docs.limit(0), labels).count() == 0
        assert all(0 <= r.score <= 1 for r in f(docs, labels).collect())
    left = drop_rejected(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {3, 5, 7, None} and 20 not in {r.doc_id for r in left.collect()}


def test_discriminant_equals_its_formula(spark, small):
    rows = document_statistics(spark.read.parquet(f"{small}/documents.parquet")).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    model = Discriminant.fit(rows, "quality")
    data = rows.withColumn("score", model.score()).toPandas()
    x = data[STATISTICS].to_numpy()
    density = [p - np.log(np.diag(f)).sum() - (np.linalg.solve(f, (x - m).T) ** 2).sum(axis=0) / 2 for m, f, p in zip(model.means, model.factors, model.log_priors, strict=True)]
    assert np.allclose(1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500))), data.score, atol=1e-9)


def test_ftrl_is_sparse():
    pool = np.random.default_rng(0)
    rows = [np.unique(pool.integers(100, 5000, 40)) for _ in range(400)]
    labels = np.array([i % 4 == 0 for i in range(400)], float)
    rows = [np.append(r, 7).astype(np.int32) if y else r.astype(np.int32) for r, y in zip(rows, labels, strict=True)]
    at, w, bias = fit_ftrl(rows, labels)
    assert 7 in at and w[list(at).index(7)] == max(w) and len(at) < 500 and bias < 0


def plain_features(text):
    """Of a text, word by word: words, stems, pairs and pairs with one and two words between, hashed."""
    import hashlib
    import re

    low = "".join(c.lower() if c.isascii() else c for c in text)
    words = [w.encode() for w in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", low)]
    h = lambda b: int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")
    out = {h(w) for w in words} | {h(b"^" + w[:4]) for w in words}
    for gap, mix in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
        out |= {(h(a) * mix % 2**64) ^ h(b) for a, b in zip(words, words[gap:], strict=False)}
    return sorted({x % 2**20 for x in out})


def test_toxicity_equals_a_plain_fit(spark, small):
    """Every weight kept in a dictionary and updated alone, in the order of the operator's passes."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r.text or "") < 4000]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    x = {d: plain_features(t) for d, t in docs}
    rows = sorted((str(d), len(x[d]), toxic[d], d) for d in x if d in toxic and zlib.crc32(str(d).encode()) % 3 != 1)
    z, n, bias_z, bias_n, bias, order = {}, {}, 0.0, 0.0, 0.0, np.random.default_rng(7)

    def weight(i):
        t = z.get(i, 0.0)
        return 0.0 if abs(t) <= 8.0 else -(t - np.sign(t) * 8.0) / ((1.0 + n[i] ** 0.5) / 0.3 + 0.5)

    for _ in range(5):
        for k in order.permutation(len(rows)):
            _, _, label, d = rows[k]
            w = {i: weight(i) for i in x[d]}
            g = (1 / (1 + np.exp(-np.clip(sum(w.values()) + bias, -30, 30))) - label) * (3.0 if label else 1.0)
            for i in x[d]:
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((was + g * g) ** 0.5 - was**0.5) / 0.3 * w[i]
                n[i] = was + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / 0.3 * bias
            bias_n += g * g
            bias = -bias_z / ((1.0 + bias_n**0.5) / 0.3)
    want = {d: 1 / (1 + np.exp(-np.clip(sum(map(weight, x[d])) + bias, -30, 30))) for d in x}
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.score, r.held_out) for r in toxicity_scores(df, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert all(abs(got[d][0] - s) < 1e-5 for d, s in want.items()) and len({round(s, 3) for s in want.values()}) > 10
    assert all(held == (zlib.crc32(str(d).encode()) % 3 == 1) for d, (_, held) in got.items())


def test_bounds_of_the_sample(spark, small):
    """Fewer rows are taken whole; a bound beyond all rows changes nothing."""
    from pawprint.llm.toxicity import train

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    whole, same, few, one = (train(docs, labels, **b) for b in ({}, {"sample_features": 10**9}, {"sample_features": 30_000}, {"sample_features": 1}))
    assert whole[0].tolist() == same[0].tolist() and whole[2] == same[2] and few[2] != whole[2] and one[2] != few[2]


def test_quality_equals_a_plain_fit(spark, small):
    """Means, covariances, shrinkage and densities by numpy on the rows' statistics."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    data = document_statistics(docs).toPandas()
    known = {r.doc_id: r.quality for r in labels.collect()}
    x = data[STATISTICS].to_numpy(float)
    ids = data.doc_id.tolist()
    fit = [[i for i, d in enumerate(ids) if known.get(d) == k and zlib.crc32(str(d).encode()) % 5 != 0] for k in (0, 1)]
    covs = [np.cov(x[i].T, bias=True) for i in fit]
    pooled = np.diag(sum(len(i) * np.diag(c) for i, c in zip(fit, covs, strict=True)) / sum(map(len, fit))) + 0.02 * np.eye(len(STATISTICS))
    density = []
    for i, c in zip(fit, covs, strict=True):
        c = 0.7 * c + 0.3 * pooled
        away = x - x[i].mean(axis=0)
        density.append(np.log(len(i) / sum(map(len, fit))) - np.linalg.slogdet(c)[1] / 2 - np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away) / 2)
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert all(abs(got[d].score - s) < 1e-6 and got[d].predicted == (got[d].score >= 0.3) for d, s in zip(ids, want, strict=True))
