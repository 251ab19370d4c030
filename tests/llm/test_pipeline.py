"""The pipeline against its stages by brute force."""

import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from pawprint.llm.bpe import read_ranks
from pawprint.llm.quality import quality_scores

from .test_decontaminate import brute as leaks
from .test_near_dedup import brute as near


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality_scores(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    left = {r.doc_id: r.text or "" for r in docs.collect() if scores[r.doc_id]}
    first = {}
    for d in sorted(left):
        first.setdefault(left[d], d)
    left = {d: t for t, d in first.items()}
    left = {d: left[d] for d, (_, c) in near(left.items(), corpus_pipeline.NEAR_PERCENT).items() if c == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] for i in range(max(1, len(w) - 9)) if w}
    left = {d: t for d, t in left.items() if not any(tuple(w[i : i + len(g)]) == g for w in [words(t)] for g in grams for i in (range(len(w)) if g[0] in w else ()))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id: (list(r.ids), r.decoded_sha256) for r in got} == {d: (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in left.items()}
    assert 0 < len(got) < docs.count() and all(r.n_tokens == len(r.ids) for r in got)


def words(text):
    from .test_decontaminate import words

    return words(text)


def test_stages_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
    assert leaks("x", [(1, "x")], 10)[4]


def test_drops_keep_any_column_names(spark):
    """Names that a drop's own join might use, in any case, and a null key."""
    from pyspark.sql import functions as F

    from pawprint.llm.common import without, written

    docs = spark.createDataFrame([(1, "a", 7, 8), (2, "b", 7, 8), (None, "c", 7, 8), (2, None, 7, 8)], "doc_id bigint, text string, gone_0 int, `GONE_1` int")
    gone = written(docs.filter("doc_id = 2 and text is not null").select("doc_id", "text"), "gone")
    left = without(docs, gone, [docs["doc_id"], docs["text"]], 16)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, "a", 7, 8), (None, "c", 7, 8), (2, None, 7, 8)], key=str)
    assert without(docs, gone.limit(0), [docs["doc_id"], docs["text"]], 16).filter(F.col("gone_0") == 7).count() == 4


def test_temporary_tables_go_at_the_end(spark):
    import os

    from pawprint.llm.common import temporary, written

    with temporary(spark):
        inner, kept = written(spark.range(3).toDF("x"), "inner"), written(spark.range(4).toDF("x"), "kept", keep=True)
        paths = [os.path.dirname(df.inputFiles()[0].removeprefix("file://")) for df in (inner, kept)]
        assert inner.count() == 3 and all(map(os.path.isdir, paths))
    assert [os.path.isdir(p) for p in paths] == [False, True] and kept.count() == 4
