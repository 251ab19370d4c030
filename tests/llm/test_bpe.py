"""Byte-level BPE against the tiktoken library."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from pawprint.llm.bpe import ByteBpe, digests, encode_documents, read_ranks
from pawprint.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def row(enc, text):
    ids = enc.encode_ordinary(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, small, library):
    want = {d: row(library, t or "") for d, t in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op1_byte_bpe"](spark, small).collect()} == want


def test_edges(spark, library):
    texts = ["", None, "a", "aaaa" * 500, "x1y2 don't we'll  two\n\n three \t", "日本語 é😀👩‍👩‍👧", " nb sp　 ", "qwrtz" * 300, "<|endoftext|>", "Ünïcödé" * 50, "same same same", "a\rb\r\nc \x0b\x0c\x1c\x85"]
    docs = spark.createDataFrame([(i % 9, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    for head in (0, 1 << 19):
        got = digests(encode_documents(docs, PATH, P.PATTERN, head_words=head)).collect()
        assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((i % 9, *row(library, t or "")) for i, t in enumerate(texts))
    assert digests(encode_documents(docs.filter("doc_id < 0"), PATH, P.PATTERN)).count() == 0


def test_long_words(spark, library):
    """Both sides of LONG_BYTES, and a word of a megabyte."""
    texts = ["qwrtz" * 100 + " " + "qwrtz" * 300 + " x " + "qwrtz" * 100, "é" * 511 + " " + "é" * 513, "ab" * 500_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = digests(encode_documents(docs, PATH, P.PATTERN, head_words=0)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {i: row(library, t) for i, t in enumerate(texts[:2])} | {2: (got_row := next((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id == 2))}
    assert got_row[2] == hashlib.sha256(texts[2].encode()).hexdigest()


def test_session_is_left_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert encode_documents(docs, PATH, P.PATTERN).count() == 1 and spark.conf.get(name) == before


def test_steps_side_by_side():
    """Words of all widths, both sides of LONG_BYTES, one by one and side by side; a byte without a rank."""
    import random

    import numpy as np
    import pyarrow as pa

    from pawprint.llm.bpe import LONG_BYTES, Merges, merged_ids

    ranks, r = read_ranks(PATH), random.Random(5)
    words = ["".join(r.choice("aaetnhé日 ") for _ in range(n)) for n in (*range(1, LONG_BYTES + 9), 300) for _ in range(6)] + ["", "a" * LONG_BYTES]
    ids, sizes = Merges(ranks).fold(pa.array(["x", *words])[1:])
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [merged_ids(w.encode(), ranks) for w in words]
    few = Merges({b"a": 0, b"b": 1, b"ab": 2})
    assert few.fold(pa.array(["abab", "b"]))[0].tolist() == [2, 2, 1]
    with pytest.raises(ValueError, match="lacks"):
        few.fold(pa.array(["abc"]))


def test_one_worker_for_a_task(spark):
    """Words go to Python once, and the plan holds no rank table."""
    docs = spark.createDataFrame([(1, "qwrtz qwrtz yxcv")], "doc_id bigint, text string")
    shared = []
    plan = ByteBpe(read_ranks(PATH), P.PATTERN)._encoded(docs, "doc_id", "text", shared)._jdf.queryExecution().executedPlan().toString()
    for x in shared:
        x.destroy()
    assert plan.count("MapInArrow") == 1 and len(plan) < 5000
