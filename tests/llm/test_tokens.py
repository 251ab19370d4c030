"""Token counts and token tables against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from pawprint.llm.common import scratch
from pawprint.llm.queries import QUERIES
from pawprint.llm.token_counts import TokenCounter, token_counts
from pawprint.llm.token_tables import Shard, TextEncoder, can_cut, read_shards, token_tables, write_shards

ODD = ["", " ", "\n", "a  b", " lead", "trail ", "x \ny", "\n\n", "▁odd▁ one", "<s> </s> <unk>", "<|endoftext|>x", "日本 é̈ Σίσυφος İ", "word\t\r tab", "!!! ??", "don't we'll", "naïve, café. end."]


@pytest.fixture(scope="module")
def texts(spark, small):
    return [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]


def test_counts_equal_the_library(texts):
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    whole, spliced = TokenCounter(model), TokenCounter(model, 200, 4)
    pool = random.Random(5)
    made = ["".join(pool.choice("ab the\n  é日▁!.0") for _ in range(pool.randint(0, 300))) for _ in range(300)]
    for t in texts + ODD + made + ["a" * 5000, "日" * 3000, " " * 2000]:
        n = len(whole.sp.encode(t))
        assert whole.count(t) == n and spliced.count(t) == n, repr(t[:80])


def test_memo_is_exact(texts):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        json = f.read()
    assert can_cut(json)
    a, b = TextEncoder(json, False), TextEncoder(json, True)
    assert a.encode(texts + ODD) == b.encode(texts + ODD)
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert not can_cut(f.read())


def test_special_tokens_in_any_case():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        json = f.read()
    odd = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "A Word<|ENDOFTEXT|>B", "<|StartOfText|> Caf\u00c9. <|endoftext|>", "\u65e5 <|ENDOFTEXT|>", "<|ENDOFTEXT|"]
    enc = TextEncoder(json, True)
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in odd]
    assert [list(np.frombuffer(x, "<u4")) for x in enc.encode(odd)] == want
    assert want[0] == want[1] == [27, 347, 40786, 4160, 91, 285] and want[2] == [49407]


def test_count_query(spark, small, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = QUERIES["op9_token_counts"](spark, small).collect()
    want = {r[0]: r[1] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {d: (len(t.encode()), n := len(sp.encode(t)), n > 4096) for d, t in want.items()}


def test_table_query(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, start = [], 0
    for d, text in sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op10_token_tables"](spark, small).collect())) == want


def test_table_edges(spark):
    rows = [(-5, "a b", 1), (3, None, 2), (3, "x", 3), (2**62, "", 4), (7, "long " * 20000, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    path = scratch(spark, "sst-test")
    manifest = write_shards(docs, P.path("word_bpe_49k.json"), path)
    got = read_shards(manifest).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(-5, 3), (3, 1), (3, 2), (7, 20001), (2**62, 1)]
    found = {}
    for m in manifest.collect():
        with open(m.path.removeprefix("file://"), "rb") as f:
            f.size = lambda f=f: f.seek(0, 2)
            shard = Shard(f)
            for k in (-5, 3, 4, 7, 2**62):
                if (ids := shard.get(k)) is not None:
                    found[k] = len(ids)
    assert found == {-5: 3, 3: 1, 7: 20001, 2**62: 1}
    empty = docs.filter("doc_id = 0")
    assert token_tables(empty, P.path("word_bpe_49k.json")).count() == 0
    assert token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_table_null_and_hot_identifiers(spark):
    """A null identifier comes first; rows of one identifier are dealt to several shards and keep the order of their text."""
    rows = [(None, "a b"), (1, "z")] + [(4, f"{i:03d} word") for i in range(300)] + [(None, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    manifest = write_shards(docs, P.path("word_bpe_49k.json"), scratch(spark, "sst-null"))
    got = read_shards(manifest).orderBy("start").collect()
    enc = TextEncoder(open(P.path("word_bpe_49k.json"), encoding="utf-8").read(), False)
    want = [(d, np.frombuffer(enc.encode([t])[0] + np.array([2], "<u4").tobytes(), "<u4")) for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(d, len(x), zlib.crc32(x.tobytes())) for d, x in want]
    assert manifest.filter("first_id = 4 or first_id is null").count() > 2


def test_words_side_by_side():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        enc = TextEncoder(f.read(), True)
    odd = ["Ünï Ærøskøbing ﬁ İstanbul ĲSSEL straße's a'll don't été ÅNGSTRÖM Å x́ ªº ß ŉ", "a.b. c, d. É. ı.", "русский ТЕКСТ. Σς 日本", "", "x\x85w\x1cq  y", "Zq" * 3000]
    assert enc.ends is not None
    assert [list(np.frombuffer(x, "<u4")) for x in enc.encode(odd)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in odd]
