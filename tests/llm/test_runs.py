"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pawprint.llm.queries import ORACLES, QUERIES
from pawprint.llm.runs import find_runs, periodic_runs


def brute(words, copies=4, least=6):
    """(start, length, period) by trying each period at each place, straight from the definition."""
    n, found = len(words), {}
    for p in range(1, n // copies + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, copies * p):
                found.setdefault((i, j + p - i), p)  # periods rise: the smallest one stays
            i = j
    return sorted((s, m, p) for (s, m), p in found.items())


def collapse(words, runs):
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(r, n, letters):
    out = []
    while len(out) < n:
        part = [r.choice(letters) for _ in range(r.randint(1, 6))]
        out += part * r.choice([1, 1, 2, 4, 5, 9])
    return out[:n]


@pytest.mark.parametrize("moduli", [None, (13,), (101, 7)])
def test_runs_equal_brute_force(moduli):
    """With tiny moduli hashes collide all the time, and the result stays."""
    r = random.Random(5)
    docs = [random_words(r, r.randint(0, 160), "abc"[: r.randint(1, 3)]) for _ in range(150)] + [[], ["a"], ["a"] * 5, ["a"] * 6, list("ab") * 4, list("abcd") * 9 + list("ab") * 30]
    ids = np.array([ord(w) for d in docs for w in d])
    got = find_runs(ids, [len(d) for d in docs], **({"moduli": moduli} if moduli else {}))
    want = [(i, *run) for i, d in enumerate(docs) for run in brute(d)]
    assert [tuple(x) for x in got.tolist()] == want and len(want) > 100


def test_other_bounds():
    r = random.Random(6)
    docs = [random_words(r, 90, "ab") for _ in range(40)]
    ids = np.array([ord(w) for d in docs for w in d])
    for copies, least in ((2, 2), (3, 8), (6, 20)):
        assert [tuple(x) for x in find_runs(ids, [90] * 40, copies, least).tolist()] == [(i, *run) for i, d in enumerate(docs) for run in brute(d, copies, least)]


def want(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, milli, digest("".join(f"{s},{m},{p}\n" for s, m, p in runs)), digest(collapse(words, runs)))


def test_query_equals_brute_force(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in rows if len(r.text or "") < 20_000]
    r = random.Random(1)
    odd = [(None, "a a a a a a"), (1, None), (2, ""), (3, " \t\n"), (5, "a b " * 9), (5, "a b " * 9)]
    odd += [(10_000 + i, " ".join(random_words(r, r.randint(1, 200), ["x", "yy", "é"]))) for i in range(120)]
    docs = spark.createDataFrame([(*x, 7, "k") for x in short + odd], "doc_id bigint, text string, runs int, words string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((want(*x) for x in short + odd), key=str)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in odd) > 3
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op11_runs"](spark, f"{tmp_path}/none").count() == 0


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    r = random.Random(4)
    rows = [(i, " ".join(random_words(r, r.randint(0, 120), ["x", "yy", "\u00e9"]))) for i in range(300)] + [(None, "b b b b b b"), (7, None), (7, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op11_runs"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(ORACLES["op11_runs"]).fetchall()))


def test_long_document(spark):
    """A planted run in a text of 400,000 words, and a text of one word 300,000 times."""
    r = random.Random(2)
    a, unit, b = ([f"w{r.randint(0, 400)}" for _ in range(n)] for n in (150_000, 1237, 100_000))
    text = " ".join(a + ["<"] + unit * 120 + [">"] + b)
    docs = spark.createDataFrame([(1, text), (2, "z " * 300_000)], "doc_id bigint, text string")
    got = {x.doc_id: x for x in periodic_runs(docs).collect()}
    assert [(x.start, x.length, x.period) for x in got[1].runs if x.period > 5] == [(150_001, 1237 * 120, 1237)]
    assert [(x.start, x.length, x.period) for x in got[2].runs] == [(0, 300_000, 1)] and got[2].collapsed == "z"
    assert len(got[1].collapsed.split()) <= 250_002 + 1237
