import hashlib
import random
import re

from pyspark.sql import functions as F

from pawprint.llm.line_dedup import dedup_lines, one_edit
from pawprint.llm.queries import QUERIES


def apart(a, b):
    """Whether two lists of words are at most one edit apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=8):
    """doc_id -> (lines, equal, near, text) by comparing each line with all earlier ones that share an end."""
    seen, by_half, out = {}, {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        lines, kept, equal, near = (t or "").split("\n"), [], 0, 0
        for line in lines:
            w = [x for x in re.split("[ \t]+", line) if x]
            if not w:
                kept.append(line)
            elif line in seen:
                equal += 1
            else:
                seen[line] = w
                ends = [("f", *w[:3]), ("l", *w[-3:])]
                if len(w) >= least and any(apart(w, o) for e in ends for o in by_half.get(e, ())):
                    near += 1
                else:
                    kept.append(line)
                if len(w) >= least:
                    for e in ends:
                        by_half.setdefault(e, []).append(w)
        out[d] = (len(lines), equal, near, "\n".join(kept))
    return out


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.text_sha256) for r in QUERIES["op6_line_dedup"](spark, small).collect()}
    assert got == {d: (*v[:3], hashlib.sha256(v[3].encode()).hexdigest()) for d, v in brute(rows).items()}


def test_edits_against_brute_force(spark):
    pool = random.Random(11)
    base = [[pool.choice("abcd") for _ in range(pool.randint(7, 12))] for _ in range(12)]
    lines = []
    for _ in range(400):
        w = list(pool.choice(base))
        for _ in range(pool.randint(0, 2)):
            i = pool.randrange(len(w))
            if (kind := pool.randrange(3)) == 0:
                w[i] = pool.choice("abcdx")
            elif kind == 1:
                del w[i]
            else:
                w.insert(i, pool.choice("abcdx"))
        lines.append(pool.choice([" ", "  ", "\t"]).join(w))
    rows = [(i - 20, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(80)] + [(500, None), (501, ""), (502, "\n\n"), (503, "tiny\ntiny"), (504, "w " * 20000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, no int").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.text) for r in dedup_lines(docs).collect()}
    want = brute(rows)
    assert got == want and sum(v[2] for v in want.values()) > 20
    assert dedup_lines(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a\na"), (1, "a\na"), (None, "a")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.n_equal) for r in dedup_lines(twice).collect()) == [("1", 2), ("1", 2), ("None", 0)]


def test_one_edit(spark):
    pool = random.Random(2)
    pairs = [([pool.choice("ab") for _ in range(pool.randint(1, 5))], [pool.choice("ab") for _ in range(pool.randint(1, 5))]) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    assert all(r.near == apart(r.a, r.b) for r in df.withColumn("near", one_edit(F.col("a"), F.col("b"))).collect())


def test_earlier_lines_of_one_word_less(spark):
    """Against all earlier distinct lines."""
    pool = random.Random(7)
    base = [[pool.choice("abcd") for _ in range(7)] for _ in range(6)]
    lines = []
    for _ in range(150):
        w = list(pool.choice(base))
        for _ in range(pool.randint(0, 3)):
            w.insert(pool.randrange(len(w) + 1), pool.choice("abcdx"))
        lines.append(" ".join(w[pool.randint(0, 1) :]))
    rows = [(i, "\n".join(lines[i * 3 : i * 3 + 3])) for i in range(50)]
    seen, want = [], []
    for d, t in rows:
        equal = near = 0
        for line in t.split("\n"):
            w = line.split(" ")
            if w in seen:
                equal += 1
            else:
                near += len(w) >= 8 and any(apart(w, o) for o in seen)
                seen.append(w)
        want.append((d, equal, near))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_equal, r.n_near) for r in dedup_lines(docs, short_partners=True).collect()) == want
    assert sum(r.n_near for r in dedup_lines(docs).collect()) < sum(w[2] for w in want)


def test_many_lines_that_go(spark):
    """A document of 100,000 equal short lines, in time that follows them."""
    docs = spark.createDataFrame([(1, "a b\n" * 100_000 + "c"), (2, "x\ny\nx")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.n_equal, r.text) for r in dedup_lines(docs).collect()}
    assert got == {1: (100_001, 99_999, "a b\nc"), 2: (3, 1, "x\ny")}
