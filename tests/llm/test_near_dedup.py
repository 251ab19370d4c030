import random
import re

from pawprint.llm import near_dedup
from pawprint.llm.near_dedup import components, drop_near_copies, near_groups
from pawprint.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, percent):
    """doc_id -> (n_shingles, component), by an inverted index of shingles."""
    sets, post = {d: shingle_set(t) for d, t in rows}, {}
    for d, s in sets.items():
        for x in s:
            post.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        shared = {}
        for x in s:
            for o in post[x]:
                if o < d:
                    shared[o] = shared.get(o, 0) + 1
        for o, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k):
                a, b = find(o), find(d)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check(spark, rows, percent):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, fp int").repartition(4)
    got = near_groups(docs, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == (want := brute(rows, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)
    return docs, want


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_near_dedup"](spark, small).collect()} == brute(rows, 85)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies with 0 to 6 changed words, and copies of such copies: far more than SMALL in one hub's group."""
    pool = random.Random(3)
    word = lambda: "".join(pool.choice("abcdefgh") for _ in range(6))

    def changed(words, k):
        words = list(words)
        for _ in range(k):
            words[pool.randrange(len(words))] = word()
        return words

    base = [word() for _ in range(150)]
    other = changed(base, 8)
    texts = [changed(base, pool.randint(0, 6)) for _ in range(250)] + [changed(other, pool.randint(0, 2)) for _ in range(60)] + [changed(base, 3)[: 140 + i % 10] for i in range(40)]
    texts += [[word() for _ in range(pool.randint(1, 60))] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(9000, ""), (9001, None), (9002, " \n"), (9003, "one two"), (9004, "ONE\ttwo"), (9005, "x " * 30000)]
    docs, want = check(spark, rows, 85)
    left = drop_near_copies(docs, 85)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    check(spark, rows, 80)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "d e f"), (None, "z")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_groups(docs).collect()) == [("2", "2", True), ("2", "2", True), ("None", "2", False), ("None", "None", False)]
    assert near_groups(docs.limit(0)).count() == 0 and drop_near_copies(docs.limit(0)).count() == 0


def test_identifier_repeated_over_two_groups(spark):
    pool = random.Random(6)
    a, b = ([f"w{pool.randrange(10**6)}" for _ in range(60)] for _ in range(2))
    rows = [(5, " ".join(a)), (7, " ".join([*a[:-1], "end"])), (2, " ".join(b)), (5, " ".join([*b[:-1], "end"]))]
    left = drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), 80).collect()
    assert sorted(map(tuple, left)) == sorted([rows[0], rows[2]])
