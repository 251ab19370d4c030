import hashlib
import re

from pawprint.llm.decontaminate import PositionalIndex, contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, n):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        for s in range(max(1, len(x) - n + 1)) if x else ():
            win = x[s : s + n]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "a b c d e f"), (2, "x y"), (10, "É über don't stop-Now"), (3, None), (4, "..."), (5, "of of of of"), (2, "q r s t"), (6, "never seen zzz words")]
TEXTS = ["zero a b c d e f tail", "A B, C. d x y", "of of of of of of", "é ÉBER", "É über DON'T stop now", None, "", "x y x y x y", "b c d e", "long " * 30000 + "q r s t", "never seen zzz", "a b c d e f"]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i % 11, t, i, 1) for i, t in enumerate(TEXTS)] + [(None, "x y", 1, 1)], "doc_id bigint, text string, n_hit int, pos int").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for n in (4, 10):
        got = sorted(map(tuple, contamination(docs, bench, n).collect()), key=str)
        want = sorted([(i % 11, *brute(t, ITEMS, n)) for i, t in enumerate(TEXTS)] + [(None, *brute("x y", ITEMS, n))], key=str)
        assert got == want
        left = drop_contaminated(docs, bench, n)
        assert left.columns == docs.columns
        assert sorted(str(r.text) for r in left.collect()) == sorted(str(t) for t in TEXTS if not brute(t, ITEMS, n)[4])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[:4] for r in contamination(docs, none).collect()] == [(1, 6, 0, 0)]
    assert contamination(docs.limit(0), none).count() == 0 and drop_contaminated(docs, none).count() == 1


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "f filler a"), (2, "f 1 2 3 4 5 6 7 8 9 a"), (3, "a f")], "doc_id bigint, text string")
    near = PositionalIndex(docs, spark.createDataFrame([(1, "a f")], "item_id bigint, text string"), 2).near(3)
    assert {r.doc_id for r in near.collect()} == {1, 3}
