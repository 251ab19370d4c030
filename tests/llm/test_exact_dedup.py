from pawprint.llm.exact_dedup import drop_exact_copies, exact_groups


def brute(rows, largest=True):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    pick = max if largest else min
    return {t: (pick([d for d in ds if d is not None], default=None), len(ds)) for t, ds in groups.items()}


def test_groups_against_brute_force(spark):
    rows = [(i, ["hot" * 50, "", None, f"t{i % 90}", f"t{i}", "x" * 5000 + str(i % 3)][i % 6]) for i in range(600)]
    rows += [(10_000 + i, "hot" * 50) for i in range(500)] + [(None, "hot" * 50), (None, "alone"), (7, "t7"), (7, "t7")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, keep_id int").repartition(5)
    for keep in ("largest", "smallest"):
        want = brute(rows, keep == "largest")
        got = exact_groups(docs, keep=keep).collect()
        assert len(got) == len(rows)
        import hashlib

        by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
        for r in got:
            assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
        kept = [r for r in got if r.kept]
        assert len(kept) == len(want) and {r.text_sha256 for r in kept} == set(by_sha)
        left = drop_exact_copies(docs, keep=keep)
        assert left.columns == docs.columns
        assert sorted((r.text or "", str(r.doc_id)) for r in left.collect()) == sorted((t, str(v[0])) for t, v in want.items())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_groups(docs).count() == 0 and drop_exact_copies(docs).count() == 0
