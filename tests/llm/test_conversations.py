"""Repair of conversations against brute force and SQL."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from pawprint.llm.conversations import Solver, damaged, repair, replay, signature
from pawprint.llm.queries import ORACLES, QUERIES


def brute(rows):
    """(cost, audit) by trying edits in the order of cost and string, row after row."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if (audit, i, roles) in done or len(roles) > 3 * len(rows) + 3:
            continue
        done.add((audit, i, roles))
        state = roles[-1:]
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for r in "ua":
            if r in follows:
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r))
        if i < len(rows):
            letter = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if letter != "-":
                more = 3 * letter.isupper()
                for r in follows:
                    if r == letter.lower():
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + r))
                    if r != "s":
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, roles + r))
    raise AssertionError


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_all_short_signatures(n):
    solver = Solver()
    for rows in map("".join, itertools.product("suaxSUAX-", repeat=n)):
        assert solver.solve(rows) == brute(rows), rows


def test_longer_signatures():
    r, solver = random.Random(3), Solver()
    for _ in range(60):
        rows = "".join(r.choice("suauauaxUA-") for _ in range(r.randint(4, 7)))
        assert solver.solve(rows) == brute(rows), rows
    assert solver.solve("ua" * 50_000) == (0, "KK" * 50_000) and solver.solve("-" * 3001) == (4 * 3001, "D" * 3001)
    cost, audit = solver.solve("uau" * 20_000)
    assert cost == 3 * 20_000 and replay(audit, ["user", "assistant", "user"] * 20_000, ["x"] * 60_000)[-1][0] == "assistant"


def want(rows):
    """The query's row by conv_id, from (conv_id, turn, role, text)."""
    by, out = {}, {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by.setdefault(c, [])
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        by[c] += [(t, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    for c, rows in by.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = {t for t, _, _ in rows if t is not None}
        sig, blank, duplicate, truncated = signature([x[1] for x in rows], [x[2] for x in rows])
        first = [x[1][:1] for x in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
        cost, audit = brute(sig)
        fixed, state, i = [], "", 0
        for e in audit:
            if e != "D":
                state = rows[i][1][0] if e == "K" else "a" if state == "u" else "u"
                fixed.append((rows[i][1] if e == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + ("" if e == "I" else rows[i][2]))
            i += e != "I"
        out[c] = (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


def odd_rows():
    r = random.Random(9)
    pool = ["Yes.", "Why?", "no end", "", " \t", "x!  ", None, "Yes.", "é!", "a "]
    rows = [(r.choice([None, *range(5000, 5040)]), r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", "tool", None, "User", ""]), r.choice(pool)) for _ in range(160)]
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i + 6000}:0".encode()) % 20 == 0)
    return [*rows, (dropped + 6000, 0, "user", "gone."), (7077, 1, "user", "Hi."), (7077, 1, "user", "Hi.")]


def test_signature():
    assert signature(["user", "assistant", "user", "tool", "system"], ["Hi.", "cut", "Hi.", "Ok? \n", " \r"]) == ("uA-x-", 1, 1, 1)


def test_query_equals_brute_force(spark, small, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + odd_rows()
    table = spark.createDataFrame([(*x, 1, "k") for x in rows], "conv_id bigint, turn bigint, role string, text string, copies int, rows string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversations"](spark, str(tmp_path))
    expected = want(rows)
    assert {x.conv_id: tuple(x) for x in got.collect()} == expected and got.count() == len(expected)
    assert any(x[7] == "" for x in expected.values())
    table.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert QUERIES["op13_conversations"](spark, f"{tmp_path}/none").count() == 0


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    rows = odd_rows()
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["op13_conversations"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(ORACLES["op13_conversations"]).fetchall()))


def test_shuffled_audits(spark, monkeypatch):
    """Beyond the bound of a broadcast a shuffle joins the same rows; a long conversation of many turns."""
    rows = [(i % 30, i // 30, "user" if i // 30 % 2 == 0 else "assistant", f"t{i}.") for i in range(120)] + [(99, i, "user" if i % 2 == 0 else "assistant", f"long {i}!") for i in range(20_000)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    near = {r.conv_id: tuple(r) for r in repair(damaged(table)).collect()}
    monkeypatch.setattr("pawprint.llm.conversations.BROADCAST_BYTES", -1)
    assert {r.conv_id: tuple(r) for r in repair(damaged(table)).collect()} == near and len(near) == 31
