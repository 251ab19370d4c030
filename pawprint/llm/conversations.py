"""Repair of conversations' structure by their signatures.

A row has one fault at most: blank (no character but spaces and controls 9 to 13), duplicate (role and text seen
earlier in the conversation), truncated (the last character that is none of these is no ".", "!" or "?"). A
conversation should go system?, (user, assistant)+, or be empty. Edits cost: K keep 0, R give another role 3, D delete
4 (blank and duplicate rows have to go), I insert a row of empty text 3, and 3 more for each truncated row that stays.

1. Each conversation's rows become a signature: a letter a row, of its role's first letter and its fault.
2. Distinct signatures are solved once: the cheapest edits, of a tie the string of them that comes first in ASCII. A
   signature is halved again and again, and each part is solved once for all ways in and out of it (memoised
   recursion, as deep as the logarithm of its length).
3. The strings of edits (audits) are joined back to their conversations and replayed. They tell the roles too: kept
   rows have theirs, and what is given or inserted can only be what must follow.

Signatures are grouped before they are solved, and their audits broadcast only if their counted bytes are bounded;
otherwise a shuffle joins them, and adaptive execution splits a signature that many conversations have. A
conversation is one row, as a document is: its result holds all its text.

Defined cases: a null role or text is one space, so the row is blank, or has a role of no known letter, which can't
be kept; rows go by turn, null turns first, then by role and text; a null identifier is one conversation; a
conversation without rows has an empty audit and text; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, temporary, written

#: Costs of edits, and what may follow (from the start, a system, user or assistant row).
RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3
NEXT = {"start": "su", "s": "u", "u": "a", "a": "u"}
STATES = ("start", "s", "u", "a")
ENDS = ("start", "a")
ROLES = {"s": "system", "u": "user", "a": "assistant"}
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Parts of signatures that a worker remembers, and their greatest length.
MEMO_ENTRIES, MEMO_CHARS = 50_000, 256
LETTERS = {"s", "u", "a"}


def signature(roles: list[str], texts: list[str]) -> tuple[str, int, int, int]:
    """The letters of rows in order, and how many are blank, duplicate and truncated.

    s, u, a: a sound row by its role's first letter, x: of another one; upper case: truncated; -: blank or duplicate.
    """
    seen, out, counts = set(), [], [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        end = text.rstrip(SPACE)
        letter = role[:1] if role[:1] in LETTERS else "x"
        if not end:
            counts[0] += 1
            letter = "-"
        elif (role, text) in seen:
            counts[1] += 1
            letter = "-"
        elif end[-1] not in ".!?":
            counts[2] += 1
            letter = letter.upper()
        seen.add((role, text))
        out.append(letter)
    return "".join(out), *counts


def _row_ways(letter: str) -> dict[tuple[str, str], tuple[int, str]]:
    """Of one row, the cheapest edits from each state to each other, with insertions before and after it."""
    inserted = {}
    for a in STATES:
        b, n = a, 0
        inserted[a, a] = (0, "")
        while (b := NEXT[b][-1], n := n + 1) and (a, b) not in inserted:
            inserted[a, b] = (n * INSERT, "I" * n)
    sound = letter.lower()
    own = {(a, a): (DELETE, "D") for a in STATES}
    if letter != "-":
        extra = CUT if letter.isupper() else 0
        for a in STATES:
            b = NEXT[a][-1]
            own_way = [(RENAME + extra, "R")] + ([(extra, "K")] if b == sound else [])
            own[a, b] = min(own_way)
            if a == "start" and sound == "s":
                own[a, "s"] = (extra, "K")
    return _then(_then(inserted, own), inserted)


def _then(first: dict, second: dict) -> dict:
    """The cheapest ways of two parts one after the other. No cheapest way of the first part between two states begins another one, so that the parts' first strings give the whole's."""
    out: dict[tuple[str, str], tuple[int, str]] = {}
    for (a, b), (cost, audit) in first.items():
        for c in STATES:
            if (b, c) in second:
                more, rest = second[b, c]
                way = (cost + more, audit + rest)
                if (a, c) not in out or way < out[a, c]:
                    out[a, c] = way
    return out


class Solver:
    """Cheapest edits of signatures, with a memo of their parts, emptied when it is full."""

    def __init__(self):
        self.memo: dict[str, dict] = {}

    def ways(self, part: str) -> dict:
        if part in self.memo:
            return self.memo[part]
        out = _row_ways(part) if len(part) == 1 else _then(self.ways(part[: len(part) // 2]), self.ways(part[len(part) // 2 :]))
        if len(part) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[part] = out
        return out

    def solve(self, signature: str) -> tuple[int, str]:
        if not signature:
            return 0, ""
        ways = self.ways(signature)
        return min(ways["start", end] for end in ENDS if ("start", end) in ways)


def replay(audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The repaired rows, role and text."""
    out, state, at = [], "start", 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            row, state = (roles[at], texts[at]), roles[at][:1]
        else:
            state = NEXT[state][-1]
            row = (ROLES[state], "" if edit == "I" else texts[at])
        at += edit != "I"
        out.append(row)
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by a hash of conversation and turn; copies is 0 for a dropped row, 2 for a repeated one."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    return conversations.select("conv_id", "turn", F.when(how == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"))


def _signed(batches):
    for b in batches:
        found = [signature(roles, texts) for roles, texts in zip(b.column("roles").to_pylist(), b.column("texts").to_pylist(), strict=True)]
        parts = list(zip(*found, strict=True)) or [[], [], [], []]
        more = [pa.array(parts[0], pa.string()), *(pa.array(p, pa.int64()) for p in parts[1:])]
        yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "signature", "blank", "duplicate", "truncated"])


def _solved(batches):
    solver = Solver()
    for b in batches:
        found = [solver.solve(s) for s in b["signature"]]
        yield pd.DataFrame({"signature": b["signature"], "cost": [c for c, _ in found], "audit": [a for _, a in found]})


def _replayed(batches):
    for b in batches:
        rows = [replay(*x) for x in zip(*(b.column(c).to_pylist() for c in ("audit", "roles", "texts")), strict=True)]
        b = b.drop_columns(["roles", "texts"])
        lists = [pa.array([[r[k] for r in x] for x in rows], pa.list_(pa.string())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*b.columns, *lists], [*b.schema.names, "roles", "texts"])


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of rows (conv_id, turn, role, text, copies): what its rows had, cost, audit, and the repaired roles and texts."""
    spark = rows.sparkSession
    with temporary(spark):
        conversations = _conversations(rows)
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in conversations.schema)
        signed = conversations.mapInArrow(_signed, f"{kind}, signature string, blank bigint, duplicate bigint, truncated bigint")
        signed = written(signed, "signatures")
        audits = written(signed.select("signature").distinct().mapInPandas(_solved, "signature string, cost bigint, audit string"), "audits")
        size = audits.agg(F.sum(F.length("signature") + F.length("audit") + 64)).first()[0] or 0
        both = signed.join(F.broadcast(audits) if size <= BROADCAST_BYTES else audits, "signature")
        kept = [f for f in both.schema if f.name not in ("roles", "texts")]
        out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        return written(both.mapInArrow(_replayed, f"{out}, roles array<string>, texts array<string>"), "repaired", keep=True)


def _conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, illegal, roles, texts (arrays in order)."""
    there = F.when(F.col("copies") > 0, F.struct("turn", "role", "text", "copies"))
    # a null turn sorts first; a row of copies stays one here, and is dealt out within the conversation
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(there)).alias("rows"))
    dealt = F.flatten(F.transform("rows", lambda r: F.array_repeat(r, r["copies"])))
    whole = whole.select("conv_id", dealt.alias("rows"))
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0)).cast("long")
    whole = whole.select("conv_id", gaps.alias("gaps"), F.transform("rows", lambda r: r["role"]).alias("roles"), F.transform("rows", lambda r: r["text"]).alias("texts"))
    initials = F.transform("roles", lambda r: F.substring(r, 1, 1))
    pairs = F.zip_with(F.slice(initials, F.lit(1), F.greatest(F.size("roles") - 1, F.lit(0))), F.slice(initials, 2, F.size("roles")), lambda a, b: F.concat(a, b))
    return whole.select("conv_id", "gaps", F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"), "roles", "texts")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    return repaired.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
