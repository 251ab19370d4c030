"""Periodic runs of words, by a harmonic grid of prefix hashes.

A run is a stretch of words with smallest period q that has at least min_copies * q and at least min_words words, and
that no neighbouring word extends. In a run of period q, at least (min_copies - 1) * q neighbouring places i have the
same word as place i + q, so one of them is a grid point: the grid of a period p takes every (min_copies - 1) * p-th
place. All (period, grid point) pairs of many documents are handled side by side in numpy: pairs whose words, and
those next to them, differ go at once; for the others two binary searches over prefix hashes (two prime moduli) find
how far the words agree forwards and backwards, which gives the whole stretch. The pairs are few: of n words about
n / 3 * ln(n / 4), made in blocks of bounded size.

Several pairs find the same stretch: one for each grid point in it, and for each multiple of its period. Of each
stretch the smallest period is verified word for word; periods that are no multiple of a verified one, and stretches
that fail, came of a hash collision: that period is searched in its document again, by comparing words.

A document is handled within one task; its words are never cut to a prefix. Defined cases: null and empty texts have
no words and no runs; identifiers are passed through, null and repeated ones too; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two primes under 2 ** 31, so that products fit in 63 bits, and the bases of the polynomials.
MODULI, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_812_433_253)
#: (period, grid point) pairs handled at a time, and bytes of texts put side by side.
BLOCK_PAIRS, BLOCK_BYTES = 1 << 19, 1 << 21
#: Fixed value: a word of bytes is what lies between spaces and the controls 9 to 13, as bytes.split() has it.
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class PrefixHashes:
    """Sums of value(word) * base ** place up to each place, for each modulus."""

    def __init__(self, ids: np.ndarray, moduli: tuple[int, ...] = MODULI):
        self.moduli, self.powers, self.sums = moduli, [], []
        for m, base in zip(moduli, BASES, strict=False):
            power = np.ones(1, np.int64)
            step = base % m
            while len(power) <= len(ids):
                power = np.concatenate([power, power * step % m])
                step = step * step % m
            value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            value = ((value >> np.uint64(31)) % np.uint64(m)).astype(np.int64)
            self.powers.append(power)
            self.sums.append(np.concatenate([[0], np.cumsum(value * power[: len(ids)] % m)]) % m)

    def agree(self, a: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether the size words from a on have the hash of those p places later."""
        out = np.ones(len(a), bool)
        for m, power, sums in zip(self.moduli, self.powers, self.sums, strict=True):
            out &= ((sums[a + size] - sums[a]) * power[p] - (sums[a + p + size] - sums[a + p])) % m == 0
        return out

    def reach(self, at: np.ndarray, p: np.ndarray, most: np.ndarray, forwards: bool) -> np.ndarray:
        """For each pair, how many words from at on (or before at) agree with those p later: a binary search of all pairs together."""
        low, high = np.zeros(len(at), np.int64), most.astype(np.int64)
        for _ in range(int(high.max(initial=0)).bit_length()):
            half = (low + high + 1) // 2
            fits = self.agree(at if forwards else at - half, half, p)
            low, high = np.where(fits, half, low), np.where(fits, high, half - 1)
        return low


def _stretches(ids: np.ndarray, lengths: np.ndarray, copies: int, least: int, moduli: tuple[int, ...]):
    """Yields blocks of rows document, start, end, period of what may be runs."""
    ends = np.cumsum(lengths)
    hashes = PrefixHashes(ids, moduli)
    padded = np.concatenate([ids, [-1, -2]])  # for looks past the end
    periods = np.where(lengths >= least, lengths // copies, 0)
    doc = np.repeat(np.arange(len(lengths)), periods)
    p = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (copies - 1) * p
    points = (lengths[doc] - p) // step
    upto = np.cumsum(points)
    at = 0
    while at < len(doc):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
        n = points[at:end]
        d, q = np.repeat(doc[at:end], n), np.repeat(p[at:end], n)
        k = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        g = (ends - lengths)[d] + (k + 1) * (copies - 1) * q - 1
        at = end
        some = ids[g] == ids[g + q]
        d, q, g = d[some], q[some], g[some]
        same = lambda i: padded[g + i] == padded[g + i + q]  # noqa: E731, B023
        if copies >= 4 and least >= 6:  # five neighbouring places agree at least, so two of these on one side or one on each
            one, before = same(1), same(-1)
            some = (one & before) | (one & same(2)) | (before & same(-2))
            d, q, g = d[some], q[some], g[some]
        first, last = (ends - lengths)[d], ends[d]
        start = g - hashes.reach(g, q, g - first, False)
        end_of = g + q + hashes.reach(g, q, last - g - q, True)
        some = end_of - start >= np.maximum(least, copies * q)
        yield _distinct(np.stack([d, start, end_of, q])[:, some])


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct columns, by stretch and period."""
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[1:, 1:] != rows[1:, :-1]).any(axis=0)
    return rows[:, new]


def _compared(ids: np.ndarray, first: int, last: int, p: int, least: int) -> list[tuple[int, int]]:
    """All stretches of period p of a document that have least words, by comparing words."""
    apart = np.concatenate([[first - 1], np.flatnonzero(ids[first : last - p] != ids[first + p : last]) + first, [last - p]])
    return [(int(i) + 1, int(j) + p) for i, j in zip(apart, apart[1:], strict=False) if j + p - i - 1 >= least]


def find_runs(ids: np.ndarray, lengths: np.ndarray, copies: int = 4, least: int = 6, moduli: tuple[int, ...] = MODULI) -> np.ndarray:
    """Columns document, start, length, period of all runs of documents side by side, in this order; ids tell words apart."""
    ids, lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    found = [x for x in _stretches(ids, lengths, copies, least, moduli) if x.shape[1]]
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = _distinct(np.concatenate(found, axis=1)).T.tolist()
    runs: dict[tuple[int, int], tuple[int, int]] = {}
    stretch, period = None, 0
    for d, start, end, p in rows:
        first, last = int(ends[d] - lengths[d]), int(ends[d])
        if (start, end) == stretch and p % period == 0:
            continue  # a multiple of the verified period
        sound = (
            (start, end) != stretch
            and np.array_equal(ids[start : end - p], ids[start + p : end])
            and (start == first or ids[start - 1] != ids[start - 1 + p])
            and (end == last or ids[end] != ids[end - p])
        )
        if sound:
            stretch, period, true = (start, end), p, [(start, end)]
        else:
            true = _compared(ids, first, last, p, max(least, copies * p))
        for x in true:
            if x not in runs or p < runs[x][1]:
                runs[x] = (d, p)
    out = np.array([(d, start - (ends[d] - lengths[d]), end - start, p) for (start, end), (d, p) in runs.items()], np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _side_by_side(texts: list[bytes]):
    """Slices of texts of about BLOCK_BYTES together, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > BLOCK_BYTES:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def periodic_runs(docs: DataFrame, copies: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed.

    collapsed holds the words that stay, joined by one space: a word goes if any run has it after its first period words.
    """

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for i, j in _side_by_side(texts):
                words = [t.split() for t in texts[i:j]]
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                ids = np.asarray(pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices, np.int64)
                runs = find_runs(ids, lengths, copies, least)
                first = np.cumsum(lengths) - lengths
                edge = np.zeros(len(ids) + 1, np.int64)
                np.add.at(edge, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
                np.add.at(edge, first[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
                gone = np.cumsum(edge) > 0
                some = set(runs[:, 0].tolist())
                collapsed = [b" ".join([w for w, x in zip(ws, gone[f : f + len(ws)].tolist(), strict=True) if not x] if d in some else ws) for d, (ws, f) in enumerate(zip(words, first.tolist(), strict=True))]
                bounds = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(lengths), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: of every tenth document by crc32 of its identifier, the words from some place on repeat those of a period chosen by the same number.

    A null identifier has no such number and keeps its text.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.array_join(F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, x["a"] + (i - x["a"]) % x["p"]))), " "))[0]

    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))
    some = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]  # the words are cut once
    return docs.select(F.col(id_col).alias("doc_id"), F.when(h % 10 == 0, some).otherwise(F.col(text_col)).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period, exponent_milli, and the hashes of runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
