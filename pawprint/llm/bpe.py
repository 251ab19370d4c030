"""Byte-level BPE encoding and decoding.

Spark cuts texts into words, counts the distinct ones over all documents, and brings the frequent ones, at most
head_words, with their ids to all tasks (their number and length are bounded). The other words - rare ones - are
merged in the tasks of their documents, once for a distinct word of a batch. No document is shuffled.

A word starts as its bytes' ids, and the neighbouring pair of lowest rank, the leftmost first, is merged until no pair
has a rank. Merges does a step of all words of a batch side by side, in numpy: its table has, for each pair of ids whose joined
bytes are in the vocabulary, the id of the joined piece. Decoding joins the binary pieces of the ids, from a literal array.

Defined cases: null text counts as empty; an empty text has no ids; identifiers are passed through, null and
repeated ones too; an empty table gives an empty result. Words are found by Java's regular expressions with Unicode
classes. A byte without a rank is an error, if a text has it. Steps side by side take time in the square of a word's bytes, so words of more than
LONG_BYTES are merged one by one, with a heap of pairs.
"""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, release, temporary, written

#: The longest word, in characters, that may be among the broadcast ones.
HEAD_CHARS = 64
#: Documents in an Arrow batch: texts are long, and Spark's own bound is for short rows.
BATCH_ROWS = 1000
#: Words of more bytes are merged with a heap: steps side by side take the square of their bytes.
LONG_BYTES = 64
#: Widths of the matrices that take the other words, and the cells of one.
WIDTHS = (4, 8, 16, 32, LONG_BYTES)
CELLS = 1 << 20
#: The rank of a pair that has none.
NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a line for each piece, base64 bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def _literal(value, kind: str) -> Column:
    """A literal of a nested type, made by one expression that the optimiser folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def merged_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word: merges the pair of lowest rank, the leftmost first, in n log n steps."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that begins at i: where it ends, and where the one before begins
    heap, alive = [], [True] * n

    def ask(i: int) -> None:
        if i >= 0 and (j := ends[i]) < n and (rank := ranks.get(word[i : ends[j]])) is not None:
            heap.append((rank, i, j, ends[j])) if not done else heapq.heappush(heap, (rank, i, j, ends[j]))

    done = False
    for i in range(n):
        ask(i)
    heapq.heapify(heap)
    done = True
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if alive[i] and ends[i] == j and alive[j] and ends[j] == end:
            alive[j], ends[i] = False, end
            if end < n:
                before[end] = i
            ask(before[i])
            ask(i)
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))


class Merges:
    """The merges of a vocabulary as arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values(), default=-1) + 1
        found = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    found[a * self.size + b] = rank
        keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.joined = np.append(np.fromiter(found.values(), np.int32, len(found))[order], NONE).astype(np.int32)
        one = [bytes([b]) for b in range(256)]
        self.bytes = np.array([ranks.get(b, -1) for b in one], np.int32)
        self.pairs = np.array([ranks.get(a + b, NONE) if a in ranks and b in ranks else NONE for a in one for b in one], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of the joined pieces, NONE where there is none."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.joined[at], NONE)

    def fold(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (without the whole-word shortcut), one after the other, and their number for each word."""
        n = len(words)
        sizes, found = np.zeros(n, np.int64), []
        if not n or words.buffers()[2] is None:
            return np.zeros(0, np.int32), sizes
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data, lengths = np.frombuffer(words.buffers()[2], np.uint8), np.diff(offsets)
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            own = np.flatnonzero((lengths > low) & (lengths <= width))
            for i in range(0, len(own), CELLS // width):
                part = own[i : i + CELLS // width]
                ids, alive = self._steps(data, offsets[part], lengths[part], width)
                sizes[part] = alive.sum(axis=1)
                found.append((part, ids[alive]))
        for i in np.flatnonzero(lengths > LONG_BYTES):
            ids = merged_ids(data[offsets[i] : offsets[i + 1]].tobytes(), self.ranks)
            sizes[i] = len(ids)
            found.append((np.array([i]), np.array(ids, np.int32)))
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        for part, ids in found:
            own = sizes[part]
            out[np.repeat(starts[part] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        if len(out) and out.min() < 0:
            raise ValueError("a text has a byte that the vocabulary lacks")
        return out, sizes

    def _steps(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and whether they are there, a row for each word: a merged pair stays at its first byte's place."""
        at = np.arange(width)
        alive = at < lengths[:, None]
        codes = np.where(alive, data[np.minimum(starts[:, None] + at, len(data) - 1)], 0).astype(np.int32)
        ids, ranks = self.bytes[codes], np.full(alive.shape, NONE, np.int32)  # ranks: of the pair that begins at a place
        ranks[:, :-1] = np.where(alive[:, 1:], self.pairs[codes[:, :-1] * 256 + codes[:, 1:]], NONE)
        before, after = (np.tile((at + d).astype(np.int16), (len(starts), 1)) for d in (-1, 1))
        rows = np.arange(len(starts))
        while len(rows):
            place = ranks[rows].argmin(axis=1)  # the leftmost of equal ones
            low = ranks[rows, place]
            some = low != NONE
            rows, place, low = rows[some], place[some], low[some]
            gone = after[rows, place]
            then = after[rows, gone]
            ids[rows, place], alive[rows, gone], after[rows, place] = low, False, then
            ranks[rows, place] = ranks[rows, gone] = NONE
            has = then < lengths[rows]
            r, p, q = rows[has], place[has], then[has]
            before[r, q] = p
            ranks[r, p] = self.rank(low[has], ids[r, q])
            prior = before[rows, place]
            has = prior >= 0
            r, q = rows[has], prior[has]
            ranks[r, q] = self.rank(ids[r, q], low[has])
        return ids, alive


class ByteBpe:
    """Encodes and decodes by the ranks of a vocabulary; pattern splits texts into words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, head_words: int = 1 << 19):
        self.merges, self.pattern, self.head_words = Merges(ranks), f"(?U){pattern}", head_words
        pieces: list = [None] * self.merges.size
        for piece, rank in ranks.items():
            pieces[rank] = piece.decode("latin-1")  # a character for each byte
        self.pieces = _literal(pieces, "array<string>")
        self.by_text = {}
        for piece, rank in ranks.items():
            try:
                self.by_text[piece.decode()] = rank
            except UnicodeDecodeError:
                pass

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def head(self, docs: DataFrame, text_col: str, merges) -> pa.Table:
        """The frequent words, and their ids: at most head_words rows. merges is a broadcast of self.merges."""
        counts = (
            docs.select(F.explode(self.words(F.col(text_col))).alias("word"))
            .groupBy("word")
            .agg(F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") > 1) & (F.length("word") <= HEAD_CHARS))
        )
        counts = written(counts, "bpe-words")
        steps = counts.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
        least, room = float("inf"), self.head_words
        for r in sorted(steps, reverse=True):
            room -= r["words"]
            if room < 0:
                break
            least = r["step"]

        def folded(batches):
            for b in batches:
                ids, sizes = merges.value.fold(b.column(0))
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids, sizes)], ["word", "ids"])

        known = counts.filter(F.floor(F.log2("n") * 4) >= F.lit(least)).select("word")
        return known.mapInArrow(folded, "word string, ids array<int>").toArrow()  # bounded: head_words words of HEAD_CHARS

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, ids (array<int>) for each row of docs, as a written table."""
        spark, shared = docs.sparkSession, []
        try:
            with arrow_batches(spark, BATCH_ROWS), temporary(spark):
                return written(self._encoded(docs, id_col, text_col, shared), "bpe-ids", keep=True)
        finally:
            for x in shared:
                x.destroy()
            pa.default_memory_pool().release_unused()

    def _encoded(self, docs: DataFrame, id_col: str, text_col: str, shared: list) -> DataFrame:
        """The rows of encode(), not yet computed; appends the broadcasts that they need to shared."""
        sc = docs.sparkSession.sparkContext
        merges = sc.broadcast(self.merges)
        shared.append(merges)
        table = self.head(docs, text_col, merges)
        release(docs.sparkSession)
        whole = pa.array(list(self.by_text), pa.string())  # a word of the vocabulary is its own piece
        table = table.filter(pc.invert(pc.is_in(table.column("word"), value_set=whole))).combine_chunks()
        lists = table.column("ids").combine_chunks()
        ids = np.concatenate([np.fromiter(self.by_text.values(), np.int32, len(whole)), np.asarray(lists.flatten(), np.int32)])
        sizes = np.concatenate([np.ones(len(whole), np.int64), np.asarray(lists.value_lengths(), np.int64)])
        names = pa.concat_arrays([whole, table.column("word").combine_chunks().cast(pa.string())])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("word", pa.string())])) as w:
            w.write_table(pa.table({"word": names}))
        head = sc.broadcast((sink.getvalue().to_pybytes(), ids, sizes))
        shared.append(head)
        del table, lists, names

        def coded(batches):
            words, ids, sizes = head.value
            known = pa.ipc.open_stream(words).read_all().column("word").combine_chunks()
            for b in batches:
                lists = b.column(1)
                units = lists.flatten().dictionary_encode()
                place = np.asarray(pc.fill_null(pc.index_in(units.dictionary, value_set=known), -1), np.int64).copy()
                new = np.flatnonzero(place < 0)
                own, own_sizes = merges.value.fold(units.dictionary.take(pa.array(new)))
                place[new] = len(sizes) + np.arange(len(new))
                all_ids, all_sizes = np.concatenate([ids, own]), np.concatenate([sizes, own_sizes])
                word = place[np.asarray(units.indices, np.int64)]
                size = all_sizes[word]
                ends = np.concatenate([[0], np.cumsum(size)])
                where = np.repeat((np.cumsum(all_sizes) - all_sizes)[word] - ends[:-1], size) + np.arange(ends[-1])
                bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(all_ids[where], pa.int32()))], ["doc_id", "ids"])

        rows = docs.select(F.col(id_col).alias("doc_id"), self.words(F.col(text_col)).alias("words"))
        return rows.mapInArrow(coded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")

    def decode(self, ids: Column) -> Column:
        """The bytes of array<int> ids, binary: the binary pieces, a character for each byte, side by side."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), ""), "ISO-8859-1")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = 1 << 19) -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary, from these ids)."""
    bpe = ByteBpe(read_ranks(ranks_path), pattern, head_words)
    return bpe.encode(docs, id_col, text_col).withColumn("decoded", bpe.decode(F.col("ids")))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents()."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
