"""Token ids as sorted-string-table shards.

Shards are written by Spark tasks in ascending key order, one for each sort range. A shard is

    block* | bloom filter | block index | footer

A block holds entries (shared key bytes, own key bytes, value bytes as varints; key rest; value), with a restart
point - an entry with its whole key - every RESTART entries, the offsets of these, and is compressed. The sparse
index has the last key of each block with its place; a lookup asks the Bloom filter, then bisects the index, then
the restart points. Keys are 8 bytes that sort as the signed identifiers do (none for a null). A value is a byte for the width of
an id (2 or 4 bytes) and the ids, little-endian.

Defined cases: null text counts as empty (only the end id is written); rows that repeat an identifier are all
written, in order of their text, and may span shards; null identifiers have the empty key, which sorts before
all others; an empty table gives no shard and an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, shuffle_partitions, written

MAGIC = b"PAWSST01"
FOOTER = struct.Struct("<QQQQQQ8s")  # bloom at, bloom bytes, index at, index bytes, entries, ids, magic
BLOCK_BYTES = 64 << 10
#: Characters of a text that part the rows of one identifier.
HEAD_CHARS = 16
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MEMO_ENTRIES = 400_000
_ENCODERS: dict[str, "TextEncoder"] = {}


class TextEncoder:
    """Ids of whole texts as the tokenizer of a JSON file gives them, without added special tokens.

    Texts are cut at spaces, tabs and line ends, which the tokenizer's normaliser and pre-tokeniser drop and
    never join across; a bounded memo of the worker keeps the ids of repeated segments. cut=False encodes whole texts.
    """

    def __init__(self, json: str, cut: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cut, self.memo = Tokenizer.from_str(json), cut, {"": b""}
        # matched in the text as it is, before the normaliser
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # ids that end a word, if the model marks them: words can then be encoded side by side in one text
        vocab, self.ends = self.tokenizer.get_vocab(), None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _side_by_side(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each of which is one word to the pre-tokeniser and ends in one id that says so."""
        out = []
        for lo in range(0, len(words), 500):
            (found,) = self.tokenizer.encode_batch_fast([" ".join(words[lo : lo + 500])], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(ends) != len(words[lo : lo + 500]) or ends[-1] != len(raw):
                out += self._ids(words[lo : lo + 500])
            else:
                out += map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.cut:
            return self._ids(texts)
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {"": b""}
        memo = self.memo
        parts = [_lowered(t, self.added).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = set().union(*parts).difference(memo)
        # an ASCII word before a full stop or comma is a word of its own
        ended = [w for w in new if w[-1] in ".," and w.isascii() and w[:-1].isalpha()]
        new.difference_update(ended)
        new.update(x for w in ended for x in (w[:-1], w[-1]) if x not in memo)
        # up to U+012F a letter is one to all tables, and lower case has as many letters
        plain = [w for w in new if w.isalpha() and (w.isascii() or max(w) < "\u0130")] if self.ends is not None else []
        memo.update(zip(plain, self._side_by_side(plain), strict=True))
        new.difference_update(plain)
        order = list(new)
        memo.update(zip(order, self._ids(order), strict=True))
        memo.update((w, memo[w[:-1]] + memo[w[-1]]) for w in ended)
        return [b"".join(map(memo.__getitem__, p)) for p in parts]


def _lowered(text: str, added: list[str]) -> str:
    """Lower-cased ahead of the tokenizer, which makes the memo smaller, where both surely agree: up to U+00FF, and no added token in any case."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    low = text.lower()
    return text if any(t in low for t in added) else low


def encoder(json: str, cut: bool) -> TextEncoder:
    key = f"{hashlib.sha256(json.encode()).hexdigest()}-{cut}"
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(json, cut)
    return _ENCODERS[key]


def can_cut(json: str) -> bool:
    """Whether segments between white space are encoded independently: the pre-tokeniser keeps none of it and the normaliser only composes, lowers and squeezes."""
    import json as j

    spec = j.loads(json)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    dropped = split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and " ?" not in split["pattern"].get("Regex", " ?")
    known = [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("pattern") == {"Regex": r"\s+"}
    return bool(dropped and known and not any(c.isspace() for t in spec["added_tokens"] for c in t["content"]))


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _key_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _bloom_places(key_hash: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", key_hash)
    b |= 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes entries that come in ascending key order; memory holds one block, the index and the keys' hashes."""

    def __init__(self, out):
        import zstandard

        self.out, self.at, self.index, self.hashes, self.entries, self.ids, self.last = out, 0, [], bytearray(), 0, 0, b""
        self.zstd = zstandard.ZstdCompressor(level=1)
        self._start()

    def _start(self):
        self.block, self.restarts, self.n = bytearray(), [], 0

    def add(self, key: bytes, value: bytes, n_ids: int) -> None:
        if key < self.last:
            raise ValueError("keys have to come in ascending order")
        shared = 0
        if self.n % RESTART:
            shared = len(os.path.commonprefix([self.last, key]))
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.entries or key != self.last:
            self.hashes += _key_hash(key)
        self.n, self.last, self.entries, self.ids = self.n + 1, key, self.entries + 1, self.ids + n_ids
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.n:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            data = self.zstd.compress(raw)
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self._start()

    def close(self) -> None:
        self.flush()
        bits = max(64, -(-len(self.hashes) // 16 * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits, bool)
        for i in range(0, len(self.hashes), 16):
            bloom[_bloom_places(bytes(self.hashes[i : i + 16]), bits)] = True
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        self.out.write(bloom + index + FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), self.entries, self.ids, MAGIC))


class Shard:
    """Reads a shard: scan() in key order, get() by binary search."""

    def __init__(self, source):
        self.f = source
        size = source.size()
        source.seek(size - FOOTER.size)
        bloom_at, bloom_n, index_at, index_n, self.entries, self.ids, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(bloom_at)
        self.bloom = np.unpackbits(np.frombuffer(source.read(bloom_n), np.uint8), bitorder="little")
        source.seek(index_at)
        raw, at, self.index = source.read(index_n), 0, []
        while at < len(raw):
            (n,) = struct.unpack_from("<H", raw, at)
            self.index.append((raw[at + 2 : at + 2 + n], *struct.unpack_from("<QQ", raw, at + 2 + n)))
            at += 18 + n

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        import zstandard

        _, at, n = self.index[i]
        self.f.seek(at)
        data = self.f.read(n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        raw = zstandard.ZstdDecompressor().decompress(data[:-4])
        (k,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 - 4 * k
        return raw[:end], list(struct.unpack_from(f"<{k}I", raw, end))

    @staticmethod
    def _entries(raw: bytes, at: int = 0):
        last = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            last = last[:shared] + raw[at : at + own]
            yield last, raw[at + own : at + own + n]
            at += own + n

    def scan(self):
        for i in range(len(self.index)):
            yield from self._entries(self._block(i)[0])

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document with this identifier."""
        key = key_of(doc_id)
        if not all(self.bloom[_bloom_places(_key_hash(key), len(self.bloom))]):
            return None
        i = bisect.bisect_left(self.index, key, key=lambda x: x[0])
        if i == len(self.index):
            return None
        raw, restarts = self._block(i)
        r = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(raw, at))[0])
        for k, v in self._entries(raw, restarts[max(0, r - 1)]):
            if k >= key:
                return unpack(v) if k == key else None
        return None


def pack(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the texts and writes them as shards under path. Returns a written table, a row for each shard: path, first_id, first_head, entries, n_ids.

    A task writes under a name of its own, and only what successful tasks return is listed: leftovers of failed
    or repeated tasks are never read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        json = f.read()
    spark = docs.sparkSession
    tokenizer, cut, end = spark.sparkContext.broadcast(json), can_cut(json), np.array([end_id], "<u4").tobytes()
    kept = {"path": pa.string(), "first_id": pa.int64(), "first_head": pa.string(), "entries": pa.int64(), "n_ids": pa.int64()}

    def run(batches):
        enc, out = encoder(tokenizer.value, cut), None
        for b in batches:
            doc_ids, texts, heads = (c.to_pylist() for c in b.columns)
            for lo in range(0, len(texts), 500):
                for d, head, ids in zip(doc_ids[lo : lo + 500], heads[lo : lo + 500], enc.encode(texts[lo : lo + 500]), strict=True):
                    if out is None:
                        files, base = fs.FileSystem.from_uri(path)
                        files.create_dir(base)
                        name, first = f"shard-{key_of(d).hex() or 'null'}-{uuid.uuid4().hex[:8]}.sst", (d, head)
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                        shard = ShardWriter(out)
                    ids = np.frombuffer(ids + end, "<u4")
                    shard.add(key_of(d), pack(ids), len(ids))
        if out is not None:
            shard.close()
            out.close()
            row = [f"{path}/{name}", *first, shard.entries, shard.ids]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kept.values(), strict=True)], list(kept))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("head", F.substring("text", 1, HEAD_CHARS))  # an identifier of many rows is dealt to several ranges
    ranged = rows.repartitionByRange(2 * shuffle_partitions(spark), "doc_id", "head").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInArrow(run, "path string, first_id bigint, first_head string, entries bigint, n_ids bigint"), "shards")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, one row for each entry of the listed shards."""
    spark = manifest.sparkSession
    shards, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (key_of(r["first_id"]), r["first_head"])):  # a row for each shard, as many as write partitions
        shards.append((r["path"], start))
        start += r["n_ids"]
    kept = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}

    def run(batches):
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, name = fs.FileSystem.from_uri(path)
                rows = []
                with files.open_input_file(name) as f:
                    for key, value in Shard(f).scan():
                        ids = unpack(value)
                        rows.append((id_of(key), at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kept.values(), strict=True)], list(kept))

    listed = spark.createDataFrame(shards, "path string, at bigint").repartition(max(1, len(shards)))
    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_tables(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes shards into the shared folder and reads them back."""
    return read_shards(write_shards(docs, tokenizer_path, scratch(docs.sparkSession, "sst"), end_id))
