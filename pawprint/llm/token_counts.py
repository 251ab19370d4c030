"""Token counts by a sentencepiece BPE model, with overlap resynchronisation for huge documents.

A place between two characters is *proven stable* if no piece of the vocabulary holds these two characters side
by side: no merge can ever cross it, so what stands before it and what stands after it are encoded
independently of each other. Two uses are made of that:

* Documents over chunk_chars are encoded as overlapping chunks with offsets. Two neighbouring chunks are spliced
  at a place of their overlap that is proven stable and where both have a token boundary. Without such a place
  the overlap is widened, and once it covers the left chunk, that chunk is made longer.
* Other documents are cut before their spaces and around their line ends, if these are proven stable for the
  model, and counts of repeated segments are kept in a bounded memo of the worker. Otherwise they are encoded whole.

Defined cases: null text counts as empty; an empty text has no tokens; identifiers are passed through, null and
repeated ones too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MEMO_ENTRIES = 400_000
_COUNTERS: dict[str, "TokenCounter"] = {}


class _Memo(dict):
    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        n = self.of(key)
        if len(key) <= 64:
            self[key] = n
        return n


class TokenCounter:
    """Counts tokens of texts as the model gives them, without begin or end tokens."""

    def __init__(self, model: bytes, chunk_chars: int = 16384, overlap_chars: int = 256):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        whole = [p.piece for p in proto.pieces if p.type in (1, 4)]
        self.pairs = {s[i : i + 2] for s in whole for i in range(len(s) - 1)}
        # offsets and stable places are those of the text itself only if it isn't rewritten first
        self.plain = proto.trainer_spec.model_type == 2 and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        self.plain = self.plain and spec.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        self.segments = self.plain and spec.add_dummy_prefix and not any(x[1] == MARK and x[0] != MARK or "\n" in x for x in self.pairs)
        self.newline = len(self.sp.encode("\n"))
        self.segments = self.segments and "\n" not in whole and self.newline == 2
        self.after_space = _Memo(lambda s: len(self.sp.encode(s)))
        self.after_newline = _Memo(lambda s: len(self.sp.encode("\n" + s)) - self.newline if s else 0)

    def stable(self, text: str, p: int) -> bool:
        return text[p - 1 : p + 1].replace(" ", MARK) not in self.pairs

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.plain and len(text) > self.chunk:
            return self.spliced(text)
        if not self.segments or MARK in text or "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            return len(self.sp.encode(text))
        for memo in (self.after_space, self.after_newline):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
        lines = text.split("\n")
        n = len(lines) - 1  # a token for each line end
        for i, line in enumerate(lines):
            words = line.split(" ")
            if i:
                n += self.after_newline[words[0]]
                del words[0]
            n += sum(map(self.after_space.__getitem__, words))
        return n

    def begins(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Where the tokens of text[lo:hi] begin."""
        offsets = self.sp.encode(text[lo:hi], return_type="offset_mapping")["offsets"]
        return np.fromiter((at for at, _ in offsets), np.int64, len(offsets)) + lo

    def spliced(self, text: str) -> int:
        end, total, cut, lo, hi = len(text), 0, 0, 0, min(len(text), self.chunk)
        left = self.begins(text, lo, hi)
        while hi < end:
            width = self.overlap
            while True:
                begin = hi - width
                if begin <= max(lo, cut):  # no place to splice in all of this chunk
                    hi = min(end, hi + max(self.chunk, hi - lo))  # doubled, so that all the encodings together stay linear
                    left = self.begins(text, lo, hi)
                    break
                to = min(end, begin + max(self.chunk, 2 * width))
                right = self.begins(text, begin, to)
                both = np.intersect1d(left, right)
                place = next((int(p) for p in both[::-1] if begin < p < hi and self.stable(text, int(p))), None)
                if place is not None:
                    total += int(((left >= cut) & (left < place)).sum())
                    cut, lo, hi, left = place, begin, to, right
                    break
                width *= 2
        return total + int((left >= cut).sum())


def counter(model: bytes, chunk_chars: int, overlap_chars: int) -> TokenCounter:
    key = f"{hashlib.sha256(model).hexdigest()}-{chunk_chars}-{overlap_chars}"
    if key not in _COUNTERS:
        _COUNTERS[key] = TokenCounter(model, chunk_chars, overlap_chars)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 16384, overlap_chars: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). The model file is read by the driver and broadcast (some MB)."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        count = counter(model.value, chunk_chars, overlap_chars).count
        for b in batches:
            n = [count(t) for t in b.column(1).to_pylist()]
            size = pc.cast(pc.binary_length(b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
