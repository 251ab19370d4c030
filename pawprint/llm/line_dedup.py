"""Line dedup by a deletion-neighbourhood join (DataFrame operations only).

A line goes if an earlier line - in order of document and line number, over all documents - is equal, or, for lines
of at least min_words words, differs from it by one inserted, deleted or replaced word. Earlier lines count whether
they stay themselves or not, so that the result doesn't depend on any order of work. With short_partners, the earlier
line may have one word less than min_words; without, it has min_words at least. Shorter lines go by equality alone.

Every distinct line of min_words and more that shares its first or its last half with another one (two lines with
one edit between them always do) emits the hash of each variant with one word left out, and of the whole line.
Variants that are equal and leave out the same place are replacements of one word of each other; a variant that
equals a whole line is that line with one word inserted. Of all these equal variants only the earliest line is joined
to each other one, never all pairs; the words of both are then compared, which verifies the edit distance.

Defined cases: null text counts as empty; lines without words always stay; equality is of the line's text, edits are
of words parted by spaces and tabs; equal rows (identifier and text) count as one document and get equal results;
a null identifier comes before all others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, temporary, written

ROW = ["doc_id", "rid"]
#: Values that a running xor handles at a time.
SCAN_BLOCK = 256
#: Memory of a row of places in a broadcast join, as measured.
PLACE_BYTES = 240


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda's body has no common subexpressions."""
    return F.transform(F.array(value), body)[0]


def words_of(line: Column) -> Column:
    return F.filter(F.split(line, "[ \\t]+"), lambda w: w != "")


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, rid, no (from 0), line, of lines with words."""
    lines = docs.select(*ROW, F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.filter(F.col("line").rlike("[^ \\t]"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one insertion, deletion or replacement apart."""
    wrong = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    longer, shorter = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    same = F.aggregate(F.zip_with(longer, shorter, lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    without = F.concat(F.slice(longer, F.lit(1), same), F.slice(longer, same + 2, F.size(longer)))
    return F.when(F.size(a) == F.size(b), wrong <= 1).when(F.abs(F.size(a) - F.size(b)) == 1, without == shorter).otherwise(False)


def _at(place: Column, word: Column) -> Column:
    return F.xxhash64(word, place)


def sequence_hash(words: str) -> Column:
    """Hash of an array of words: the hashes of word and place, joined by xor."""
    return F.aggregate(F.transform(words, lambda w, i: _at(i, w)), F.lit(0).cast("bigint"), lambda h, x: h.bitwiseXOR(x))


def xor_before(values: Column) -> Column:
    """For each place of an array of longs, the xor of all before it; and last, of all. In blocks, so that long arrays are not copied for each place."""
    none = F.lit(0).cast("bigint")
    scan = lambda part: F.aggregate(part, F.array(none), lambda done, x: F.concat(done, F.array(F.element_at(done, -1).bitwiseXOR(x))))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / SCAN_BLOCK).cast("int")), lambda k: scan(F.slice(values, k * SCAN_BLOCK + 1, SCAN_BLOCK)))

    def joined(parts: Column) -> Column:
        starts = scan(F.transform(parts, lambda p: F.element_at(p, -1)))
        inside = lambda starts: F.flatten(F.transform(parts, lambda p, k: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x.bitwiseXOR(F.get(starts, k)))))
        return _let(starts, lambda starts: F.concat(inside(starts), F.array(F.element_at(starts, -1))))

    return _let(parts, joined)


def without_each(words: str) -> Column:
    """sequence_hash of the array without its i-th word, for each i: what stands before, and what stands after, a place earlier."""
    here, earlier = F.transform(words, lambda w, i: _at(i, w)), F.transform(words, lambda w, i: _at(i - 1, w))

    def hashes(before: Column, other: Column) -> Column:
        # all, without what stands up to i
        after = lambda i: F.element_at(other, -1).bitwiseXOR(F.get(other, i + 1))
        return F.transform(F.slice(before, F.lit(1), F.size(before) - 1), lambda x, i: x.bitwiseXOR(after(i)))

    return _let(xor_before(here), lambda before: _let(xor_before(earlier), lambda other: hashes(before, other)))


class LineDedup:
    def __init__(self, docs: DataFrame, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", short_partners: bool = False):
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("rid"), text.alias("text"))
        self.min_words = min_words
        self.partner_words = min_words - short_partners

    def lines(self) -> DataFrame:
        """h1, h2 (hashes of a distinct line's text), first (its earliest occurrence), n (occurrences), keys of its halves."""
        rows = line_rows(self.docs).withColumn("words", words_of(F.col("line")))
        n = F.size("words")
        halves = []
        for c in (n, n - 1):  # the shorter line's words, if this is the shorter or the longer one of a pair
            p = F.floor(c / 2).cast("int")
            halves += [F.xxhash64(c, F.lit("first"), F.slice("words", F.lit(1), p)), F.xxhash64(c, F.lit("last"), F.slice("words", n - (c - p) + 1, c - p))]
        keys = F.when(n >= self.min_words, F.array(*halves)).when(n >= self.partner_words, F.array(*halves[:2])).otherwise(F.array().cast("array<bigint>"))
        rows = rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), F.struct(*ROW, "no").alias("at"), keys.alias("keys"))
        return rows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n"))

    def near(self, lines: DataFrame) -> DataFrame:
        """h1, h2 of lines with an earlier line one edit away."""
        halves = lines.filter(F.size("keys") > 0).select("h1", "h2", F.explode("keys").alias("key"))
        shared = halves.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select("key")
        some = written(halves.join(shared, "key").select("h1", "h2").distinct().join(lines.select("h1", "h2", "first"), ["h1", "h2"]), "near-lines")
        places = some.select("h1", "h2", F.col("first.doc_id").alias("of_id"), F.col("first.rid").alias("of_rid"), F.col("first.no").alias("of_no"), "first")
        there = (F.col("rid") == F.col("of_rid")) & F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("no") == F.col("of_no"))
        texts = line_rows(self.docs).join(bounded_broadcast(places, places.count(), PLACE_BYTES), there).select("h1", "h2", "first", words_of(F.col("line")).alias("words")).dropDuplicates(["h1", "h2"])
        texts = written(texts, "near-line-words")
        n = F.size("words")
        variants = texts.filter(n >= self.min_words).select("h1", "h2", "first", F.posexplode(without_each("words")).alias("pos", "v"))
        variants = written(variants, "variants")
        whole = texts.select("h1", "h2", "first", sequence_hash("words").alias("v"), (n >= self.min_words).alias("asks"))
        earliest = lambda rows, *keys: rows.groupBy(*keys).agg(F.min("first").alias("earlier"), F.count(F.lit(1)).alias("m"))
        replaced = variants.join(earliest(variants, "v", "pos").filter("m > 1"), ["v", "pos"]).select("h1", "h2", "first", "earlier")
        longer = variants.join(whole.select("v", F.col("first").alias("earlier")), "v").select("h1", "h2", "first", "earlier")
        shorter = whole.filter("asks").join(earliest(variants, "v"), "v").select("h1", "h2", "first", "earlier")
        found = replaced.unionByName(longer).unionByName(shorter).filter(F.col("earlier") < F.col("first"))
        found = found.groupBy("h1", "h2").agg(F.min("earlier").alias("earlier"))
        mine = found.join(texts.select("h1", "h2", "words"), ["h1", "h2"])
        other = texts.select(F.col("first").alias("earlier"), F.col("words").alias("other"))
        return mine.join(other, "earlier").filter(one_edit(F.col("words"), F.col("other"))).select("h1", "h2")

    def gone(self) -> DataFrame:
        """of_id, of_rid, equal, near: the numbers of the lines that go, of each document that has any."""
        lines = written(self.lines(), "lines")
        near = self.near(lines).withColumn("near", F.lit(True)).dropDuplicates(["h1", "h2"])
        near = written(near, "near-found")
        known = lines.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").filter("n > 1 or near").drop("n")  # all others stay
        rows = line_rows(self.docs).select(*ROW, "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))
        seen = rows.join(known, ["h1", "h2"]).withColumn("equal", F.struct(*ROW, "no") != F.col("first")).filter(F.col("equal") | F.col("near"))
        # equal rows of documents repeat their lines: a set, bounded by the document's own lines
        found = seen.groupBy(*ROW).agg(F.collect_set(F.when(F.col("equal"), F.col("no"))).alias("equal"), F.collect_set(F.when(~F.col("equal"), F.col("no"))).alias("near"))
        return found.select(F.col("doc_id").alias("of_id"), F.col("rid").alias("of_rid"), "equal", "near")

    def clean(self) -> DataFrame:
        """One row per document: doc_id, n_lines, n_equal and n_near (lines that went), text (the lines that stay)."""
        with temporary(self.docs.sparkSession):
            gone = written(self.gone(), "gone-lines", keep=True)
        joined = self.docs.join(gone, (F.col("rid") == F.col("of_rid")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left")
        out = F.coalesce(F.concat("equal", "near"), F.array().cast("array<int>"))

        def stay(lines: Column) -> Column:
            """The lines without those that go: their numbers are a difference of sets, so that the time is in proportion to them."""
            kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
            return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

        return joined.select(
            "doc_id",
            F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
            F.coalesce(F.size("equal"), F.lit(0)).cast("long").alias("n_equal"),
            F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("n_near"),
            _let(F.split("text", "\n"), stay).alias("text"),
        )


def dedup_lines(docs: DataFrame, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", short_partners: bool = False) -> DataFrame:
    return LineDedup(docs, min_words, id_col, text_col, short_partners).clean()
