"""Benchmark decontamination by a distributed positional inverted index (DataFrame operations only).

Test items are cut into windows of consecutive words. Over all documents the occurrences of the test's terms are
counted; of each window the rarest terms are its anchors, and the index stores the postings (term, document,
position) of anchor terms only. A window's candidates come from the list of its rarest term; the lists of its other
anchors, shifted by their offsets, are intersected with it by equi-joins. What remains is compared word for word
with the document.

The test's tables are broadcast if their size, counted first, is under common.BROADCAST_BYTES, and joined by
shuffles otherwise.

Defined cases: null and empty texts have no words and no windows; an item with fewer words than a window is one
window; a null item_id counts as the empty string; documents that repeat an identifier are told apart by their text,
and equal rows get equal results; an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_broadcast, release, temporary, without, written

#: Fixed value: a word is a run of ASCII digits, ASCII lower-case letters (after lower-casing) and other characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lists that are intersected for a window.
ANCHORS = 3
ROW = ["rid", "doc_id"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def test_windows(benchmark: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, wid (hash of the window's words), words: a row for each window of each item."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(n)))).alias("words")).select("item_id", F.xxhash64("words").alias("wid"), "words").distinct()


class PositionalIndex:
    """Postings of the documents for the windows of a test set."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"):
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
        self.windows = written(test_windows(benchmark, n, item_col, item_text_col), "test-windows")
        self.n_windows = self.windows.count()
        self.n = n
        tokens = self.docs.select(F.explode(words_of(F.col("text"))).alias("term"))
        terms = self.windows.select(F.explode("words").alias("term")).distinct()
        counts = tokens.join(self._small(terms, self.n_windows * n), "term").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
        self.anchors = written(self._anchors(counts), "test-anchors")
        posted = self.docs.select(*ROW, F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
        wanted = self.anchors.select("term").distinct()
        self.postings = written(posted.join(self._small(wanted, self.n_windows * ANCHORS), "term").select("term", *ROW, "pos").distinct(), "postings")

    def _small(self, df: DataFrame, rows: int, row_bytes: int = 160) -> DataFrame:
        return bounded_broadcast(df, rows, row_bytes)

    def _anchors(self, counts: DataFrame) -> DataFrame:
        """wid, rank (1: the rarest), term, offset. Windows with a term that no document has get no anchors."""
        each = self.windows.select("wid", "words").dropDuplicates(["wid"]).select("wid", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
        each = each.join(self._small(counts, self.n_windows * self.n), "term", "left")
        complete = each.groupBy("wid").agg(F.count("freq").alias("found"), F.max("size").alias("size")).filter("found = size").select("wid")
        by_term = Window.partitionBy("wid", "term").orderBy("offset")
        rarest = Window.partitionBy("wid").orderBy("freq", "term")
        each = each.join(complete, "wid", "left_semi").withColumn("again", F.row_number().over(by_term)).filter("again = 1")
        return each.withColumn("rank", F.row_number().over(rarest)).filter(F.col("rank") <= ANCHORS).select("wid", "rank", "term", "offset")

    def _list(self, rank: int) -> DataFrame:
        """wid, row, start: where windows can start by their anchor of this rank."""
        one = self.anchors.filter(F.col("rank") == rank).select("wid", "term", "offset")
        return self.postings.join(self._small(one, self.n_windows), "term").select("wid", *ROW, (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0")

    def candidates(self) -> DataFrame:
        """Intersects the offset-adjusted lists from the rarest on."""
        found = self._list(1)
        for rank in range(2, ANCHORS + 1):
            has = self.anchors.filter(F.col("rank") == rank).select("wid", F.lit(True).alias("more"))
            flagged = found.join(self._small(has, self.n_windows), "wid", "left")
            same = self._list(rank).withColumnRenamed("doc_id", "other_id")
            left = flagged.filter("more").drop("more").join(same, ["wid", "rid", "start"], "left_semi")
            found = flagged.filter("more is null").drop("more").unionByName(left)
        return found

    def phrases(self) -> DataFrame:
        """Exact matches: rid, doc_id, wid, start (word position from 0), size."""
        found = written(self.candidates(), "candidates")
        release(self.docs.sparkSession)
        rows = found.count()
        words = self.windows.select("wid", "words").dropDuplicates(["wid"])
        asked = found.join(self._small(words, self.n_windows), "wid")
        only = bounded_broadcast(found.select("rid").distinct(), rows, 16)
        texts = self.docs.join(only, "rid", "left_semi").select(F.col("rid").alias("of"), F.col("doc_id").alias("of_id"), "text").dropDuplicates(["of", "of_id"])
        texts = texts.select("of", "of_id", words_of(F.col("text")).alias("doc_words"))
        there = asked.join(texts, (F.col("rid") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
        same = F.slice("doc_words", F.col("start") + 1, F.size("words")) == F.col("words")
        return there.filter(same).select(*ROW, "wid", "start", F.size("words").alias("size"))

    def near(self, within: int) -> DataFrame:
        """Proximity matches: rid, doc_id, wid, pos of the rarest anchor that has every other anchor at most within words away, in any order."""
        width = max(1, within)
        lists = [self.postings.join(self._small(self.anchors.filter(F.col("rank") == r).select("wid", "term"), self.n_windows), "term").select("wid", *ROW, "pos") for r in range(1, ANCHORS + 1)]
        found = lists[0]
        for rank, other in enumerate(lists[1:], 2):
            has = self.anchors.filter(F.col("rank") == rank).select("wid", F.lit(True).alias("more"))
            flagged = found.join(self._small(has, self.n_windows), "wid", "left")
            # positions are dealt to cells of the width asked for: matches lie in the same or a neighbouring cell
            cells = other.select(F.col("wid"), "rid", F.col("doc_id").alias("other_id"), F.col("pos").alias("other"), F.explode(F.array(*[F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)])).alias("cell"))
            asked = flagged.filter("more").drop("more").withColumn("cell", F.floor(F.col("pos") / width))
            close = asked.join(cells, ["wid", "rid", "cell"]).filter((F.abs(F.col("pos") - F.col("other")) <= within) & F.col("doc_id").eqNullSafe(F.col("other_id"))).select("wid", *ROW, "pos").distinct()
            found = flagged.filter("more is null").drop("more").unionByName(close)
        return found


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, **cols: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    with temporary(docs.sparkSession):
        return written(_contamination(PositionalIndex(docs, benchmark, n, **cols)), "contamination", keep=True)


def _contamination(index: PositionalIndex) -> DataFrame:
    matches = written(index.phrases(), "matches")
    before = Window.partitionBy(*ROW).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.groupBy(*ROW, "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    spans = spans.withColumn("past", F.max("end").over(before))
    hits = spans.groupBy(*ROW).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("past", F.lit(0))))).alias("n_hit"))
    names = index.windows.select("wid", "item_id").distinct()
    items = matches.select(*ROW, "wid").distinct().join(bounded_broadcast(names, index.n_windows, 160), "wid").groupBy(*ROW).agg(F.collect_set("item_id").alias("items"))
    found = hits.join(items.withColumnRenamed("doc_id", "items_doc"), (hits["rid"] == items["rid"]) & hits["doc_id"].eqNullSafe(F.col("items_doc")))
    found = found.select(hits["rid"].alias("hit_rid"), hits["doc_id"].alias("hit_id"), "n_hit", "items")
    rows = index.docs.select(*ROW, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    names_of = F.array_join(F.array_sort(F.coalesce("items", F.array().cast("array<string>"))), ",")
    return rows.join(found, (F.col("rid") == F.col("hit_rid")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(names_of, 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a window of the benchmark, all columns kept."""
    with temporary(docs.sparkSession):
        index = PositionalIndex(docs, benchmark, n, id_col=id_col, text_col=text_col)
        hit = written(index.phrases().select("rid").distinct(), "contaminated", keep=True)
    return without(docs, hit, [F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit("")))], 16)
