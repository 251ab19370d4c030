"""Exact dedup by content sort (DataFrame operations only).

Documents are range-partitioned by sampled splitters over (first characters, hash), sorted externally by
their whole text, and every run of equal neighbours - compared in full - becomes one group. Texts that hold
more than a share of all rows are salted by their row's identifier, so that such a group is spread over many
sort ranges; the group's size and the row that stays come from an aggregate that is
combined before its shuffle.

Defined cases: null text counts as empty; equal means byte-equal; a null identifier loses against any other;
of rows that repeat an identifier and text one stays; an empty table gives an empty result; other columns are
neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Characters of a text that lead the splitters, so that sampled keys stay small however long the texts are.
SPLITTER_CHARS = 24
#: A text is salted if it has more rows than this share of a sort range.
HOT_SHARE = 0.25
HOT_LEAST = 64


def _grouped(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """doc_id, text_sha256, keep_id, group_size, kept, and the whole row of docs as a struct."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is largest or smallest, not {keep}")
    parts = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("h"))
    choose = F.max if keep == "largest" else F.min
    # at most count / bound = parts / HOT_SHARE hashes
    bound = max(HOT_LEAST, int(docs.count() * HOT_SHARE / parts))
    hot = (
        rows.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > bound)
        .select(F.col("h").alias("hot_h"), F.ceil(F.col("n") / bound).alias("salts"))
    )
    merged = (
        rows.join(F.broadcast(hot), F.col("h") == F.col("hot_h"))
        .groupBy("t")
        .agg(choose("doc_id").alias("hot_best"), F.count(F.lit(1)).alias("hot_n"))
        .select(F.sha2("t", 256).alias("hot_sha"), "hot_best", "hot_n")
    )
    first = F.desc_nulls_last("doc_id") if keep == "largest" else F.asc_nulls_last("doc_id")
    run = Window.partitionBy("head", "h", "salt", "t")
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("salts"))).otherwise(F.lit(0).cast("long"))
    runs = (
        rows.join(F.broadcast(hot), F.col("h") == F.col("hot_h"), "left")
        .select("row", "doc_id", "t", "h", F.substring("t", 1, SPLITTER_CHARS).alias("head"), F.col("salts").isNotNull().alias("hot"), salt.alias("salt"))
        .repartitionByRange(parts, "head", "h", "salt")
        .withColumn("place", F.row_number().over(run.orderBy(first)))
        .withColumn("best", F.first("doc_id").over(run.orderBy(first)))
        .withColumn("n", F.count(F.lit(1)).over(run))
        .select("row", "doc_id", "hot", "place", "best", "n", F.sha2("t", 256).alias("text_sha256"))
    )
    keep_id = F.when(F.col("hot"), F.col("hot_best")).otherwise(F.col("best"))
    return runs.join(F.broadcast(merged), F.col("hot") & (F.col("text_sha256") == F.col("hot_sha")), "left").select(
        "row",
        "doc_id",
        keep_id.alias("keep_id"),
        F.when(F.col("hot"), F.col("hot_n")).otherwise(F.col("n")).alias("group_size"),
        ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. keep: largest or smallest identifier."""
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _grouped(only, "doc_id", "text", keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept."""
    return _grouped(docs, id_col, text_col, keep).filter("kept").select("row.*")
