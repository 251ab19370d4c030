"""A cleaning pipeline over documents: quality, exact copies, near copies, benchmark leaks, tokens.

Cases that all stages define alike: a null text counts as empty, whole texts are used whatever their length, an empty
table gives an empty one, and further columns of any name are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawprint.llm.common import written

#: Fixed parameters of the stages.
QUALITY_CUT = 0.3
NEAR_PERCENT = 80
WINDOW = 10


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    An empty text is scored like any other. Rows of one identifier go only if all of them are rejected, and rows of a null
    identifier never do. Without labels of both classes, all have the score of the one that there is, or 0.5.
    """
    from pawprint.llm.quality import drop_rejected

    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), QUALITY_CUT)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id. Null and empty texts are equal; a null doc_id loses to any other; of equal rows one stays."""
    from pawprint.llm.exact_dedup import drop_exact_copies

    return drop_exact_copies(docs, keep="smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Texts without words have no near copies. Rows of one identifier are told apart by their text; rows of a null identifier stay.
    """
    from pawprint.llm.near_dedup import drop_near_copies

    return drop_near_copies(docs, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark. Texts without words stay, and an empty benchmark drops nothing; rows of one identifier are told apart by their text."""
    from pawprint.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (byte-level BPE) and decoded_sha256 of the bytes that they decode to. A row for each row; an empty text has no ids."""
    import public_tokenizers

    from pawprint.llm.bpe import ByteBpe, read_ranks

    bpe = ByteBpe(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    ids = bpe.encode(docs)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL cannot fit the classifier or merge byte pairs; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
