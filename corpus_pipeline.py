"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import jaccard_join, mixing, packing, quality, queries, substring_dedup
from seriesloom.llm.common import ship, stage, table


def carried(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that an operator reads and the others in one, where no name of the operator's can replace them."""
    others = [c for c in docs.columns if c not in own]
    return docs.select(*own, *([F.struct(*others).alias("carried")] if others else []))


def restored(out: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    return out.select(*[F.col(c) if c in own else F.col("carried")[c].alias(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go.

    Null and empty texts weigh nothing and are drawn by their noise; repeated rows share theirs, so they stay or go
    together, as rows that tie at the last place do; without labels all stay; an empty table stays empty; other columns
    pass, whatever their names.
    """
    own = ["doc_id", "text"]
    return restored(quality.resample(carried(docs, *own), table(spark, sf_dir, "labels")), docs, *own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, one row of the smallest doc_id stays: five words, a similarity of 0.8.

    Null doc_ids come last and ties go to the row read first, so of repeated rows one stays. Texts that are null or hold
    no word link with nothing; only equal ones of one doc_id are one. Other columns pass; an empty table stays empty.
    """
    ship(spark)
    return jaccard_join.one_of_each(docs, jaccard_join.Options(n=5, at=80))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that occur again go; a text that loses some is its other words, joined by spaces; one that loses all goes.

    Texts that are null or shorter than a window stay as they are. Rows that repeat would lose all windows to each other:
    the stage before leaves one. n_chars is counted anew; other columns pass; an empty table stays empty.
    """
    ship(spark)
    own = ["doc_id", "text", "n_chars"]
    cut = substring_dedup.remove_repeats(carried(docs, *own)).where("n_removed = 0 or n_removed < n_words")
    cut = cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return restored(cut.withColumn("n_chars", F.length("text").cast("long")), docs, *own)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at least once, small ones up to one and a half times.

    A null source is one of its own; null texts have no tokens and are drawn with their block; repeated rows are drawn
    alike; other columns pass; an empty table stays empty.
    """
    ship(spark)
    own = ["doc_id", "text", "source"]
    return restored(mixing.mix_sources(carried(docs, *own), mixing.Options(repetition=1.5)), docs, *own)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens, a row a piece: the stage's own columns.

    Null texts are empty (their end id alone); repeated rows and null doc_ids have pieces of their own; ties in length go
    by doc_id, piece and place in the table; other columns are ignored; an empty table gives no pieces.
    """
    ship(spark)
    return packing.pack(packing.token_pieces(docs, queries.tokenizer_path("word_bpe_49k.json")))


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mix), ("packing", pack)]

#: SQL expresses neither the resampling nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
