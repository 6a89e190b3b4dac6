"""A training-data pipeline over `documents`, from raw rows to packed sequences.

1. toxicity     documents that the classifier chain calls toxic go
2. exact_dedup  of equal texts the row with the largest doc_id stays
3. near_dedup   of each class of near duplicates the smallest doc_id stays
4. secrets      secrets in the texts are masked, every document stays
5. packing      what is left is tokenised and packed into sequences

Each stage is one operator of beaconry.llm on all rows that the stage before it
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconry.llm import cuckoo, minhash, packing, secrets, toxicity
from beaconry.llm.common import materialise, table
from beaconry.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose last link's probability stays below the threshold.

    The labels are sf_dir's, where they still have a document. A null or empty text
    has no words and is judged by the model's bias alone; rows that repeat are
    judged each on its own; without rows there are none.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def _keyed(docs: DataFrame) -> DataFrame:
    """_row (all columns of docs, so that no name clashes), _id ('' where there is none), _sha."""
    return docs.select(F.struct(*docs.columns).alias("_row"), _id(), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("_sha"))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of _keyed() less those whose doc_id and text_sha256 are in gone; merged in order, so the cost is in proportion at every size."""
    gone = gone.select(_id(), F.col("text_sha256").alias("_sha"))
    return rows.join(gone.hint("merge"), ["_id", "_sha"], "left_anti").select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest doc_id.

    A null text counts as empty. Of rows that repeat both the id and the text the
    one with the least hash of all columns stays. Without rows there are none.
    """
    told = cuckoo.dedup(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"))
    gone = materialise(told.filter("NOT stays"), "copies")
    first = F.row_number().over(Window.partitionBy("_id", "_sha").orderBy(F.xxhash64("_row")))
    # The window deals the texts out once, by the keys of the join after it.
    return _without(_keyed(docs).withColumn("_n", first).filter("_n = 1"), gone)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id. Rows without doc_id stay.

    Null and empty texts are equal texts; rows that repeat id and text share one
    verdict, rows that repeat only an id are judged each by its text. Without rows
    there are none.
    """
    return _without(_keyed(docs), materialise(minhash.dedup(docs).filter("NOT kept").select("doc_id", "text_sha256").distinct(), "near"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked; null texts stay null, without rows there are none."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids; a null or empty text is its end's id alone, without rows there are no pieces."""
    return packing.pack(packing.tokenise(docs, vocabulary("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near), ("secrets", mask_secrets), ("packing", pack)]

#: SQL cannot express the stages; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to `documents`; each result is written as Parquet and read as the next stage's docs."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
