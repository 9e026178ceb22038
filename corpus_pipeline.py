"""The pipeline over ``documents``: each stage is one operator, its result the next one's input.

All stages but the last return the columns of ``documents``. Stages that clean texts keep every row;
``n_chars`` follows the text. Rows without doc_id are never removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm import line_dedup, near_dedup, packing, substring_dedup, toxicity
from listwright.llm.registry import send_package, table
from listwright.sources.storage import scratch

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorization machine scores at least ``TOXIC``."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id", 5, 0))
    scored = toxicity.scores(docs, toxicity.fit(docs, labels))
    return scored.where(F.col("score") < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that repeat or nearly repeat an earlier document's or place's line."""
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    gone = near_dedup.near_groups(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of passages that a document of smaller id has."""
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and places in the packed sequences."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("best_fit_packing", pack),
]

# SQL cannot fit the machine of the first stage, and knows no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every other stage is written in the shared folder and read again."""
    send_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
