"""A corpus pipeline: raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept and is written as Parquet before the
next one reads it. All stages but the last return ``COLUMNS`` of all documents that they keep,
whatever other columns there are; empty tables go through all stages and give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltrace.llm import decontam, line_dedup, near_dup, packing, toxicity
from siltrace.llm.queries import TOXIC_FROM, tokenizer_path
from siltrace.session import shared_dir
from siltrace.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection threshold.

    Null and empty texts score as texts without words and stay; an empty table gives no rows.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).where(F.col("_score") < TOXIC_FROM).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks and passages of lines that an earlier document holds; ``n_chars`` follows.

    Null texts stay null; no document is dropped; other columns than ``COLUMNS`` go.
    """
    out = line_dedup.line_dedup(docs)
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by runs of five words; null and empty texts stay."""
    return near_dup.deduplicated(docs, shingle=5, percent=80).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts have none and stay."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens; a null or empty text is its end mark alone."""
    return packing.packed_sequences(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Models and tokens can't be expressed in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
