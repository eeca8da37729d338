"""A training corpus from raw documents, stage by stage; each stage is written as Parquet and read by the next.

1. quality: documents that the quality classifier rejects go.
2. lines: later matches of a line go; documents that lose all their words with them go.
3. near_duplicates: of each group of similar documents the one of least doc_id stays.
4. mixing: sources are mixed to their target weights; a document taken in two epochs is two rows.
5. packing: the documents' tokens are packed into sequences; a row per piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, line_dedup, mixing, packing, quality_model
from tidemark.llm.common import checkpoint_dir, table, words

#: Documents whose score is below it are rejected.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the input; labels of documents that aren't in it count for nothing."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score_documents(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= LEAST_QUALITY).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs)
    emptied = (F.col(f"{kept.columns[-1]}.n_removed") > 0) & (F.size(words(F.col("text"))) == 0)
    return kept.where(~emptied).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, keep_words=False)  # the other stages need the memory


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None  # a trained model and the tokenizer aren't SQL; tests/llm holds every stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every stage but it is written to the shared checkpoint folder."""
    docs, top = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
