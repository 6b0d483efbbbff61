"""A corpus pipeline of five stages over `documents`; each stage is written as Parquet and read again as the next one's input.

1. quality rules: rejected documents go; in the others, lines that fail go.
2. n-gram Jaccard join: the smallest doc_id of each group of near duplicates stays.
3. PII: personal data in texts is masked.
4. mixing: documents are repeated or left out so that sources get their target weights.
5. encoding: the ids of each text under merge-dropout, each copy by its own draws, checked to decode to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempograph.llm.common import read_table, shared_dir
from tempograph.llm.merge_dropout import encode_documents
from tempograph.llm.mixing import mix
from tempograph.llm.ngram_join import one_of_each
from tempograph.llm.pii import redact
from tempograph.llm.quality_rules import keep_clean


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))  # copies that mixing made; equal rows, so any order is one
    return encode_documents(docs.withColumn("copy", F.row_number().over(same)))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: Masks, shingle sets and merge-dropout can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
