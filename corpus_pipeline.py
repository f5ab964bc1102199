"""From documents to token ids: quality classifier, near-duplicates, repeated strings, source mix, byte-level BPE.

Each stage works on all rows that the stage before kept, written as Parquet and read again. An empty table gives empty tables. Rows with a null
doc_id are scored, compared and drawn as others are; of two equal rows near_dedup keeps one, the two being near duplicates of one another.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.bpe import encode
from strandloom.llm.common import shared_folder
from strandloom.llm.minhash_dedup import representatives
from strandloom.llm.mixing import mix
from strandloom.llm.quality_classifier import classify
from strandloom.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good; all of them if the labels have no positive to train it on. A null text is judged as an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).where("predicted = 1 or predicted is null").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8. Of a group the smallest doc_id stays, a null one last; null
    texts and those without words are like nothing and stay."""
    return representatives(docs, shingle=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that start twice or more. A document that loses all stays, as an empty text; a null text stays null."""
    out = remove_repeats(docs, window=200, as_text=True)
    return out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by weights 3, 1, 2, repeating, takes them. Null is a source of its own, the last; documents without words are
    drawn like others and count nothing."""
    return mix(docs, weights=(3, 1, 2), budget=1.5, most=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts; of a null or empty text none."""
    return encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"), "input_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("repeated_strings", repeated_strings),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: No stage but the mix's sizes can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
