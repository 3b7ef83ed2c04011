"""The corpus pipeline: language ID, near-duplicate join, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshrel.llm.decontamination import decontaminate
from meshrel.llm.frames import shared_folder, table
from meshrel.llm.jaccard import keep_one
from meshrel.llm.languages import keep_identified
from meshrel.llm.mixing import mix_sources
from meshrel.llm.suffixes import cut_repeats

#: A passage of over 50 words is about 300 bytes, and over 200 in all but odd cases.
REPEAT_BYTES = 200


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 of five-word shingles, the first by doc_id stays."""
    return keep_one(docs, k=5, per=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that occur elsewhere are cut from texts; documents left without words go."""
    return cut_repeats(docs, REPEAT_BYTES)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their copies."""
    return mix_sources(docs).where("copies > 0")


STAGES = [
    ("language_id", languages),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeats),
    ("decontamination", benchmarks),
    ("source_mix", mixture),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written in the shared checkpoint folder and read again."""
    folder = shared_folder(spark)
    run_id = spark.range(1).select(F.expr("uuid()").alias("u")).first()["u"]
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{run_id}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
