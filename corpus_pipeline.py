"""The corpus pipeline: toxic documents go, then repeated lines, near copies and benchmark passages; the rest is packed.

``STAGES`` lists its stages in order. Each takes the session, the documents that its
predecessor kept and the folder of the tables, and returns a DataFrame; ``run`` writes
each stage's result as Parquet in the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from sightline.llm.quality import crc32_of_id
from sightline.llm.store import saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon's judge, fitted on the labelled rows among them, doesn't find toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judge = toxicity.fit(docs, labels, train=crc32_of_id() % 5 != 0)
    return toxicity.reject_toxic(docs, judge)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later runs of three repeated lines, or of fewer with 50 words; those of which nothing is left go."""
    return line_dedup.remove_repeated_lines(docs, least_words=line_dedup.LEAST_WORDS, drop_emptied=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group at five words and similarity 0.8."""
    return jaccard.one_of_each(docs, shingle=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly such passages go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Learned judges, automata and packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
