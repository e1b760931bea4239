"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Language identification drops documents whose language can't be told; the n-gram Jaccard join keeps
one document of each near-duplicate class; decontamination drops documents in which a benchmark
passage occurs; personal data is masked in the text of the rest; mixing repeats or drops documents
so that sources come near their target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.llm import decontaminate, langid, mixing, neardup, pii
from cuespark.llm.common import table
from cuespark.session import settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with no language at even odds, go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return neardup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; n_chars is that of the masked text."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy that the mix takes is a row, numbered from 1 in `copy`; size, target and taken beside it."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
]
ORACLE_SQL = None           # language identification, the forest and the coins have no SQL; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
