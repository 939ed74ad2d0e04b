"""The corpus pipeline: documents in, a clean and mixed training corpus out.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``; the last
adds ``sample_prob``, the expected number of copies of the row: below 1 the
probability by which it was sampled, above 1 it is there repeatedly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm.common import materialize
from ledgerspark.llm.decontam import clean_documents
from ledgerspark.llm.langid import identified_documents
from ledgerspark.llm.mixing import sampled_documents
from ledgerspark.llm.neardup import deduplicated_documents
from ledgerspark.llm.substrings import trimmed_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a recognised language."""
    return identified_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each near-duplicate group (five-word shingles, 0.8)."""
    return deduplicated_documents(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier place of the corpus already holds."""
    return trimmed_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents and cuts stray benchmark passages from the others."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the raked source, language and topic shares; rare ones are repeated."""
    return sampled_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: No SQL can state these stages (models, components, hashes of word sequences);
#: tests/llm/test_pipeline.py holds each stage against a direct version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
