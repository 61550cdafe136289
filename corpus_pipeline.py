"""A corpus pipeline: language ID, exact dedup, near-duplicate join, decontamination, byte pairs.

Every stage takes (spark, docs, sf_dir) and returns rows with the columns of documents; the last one adds
``token_ids``, its texts being what the ids decode to. ``run`` writes each stage to the shared folder and
reads it back. Rows are followed by an id of their own within a stage, so repeated doc_ids do no harm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldcheck.llm import bpe, decontam, exact, jaccard, langid
from fieldcheck.llm.common import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and texts that are like no language learned, go."""
    return langid.keep_known(docs, langid.fitted(langid.labelled(docs)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest stays, then the smallest doc_id."""
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at Jaccard 0.8 or more, the smallest doc_id stays."""
    return jaccard.keep_first(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word passage of the benchmark go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as token ids, and as decoded from them."""
    return bpe.token_column(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("byte_pairs", byte_pairs)]

#: The first and the last stage are a trained network and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
