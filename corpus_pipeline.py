"""A training-corpus pipeline of the operators in ``authorloom.llm``.

Quality classifier -> line dedup -> near-dedup (word shingles) -> benchmark
decontamination -> packing. Each stage takes (spark, docs, sf_dir); what it
returns is to be written as Parquet and read again as the next one's documents
(``run`` does so). All but the last return the columns of documents.

A stage's intermediate tables are deleted when the next stage begins, unless
the documents given to that are still to be read from them.

Defined results: documents with a null or empty text pass every filter that
has no ground to reject them (the classifier gives them the score of an empty
text), count as near duplicates of no other text, and are packed as their end
id; rows without a key are never dropped by the two dedup stages and the
decontamination; rows that repeat a key are one document to the line stage and
go or stay together in the near-dedup stage; of texts in a tie the smallest key
stays; very long texts are processed whole; an empty table gives no rows; other
columns are carried along up to packing, whatever their names.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from authorloom.llm import common, decontam, line_dedup, packing, quality, simhash, tokens

#: The stages' models and joins are not expressible in SQL; tests compare them with brute-force versions.
ORACLE_SQL = None


def _stage(f):
    """A stage that first deletes what the stage before it left behind."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        owner = f"pipeline {spark.sparkContext.applicationId}"
        common.free(owner, docs)
        common.reclaim(spark)
        with common.owned(owner):
            return f(spark, docs, sf_dir)

    return stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted on all labels given, calls low quality."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier line repeats, exactly or within one edit."""
    return line_dedup.remove(docs)


@_stage
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest key of each group of near duplicates: 5-word shingles, Jaccard similarity 0.8 or more."""
    return simhash.keep_similar(docs)


@_stage
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack_documents(docs, tokens.tokenizer_path())


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("simhash", simhash_stage), ("decontamination", benchmark_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, common.cut(stage(spark, docs, sf_dir), name)
        common.discard(before)
    common.free(f"pipeline {spark.sparkContext.applicationId}")
    return docs
