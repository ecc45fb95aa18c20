"""Corpus pipeline: quality rules, quality classifier, near-duplicates, benchmark decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. Classifiers are fitted on the
labelled rows of the raw tables in sf_dir and applied to all of docs.

Defined results: null and empty texts fail the quality rules; the near-duplicate stage takes rows by their texts, whatever ids they share or
lack, and leaves one row of repeated ones; an empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notemill.llm import decontaminate, near_dedup, packing, quality_classifier, quality_rules
from notemill.llm.queries import table, vocabulary
from notemill.llm.scratch import Scratch


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = quality_rules.fit_on_labels(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.filter_documents(docs, field)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.fit_on_labels(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.filter_documents(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.filter_documents(spark, docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.filter_documents(docs, decontaminate.indexes(table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(spark, docs, vocabulary("word_bpe_49k.json")), keep_tokens=True)


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_leaks),
    ("packing", packed),
]

#: Trained stages and packing can't be said in SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, name)
    return docs
