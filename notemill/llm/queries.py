"""The queries of the operators, each over its whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as q

    docs = table(spark, sf_dir, "documents")
    return q.quality_rules(docs, q.fit_on_labels(spark, docs, table(spark, sf_dir, "labels")))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_classifier as q

    docs = table(spark, sf_dir, "documents")
    return q.classify(docs, q.fit_on_labels(spark, docs, table(spark, sf_dir, "labels")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id as q

    docs = table(spark, sf_dir, "documents")
    return q.identify(docs, q.fit(spark, docs, vocabulary("piece_bpe_32k.model")))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store as q
    from .scratch import Scratch

    path = f"{Scratch(spark, 'tokens').path}/ids"
    q.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return q.digest(q.read_tokens(spark, path))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat_format as q

    return q.digest(q.format_conversations(q.with_hostile(table(spark, sf_dir, "conversations"))))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter as q

    return q.judge_urls(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing as q

    return q.digest(q.pack(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate as q

    return q.leaks(table(spark, sf_dir, "documents"), q.indexes(table(spark, sf_dir, "benchmark")))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pitman_yor as q

    return q.score(spark, table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dedup as q

    return q.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup as q

    return q.digest(q.dedup_lines(spark, table(spark, sf_dir, "documents")))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence as q

    return q.audit(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle as q

    return q.digest(q.manifest(table(spark, sf_dir, "documents"), {"tampered": q.tampered_leaf()}))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_token_store, op3_chat_format, op4_packing, op5_language_id, op6_pitman_yor, op7_url_filter, op8_quality_rules, op9_decontaminate, op10_near_dedup, op11_line_dedup, op12_source_audit, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {
        "op3_chat_format": oracles.CHAT_FORMAT,
        "op10_near_dedup": oracles.NEAR_DEDUP,
        "op11_line_dedup": oracles.LINE_DEDUP,
        "op12_source_audit": oracles.SOURCE_AUDIT,
        "op13_merkle_manifest": oracles.merkle_manifest(),
    }
