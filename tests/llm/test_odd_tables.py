"""Every operator on a table with columns named like those it makes or uses, against the same table without them."""

import random

import pytest
from pyspark.sql import functions as F

from notemill.llm import chat_format, decontaminate, language_id, near_dedup, packing, pitman_yor, quality_classifier, quality_rules, token_store, url_filter

from .test_duplicates_and_leaks import ITEMS, prose

public = pytest.importorskip("public_tokenizers")
NAMES = (
    "node", "n", "words", "score", "kept", "held_out", "held", "key", "comp", "block", "shard", "range", "part", "tokens", "start", "length", "predicted", "_id", "_text", "_hash", "_row", "_y", "s1", "s2",
    "registers", "n_shingles", "class_id", "first", "lang_pred", "item_id", "host", "path", "rule", "verdict", "by_rule", "role2", "n_turns", "text_hash", "doc_tokens", "row", "id",
)


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in NAMES if c not in df.columns])


@pytest.fixture(scope="module")
def tables(spark, odd_rows):
    rng = random.Random(17)
    rows = [*odd_rows, *((100 + k, prose(rng, 60)) for k in range(30)), (200, ITEMS[2][1]), (201, None)]
    docs = spark.createDataFrame([(i, x, "en" if (i or 0) % 2 else "de", "s", None) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").cache()
    labels = spark.createDataFrame([(100 + k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (101, None, None)], "doc_id long, quality int, toxic int").cache()
    return docs, labels


def by_documents(spark, name, docs, labels, tmp_path):
    if name == "quality_rules":
        return quality_rules.quality_rules(docs, quality_rules.fit_on_labels(spark, docs, labels))
    if name == "quality_classifier":
        return quality_classifier.classify(docs, quality_classifier.fit_on_labels(spark, docs, labels))
    if name == "language_id":
        return language_id.identify(docs, language_id.fit(spark, docs, public.path("piece_bpe_32k.model")))
    if name == "token_store":
        path = str(tmp_path / f"ids{len(docs.columns)}-{docs.count()}")
        token_store.write_tokens(docs, path, public.path("byte_bpe_50k.json"))
        return token_store.digest(token_store.read_tokens(spark, path))
    if name == "packing":
        return packing.digest(packing.pack(spark, docs.coalesce(1), public.path("word_bpe_49k.json"))).drop("sequence_id", "offset", "start", "length", "ids_crc32", "padded_length").distinct()
    if name == "pitman_yor":
        return pitman_yor.score(spark, docs)
    if name == "decontaminate":
        return decontaminate.leaks(docs, decontaminate.indexes(spark.createDataFrame(ITEMS, "item_id long, text string")))
    return near_dedup.near_duplicates(spark, docs)


@pytest.mark.parametrize("name", ["quality_rules", "quality_classifier", "language_id", "token_store", "packing", "pitman_yor", "decontaminate", "near_dedup"])
def test_documents(spark, tables, tmp_path, name):
    docs, labels = tables
    seen = lambda df: sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    plain = seen(by_documents(spark, name, docs, labels, tmp_path))
    assert plain == seen(by_documents(spark, name, clashing(docs), clashing(labels), tmp_path))
    empty = by_documents(spark, name, clashing(docs).limit(0), clashing(labels).limit(0), tmp_path)
    assert empty.count() == 0


def test_conversations_and_pages(spark):
    long = "x|>\\ " * 200_000
    talk = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (None, 0, "user", "a"), (2, None, None, None), (3, 0, "user", "b"), (3, 0, "user", "b")], "conv_id long, turn int, role string, text string")
    seen = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = seen(chat_format.digest(chat_format.format_conversations(talk)))
    assert got == seen(chat_format.digest(chat_format.format_conversations(clashing(talk)))) and any(r[3] == len(long) for r in got)
    pages = spark.createDataFrame([(1, "http://a.net/x"), (None, None), (2, "http://b.org/fr/"), (3, "zzz")], "page_id long, url string")
    assert seen(url_filter.judge_urls(pages)) == seen(url_filter.judge_urls(clashing(pages)))
