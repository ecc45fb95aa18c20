"""Queries over null, empty, letterless and long texts against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

TEXTS = [None, "", "  ", "123 !! 4", "漢字", "a few words", "word " * 30, "x" * 35 + " and more", "a\n\\\" b c\x85d", "\\\" " * 20_000 + "long words " * 5_000]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, TEXTS[i % len(TEXTS)], None if i % 7 == 3 else "en", None if i % 11 == 5 else f"src{i % 2}", None if i % 13 == 6 else i) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{d}/documents.parquet")
    return d


def same_as_sql(spark, d, name):
    got = [tuple(x) for x in entry.queries()[name](spark, d).collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
        want = con.execute(entry.oracle_sql()[name]).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_shortened_texts_without_letters(spark, odd):
    same_as_sql(spark, odd, "c15_shorten")


def test_candidates_of_texts_without_letters(spark, odd):
    same_as_sql(spark, odd, "c20_candidates")


def test_front_matter_with_long_quoted_texts(spark, odd):
    same_as_sql(spark, odd, "c2_any_front_matter")


def test_one_hash_over_a_large_group(spark, tmp_path):
    rows = [(i, None if i % 10 == 3 or i >= 5_000 else f"text {i}", "one" if i < 5_000 else "none" if i < 5_003 else None) for i in range(5_006)] + [(5_006, "x", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, str(tmp_path), "f22_fingerprint")
