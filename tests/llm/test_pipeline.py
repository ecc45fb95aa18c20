"""Every stage of the pipeline against a plain version of it, and on odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from notemill.llm import quality_classifier, quality_rules

from .test_duplicates_and_leaks import ITEMS, brute_components, changed, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public = pytest.importorskip("public_tokenizers")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("corpus")
    rng = random.Random(12)
    good = [(k, "\n".join(prose(rng, 30) + "." for _ in range(4))) for k in range(60)]
    bad = [(100 + k, " ".join(prose(rng, 1) + "###&&&" for _ in range(120))) for k in range(30)]
    copies = [(200 + k, changed(rng, good[k][1], 2)) for k in range(5)]
    leak = [(300, good[7][1][::-1] + " " + ITEMS[3][1])]
    rows = [(i, x, "en", "s", len(x)) for i, x in good + bad + copies + leak]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(range(60))
    assert out.agg(F.sum("length")).first()[0] > 0


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    """Nulls, repeated rows, one id with two texts, a leak in capitals, and columns named like those that operators make."""
    rng = random.Random(4)
    text = prose(rng, 80)
    rows = [*odd_rows, (20, text), (20, text), (20, prose(rng, 80)), (21, changed(rng, text, 1)), (None, text), (None, None), (22, prose(rng, 60) + " " + ITEMS[5][1].upper())]
    names = "doc_id long, text string, lang string, source string, n_chars long, node long, n_shingles string, score string, kept int, s1 int, _id int, row string, tokens int"
    return spark.createDataFrame([(i, x, "en", None, None, 1, "a", "b", 0, None, 5, "r", 2) for i, x in rows], names).cache()


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_rules_stage(spark, folder, odd):
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    field = quality_rules.fit_on_labels(spark, read("documents"), read("labels"))
    for docs in (read("documents"), odd, odd.limit(0)):
        got, judged = STAGES["quality_rules"](spark, docs, folder), quality_rules.quality_rules(docs, field).collect()
        assert got.columns == docs.columns
        assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in judged if r.kept)


def test_classifier_stage(spark, folder, odd):
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    model = quality_classifier.fit_on_labels(spark, read("documents"), read("labels"))
    for docs in (read("documents"), odd, odd.limit(0)):
        got, judged = STAGES["quality_classifier"](spark, docs, folder), quality_classifier.classify(docs, model).collect()
        assert got.columns == docs.columns and all(r.predicted == (r.score >= 0.3) for r in judged)
        assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in judged if r.predicted)


def test_near_duplicate_stage(spark, folder, odd):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in STAGES["near_dedup"](spark, docs, folder).collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    got = STAGES["near_dedup"](spark, odd, folder)
    assert got.columns == odd.columns
    rows = texts(odd)
    gone = [(4, "same text twice over"), next(r for r in rows if r[0] == 21), next(r for r in rows if r[0] is None and r[1] and len(r[1]) > 99)]
    gone.append(next(r for r in rows if r[0] == 20 and rows.count(r) == 2))
    for r in gone:
        rows.remove(r)
    assert texts(got) == rows
    assert STAGES["near_dedup"](spark, odd.limit(0), folder).count() == 0


def test_decontamination_stage(spark, folder, odd):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [x for _, x in ITEMS]
    leaked = lambda x: any(i in (x or "").lower() for i in items)
    for table in (docs, odd, odd.limit(0)):
        got = STAGES["decontamination"](spark, table, folder)
        assert got.columns == table.columns and texts(got) == [r for r in texts(table) if not leaked(r[1])]


def test_packing_stage(spark, folder, odd):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for table in (odd, odd.limit(0)):
        pieces = sorted(STAGES["packing"](spark, table, folder).collect(), key=lambda r: (r.sequence_id, r.offset))
        want = [[*encode.encode(r.text or "", add_special_tokens=False).ids, 2] for r in table.collect()]
        assert sum(r.length for r in pieces) == sum(map(len, want))
        for a, b in zip(pieces, pieces[1:], strict=False):
            assert b.offset == (a.offset + a.length if a.sequence_id == b.sequence_id else 0)
        whole = [list(memoryview(bytes(r.tokens)).cast("I")) for r in pieces if r.start == 0 and r.length == r.doc_tokens]
        assert all(x in want for x in whole) and len(whole) == sum(len(x) <= 4096 for x in want)
