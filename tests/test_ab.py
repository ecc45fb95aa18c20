import json

import pytest
from pyspark.sql import functions as F

from notemill.operators import notes, rank
from notemill.plans import ab
from notemill.sources import files, state

from .test_engine import CORPUS, NOW

CASES = """cases:
  - id: a
    query: What should I do next for the release?
    scope: dev
    expected_any: [notes/05_open_loops/loop__release_list.md]
  - id: b
    query: What is the deploy target?
    expected_any: [notes/02_facts/fact__deploy_target.md]
  - id: c
    query: zebra
    expected_any: [notes/04_goals/goal__ship.md]
  - id: d
    query: nothing is expected of this
"""


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("ab") / "notes"
    for path, (status, day, conf, tags, body) in CORPUS.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(f"---\nupdated: {day}T00:00:00Z\ntags: [{tags}]\nconfidence: {conf}\nsource: user\nscope: dev\n" + (f"status: {status}\n" if status else "") + "---\n" + body)
    (root / "cases.yaml").write_text(CASES)
    return str(root)


@pytest.fixture(scope="module")
def run(spark, corpus):
    index = rank.index_of(notes.candidates(notes.parse(files.notes(spark, corpus))))
    asked = ab.cases(spark.createDataFrame([("cases", CASES)], "path string, text string"))
    expected = asked.select("query_id", F.explode("expected").alias("rel_path"))
    arms = [ab.Arm("old", "precomputed_index"), ab.Arm("new", "two_stage")]
    rows = ab.outcomes(asked.drop("expected"), expected, index, arms, NOW(), depth=5).cache()
    return index, asked, arms, rows


def test_outcomes_and_quality(spark, run):
    _, _, _, rows = run
    got = {(r.arm, r.query_id): r for r in rows.collect()}
    assert set(got) == {(arm, q) for arm in ("old", "new") for q in "abc"}
    for arm in ("old", "new"):
        assert got[arm, "a"].rank == 1 and got[arm, "b"].hit1 == 1 and got[arm, "c"].rank is None and got[arm, "c"].rr == 0
    q = {(r.arm, r.part, r.value): r for r in ab.quality(rows).collect()}
    assert q["new", "all", ""].cases == 3 and abs(q["new", "all", ""].mrr - 2 / 3) < 1e-9 and q["old", "scope", "dev"].hitk == 1.0
    assert sum(r.cases for r in q.values() if r.part == "intent" and r.arm == "old") == 3


def test_pairs_of_made_up_ranks(spark):
    rows = spark.createDataFrame(
        [("a", "q1", 1), ("b", "q1", 2), ("a", "q2", None), ("b", "q2", 3), ("a", "q3", None), ("b", "q3", None), ("a", "q4", 4), ("b", "q4", 4)], "arm string, query_id string, rank int"
    ).withColumn("rr", F.coalesce(1 / F.col("rank"), F.lit(0.0)))
    assert {r.query_id: r.outcome for r in ab.paired(rows, "a", "b").collect()} == {"q1": "worse", "q2": "better", "q3": "missed", "q4": "same"}


def test_times_reports_and_baseline(spark, run, tmp_path):
    index, asked, arms, rows = run
    resets = []
    times = ab.timed(spark, asked.select("query_id"), arms, lambda arm, part: part.count(), runs=2, cold=True, reset=lambda: resets.append(1), most=2)
    kept = times.groupBy("arm", "kind").count().collect()
    assert {(r.arm, r.kind): r["count"] for r in kept} == {(a, k): n for a in ("old", "new") for k, n in (("eval", 2), ("query", 4))}
    assert len(resets) == 2 * 2 * (2 + 2) and times.where("ms <= 0 OR (kind = 'query' AND query_id IS NULL)").count() == 0

    quality, pairs = ab.quality(rows), ab.paired(rows, "old", "new")
    made = spark.createDataFrame([("old", "eval", 10.0), ("new", "eval", 100.0), ("old", "query", 1.0), ("new", "query", 1.0)], "arm string, kind string, ms double")
    decided = ab.verdict(quality, made, "old", "new")
    row = decided.first()
    assert row.decision == "regression" and row.new_eval_p95 == 100.0 and row.delta_mrr == 0
    report = json.loads(ab.report_json(decided, quality, pairs, facts={"k": "3"}).first()[0])
    assert report["facts"] == {"k": "3"} and report["outcomes"] == {"missed": 1, "same": 2} and report["changed"] == [] and report["verdict"]["decision"] == "regression"
    assert {x["value"] for x in report["quality"] if x["part"] == "scope"} == {"all", "dev"}
    text = [r.line for r in ab.report_markdown(decided, quality, pairs, "old", "new").orderBy("section", "pos").collect()]
    assert text[0] == "# old against new: regression" and "| mrr | 0.6667 | 0.6667 | +0.0000 |" in text and "| scope | dev | 1 | 1.0000 | 1.0000 |" in text and text[-1] == "|---|---|---|---|"

    at = ab.save_baseline(state.current(spark, str(tmp_path)), quality)
    worse = quality.withColumn("mrr", F.when(F.col("arm") == "new", F.col("mrr") - 0.1).otherwise(F.col("mrr")))
    assert {r.arm: (r.regressed, r.delta_mrr) for r in ab.against_baseline(at, worse).collect()} == {"old": (False, 0.0), "new": (True, -0.1)}


def test_corpora_of_both_arms(spark, corpus, tmp_path):
    here = ab.corpus(spark, corpus, "cases.yaml")
    assert {r.path for r in here.collect()} == {*CORPUS, "cases.yaml"} and ab.same_corpus(here, here).count() == 0
    changed = here.where("path <> 'cases.yaml'").withColumn("hash", F.when(F.col("path").startswith("02"), "x").otherwise(F.col("hash")))
    assert {(r.path, r.state) for r in ab.same_corpus(here, changed).collect()} == {("cases.yaml", "deleted"), ("02_facts/fact__deploy_target.md", "modified")}
    with pytest.raises(ValueError):
        ab.corpus(spark, corpus, "missing.yaml")
