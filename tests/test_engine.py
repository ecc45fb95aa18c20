import os

import pytest
from pyspark.sql import functions as F

from notemill.functions import text as t
from notemill.operators import analytics, evaluate, extract, lint, notes, rank, semantic
from notemill.plans import retrieval
from notemill.schema import Settings
from notemill.sources import adapter, files, sinks
from notemill.streaming import imports

CORPUS = {  # path, scope, status, updated, confidence, tags, body
    "05_open_loops/loop__release_list.md": ("open", "2026-03-20", 0.9, "release, checklist, deploy", "# Loop: Release list\n## Question or task\nPrepare the next release\n## Next action\n- [ ] Do the release checklist\n"),
    "05_open_loops/loop__review.md": ("open", "2026-03-10", 0.85, "review, pending, task", "# Loop: Review\n## Question or task\nReview what is pending\n## Next action\n- [ ] Read it\n"),
    "02_facts/fact__deploy_target.md": ("", "2026-03-15", 0.95, "deploy, infrastructure", "# Deploy target\n## Statement\nWe deploy to the small cluster; see [[loop__review]]\n"),
    "03_preferences/pref__short.md": ("", "2026-02-20", 0.9, "communication, style", "# Short answers\n## Statement\nAnswers should be short\n"),
    "04_goals/goal__ship.md": ("", "2026-03-18", 0.9, "release, milestone", "# Ship version one\n## Statement\nShip the first release\n"),
    "06_concepts/concept__steps.md": ("", "2026-03-05", 0.85, "retrieval, ux", "# Stepwise detail\n## Statement\nShow little, then more\n"),
}


@pytest.fixture(scope="module")
def vault(tmp_path_factory):
    root = tmp_path_factory.mktemp("vault") / "notes"
    for path, (status, day, conf, tags, body) in CORPUS.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        front = f"---\ncreated: {day}T00:00:00Z\nupdated: {day}T00:00:00Z\ntags: [{tags}]\nconfidence: {conf}\nsource: user\nscope: dev\nlang: en\n" + (f"status: {status}\n" if status else "") + "---\n"
        (root / path).write_text(front + body)
    (root / ".hidden").mkdir()
    (root / ".hidden" / "x.md").write_text("hidden")
    (root / "readme.txt").write_text("no note")
    return str(root)


@pytest.fixture(scope="module")
def candidates(spark, vault):
    return notes.candidates(notes.parse(files.notes(spark, vault))).cache()


def ask(spark, *queries):
    rows = spark.createDataFrame([(str(i), q, s) for i, (q, s) in enumerate(queries)], "query_id string, query string, query_scope string")
    return rank.with_intents(rows.withColumn("query_tokens", t.tokens(F.col("query"))))


def NOW():
    return F.lit("2026-03-21").cast("timestamp")


def test_scan_and_candidates(spark, vault, candidates):
    assert files.notes(spark, vault).count() == 6 and files.tree(spark, vault).count() == 6
    row = candidates.where("type = 'loop' AND title = 'Release list'").first()
    assert row.rel_path == "notes/05_open_loops/loop__release_list.md" and row.next_action == "Do the release checklist" and row.has_next_action_checkbox
    assert row.tags == ["release", "checklist", "deploy"] and row.confidence == 0.9 and "Next: Do the" in row.snippet


@pytest.mark.parametrize("mode", ["legacy", "two_stage", "precomputed_index", "progressive_disclosure", "unknown"])
def test_modes_find_the_expected_notes(spark, candidates, mode):
    q = ask(spark, ("What should I do next for the release?", "dev"), ("What is the deploy target?", "all"))
    best = {r.query_id: r.rel_path for r in retrieval.rank_notes(q, candidates, NOW(), mode, 3).where("rank = 1").collect()}
    assert best == {"0": "notes/05_open_loops/loop__release_list.md", "1": "notes/02_facts/fact__deploy_target.md"}


def scored(spark, query, **changes):
    base = dict(rel_path="a", type="fact", status="", scope="dev", updated="2026-01-01", confidence=0.5, note_tokens=["release"], tag_tokens=["x"], body="b", title="t", statement="s", signal_score=0.0)
    rows = [base | changes, base | {"rel_path": "z"}]
    df = spark.createDataFrame(rows).withColumn("updated_ts", F.lit("2026-01-01").cast("timestamp"))
    q = ask(spark, query)
    signals = spark.createDataFrame([(r["rel_path"], r["signal_score"]) for r in rows], "note string, signal_score double")
    pool = rank.components(rank.pairs(q, rank.index_of(df.drop("signal_score")), signals=signals)).withColumn("bm25", F.lit(0.0))
    got = {r.rel_path: r.score for r in rank.rank(pool, NOW(), 5, Settings(signal=0.1)).collect()}
    return got.get("a", 0.0) - got["z"]


def test_score_relations(spark):
    assert scored(spark, ("release", "all"), type="id") > 0
    assert scored(spark, ("release", "all"), type="loop", status="closed") < 0
    assert scored(spark, ("release history", "all"), type="loop", status="closed") > 0
    assert scored(spark, ("release", "dev"), scope="home") < 0
    assert scored(spark, ("release", "all"), signal_score=0.5) > 0 > scored(spark, ("release", "all"), signal_score=-0.5)
    assert scored(spark, ("release", "personal"), scope="life") > 0


def test_aliases_bundle_and_views(spark, candidates):
    aliases = spark.createDataFrame([("release", 0, "ship version"), ("release", 1, "version")], "alias string, pos int, phrase string")
    row = rank.expand_aliases(ask(spark, ("the release", "all")), aliases).first()
    assert row.expanded == ["release", "ship", "version"] and [e.phrase for e in row.events] == ["ship version"]
    ranked = retrieval.rank_notes(ask(spark, ("release deploy", "all")), candidates, NOW(), "two_stage", 3)
    assert rank.bundle(ranked).count() == 3
    assert rank.view(ranked, "detail").columns[-1] == "confidence"


def test_signals(spark):
    rows = [("1", "retrieval_hit", "n", None), ("2", "retrieval_hit", "n", None), ("3", "affirmation", "n", None), ("1", "correction", "m", None), ("2", "correction", "m", None), ("3", "stale_flag", "m", None),
            ("1", "rating", "r", 3), ("2", "rating", "r", 9), ("3", "rating", "r", 6), ("4", "rating", None, 5)]
    got = {r.note: r for r in analytics.signal_summary(spark.createDataFrame(rows, "ts string, type string, note string, rating int")).collect()}
    assert got["n"].signal_score == 0.1 and got["m"].signal_score == -0.75
    assert (got["r"].rating_count, got["r"].rating_sum, got["r"].rating_min, got["r"].rating_max) == (3, 18, 3, 9) and set(got) == {"n", "m", "r"}


def test_logs_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z", "rating", "n", "", 99), ("2024-01-02T00:00:00Z", "bogus", "n", "", 1)], "ts string, type string, note string, query string, rating int")
    sinks.append_signals(rows, str(tmp_path / "s"))
    (tmp_path / "s" / "bad.json").write_text("{not json\n")
    got = files.signals(spark, str(tmp_path / "s")).where("ts IS NOT NULL").collect()
    assert [(r.type, r.rating, r.query) for r in got] == [("rating", 10, None)]
    assert files.signals(spark, str(tmp_path / "s"), since="2024-01-01T00:00:00Z").count() == 0
    lines = spark.createDataFrame([(1, "2024-01-01T00:00:00Z | created | notes/a.md | x | y"), (2, "- nothing")], "lineno int, value string")
    assert [(r.action, r.desc) for r in analytics.parse_timeline(lines).collect()] == [("created", "x | y")]
    sinks.replace(rows, str(tmp_path / "t"))
    sinks.replace(rows.limit(1), str(tmp_path / "t"))
    assert sinks.current(spark, str(tmp_path / "t")).count() == 1
    (tmp_path / "aliases.json").write_text('{"Commute": ["calendar", " "]}')
    assert [(r.alias, r.phrase) for r in files.aliases(spark, str(tmp_path / "aliases.json")).collect()] == [("commute", "calendar")]
    cases = files.eval_cases(spark, "# c\n- id: a\n  query: \"what now\"\n  scope: dev\n  expected_any:\n    - notes/x.md\n").first()
    assert (cases.query_id, cases.query, cases.query_scope, cases.expected) == ("a", "what now", "dev", ["notes/x.md"])
    assert files.settings({"bm25": "0.5"}).bm25 == 0.5
    assert files.state(spark, str(tmp_path / "none"), "a int").count() == 0


def test_lint_and_cases(spark, vault, candidates):
    parsed = notes.parse(files.notes(spark, vault))
    assert lint.notes(parsed).count() == 0
    bad = spark.createDataFrame([("/v/notes/05_open_loops/x.md", "---\ntags: [Bad!]\nconfidence: 2\nscope: moon\n---\n## Links\n-\n"), ("/v/notes/02_facts/y.md", "nothing")], "path string, text string")
    codes = {(r.rel_path[-4:], r.code) for r in lint.notes(notes.parse(bad)).collect()}
    assert {("x.md", "missing_created"), ("x.md", "bad_tag"), ("x.md", "confidence_out_of_range"), ("x.md", "bad_scope"), ("x.md", "loop_without_status"), ("x.md", "placeholder_link"), ("y.md", "missing_front_matter")} <= codes
    rows = spark.createDataFrame([("a", "q", "dev", ["gone"]), ("a", "", "moon", [])], "query_id string, query string, query_scope string, expected array<string>")
    assert {r.code for r in lint.cases(rows, candidates.select("rel_path")).collect()} == {"duplicate_id", "empty_query", "bad_scope", "nothing_expected", "missing_path"}


def test_snapshots_and_vectors(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert {(r.path, r.state) for r in analytics.diff(old, new).collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "added")}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vector array<float>")
    assert [r.id for r in semantic.ranked(v, q, 3).orderBy("rank").collect()] == [1, 3, 2]
    items = spark.createDataFrame([(1, "h", "t"), (2, "new", "tt")], "id long, hash string, text string")
    prev = spark.createDataFrame([(1, "h", [9.0]), (5, "x", [1.0])], "id long, hash string, embedding array<float>")
    out = {r.id: (r.state, list(r.embedding)) for r in semantic.rebuild(items, prev, lambda c: F.array(F.length(c).cast("float"))).collect()}
    assert out == {1: ("reused", [9.0]), 2: ("embedded", [2.0])}


def test_decisions(spark):
    cols = [f"{s}_{m}" for s in ("base", "new") for m in ("hit1", "hitk", "mrr", "eval_p95", "query_p95")]
    def decide(*new):
        return spark.createDataFrame([(0.5, 0.5, 0.5, 10.0, 10.0, *map(float, new))], cols).select(evaluate.decide()).first()[0]
    assert decide(0.5, 0.5, 0.6, 99, 99) == "beneficial" and decide(0.5, 0.4, 0.6, 1, 1) == "regression"
    assert decide(0.5, 0.5, 0.5, 12.4, 12.4) == "neutral" and decide(0.5, 0.5, 0.5, 12.6, 10) == "regression"


def test_extraction(spark):
    text = "I prefer short mails\n- Decision: move to the new plan\nVi må flytte alt nå\n- [ ] Investigate why builds fail\n[ ] Investigate why builds fail\n<private>I prefer secrets</private>\n"
    df = spark.createDataFrame([("90-journal/a.md", text)], "path string, text string")
    got = {(r.kind, r.statement) for r in extract.statements(df).collect()}
    assert got == {("pref", "I prefer short mails"), ("fact", "Decision: move to the new plan"), ("fact", "Vi må flytte alt nå"), ("loop", "Investigate why builds fail")}
    kept = extract.statements(df).where(extract.suits_path(F.concat(F.lit("/"), F.col("path")), F.lit(text), F.col("kind"), F.col("statement")))
    assert {r.kind for r in kept.collect()} == {"pref", "fact"}
    assert spark.range(1).select(extract.language(F.lit("jeg og du")), extract.language(F.lit("you and I")), extract.language(F.lit("hva if"))).first()[:] == ("no", "en", "mixed")


def test_streaming_import_equals_batch(spark, tmp_path):
    src = tmp_path / "source"
    src.mkdir()
    (src / "a.md").write_text("I prefer tea in the morning\n")
    (src / "b.md").write_text("Decision: we keep the old house\nI prefer tea in the morning\n")
    dirs = [str(tmp_path / x) for x in ("state", "out", "ck")]

    def run():
        q = imports.watch_sources(spark, str(src), *dirs, trigger={"availableNow": True})
        assert q.awaitTermination(120)

    run()
    got = lambda: sorted(r.statement for r in spark.read.parquet(dirs[1]).collect())
    assert got() == ["Decision: we keep the old house", "I prefer tea in the morning"]
    few = Settings(import_files=2, bucket_caps={"journal": 1})
    for k in range(7):
        (src / f"d{k}.md").write_text(f"I prefer colour number {k} of all\n")
    q = imports.watch_sources(spark, str(src), *dirs, trigger={"availableNow": True}, settings=few)
    assert q.awaitTermination(120)
    assert [s for s in got() if "colour" in s] == [f"I prefer colour number {k} of all" for k in range(7)]
    for k in range(7):
        (src / f"d{k}.md").unlink()
    (src / "c.md").write_text("I prefer tea in the morning\nI prefer milk with it\n")
    run()
    assert [s for s in got() if "colour" not in s] == ["Decision: we keep the old house", "I prefer milk with it", "I prefer tea in the morning"]


def test_queries_match_duckdb_on_one_table(spark):
    """A few registered queries against their SQL on the smallest data; all of them are checked the same way by the driver."""
    import duckdb

    from notemill import catalogue

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    con = duckdb.connect()
    for name in os.listdir(d):
        con.sql(f"create view {name[:-8]} as select * from '{d}/{name}'")
    for name in ("d18_two_stage", "d10_bm25", "f1_signal_summary", "j3_drift", "f10_alias_suggestions", "c8_front_matter", "k5_profiles"):
        got = catalogue.queries()[name](spark, d)
        want = con.sql(catalogue.oracle_sql()[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        key = lambda row: tuple(round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in row)
        a = sorted(map(key, (tuple(r[c] for c in cols) for r in got.collect())), key=repr)
        b = sorted(map(key, con.sql(f"select {', '.join(f'"{c}"' for c in cols)} from ({catalogue.oracle_sql()[name]})").fetchall()), key=repr)
        assert a == b, name


def test_adapter_flags(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert adapter.queries(spark, "/root/testdata/sf0.001").where("loop OR history OR pref").count() > 0
