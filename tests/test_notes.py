"""Listings, note text, validation, vectors and evaluation on small tables."""

import pytest
from pyspark.sql import functions as F

from notemill.functions import text as t
from notemill.operators import analytics, browse, compose, evaluate, extract, notes, render, validate
from notemill.schema import Settings
from notemill.sources import sinks, vectors


def rows(spark, *values, schema="text string"):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def test_edits_keep_the_rest(spark):
    text = "---\nscope: work\ntags: [a]\n---\n# T\n\n## Next action\n- [ ] old\n\n## Links\n- [[x]]\n"
    df = rows(spark, text, "no front")
    one = lambda c: [r[0] for r in df.select(c).collect()]
    assert one(compose.set_front(F.col("text"), "scope", F.lit("home"))) == [text.replace("scope: work", "scope: home"), "no front"]
    assert one(compose.set_front(F.col("text"), "note", F.lit("a $1 b")))[0] == text.replace("tags: [a]\n", 'tags: [a]\nnote: "a $1 b"\n')
    assert one(compose.add_checkbox(F.col("text"), "Next action", F.lit("new"))) == [text.replace("- [ ] old\n\n", "- [ ] old\n\n- [ ] new\n"), "no front"]
    assert one(compose.add_section(F.col("text"), "More", F.lit("x"))) == [text.replace("## Links", "\n## More\nx\n## Links"), "no front\n## More\nx\n"]


def test_front_matter_goes_in_as_it_comes_out(spark):
    df = rows(spark, ("yes", ["a b", "null", "c"]), ("it: is # so", []), schema="x string, tags array<string>")
    made = df.select(F.concat(compose.front_matter(source=(F.col("x"), False), tags=(F.col("tags"), True), lang=(F.lit(None).cast("string"), False)), F.lit("\nbody")).alias("text"), "x")
    front, body = t.body_and_front(F.col("text"))
    got = made.select("x", t.front_value(front, "source"), body, t.front_list(front, "tags")).collect()
    assert [(r[1], r[2]) for r in got] == [("yes", "body"), ("it: is # so", "body")] and got[0][3] == ["a b", "null", "c"]


def test_canonical_notes_parse_again(spark):
    kinds = rows(spark, ("loop", "Fix it", "a.md"), ("fact", "Fix it", "b.md"), ("fact", "Fix it", "c.md"), schema="kind string, statement string, origin string")
    cands = kinds.withColumns({"confidence": F.lit(0.9), "tags": t.strings("imported"), "scope": F.lit("dev"), "lang": F.lit("en")})
    made = compose.canonical(cands, spark.createDataFrame([("notes/05_open_loops/loop__fix_it.md",)], "path string"), F.lit("2026-01-01T00:00:00Z"))
    got = {r.rel_path: r for r in notes.candidates(notes.parse(made)).collect()}
    assert len(got) == 3 and "notes/02_facts/fact__fix_it.md" in got and "notes/05_open_loops/loop__fix_it.md" not in got
    assert all(r.statement == "Fix it" and r.tags == ["imported"] and r.confidence == 0.9 for r in got.values())
    assert [r.next_action for r in got.values() if r.type == "loop"] == ["Clarify and execute this loop"]


def test_validation(spark):
    df = rows(spark, ("ok", "notes/a.md"), ("", "../x"), ("x" * 2001, "/v/notes/../other"), ("a\x00", "/v/notes"), schema="q string, p string")
    got = df.select(validate.query(F.col("q")), validate.inside(F.col("p"), "/v/notes")).collect()
    assert [tuple(r) for r in got] == [(None, None), ("empty", "escapes_root"), ("too_long", "escapes_root"), ("null_bytes", None)]
    assert validate.settings(Settings()) == [] and len(validate.settings(Settings(import_write=2.0, import_queue=3.0, bm25=0.9))) == 4
    assert validate.known_keys({"bm25": 1, "gone": 2}) == ["gone"]


def test_listings(spark):
    df = rows(spark, ("a", "loop", None, "2"), ("b", "loop", "closed", "3"), ("c", "fact", "", "1"), schema="rel_path string, type string, status string, updated string")
    assert [r.rel_path for r in browse.typed(df, "loop", "open").collect()] == ["a"]
    assert {(r.rel_path, r.pos) for r in browse.listing(df, limit=1).collect()} == {("b", 1), ("c", 1)}
    with pytest.raises(KeyError):
        browse.tree(df.withColumn("scope", F.lit("dev")), sort="size")
    line = df.withColumns({"title": F.lit("T"), "question": F.lit(""), "statement": F.lit("s"), "next_action": F.lit("go"), "confidence": F.lit(0.5)}).select("rel_path", render.compact().alias("l"))
    assert {r.rel_path: r.l for r in line.collect()} == {"a": "? | untitled - next: go (updated 2 conf 0.5)", "b": "closed | untitled - next: go (updated 3 conf 0.5)", "c": "T - s (updated 1 conf 0.5)"}


def test_vectors_are_stored_by_model(spark, tmp_path):
    root, embed = str(tmp_path), lambda c: F.array(F.length(c).cast("float"))
    items = rows(spark, ("1", "h", "aa"), ("2", "h", "b"), schema="id string, hash string, text string")
    assert vectors.load(spark, root, "local", "m/x") is None and vectors.status(spark, root, "local", "m/x") == {"items": 0, "dims": 0}
    assert vectors.build(items, root, embed, "local", "m/x") == {"embedded": 2, "reused": 0, "removed": 0}
    assert vectors.build(items.where("id = '2'"), root, embed, "local", "m/x") == {"embedded": 0, "reused": 1, "removed": 1}
    assert vectors.status(spark, root, "local", "m/x") == {"items": 1, "dims": 1} and vectors.load(spark, root, "local", "other") is None
    sinks.point(spark, f"{root}/local/m_x", sinks.pointer(spark, f"{root}/local/m_x")["version"], {"items": "9", "dims": "1"})
    assert vectors.load(spark, root, "local", "m/x") is None
    vectors.clean(spark, root, "local", "m/x")
    assert vectors.status(spark, root, "local", "m/x")["items"] == 0
    assert vectors.allowed("local", "source") and not vectors.allowed("remote", "source") and vectors.allowed("remote", "notes")


def test_any_ranker_can_be_evaluated(spark):
    cases = rows(spark, (1, ["a", "b"]), (2, ["c"]), (3, ["z"]), schema="query_id int, expected array<string>")
    ranked = rows(spark, (1, "x", 1), (1, "b", 2), (2, "c", 1), schema="query_id int, rel_path string, rank int")
    got = evaluate.run(cases, lambda q: ranked.join(q, "query_id")).first()
    assert (got.cases, round(got.hit1, 4), round(got.hitk, 4), got.mrr) == (3, 0.3333, 0.6667, 0.5)


def test_rewound_logs_and_first_keys(spark):
    log = rows(spark, ("s", 1), ("s", 2), ("t", 5), ("t", 9), schema="stream string, lineno int")
    base = rows(spark, ("s", 7), ("t", 5), schema="stream string, baseline int")
    assert {(r.stream, r.lineno) for r in analytics.after_baseline(log, base).collect()} == {("s", 1), ("s", 2), ("t", 9)}
    keys = rows(spark, ("k", 2, "b"), ("k", 1, "a"), ("m", 3, "c"), schema="key string, n int, v string")
    assert {(r.key, r.n, r.v) for r in extract.first_of_key(keys, "n").collect()} == {("k", 1, "a"), ("m", 3, "c")}


def test_query_vectors_are_kept(spark):
    asked = []
    held = vectors.QueryVectors(lambda x: asked.append(x) or [float(len(x))], 2)
    assert {(r.query_id, r.query_vector[0]) for r in held(spark, {1: "abc", 2: " ", 3: "abc "}).collect()} == {(1, 3.0), (3, 3.0)}
    assert asked == ["abc"]


def test_events_and_probes(spark, tmp_path):
    events = rows(spark, ("t", "created", "notes/a.md", "x", "work"), ("t", "sleep", None, "", None), ("t", "bogus", "notes/a.md", "", None), ("t", "updated", "/etc", "", None), schema="ts string, action string, path string, desc string, activity_type string")
    bad = sinks.append_events(events, str(tmp_path / "j"), str(tmp_path / "m"))
    assert {r.action for r in bad.collect()} == {"bogus", "updated"}
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and {r.value for r in spark.read.text(str(tmp_path / "m")).collect()} == {"t | created | notes/a.md | x", "t | sleep | "}
    cold = []
    assert len(evaluate.probe(lambda: None, 3, lambda: cold.append(1))) == 3 and len(cold) == 3
    quality = rows(spark, (0.5, 0.5, 0.5), schema="hit1 double, hitk double, mrr double")
    row = evaluate.ab_row(quality, quality, {"eval": [1.0, 2.0], "query": [1.0]}, {"eval": [9.0], "query": [1.0]})
    assert row.select(evaluate.decide()).first()[0] == "regression"


def test_ingest_context_and_stems(spark):
    from notemill.operators import rank

    made = rows(spark, *[(f"/v/notes/02_facts/n{k}.md", f"---\nupdated: 2026-01-0{k + 1}T00:00:00Z\n---\n# T{k}\n## Statement\n{w}\n") for k, w in enumerate(["alpha beta", "beta gamma", "delta"])], schema="path string, text string")
    cands = notes.candidates(notes.parse(made))
    sources = rows(spark, (1, "beta gamma words"), (2, ""), schema="query_id int, text string")
    got = {r.query_id: r.related for r in rank.ingest_context(sources, rank.index_of(cands), F.lit("2026-01-10").cast("timestamp"), top_k=2).collect()}
    assert got == {1: ["notes/02_facts/n1.md", "notes/02_facts/n0.md"], 2: []}
    assert browse.by_stem(cands, rows(spark, ("n2",), ("zz",), schema="stem string")).first().rel_path == "notes/02_facts/n2.md"
    names = browse.saved_views(cands.withColumn("source", F.lit("inferred")), "tv_")
    assert spark.table("tv_inferred").count() == 3 and len(names) == 4


def test_lint_of_a_timeline(spark):
    from notemill.operators import lint

    lines = ["# Timeline", "2026-01-02T00:00:00Z | created | notes/a.md | x", "2026-01-01T00:00:00Z | updated | notes/*.md | x", "2026 nonsense", "Format: x"]
    df = rows(spark, *[(k + 1, x, 0) for k, x in enumerate(lines)], schema="lineno int, value string, stream int")
    assert {tuple(r) for r in lint.timeline(df).collect()} == {(3, "wildcard_path"), (3, "out_of_order"), (4, "invalid_format")}


def test_voice_and_session_notes(spark):
    held = rows(spark, ("p.md", "---\ncreated: 2020-01-01T00:00:00Z\n---\nold"), schema="path string, text string")
    profiles = rows(spark, ("p.md", '{"a": [1]}'), ("q.md", "{}"), schema="path string, profile string")
    got = {r.path: r.text for r in compose.voice_note(profiles, held, F.lit("2026-01-01T00:00:00Z")).collect()}
    assert "created: 2020-01-01T00:00:00Z\nupdated: 2026-01-01T00:00:00Z" in got["p.md"] and '```json\n{"a": [1]}\n```' in got["p.md"] and "created: 2026" in got["q.md"]
    commits = rows(spark, ("s", 2, "fix", "b"), ("s", 1, "decision", "a"), ("s", 3, None, "c"), schema="session string, pos int, kind string, message string")
    assert compose.session_note(commits, F.lit("2026-01-01T00:00:00Z")).first().text.endswith("# Session s\n\n- decision: a\n- fix: b\n")
