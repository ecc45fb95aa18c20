"""A session's text, derived tables and the migration of a timeline."""

import datetime as dt

from pyspark.sql import functions as F

from notemill.operators import analytics
from notemill.sources import sinks

NOW, TODAY = dt.datetime(2026, 3, 21), "2026-03-21"


def notes(spark):
    rows = [
        ("notes/i", "id", "home", "", 0.9, "user", "Who"), ("notes/f1", "fact", "home", "", 0.9, "user", "Known"), ("notes/f2", "fact", "home", "", 0.2, "user", "Doubtful"),
        ("notes/l", "loop", "dev", "open", 0.1, "tool", "To do"), ("notes/c", "loop", "dev", "closed", 0.9, "tool", "Done"), ("notes/x", "concept", "dev", "", 0.9, "user", "Idea"),
    ]
    df = spark.createDataFrame(rows, "rel_path string, type string, scope string, status string, confidence double, source string, title string")
    return df.withColumns({"updated_ts": F.lit(NOW), "updated": F.lit("2026-03-21T00:00:00Z"), "body": F.concat(F.lit("# T\n[[other]] words\n"), "title"), "tags": F.array(F.lit("t"), F.lit("t")), "statement": F.lit("s"), "text": F.lit("some words")})


def log(spark, *rows):
    return spark.createDataFrame([(ts, action, "notes/02_facts/a.md", n, s) for ts, action, n, s in rows], "ts string, action string, path string, lineno long, stream long")


def lines(df):
    return [(r.section, r.line) for r in df.orderBy("section", "pos").collect()]


def test_lines_of_a_session(spark):
    events = log(spark, ("2026-03-01T00:00:00Z", "sleep", 1, 7), ("2026-03-02T00:00:00Z", "updated", 2, 7), ("2026-03-20T00:00:00Z", "sleep", 1, 8))
    signals = spark.createDataFrame([("correction", None), ("retrieval_miss", "where"), ("retrieval_miss", "where"), ("retrieval_miss", "a")], "type string, query string")
    got = lines(analytics.boot_lines(notes(spark), events, signals, F.lit(NOW), TODAY))
    assert got == [
        (1, "- Open loops (dev): To do"), (1, "- Identity (home): Who"), (1, "- Facts (home): Known"),
        (2, "- Stream 7: 1 changes since it was tended, 20 days ago; due"), (2, "- Stream 8: 0 changes since it was tended, 1 days ago"),
        (3, "- Signals: 4"), (3, "- Corrections to look at: 1"), (3, '- Asked for most without a result: "where" (2)'),
    ]
    assert lines(analytics.boot_lines(notes(spark).where("false"), events.where("false"), signals.where("false"), F.lit(NOW), TODAY)) == []


def test_a_timeline_is_migrated_once(spark, tmp_path):
    text = ["# Timeline", "", "2026-01-01T00:00:00Z | created | notes/05_open_loops/a.md | begun | well", "2026-01-02T00:00:00Z | moved | notes/x | no", "2026-01-03T00:00:00Z | sleep | - | night", "no line"]
    md = spark.createDataFrame(list(enumerate(text)), "lineno long, value string")
    path = str(tmp_path / "log")
    assert sinks.ensure_jsonl(md, path) == 2 and sinks.ensure_jsonl(md, path) == 0
    got = sorted(tuple(r) for r in spark.read.json(path).select("lineno", "action", "path", "desc", "type").collect())
    assert got == [(2, "created", "notes/05_open_loops/a.md", "begun | well", "loop"), (4, "sleep", "-", "night", "other")]


def test_derived_tables(spark, tmp_path):
    sinks.derived(notes(spark), str(tmp_path))
    read = lambda name: spark.read.json(str(tmp_path / name))
    assert {(r.src, r.target) for r in read("links").collect()} == {(r.rel_path, "other") for r in notes(spark).collect()}
    assert read("index").count() == 6 and read("tags").count() == 6 and {r.pos for r in read("catalogue").where("type = 'fact'").collect()} == {1, 2}
