"""Sync against committed state, sessions of event streams, nested profiles."""

import datetime as dt
import json

from pyspark.sql import functions as F

from notemill.plans import sync
from notemill.sources import files, state
from notemill.streaming import imports

NOW = "2026-01-02T00:00:00Z"


def shot(spark, **hashes):
    return spark.createDataFrame([(f"notes/{k}.md", v) for k, v in hashes.items()], "path string, hash string")


def log(spark, *rows):
    return spark.createDataFrame([("2026-01-01T00:00:00Z", "updated", f"notes/{p}.md", n) for n, p in rows], "ts string, action string, path string, lineno long")


def test_sync_is_checked_planned_and_applied_once(spark, tmp_path):
    root = str(tmp_path)
    old, events = shot(spark, a="1", b="1", c="1"), log(spark, (1, "a"), (2, "b"))
    assert sync.check(state.current(spark, root), old, events).first().verdict == "missing"
    assert sync.apply(spark, root, old, lambda: events, NOW).version == 1
    assert sync.check(state.current(spark, root), old, events).first().asDict() == {
        "synced": True, "added": 0, "modified": 0, "removed": 0, "unlogged": 0, "timeline_only": 0, "rewound": False, "verdict": "healthy", "exit_code": 0}
    assert sync.apply(spark, root, old, lambda: events, NOW).version == 1, "nothing to write"

    new, grown = shot(spark, a="2", b="1", d="1"), [*((1, "a"), (2, "b")), (3, "a"), (4, "b")]
    at = state.current(spark, root)
    assert {(r.path[6:-3], r.state, r.kind) for r in sync.drift(at, new, log(spark, *grown)).collect()} == {("a", "modified", "logged"), ("b", None, "timeline_only"), ("c", "deleted", "unlogged"), ("d", "added", "unlogged")}
    assert sync.check(at, new, log(spark, *grown)).first().exit_code == 1
    appended = []

    def append(rows):
        for k, r in enumerate(rows.orderBy("path").collect()):
            appended.append((r.action, r.path))
            grown.append((5 + k, r.path[6:-3]))

    at = sync.apply(spark, root, new, lambda: log(spark, *grown), NOW, append)
    assert appended == [("deleted", "notes/c.md"), ("created", "notes/d.md")] and at.facts["timeline_event_count"] == 6 and at.version == 2
    assert sync.check(at, new, log(spark, *grown)).first().verdict == "healthy"
    assert sync.apply(spark, root, new, lambda: log(spark, *grown), NOW, append).version == 2 and len(appended) == 2


def test_rewound_logs_and_damaged_states(spark, tmp_path):
    root, files_now = str(tmp_path), shot(spark, a="1")
    sync.apply(spark, root, files_now, lambda: log(spark, (1, "a"), (2, "a"), (3, "a")), NOW)
    short = log(spark, (1, "a"))
    row = sync.check(state.current(spark, root), files_now, short).first()
    assert row.rewound and row.verdict == "inconsistent" and row.timeline_only == 1
    at = sync.apply(spark, root, files_now, lambda: short, NOW)
    assert at.version == 2 and sync.check(at, files_now, short).first().verdict == "healthy"
    (tmp_path / state.LOG / f"{3:020d}").write_text("no json")
    assert sync.check(state.current(spark, root), files_now, short).first().verdict == "damaged"
    assert sync.apply(spark, root, files_now, lambda: short, NOW).version == 4
    assert sync.check(state.current(spark, root), files_now, short).first().verdict == "healthy"


def moments(spark, *rows):
    return spark.createDataFrame([(s, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m), n, "updated") for s, m, n in rows], "stream long, at timestamp, lineno long, action string")


def test_sessions_and_what_is_captured(spark):
    rows = imports.sessions(moments(spark, (1, 0, 0), (1, 20, 1), (1, 49, 2), (1, 80, 3), (2, 0, 0)), "30 minutes")
    assert sorted((r.stream, r.events, r.first_line, r.last_line) for r in rows.collect()) == [(1, 1, 3, 3), (1, 3, 0, 2), (2, 1, 0, 0)]
    baseline = spark.createDataFrame([(1, 1)], "stream long, baseline long")
    assert sorted((r.stream, r.from_line, r.last_line) for r in imports.captured(rows, baseline).collect()) == [(1, 2, 2), (1, 3, 3), (2, 0, 0)]


def test_sessions_of_a_stream_are_told_when_closed(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def feed(*rows):
        moments(spark, *rows).coalesce(1).write.mode("append").json(folder)
        stream = spark.readStream.schema("stream long, at timestamp, lineno long, action string").json(folder)
        q = imports.sessions(stream, "30 minutes", late="10 minutes").writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted((r.stream, r.events, r.last_line) for r in spark.read.schema("stream long, events long, last_line long").parquet(out).collect())

    assert feed((1, 0, 0), (1, 20, 1)) == [], "more may come"
    assert feed((1, 40, 2), (2, 200, 0)) == [(1, 3, 2)], "one session over both feeds, closed by the time that has passed"
    assert feed((3, 400, 0)) == [(1, 3, 2), (2, 1, 0)]


def test_nested_profiles(spark):
    blocks = ['{"a": {"b": [1, {"c": "x"}]}, "n": 2.5, "none": null}', "[1]", "{bad", "", '"text"']
    notes = spark.createDataFrame([(str(i), f"# V\n```json\n{b}\n```\nmore\n```json\n{{}}\n```\n") for i, b in enumerate(blocks)] + [("n", None), ("p", "no block")], "path string, text string")
    rows = files.voice_profile(notes).select("path", F.try_variant_get("profile", "$.a.b[1].c", "string").alias("c"), F.try_variant_get("profile", "$.n", "double").alias("n"), F.to_json("profile").alias("all"))
    got = {r.path: r for r in rows.collect()}
    assert got["0"].c == "x" and got["0"].n == 2.5 and json.loads(got["0"].all) == json.loads(blocks[0])
    assert all(got[k].all is None for k in ("1", "2", "3", "4", "n", "p"))
