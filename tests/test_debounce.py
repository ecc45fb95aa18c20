"""Debounced import as stateful streaming: bursts, restarts, repeated content, and the batch import as the measure."""

import json
import time

from pyspark.sql import functions as F

from notemill.operators import extract
from notemill.streaming import debounce

TEXT = "# Notes\nI prefer short answers in {0}\nDecision: use the small cluster for {0} from now\n"


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("".join(json.dumps({"path": p, "text": x, "mtime": f"2026-01-01T00:00:{s:02d}Z"}) + "\n" for p, x, s in rows))
    (folder / f".{name}").rename(folder / f"{name}.json")


def wait(spark, out, n, most=60):
    """The settled rows, as soon as there are n."""
    for _ in range(most * 2):
        time.sleep(0.5)
        try:
            rows = spark.read.schema(debounce.SETTLED).parquet(out).collect()
        except Exception:  # noqa: BLE001  nothing written yet
            rows = []
        if len(rows) >= n:
            return sorted((r.path, r.text, r.size) for r in rows)
    raise AssertionError(f"{rows} after {most} s")


def test_bursts_and_restarts(spark, tmp_path):
    log, out, cp = tmp_path / "log", str(tmp_path / "settled"), str(tmp_path / "cp")
    start = lambda: debounce.settle(debounce.changes(spark, str(log)), out, cp, quiet_ms=1500, every="500 milliseconds")
    put(log, "a", ("x.md", "one", 1), ("x.md", "three", 3), ("x.md", "two", 2), ("y.md", "why", 1), (None, "no path", 1))
    q = start()
    try:
        assert wait(spark, out, 2) == [("x.md", "three", 5), ("y.md", "why", 3)], "of a burst the newest version alone"
        put(log, "b", ("x.md", "three", 9), ("y.md", "æ", 9))  # x says what was told already
        assert wait(spark, out, 3)[-1] == ("y.md", "æ", 2)
    finally:
        q.stop()
    put(log, "c", ("x.md", "four", 20), ("y.md", "æ", 21))
    q = start()
    try:
        assert wait(spark, out, 4) == [("x.md", "four", 4), ("x.md", "three", 5), ("y.md", "why", 3), ("y.md", "æ", 2)]
    finally:
        q.stop()


def test_keys_are_kept_in_the_state_store(spark, tmp_path):
    folder, out, cp = tmp_path / "settled", str(tmp_path / "out"), str(tmp_path / "cp")

    def feed(name, *rows):
        made = spark.createDataFrame([(p, x, "h", len(x)) for p, x in rows], "path string, text string, hash string, size long").withColumn("mtime", F.current_timestamp())
        made.coalesce(1).write.mode("append").parquet(str(folder))
        q = debounce.extract_settled(spark, str(folder), out, cp, {"availableNow": True})
        q.awaitTermination()
        return spark.read.schema("path string, kind string, scope string, statement string, confidence double, key string, route string").parquet(out).collect()

    first = feed("1", ("04-dev/a.md", TEXT.format("mail")), ("04-dev/b.md", TEXT.format("mail")))
    batch = extract.statements(spark.createDataFrame([("04-dev/a.md", TEXT.format("mail"))], "path string, text string"))
    want = {(r.kind, r.statement) for r in batch.collect()}
    assert want and {(r.kind, r.statement) for r in first} == want and len({r.key for r in first}) == len(first), "each key once, as the batch import has it"
    again = feed("2", ("04-dev/c.md", TEXT.format("mail")), ("04-dev/d.md", TEXT.format("chat")))
    new = [r for r in again if r.key not in {x.key for x in first}]
    assert len(again) == len(first) + len(new) and new and all("chat" in r.statement and r.path == "04-dev/d.md" for r in new)
