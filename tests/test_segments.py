"""Index segments, places of rows without a window over a group, and what is built on them."""

import datetime as dt
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from notemill.operators import analytics, notes, places
from notemill.operators import rank as r
from notemill.sources import index as stored

DAY = dt.datetime(2026, 1, 1)


def files(spark, texts):
    rows = [(f"/v/notes/02_facts/{k}.md", f"# {k}\n## Statement\n{x}\n", DAY + dt.timedelta(days=d), len(x)) for k, (x, d) in texts.items()]
    return spark.createDataFrame(rows, "path string, text string, mtime timestamp, size long")


def same_as_rebuilt(spark, root, texts):
    whole = r.index_of(r.with_length(notes.candidates(notes.parse(files(spark, texts).withColumn("hash", F.sha2("text", 256))), "path", "mtime", "hash")))
    held = stored.load(spark, root)
    key = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert key(held.entries, "rel_path", "title", "statement", "mtime", "hash") == key(whole.entries, "rel_path", "title", "statement", "mtime", "hash")
    assert key(held.postings, "token", "rel_path", "n", "g", "dl") == key(whole.postings, "token", "rel_path", "n", "g", "dl")


def test_a_refresh_writes_what_changed_and_reads_as_a_rebuild(spark, tmp_path):
    root, texts = str(tmp_path / "i"), {f"n{k}": (f"word{k} common", 0) for k in range(40)}
    assert stored.refresh(files(spark, texts), root) == {"parsed": 40}
    sizes = lambda: [x["rows"] for x in stored.segments(spark, root)]
    texts |= {"n0": ("changed common", 1), "n1": (texts["n1"][0], 1), "new": ("fresh", 0)}
    del texts["n2"]
    assert stored.refresh(files(spark, texts), root) == {"reused": 37, "touched": 1, "parsed": 2, "removed": 1}
    assert sizes() == [40, 3]
    same_as_rebuilt(spark, root, texts)
    del texts["n3"]  # a segment that removes alone
    assert stored.refresh(files(spark, texts), root) == {"reused": 39, "removed": 1} and sizes() == [40, 3, 0]
    texts["n2"] = ("back again", 5)
    assert stored.refresh(files(spark, texts), root)["parsed"] == 1
    same_as_rebuilt(spark, root, texts)


def test_segments_of_like_size_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "FANOUT", 2)
    root, texts = str(tmp_path / "i"), {f"n{k}": ("one", 0) for k in range(70)}
    stored.refresh(files(spark, texts), root)
    for k in range(2):
        texts[f"n{k}"] = (f"again {k}", k + 1)
        stored.refresh(files(spark, texts), root)
    assert [x["rows"] for x in stored.segments(spark, root)] == [70, 2]
    same_as_rebuilt(spark, root, texts)


def test_postings_of_a_frequent_token_are_in_several_files(spark, tmp_path):
    rows = [(f"notes/{k:04d}", ["common", f"w{k}"]) for k in range(3000)]
    made = spark.createDataFrame(rows, "rel_path string, note_tokens array<string>").select(
        "rel_path", F.lit("fact").alias("type"), F.lit("").alias("status"), F.lit("dev").alias("scope"), F.lit("u").alias("updated"), F.current_timestamp().alias("updated_ts"), F.lit(0.5).alias("confidence"),
        "note_tokens", F.array().cast("array<string>").alias("tag_tokens"), F.lit("").alias("body"), F.lit("").alias("title"), F.lit("").alias("statement"),
    )
    stored.store(r.index_of(made), str(tmp_path / "i"))
    held = stored.load(spark, str(tmp_path / "i")).postings.where("token = 'common'").groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(held) > 1 and max(x["count"] for x in held) < 3000


def test_places(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    got = {x.id: x.pos for x in places.placed(df, "g", [F.col("x").desc(), F.col("id").asc()]).collect()}
    for g in ("a", "b", None):
        want = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        assert [got[x[2]] for x in want] == list(range(1, len(want) + 1))
    assert places.placed(df.where("false"), "g", [F.col("x").asc()]).count() == 0
    again = spark.createDataFrame([("g", "x")] * 7, "g string, x string")
    assert sorted(x.pos for x in places.placed(again, "g", [F.col("x").asc()]).collect()) == list(range(1, 8))


def test_fingerprints_in_parts(spark):
    rows = [("big", f"p{k:03d}", f"h{k}") for k in range(100)] + [("one", "p", "h")]
    df = spark.createDataFrame(rows, "g string, path string, hash string")

    def want(lines, part):
        while True:
            cut = [hashlib.sha256("".join(lines[i : i + part]).encode()).hexdigest() for i in range(0, len(lines), part)]
            if len(cut) == 1:
                return cut[0]
            lines = [x + "\n" for x in cut]

    for part in (4096, 8):
        got = {x.g: x.fingerprint for x in analytics.fingerprint(df.repartition(3), "g", part).collect()}
        assert got == {g: want(sorted(f"{p}\t{h}\n" for x, p, h in rows if x == g), part) if g == "big" or part == 4096 else got["one"] for g in ("big", "one")}
    assert analytics.fingerprint(df.where("false"), "g").count() == 0


def test_broken_links_by_ends_of_paths(spark):
    paths = spark.createDataFrame([(f"d{k}/readme.md",) for k in range(200)] + [("a/b/c.md",)], "path string")
    edges = spark.createDataFrame([("s", x) for x in ("readme.md", "d7/readme.md", "7/readme.md", "c.md", "b/c.md", "x/c.md", "a/b/c.md", "c", "missing.md", "missing.md")], "src string, dst string")
    assert sorted(x.dst for x in analytics.broken(edges, paths).collect()) == ["7/readme.md", "missing.md", "x/c.md"]


def test_nothing_of_the_index_is_half_written(spark, tmp_path):
    root, texts = str(tmp_path / "i"), {"a": ("one", 0)}
    stored.refresh(files(spark, texts), root)
    os.makedirs(tmp_path / "i" / "v-unfinished" / "entries")  # of a refresh that stopped
    same_as_rebuilt(spark, root, texts)


def test_a_refresh_does_not_undo_another(spark, tmp_path, monkeypatch):
    root, texts = str(tmp_path / "i"), {"a": ("one", 0)}
    stored.refresh(files(spark, texts), root)
    write = stored._write

    def slow(*args):
        monkeypatch.setattr(stored, "_write", write)
        stored.refresh(files(spark, texts | {"b": ("from another", 0)}), root)
        return write(*args)

    monkeypatch.setattr(stored, "_write", slow)
    with pytest.raises(stored.sinks.Conflict):
        stored.refresh(files(spark, texts | {"c": ("late", 0)}), root)
    same_as_rebuilt(spark, root, texts | {"b": ("from another", 0)})
