import json

from pyspark.sql import functions as F

from notemill.operators import compose, mapping


def read(spark, text, escapes=False):
    df = spark.createDataFrame([(text,)], "text string").select(mapping.entries(F.col("text"), escapes).alias("e"))
    return [(".".join(e.path), e.value, e.kind) for e in df.first().e or []]


def test_entries_of_nested_text(spark):
    text = """# head
name: "a: b"   # said
n: 3
empty:
list: [a, "b, c", 'd']
deep:
  more:
    - x: 1
      y: ~
    -
      x: 2
    - plain # note
  flag: True
same:
- 1.5
- two
after: end
"""
    assert read(spark, text) == [
        ("name", "a: b", "str"), ("n", "3", "int"), ("empty", "", "empty"), ("list", "", "empty"), ("list.0", "a", "str"), ("list.1", "b, c", "str"), ("list.2", "d", "str"),
        ("deep", "", "empty"), ("deep.more", "", "empty"), ("deep.more.0.x", "1", "int"), ("deep.more.0.y", "~", "null"), ("deep.more.1.x", "2", "int"), ("deep.more.2", "plain", "str"), ("deep.flag", "True", "bool"),
        ("same", "", "empty"), ("same.0", "1.5", "float"), ("same.1", "two", "str"), ("after", "end", "str"),
    ]
    assert read(spark, None) == [] and read(spark, "") == [] and read(spark, "no key here\n- loose\n") == [("0", "loose", "str")]


def test_lookups(spark):
    text = "a: 1\na: 2\nlist:\n  - x\n  - y\none: z\nvoid:\nmap:\n  k: v\n"
    e = F.col("e")
    row = spark.createDataFrame([(text,)], "text string").select(mapping.entries(F.col("text")).alias("e")).select(
        mapping.scalar_at(e, "a").alias("a"), mapping.scalar_at(e, "map", "k").alias("k"), mapping.scalar_at(e, "no").alias("no"), mapping.list_at(e, "list").alias("list"),
        mapping.list_at(e, "one").alias("one"), mapping.list_at(e, "void").alias("void"), mapping.list_at(e, "no").alias("none"), mapping.scalars(e).alias("all"),
    ).first()
    assert (row.a, row.k, row.no, row.list, row.one, row.void, row.none) == ("2", "v", None, ["x", "y"], ["z"], [], None)
    assert row.all == {"a": "2", "list.0": "x", "list.1": "y", "one": "z", "map.k": "v"}


def test_round_trip_of_serialised_front_matter(spark):
    values = ["", "plain", "true", "Null", "with: colon", 'say "hi"', "back\\slash", "line\nbreak", "# no comment", "[not a list]", " padded ", "-", "~", "æ€", "1.5"]
    df = spark.createDataFrame([(i, v, [v, "x"]) for i, v in enumerate(values)], "i int, v string, l array<string>")
    front = compose.front_matter(v=(F.col("v"), False), l=(F.col("l"), True))
    files = df.select("i", "v", F.col("i").cast("string").alias("path"), F.concat(front, F.lit("\nbody\n")).alias("text"))
    got = {(int(r.path), r.key): r.value for r in mapping.any_front_matter(files, escapes=True).where("kind <> 'empty'").collect()}
    for i, v in enumerate(values):
        assert got.get((i, "v")) == v and got.get((i, "l.0")) == v and got.get((i, "l.1")) == "x", v


def test_cases(spark):
    text = """version: 1
cases:
  - id: c1
    query: "what: now"
    scope: dev
    expected_any:
      - notes/a.md
      - "notes/b.md"
  - query: second
    scope:
    expected_any: [notes/c.md]
  - id: third
    expected_any:
"""
    files = spark.createDataFrame([("x", text), ("y", "- id: top\n  query: q\n  expected_any:\n  - n\n"), ("z", ""), ("n", None)], "path string, text string")
    got = [tuple(r) for r in mapping.eval_cases(files).orderBy("file", "pos").drop("pos").collect()]
    assert got == [("x", "c1", "what: now", "dev", ["notes/a.md", "notes/b.md"]), ("x", "", "second", "all", ["notes/c.md"]), ("x", "third", "", "all", []), ("y", "top", "q", "all", ["n"])]


def test_vault_configuration(spark):
    texts = ["{}", "no json", "[1]", json.dumps({"queue_confidence_min": 0.95, "debounce_seconds": 0.1, "exclude_dirs": [" b", "a", "a", ""], "max_files_per_cycle": "x"}), None]
    got = mapping.vault_config(spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "path string, text string")).orderBy("path").collect()
    for row in (got[0], got[1], got[2], got[4]):
        assert row.queue_confidence_min == 0.7 and row.max_files_per_cycle == 50 and row.problems == [] and ".git" in row.exclude_dirs
    assert got[3].exclude_dirs == ["a", "b"] and got[3].max_files_per_cycle == 50
    assert got[3].problems == ["debounce_seconds is out of range", "queue_confidence_min exceeds auto_write_confidence_min"]
    config = mapping.vault_config(spark.createDataFrame([("v", texts[3])], "path string, text string"))
    assert [r.asDict() for r in mapping.vault_config(mapping.vault_text(config)).collect()] == [r.asDict() for r in config.collect()]
