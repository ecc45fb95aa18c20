"""Items, their hashes, encoders and stored vectors."""

import datetime as dt
import hashlib
import json

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from notemill.operators import semantic
from notemill.sources import vectors

FRONT = "---\ntags: [b, a]\nscope: dev\nstatus: open\nlang: en\nconfidence: 0.90\nupdated: 2026-01-01T00:00:00Z\n---\n"


def files(spark, *rows):
    return spark.createDataFrame([(p, x, dt.datetime(2025, 5, 6, 7, 8, 9)) for p, x in rows], "path string, text string, mtime timestamp")


def test_items_and_their_hashes(spark):
    got = {r.path: r for r in semantic.items(files(
        spark, ("/v/notes/02_facts/a.md", FRONT + "# Title\nsays \"æ\" \\ this\n"), ("/v/notes/04_goals/goal_x.md", "just text"), ("/v/notes/02_facts/e.md", ""), ("/v/notes/02_facts/n.md", None))).collect()}
    a = got["/v/notes/02_facts/a.md"]
    record = {"title": "Title", "body": "# Title\nsays \"æ\" \\ this", "tags": "a,b", "scope": "dev", "status": "open", "lang": "en", "updated": "2026-01-01T00:00:00Z", "confidence": "0.9"}
    assert a.hash == hashlib.sha1(json.dumps(record, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert (a.id, a.type, a.text, a.updated) == ("notes:notes/02_facts/a.md", "fact", "Title\n# Title\nsays \"æ\" \\ this", "2026-01-01T00:00:00Z")
    x = got["/v/notes/04_goals/goal_x.md"]
    assert (x.text, x.updated, x.type) == ("goal x\njust text", "2025-05-06T07:08:09Z", "goal")
    assert got["/v/notes/02_facts/e.md"].text == "e" and got["/v/notes/02_facts/n.md"].hash is not None
    source = semantic.items(files(spark, ("src/a.md", "t")), "source").first()
    assert (source.id, source.type) == ("source:src/a.md", "source")


def test_any_field_changes_the_hash(spark):
    texts = [FRONT + "# T\nb"] + [FRONT.replace(*x) + "# T\nb" for x in (("[b, a]", "[b, c]"), ("dev", "work"), ("open", "closed"), ("en", "no"), ("0.90", "0.91"), ("2026", "2027"))] + [FRONT + "# U\nb", FRONT + "# T\nc"]
    same = [FRONT.replace("[b, a]", "[a, b]") + "# T\nb\n\n", FRONT.replace("0.90", "0.9") + "# T\nb", FRONT.replace("---\ntags", "---\nother: 1\ntags") + "# T\nb"]
    rows = semantic.items(files(spark, *[(f"/v/notes/02_facts/{i}.md", x) for i, x in enumerate(texts + same)])).select("path", "hash").collect()
    of = {int(r.path.split("/")[-1][:-3]): r.hash for r in rows}
    assert len({of[i] for i in range(len(texts))}) == len(texts) and {of[len(texts) + i] for i in range(len(same))} == {of[0]}


def letters(refused=()):
    def load():
        def encode(texts):
            assert len(texts) <= 2, "batches are bounded"
            for x in texts:
                if x in refused:
                    raise ValueError(f"{x} was encoded already")
            return [[float(x.count(c)) for c in "abc"] for x in texts]

        return encode

    return load


def test_only_changed_items_are_encoded_and_found(spark, tmp_path):
    root, rows = str(tmp_path), lambda **x: spark.createDataFrame([(k, f"h-{v}", v) for k, v in x.items()], "id string, hash string, text string").repartition(2)
    first = semantic.Encoder("letters", letters(), batch=2)
    assert vectors.search(spark.createDataFrame([(1, "a")], "query_id long, text string"), root, first, "local", "m") == (None, "missing_index")
    assert vectors.build(rows(x="aab", y="bcc", z="c"), root, first, "local", "m") == {"embedded": 3, "reused": 0, "removed": 0}
    strict = semantic.Encoder("strict", letters(("aab", "bcc")), batch=2)
    assert vectors.build(rows(x="aab", y="bcc", w="abc"), root, strict, "local", "m") == {"embedded": 1, "reused": 2, "removed": 1}
    assert {r.id: list(r.embedding) for r in vectors.load(spark, root, "local", "m").collect()} == {"x": [2, 1, 0], "y": [0, 1, 2], "w": [1, 1, 1]}
    asked = spark.createDataFrame([(1, "aab"), (2, "  "), (3, "cc"), (4, None)], "query_id long, text string")
    found, reason = vectors.search(asked, root, first, "local", "m", 1)
    assert reason == "" and {(r.query_id, r.id) for r in found.collect()} == {(1, "x"), (3, "y")}
    assert vectors.search(asked.where("query_id = 2"), root, first, "local", "m") == (None, "empty_query")
    assert vectors.told(spark, root, {"local": ["m", "none"]}) == ["- local/m items=3 dims=3", "- local/none none"]


def test_vectors_of_another_length_are_refused(spark, tmp_path):
    odd = spark.createDataFrame([("a", "h", [1.0, 2.0]), ("b", "h", [1.0])], "id string, hash string, embedding array<float>")
    vectors.store(odd, str(tmp_path), "local", "m")
    assert vectors.load(spark, str(tmp_path), "local", "m") is None
    vectors.store(odd.where("id = 'a'"), str(tmp_path), "local", "m")
    assert vectors.load(spark, str(tmp_path), "local", "m").count() == 1


def test_nearest_ties_zero_vectors_and_blocks(spark):
    rows = [(f"v{k:04d}", [float(k % 3), 1.0]) for k in range(2500)] + [("zero", [0.0, 0.0]), ("null", None)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 1.0]), (2, [0.0, 0.0])], "query_id long, query_vector array<float>")
    got = semantic.ranked(v, q, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, "v0002"), (1, "v0005"), (1, "v0008"), (2, "null"), (2, "v0000"), (2, "v0001")]
    assert abs(got[0].cosine - 1) < 1e-9 and got[3].cosine == 0
    assert semantic.ranked(v.where(F.lit(False)), q, 3).count() == 0


def test_search_ranks_as_its_sql(spark, tmp_path):
    draw = np.random.default_rng(3)
    near = np.round(draw.normal(size=8), 3) + draw.normal(size=(2600, 8)) * 10.0 ** -draw.integers(2, 5, (2600, 1))  # many agree to six digits
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(near)]
    rows[700:712] = [(700 + i, [1.0] + [0.0] * i + [8.0 * (i > 0)] + [0.0] * (6 - i)) for i in range(7)] + [(707 + i, rows[5][1]) for i in range(5)]
    rows[100], rows[200], rows[901], rows[902], rows[903] = (100, [0.0] * 8), (200, None), (901, None), (902, [0.0] * 8), (None, rows[300][1])
    rows[904] = (904, [float("nan")] + [1.0] * 7)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["e8_semantic_search"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        want = con.execute(entry.oracle_sql()["e8_semantic_search"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
