import pytest
from pyspark.sql import functions as F

from notemill.functions import text as t


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("plain", "plain"), ("a <private>b</private> c", "a  c"), ("a <private>b\nc</private>d", "a d"), ("<private>x</private><private>y</private>z", "z"),
        ("a <PRIVATE>b</Private>", "a "), ("a <private>rest", "a "), ("a <private>b <private>c</private> d</private> e", "a  e"), ("a</private>b", "a</private>b"), (None, ""),
    ],
)
def test_privacy(spark, text, out):
    assert one(spark, text, t.strip_private) == out


def test_tokens(spark):
    assert one(spark, "The Cat's 2 cats and blå THE", t.tokens) == ["2", "bl", "cat", "cats", "s"]
    assert one(spark, None, t.tokens) == []


def test_sections_and_lines(spark):
    body = "# Loop: Title\nintro\n## Next Steps\n- [ ] do it\n## Why matters\nx\n### Next action\n- more\n"
    rows = one(spark, body, t.section_lines)
    assert [(r["name"], r["line"]) for r in rows] == [("next action", "- [ ] do it"), ("why it matters", "x"), ("next action", "- more"), ("next action", "")]
    assert one(spark, body, t.title) == "Title"
    assert one(spark, body, t.first_content_line) == "intro"
    assert one(spark, body, t.first_checkbox) == "do it"
    assert one(spark, "- first", t.first_content_line) == "first"


def test_front_matter(spark):
    text = "---\ntags:\n  - One\n  - two, THREE\nconfidence: \"0.7\"  # sure\nempty:\n---\nbody"
    front, body = t.body_and_front(F.col("x"))
    row = spark.createDataFrame([(text,)], "x string").select(front.alias("f"), body.alias("b"), t.normalise_tags(t.front_list(front, "tags")).alias("tags"), t.front_value(front, "empty").alias("e")).first()
    assert row.b == "body" and row.tags == ["one", "two", "three"] and row.e is None
    assert one(spark, "---\nno end", lambda c: t.body_and_front(c)[0]) is None
    assert one(spark, "---\nno end", lambda c: t.body_and_front(c)[1]) == "---\nno end"


def test_links(spark):
    rows = one(spark, "x\n[a](b.md) [[n|shown]] [[m]]\n[no](c.txt)", t.links)
    assert [(r["line"], r["target"], r["display"], r["wiki"]) for r in rows] == [(2, "n", "shown", True), (2, "m", "m", True), (2, "b.md", "a", False)]


def test_timestamps_and_slugs(spark):
    assert one(spark, "2024-01-02T03:04:05Z", t.timestamp) is not None
    assert one(spark, "2024-01-02", t.timestamp) is None and one(spark, "2024-13-02T03:04:05Z", t.timestamp) is None
    assert one(spark, "  It's a \"Test\" -- now ", t.slug) == "its_a_test_now"
    assert one(spark, "!!!", t.slug) == "untitled"
    assert one(spark, "one two  three four", lambda c: t.shorten(c, 12)) == "one two..."
    assert one(spark, "short", lambda c: t.shorten(c, 12)) == "short"


def test_whole_texts_reach_files_and_archive_loops(spark, tmp_path):
    from notemill.plans import analytics_queries, text_queries

    rows = [(2, "plain words " * 50 + "by week 12 finally", "en", "s"), (5, "plain words " * 50 + "finally", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert all("words finally\n" in r.text or "week finally\n" in r.text for r in text_queries.files(spark, str(tmp_path)).collect())
    assert {r.doc_id: r.kept for r in analytics_queries.x6_archive_loops(spark, str(tmp_path)).collect()} == {2: True, 5: False}
