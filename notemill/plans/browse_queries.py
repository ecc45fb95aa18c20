"""Queries of listings, note text, validation, briefings, vectors and state over the adapter's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import analytics as an
from ..operators import browse as b
from ..operators import compose as c
from ..operators import evaluate as ev
from ..operators import extract as x
from ..operators import lint
from ..operators import notes as n
from ..operators import rank as r
from ..operators import render
from ..operators import validate as v
from ..schema import STATUSES
from ..sources import adapter as a
from ..sources import index as stored
from ..sources import sinks, vectors
from .analytics_queries import _EDGES, _SNAP, _edges, _snapshots
from .registry import query
from .text_queries import files

_STATUS = "CASE WHEN type <> 'loop' THEN '' WHEN doc_id % 4 = 2 THEN 'open' ELSE status END"


def _loops(spark: SparkSession, d: str) -> DataFrame:
    """Notes, some of whose loops lack a status."""
    return a.notes(spark, d).withColumn("status", F.when((F.col("type") == "loop") & (F.col("doc_id") % 4 == 2), F.lit(None)).otherwise(F.col("status")))


@query(f"WITH {a.SQL_NOTES}, r AS (SELECT rel_path, type, updated, {_STATUS} AS status FROM notes) SELECT rel_path, type, status, CAST(row_number() OVER (PARTITION BY type ORDER BY updated DESC, rel_path DESC) AS INT) AS pos FROM r WHERE type <> 'loop' OR status = 'open'")
def a3_typed_notes(spark: SparkSession, d: str) -> DataFrame:
    return b.listing(_loops(spark, d), "all", "open").select("rel_path", "type", "status", F.col("pos").cast("int").alias("pos"))


@query(f"WITH {a.SQL_NOTES}, r AS (SELECT rel_path, type, updated, {_STATUS} AS status FROM notes) SELECT rel_path, status FROM r WHERE type = 'loop' QUALIFY row_number() OVER (ORDER BY updated DESC, rel_path DESC) <= 15")
def a4_browse_loops(spark: SparkSession, d: str) -> DataFrame:
    return b.listing(_loops(spark, d), "loop", limit=15).select("rel_path", "status")


@query("SELECT doc_id, '/v/notes/00_inbox/n' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 = 0 THEN 'n' || doc_id ELSE 'Item ' || doc_id END AS title FROM documents")
def a20_inbox(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = a.table(spark, d, "documents").select("doc_id", F.concat(F.lit("/v/notes/00_inbox/n"), i, F.lit(".md")).alias("path"), F.concat(F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("# Item "), i, F.lit("\n"))), F.regexp_replace("text", "(?m)^#", "")).alias("text"))
    found = b.inbox(rows)
    return found.select(F.regexp_extract("path", r"n(\d+)\.md$", 1).cast("long").alias("doc_id"), "path", "title")


_TREE = f"WITH {a.SQL_NOTES}, q AS (SELECT *, contains(lower(title || ' ' || body || ' ' || array_to_string(tags, ' ')), 'tion') AS hit FROM notes)"


@query(_TREE + " SELECT rel_path, CAST(row_number() OVER (PARTITION BY type ORDER BY confidence DESC, updated DESC, rel_path DESC) AS INT) AS pos FROM q WHERE hit AND list_contains(tags, 'fr') AND scope IN ('dev', 'work')")
def d26_tree(spark: SparkSession, d: str) -> DataFrame:
    return b.tree(a.notes(spark, d), ("dev", "work"), "fr", "tion", "confidence").select("rel_path", F.col("pos").cast("int").alias("pos"))


@query(f"WITH {_EDGES}, m AS (SELECT DISTINCT src, 'a/' || trim(dst, '/') || '.md' AS dst FROM e WHERE length(trim(dst, '/')) > 0 AND regexp_matches(trim(dst, '/'), '^[a-z0-9]+$')), p AS (SELECT DISTINCT 'notes/02_facts/' || trim(dst, '/') || '.md' AS rel_path, trim(dst, '/') AS s FROM e WHERE length(dst) % 2 = 0 AND regexp_matches(trim(dst, '/'), '^[a-z0-9]+$')) SELECT DISTINCT src, rel_path FROM m JOIN p ON regexp_extract(m.dst, '([^/]*)\\.md$', 1) = p.s")
def g12_links_by_stem(spark: SparkSession, d: str) -> DataFrame:
    plain = _edges(spark, d).withColumn("s", F.regexp_replace("dst", "^/+|/+$", "")).where(F.col("s").rlike("^[a-z0-9]+$"))
    links = plain.select("src", F.concat(F.lit("a/"), "s", F.lit(".md")).alias("dst"))
    notes = plain.where(F.length("dst") % 2 == 0).select(F.concat(F.lit("notes/02_facts/"), "s", F.lit(".md")).alias("rel_path")).distinct()
    return b.links_by_stem(links, notes)


@query(f"WITH {a.SQL_NOTES} SELECT 'tag' AS kind, tag AS value, count(DISTINCT rel_path) AS n FROM (SELECT rel_path, unnest(tags) AS tag FROM notes) GROUP BY tag UNION ALL SELECT 'scope', scope, count(*) FROM notes GROUP BY scope UNION ALL SELECT 'type', type, count(*) FROM notes GROUP BY type")
def f23_store_groups(spark: SparkSession, d: str) -> DataFrame:
    return b.groupings(a.notes(spark, d))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'loop' WHEN 1 THEN 'fact' WHEN 2 THEN 'pref' WHEN 3 THEN 'concept' WHEN 4 THEN 'concept' ELSE 'id' END AS type FROM documents")
def c24_type_of_name(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 6 == 0, "loop__").when(i % 6 == 1, "fact__").when(i % 6 == 2, "pref__").when(i % 6 == 3, "concept__").when(i % 6 == 4, "my_loop__").otherwise("id__")
    return a.table(spark, d, "documents").select("doc_id", b.type_of_name(F.concat(F.lit("/v/"), name, "source", F.lit(".md"))).alias("type"))


@query(r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['notes/02_facts/' || doc_id || '.md'] WHEN 1 THEN list_sort(['/home/u/v/notes/02_facts/' || doc_id || '.md', 'notes/02_facts/' || doc_id || '.md'])
  WHEN 2 THEN list_sort(['notes\a' || doc_id || '.md', 'notes/a' || doc_id || '.md']) ELSE ['other/' || doc_id] END AS forms FROM documents""")
def c26_expected_paths(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    given = F.when(i % 4 == 0, F.concat(F.lit(" notes/02_facts/"), i, F.lit(".md"))).when(i % 4 == 1, F.concat(F.lit("/home/u/v/notes/02_facts/"), i, F.lit(".md"))).when(i % 4 == 2, F.concat(F.lit("notes\\a"), i, F.lit(".md"))).otherwise(F.concat(F.lit("other/"), i))
    return a.table(spark, d, "documents").select("doc_id", b.equal_paths(given).alias("forms"))


_SCALARS = ("42", "-7", "3.14", "true", "FALSE", "null", "~", "", "[a, b]", '"quoted 1"', "plain text", "'12'", "1e5", "2.5e3", ".5", "no  # why")
_KINDS = ("int", "int", "float", "bool", "bool", "null", "null", "null", "list", "str", "str", "int", "str", "float", "float", "str")


@query("SELECT CAST(doc_id % 16 AS INT) AS k, [" + ", ".join(f"'{k}'" for k in _KINDS) + "][CAST(doc_id % 16 + 1 AS INT)] AS kind, count(*) AS n FROM documents GROUP BY ALL")
def c3_scalar_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("doc_id") % 16).cast("int")
    rows = a.table(spark, d, "documents").select(k.alias("k"), F.element_at(t.strings(*_SCALARS), k + 1).alias("value"))
    return rows.select("k", c.scalar_kind(F.col("value")).alias("kind")).groupBy("k", "kind").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 13 = 0 OR doc_id % 9 = 0 THEN '2025-01-01T00:00:00Z' ELSE '2024-01-02T03:04:05Z' END AS updated, CASE WHEN doc_id % 13 = 0 THEN 'assistant' ELSE 'user' END AS source,
  CASE WHEN doc_id % 13 = 0 OR doc_id % 8 = 0 THEN 'personal' ELSE 'dev' END AS scope, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'open' END AS status FROM documents""")
def c9_structured_front(spark: SparkSession, d: str) -> DataFrame:
    rows = c.with_defaults(n.parse(files(spark, d)), F.lit("2025-01-01").cast("timestamp"))
    return rows.select(F.regexp_extract("rel_path", r"n(\d+)\.md$", 1).cast("long").alias("doc_id"), F.date_format("updated_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"), "source", "scope", "status")


@query("""SELECT doc_id, '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'tags: [' || source || ', "yes", "two words"]' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'title: "a \\"b\\""' || chr(10) ELSE '' END || 'empty: ""' || chr(10) || '---' AS front FROM documents""")
def c10_front_matter_out(spark: SparkSession, d: str) -> DataFrame:
    made = c.front_matter(
        id=(F.col("doc_id"), False), lang=(F.col("lang"), False), tags=(F.array("source", F.lit("yes"), F.lit("two words")), True), title=(F.when(F.col("doc_id") % 2 == 0, 'a "b"'), False), empty=(F.lit(""), False),
    )
    return a.table(spark, d, "documents").select("doc_id", made.alias("front"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 4 THEN 'act ' || doc_id ELSE '' END AS next_action, CASE WHEN doc_id % 6 = 4 THEN '' ELSE trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')) END AS statement FROM documents")
def c22_note_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = c.parts(n.parse(files(spark, d)))
    return rows.select(F.regexp_extract("rel_path", r"n(\d+)\.md$", 1).cast("long").alias("doc_id"), "next_action", "statement")


_B13 = r"""WITH k AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'loop' WHEN 1 THEN 'fact' ELSE 'pref' END AS kind, 'Statement ' || (doc_id % 40) AS statement, 'o' || doc_id AS origin FROM documents
), p AS (SELECT *, 'notes/' || CASE kind WHEN 'loop' THEN '05_open_loops' WHEN 'fact' THEN '02_facts' ELSE '03_preferences' END || '/' || kind || '__statement_' || (doc_id % 40) AS base FROM k
), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY statement, origin) AS n FROM p)
SELECT base || CASE WHEN n > 1 OR base LIKE '%fact__statement_7' THEN '__' || substr(sha1(kind || '|' || statement || '|2026-01-01T00:00:00Z|' || origin), 1, 6) ELSE '' END || '.md' AS path,
  '---' || chr(10) || 'created: 2026-01-01T00:00:00Z' || chr(10) || 'updated: 2026-01-01T00:00:00Z' || chr(10) || 'tags: [imported]' || chr(10) || 'confidence: 0.91' || chr(10) || 'source: inferred' || chr(10) || 'scope: dev' || chr(10) || 'lang: en' || chr(10)
  || CASE WHEN kind = 'loop' THEN 'status: open' || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || '# ' || CASE WHEN kind = 'loop' THEN 'Loop: ' ELSE '' END || statement AS head FROM r"""


@query(_B13)
def b13_canonical_notes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = a.table(spark, d, "documents").select(
        F.when(i % 3 == 0, "loop").when(i % 3 == 1, "fact").otherwise("pref").alias("kind"), F.concat(F.lit("Statement "), i % 40).alias("statement"), F.lit(0.913).alias("confidence"), t.strings("imported").alias("tags"),
        F.lit("dev").alias("scope"), F.lit("en").alias("lang"), F.concat(F.lit("o"), i).alias("origin"),
    )
    taken = spark.createDataFrame([("notes/02_facts/fact__statement_7.md",)], "path string")
    made = c.canonical(rows, taken, F.lit("2026-01-01T00:00:00Z"))
    return made.select("path", F.regexp_extract("text", r"(?s)^(.*?\n# [^\n]*)", 1).alias("head"))


@query("SELECT doc_id, 'notes/02_facts/fact__n' || doc_id || '.md' AS path, 'promoted from inbox: n' || doc_id || '.md' AS \"desc\" FROM documents")
def b14_promote(spark: SparkSession, d: str) -> DataFrame:
    rows = a.table(spark, d, "documents").select(F.concat(F.lit("notes/00_inbox/n"), "doc_id", F.lit(".md")).alias("path"), "text", F.lit("fact").alias("kind"))
    notes, events = c.promoted(rows, F.lit("2026-01-01T00:00:00Z"))
    return notes.join(events, "path").select(F.regexp_extract("path", r"n(\d+)\.md$", 1).cast("long").alias("doc_id"), "path", "desc")


_PLAIN = "trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'))"


@query(f"""SELECT doc_id, '---' || chr(10) || 'scope: ' || CASE WHEN doc_id % 2 = 0 THEN 'home' ELSE 'work' END || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'status: "no"' || chr(10) END || '---' || chr(10) || {_PLAIN} || chr(10)
  || '## Next action' || chr(10) || '- [ ] old' || chr(10) || '- [ ] new ' || doc_id || chr(10) || chr(10) || '## More' || chr(10) || lang || chr(10) || '## Links' || chr(10) || '- x' || chr(10) AS text FROM documents""")
def b15_edits(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    plain = F.trim(F.regexp_replace("text", "[^a-zA-Z]+", " "))
    made = F.concat(F.lit("---\nscope: work\n---\n"), plain, F.lit("\n## Next action\n- [ ] old\n## Links\n- x\n"))
    rows = a.table(spark, d, "documents").select(i, "lang", made.alias("text"))
    rows = rows.withColumn("text", F.when(i % 2 == 0, c.set_front(F.col("text"), "scope", F.lit("home"))).otherwise(c.set_front(F.col("text"), "status", F.lit("no"))))
    rows = rows.withColumn("text", c.add_checkbox(F.col("text"), "Next action", F.concat(F.lit("new "), i)))
    return rows.select("doc_id", c.add_section(F.col("text"), "More", F.col("lang")).alias("text"))


@query("""SELECT doc_id, CASE WHEN length(trim(q)) = 0 THEN 'empty' WHEN length(trim(q)) > 2000 THEN 'too_long' END AS query, CASE WHEN doc_id % 5 = 0 THEN 'bad_scope' END AS scope, CASE WHEN doc_id % 7 IN (0, 6) THEN 'bad_limit' END AS "limit",
  CASE WHEN doc_id % 3 = 0 THEN 'escapes_root' END AS path, CASE WHEN doc_id % 4 = 0 THEN 'bad_type' END AS type FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE regexp_replace(text, '[^a-zA-Z]+', ' ', 'g') END AS q FROM documents)""")
def x19_validation(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    asked = F.when(i % 11 == 0, "  ").otherwise(F.regexp_replace("text", "[^a-zA-Z]+", " "))
    limits = F.when(i % 7 == 0, 0).when(i % 7 == 6, 1001).otherwise(i % 7)
    path = F.when(i % 3 == 0, "02_facts/../../secret").when(i % 3 == 1, "/v/notes/./a.md").otherwise("x/../a.md")
    return a.table(spark, d, "documents").select(
        "doc_id", v.query(asked).alias("query"), v.scope(F.when(i % 5 == 0, "moon").otherwise(" Dev")).alias("scope"), v.limit(limits).alias("limit"), v.inside(path, "/v/notes").alias("path"),
        v.note_type(F.when(i % 4 == 0, "memo").otherwise("all")).alias("type"),
    )


@query("""SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'invalid_format' WHEN 1 THEN 'wildcard_path' WHEN 2 THEN NULL ELSE CASE WHEN item_id % 5 = 3 THEN 'out_of_order' END END AS code FROM benchmark WHERE item_id % 5 IN (0, 1, 3) AND NOT (item_id = 3 AND FALSE)""")
def x18_timeline_lint(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    stamp = F.when(i % 5 == 3, "2024-01-01T00:00:00Z").otherwise(F.date_format(F.timestamp_seconds(F.lit(1706000000) + i * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    line = F.when(i % 5 == 0, F.concat(stamp, F.lit(" bad line"))).when(i % 5 == 4, "# a heading").otherwise(F.concat(stamp, F.lit(" | updated | notes/"), F.when(i % 5 == 1, "*").otherwise("a"), F.lit(".md | x")))
    return lint.timeline(a.table(spark, d, "benchmark").select(i.alias("lineno"), line.alias("value"), F.lit(0).alias("stream"))).select(F.col("lineno").alias("item_id"), "code")


@query(f"WITH {_SNAP}, lg AS (SELECT DISTINCT CAST(user_id * 3 AS VARCHAR) AS path FROM events), ch AS (SELECT * FROM df WHERE state <> 'unchanged'), u AS (SELECT count(*) AS k FROM ch WHERE path NOT IN (SELECT path FROM lg)) SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'modified') AS modified, count(*) FILTER (state = 'deleted') AS removed, (SELECT k FROM u) AS unlogged, false AS rewound, CASE WHEN (SELECT k FROM u) > 0 THEN 'unlogged' ELSE 'healthy' END AS verdict, CASE WHEN (SELECT k FROM u) > 0 THEN 1 ELSE 0 END AS exit_code FROM df")
def y4_sync_verdict(spark: SparkSession, d: str) -> DataFrame:
    events = a.table(spark, d, "events")
    return an.sync_verdict(*_snapshots(spark, d), events.select((F.col("user_id") * 3).cast("string").alias("path")), 5, 10)


@query(f"WITH {_SNAP} SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'deleted') AS removed, count(*) FILTER (state = 'modified') AS changed, false AS is_equal FROM df")
def j5_map_diff(spark: SparkSession, d: str) -> DataFrame:
    return an.map_diff(*_snapshots(spark, d))


@query("SELECT doc_id, doc_id % 3 = 0 AS tracked, doc_id % 4 = 1 AS skipped FROM documents")
def j6_path_predicates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.when(i % 3 == 0, "./notes/02_facts/a.md").when(i % 3 == 1, "notes/08_indices/a.md").otherwise("notes/a.txt")
    other = F.when(i % 4 == 1, "a/.OBSIDIAN/x.md").otherwise("a/obsidian.md")
    return a.table(spark, d, "documents").select("doc_id", b.tracked(path).alias("tracked"), b.skipped(other, (".obsidian", "templates")).alias("skipped"))


@query(f"""WITH {a.SQL_NOTES}, l AS (SELECT *, CAST(date_diff('day', CAST(updated_ts AS DATE), DATE '2024-02-15') AS INT) AS days FROM notes WHERE type = 'loop')
SELECT count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'open' AND days > 14) AS stale, count(*) FILTER (status = 'open' AND doc_id % 3 = 0) AS gaps FROM l""")
def f18_weekly_loops(spark: SparkSession, d: str) -> DataFrame:
    rows = a.notes(spark, d).where("type = 'loop'").withColumn("next_action", F.when(F.col("doc_id") % 3 == 0, "").otherwise("do"))
    return an.weekly_loops(rows, "2024-02-15")


@query(f"WITH {a.SQL_TIMELINE}, m AS (SELECT max(ts) AS last FROM timeline) SELECT lineno, ts, action, path FROM timeline, m WHERE CAST(ts[:19] AS TIMESTAMP) > CAST(last[:19] AS TIMESTAMP) - INTERVAL 24 HOUR ORDER BY ts DESC, lineno DESC LIMIT 10")
def i8_last_events(spark: SparkSession, d: str) -> DataFrame:
    rows = a.timeline(spark, d)
    last = rows.agg(F.max("ts")).first()[0]
    return an.last_events(rows, last, 24, 10).select("lineno", "ts", "action", "path")


@query(f"WITH {a.SQL_SIGNALS} SELECT count(*) AS total, count(DISTINCT note) FILTER (type = 'correction') AS corrections_pending FROM signals")
def f4_totals(spark: SparkSession, d: str) -> DataFrame:
    return an.signal_totals(a.signals(spark, d))


@query(f"WITH {a.SQL_NOTES} SELECT rel_path, round(confidence, 6) AS score FROM notes ORDER BY confidence DESC, updated DESC, rel_path DESC LIMIT 20")
def i7_context_items(spark: SparkSession, d: str) -> DataFrame:
    return an.context_items(a.notes(spark, d).withColumn("profile", F.col("confidence"))).select("rel_path", F.round("profile", 6).alias("score"))


@query("""WITH m AS (SELECT label % 2 AS arm, avg(vec_id) AS hit1, avg(label) AS mrr FROM embeddings GROUP BY 1) SELECT 'hit1' AS metric, round(b.hit1, 4) AS base, round(n.hit1, 4) AS new, round(n.hit1 - b.hit1, 4) AS delta FROM m b, m n WHERE b.arm = 0 AND n.arm = 1
UNION ALL SELECT 'mrr', round(b.mrr, 4), round(n.mrr, 4), round(n.mrr - b.mrr, 4) FROM m b, m n WHERE b.arm = 0 AND n.arm = 1""")
def f17_probe_deltas(spark: SparkSession, d: str) -> DataFrame:
    rows = a.table(spark, d, "embeddings")
    of = lambda arm: rows.where(F.col("label") % 2 == arm).agg(F.avg("vec_id").alias("hit1"), F.avg("label").alias("mrr"))
    return ev.deltas(of(0), of(1), ("hit1", "mrr"))


@query("SELECT count(*) AS items, 64 AS dims, count(*) FILTER (vec_id % 10 = 0) AS embedded, count(*) FILTER (vec_id % 10 <> 0) AS reused, 3 AS removed FROM embeddings")
def e5_vector_store(spark: SparkSession, d: str) -> DataFrame:
    rows, root = a.table(spark, d, "embeddings"), f"{stored.folder(spark)}/vectors-{uuid.uuid4().hex}"
    i = F.col("vec_id")
    items = rows.select(i.cast("string").alias("id"), F.sha1(i.cast("string")).alias("hash"), "embedding")
    gone = spark.createDataFrame([(f"gone{k}", "h", [0.0] * 64) for k in range(3)], "id string, hash string, embedding array<float>")
    vectors.store(items.where(i % 10 != 0).unionByName(gone), root, "local", "a/model")
    found = vectors.build(items.withColumnRenamed("embedding", "text"), root, lambda v: v, "local", "a/model")
    state = vectors.status(spark, root, "local", "a/model")
    vectors.clean(spark, root, "local", "a/model")
    return spark.createDataFrame([(state["items"], state["dims"], found["embedded"], found["reused"], found["removed"])], "items long, dims int, embedded long, reused long, removed int")


@query(f"WITH {a.SQL_NOTES}, s AS (SELECT rel_path, len(regexp_extract_all(text, '\\S+')) AS words FROM notes) SELECT 'sizes' AS name, count(*) AS n FROM s UNION ALL SELECT 'tags', count(*) FROM (SELECT DISTINCT rel_path, unnest(tags) FROM notes) UNION ALL SELECT 'recent', least(30, count(*)) FROM notes UNION ALL SELECT 'catalogue', count(*) FROM notes UNION ALL SELECT 'metrics', count(DISTINCT scope) FROM notes UNION ALL SELECT 'links', count(*) FROM notes UNION ALL SELECT 'index', count(*) FROM notes")
def b10_derived_indexes(spark: SparkSession, d: str) -> DataFrame:
    root, notes = f"{stored.folder(spark)}/derived-{uuid.uuid4().hex}", a.notes(spark, d).withColumn("body", F.concat("body", F.lit(" [[n"), F.col("doc_id") + 1, F.lit("]]")))
    sinks.derived(notes, root)
    counts = [(name, spark.read.json(f"{root}/{name}").count()) for name in sinks.DERIVED]
    return spark.createDataFrame(counts, "name string, n long")


@query(f"WITH {a.SQL_NOTES} SELECT scope, count(*) AS n FROM notes WHERE type IN ('fact', 'pref') GROUP BY scope")
def b11_profiles_by_scope(spark: SparkSession, d: str) -> DataFrame:
    path = f"{stored.folder(spark)}/profiles-{uuid.uuid4().hex}"
    sinks.by_scope(a.notes(spark, d).where("type IN ('fact', 'pref')"), path)
    return spark.read.parquet(path).groupBy("scope").agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_replace(CASE doc_id % 2 WHEN 0 THEN 'org/Model v1.5' ELSE 'plain-model_2' END, '[^A-Za-z0-9._-]+', '_', 'g') || '/' || lang AS key FROM documents")
def y12_model_key(spark: SparkSession, d: str) -> DataFrame:
    model = F.when(F.col("doc_id") % 2 == 0, "org/Model v1.5").otherwise("plain-model_2")
    return a.table(spark, d, "documents").select("doc_id", F.concat(vectors.key(model), F.lit("/"), "lang").alias("key"))


@query("SELECT doc_id, 'notes/02_facts/' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 = 0 THEN '2024-05-06T07:08:09Z' ELSE '2026-01-01T00:00:00Z' END AS ts FROM documents")
def y14_vault_events(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = a.table(spark, d, "documents").select(F.concat(F.lit("/home/v/vault/notes/02_facts/"), i, F.lit(".md")).alias("path"), F.lit("created").alias("action"), F.lit("x").alias("desc"), F.when(i % 3 == 0, "2024-05-06T07:08:09Z").alias("ts"), i.alias("doc_id"))
    return an.vault_events(rows, F.lit("2026-01-01T00:00:00Z")).select("doc_id", "path", "ts")


@query(f"WITH {a.SQL_NOTES} SELECT rel_path, CASE WHEN type = 'loop' THEN CASE WHEN status = '' THEN '?' ELSE status END || ' | T' || doc_id || ' - next: none (updated ' || substr(updated, 1, 10) ELSE 'T' || doc_id || ' - S' || doc_id || ' (updated ' || substr(updated, 1, 10) END || CASE WHEN confidence < 0.7 THEN ' conf ' || printf('%.2g', confidence) ELSE '' END || ')' AS line FROM notes")
def y1_compact_lines(spark: SparkSession, d: str) -> DataFrame:
    made = {"title": F.concat(F.lit("T"), "doc_id"), "question": F.concat(F.lit("T"), "doc_id"), "statement": F.concat(F.lit("S"), "doc_id"), "next_action": F.lit("")}
    return a.notes(spark, d).withColumns(made).select("rel_path", render.compact(200).alias("line"))


@query("""WITH s AS (SELECT 'a/' || doc_id || '.md' AS path, doc_id % 17 AS y, doc_id % 5 AS g FROM documents WHERE doc_id % 4 <> 0) SELECT path, CAST(row_number() OVER (PARTITION BY y ORDER BY g DESC, path) AS INT) AS pos FROM s""")
def a9_vault_order(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = a.table(spark, d, "documents").select(F.concat(F.when(i % 4 == 0, "a/Templates/").otherwise("a/"), i, F.lit(".md")).alias("path"), (i % 17).alias("yield"), (i % 5).alias("signal"))
    return x.vault(rows, ("templates",)).select("path", F.col("pos").cast("int").alias("pos"))


@query(f"WITH {a.SQL_TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY lineno) AS k FROM timeline) SELECT stream, k AS lineno, action FROM r")
def a13_numbered_timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = a.timeline(spark, d)
    texts = rows.groupBy("stream").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lineno", F.concat_ws(" | ", "ts", "action", "path", "desc").alias("line")))), lambda r: r["line"]), "\n").alias("text"))
    return an.numbered(texts, "stream").select("stream", F.col("lineno").cast("long").alias("lineno"), "action")


@query(f"WITH {a.SQL_NOTES} SELECT count(*) AS notes, count(*) FILTER (type = 'loop' AND status = 'open') AS open_loops, max(updated) AS latest, (SELECT count(*) FROM events) AS signals FROM notes")
def k6_boot_payload(spark: SparkSession, d: str) -> DataFrame:
    return an.boot_payload(a.notes(spark, d), a.signals(spark, d)).select("notes", "open_loops", "latest", "signals")


@query("SELECT status, count(*) AS n FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 2 THEN 'blocked' WHEN 3 THEN 'snoozed' ELSE 'open' END AS status FROM documents) GROUP BY status")
def y18_enum_fallback(spark: SparkSession, d: str) -> DataFrame:
    given = F.element_at(t.strings("open", "Closed", "BLOCKED", "snoozed", "whatever"), (F.col("doc_id") % 5 + 1).cast("int"))
    return a.table(spark, d, "documents").select(F.when(F.lower(given).isin(*STATUSES), F.lower(given)).otherwise("open").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {a.SQL_NOTES} SELECT type, count(*) AS entries, CAST(sum(len(note_tokens) + len(tag_tokens)) AS BIGINT) AS postings FROM notes GROUP BY type")
def b8_stored_index(spark: SparkSession, d: str) -> DataFrame:
    root = f"{stored.folder(spark)}/notes-{uuid.uuid4().hex}"
    stored.store(r.index_of(a.notes(spark, d)), root)
    index = stored.load(spark, root)
    entries = index.entries.groupBy("type").agg(F.count("*").alias("entries"))
    return entries.join(index.postings.groupBy("type").agg(F.count("*").alias("postings")), "type")


@query(f"WITH {a.SQL_NOTES} SELECT type, count(*) AS n FROM notes WHERE type <> 'id' GROUP BY type")
def a10_embedding_corpus(spark: SparkSession, d: str) -> DataFrame:
    return vectors.corpus(a.notes(spark, d), "notes").groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, '---' || chr(10) || 'created: ' || CASE WHEN doc_id % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE '2026-01-01T00:00:00Z' END || chr(10) || 'updated: 2026-01-01T00:00:00Z' || chr(10) || 'tags: [voice]' || chr(10) || 'source: user' || chr(10)
  || 'scope: meta' || chr(10) || 'lang: en' || chr(10) || '---' || chr(10) || chr(10) || '# Voice' || chr(10) || chr(10) || '## Statement' || chr(10) || '```json' || chr(10) || '{"tone":"' || lang || '"}' || chr(10) || '```' || chr(10) AS text FROM documents""")
def b22_voice_note(spark: SparkSession, d: str) -> DataFrame:
    docs, i = a.table(spark, d, "documents"), F.col("doc_id")
    path = F.concat(F.lit("notes/03_preferences/voice"), i, F.lit(".md"))
    held = docs.where(i % 2 == 0).select(path.alias("path"), F.lit("---\ncreated: 2024-01-01T00:00:00Z\n---\nold").alias("text"))
    made = c.voice_note(docs.select(path.alias("path"), F.to_json(F.struct(F.col("lang").alias("tone"))).alias("profile")), held, F.lit("2026-01-01T00:00:00Z"))
    return made.select(F.regexp_extract("path", r"voice(\d+)\.md$", 1).cast("long").alias("doc_id"), "text")


@query("""SELECT conv_id, count(*) AS n, min(turn) AS first FROM conversations WHERE turn % 3 <> 1 GROUP BY conv_id""")
def b20_session_notes(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    message = F.concat(F.when(turn % 3 == 0, "fix ").when(turn % 3 == 1, "zzz ").otherwise("new pattern "), turn)
    rows = a.table(spark, d, "conversations").select(F.col("conv_id").alias("session"), turn.alias("pos"), message.alias("message"), x.commit_kind(message).alias("kind"))
    made = c.session_note(rows, F.lit("2026-01-01T00:00:00Z"))
    line = F.regexp_extract_all("text", F.lit(r"(?m)^- \w+: [a-z ]+(\d+)$"), 1)
    return made.select(F.regexp_extract("path", r"session_(-?\d+)\.md$", 1).cast("long").alias("conv_id"), F.size(line).cast("long").alias("n"), F.element_at(line, 1).cast("long").alias("first"))


@query(f"WITH {a.SQL_NOTES} SELECT CAST(doc_id AS VARCHAR) AS stem, rel_path FROM notes WHERE doc_id % 50 = 0")
def y15_by_stem(spark: SparkSession, d: str) -> DataFrame:
    notes = a.notes(spark, d)
    return b.by_stem(notes, notes.where("doc_id % 50 = 0").select(F.col("doc_id").cast("string").alias("stem")))


@query(f"WITH {a.SQL_NOTES} SELECT 'inferred' AS name, count(*) AS n FROM notes WHERE source = 'inferred' UNION ALL SELECT 'low_confidence', count(*) FROM notes WHERE confidence < 0.7 UNION ALL SELECT 'open_loops', count(*) FROM notes WHERE type = 'loop' AND status IN ('open', 'blocked')")
def b19_saved_views(spark: SparkSession, d: str) -> DataFrame:
    prefix = f"v{uuid.uuid4().hex}_"
    names = [v for v in b.saved_views(a.notes(spark, d), prefix) if not v.endswith("_recent")]
    return spark.sql(" UNION ALL ".join(f"SELECT '{v.removeprefix(prefix)}' AS name, count(*) AS n FROM {v}" for v in names))


@query("SELECT '| hit1 | ' || printf('%.4f', a) || ' | ' || printf('%.4f', b) || ' | ' || printf('%+.4f', b - a) || ' |' AS line FROM (SELECT avg(quality) AS a, avg(quality) FILTER (doc_id % 2 = 0) AS b FROM labels)")
def b18_report_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = a.table(spark, d, "labels").agg(F.avg("quality").alias("base"), F.avg(F.when(F.col("doc_id") % 2 == 0, F.col("quality"))).alias("new"))
    return render.report(rows.withColumn("metric", F.lit("hit1")))


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'other/' ELSE 'notes/' END || user_id AS path FROM events WHERE user_id % 5 = 0")
def s5_event_append(spark: SparkSession, d: str) -> DataFrame:
    root = f"{stored.folder(spark)}/events-{uuid.uuid4().hex}"
    rows = a.timeline(spark, d).withColumn("path", F.when(F.substring_index("path", "/", -1).cast("int") % 5 == 0, F.regexp_replace("path", "notes/", "other/")).otherwise(F.col("path")))
    bad = sinks.append_events(rows.withColumn("action", F.when(F.col("action") == "sleep", "updated").otherwise(F.col("action"))).select("ts", "action", "path", "desc", "lineno"), f"{root}/jsonl", f"{root}/markdown")
    return bad.select(F.col("lineno").alias("event_id"), "path")
