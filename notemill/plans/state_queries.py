"""Queries of committed state, configuration texts and A/B runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, compose, mapping
from ..operators import semantic as sem
from ..sources import adapter as a
from ..sources import files as readers
from ..sources import index as stored
from ..sources import sinks, state, vectors
from ..streaming import imports
from . import ab, sync
from .analytics_queries import _SNAP, _SUMMARY, _snapshots
from .registry import query
from .retrieval_queries import _EXPECTED, _INDEX, expected_paths, sql_bm25, sql_pool, sql_rank


def own_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run, dropped when the session ends."""
    root = f"{stored.folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = sinks.file_system(spark, root)
    fs.deleteOnExit(path)
    return root


@query(f"""{_SUMMARY.replace("WITH ", f"WITH {a.SQL_NOTES}, {a.SQL_TIMELINE}, ", 1)}
SELECT 'signal_notes' AS part, note AS key, CAST(CAST(round(signal_score * 10000) AS BIGINT) AS VARCHAR) AS value FROM summary
UNION ALL SELECT 'sync_files', rel_path, sha256(text) FROM notes
UNION ALL SELECT 'nudges', rel_path, CASE WHEN doc_id % 3 = 0 THEN '2024-02-10T00:00:00Z' ELSE '2024-02-01T00:00:00Z' END FROM notes WHERE type = 'loop' AND status = 'open'
UNION ALL SELECT 'manifest', rel_path, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END FROM notes
UNION ALL SELECT 'facts', 'timeline_event_count', CAST(count(*) AS VARCHAR) FROM timeline
UNION ALL SELECT 'facts', 'last_timeline_timestamp', arg_max(ts, lineno) FROM timeline
UNION ALL SELECT 'facts', 'total_signals', CAST(count(*) AS VARCHAR) FROM signals
UNION ALL SELECT 'facts', 'tracked_file_count', CAST(count(*) AS VARCHAR) FROM notes""")
def b17_state_commits(spark: SparkSession, d: str) -> DataFrame:
    """Sync state, signal summary, nudge log and manifest saved in one commit, a later one on top of it, and all of it read back."""
    root, notes, now = own_folder(spark, "state"), a.notes(spark, d), "2024-02-15T00:00:00Z"
    files = notes.select(F.col("rel_path").alias("path"), F.sha2("text", 256).alias("hash"), "doc_id", (F.col("type") == "loop").alias("loop"), "status")
    loops = files.where("loop AND status = 'open'")
    base = state.current(spark, root)
    first = {"nudges": state.nudge(state.load(spark, root, "nudges"), loops, "2024-02-01T00:00:00Z"), "manifest": files.select("path", "hash", F.lit("first").alias("updated"))}
    state.commit(base, *state.merged(state.sync(files, a.timeline(spark, d), now), state.signal_summary(a.signals(spark, d), now), (first, {})))

    def later(at: state.Snapshot) -> tuple[dict[str, DataFrame], dict[str, object]]:
        third = files.where("doc_id % 3 = 0")
        seen = third.select("path", "hash", F.lit("second").alias("updated"))
        return {"nudges": state.nudge(at.table("nudges"), third.where("loop AND status = 'open'"), "2024-02-10T00:00:00Z"), "manifest": analytics.upsert(at.table("manifest"), seen, "path")}, {}

    held = state.update(spark, root, later)
    part = lambda name, key, value: held.table(name).select(F.lit(name).alias("part"), F.col(key).alias("key"), value.cast("string").alias("value"))
    rows = part("signal_notes", "note", F.round(F.col("signal_score") * 10000).cast("long")).unionByName(part("sync_files", "path", F.col("hash")))
    rows = rows.unionByName(part("nudges", "path", F.col("nudged"))).unionByName(part("manifest", "path", F.col("updated")))
    facts = [("facts", k, str(held.facts[k])) for k in ("timeline_event_count", "last_timeline_timestamp", "total_signals", "tracked_file_count")]
    return rows.unionByName(spark.createDataFrame(facts, "part string, key string, value string"))


@query("""SELECT item_id AS id, text AS query, CASE WHEN item_id % 3 = 0 THEN 'dev' ELSE 'all' END AS scope, CASE WHEN item_id % 4 = 0 THEN '' ELSE 'notes/' || item_id || '.md|a ' || text END AS expected FROM benchmark""")
def a18_eval_cases(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items written as files of cases, one for each of 16 groups, and read back whole."""
    b, i = a.table(spark, d, "benchmark"), F.col("item_id")
    hits = F.when(i % 4 == 0, F.lit("  expected_any: []\n")).otherwise(F.concat(F.lit("  expected_any:\n    - notes/"), i, F.lit(".md\n    - "), compose.scalar(F.concat(F.lit("a "), F.col("text"))), F.lit("  # as said\n")))
    scope = F.when(i % 3 == 0, "  scope: dev\n").otherwise("")
    case = F.concat(F.lit("- id: "), i, F.lit("\n  query: "), compose.scalar(F.col("text")), F.lit("\n"), scope, hits)
    files = b.groupBy((i % 16).alias("path")).agg(F.concat(F.lit("# cases\ncases:\n"), F.array_join(F.array_sort(F.collect_list(case)), "\n")).alias("text"))
    rows = mapping.eval_cases(files, escapes=True)
    return rows.select(F.col("query_id").cast("long").alias("id"), "query", F.col("query_scope").alias("scope"), F.array_join("expected", "|").alias("expected"))


@query("""WITH k AS (SELECT doc_id, unnest(['source', 'n_chars', 'ratio', 'quoted', 'lists.0', 'lists.1', 'deep.lang', 'deep.more.0.n', 'deep.more.1.n', 'flag']) AS key, source, n_chars, lang, text FROM documents)
SELECT doc_id, key, CASE key WHEN 'source' THEN source WHEN 'n_chars' THEN CAST(n_chars AS VARCHAR) WHEN 'ratio' THEN CAST(doc_id % 10 AS VARCHAR) || '.5' WHEN 'quoted' THEN text WHEN 'lists.0' THEN lang WHEN 'lists.1' THEN source
  WHEN 'deep.lang' THEN lang WHEN 'deep.more.0.n' THEN '1' WHEN 'deep.more.1.n' THEN CAST(doc_id AS VARCHAR) ELSE 'true' END AS value,
  CASE key WHEN 'n_chars' THEN 'int' WHEN 'ratio' THEN 'float' WHEN 'deep.more.0.n' THEN 'int' WHEN 'deep.more.1.n' THEN 'int' WHEN 'flag' THEN 'bool' ELSE 'str' END AS kind FROM k""")
def c2_any_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Front matter with keys of any name, lists and nested keys; the whole text is one of its values.

    A null is written as `null`, which is read as a scalar of that kind, and is null here, with the kind that its column has; so is an empty string, which stays one.
    """
    docs, i = a.table(spark, d, "documents"), F.col("doc_id")
    shown = lambda c: F.coalesce(c, F.lit("null"))
    text = lambda c: shown(compose.scalar(F.col(c)))
    front = F.concat(
        F.lit("---\nsource: "), text("source"), F.lit("\n# a comment\nn_chars: "), shown(F.col("n_chars").cast("string")), F.lit("\nratio: "), shown(F.concat((i % 10).cast("string"), F.lit(".5"))), F.lit("\nquoted: "), text("text"),
        F.lit("\nlists: ["), text("lang"), F.lit(", "), text("source"), F.lit("]\ndeep:\n  lang: "), text("lang"), F.lit("\n  more:\n  - n: 1\n  - n: "), shown(i.cast("string")),
        F.lit("\n\nflag: true\n---\nbody\n"),
    )
    rows = mapping.any_front_matter(docs.select(i.cast("string").alias("path"), front.alias("text")), escapes=True)
    none = F.col("kind") == "null"
    kind = F.when(none & F.col("key").isin("n_chars", "deep.more.1.n"), "int").when(none & (F.col("key") == "ratio"), "float").when(none, "str").otherwise(F.col("kind"))
    return rows.where("kind <> 'empty'").select(F.col("path").cast("long").alias("doc_id"), "key", F.when(~none | (F.col("value") == ""), F.col("value")).alias("value"), kind.alias("kind"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 50 ELSE CAST(page_id % 7 AS INT) END AS max_files_per_cycle, CASE WHEN page_id % 5 = 0 THEN CAST(0.7 AS DOUBLE) ELSE page_id % 3 * CAST(0.6 AS DOUBLE) END AS queue_confidence_min,
  CASE WHEN page_id % 5 = 0 THEN '.git|.obsidian|.smart-env|.smartchats|.trash|attachments|notemill' ELSE array_to_string(list_sort(list_distinct([url, 'templates'])), '|') END AS exclude_dirs,
  CASE WHEN page_id % 5 = 0 THEN 0 ELSE (page_id % 3 = 2)::INT + (page_id % 7 = 0)::INT + (page_id % 3 = 2)::INT END AS problems FROM pages WHERE url IS NOT NULL AND url = trim(url) AND url <> ''""")
def a24_vault_config(spark: SparkSession, d: str) -> DataFrame:
    """A configuration for each page, one in five broken; excluded folders hold the page's address."""
    i = F.col("page_id")
    pages = a.table(spark, d, "pages").where("url IS NOT NULL AND url = trim(url) AND url <> ''")
    good = F.to_json(F.struct((i % 7).alias("max_files_per_cycle"), ((i % 3) * F.lit(0.6)).alias("queue_confidence_min"), F.array(F.lit(" templates "), "url", "url").alias("exclude_dirs")))
    rows = mapping.vault_config(pages.select(i.cast("string").alias("path"), F.when(i % 5 == 0, F.concat(F.lit("{broken "), "url")).otherwise(good).alias("text")))
    return rows.select(F.col("path").cast("long").alias("page_id"), "max_files_per_cycle", "queue_confidence_min", F.array_join("exclude_dirs", "|").alias("exclude_dirs"), F.size("problems").alias("problems"))


def _arm_sql(name: str, pool: str) -> str:
    at = "coalesce(min(rank), 1000)"
    return f"""({pool} , {_EXPECTED}
  SELECT '{name}' AS arm, query_id, any_value(queries.query_scope) AS query_scope, min(rank) AS rank, ({at} <= 1)::INT AS hit1, ({at} <= 3)::INT AS hitk, coalesce(1 / min(rank), 0) AS rr
  FROM expected JOIN queries USING (query_id) LEFT JOIN best USING (query_id, rel_path) GROUP BY query_id)"""


_RUNS = f"""WITH runs AS (SELECT * FROM {_arm_sql("base", sql_pool(_INDEX) + sql_bm25() + sql_rank())}
  UNION ALL SELECT * FROM {_arm_sql("new", sql_pool() + sql_bm25() + sql_rank())})"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    asked, index = a.queries(spark, d), a.index(spark, d)
    arms = [ab.Arm("base", "precomputed_index"), ab.Arm("new", "two_stage")]
    return ab.outcomes(asked, expected_paths(spark, d, index), index, arms, a.now(), depth=8)


@query(_RUNS + """ SELECT arm, CASE WHEN GROUPING(query_scope) = 0 THEN 'scope' ELSE 'all' END AS part, coalesce(query_scope, '') AS value, count(*) AS cases, round(avg(hit1), 6) AS hit1, round(avg(hitk), 6) AS hitk, round(avg(rr), 6) AS mrr
FROM runs GROUP BY GROUPING SETS ((arm), (arm, query_scope))""")
def y6_ab_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = ab.quality(_outcomes(spark, d)).where("part <> 'intent'")
    return rows.select("arm", "part", "value", "cases", *[F.round(c, 6).alias(c) for c in ab.METRICS])


@query(_RUNS + """, pairs AS (SELECT query_id, max(rank) FILTER (arm = 'base') AS base_rank, max(rank) FILTER (arm = 'new') AS new_rank FROM runs GROUP BY query_id)
SELECT query_id, CAST(base_rank AS INT) AS base_rank, CAST(new_rank AS INT) AS new_rank, CASE WHEN base_rank IS NULL AND new_rank IS NULL THEN 'missed' WHEN coalesce(1 / new_rank, 0) > coalesce(1 / base_rank, 0) THEN 'better'
  WHEN coalesce(1 / new_rank, 0) < coalesce(1 / base_rank, 0) THEN 'worse' ELSE 'same' END AS outcome FROM pairs""")
def y7_ab_paired(spark: SparkSession, d: str) -> DataFrame:
    return ab.paired(_outcomes(spark, d), "base", "new").select("query_id", "base_rank", "new_rank", "outcome")


_SINCE = f"""WITH {_SNAP}, lg AS (SELECT DISTINCT CAST(user_id * 3 AS VARCHAR) AS path FROM events WHERE event_id > 300), ch AS (SELECT * FROM df WHERE state <> 'unchanged'
), dr AS (SELECT coalesce(ch.path, lg.path) AS path, state, CASE WHEN state IS NULL THEN 'timeline_only' WHEN lg.path IS NULL THEN 'unlogged' ELSE 'logged' END AS kind FROM ch FULL JOIN lg ON ch.path = lg.path)"""


def _synced(spark: SparkSession, d: str) -> tuple[str, DataFrame, DataFrame]:
    """(state folder, files now, timeline now) after a sync of the older snapshot with the first lines of the log."""
    old, new = _snapshots(spark, d)
    events = a.timeline(spark, d).withColumn("path", (F.substring_index("path", "/", -1).cast("long") * 3).cast("string"))
    root = own_folder(spark, "sync")
    sync.apply(spark, root, old, lambda: events.where("lineno <= 300"), "2024-02-01T00:00:00Z")
    return root, new, events


@query(_SINCE + " SELECT * FROM dr")
def y4_sync_drift(spark: SparkSession, d: str) -> DataFrame:
    root, new, events = _synced(spark, d)
    return sync.drift(state.current(spark, root), new, events)


@query(_SINCE + """ SELECT 'before' AS step, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'modified') AS modified, count(*) FILTER (state = 'deleted') AS removed, count(*) FILTER (kind = 'unlogged') AS unlogged,
  count(*) FILTER (kind = 'timeline_only') AS timeline_only, CASE WHEN count(*) FILTER (kind = 'unlogged') > 0 THEN 'unlogged' ELSE 'healthy' END AS verdict, 1 AS version FROM dr
UNION ALL SELECT 'after', 0, 0, 0, 0, 0, 'healthy', 2 UNION ALL SELECT 'again', 0, 0, 0, 0, 0, 'healthy', 2""")
def y4_sync_apply(spark: SparkSession, d: str) -> DataFrame:
    """Check, apply, check, apply again, check: the second apply writes nothing."""
    root, new, events = _synced(spark, d)
    shown = lambda step, at: sync.check(at, new, events).select(F.lit(step).alias("step"), "added", "modified", "removed", "unlogged", "timeline_only", "verdict", F.lit(at.version).alias("version"))
    out = shown("before", state.current(spark, root))
    for step in ("after", "again"):
        out = out.unionByName(shown(step, sync.apply(spark, root, new, lambda: events, "2024-02-02T00:00:00Z")))
    return out


@query("""WITH o AS (SELECT user_id AS stream, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 37 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), s AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM o
), g AS (SELECT stream, k, min(ts) AS began, max(ts) AS ended, count(*) AS events, min(event_id) AS first_line, max(event_id) AS last_line, count(*) FILTER (event_type = 'signup') AS sleeps FROM s GROUP BY stream, k)
SELECT stream, strftime(began, '%Y-%m-%d %H:%M:%S') AS began, strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended, events, first_line, last_line, sleeps, greatest(first_line, CASE WHEN stream % 3 = 0 THEN 0 ELSE 501 END) AS from_line FROM g
WHERE last_line > CASE WHEN stream % 3 = 0 THEN -1 ELSE 500 END""")
def s7_session_capture(spark: SparkSession, d: str) -> DataFrame:
    events = a.table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("ts").alias("at"), F.col("event_id").alias("lineno"), F.when(F.col("event_type") == "signup", "sleep").otherwise("updated").alias("action"))
    baseline = events.where("stream % 3 <> 0").select("stream").distinct().withColumn("baseline", F.lit(500).cast("long"))
    rows = imports.captured(imports.sessions(events, "37 minutes"), baseline)
    told = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("stream", told("began"), told("ended"), "events", "first_line", "last_line", "sleeps", "from_line")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS tone, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS n, CASE WHEN doc_id % 7 <> 0 THEN source END AS second, CASE WHEN doc_id % 7 <> 0 THEN text END AS said FROM documents""")
def a22_voice_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Nested profiles in fenced blocks of notes; the text itself is one of the values, and every seventh block is broken."""
    docs, i = a.table(spark, d, "documents"), F.col("doc_id")
    made = F.to_json(F.struct(F.col("lang").alias("tone"), F.struct(F.struct(F.col("n_chars").alias("n"), F.col("text").alias("said")).alias("more"), F.array("lang", "source").alias("list")).alias("deep")))
    text = F.concat(F.lit("# Voice\n\n```json\n"), F.when(i % 7 == 0, F.lit("{broken")).otherwise(F.replace(made, F.lit("`"), F.lit("\\u0060"))), F.lit("\n```\n"))
    rows = readers.voice_profile(docs.select(i.alias("path"), text.alias("text")))
    get = lambda path, kind: F.try_variant_get("profile", path, kind)
    return rows.select(F.col("path").alias("doc_id"), get("$.tone", "string").alias("tone"), get("$.deep.more.n", "long").alias("n"), get("$.deep.list[1]", "string").alias("second"), get("$.deep.more.said", "string").alias("said"))


def _item_files(spark: SparkSession, d: str) -> DataFrame:
    """Notes with front matter, their bodies whole documents."""
    docs, i = a.table(spark, d, "documents"), F.col("doc_id")
    front = F.concat(F.lit("---\ntags: [zz, "), "source", F.lit("]\nscope: dev\nlang: "), "lang", F.lit("\nconfidence: 0."), (i % 9 + 1).cast("string"), F.lit("\nupdated: 2026-01-01T00:00:00Z\n---\n"))
    path = F.concat(F.lit("/v/notes/02_facts/fact_"), i, F.lit(".md"))
    return docs.select("doc_id", path.alias("path"), F.concat(front, F.lit("# T"), i, F.lit("\n"), "text").alias("text"), F.timestamp_seconds(F.lit(0)).alias("mtime"))


_BODY = "trim('# T' || doc_id || chr(10) || text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"""SELECT 'notes:notes/02_facts/fact_' || doc_id || '.md' AS id, sha1('{{"body": ' || CAST(to_json({_BODY}) AS VARCHAR) || ', "confidence": "0.' || (doc_id % 9 + 1) || '", "lang": "' || lang || '", "scope": "dev", "status": "", "tags": "'
  || array_to_string(list_sort(['zz', source]), ',') || '", "title": "T' || doc_id || '", "updated": "2026-01-01T00:00:00Z"}}') AS hash, 'T' || doc_id || chr(10) || {_BODY} AS text FROM documents""")
def e1_items(spark: SparkSession, d: str) -> DataFrame:
    return sem.items(_item_files(spark, d)).select("id", "hash", "text")


def word_lengths():
    """A small encoder: how many words of each length modulo 8 a text has."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for x in texts:
            row = [0.0] * 8
            for w in x.split(" "):
                row[len(w) % 8] += 1
            out.append(row)
        return out

    return encode


_LENGTHS = ", ".join(f"count(*) FILTER (length(w) % 8 = {k})" for k in range(8))


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END, ' ')) AS w FROM documents WHERE doc_id % 10 <> 1)
SELECT CAST(doc_id AS VARCHAR) AS id, array_to_string([{_LENGTHS}], ',') AS vector FROM w GROUP BY doc_id""")
def e2_encoded_items(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents are built, then brought up to a fifth that changed and a tenth that is gone, and read back."""
    docs, i, root = a.table(spark, d, "documents"), F.col("doc_id"), own_folder(spark, "encoded")
    rows = lambda df, text: df.select(i.cast("string").alias("id"), F.sha1(text).alias("hash"), text.alias("text"))
    encoder = sem.Encoder("word-lengths", word_lengths)
    vectors.build(rows(docs, F.col("text")), root, encoder, "local", "word/lengths")
    now = docs.where(i % 10 != 1)
    vectors.build(rows(now, F.when(i % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))), root, encoder, "local", "word/lengths")
    return vectors.load(spark, root, "local", "word/lengths").select("id", F.array_join(F.transform("embedding", lambda v: v.cast("long").cast("string")), ",").alias("vector"))


@query(f"""WITH {a.SQL_NOTES} SELECT 'sizes' AS name, rel_path AS key, CAST(len(regexp_extract_all(text, '\\S+')) AS VARCHAR) AS value FROM notes UNION ALL SELECT DISTINCT 'tags', unnest(tags), rel_path FROM notes
UNION ALL SELECT 'links', rel_path, 'n' || (doc_id + 1) FROM notes UNION ALL SELECT 'index', type || ' ' || rel_path, title || ' ' || updated FROM notes""")
def b10_derived_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the derived tables say, read back from their files."""
    root, notes = own_folder(spark, "derived"), a.notes(spark, d)
    sinks.derived(notes.withColumn("body", F.concat("statement", F.lit(" [[n"), F.col("doc_id") + 1, F.lit("]]"))), root)
    read = lambda name, key, value: spark.read.json(f"{root}/{name}").select(F.lit(name).alias("name"), key.alias("key"), value.cast("string").alias("value"))
    rows = read("sizes", F.col("rel_path"), F.col("words")).unionByName(read("tags", F.col("tag"), F.col("rel_path"))).unionByName(read("links", F.col("src"), F.col("target")))
    return rows.unionByName(read("index", F.concat_ws(" ", "type", "rel_path"), F.concat_ws(" ", "title", "updated")))


_FOLDERS = ("01_identity", "02_facts", "03_preferences", "04_goals", "05_open_loops", "06_concepts", "08_indices", "elsewhere")
_EVENT_KINDS = ("identity", "fact", "preference", "goal", "loop", "concept", "index", "other")


@query(f"""WITH {a.SQL_TIMELINE} SELECT lineno, ts, action, 'notes/' || ['{"', '".join(_FOLDERS)}'][CAST(lineno % 8 + 1 AS INT)] || '/' || stream AS path, "desc", ['{"', '".join(_EVENT_KINDS)}'][CAST(lineno % 8 + 1 AS INT)] AS type FROM timeline WHERE lineno % 9 <> 0""")
def b5_timeline_migration(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown timeline, with broken lines in it, made a JSON one; a second migration does nothing."""
    root, n = own_folder(spark, "timeline"), F.col("lineno")
    folder = F.element_at(F.array(*[F.lit(x) for x in _FOLDERS]), (n % 8 + 1).cast("int"))
    line = F.concat_ws(" | ", "ts", F.when(n % 9 == 0, "unheard").otherwise(F.col("action")), F.concat_ws("/", F.lit("notes"), folder, "stream"), "desc")
    lines = a.timeline(spark, d).select("lineno", line.alias("value"))
    sinks.ensure_jsonl(lines, f"{root}/jsonl")
    sinks.ensure_jsonl(lines, f"{root}/jsonl")
    return spark.read.schema("ts string, action string, path string, desc string, type string, lineno long").json(f"{root}/jsonl")


@query(f"""WITH {a.SQL_SIGNALS}, s AS (SELECT count(*) AS n, count(*) FILTER (type = 'correction') AS c FROM signals), m AS (SELECT query, count(*) AS misses FROM signals WHERE type = 'stale_flag' AND query <> '' GROUP BY query ORDER BY misses DESC, query LIMIT 1)
SELECT 3 AS section, CAST(1 AS BIGINT) AS pos, '- Signals: ' || n AS line FROM s WHERE n > 0 UNION ALL SELECT 3, 2, '- Corrections to look at: ' || c FROM s WHERE c > 0
UNION ALL SELECT 3, 3, '- Asked for most without a result: "' || query || '" (' || misses || ')' FROM m""")
def k6_boot_lines(spark: SparkSession, d: str) -> DataFrame:
    """What a session's text says of signals; context notes and streams are held against their own operators in the tests."""
    signals = a.signals(spark, d).withColumn("type", F.when(F.col("type") == "stale_flag", "retrieval_miss").otherwise(F.col("type")))
    return analytics.boot_lines(a.notes(spark, d), a.timeline(spark, d), signals, a.now(), "2024-02-15").where("section = 3")
