"""Note, query, signal, timeline and link tables made from the generic test tables, the same in Spark and in DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import rank as r
from ..operators.rank import with_intents
from ..schema import STOPWORDS
from . import index as stored

NOW = "2024-02-15 00:00:00"
TYPES, SCOPE_CYCLE, SOURCE_CYCLE = ("id", "fact", "pref", "goal", "loop", "concept"), ("home", "work", "dev", "personal", "meta"), ("user", "tool", "assistant", "inferred")
QUERY_SCOPES, QUERY_WORDS = ("all", "home", "work", "dev", "personal", "meta"), ("", " loop", " history", " preference")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _cycle(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(t.strings(*values), (by % len(values) + 1).cast("int"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, i = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("doc_id")
    rows = docs.join(labels, "doc_id", "left").withColumn("updated_ts", F.timestamp_seconds(F.lit(1704067200) + i * 3600))
    return rows.select(
        "doc_id", F.concat(F.lit("notes/"), i).alias("rel_path"), _cycle(TYPES, i).alias("type"), _cycle(SCOPE_CYCLE, i).alias("scope"),
        F.when(i % 6 != 4, "").when(i % 4 == 0, "closed").otherwise("open").alias("status"),
        F.coalesce(0.5 + 0.4 * F.col("quality") - 0.3 * F.col("toxic"), F.lit(0.6)).alias("confidence"), "updated_ts",
        F.date_format("updated_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"), _cycle(SOURCE_CYCLE, i).alias("source"),
        F.array("lang", docs["source"]).alias("tags"), F.substring("text", 1, 40).alias("title"), F.substring("text", 41, 120).alias("statement"), "text", F.col("text").alias("body"),
        t.tokens(F.concat_ws(" ", "text", "lang", docs["source"])).alias("note_tokens"), t.tokens(F.concat_ws(" ", "lang", docs["source"])).alias("tag_tokens"),
    )


_INDEXES: dict[tuple, r.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> r.Index:
    """The stored index of the notes, built once for each session and state of the tables."""
    stamp = lambda name: tuple(sorted((x.path, x.stamp, x.size) for x in table(spark, sf_dir, name).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("stamp"), F.col("_metadata.file_size").alias("size")).distinct().collect()))
    key = (spark.sparkContext.applicationId, sf_dir, stamp("documents"), stamp("labels"))
    if key not in _INDEXES:
        root = f"{stored.folder(spark)}/notes-{uuid.uuid4().hex}"
        stored.store(r.index_of(notes(spark, sf_dir)), root)
        _INDEXES[key] = stored.load(spark, root)
    return _INDEXES[key]


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    asked = F.concat(F.substring("text", 1, 60), _cycle(QUERY_WORDS, i))
    rows = b.select(i.alias("query_id"), asked.alias("query"), t.tokens(asked).alias("query_tokens"), _cycle(QUERY_SCOPES, i).alias("query_scope"))
    return with_intents(rows)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for x in ("click", "retrieval_hit", "view", "preference_applied", "error", "correction", "purchase", "affirmation", "signup", "stale_flag")])
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), kind[F.col("event_type")].alias("type"), F.concat(F.lit("notes/"), F.col("user_id")).alias("note"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("q"), k)).alias("query"), F.when(F.col("event_type") == "purchase", k % 10 + 1).cast("int").alias("rating"), "event_id",
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    action = F.create_map(*[F.lit(x) for x in ("click", "created", "view", "updated", "error", "archived", "purchase", "closed", "signup", "sleep")])
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), action[F.col("event_type")].alias("action"), F.concat(F.lit("notes/"), F.col("user_id")).alias("path"),
        (F.col("user_id") % 20).alias("stream"), F.col("event_id").alias("lineno"), F.col("event_type").alias("desc"),
    )


# DuckDB -------------------------------------------------------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_tokens(x: str) -> str:
    return f"list_sort(list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda w: NOT list_contains({_list(STOPWORDS)}, w)))"


SQL_NOTES = f"""notes AS (
  SELECT d.doc_id, 'notes/' || d.doc_id AS rel_path, {_list(TYPES)}[CAST(d.doc_id % 6 + 1 AS INT)] AS type, {_list(SCOPE_CYCLE)}[CAST(d.doc_id % 5 + 1 AS INT)] AS scope,
    CASE WHEN d.doc_id % 6 <> 4 THEN '' WHEN d.doc_id % 4 = 0 THEN 'closed' ELSE 'open' END AS status,
    coalesce(CAST(0.5 AS DOUBLE) + CAST(0.4 AS DOUBLE) * quality - CAST(0.3 AS DOUBLE) * toxic, 0.6) AS confidence,
    TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id AS INT)) AS updated_ts, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id AS INT)), '%Y-%m-%dT%H:%M:%SZ') AS updated,
    {_list(SOURCE_CYCLE)}[CAST(d.doc_id % 4 + 1 AS INT)] AS source, [d.lang, d.source] AS tags, substr(text, 1, 40) AS title, substr(text, 41, 120) AS statement, text, text AS body,
    {sql_tokens("text || ' ' || d.lang || ' ' || d.source")} AS note_tokens, {sql_tokens("d.lang || ' ' || d.source")} AS tag_tokens
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""
_ASKED = f"substr(text, 1, 60) || {_list(QUERY_WORDS)}[CAST(item_id % 4 + 1 AS INT)]"


def _hints(values) -> str:
    return f"list_has_any(query_tokens, {_list(values)})"


def _sql_queries() -> str:
    from ..schema import HISTORY_HINTS, LOOP_HINTS, PREFERENCE_HINTS

    return f"""asked AS (
  SELECT item_id AS query_id, {_ASKED} AS query, {sql_tokens(_ASKED)} AS query_tokens, {_list(QUERY_SCOPES)}[CAST(item_id % 6 + 1 AS INT)] AS query_scope FROM benchmark
), queries AS (SELECT *, {_hints(HISTORY_HINTS)} AS history, {_hints(LOOP_HINTS)} AS loop, {_hints(PREFERENCE_HINTS)} AS pref FROM asked)"""


SQL_QUERIES = _sql_queries()
SQL_SIGNALS = """signals AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, MAP {'click': 'retrieval_hit', 'view': 'preference_applied', 'error': 'correction', 'purchase': 'affirmation', 'signup': 'stale_flag'}[event_type] AS type,
    'notes/' || user_id AS note, CASE WHEN event_type = 'signup' THEN 'q' || CAST(props->>'$.k' AS INT) END AS query,
    CASE WHEN event_type = 'purchase' THEN CAST(props->>'$.k' AS INT) % 10 + 1 END AS rating, event_id FROM events
)"""
SQL_TIMELINE = """timeline AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, MAP {'click': 'created', 'view': 'updated', 'error': 'archived', 'purchase': 'closed', 'signup': 'sleep'}[event_type] AS action,
    'notes/' || user_id AS path, user_id % 20 AS stream, event_id AS lineno, event_type AS "desc" FROM events
)"""
