"""Queries of signals, timeline, corpus, links, snapshots, context and import over the adapter's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import analytics as an
from ..operators import browse as b
from ..operators import evaluate as ev
from ..operators import extract as x
from ..operators import notes as n
from ..operators import semantic as s
from ..schema import STOPWORDS
from ..sources import adapter as a
from .registry import query
from .retrieval_queries import _RECENCY, _num

_SUMMARY = f"""WITH {a.SQL_SIGNALS}, agg AS (
  SELECT note, count(*) FILTER (type = 'retrieval_hit') AS hits, count(*) FILTER (type = 'correction') AS corrections, count(*) FILTER (type = 'affirmation') AS affirmations,
    count(*) FILTER (type = 'stale_flag') AS stale_flags, count(*) FILTER (type = 'preference_applied') AS preferences, max(ts) FILTER (type = 'retrieval_hit') AS last_hit,
    count(rating) AS rating_count, CAST(sum(rating) AS BIGINT) AS rating_sum, min(rating) AS rating_min, max(rating) AS rating_max FROM signals GROUP BY note
), sc AS (SELECT *, (affirmations - corrections - stale_flags) / CAST(affirmations + corrections + stale_flags + 1 AS DOUBLE) AS s FROM agg)
, summary AS (SELECT * EXCLUDE (s), round_even(CASE WHEN s >= 0 THEN s * least(hits / CAST(10 AS DOUBLE), 1) ELSE s END, 4) AS signal_score FROM sc)"""


@query(_SUMMARY + " SELECT * FROM summary")
def f1_signal_summary(spark: SparkSession, d: str) -> DataFrame:
    return an.signal_summary(a.signals(spark, d))


@query(f"WITH {a.SQL_SIGNALS} SELECT query, count(*) AS misses FROM signals WHERE type = 'stale_flag' AND query <> '' GROUP BY query ORDER BY misses DESC, query LIMIT 20")
def f3_retrieval_misses(spark: SparkSession, d: str) -> DataFrame:
    rows = a.signals(spark, d)
    return an.retrieval_misses(rows.withColumn("type", F.when(F.col("type") == "stale_flag", "retrieval_miss").otherwise(F.col("type"))))


@query(f"WITH {a.SQL_SIGNALS} SELECT coalesce(CASE WHEN event_id % 50 = 0 THEN NULL ELSE type END, 'unknown') AS type, count(*) AS n FROM signals GROUP BY 1")
def f4_signal_types(spark: SparkSession, d: str) -> DataFrame:
    return an.signal_types(a.signals(spark, d).withColumn("type", F.when(F.col("event_id") % 50 != 0, F.col("type"))))


@query(_SUMMARY + " SELECT note, hits FROM summary ORDER BY hits DESC, note LIMIT 10")
def f4_top_notes(spark: SparkSession, d: str) -> DataFrame:
    return an.top_notes(an.signal_summary(a.signals(spark, d)))


@query(_SUMMARY.replace("WITH ", f"WITH {a.SQL_NOTES}, ", 1) + " SELECT rel_path, CASE WHEN (SELECT count(*) FROM signals) >= 20 THEN coalesce(signal_score, 0) ELSE 0 END AS signal_score FROM notes LEFT JOIN summary ON note = rel_path")
def f5_gated_scores(spark: SparkSession, d: str) -> DataFrame:
    return an.gated_scores(a.signals(spark, d), a.notes(spark, d))


@query(f"WITH {a.SQL_NOTES} SELECT rel_path, len(regexp_extract_all(text, '\\S+')) AS words FROM notes")
def f6_sizes(spark: SparkSession, d: str) -> DataFrame:
    return an.sizes(a.notes(spark, d)).withColumn("words", F.col("words").cast("long"))


@query(f"WITH {a.SQL_NOTES}, e AS (SELECT rel_path, unnest(tags) AS tag FROM notes) SELECT tag, count(DISTINCT rel_path) AS n, min(rel_path) AS first FROM e GROUP BY tag")
def f7_tag_index(spark: SparkSession, d: str) -> DataFrame:
    return an.tag_index(a.notes(spark, d), 100).groupBy("tag").agg(F.sum(F.size("paths")).alias("n"), F.min(F.element_at("paths", 1)).alias("first"))


_PAIRS = f"{a.SQL_NOTES}, e AS (SELECT DISTINCT rel_path, unnest(tags) AS tag FROM notes), tp AS (SELECT x.tag, y.tag AS other, count(*) AS n FROM e x JOIN e y USING (rel_path) WHERE x.tag <> y.tag GROUP BY ALL)"


@query(f"WITH {_PAIRS} SELECT * FROM tp")
def f8_tag_pairs(spark: SparkSession, d: str) -> DataFrame:
    return an.tag_pairs(a.notes(spark, d))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_PHRASES = f"""w AS (SELECT list_filter(regexp_extract_all(lower(title || ' ' || text), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP})) AS w FROM notes
), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i : i + 1], ' '))) AS phrase FROM w
  UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) FROM w
), ph AS (SELECT phrase, count(*) AS n FROM g GROUP BY phrase)"""


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    return an.phrases(a.notes(spark, d).select(F.concat_ws(" ", "title", "text").alias("source")), "source")


@query(f"WITH {a.SQL_NOTES}, {_PHRASES} SELECT * FROM ph WHERE n >= 2")
def f9_phrases(spark: SparkSession, d: str) -> DataFrame:
    return _phrases(spark, d).where("n >= 2")


@query(f"""WITH {_PAIRS}, {_PHRASES}, s AS (SELECT tag AS alias, lower(trim(regexp_replace(other, '[_-]', ' ', 'g'))) AS phrase FROM tp WHERE n >= 2
  UNION SELECT split_part(phrase, ' ', 1), phrase FROM ph WHERE n >= 2), k AS (SELECT * FROM s WHERE length(alias) >= 2 AND NOT (alias = 'en' AND phrase = 'src1') QUALIFY row_number() OVER (PARTITION BY alias ORDER BY phrase) <= 8)
SELECT alias, list(phrase ORDER BY phrase) AS phrases FROM k GROUP BY alias""")
def f10_alias_suggestions(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("en", "src1")], "alias string, phrase string")
    return an.alias_suggestions(a.notes(spark, d), _phrases(spark, d), known)


@query(f"WITH {a.SQL_NOTES} SELECT rel_path, type, confidence, updated, CAST(row_number() OVER (PARTITION BY type ORDER BY updated DESC, rel_path DESC) AS INT) AS pos FROM notes")
def f11_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return an.catalogue(a.notes(spark, d)).select("rel_path", "type", "confidence", "updated", F.col("pos").cast("int").alias("pos"))


@query(f"WITH {a.SQL_NOTES}, w AS (SELECT scope, len(regexp_extract_all(text, '\\S+')) AS words FROM notes) SELECT scope, count(*) AS n, CAST(sum(words) AS BIGINT) AS total, round(avg(words), 6) AS mean, quantile_disc(words, 0.95) AS p95 FROM w GROUP BY scope")
def f12_context_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = a.notes(spark, d).select("scope", t.word_count(F.col("text")).cast("long").alias("words"))
    return an.metrics(rows, "scope", "words").withColumn("mean", F.round("mean", 6))


@query("""WITH t AS (SELECT event_type AS arm, value AS ms FROM events)
SELECT arm, round(min(ms), 6) AS least, round(max(ms), 6) AS most, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS median, round(quantile_disc(ms, 0.95), 6) AS p95 FROM t GROUP BY arm""")
def f13_latency(spark: SparkSession, d: str) -> DataFrame:
    rows = a.table(spark, d, "events").select(F.col("event_type").alias("arm"), F.col("value").alias("ms"))
    return ev.latency(rows).select("arm", *[F.round(c, 6).alias(c) for c in ("least", "most", "mean", "median", "p95")])


@query("""WITH c AS (SELECT item_id, CAST(0.5 AS DOUBLE) AS b, CAST(0.5 AS DOUBLE) + (item_id % 3 - 1) / CAST(10 AS DOUBLE) AS m, CAST(5 AS DOUBLE) AS bp, CAST(5 + item_id % 5 AS DOUBLE) AS np FROM benchmark)
SELECT item_id, CASE WHEN m - b < -1e-9 THEN 'regression' WHEN m - b > 1e-9 THEN 'beneficial' WHEN np > bp * 1.05 + 2.0 THEN 'regression' ELSE 'neutral' END AS decision FROM c""")
def f16_decision(spark: SparkSession, d: str) -> DataFrame:
    i, half = F.col("item_id"), F.lit(0.5)
    rows = a.table(spark, d, "benchmark").select(
        i, *[half.alias(f"base_{m}") for m in ("hit1", "hitk", "mrr")], half.alias("new_hit1"), half.alias("new_hitk"), (half + (i % 3 - 1) / 10).alias("new_mrr"),
        *[F.lit(5.0).alias(f"base_{m}") for m in ("eval_p95", "query_p95")], F.lit(5.0).alias("new_query_p95"), (5 + i % 5).cast("double").alias("new_eval_p95"),
    )
    return rows.select("item_id", ev.decide().alias("decision"))


@query(f"WITH {a.SQL_TIMELINE} SELECT action, count(*) AS n FROM timeline WHERE ts >= '2024-01-20T00:00:00Z' GROUP BY action")
def f18_weekly_counts(spark: SparkSession, d: str) -> DataFrame:
    return an.action_counts(a.timeline(spark, d), "2024-01-20T00:00:00Z")


@query(f"""WITH {a.SQL_NOTES} SELECT rel_path, days, CASE WHEN days > 21 THEN 'stale >21d' WHEN days > 14 THEN 'stale >14d' WHEN days > 7 THEN '>7d' ELSE '' END AS band
FROM (SELECT rel_path, CAST(date_diff('day', CAST(updated_ts AS DATE), DATE '2024-02-15') AS INT) AS days FROM notes WHERE type = 'loop' AND status IN ('open', 'blocked'))""")
def f19_staleness(spark: SparkSession, d: str) -> DataFrame:
    return an.staleness(a.notes(spark, d).where("type = 'loop'"), "2024-02-15").select("rel_path", "days", "band")


@query(f"""WITH {a.SQL_NOTES}, l AS (SELECT rel_path, CAST(date_diff('day', CAST(updated_ts AS DATE), DATE '2024-02-15') AS INT) AS days, CASE WHEN doc_id % 3 = 0 THEN DATE '2024-02-14' WHEN doc_id % 3 = 1 THEN DATE '2024-02-12' END AS nudged
  FROM notes WHERE type = 'loop' AND status IN ('open', 'blocked'))
SELECT rel_path, days FROM l WHERE days > 7 AND (nudged IS NULL OR date_diff('day', nudged, DATE '2024-02-15') >= 3) ORDER BY days DESC, rel_path LIMIT 5""")
def g17_nudges(spark: SparkSession, d: str) -> DataFrame:
    rows = a.notes(spark, d)
    log = rows.select("rel_path", F.when(F.col("doc_id") % 3 == 0, "2024-02-14").when(F.col("doc_id") % 3 == 1, "2024-02-12").alias("last_nudge"))
    return an.nudges(an.staleness(rows.where("type = 'loop'"), "2024-02-15"), log, "2024-02-15").select("rel_path", "days")


@query(f"WITH {a.SQL_NOTES}, s(scope) AS (VALUES ('home'), ('work'), ('dev'), ('personal'), ('meta')) SELECT s.scope, count(rel_path) AS n FROM s LEFT JOIN notes ON notes.scope = s.scope AND type = 'loop' AND notes.scope <> 'meta' GROUP BY s.scope")
def f20_scope_histogram(spark: SparkSession, d: str) -> DataFrame:
    return b.scope_histogram(a.notes(spark, d).where("type = 'loop' AND scope <> 'meta'"), a.SCOPE_CYCLE)


@query("SELECT source, sha256(string_agg(doc_id || chr(9) || sha256(text) || chr(10), '' ORDER BY doc_id || chr(9) || sha256(text) || chr(10))) AS fingerprint FROM documents GROUP BY source")
def f22_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = a.table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    return an.digest(rows, "source")


@query(f"WITH {a.SQL_NOTES} SELECT type, scope, count(*) AS n FROM notes GROUP BY ALL")
def f23_groupings(spark: SparkSession, d: str) -> DataFrame:
    return a.notes(spark, d).groupBy("type", "scope").agg(F.count("*").alias("n"))


@query(f"WITH {a.SQL_TIMELINE} SELECT lineno, ts, before FROM (SELECT xor(lineno, 1023) AS lineno, ts, lag(ts) OVER (PARTITION BY path ORDER BY xor(lineno, 1023)) AS before FROM timeline) WHERE ts < before")
def h3_timeline_order(spark: SparkSession, d: str) -> DataFrame:
    mixed = a.timeline(spark, d).withColumn("lineno", F.col("lineno").bitwiseXOR(F.lit(1023)))
    return an.order_violations(mixed).select("lineno", "ts", "before")


@query(f"""WITH {a.SQL_TIMELINE}, l AS (SELECT stream, max(lineno) FILTER (action = 'sleep') AS pos, max(ts) FILTER (action = 'sleep') AS slept FROM timeline GROUP BY stream)
SELECT stream, slept, count(*) FILTER (lineno > coalesce(pos, -1) AND action <> 'sleep') AS changes, CAST(date_diff('day', CAST(slept[:10] AS DATE), DATE '2024-02-02') AS INT) AS days,
  coalesce(days >= 7, true) OR changes >= 25 AS due FROM timeline JOIN l USING (stream) GROUP BY stream, slept""")
def h4_since_sleep(spark: SparkSession, d: str) -> DataFrame:
    return an.since_sleep(a.timeline(spark, d), "2024-02-02")


@query(f"WITH {a.SQL_TIMELINE} SELECT lineno, path FROM timeline WHERE ts >= '2024-01-25T00:00:00Z' AND path = 'notes/7'")
def j9_timeline_since(spark: SparkSession, d: str) -> DataFrame:
    return an.since(a.timeline(spark, d), "2024-01-25T00:00:00Z").where("path = 'notes/7'").select("lineno", "path")


_SNAP = """old AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0),
df AS (SELECT path, CASE WHEN old.hash IS NULL THEN 'added' WHEN new.hash IS NULL THEN 'deleted' WHEN old.hash = new.hash THEN 'unchanged' ELSE 'modified' END AS state FROM old FULL JOIN new USING (path))"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, i = a.table(spark, d, "documents"), F.col("doc_id")
    old = docs.where(i % 10 != 0).select(i.cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    new = docs.where(i % 11 != 0).select(i.cast("string").alias("path"), F.sha2(F.when(i % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return old, new


@query(f"WITH {_SNAP} SELECT * FROM df")
def j4_manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return an.diff(*_snapshots(spark, d))


@query(f"""WITH {_SNAP}, lg AS (SELECT DISTINCT CAST(user_id * 3 AS VARCHAR) AS path FROM events), ch AS (SELECT * FROM df WHERE state <> 'unchanged')
SELECT path, CASE WHEN path IN (SELECT path FROM lg) THEN 'logged' ELSE 'unlogged' END AS kind FROM ch UNION ALL SELECT path, 'timeline_only' FROM lg WHERE path NOT IN (SELECT path FROM ch)""")
def j3_drift(spark: SparkSession, d: str) -> DataFrame:
    logged = a.table(spark, d, "events").select((F.col("user_id") * 3).cast("string").alias("path"))
    return an.drift(*_snapshots(spark, d), logged)


@query("""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 5 AS m, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0),
f AS (SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 5 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS m, sha256(CASE WHEN doc_id % 8 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0)
SELECT path, CASE WHEN f.m IS NULL THEN 'removed' WHEN p.m IS NULL THEN 'parsed' WHEN f.m = p.m THEN 'reused' WHEN f.hash = p.hash THEN 'touched' ELSE 'parsed' END AS state FROM p FULL JOIN f USING (path)""")
def d4_index_refresh(spark: SparkSession, d: str) -> DataFrame:
    docs, i = a.table(spark, d, "documents"), F.col("doc_id")
    old = docs.where(i % 10 != 0).select(i.cast("string").alias("path"), (i % 5).alias("mtime"), F.sha2("text", 256).alias("hash"))
    new = docs.where(i % 11 != 0).select(i.cast("string").alias("path"), (i % 5 + F.when(i % 4 == 0, 1).otherwise(0)).alias("mtime"), F.sha2(F.when(i % 8 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return n.refresh(old, new).select("path", "state")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def b16_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = a.table(spark, d, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return an.upsert(old, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.lit(-1.0).alias("v")), "k")


_EDGES = """e AS (SELECT CAST(page_id AS VARCHAR) AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("dst"))


@query(f"""WITH {_EDGES}, nd AS (SELECT DISTINCT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, coalesce(o, 0) AS outgoing, coalesce(i, 0) AS incoming, coalesce(o, 0) + coalesce(i, 0) = 0 AS orphan FROM nd
LEFT JOIN (SELECT src AS node, count(*) AS o FROM e GROUP BY 1) USING (node) LEFT JOIN (SELECT dst AS node, count(*) AS i FROM e GROUP BY 1) USING (node)""")
def j7_link_degrees(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return an.degrees(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), e)


@query(f"""WITH {_EDGES}, m AS (SELECT DISTINCT src, 'x' || dst || '.md' AS dst FROM e), p AS (SELECT DISTINCT 'notes/x' || dst || '.md' AS path FROM e WHERE length(dst) % 2 = 0)
SELECT src, dst FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.path = dst OR ends_with(p.path, '/' || dst))""")
def g11_broken_links(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    links = e.select("src", F.concat(F.lit("x"), "dst", F.lit(".md")).alias("dst")).distinct()
    paths = e.where(F.length("dst") % 2 == 0).select(F.concat(F.lit("notes/x"), "dst", F.lit(".md")).alias("path")).distinct()
    return an.broken(links, paths)


_PROFILE = f"({_num(0.55)} * {_RECENCY} + {_num(0.25)} * confidence + {_num(0.2)} * CASE WHEN source IN ('user', 'tool') THEN 1.0 WHEN source = 'assistant' THEN 0.7 WHEN source = 'inferred' THEN 0.6 ELSE 0.5 END)"


@query(f"WITH {a.SQL_NOTES} SELECT rel_path, round({_PROFILE}, 6) AS score FROM notes")
def k2_profile_score(spark: SparkSession, d: str) -> DataFrame:
    return a.notes(spark, d).select("rel_path", F.round(an.profile_score(a.now()), 6).alias("score"))


@query(f"""WITH {a.SQL_NOTES}, p AS (SELECT rel_path, scope, type, row_number() OVER (PARTITION BY scope, type ORDER BY {_PROFILE} DESC, updated DESC, rel_path DESC) AS pos FROM notes WHERE type <> 'concept')
SELECT rel_path, scope, type, CAST(pos AS INT) AS pos FROM p WHERE pos <= CASE type WHEN 'fact' THEN 6 WHEN 'pref' THEN 8 WHEN 'goal' THEN 8 WHEN 'loop' THEN 10 ELSE 1000000 END""")
def k5_profiles(spark: SparkSession, d: str) -> DataFrame:
    return an.profiles(a.notes(spark, d), a.now()).select("rel_path", "scope", "type", F.col("pos").cast("int").alias("pos"))


@query(f"""WITH {a.SQL_NOTES}, p AS (SELECT rel_path, scope, type, row_number() OVER (PARTITION BY scope, type ORDER BY {_PROFILE} DESC, updated DESC, rel_path DESC) AS pos FROM notes
  WHERE type <> 'concept' AND CASE WHEN type = 'loop' THEN status IN ('open', 'blocked', 'snoozed') ELSE confidence >= 0.8 END)
SELECT rel_path FROM p WHERE pos <= CASE type WHEN 'fact' THEN 6 WHEN 'pref' THEN 8 WHEN 'goal' THEN 8 WHEN 'loop' THEN 12 ELSE 1000000 END""")
def k3_boot_context(spark: SparkSession, d: str) -> DataFrame:
    return an.boot(a.notes(spark, d), a.now()).select("rel_path")


_TRIAGE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{m}')" for m in marks) + f" THEN '{kind}'" for kind, marks in x.TRIAGE) + " ELSE 'facts' END"
_MADE = "text || CASE conv_id % 6 WHEN 0 THEN ' I always prefer tea' WHEN 1 THEN ' it was Decided' WHEN 2 THEN ' the Target is near' WHEN 3 THEN ' TODO: revisit' WHEN 4 THEN ' a Framework' ELSE '' END"


def _talk(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("conv_id") % 6
    more = F.when(i == 0, " I always prefer tea").when(i == 1, " it was Decided").when(i == 2, " the Target is near").when(i == 3, " TODO: revisit").when(i == 4, " a Framework").otherwise("")
    return a.table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", more).alias("text"))


@query(f"SELECT conv_id, turn, {_TRIAGE_SQL} AS suggested FROM (SELECT conv_id, turn, {_MADE} AS text FROM conversations)")
def x14_triage(spark: SparkSession, d: str) -> DataFrame:
    return _talk(spark, d).select("conv_id", "turn", x.triage(F.col("text")).alias("suggested"))


_COMMIT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i)(?:{p})') THEN '{k}'" for k, p in x.COMMITS) + " END"


@query(f"SELECT conv_id, turn, {_COMMIT_SQL} AS kind FROM (SELECT conv_id, turn, {_MADE} AS text FROM conversations)")
def x15_commit_kind(spark: SparkSession, d: str) -> DataFrame:
    return _talk(spark, d).select("conv_id", "turn", x.commit_kind(F.col("text")).alias("kind"))


@query(r"""SELECT doc_id, CASE WHEN no AND en THEN 'mixed' WHEN no THEN 'no' WHEN en THEN 'en' ELSE 'mixed' END AS lang FROM (
  SELECT doc_id, len(list_intersect(w, ['og','ikke','jeg','du','vi','skal','med','uten','hvor','hva','hvis'])) > 0 AS no, len(list_intersect(w, ['and','not','i','you','we','should','with','without','what','if'])) > 0 AS en
  FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+') AS w FROM documents))""")
def x8_language(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "documents").select("doc_id", x.language(F.col("text")).alias("lang"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'home' WHEN doc_id % 4 = 1 THEN 'dev' ELSE 'personal' END AS scope, CASE WHEN doc_id % 4 = 0 THEN 'home' WHEN doc_id % 4 = 1 THEN 'dev' WHEN doc_id % 4 = 2 THEN 'journal' ELSE 'other' END AS bucket FROM documents""")
def x9_path_rules(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.when(i % 4 == 0, "01-home/a/x.md").when(i % 4 == 1, "04-dev/b.md").when(i % 4 == 2, "90-journal/2024/c.md").otherwise("misc/d.md")
    return a.table(spark, d, "documents").select("doc_id", x.scope_of_path(path).alias("scope"), x.bucket(path).alias("bucket"))


@query(r"SELECT doc_id, sha1('fact|' || lang || '|' || lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')))) AS key FROM documents")
def x10_import_key(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "documents").select("doc_id", x.import_key(F.lit("fact"), F.col("lang"), F.col("text")).alias("key"))


@query("""SELECT doc_id, CASE WHEN c >= 0.9 THEN 'write' WHEN c >= 0.7 THEN 'queue' ELSE 'skip' END AS route, round(least(1, c + least((doc_id % 13) / CAST(30 AS DOUBLE), 0.2)), 6) AS score
FROM (SELECT doc_id, (doc_id % 11) / CAST(10 AS DOUBLE) AS c FROM documents)""")
def x11_routing(spark: SparkSession, d: str) -> DataFrame:
    rows = a.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 11 / 10).alias("confidence"), (F.col("doc_id") % 13).alias("signal"))
    return rows.select("doc_id", x.route().alias("route"), F.round(x.candidate_score(), 6).alias("score"))


@query("""WITH s AS (SELECT CASE doc_id % 3 WHEN 0 THEN '90-journal/archive/' WHEN 1 THEN '90-journal/' ELSE '04-dev/' END || doc_id AS path, doc_id % 17 AS y, doc_id % 7 AS m, doc_id % 5 AS g, CASE doc_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 20 ELSE 1000000 END AS cap, doc_id % 3 AS b FROM documents WHERE doc_id % 10 <> 3)
SELECT path FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY y DESC, m DESC, g DESC, path) AS pos FROM s) WHERE pos <= cap ORDER BY y DESC, m DESC, g DESC, path LIMIT 50""")
def h1_select_files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    folder = F.when(i % 3 == 0, "90-journal/archive/").when(i % 3 == 1, "90-journal/").otherwise("04-dev/")
    scan = a.table(spark, d, "documents").select("doc_id", F.concat(folder, i).alias("path"), F.lit("h").alias("hash"), i.alias("size"), (i % 17).alias("yield"), (i % 7).alias("mtime"), (i % 5).alias("signal"))
    return x.select_files(scan, scan.where(i % 10 == 3).select("path", "hash", "size")).select("path")


_RECORD = ("rel_path", "type", "title", "body", "updated", "scope", "status", "source")


@query(f"WITH {a.SQL_NOTES} SELECT rel_path, sha1(concat_ws(chr(31), {', '.join(_RECORD)})) AS hash FROM notes")
def e1_item_hash(spark: SparkSession, d: str) -> DataFrame:
    return a.notes(spark, d).select("rel_path", s.item_hash(*_RECORD).alias("hash"))


@query(f"WITH {a.SQL_TIMELINE} SELECT lineno, ts, action, path, \"desc\" FROM timeline WHERE lineno % 10 <> 3")
def a12_timeline_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = a.timeline(spark, d)
    line = F.when(F.col("lineno") % 10 == 3, F.concat(F.lit("- "), "ts")).otherwise(F.concat_ws(" | ", "ts", "action", "path", "desc"))
    return an.parse_timeline(rows.select("lineno", line.alias("value"))).select("lineno", "ts", "action", "path", "desc")


@query(f"WITH {a.SQL_TIMELINE} SELECT ts || ' | ' || action || ' | ' || path || ' | ' || \"desc\" AS value FROM timeline ")
def b5_render_timeline(spark: SparkSession, d: str) -> DataFrame:
    return an.render_timeline(a.timeline(spark, d))


@query("""WITH q AS (SELECT avg(quality) AS hit1, avg(toxic) AS hitk, avg(quality + toxic) / 2 AS mrr FROM labels), p AS (SELECT avg(quality) AS hit1, avg(toxic) AS hitk, avg(quality + toxic) / 2 AS mrr FROM labels WHERE doc_id % 2 = 0)
SELECT round(p.hit1 - q.hit1, 6) AS delta_hit1, round(p.hitk - q.hitk, 6) AS delta_hitk, round(p.mrr - q.mrr, 6) AS delta_mrr, delta_hitk < 0 OR delta_mrr < 0 AS regressed FROM p, q""")
def f15_baseline_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = a.table(spark, d, "labels")
    of = lambda x: x.agg(F.avg("quality").alias("hit1"), F.avg("toxic").alias("hitk"), (F.avg(F.col("quality") + F.col("toxic")) / 2).alias("mrr"))
    return ev.compare(of(rows), of(rows.where("doc_id % 2 = 0")))


_QUEUE = "queue AS (SELECT doc_id, sha1(text) AS key, CASE doc_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'pending' ELSE 'promoted' END AS review_status FROM documents), known AS (SELECT key FROM queue WHERE doc_id % 3 = 0)"


def _queue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    status = F.when(i % 4 == 0, "approved").when(i % 4 == 1, "rejected").when(i % 4 == 2, "pending").otherwise("promoted")
    queue = a.table(spark, d, "documents").select("doc_id", F.sha1("text").alias("key"), status.alias("review_status"))
    return queue, queue.where("doc_id % 3 = 0").select("key").distinct()


@query(f"WITH {_QUEUE} SELECT review_status, count(*) AS n FROM queue GROUP BY 1")
def f24_queue_status(spark: SparkSession, d: str) -> DataFrame:
    return x.queue_counts(_queue(spark, d)[0])


@query(f"WITH {_QUEUE} SELECT doc_id, CASE WHEN review_status = 'approved' AND key NOT IN (SELECT key FROM known) THEN 'promoted' ELSE review_status END AS review_status FROM queue")
def x13_queue_promotion(spark: SparkSession, d: str) -> DataFrame:
    return x.promote(*_queue(spark, d))[0].select("doc_id", "review_status")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1")
def h2_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = a.table(spark, d, "documents").select("doc_id", F.sha1(F.lower("text")).alias("key"))
    return x.first_of_key(rows, "doc_id").select("doc_id")


@query(f"WITH {a.SQL_TIMELINE} SELECT stream, count(*) FILTER (stream % 4 = 0 OR lineno > 5000) AS n FROM timeline GROUP BY stream HAVING n > 0")
def h5_after_baseline(spark: SparkSession, d: str) -> DataFrame:
    then = a.timeline(spark, d).select("stream").distinct().withColumn("baseline", F.when(F.col("stream") % 4 == 0, 10**9).otherwise(5000).cast("long"))
    return an.after_baseline(a.timeline(spark, d), then).groupBy("stream").agg(F.count("*").alias("n"))


@query(f"WITH {a.SQL_NOTES} SELECT rel_path, updated FROM notes ORDER BY updated DESC, rel_path DESC LIMIT 30")
def i3_recent(spark: SparkSession, d: str) -> DataFrame:
    return b.recent(a.notes(spark, d)).select("rel_path", "updated")


@query(f"WITH {a.SQL_NOTES} SELECT rel_path, len(regexp_extract_all(text, '\\S+')) AS words FROM notes ORDER BY words DESC, rel_path DESC LIMIT 10")
def i4_largest(spark: SparkSession, d: str) -> DataFrame:
    return b.largest(an.sizes(a.notes(spark, d)).withColumn("words", F.col("words").cast("long")))


@query(f"WITH {_EDGES}, m AS (SELECT src, CASE WHEN src < '3' THEN '5' ELSE dst END AS dst FROM e) SELECT src, dst, src = '5' AS outgoing FROM m WHERE src = '5' OR dst = '5'")
def j8_links_of_one(spark: SparkSession, d: str) -> DataFrame:
    return b.panel(_edges(spark, d).withColumn("dst", F.when(F.col("src") < "3", "5").otherwise(F.col("dst"))), "5")


@query("""SELECT doc_id, regexp_matches(s, '(?i)(#openloop|#loop|@loop|@openloop)') OR regexp_matches(s, '(?i)\\b(20\\d{2}-\\d{2}-\\d{2}|q[1-4]|uke\\s?\\d{1,2}|week\\s?\\d{1,2})\\b') AS kept
FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' by week 12' WHEN 1 THEN ' #loop' ELSE ' later' END AS s FROM documents)""")
def x6_archive_loops(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    stmt = F.concat("text", F.when(i % 3 == 0, " by week 12").when(i % 3 == 1, " #loop").otherwise(" later"))
    # a decision-pending word makes the journal rule hold, so that the archive rule decides
    path = F.lit("/vault/90-journal/archive/a.md")
    return a.table(spark, d, "documents").select("doc_id", x.suits_path(path, F.lit(""), F.lit("loop"), F.concat(stmt, F.lit(" tbd"))).alias("kept"))


@query(_SUMMARY.replace("WITH ", f"WITH {a.SQL_NOTES}, ", 1) + " SELECT source, round(CASE WHEN source IN ('user', 'tool') THEN 1.0 WHEN source = 'assistant' THEN 0.7 ELSE 0.6 END, 2) AS weight, count(*) AS n FROM notes GROUP BY 1, 2")
def k1_source_weight(spark: SparkSession, d: str) -> DataFrame:
    fixed = F.lit("2020-01-01").cast("timestamp")  # far beyond the horizon, so recency is 0
    rows = a.notes(spark, d).withColumn("updated_ts", fixed).withColumn("confidence", F.lit(0.0))
    return rows.select("source", F.round(an.profile_score(a.now()) / 0.20, 2).alias("weight")).groupBy("source", "weight").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT '04-dev/' || doc_id || '.md' AS path, 'I prefer option ' || (doc_id % 30) AS s, doc_id % 17 AS y, doc_id % 7 AS m, doc_id % 5 AS g FROM documents
), c AS (SELECT *, row_number() OVER (ORDER BY y DESC, m DESC, g DESC, path) AS fr FROM f QUALIFY fr <= 50
), k AS (SELECT *, sha1('pref|dev|' || lower(s)) AS key FROM c)
SELECT path, s AS statement, key, 'write' AS route, least(1.0, CAST(0.92 AS DOUBLE) + least(g / CAST(30 AS DOUBLE), 0.2)) AS score FROM k WHERE s <> 'I prefer option 3' QUALIFY row_number() OVER (PARTITION BY key ORDER BY fr) = 1""")
def x12_import_cycle(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    scan = a.table(spark, d, "documents").select(
        F.concat(F.lit("04-dev/"), i, F.lit(".md")).alias("path"), F.concat(F.lit("I prefer option "), i % 30, F.lit("\n")).alias("text"), F.lit("h").alias("hash"), i.alias("size"),
        (i % 17).alias("yield"), (i % 7).alias("mtime"), (i % 5).alias("signal"),
    )
    known = spark.range(1).select(x.import_key(F.lit("pref"), F.lit("dev"), F.lit("I prefer option 3")).alias("key"))
    got = x.import_cycle(scan, scan.limit(0).select("path", "hash", "size"), known)
    return got.select("path", "statement", "key", "route", F.col("candidate_score").alias("score"))


@query(_SUMMARY + " SELECT note, hits, corrections, rating_sum, signal_score FROM summary")
def s3_signal_stream(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    from ..sources import index as stored
    from ..streaming import imports

    folder = f"{stored.folder(spark)}/signals-{uuid.uuid4().hex}"
    a.signals(spark, d).drop("event_id").write.json(folder)
    summary = imports.run_once(imports.watch_signals(spark, folder), f"signal_stream_{uuid.uuid4().hex}")
    return summary.select("note", "hits", "corrections", "rating_sum", "signal_score")


@query(f"""WITH {a.SQL_NOTES} SELECT rel_path, '- T' || doc_id || CASE WHEN type = 'loop' AND status <> '' THEN ' [' || status || ']' ELSE '' END || CASE WHEN confidence < 0.7 THEN printf(' (confidence %.2f)', confidence) ELSE '' END AS line FROM notes""")
def y1_listing(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import render

    return a.notes(spark, d).withColumn("title", F.concat(F.lit("T"), "doc_id")).select("rel_path", render.listing().alias("line"))


@query(f"""WITH {a.SQL_NOTES}, s AS (SELECT rel_path, doc_id, CAST(date_diff('day', CAST(updated_ts AS DATE), DATE '2024-02-15') AS INT) AS days FROM notes WHERE type = 'loop' AND status IN ('open', 'blocked'))
SELECT rel_path, days, '- T' || doc_id || CASE WHEN days > 21 THEN ' **[stale >21d]**' WHEN days > 14 THEN ' **[stale >14d]**' WHEN days > 7 THEN ' **[>7d]**' ELSE '' END || ' (' || days || 'd ago)' AS line FROM s""")
def f19_briefing_lines(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import render

    rows = a.notes(spark, d).withColumn("title", F.concat(F.lit("T"), "doc_id")).where("type = 'loop'")
    return render.briefing(an.staleness(rows, "2024-02-15"))


_CASES = "CASE WHEN item_id % 5 = 0 THEN '' ELSE 'q' END"


@query(f"""WITH c AS (SELECT item_id - item_id % 7 // 6 AS query_id, {_CASES} AS query, CASE WHEN item_id % 4 = 0 THEN 'moon' ELSE 'dev' END AS query_scope, CASE WHEN item_id % 3 = 0 THEN [] WHEN item_id % 3 = 1 THEN ['notes/1'] ELSE ['gone'] END AS expected FROM benchmark)
SELECT CAST(query_id AS BIGINT) AS query_id, code, count(*) AS n FROM (
  SELECT query_id, 'duplicate_id' AS code FROM c GROUP BY query_id HAVING count(*) > 1 UNION ALL SELECT query_id, 'empty_query' FROM c WHERE query = '' UNION ALL SELECT query_id, 'bad_scope' FROM c WHERE query_scope = 'moon'
  UNION ALL SELECT query_id, 'nothing_expected' FROM c WHERE len(expected) = 0 UNION ALL SELECT DISTINCT query_id, 'missing_path' FROM c WHERE list_contains(expected, 'gone')) GROUP BY ALL""")
def x20_case_lint(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import lint

    i = F.col("item_id")
    rows = a.table(spark, d, "benchmark").select(
        (i - F.floor(i % 7 / 6)).alias("query_id"), F.when(i % 5 == 0, "").otherwise("q").alias("query"), F.when(i % 4 == 0, "moon").otherwise("dev").alias("query_scope"),
        F.when(i % 3 == 0, t.strings()).when(i % 3 == 1, t.strings("notes/1")).otherwise(t.strings("gone")).alias("expected"),
    )
    found = lint.cases(rows, spark.createDataFrame([("notes/1",)], "rel_path string"))
    return found.groupBy("query_id", "code").agg(F.count("*").alias("n"))
