"""Signals, timeline, corpus statistics, links, snapshots and context: aggregations over note tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as t
from ..schema import DEFAULTS, STOPWORDS, Settings
from .places import placed


# Signals -----------------------------------------------------------------------------------------------------------


def signal_summary(signals: DataFrame) -> DataFrame:
    """Counts, rating statistics and signal score of each note; rows without a note don't count."""
    n = lambda kind: F.count_if(F.col("type") == kind)
    out = signals.where(F.col("note").isNotNull() & (F.col("note") != "")).groupBy("note").agg(
        n("retrieval_hit").alias("hits"), n("correction").alias("corrections"), n("affirmation").alias("affirmations"), n("stale_flag").alias("stale_flags"),
        n("preference_applied").alias("preferences"), F.max(F.when(F.col("type") == "retrieval_hit", F.col("ts"))).alias("last_hit"),
        F.count("rating").alias("rating_count"), F.sum("rating").alias("rating_sum"), F.min("rating").alias("rating_min"), F.max("rating").alias("rating_max"),
    )
    bad = F.col("corrections") + F.col("stale_flags")
    s = (F.col("affirmations") - bad) / (F.col("affirmations") + bad + 1)
    usage = F.least(F.col("hits") / 10, F.lit(1.0))
    return out.withColumn("signal_score", F.bround(F.when(s >= 0, s * usage).otherwise(s), 4))


def retrieval_misses(signals: DataFrame, top: int = 20) -> DataFrame:
    rows = signals.where((F.col("type") == "retrieval_miss") & (F.coalesce("query", F.lit("")) != ""))
    return rows.groupBy("query").agg(F.count("*").alias("misses")).orderBy(F.desc("misses"), "query").limit(top)


def signal_types(signals: DataFrame) -> DataFrame:
    return signals.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def top_notes(summary: DataFrame, top: int = 10) -> DataFrame:
    return summary.select("note", "hits").orderBy(F.desc("hits"), "note").limit(top)


def gated_scores(signals: DataFrame, notes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Signal score of each note (0 where unknown), all 0 until enough signals are in."""
    total = signals.agg(F.count("*").alias("total"))
    scored = notes.select("rel_path").join(signal_summary(signals).select(F.col("note").alias("rel_path"), "signal_score"), "rel_path", "left").crossJoin(F.broadcast(total))
    return scored.select("rel_path", F.when(F.col("total") >= settings.signal_min_entries, F.coalesce("signal_score", F.lit(0.0))).otherwise(F.lit(0.0)).alias("signal_score"))


def signal_totals(signals: DataFrame) -> DataFrame:
    """All signals, and notes with corrections that wait."""
    return signals.agg(F.count("*").alias("total"), F.count_distinct(F.when((F.col("type") == "correction") & (F.col("note") != ""), F.col("note"))).alias("corrections_pending"))


# Timeline ----------------------------------------------------------------------------------------------------------


def since(timeline: DataFrame, start: str) -> DataFrame:
    """Events at or after start."""
    return timeline.where(F.col("ts").isNotNull() & (F.col("ts") >= start))


def order_violations(timeline: DataFrame, stream: str = "path") -> DataFrame:
    """Events of a stream that come after a later one, by line number."""
    w = Window.partitionBy(stream).orderBy("lineno")
    return timeline.withColumn("before", F.lag("ts").over(w)).where(F.col("ts") < F.col("before"))


def since_sleep(timeline: DataFrame, today: str, days: int = 7, changes: int = 25) -> DataFrame:
    """Of each stream: changes after its last sleep event, whole days since, and whether sleep is due."""
    last = timeline.groupBy("stream").agg(F.max(F.when(F.col("action") == "sleep", F.col("lineno"))).alias("at"), F.max(F.when(F.col("action") == "sleep", F.col("ts"))).alias("slept"))
    rows = timeline.join(last, "stream").groupBy("stream", "slept").agg(F.count_if((F.col("lineno") > F.coalesce("at", F.lit(-1))) & (F.col("action") != "sleep")).alias("changes"))
    rows = rows.withColumn("days", F.datediff(F.lit(today).cast("date"), F.col("slept").cast("date")))
    return rows.withColumn("due", F.coalesce(F.col("days") >= days, F.lit(True)) | (F.col("changes") >= changes))


def action_counts(timeline: DataFrame, start: str) -> DataFrame:
    return since(timeline, start).groupBy("action").agg(F.count("*").alias("n"))


def parse_timeline(lines: DataFrame) -> DataFrame:
    """Rows of Markdown timeline lines (value, lineno); lines of another form are left out."""
    pattern = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z) \| (created|updated|archived|deleted|closed|sleep) \| (.+?) \| (.*)$"
    names = ("ts", "action", "path", "desc")
    return lines.where(F.col("value").rlike(pattern)).select("lineno", *[F.regexp_extract("value", pattern, k + 1).alias(c) for k, c in enumerate(names)])


#: What the notes of a folder are called in a timeline.
EVENT_TYPES = {
    "01_identity": "identity", "02_facts": "fact", "03_preferences": "preference", "04_goals": "goal", "05_open_loops": "loop", "06_concepts": "concept", "08_indices": "index",
}


def event_type(path: Column) -> Column:
    """Type of the note that an event is about, by its path's folder; other for any other path."""
    out, at = F.lit("other"), t.strip(F.coalesce(path, F.lit("")))
    for folder, kind in EVENT_TYPES.items():
        out = F.when(at.startswith(f"notes/{folder}/"), kind).otherwise(out)
    return out


def last_events(timeline: DataFrame, now: str, hours: int = 24, most: int = 10) -> DataFrame:
    """The last events of the hours before now."""
    at = lambda c: F.to_timestamp(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return timeline.where(F.unix_timestamp(at(F.lit(now))) - F.unix_timestamp(at(F.col("ts"))) < hours * 3600).orderBy(F.desc("ts"), F.desc("lineno")).limit(most)


def after_baseline(timeline: DataFrame, baseline: DataFrame) -> DataFrame:
    """Events of each stream after its baseline (stream, baseline: lines read then); all of a stream that is shorter now."""
    read = timeline.groupBy("stream").agg(F.max("lineno").alias("last")).join(baseline, "stream", "left")
    start = read.select("stream", F.when(F.col("last") < F.col("baseline"), -1).otherwise(F.coalesce("baseline", F.lit(-1))).alias("start"))
    return timeline.join(start, "stream").where(F.col("lineno") > F.col("start")).drop("start")


def numbered(texts: DataFrame, key: str) -> DataFrame:
    """Timeline rows of whole Markdown texts, with their line numbers."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("lineno", "value")).withColumn("lineno", F.col("lineno") + 1)
    rows = parse_timeline(lines.withColumn("lineno", F.struct(key, "lineno")))
    return rows.select(f"lineno.{key}", "lineno.lineno", "ts", "action", "path", "desc")


def vault_events(events: DataFrame, now: Column) -> DataFrame:
    """Timeline rows with logical paths; a row's own time holds, else it is now."""
    return events.withColumns({"path": t.logical_path(F.col("path")), "ts": F.coalesce("ts", now)})


def render_timeline(timeline: DataFrame) -> DataFrame:
    return timeline.select(F.concat_ws(" | ", "ts", "action", "path", "desc").alias("value"))


# Briefing ----------------------------------------------------------------------------------------------------------


def staleness(loops: DataFrame, now: str) -> DataFrame:
    """Days since update of active loops, with band and nudge (stale, and not nudged for three days)."""
    rows = loops.where(F.col("status").isin("open", "blocked")).withColumn("days", F.datediff(F.lit(now).cast("date"), F.col("updated_ts").cast("date")))
    band = F.when(F.col("days") > 21, "stale >21d").when(F.col("days") > 14, "stale >14d").when(F.col("days") > 7, ">7d").otherwise("")
    return rows.withColumn("band", band)


def nudges(stale: DataFrame, log: DataFrame, now: str, most: int = 5, pause: int = 3) -> DataFrame:
    rows = stale.where("days > 7").join(log, "rel_path", "left")
    rows = rows.where(F.col("last_nudge").isNull() | (F.datediff(F.lit(now).cast("date"), F.col("last_nudge").cast("date")) >= pause))
    return rows.orderBy(F.desc("days"), "rel_path").limit(most)


def weekly_loops(loops: DataFrame, now: str) -> DataFrame:
    """Open and blocked loops, open ones not updated for two weeks, and open ones without a next action."""
    is_open, days = F.col("status") == "open", F.datediff(F.lit(now).cast("date"), F.col("updated_ts").cast("date"))
    return loops.agg(F.count_if(is_open).alias("open"), F.count_if(F.col("status") == "blocked").alias("blocked"), F.count_if(is_open & (days > 14)).alias("stale"), F.count_if(is_open & (F.coalesce("next_action", F.lit("")) == "")).alias("gaps"))


# Corpus ------------------------------------------------------------------------------------------------------------


def sizes(notes: DataFrame) -> DataFrame:
    return notes.select("rel_path", t.word_count(F.col("text")).alias("words"))


def tag_index(notes: DataFrame, chunk: int = 10_000) -> DataFrame:
    """tag, part, paths; the paths of a frequent tag are in several parts of about chunk paths each."""
    held = notes.select("rel_path", F.explode("tags").alias("tag"))
    frequent = held.groupBy("tag").agg(F.ceil(F.count("*") / chunk).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("rel_path"), F.coalesce("parts", F.lit(1)))
    return held.join(frequent, "tag", "left").withColumn("part", part).groupBy("tag", "part").agg(F.sort_array(F.collect_set("rel_path")).alias("paths"))


def tag_pairs(notes: DataFrame) -> DataFrame:
    """Symmetric co-occurrence counts of the tags of one note."""
    tags = notes.select("rel_path", F.explode(F.array_distinct("tags")).alias("tag"), F.array_distinct("tags").alias("others"))
    return tags.select("tag", F.explode("others").alias("other")).where("tag <> other").groupBy("tag", "other").agg(F.count("*").alias("n"))


def phrase_tokens(text: Column) -> Column:
    """Lower-cased words of at least three characters that aren't stopwords, in order; _ and - split."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))


def phrases(texts: DataFrame, column: str) -> DataFrame:
    """Counts of all two- and three-word phrases."""
    rows = texts.select(phrase_tokens(F.col(column)).alias("w"))

    def grams(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, runs).otherwise(t.strings())

    return rows.select(F.explode(F.concat(grams(2), grams(3))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


def alias_suggestions(notes: DataFrame, phrase_counts: DataFrame, existing: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """alias, phrases: neighbours of tags and frequent phrases by their first word, without those already known."""
    by_tag = tag_pairs(notes).where(F.col("n") >= least).select(F.col("tag").alias("alias"), F.lower(t.strip(F.regexp_replace("other", "[_-]", " "))).alias("phrase"))
    by_phrase = phrase_counts.where(F.col("n") >= least).select(F.element_at(F.split("phrase", " "), 1).alias("alias"), "phrase").where(F.length("alias") >= 3)
    found = by_tag.unionByName(by_phrase).where("phrase <> ''").distinct().join(existing.select("alias", "phrase"), ["alias", "phrase"], "left_anti")
    first = Window.partitionBy("alias").orderBy("phrase")
    return found.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= most).groupBy("alias").agg(F.sort_array(F.collect_list("phrase")).alias("phrases"))


def catalogue(notes: DataFrame, width: int = 200) -> DataFrame:
    """Title, first content line, tags, confidence and rank by update within the type."""
    rows = notes.select("rel_path", "type", "title", F.substring(t.first_content_line(F.col("body")), 1, width).alias("summary"), "tags", "confidence", "updated")
    return placed(rows, "type", [F.desc("updated"), F.desc("rel_path")])


def metrics(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Count, sum, mean and nearest-rank 95th percentile."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def fingerprint(files: DataFrame, group: str, part: int = 4096) -> DataFrame:
    """One hash over the sorted (path, hash) lines of each group. Of more than `part` lines, every so many are hashed, and the hashes, a line
    each, take their place; so no row gathers more than a part, and two corpora have one hash only if all lines are the same."""
    lines = files.select(F.col(group).alias("g"), F.concat("path", F.lit("\t"), "hash", F.lit("\n")).alias("line"))
    while True:
        at = placed(lines, "g", [F.col("line").asc()] if "at" not in lines.columns else [F.col("at").asc()])
        parts = at.groupBy("g", ((F.col("pos") - 1) / part).cast("long").alias("at")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), ""), 256).alias("h"))
        if parts.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0] == 0:
            return parts.select(F.col("g").alias(group), F.col("h").alias("fingerprint"))
        lines = parts.select("g", "at", F.concat("h", F.lit("\n")).alias("line"))


def digest(files: DataFrame, group: str, block: int = 64) -> DataFrame:
    """SHA-256 over all sorted (path, hash) lines of each group as one text; null lines are left out, a group without lines has null.

    Lines are sorted in ranges and joined to blocks in parallel. A hash takes its bytes one after another, so a group's blocks pass one task in their order,
    which holds a batch of them at a time."""
    lines = files.select(F.col(group).alias("g"), F.concat("path", F.lit("\t"), "hash", F.lit("\n")).alias("line"))
    at = placed(lines.where("line IS NOT NULL"), "g", [F.col("line").asc()])
    blocks = at.groupBy("g", ((F.col("pos") - 1) / block).cast("long").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("text"))
    names = [group, "fingerprint"]

    def run(batches):
        key, held = None, None
        for batch in batches:
            out = []
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None or g != key:
                    if held is not None:
                        out.append((key, held.hexdigest()))
                    key, held = g, hashlib.sha256()
                held.update(text.encode())
            kind = batch.schema.field(0).type
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out])], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([held.hexdigest()])], names=names)

    schema = StructType([StructField(group, lines.schema["g"].dataType), StructField("fingerprint", StringType())])
    found = blocks.repartition("g").sortWithinPartitions("g", "at").select("g", "text").mapInArrow(run, schema)
    bare = lines.groupBy("g").agg(F.count("line").alias("n")).where("n = 0").select(F.col("g").alias(group), F.lit(None).cast("string").alias("fingerprint"))
    return found.unionByName(bare)


# Links -------------------------------------------------------------------------------------------------------------


def edges(notes: DataFrame) -> DataFrame:
    return notes.select("rel_path", F.explode(t.links(F.col("body"))).alias("l")).select(F.col("rel_path").alias("src"), "l.*")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Outgoing and incoming links of each node, and whether it has none."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outgoing"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("incoming"))
    rows = nodes.join(out, "node", "left").join(into, "node", "left").na.fill(0, ["outgoing", "incoming"])
    return rows.withColumn("orphan", (F.col("outgoing") + F.col("incoming")) == 0)


def broken(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Links to .md targets that no path equals or ends with: an anti-join on what paths end with, each such end once, so that a name that is
    in every folder is one row."""
    parts = F.split("path", "/")
    ends = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("dst")).distinct()
    return edges.where(F.col("dst").endswith(".md")).select("src", "dst").distinct().join(ends, "dst", "left_anti").select("src", "dst")


# Snapshots ---------------------------------------------------------------------------------------------------------


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, deleted, modified or unchanged, for every path of two snapshots (path, hash)."""
    a, b = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    state = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def drift(old: DataFrame, new: DataFrame, logged: DataFrame) -> DataFrame:
    """Changes by whether the timeline has them: logged, unlogged, and timeline_only for logged paths that didn't change."""
    changed = diff(old, new).where("state <> 'unchanged'")
    paths = logged.select("path").distinct()
    return (
        changed.join(paths, "path", "left_semi").select("path", F.lit("logged").alias("kind"))
        .unionByName(changed.join(paths, "path", "left_anti").select("path", F.lit("unlogged").alias("kind")))
        .unionByName(paths.join(changed, "path", "left_anti").select("path", F.lit("timeline_only").alias("kind")))
    )


def map_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many paths were added, removed and changed, and whether the maps are equal."""
    n = lambda state: F.count_if(F.col("state") == state)
    return diff(old, new).agg(n("added").alias("added"), n("deleted").alias("removed"), n("modified").alias("changed"), (F.count_if(F.col("state") != "unchanged") == 0).alias("is_equal"))


def sync_verdict(old: DataFrame, new: DataFrame, logged: DataFrame, events_then: int, events_now: int) -> DataFrame:
    """Drift since a baseline, unlogged changes, and whether the timeline is shorter than it was then; exit_code is 1 unless all is well."""
    rows = drift(old, new, logged).agg(F.count_if(F.col("kind") == "unlogged").alias("unlogged"))
    counts = map_diff(old, new).select("added", F.col("changed").alias("modified"), "removed")
    both = counts.join(rows).withColumn("rewound", F.lit(events_now < events_then))  # one row each
    verdict = F.when(F.col("unlogged") > 0, "unlogged").when(F.col("rewound"), "inconsistent").otherwise("healthy")
    return both.withColumn("verdict", verdict).withColumn("exit_code", F.when(verdict == "healthy", 0).otherwise(1))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of table with the same key."""
    return table.join(rows, key, "left_anti").unionByName(rows)


# Context -----------------------------------------------------------------------------------------------------------


def profile_score(now: Column) -> Column:
    from .rank import recency

    weight = F.when(F.col("source").isin("user", "tool"), 1.0).when(F.col("source") == "assistant", 0.7).when(F.col("source") == "inferred", 0.6).otherwise(0.5)
    return 0.55 * recency(F.col("updated_ts"), now) + 0.25 * F.col("confidence") + 0.20 * weight


def profiles(notes: DataFrame, now: Column, caps: dict[str, int] | None = None) -> DataFrame:
    """Best notes of each scope and type; identity is unlimited, concepts have no place."""
    caps = caps or {"fact": 6, "pref": 8, "goal": 8, "loop": 10}
    order = Window.partitionBy("scope", "type").orderBy(F.desc("profile"), F.desc("updated"), F.desc("rel_path"))
    rows = notes.where(F.col("type") != "concept").withColumn("profile", profile_score(now)).withColumn("pos", F.row_number().over(order))
    cap = F.lit(2**31 - 1)
    for kind, n in caps.items():
        cap = F.when(F.col("type") == kind, n).otherwise(cap)
    return rows.where(F.col("pos") <= cap)


def context_items(rows: DataFrame, most: int = 20) -> DataFrame:
    """The best profile items of all."""
    return rows.orderBy(F.desc("profile"), F.desc("updated"), F.desc("rel_path")).limit(most)


def boot_payload(notes: DataFrame, signals: DataFrame) -> DataFrame:
    """One row for a session's start: notes, open loops, the latest update and the signals that are in."""
    own = notes.agg(F.count("*").alias("notes"), F.count_if((F.col("type") == "loop") & (F.col("status") == "open")).alias("open_loops"), F.max("updated").alias("latest"))
    return own.join(signals.agg(F.count("*").alias("signals")))  # one row each


def boot_lines(notes: DataFrame, timeline: DataFrame, signals: DataFrame, now: Column, today: str, settings: Settings = DEFAULTS) -> DataFrame:
    """section, pos, line of the text that a session starts with, in that order: context notes by scope and type, then whether the notes want
    tending, then what the signals say. A stream of signals or events without rows has no lines."""
    kinds = {"id": "Identity", "fact": "Facts", "pref": "Preferences", "goal": "Goals", "loop": "Open loops"}
    heading, rank = F.lit(""), F.lit(len(kinds))
    for k, (kind, name) in enumerate(kinds.items()):
        heading, rank = F.when(F.col("type") == kind, name).otherwise(heading), F.when(F.col("type") == kind, k).otherwise(rank)
    line = F.concat(F.lit("- "), heading, F.lit(" ("), "scope", F.lit("): "), t.shorten(F.col("title"), 160))
    context = boot(notes, now, settings).select(F.lit(1).alias("section"), rank.alias("rank"), F.col("pos").cast("long").alias("k"), "scope", "rel_path", line.alias("line"))
    asleep = since_sleep(timeline, today).select(
        F.lit(2).alias("section"), F.lit(0).alias("rank"), F.col("changes").cast("long").alias("k"), F.col("stream").cast("string").alias("scope"), F.lit("").alias("rel_path"),
        F.concat(F.lit("- Stream "), "stream", F.lit(": "), "changes", F.lit(" changes since it was tended, "), F.coalesce(F.concat(F.col("days").cast("string"), F.lit(" days ago")), F.lit("never")), F.when(F.col("due"), "; due").otherwise("")).alias("line"),
    )
    totals = signals.agg(F.count("*").alias("n"), F.count_if(F.col("type") == "correction").alias("corrections")).where("n > 0")
    told = lambda k, c: F.struct(F.lit(k).alias("rank"), c.alias("line"))
    said = totals.select(F.explode(F.array_compact(F.array(
        told(0, F.concat(F.lit("- Signals: "), "n")), F.when(F.col("corrections") > 0, told(1, F.concat(F.lit("- Corrections to look at: "), "corrections")))))).alias("x")).select("x.*")
    missed = retrieval_misses(signals, 1).select(F.lit(2).alias("rank"), F.concat(F.lit('- Asked for most without a result: "'), "query", F.lit('" ('), "misses", F.lit(")")).alias("line"))
    signalled = said.unionByName(missed).select(F.lit(3).alias("section"), "rank", F.lit(0).cast("long").alias("k"), F.lit("").alias("scope"), F.lit("").alias("rel_path"), "line")
    rows = context.unionByName(asleep).unionByName(signalled)
    # context and signals are of bounded size; streams may be many
    return placed(rows, "section", [F.col("scope").asc(), F.col("rank").asc(), F.col("k").asc(), F.col("rel_path").asc()]).select("section", "pos", "line")


def boot(notes: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Confident notes and active loops for a session's start."""
    active = F.coalesce("status", F.lit("open")).isin("open", "blocked", "snoozed")
    rows = notes.where(F.when(F.col("type") == "loop", active).otherwise(F.col("confidence") >= settings.boot_min_confidence))
    return profiles(rows, now, {"fact": 6, "pref": 8, "goal": 8, "loop": 12})
