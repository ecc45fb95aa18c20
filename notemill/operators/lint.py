"""Violations of notes and evaluation cases, a row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..schema import LANGS, SCOPES, SOURCES, STATUSES
from . import analytics

REQUIRED = ("created", "updated", "tags", "confidence", "source", "scope", "lang")
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def notes(parsed: DataFrame, large: int = 2000) -> DataFrame:
    """rel_path, severity, code of parsed notes (operators.notes.parse)."""
    raw = lambda key: F.coalesce(t.front_value(F.col("front"), key), F.lit(""))
    error = lambda cond, code: F.when(cond, F.struct(F.lit("error").alias("severity"), F.lit(code).alias("code")))
    warn = lambda cond, code: F.when(cond, F.struct(F.lit("warning").alias("severity"), F.lit(code).alias("code")))
    has, is_loop = F.col("front").isNotNull(), F.col("type") == "loop"
    conf = raw("confidence").try_cast("double")
    active = is_loop & (F.coalesce("status", F.lit("open")) == "open")
    action = t.section(F.col("sections"), "next action")
    listed = lambda key, values: (raw(key) != "") & ~F.lower(raw(key)).isin(*values)
    checks = [
        error(~has, "missing_front_matter"),
        *[error(has & (raw(k) == "" if k != "tags" else ~F.col("front").rlike("(?m)^tags:")), f"missing_{k}") for k in REQUIRED],
        error(has & is_loop & (raw("status") == ""), "loop_without_status"),
        *[error(has & (raw(k) != "") & ~raw(k).rlike(STAMP), f"bad_{k}") for k in ("created", "updated")],
        error(has & listed("source", SOURCES), "bad_source"), error(has & listed("scope", SCOPES), "bad_scope"), error(has & listed("lang", LANGS), "bad_lang"),
        error(has & is_loop & listed("status", STATUSES), "bad_status"),
        error(has & F.exists("tags", lambda x: ~x.rlike("^[a-z0-9][a-z0-9_-]*$")), "bad_tag"),
        error(has & ((conf < 0) | (conf > 1)), "confidence_out_of_range"),
        warn(has & (F.lower(raw("source")) == "inferred") & (conf > 0.8), "inferred_too_confident"),
        warn(has & (t.word_count(F.col("text")) > large), "large_file"),
        warn(has & active & (action == ""), "loop_without_next_action"), warn(has & active & (action != "") & ~t.has_checkbox(action), "loop_without_checkbox"),
        warn(has & t.section(F.col("sections"), "links").rlike(r"(?m)^\s*-\s*$"), "placeholder_link"),
        warn(has & F.array_contains("tags", "synthesized") & (F.size(t.links(F.col("body"))) == 0), "synthesized_without_links"),
    ]
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return parsed.select("rel_path", F.explode(found).alias("v")).select("rel_path", "v.severity", "v.code")


def counters(violations: DataFrame) -> DataFrame:
    return violations.groupBy("severity", "code").agg(F.count("*").alias("n"))


def cases(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """query_id, code of evaluation cases (query_id, query, query_scope, expected) that can't be used."""
    twice = rows.groupBy("query_id").count().where("count > 1").select("query_id", F.lit("duplicate_id").alias("code"))
    empty = rows.where(t.strip(F.coalesce("query", F.lit(""))) == "").select("query_id", F.lit("empty_query").alias("code"))
    scope = rows.where(~F.col("query_scope").isin(*SCOPES)).select("query_id", F.lit("bad_scope").alias("code"))
    none = rows.where(F.size("expected") <= 0).select("query_id", F.lit("nothing_expected").alias("code"))
    missing = rows.select("query_id", F.explode("expected").alias("rel_path")).join(paths, "rel_path", "left_anti").select("query_id", F.lit("missing_path").alias("code")).distinct()
    return twice.unionByName(empty).unionByName(scope).unionByName(none).unionByName(missing)


def timeline(lines: DataFrame) -> DataFrame:
    """lineno, code of timeline lines (lineno, value, stream): those that begin like an event but aren't one, wildcard paths, and events
    that come after a later one of their stream."""
    dated = lines.where(F.trim("value").rlike("^[0-9]"))
    rows = analytics.parse_timeline(dated.withColumn("lineno", F.struct("stream", "lineno"))).select("lineno.*", "ts", "path")
    bad = dated.join(rows, ["stream", "lineno"], "left_anti").select("lineno", F.lit("invalid_format").alias("code"))
    wild = rows.where(F.col("path").contains("*")).select("lineno", F.lit("wildcard_path").alias("code"))
    late = analytics.order_violations(rows, "stream").select("lineno", F.lit("out_of_order").alias("code"))
    return bad.unionByName(wild).unionByName(late)
