"""Sync of tracked notes with the timeline against the committed state: check, plan of what the log lacks, and apply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics
from ..sources import state

#: What a change of a file is called in the timeline.
ACTION_OF = {"added": "created", "modified": "updated", "deleted": "deleted"}


def since(at: state.Snapshot, timeline: DataFrame) -> tuple[DataFrame, bool]:
    """Events (ts, action, path, lineno) after the last sync, and whether the log is shorter than it was then; of such a log all events count."""
    rewound = timeline.count() < int(at.facts.get("timeline_event_count", 0))
    return (timeline if rewound else timeline.where(F.col("lineno") > int(at.facts.get("timeline_last_line", -1)))), rewound


def drift(at: state.Snapshot, files: DataFrame, timeline: DataFrame) -> DataFrame:
    """path, state (added, modified, deleted; null without a change), kind (logged, unlogged, timeline_only) since the last sync."""
    changed = analytics.diff(at.table("sync_files", state.SCHEMAS["sync_files"]), files.select("path", "hash")).where("state <> 'unchanged'")
    logged = since(at, timeline)[0].select("path", F.lit(True).alias("logged")).where("path IS NOT NULL").distinct()
    both = changed.join(logged, "path", "full_outer")
    kind = F.when(F.col("state").isNull(), "timeline_only").when(F.col("logged"), "logged").otherwise("unlogged")
    return both.select("path", "state", kind.alias("kind"))


def check(at: state.Snapshot, files: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row: synced (whether there is a state), damaged (whether a newer one can't be read), counts of drift, rewound, verdict and exit_code."""
    rewound, n = since(at, timeline)[1], lambda c: F.count_if(c)
    rows = drift(at, files, timeline).agg(
        n(F.col("state") == "added").alias("added"), n(F.col("state") == "modified").alias("modified"), n(F.col("state") == "deleted").alias("removed"),
        n(F.col("kind") == "unlogged").alias("unlogged"), n(F.col("kind") == "timeline_only").alias("timeline_only"),
    )
    known = "sync_files" in at.tables
    verdict = F.lit("damaged" if at.damaged else "missing") if not known or at.damaged else F.when(F.col("unlogged") > 0, "unlogged").when(F.lit(rewound), "inconsistent").otherwise("healthy")
    rows = rows.select(F.lit(known).alias("synced"), "added", "modified", "removed", "unlogged", "timeline_only", F.lit(rewound).alias("rewound"), verdict.alias("verdict"))
    return rows.withColumn("exit_code", F.when(F.col("verdict") == "healthy", 0).otherwise(1))


def missing_events(at: state.Snapshot, files: DataFrame, timeline: DataFrame, now: str) -> DataFrame:
    """ts, action, path, desc of the events that unlogged changes lack: the plan of what to append to the timeline."""
    action = F.create_map(*[F.lit(x) for pair in ACTION_OF.items() for x in pair])[F.col("state")]
    return drift(at, files, timeline).where("kind = 'unlogged'").select(F.lit(now).alias("ts"), action.alias("action"), "path", F.lit("found by sync").alias("desc"))


def apply(spark: SparkSession, root: str, files: DataFrame, timeline: Callable[[], DataFrame], now: str, append: Callable[[DataFrame], object] | None = None) -> state.Snapshot:
    """Make the tracked files and the timeline, read anew by timeline(), the state of sync. With append, what the log lacks is appended first.

    Nothing is written where the state says what is there already, so a second apply changes nothing. A job that stops between the two writes
    is mended by the next one: events that were appended are logged then. Another sync at the same time is refused (state.Conflict).
    """
    at = state.current(spark, root)
    changed, (new, rewound) = drift(at, files, timeline()).where("state IS NOT NULL"), since(at, timeline())
    if "sync_files" in at.tables and not at.damaged and not rewound and changed.isEmpty() and new.isEmpty():
        return at
    if append and "sync_files" in at.tables:
        lacking = missing_events(at, files, timeline(), now)
        if not lacking.isEmpty():
            append(lacking)
    tables, facts = state.sync(files, timeline(), now)
    return state.commit(at, tables, facts, relies_on=["sync_files", "timeline_event_count"])
