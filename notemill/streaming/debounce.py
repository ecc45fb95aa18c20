"""Debounced import: a file's changes gather until it is quiet, and what was seen stays in the state store.

Two queries, each with its own checkpoint, so that either can stop and go on:

1. ``settle``: a stream of changes (path, text, hash, size, mtime) keyed by path. A path's newest version waits for `quiet_ms` without a
   further change, by a timer of its key; then it is told once. A version equal to the one that was told last is not told again.
2. ``extract_settled``: statements of settled files; of each import key the first is kept (deduplication in the state store), so earlier
   keys are not read again by any batch.

A change is a record of a log (files that are written over are not new to a file source). The text of a path is held while it waits, its hash
afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import extract
from ..schema import DEFAULTS, Settings
from .imports import stream_writer

CHANGE = "path string, text string, mtime timestamp"
SETTLED = "path string, text string, hash string, size long, mtime timestamp"
#: What waits, if anything, and the hash that was told last.
_STATE = "waits boolean, text string, hash string, mtime timestamp, told string"


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of changes from a folder of JSON records (path, text, mtime)."""
    return spark.readStream.schema(CHANGE).json(folder)


def settled(changed: DataFrame, quiet_ms: int = 3000) -> DataFrame:
    """The version of each path that has been quiet for quiet_ms; of changes of one batch the newest counts, ties by hash."""

    def run(key: tuple[str], pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waits, text, digest, mtime, told = state.get if state.exists else (False, "", "", pd.Timestamp(0), "")
        if state.hasTimedOut:
            state.update((False, "", "", pd.Timestamp(0), digest))
            if waits:
                yield pd.DataFrame({"path": [key[0]], "text": [text], "hash": [digest], "size": [len(text.encode())], "mtime": [mtime]})
            return
        for pdf in pdfs:
            for row in pdf.itertuples():
                if not waits or (row.mtime, row.hash) >= (mtime, digest):
                    waits, text, digest, mtime = True, row.text, row.hash, row.mtime
        if digest == told:
            state.update((False, "", "", pd.Timestamp(0), told))
        else:
            state.update((waits, text, digest, mtime, told))
            state.setTimeoutDuration(quiet_ms)

    rows = changed.select("path", F.coalesce("text", F.lit("")).alias("text"), "mtime").where("path IS NOT NULL AND mtime IS NOT NULL").withColumn("hash", F.sha2("text", 256))
    return rows.groupBy("path").applyInPandasWithState(run, SETTLED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def settle(changed: DataFrame, out: str, checkpoint: str, quiet_ms: int = 3000, every: str = "1 second") -> StreamingQuery:
    """Write settled versions to a folder as they become quiet."""
    return stream_writer(settled(changed, quiet_ms), checkpoint, {"processingTime": every}).outputMode("append").format("parquet").start(out)


def keyed_statements(files: DataFrame) -> DataFrame:
    """path, kind, scope, statement, confidence, key of the statements of files (path, text) that their paths allow, repeated ones too."""
    found = extract.all_statements(files.select("path", "text"))
    kept = found.where(extract.suits_path(F.concat(F.lit("/"), F.col("path")), F.col("text"), F.col("kind"), F.col("statement")))
    scoped = kept.withColumn("scope", extract.scope_of_path(F.col("path")))
    return scoped.select("path", "kind", "scope", "statement", "confidence", extract.import_key(F.col("kind"), F.col("scope"), F.col("statement")).alias("key"))


def extract_settled(spark: SparkSession, folder: str, out: str, checkpoint: str, trigger: dict | None = None, settings: Settings = DEFAULTS) -> StreamingQuery:
    """Write the statements of settled files, the first of each key, with their route."""
    files = spark.readStream.schema(SETTLED).parquet(folder)
    rows = keyed_statements(files).dropDuplicates(["key"]).withColumn("route", extract.route(settings))
    return stream_writer(rows, checkpoint, trigger).outputMode("append").format("parquet").start(out)
