"""Continuous import and running feedback summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import analytics, extract
from ..schema import DEFAULTS, SIGNAL, Settings
from ..sources import files

KEYS, DONE = "key string", "path string, hash string, size long"


def watch_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Running summary of a growing feedback log."""
    rows = spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", 100).json(folder)
    return analytics.signal_summary(rows)


def import_batch(spark: SparkSession, scan: DataFrame, state: str, out: str, batch_id: int, settings: Settings = DEFAULTS) -> None:
    """Import one batch of source files. Keys and files already seen are kept in tables under state, a folder for each batch, so
    a repeated batch overwrites itself and gives the same rows."""
    keys = files.state(spark, f"{state}/keys", KEYS + ", batch long").where(F.col("batch") < batch_id)
    done = files.state(spark, f"{state}/done", DONE + ", batch long").where(F.col("batch") < batch_id)
    chosen = extract.select_files(scan, done.select("path", "hash", "size"), settings)
    got = extract.import_cycle(scan, done.select("path", "hash", "size"), keys.select("key"), settings)
    got.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    spark.read.parquet(f"{out}/batch={batch_id}").select("key").write.mode("overwrite").parquet(f"{state}/keys/batch={batch_id}")
    chosen.select("path", "hash", "size").write.mode("overwrite").parquet(f"{state}/done/batch={batch_id}")


def watch_sources(spark: SparkSession, folder: str, state: str, out: str, checkpoint: str, trigger: dict | None = None, settings: Settings = DEFAULTS, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Import Markdown files as they arrive under folder; {'availableNow': True} runs once over what is there.

    A batch takes at most import_files files, and all statements of them: files beyond that wait for the next batch, none is left out.
    """
    every = replace(settings, import_notes=2**31 - 1, bucket_caps={})
    stream = spark.readStream.format("text").schema("value string").option("wholetext", True).option("maxFilesPerTrigger", settings.import_files).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)
    m = F.col("_metadata")
    scan = stream.select(
        F.regexp_replace(m["file_path"], "^.*?" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", "").alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("hash"),
        m["file_size"].alias("size"), m["file_modification_time"].alias("mtime"), extract.signal_score(F.col("value")).alias("signal"), extract.yield_hint(F.col("value")).alias("yield"),
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        import_batch(batch.sparkSession, batch.persist(), state, out, batch_id, every)
        batch.unpersist()
        if then:
            then(batch_id)

    return stream_writer(scan, checkpoint, trigger).foreachBatch(each).start()


def stream_writer(df: DataFrame, checkpoint: str, trigger: dict | None):
    return df.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "3 seconds"}))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of a stream of events (stream, at, lineno, action): events of one stream with less than a gap between them are one session.

    stream, began, ended (of its last event), events, first_line, last_line, sleeps. For a streaming plan give late, how far behind events may
    come: a session is told once, when nothing can be added to it. A long session is merged from parts, not gathered.
    """
    rows = events.withWatermark("at", late) if late else events
    out = rows.groupBy(F.session_window("at", gap).alias("w"), "stream").agg(
        F.min("at").alias("began"), F.max("at").alias("ended"), F.count("*").alias("events"), F.min("lineno").alias("first_line"), F.max("lineno").alias("last_line"), F.count_if(F.col("action") == "sleep").alias("sleeps")
    )
    return out.drop("w")


def captured(sessions: DataFrame, baseline: DataFrame) -> DataFrame:
    """Ends of sessions to be captured: those with lines after their stream's baseline (stream, baseline: the last line read when it was taken),
    and where their new lines begin. A stream without a baseline is new as a whole."""
    new = F.greatest(F.col("first_line"), F.coalesce("baseline", F.lit(-1)) + 1)
    rows = sessions.join(baseline.select("stream", "baseline"), "stream", "left").where(F.col("last_line") > F.coalesce("baseline", F.lit(-1)))
    return rows.withColumn("from_line", new).drop("baseline")


def run_once(rows: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming plan over all that is there, into a table in memory; for summaries of bounded size."""
    q = rows.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.table(name)
