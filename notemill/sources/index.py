"""The stored note index: segments of entries and postings, refreshed by small segments of what changed.

A segment holds notes, their postings, and the paths of notes in older segments that it replaces or removes. Readers see the union of all
segments without what later ones have replaced. A refresh writes a segment of the changed files alone; when several segments of like size
have come together, they are merged into one. A pointer names the segments that count, so a stopped refresh changes nothing.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import notes as n
from ..operators import rank as r
from . import sinks

VERSION = 4
#: Segments of like size (within a factor of it) that are merged into one.
FANOUT = 4
_FOLDERS: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """Where indexes go that nobody named a place for: the shared folder of spark.checkpoint.dir; a temporary one in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="notemill-index-")
    return _FOLDERS[app]


def scratch(df: DataFrame) -> DataFrame:
    """A small table written to the shared folder and read back, so that a plan can read it several times; it goes when the session ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/scratch-{uuid.uuid4().hex}"
    fs, target = sinks.file_system(spark, path)
    fs.deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_GONE = "rel_path string, path string"


def _write(index: r.Index, root: str, gone: DataFrame | None = None) -> dict[str, object]:
    """Write a segment and say what it is. Postings are ranges of (token, path) in order: readers of some tokens skip most row groups, and
    a frequent token lies in many ranges."""
    spark, name = index.entries.sparkSession, sinks.new_version()
    index.entries.write.parquet(f"{root}/{name}/entries")
    entries = spark.read.parquet(f"{root}/{name}/entries")
    r.postings(entries).repartitionByRange("token", "rel_path").sortWithinPartitions("token", "rel_path").write.parquet(f"{root}/{name}/postings")
    (spark.createDataFrame([], _GONE) if gone is None else gone.select("rel_path", "path").distinct()).write.parquet(f"{root}/{name}/gone")
    return {"name": name, "rows": entries.count()}


def store(index: r.Index, root: str, extra: dict[str, str] | None = None) -> None:
    """Write an index as a single segment in place of what is there."""
    spark = index.entries.sparkSession
    _point(spark, root, [_write(index, root)], extra)


def _point(spark: SparkSession, root: str, segments: list[dict], extra: dict[str, str] | None = None, after: int | None = None) -> None:
    sinks.point(spark, root, str(segments[-1]["name"]), {"format": str(VERSION), "segments": json.dumps(segments)} | (extra or {}), after)


def segments(spark: SparkSession, root: str) -> list[dict] | None:
    """What the segments are called and how many notes each holds, the oldest first; None without an index of this format."""
    return _named(sinks.pointer(spark, root))


def _named(at: dict[str, str] | None) -> list[dict] | None:
    return None if at is None or at.get("format") != str(VERSION) else json.loads(at["segments"])


def _live(spark: SparkSession, root: str, found: list[dict], table: str) -> DataFrame:
    """The rows of a table of all segments, without those of notes that a later segment has replaced or removed."""
    out, schema = None, spark.read.parquet(f"{root}/{found[0]['name']}/{table}").schema
    for k, segment in enumerate(found):
        rows, later = spark.read.schema(schema).parquet(f"{root}/{segment['name']}/{table}"), [f"{root}/{x['name']}/gone" for x in found[k + 1 :]]
        if later:
            rows = rows.join(spark.read.schema(_GONE).parquet(*later).select("rel_path").distinct(), "rel_path", "left_anti").select(*schema.names)
        out = rows if out is None else out.unionByName(rows)
    return out


def load(spark: SparkSession, root: str) -> r.Index | None:
    """The stored index; None where there is none or one of another format."""
    found = segments(spark, root)
    return None if found is None else r.Index(_live(spark, root, found, "entries"), _live(spark, root, found, "postings"))


def refresh(files: DataFrame, root: str) -> dict[str, int]:
    """Bring a stored index up to the files (path, text, mtime, size): files of the same mtime are taken over unread, those of the same hash
    under their new mtime, others are parsed; files that are gone are removed. What changed is a segment of its own; nothing is written
    if nothing changed. Another refresh that came first is not undone: sinks.Conflict, and this one is to be called again.

    Returns how many files there are of each state.
    """
    spark, at = files.sparkSession, sinks.pointer(files.sparkSession, root)
    found = _named(at)
    if found is None:
        rows = r.with_length(n.candidates(n.parse(files.withColumn("hash", F.sha2("text", 256))), "path", "mtime", "hash"))
        store(r.Index(rows, rows), root)
        count = segments(spark, root)[0]["rows"]
        return {"parsed": count} if count else {}
    old = _live(spark, root, found, "entries")
    # texts are read of files alone whose time is a new one
    known = old.select("path", F.col("mtime").alias("old_mtime"))
    same = files.select("path", "mtime").join(known, "path").where("mtime = old_mtime").select("path")
    now = files.join(same, "path", "left_anti").withColumn("hash", F.sha2("text", 256))
    fresh = scratch(now)
    previous = old.select("path", "rel_path", "mtime", "hash").join(same, "path", "left_anti")
    states = scratch(n.refresh(previous, fresh.select("path", "mtime", "hash")))
    count = {x["state"]: x["count"] for x in states.groupBy("state").count().collect()}
    total = {"reused": kept for kept in [same.count()] if kept} | count
    if not count:
        return total
    parsed = fresh.join(states.where("state = 'parsed'").select("path"), "path", "left_semi")
    rows = r.with_length(n.candidates(n.parse(parsed), "path", "mtime", "hash"))
    kept = old.drop("mtime", "hash").join(states.where("state = 'touched'").select("path", "mtime", "hash"), "path")
    segment = _write(r.Index(rows.unionByName(kept), rows), root, previous.join(states.select("path"), "path", "left_semi"))
    _point(spark, root, _merged(spark, root, [*found, segment]), after=int(at["number"]))
    return total


def _tier(segment: dict) -> int:
    return int(math.log(max(1, segment["rows"]), FANOUT))


def _merged(spark: SparkSession, root: str, found: list[dict]) -> list[dict]:
    """Segments after merging the newest ones as long as FANOUT of them are of one size, or as large as the one before them."""
    while len(found) > 1:
        k = len(found) - 1
        while k > 0 and _tier(found[k - 1]) <= max(_tier(x) for x in found[k:]):
            k -= 1
        if len(found) - k < FANOUT:
            return found
        young = found[k:]
        gone = spark.read.schema(_GONE).parquet(*[f"{root}/{x['name']}/gone" for x in young])
        entries = _live(spark, root, young, "entries")
        found = [*found[:k], _write(r.Index(entries, entries), root, gone if k else None)]
    return found
