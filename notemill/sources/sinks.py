"""Writers: versioned tables swapped by a pointer, appended logs, derived indexes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, browse
from ..schema import ACTIONS, SIGNAL_TYPES


def new_version() -> str:
    return f"v-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Conflict(Exception):
    """Another writer has changed what a commit relies on."""


def claim(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Put a small file in place, whole, unless its name is taken."""
    fs, draft = file_system(spark, f"{folder}/.{uuid.uuid4().hex}")
    _, target = file_system(spark, f"{folder}/{name}")
    jvm = spark.sparkContext._jvm
    fs.mkdirs(draft.getParent())
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a local rename would replace what is there; a link is refused
            local = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
        else:  # refused by the file system if the target exists
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(draft, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        if fs.exists(target):
            return False
        raise e
    finally:
        fs.delete(draft, False)
    return True


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = file_system(spark, f"{root}/_current")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()) if fs.exists(folder) else []


def point(spark: SparkSession, root: str, version: str, facts: dict[str, str] | None = None, after: int | None = None) -> None:
    """Make a version the current one: pointers are small files of ascending numbers. With after, the number of the pointer that was read
    (0 for none), only if it is the newest still; else Conflict."""
    text, last = json.dumps({"version": version} | (facts or {})), max(_pointers(spark, root), default=0)
    while True:
        if after is not None and last != after:
            raise Conflict(f"{root} has changed since it was read")
        if claim(spark, f"{root}/_current", f"{last + 1:012d}", text):
            return
        last += 1


def pointer(spark: SparkSession, root: str) -> dict[str, str] | None:
    """What the newest pointer says, and its number; None without one."""
    numbers = _pointers(spark, root)
    if not numbers:
        return None
    return json.loads(spark.read.text(f"{root}/_current/{numbers[-1]:012d}", wholetext=True).first()[0]) | {"number": str(numbers[-1])}


def replace(df: DataFrame, root: str) -> str:
    """Write a new version of a table, then point to it; readers see the old version or the new one whole."""
    version = new_version()
    df.write.parquet(f"{root}/{version}")
    point(df.sparkSession, root, version)
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{pointer(spark, root)['version']}")


def append_signals(df: DataFrame, path: str) -> None:
    """Append feedback rows of known types; ratings are clamped to 1..10, empty fields omitted."""
    rows = df.where(F.col("type").isin(*SIGNAL_TYPES))
    if "rating" in df.columns:
        rows = rows.withColumn("rating", F.greatest(F.lit(1), F.least(F.lit(10), F.col("rating"))))
    for name, kind in rows.dtypes:
        if kind == "string":
            rows = rows.withColumn(name, F.when(F.col(name) != "", F.col(name)))
    rows.write.mode("append").json(path)


def append_timeline(df: DataFrame, path: str) -> None:
    df.where(F.col("action").isin(*ACTIONS)).write.mode("append").json(path)


def append_events(df: DataFrame, json_path: str, markdown_path: str) -> DataFrame:
    """Append events to both forms of a timeline, the activity type only to the first. Returns the rows that can't be: those of
    an unknown action, or without a path below notes/."""
    good = F.col("action").isin(*ACTIONS) & (F.coalesce("path", F.lit("")).startswith("notes/") | (F.col("action") == "sleep"))
    rows = df.where(good)
    rows.write.mode("append").json(json_path)
    rows.select(F.concat_ws(" | ", "ts", "action", "path", "desc").alias("value")).write.mode("append").text(markdown_path)
    return df.where(~F.coalesce(good, F.lit(False)))


def timeline_markdown(timeline: DataFrame, path: str) -> None:
    timeline.orderBy("ts", "path").select(F.concat_ws(" | ", "ts", "action", "path", "desc").alias("value")).write.mode("overwrite").text(path)


def ensure_jsonl(markdown: DataFrame, path: str) -> int:
    """Make the JSON form of a timeline from its Markdown lines (value, lineno), with the type of each event, if there is none or it has no
    events. Returns how many events were written."""
    spark = markdown.sparkSession
    fs, at = file_system(spark, path)
    if fs.exists(at) and not spark.read.text(path).isEmpty():
        return 0
    events = analytics.parse_timeline(markdown).select("ts", "action", "path", "desc", analytics.event_type(F.col("path")).alias("type"), "lineno")
    events.write.mode("overwrite").json(path)
    return spark.read.text(path).count()


#: Tables that ``derived`` writes.
DERIVED = ("sizes", "tags", "recent", "catalogue", "metrics", "links", "index")


def derived(rows: DataFrame, root: str) -> None:
    """The derived indexes of notes, a JSON table each."""
    sizes = analytics.sizes(rows)
    tables = {
        "sizes": sizes, "tags": rows.select(F.explode(F.array_distinct("tags")).alias("tag"), "rel_path", "title"), "recent": browse.recent(rows).select("rel_path", "title", "updated"),
        "catalogue": analytics.catalogue(rows), "metrics": analytics.metrics(sizes.join(rows.select("rel_path", "scope"), "rel_path"), "scope", "words"),
        "links": analytics.edges(rows), "index": rows.select("type", "rel_path", "title", "updated", "confidence"),
    }
    for name in DERIVED:
        tables[name].write.mode("overwrite").json(f"{root}/{name}")


def by_scope(rows: DataFrame, path: str) -> None:
    """Context profiles, a folder for each scope."""
    rows.write.mode("overwrite").partitionBy("scope").parquet(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Append rows (value) as lines of text, as of an import log."""
    df.select("value").write.mode("append").text(path)


def append_queries(ranked: DataFrame, path: str) -> None:
    """Telemetry of ranked queries: how many results each had, and the best one."""
    ranked.groupBy("query_id").agg(F.count("*").alias("results"), F.min_by("rel_path", "rank").alias("best"), F.max("score").alias("score")).write.mode("append").json(path)


def notes(df: DataFrame, path: str) -> None:
    """Parsed notes, a folder for each type."""
    df.write.mode("overwrite").partitionBy("type").parquet(path)
