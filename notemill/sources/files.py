"""Readers of note trees, logs and state, all as DataFrames with fixed schemas."""

from __future__ import annotations

import json
import os
import re
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ACTIONS, SIGNAL, TIMELINE, TYPE_DIRS, Settings


def notes(spark: SparkSession, root: str, folders: tuple[str, ...] = tuple(TYPE_DIRS)) -> DataFrame:
    """Markdown files directly in those of the type folders that exist: path, text, mtime, size."""
    return _files(spark, [root + "/{" + ",".join(folders) + "}"], False)


def tree(spark: SparkSession, root: str, skip: tuple[str, ...] = ("08_indices", "templates")) -> DataFrame:
    """Markdown files at any depth, but for hidden parts and the folders to skip."""
    parts = F.split(F.regexp_replace("path", "^.*?:/*", "/"), "/")
    rows = _files(spark, [root], True)
    below = F.split(F.substring_index("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "/")
    return rows.where(~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in skip])) & ~F.exists(below, lambda p: p.startswith(".")))


def _files(spark: SparkSession, paths: list[str], deep: bool) -> DataFrame:
    rows = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", deep).load(paths)
    m = F.col("_metadata")
    return rows.select(m["file_path"].alias("path"), F.col("value").alias("text"), m["file_modification_time"].alias("mtime"), m["file_size"].alias("size"))


def snapshot(files: DataFrame) -> DataFrame:
    """path, hash, mtime, size of each file."""
    return files.select("path", F.sha2("text", 256).alias("hash"), "mtime", "size")


def signals(spark: SparkSession, path: str, kind: str | None = None, since: str | None = None) -> DataFrame:
    """Feedback log; bad lines are left out, since is exclusive."""
    rows = spark.read.schema(SIGNAL).option("mode", "DROPMALFORMED").json(path)
    rows = rows.where(F.col("type") == kind) if kind else rows
    return rows.where(F.col("ts") > since) if since else rows


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """Event log; bad lines and rows without time or action are left out."""
    return spark.read.schema(TIMELINE).option("mode", "DROPMALFORMED").json(path).where("ts IS NOT NULL AND action IS NOT NULL")


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias, pos, phrase from a JSON object of lists; keys lower-cased, blank phrases dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    rows = raw.select(F.explode("m").alias("alias", "phrases")).select(F.lower(F.trim("alias")).alias("alias"), F.posexplode("phrases").alias("pos", "phrase"))
    return rows.where(F.trim("phrase") != "")


def eval_cases(spark: SparkSession, text: str) -> DataFrame:
    """query_id, query, query_scope, expected from a small YAML list; the text is tiny and parsed on the driver."""
    rows: list[list] = []
    for line in text.splitlines():
        stripped = line.strip()
        if not stripped or stripped.startswith("#"):
            continue
        if m := re.match(r"-\s+id:\s*(.+)$", stripped):
            rows.append([m[1].strip("\"' "), "", "all", []])
        elif rows and (m := re.match(r"(query|scope):\s*(.*)$", stripped)):
            rows[-1][1 if m[1] == "query" else 2] = m[2].strip("\"' ")
        elif rows and stripped.startswith("- "):
            rows[-1][3].append(stripped[2:].strip("\"' "))
    return spark.createDataFrame([tuple(r) for r in rows], "query_id string, query string, query_scope string, expected array<string>")


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored state table, empty where there is none yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).parquet(path) if p.getFileSystem(conf).exists(p) else spark.createDataFrame([], schema)


def voice_profile(files: DataFrame) -> DataFrame:
    """First fenced json block of each note as a variant, whose values may be nested (variant_get); null if it isn't a JSON object."""
    block = F.regexp_extract("text", r"(?s)```json\s*(.*?)```", 1)
    found = F.try_parse_json(F.when(F.ltrim(block).startswith("{"), block))
    return files.select("path", found.alias("profile"))


def settings(overrides: dict | None = None, path: str | None = None, prefix: str = "NOTEMILL_") -> Settings:
    """Defaults, then a JSON file, then environment variables, then overrides."""
    out, kinds = Settings(), {f.name: f.type for f in fields(Settings)}
    given: dict = {}
    if path and os.path.isfile(path):
        with open(path) as handle:
            given |= json.load(handle)
    given |= {k.removeprefix(prefix).lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
    given |= overrides or {}
    for k, v in given.items():
        if k in kinds and not isinstance(getattr(out, k), dict):
            out = replace(out, **{k: type(getattr(out, k))(v)})
    return out


def valid_actions(timeline: DataFrame) -> DataFrame:
    return timeline.where(F.col("action").isin(*ACTIONS))
