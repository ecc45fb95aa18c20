"""Listings and look-ups: typed reads, inbox, stems, recent events, groupings, tree filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..schema import TYPE_DIRS
from .places import placed

#: Prefixes of file names by type, and the words that sort a tree.
PREFIXES = {"id__": "id", "fact__": "fact", "pref__": "pref", "goal__": "goal", "loop__": "loop", "concept__": "concept"}
SORTS = ("updated", "title", "confidence", "type")


def newest(*before: Column) -> list[Column]:
    """Order of listings: the given columns, then newest first."""
    return [*before, F.desc("updated"), F.desc("rel_path")]


def typed(notes: DataFrame, kind: str = "all", loop_status: str | None = None) -> DataFrame:
    """Notes of one type or of all, loops without a status counting as open; of one status, if given, where they are loops."""
    rows = notes.withColumn("status", F.when(F.col("type") == "loop", F.when(F.coalesce("status", F.lit("")) == "", "open").otherwise(F.col("status"))).otherwise(F.lit("")))
    rows = rows if kind == "all" else rows.where(F.col("type") == kind)
    return rows if loop_status in (None, "all") else rows.where((F.col("type") != "loop") | (F.col("status") == loop_status))


def listing(notes: DataFrame, kind: str = "all", loop_status: str | None = None, limit: int | None = None) -> DataFrame:
    """A typed read with each note's place (pos), newest first within its type; a limit holds for each type."""
    rows = typed(notes, kind, loop_status)
    if limit is None:
        return placed(rows, "type", newest())
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("type").orderBy(*newest()))).where(F.col("pos") <= limit)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def inbox(files: DataFrame) -> DataFrame:
    """path, title of the files of an inbox: the first heading, else the file's stem."""
    found = t.title(F.col("text"))
    return files.select("path", F.when(found != "", found).otherwise(stem(F.col("path"))).alias("title"))


def type_of_name(path: Column) -> Column:
    """Type by the prefix of a file's name; concepts have any other."""
    name, out = F.regexp_extract(path, "([^/]*)$", 1), F.lit("concept")
    for prefix, kind in PREFIXES.items():
        out = F.when(name.startswith(prefix), kind).otherwise(out)
    return out


def links_by_stem(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """src, rel_path of links whose target has the stem of a note."""
    targets = edges.select("src", stem(F.col("dst")).alias("stem")).distinct()
    return targets.join(notes.select("rel_path", stem(F.col("rel_path")).alias("stem")), "stem").select("src", "rel_path")


def panel(edges: DataFrame, node: str) -> DataFrame:
    """Links of one note in both directions."""
    return edges.where((F.col("src") == node) | (F.col("dst") == node)).select("src", "dst", (F.col("src") == node).alias("outgoing"))


def containing(notes: DataFrame, text: str, scope: str = "all") -> DataFrame:
    """Notes of a scope whose title, body or tags contain the text, in any case."""
    held = F.lower(F.concat_ws(" ", "title", "body", F.array_join("tags", " ")))
    rows = notes if scope == "all" else notes.where(F.col("scope") == scope)
    return rows.where(held.contains(text.lower()))


def tree(notes: DataFrame, scopes: tuple[str, ...] = (), tag: str | None = None, text: str = "", sort: str = "updated") -> DataFrame:
    """Notes of the scopes with the tag and the text, and their place (pos) within the type by one of SORTS."""
    rows = notes.where(F.col("scope").isin(*scopes)) if scopes else notes
    rows = rows.where(F.array_contains("tags", tag)) if tag else rows
    rows = containing(rows, text) if text else rows
    first = {"updated": [], "title": [F.lower("title")], "confidence": [F.desc("confidence")], "type": [F.col("type")]}[sort]
    return placed(rows, "type", newest(*first))


def groupings(notes: DataFrame) -> DataFrame:
    """kind (tag, scope, type), value and number of notes."""
    of = lambda kind, c: notes.select("rel_path", c.alias("value")).groupBy("value").agg(F.count_distinct("rel_path").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return of("tag", F.explode("tags")).unionByName(of("scope", F.col("scope"))).unionByName(of("type", F.col("type")))


def scope_histogram(files: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    """Number of files of each scope, 0 where there is none."""
    known = files.sparkSession.createDataFrame([(s,) for s in scopes], "scope string")
    return known.join(files.groupBy("scope").agg(F.count("*").alias("n")), "scope", "left").na.fill(0, ["n"])


def recent(notes: DataFrame, most: int = 30) -> DataFrame:
    return notes.orderBy(*newest()).limit(most)


def largest(sizes: DataFrame, most: int = 10) -> DataFrame:
    return sizes.orderBy(F.desc("words"), F.desc("rel_path")).limit(most)


def tracked(path: Column) -> Column:
    """Whether a logical path is a note whose changes are followed."""
    p = F.regexp_replace(F.trim(path), r"^[./]+", "")
    return p.startswith("notes/") & p.endswith(".md") & ~F.concat(F.lit("/"), p).rlike("/(08_indices|templates)/")


def skipped(path: Column, folders: tuple[str, ...]) -> Column:
    """Whether some folder of the path is among those to leave out, in any case."""
    return F.arrays_overlap(F.split(F.lower(path), "/"), t.strings(*[f.lower() for f in folders]))


def equal_paths(expected: Column) -> Column:
    """The forms in which an expected path may stand in results: as given, with plain slashes, from notes/ on."""
    plain = F.regexp_replace(F.trim(expected), r"\\", "/")
    below = F.when(plain.startswith("notes/"), plain).otherwise(F.when(F.regexp_extract(plain, "/notes/(.+)$", 1) != "", F.concat(F.lit("notes/"), F.regexp_replace(F.regexp_extract(plain, "/notes/(.+)$", 1), "^/+", ""))))
    return F.array_sort(F.array_distinct(F.filter(F.array(F.trim(expected), plain, below), lambda x: x.isNotNull() & (x != ""))))


def folder_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for folder, name in TYPE_DIRS.items():
        out = F.when(kind == name, folder).otherwise(out)
    return out


def by_stem(notes: DataFrame, stems: DataFrame) -> DataFrame:
    """stem, rel_path of the notes whose file has one of the stems; the first by path where several do."""
    found = notes.select("rel_path", stem(F.col("rel_path")).alias("stem")).join(stems.select("stem").distinct(), "stem")
    return found.groupBy("stem").agg(F.min("rel_path").alias("rel_path"))


#: Saved views of a vault: names and the notes that each shows.
VIEWS = {
    "open_loops": "type = 'loop' AND status IN ('open', 'blocked')", "low_confidence": "confidence < 0.7", "inferred": "source = 'inferred'", "recent": "updated_ts >= now() - INTERVAL 7 DAYS",
}


def saved_views(notes: DataFrame, prefix: str = "") -> list[str]:
    """Make the saved views temporary views of the session, and give their names."""
    for name, shown in VIEWS.items():
        notes.where(shown).createOrReplaceTempView(prefix + name)
    return [prefix + name for name in VIEWS]
