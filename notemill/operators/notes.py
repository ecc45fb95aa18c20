"""From raw note files to typed candidates, and the token index over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..schema import TYPE_DIRS
from . import rank


def note_type(path: Column) -> Column:
    out = F.lit("other")
    for folder, kind in TYPE_DIRS.items():
        out = F.when(t.logical_path(path).startswith(f"notes/{folder}/"), kind).otherwise(out)
    return out


def parse(files: DataFrame) -> DataFrame:
    """Typed columns of each note file: front matter, sections, title, privacy stripped from the body."""
    front, body = t.body_and_front(F.col("text"))
    rows = files.withColumns({"front": front, "body": t.strip_private(body)}).withColumn("sections", t.section_lines(F.col("body")))
    value = lambda key: t.front_value(F.col("front"), key)
    kept = [c for c in ("path", "mtime", "hash", "size") if c in files.columns]
    return rows.select(
        *kept, t.logical_path(F.col("path")).alias("rel_path"), note_type(F.col("path")).alias("type"), "text", "body", "sections", "front",
        t.title(F.col("body")).alias("title"), value("created").alias("created"), value("updated").alias("updated"), t.timestamp(value("updated")).alias("updated_ts"),
        t.clamp(F.coalesce(value("confidence").try_cast("double"), F.lit(0.5))).alias("confidence"),
        F.lower(value("source")).alias("source"), F.lower(value("scope")).alias("scope"), F.lower(F.coalesce(value("lang"), F.lit("en"))).alias("lang"), F.lower(value("status")).alias("status"),
        t.normalise_tags(t.front_list(F.col("front"), "tags")).alias("tags"),
    )


def candidates(parsed: DataFrame, *kept: str) -> DataFrame:
    """Ranking rows of parsed notes; columns to keep besides are those of the files."""
    get = lambda name: t.strip(t.section(F.col("sections"), name))
    is_loop, first = F.col("type") == "loop", t.first_content_line(F.col("body"))
    rows = parsed.withColumns({
        "statement": F.when(is_loop, F.when(get("question or task") != "", get("question or task")).otherwise(first)).otherwise(F.when(get("statement") != "", get("statement")).otherwise(first)),
        "status": F.when(is_loop, F.coalesce("status", F.lit("open"))).otherwise(F.lit("")),
        "next_action": F.when(is_loop, F.when(t.first_checkbox(get("next action")) != "", t.first_checkbox(get("next action"))).otherwise(t.first_checkbox(F.col("body")))).otherwise(F.lit("")),
        "has_next_action_checkbox": is_loop & t.has_checkbox(F.col("body")),
        "slug": F.regexp_replace(F.regexp_extract("rel_path", r"([^/]*?)(?:\.md)?$", 1), "[_-]", " "),
    })
    snippet = t.shorten(F.concat_ws(" ", "statement", F.when(F.col("next_action") != "", F.concat(F.lit("Next: "), "next_action"))), 220)
    rows = rows.withColumn("snippet", snippet)
    return rows.select(
        "rel_path", "type", "title", "statement", "body", "updated", "updated_ts", "confidence", "source", "scope", "status", "tags",
        t.tokens(F.concat_ws(" ", "title", "statement", "body", F.array_join("tags", " "), "slug")).alias("note_tokens"),
        t.tokens(F.array_join("tags", " ")).alias("tag_tokens"),
        F.array_sort(F.array_union(t.tokens(F.concat_ws(" ", "title", "statement", "snippet", F.array_join("tags", " "), "scope", "status", "next_action", "slug")), t.link_tokens(F.col("body")))).alias("attention_tokens"),
        "snippet", "next_action", "has_next_action_checkbox", t.word_count(F.col("body")).alias("word_count"), *kept,
    )


def postings(rows: DataFrame, chunk: int = 10_000) -> DataFrame:
    """token, part, paths: inverted index over note and tag tokens (and attention tokens where present).

    The paths of a frequent token are in several parts of about chunk paths each, by their hash.
    """
    sets = [F.col(c) for c in ("note_tokens", "tag_tokens", "attention_tokens") if c in rows.columns]
    all_tokens = sets[0]
    for s in sets[1:]:
        all_tokens = F.array_union(all_tokens, s)
    held = rows.select(F.explode(all_tokens).alias("token"), "rel_path")
    frequent = held.groupBy("token").agg(F.ceil(F.count("*") / chunk).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("rel_path"), F.coalesce("parts", F.lit(1)))
    return held.join(frequent, "token", "left").withColumn("part", part).groupBy("token", "part").agg(F.sort_array(F.collect_set("rel_path")).alias("paths"))


def index_pool(queries: DataFrame, index: rank.Index, minimum: int = 24) -> DataFrame:
    """query_id, rel_path, matched: notes that share a token or the scope, padded with the newest others up to minimum; all
    notes, unmatched, where none does."""
    return rank.members(queries, index, "index", minimum)


def refresh(previous: DataFrame, files: DataFrame) -> DataFrame:
    """How each file of a snapshot (path, mtime, hash) stands to the index: reused, touched, parsed; removed if it is gone."""
    old = previous.select("path", F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"))
    state = (
        F.when(F.col("mtime").isNull(), "removed").when(F.col("old_mtime").isNull(), "parsed")
        .when(F.col("mtime") == F.col("old_mtime"), "reused").when(F.col("hash") == F.col("old_hash"), "touched").otherwise("parsed")
    )
    return files.join(old, "path", "full_outer").select("path", "mtime", "hash", state.alias("state"))
