"""Text of notes: front matter in and out, canonical and candidate notes, edits, promotion from the inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import browse

#: Scalars that must be quoted. Then the wording of imported notes, our own.
RESERVED = ("yes", "no", "true", "false", "null", "~")
CONTEXT = "Imported from a source note."
STEPS = ("- [ ] Clarify and execute this loop", "- [ ] Outcome captured in a note")
FOLDERS = {"loop": "05_open_loops", "fact": "02_facts", "pref": "03_preferences", "goal": "04_goals", "concept": "06_concepts"}


def scalar_kind(value: Column) -> Column:
    """list, null, bool, int, float or str: what an unquoted front-matter scalar is read as."""
    of = lambda v: (
        F.when((v == "") | F.lower(v).isin("null", "~"), "null").when(F.lower(v).isin("true", "false"), "bool")
        .when(v.rlike(r"^[+-]?\d+(_\d+)*+$"), "int").when(v.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), "float").otherwise("str")
    )
    return F.when(t.strip(value).rlike(r"(?s)^\[.*\]$"), "list").otherwise(t.once(t.unquote(value), of))


def scalar(value: Column) -> Column:
    """A string as a front-matter scalar, JSON-quoted where it could be read as something else."""
    quoted = F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
    return F.when(value == "", '""').when(F.lower(value).isin(*RESERVED), quoted).when(value.rlike("^[A-Za-z0-9_./:-]+$"), value).otherwise(quoted)


def front_matter(**fields: Column) -> Column:
    """A block of front matter; array columns are written as lists, null fields are left out."""
    lines = []
    for key, (value, is_list) in fields.items():
        shown = F.concat(F.lit("["), F.array_join(F.transform(value, scalar), ", "), F.lit("]")) if is_list else scalar(value.cast("string"))
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), shown)))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---"))


def with_defaults(rows: DataFrame, now: Column) -> DataFrame:
    """Front matter of parsed notes as a structured record has it: unknown sources, scopes and statuses take a default, bad times are now."""
    one_of = lambda c, values, default: F.when(F.lower(F.coalesce(c, F.lit(""))).isin(*values), F.lower(c)).otherwise(default)
    return rows.select(
        "rel_path", F.coalesce("updated_ts", now).alias("updated_ts"), one_of(F.col("source"), ("user", "tool", "assistant", "inferred"), "assistant").alias("source"),
        one_of(F.col("scope"), ("home", "work", "dev", "personal", "meta"), "personal").alias("scope"), t.clamp(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.when(F.col("status").isNotNull(), one_of(F.col("status"), ("open", "closed", "blocked", "snoozed"), "open")).alias("status"),
    )


def parts(parsed: DataFrame) -> DataFrame:
    """The sections that loops and other notes are made of; a loop's next action is its first check box, else the section's first line."""
    get = lambda name: t.strip(t.section(F.col("sections"), name))
    loop, action = F.col("type") == "loop", get("next action")
    first = F.when(t.first_checkbox(action) != "", t.first_checkbox(action)).otherwise(t.first_content_line(action))
    only = lambda cond, c: F.when(cond, c).otherwise("")
    return parsed.select(
        "rel_path", "type", "title", only(loop, get("question or task")).alias("question"), only(loop, get("why it matters")).alias("why"), only(loop, first).alias("next_action"),
        only(~loop, get("statement")).alias("statement"), only(~loop, get("context")).alias("context"), only(~loop, get("implications")).alias("implications"),
    )


def canonical(candidates: DataFrame, taken: DataFrame, stamp: Column) -> DataFrame:
    """path, text of the note that each candidate (kind, statement, confidence, tags, scope, lang, origin) becomes.

    The name is the statement's slug; where a note of that name is among the taken paths, or an earlier candidate has it, a
    hash of the statement follows.
    """
    kind, folder = F.col("kind"), F.lit(None).cast("string")
    for name, where in FOLDERS.items():
        folder = F.when(kind == name, where).otherwise(folder)
    base = F.concat(F.lit("notes/"), folder, F.lit("/"), kind, F.lit("__"), t.slug(F.col("statement")))
    rows = candidates.withColumn("base", base)
    held = taken.select(F.regexp_replace("path", r"\.md$", "").alias("base")).distinct().withColumn("held", F.lit(True))
    order = Window.partitionBy("base").orderBy("statement", "origin")
    rows = rows.join(held, "base", "left").withColumn("n", F.row_number().over(order))
    mark = F.substring(F.sha1(F.concat_ws("|", kind, F.col("statement"), stamp, F.col("origin"))), 1, 6)
    path = F.when(F.col("held") | (F.col("n") > 1), F.concat(F.col("base"), F.lit("__"), mark)).otherwise(F.col("base"))
    provenance = F.concat(F.lit("## Provenance\nOrigin: "), F.col("origin"), F.lit("\nImported: "), stamp, F.lit("\n\n## Links\n- "))
    loop = F.concat(
        F.lit("# Loop: "), F.col("statement"), F.lit("\n\n## Question or Task\n"), F.col("statement"),
        F.lit(f"\n\n## Context\n{CONTEXT}\n\n## Next Action\n{STEPS[0]}\n\n## Exit Condition\n{STEPS[1]}\n\n"), provenance,
    )
    other = F.concat(F.lit("# "), F.col("statement"), F.lit("\n\n## Statement\n"), F.col("statement"), F.lit(f"\n\n## Context\n{CONTEXT}\n\n"), provenance)
    front = front_matter(
        created=(stamp, False), updated=(stamp, False), tags=(F.col("tags"), True), confidence=(F.round("confidence", 2), False), source=(F.lit("inferred"), False),
        scope=(F.col("scope"), False), lang=(F.col("lang"), False), status=(F.when(kind == "loop", "open"), False),
    )
    return rows.select(F.concat(path, F.lit(".md")).alias("path"), F.concat(front, F.lit("\n\n"), F.when(kind == "loop", loop).otherwise(other)).alias("text"))


def set_front(text: Column, key: str, value: Column) -> Column:
    """Text with a front-matter field set: changed in place, or added as the last one. Text without front matter stays as it is."""
    front, body = t.body_and_front(text)
    line = F.concat(F.lit(f"{key}: "), scalar(value))
    changed = F.when(front.rlike(f"(?m)^{key}:"), F.regexp_replace(front, F.lit(f"(?m)^{key}:.*$"), F.regexp_replace(line, r"([\\$])", r"\\$1"))).otherwise(F.concat(front, line, F.lit("\n")))
    return F.when(front.isNull(), text).otherwise(F.concat(F.lit("---\n"), changed, F.lit("---\n"), body))


def add_section(text: Column, name: str, content: Column) -> Column:
    """Text with a section more, before the links if it has such a section, else at its end."""
    made = F.concat(F.lit(f"\n## {name}\n"), content, F.lit("\n"))
    return F.when(text.contains("## Links"), F.replace(text, F.lit("## Links"), F.concat(made, F.lit("## Links")))).otherwise(F.concat(F.regexp_replace(text, r"\s+$", ""), made))


def add_checkbox(text: Column, section: str, label: Column) -> Column:
    """Text with an open check box after the last line of a section; without that section it stays as it is."""
    lines = F.split(text, "\n")
    header = F.array_position(F.transform(lines, F.trim), f"## {section}").cast("int")
    after = F.slice(lines, header + 1, F.greatest(F.size(lines) - header, F.lit(0)))
    following = F.array_position(F.transform(after, lambda x: x.startswith("## ")), True).cast("int")
    stop = F.when(following > 0, header + following - 1).otherwise(F.when(F.element_at(lines, -1) == "", F.size(lines) - 1).otherwise(F.size(lines)))
    grown = F.concat(F.slice(lines, 1, stop), F.array(F.concat(F.lit("- [ ] "), label)), F.slice(lines, stop + 1, F.greatest(F.size(lines) - stop, F.lit(0))))
    return F.when(header > 0, F.array_join(grown, "\n")).otherwise(text)


def promoted(inbox: DataFrame, stamp: Column) -> tuple[DataFrame, DataFrame]:
    """(notes, events): files of an inbox (path, text, kind) under their type's folder and prefix, and the timeline's rows of that."""
    target = F.concat(F.lit("notes/"), browse.folder_of(F.col("kind")), F.lit("/"), F.col("kind"), F.lit("__"), t.slug(browse.stem(F.col("path"))), F.lit(".md"))
    rows = inbox.withColumn("target", target)
    events = rows.select(stamp.alias("ts"), F.lit("created").alias("action"), F.col("target").alias("path"), F.concat(F.lit("promoted from inbox: "), F.regexp_extract("path", "([^/]*)$", 1)).alias("desc"))
    return rows.select(F.col("target").alias("path"), "text"), events


def edited_events(paths: DataFrame, stamp: Column, what: str) -> DataFrame:
    """Timeline rows of an edit."""
    return paths.select(stamp.alias("ts"), F.lit("updated").alias("action"), "path", F.lit(what).alias("desc"))


def preview(candidates: DataFrame, taken: DataFrame, stamp: Column) -> DataFrame:
    """The paths that notes would be written to."""
    return canonical(candidates, taken, stamp).select("path")


def voice_note(profiles: DataFrame, existing: DataFrame, stamp: Column) -> DataFrame:
    """path, text of the note that holds a voice profile (path, profile: JSON); a note that is there keeps the time it was created."""
    front, _ = t.body_and_front(F.col("text"))
    held = existing.select("path", t.front_value(front, "created").alias("held"))
    rows = profiles.join(held, "path", "left")
    head = front_matter(created=(F.coalesce("held", stamp), False), updated=(stamp, False), tags=(t.strings("voice"), True), source=(F.lit("user"), False), scope=(F.lit("meta"), False), lang=(F.lit("en"), False))
    return rows.select("path", F.concat(head, F.lit("\n\n# Voice\n\n## Statement\n```json\n"), F.col("profile"), F.lit("\n```\n")).alias("text"))


def session_note(commits: DataFrame, stamp: Column) -> DataFrame:
    """path, text of an inbox note for each session (session, kind, message, pos): its commits that have a kind, in order."""
    lines = commits.where(F.col("kind").isNotNull()).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("pos", F.concat(F.lit("- "), "kind", F.lit(": "), "message").alias("line")))).alias("l"))
    head = front_matter(created=(stamp, False), tags=(t.strings("session"), True), source=(F.lit("tool"), False))
    return lines.select(
        F.concat(F.lit("notes/00_inbox/session_"), "session", F.lit(".md")).alias("path"),
        F.concat(head, F.lit("\n\n# Session "), F.col("session"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"),
    )
