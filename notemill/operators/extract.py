"""Rule-based extraction of statements from source notes, import selection, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..schema import DEFAULTS, Settings
from .browse import skipped
from .places import placed

# The wording that marks statements, in English and Norwegian.
VERBS = r"(?iu)(decide|design|investigate|figure out|revisit|plan|define|choose|evaluate|implement|prototype|bestemme|designe|undersøke|finne ut|ta opp igjen|planlegge|definere|velge|evaluere|implementere|prototype)"
DECISION_HEAD = r"(?iuU)^\s*#+\s*(decision|decisions|avgjørelse|avgjørelser|outcome|conclusion)\b"
ACTION_HEAD = r"(?iuU)^\s*#+\s*(next steps|next actions|action items|actions|oppfølging|oppfolging|tiltak)\b"
LINE_RULES = (
    ("pref", 0.92, r"I prefer|I want you to|Going forward|From now on", 0, False),
    ("pref", 0.92, r"Jeg foretrekker|Jeg vil|Fremover|Fra nå av", 0, False),
    ("fact", 0.90, r"Decision:|Decided:|We will|I decided", 4, False),
    ("fact", 0.78, r"We should|We must|We aim to", 4, True),
    ("fact", 0.90, r"Avgjørelse:|Bestemt:|Vi skal|Jeg bestemte", 4, False),
    ("fact", 0.78, r"Vi bør|Vi må|Vi har som mål", 4, True),
)
HEADING_RULES = (
    ("Definition: ", r"Definition|Concept|Framework|Principle|Rule|Guideline|Pattern|Heuristic|Policy"),
    ("Definisjon: ", r"Definisjon|Konsept|Rammeverk|Prinsipp|Regel|Retningslinje|Mønster|Heuristikk|Policy"),
)
SIGNAL_PATTERNS = (
    r"\b(i prefer|i want you to|going forward)\b", r"\b(jeg foretrekker|jeg vil|fremover|fra nå av)\b", r"\b(decided|decision|we will|commit to|rule:)\b",
    r"\b(bestemt|besluttet|avgjort|avjørelse:|vi skal|forplikte|forpliktelse|regel:)\b", r"\b(open question|revisit|not sure yet|need to decide)\b",
    r"\b(åpent spørsmål|ta opp igjen|ikke sikker|må bestemme)\b", r"\b(definition|means:|framework|concept)\b", r"\b(definisjon|betyr:|rammeverk|konsept)\b",
)
LANG_WORDS = {"no": r"(?iuU)\b(og|ikke|jeg|du|vi|skal|med|uten|hvor|hva|hvis)\b", "en": r"(?iuU)\b(and|not|i|you|we|should|with|without|what|if)\b"}
TRIAGE = (
    ("preferences", ("prefer", "always", "never", "style", "habit", "going forward")),
    ("facts", ("decided", "confirmed", "learned", "discovered", "is a", "was a")),
    ("goals", ("goal", "objective", "target", "achieve", "milestone")),
    ("loops", ("todo", "revisit", "unresolved", "blocked", "next step", "investigate")),
    ("concepts", ("concept", "framework", "model", "definition", "pattern")),
)
COMMITS = (
    ("decision", "decide|chose|pick|select|switch|adopt|migrate|replace|introduce|add|create|implement"),
    ("pattern", "pattern|convention|architecture|refactor|redesign|restructure"),
    ("config", "config|setting|env|flag|toggle|enable|disable|option"),
    ("fix", "fix|bug|issue|resolve|patch|hotfix|workaround"),
)
SCOPE_PARTS = (
    ("home", ("01-home", "home")), ("work", ("02-work", "work")), ("dev", ("04-dev", "dev")),
    ("personal", ("03-community", "community", "volunteer", "redcross")), ("meta", ("91-opt", "opt", "meta", "system")),
)
BUCKETS = (("90-journal/archive/", "journal-archive"), ("90-journal/", "journal"), ("02-work/", "work"), ("04-dev/", "dev"), ("01-home/", "home"), ("03-community/", "community"), ("92-archive/", "archive"))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), group)


def signal_score(text: Column) -> Column:
    score = 0.2 * F.size(_all(text, r"(?m)^(#+\s+)")) + 0.1 * F.size(_all(text, r"(?m)^(\s*-\s*\[[ xX]\]\s+)"))
    for p in SIGNAL_PATTERNS:
        score += F.when(text.rlike("(?iuU)" + p), 3.0).otherwise(0.0)
    return score - F.when(t.word_count(text) < 40, 1.0).otherwise(0.0)


def yield_hint(text: Column) -> Column:
    start = r"(?imuU)^(?:-\s*)?({})\b"
    n = lambda p: F.size(_all(text, p))
    pref = n(start.format(LINE_RULES[0][2]))
    decision = n(r"(?imuU)^(?:-\s*)?(Decision:|Decided:|We will|We should|We must|We aim to|I decided|Avgjørelse:|Bestemt:|Vi skal|Vi bør|Vi må|Vi har som mål|Jeg bestemte)\b")
    definition = n(r"(?imuU)^#+\s*((?:" + HEADING_RULES[0][1] + "|" + HEADING_RULES[1][1] + "):)")
    tasks = F.size(F.filter(_all(text, r"(?im)^(?:-\s*)?\[\s*\]\s+(.+)$"), lambda s: s.rlike(VERBS)))
    cap = lambda k, c: F.least(c, F.lit(k))
    return 2.0 * (cap(3, pref) + cap(3, decision) + cap(3, definition)) + 1.5 * cap(2, n("(?m)" + DECISION_HEAD)) + 1.0 * cap(2, n("(?m)" + ACTION_HEAD)) + 1.5 * cap(5, tasks)


def section_items(text: Column, head: str) -> Column:
    """Bullets, tasks and numbered items under headings of one kind."""
    item = r"^\s*(?:[-*+]\s*\[\s*\]|[-*+]|\d+\.)\s+(.+)$"
    fold = F.aggregate(
        t.lines(text),
        F.struct(F.lit(False).alias("on"), t.strings().alias("out")),
        lambda acc, line: F.struct(
            F.when(line.rlike(head), True).when(line.rlike(r"^\s*#+\s+"), False).otherwise(acc["on"]).alias("on"),
            F.when(acc["on"] & ~line.rlike(r"^\s*#+\s+") & line.rlike(item), F.concat(acc["out"], F.array(t.strip(F.regexp_extract(line, item, 1))))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return F.filter(fold["out"], lambda s: s != "")


def all_statements(files: DataFrame) -> DataFrame:
    """path, text, pos, kind, statement, confidence, tag of every statement, private fences left out; pos is by rule, then by place."""
    rows = files.withColumn("text", t.strip_private(F.col("text")))
    item = lambda kind, conf, tag: lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("statement"), F.lit(conf).alias("confidence"), F.lit(tag).alias("tag"))
    n_words = lambda s: F.size(t.words(s))
    found = []

    def matching(heads: str, least: int, modal: bool) -> Column:
        got = F.transform(_all(F.col("text"), rf"(?imuU)^((?:-\s*)?(?:{heads})\s+.+)$"), lambda s: t.strip(F.regexp_replace(s, r"^[- ]+", "")))
        got = F.filter(got, lambda s: n_words(s) >= least)
        return F.filter(got, lambda s: s.rlike(rf"(?iuU)^(?:{heads})\s+\w+\b(?:\s+\w+){{1,}}")) if modal else got

    def headed(before: str, heads: str) -> Column:
        titles = F.filter(F.transform(_all(F.col("text"), rf"(?imuU)^#+\s*(?:{heads}):\s*(.+)$"), t.strip), lambda s: F.length(s) >= 3)
        return F.transform(titles, lambda s: F.concat(F.lit(before), s))

    for kind, conf, heads, least, modal in LINE_RULES:
        found.append(F.transform(matching(heads, least, modal), item(kind, conf, "preference" if kind == "pref" else "decision")))
    for before, heads in HEADING_RULES:
        found.append(F.transform(headed(before, heads), item("concept", 0.82, "concept")))
    found.append(F.transform(F.filter(section_items(F.col("text"), DECISION_HEAD), lambda s: n_words(s) >= 4), item("fact", 0.80, "decision")))
    found.append(F.transform(F.filter(section_items(F.col("text"), ACTION_HEAD), lambda s: (n_words(s) >= 4) | s.rlike(VERBS)), item("loop", 0.75, "open_loop")))
    tasks = F.filter(F.transform(_all(F.col("text"), r"(?im)^(?:-\s*)?\[\s*\]\s+(.+)$"), t.strip), lambda s: (F.length(s) >= 18) & s.rlike(VERBS))
    found.append(F.transform(tasks, item("loop", 0.75, "open_loop")))
    return rows.select("path", "text", F.posexplode(F.concat(*found)).alias("pos", "c")).select("path", "text", "pos", "c.*")


def statements(files: DataFrame) -> DataFrame:
    """Of all statements of a file the first of each kind and wording."""
    first = Window.partitionBy("path", "kind", F.lower("statement")).orderBy("pos")
    return all_statements(files).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def suits_path(path: Column, text: Column, kind: Column, statement: Column) -> Column:
    """Whether a statement counts, given the file it comes from."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    strong = statement.rlike(r"(?iuU)(#openloop|#loop|@loop|@openloop)|\b(20\d{2}-\d{2}-\d{2}|q[1-4]|uke\s?\d{1,2}|week\s?\d{1,2})\b")
    owned = statement.rlike(r"(?iuU)\b(i will|i'll|i should|i need to|we will|we should|we need to|owner|assignee|responsible|jeg skal|jeg vil|jeg må|vi skal|vi må|eier|ansvar|ansvarlig)\b")
    pending = statement.rlike(r"(?iuU)\b(decide|decision|need to decide|open question|pending|tbd|unsure|not sure|to be decided|må bestemme|avgjørelse|åpent spørsmål|uavklart|usikker|ikke sikker|må avklare)\b")
    meeting = p.rlike(r"(?iuU)\b(meeting|meetings|mom|minutes-of-meeting|minutes|møte|mote|samtale|call|check-?in|1-1|1:1|one-on-one|standup|sync|retro|retrospective|status)\b") | text.rlike(
        r"(?imuU)^(#|##)\s*(meeting|mom|minutes of meeting|minutes-of-meeting|minutes|møte|1:1|one-on-one|standup|sync|retro|retrospective|agenda|participants|attendees|deltakere)\b"
    )
    prompt = p.contains("/prompts/") | p.contains("/copilot-custom-prompts/")
    ok = ~prompt | (kind == "concept")
    ok &= ~p.contains("/90-journal/archive/") | (kind != "loop") | strong
    return ok & (~(p.contains("/90-journal/") | meeting) | (kind != "loop") | owned | pending)


def language(text: Column) -> Column:
    no, en = text.rlike(LANG_WORDS["no"]), text.rlike(LANG_WORDS["en"])
    return F.when(no & en, "mixed").when(no, "no").when(en, "en").otherwise("mixed")


def scope_of_path(path: Column) -> Column:
    parts, out = F.split(F.lower(path), "/"), F.lit("personal")
    for scope, names in reversed(SCOPE_PARTS):
        out = F.when(F.arrays_overlap(parts, t.strings(*names)), scope).otherwise(out)
    return out


def bucket(path: Column) -> Column:
    out, p = F.lit("other"), F.regexp_replace(path, r"\\", "/")
    for prefix, name in reversed(BUCKETS):
        out = F.when(p.startswith(prefix), name).otherwise(out)
    return out


def select_files(scan: DataFrame, done: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Changed files (path, hash, size not done), at most the cap of each bucket, then of all, best first."""
    rows = scan.join(done, ["path", "hash", "size"], "left_anti").withColumn("bucket", bucket(F.col("path")))
    keys = [F.desc("yield"), F.desc("mtime"), F.desc("signal"), F.asc("path")]
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("bucket").orderBy(*keys)))
    cap = F.lit(2**31 - 1)
    for name, n in settings.bucket_caps.items():
        cap = F.when(F.col("bucket") == name, n).otherwise(cap)
    return rows.where(F.col("pos") <= cap).orderBy(*keys).limit(settings.import_files)


def vault(rows: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Scored files of a vault outside the folders to skip, with each file's place (pos) among those of its yield, by signal."""
    kept = rows.where(~skipped(F.col("path"), skip)) if skip else rows
    return placed(kept, "yield", [F.desc("signal"), F.col("path").asc()])


def import_key(kind: Column, scope: Column, statement: Column) -> Column:
    return F.sha1(F.concat_ws("|", kind, scope, t.normalise_statement(statement)))


def route(settings: Settings = DEFAULTS) -> Column:
    return F.when(F.col("confidence") >= settings.import_write, "write").when(F.col("confidence") >= settings.import_queue, "queue").otherwise("skip")


def candidate_score() -> Column:
    return F.least(F.lit(1.0), F.col("confidence") + F.least(F.col("signal") / 30, F.lit(0.2)))


def import_cycle(scan: DataFrame, done: DataFrame, known_keys: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One import: select files, extract, filter by path, drop known keys, first of each key, cap, route. scan has text too."""
    chosen = select_files(scan, done, settings)
    keys = [F.desc("yield"), F.desc("mtime"), F.desc("signal"), F.asc("path")]
    order = chosen.withColumn("file_rank", F.row_number().over(Window.orderBy(*keys)))  # at most import_files rows
    found = statements(order.select("path", "text")).join(order.select("path", "file_rank", "signal"), "path")
    found = found.where(suits_path(F.concat(F.lit("/"), F.col("path")), F.col("text"), F.col("kind"), F.col("statement")))
    found = found.withColumn("scope", scope_of_path(F.col("path"))).withColumn("key", import_key(F.col("kind"), F.col("scope"), F.col("statement")))
    found = found.join(known_keys.select("key"), "key", "left_anti")
    first = first_of_key(found, "file_rank", "pos")
    return first.orderBy("file_rank", "pos").limit(settings.import_notes).select("path", "kind", "scope", "statement", "confidence", "key", route(settings).alias("route"), candidate_score().alias("candidate_score"))


def first_of_key(rows: DataFrame, *order: str) -> DataFrame:
    """Of rows with the same key the first by order; equal keys are reduced before they are shuffled."""
    whole = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy("key").agg(F.min_by(whole, F.struct(*order)).alias("r")).select("r.*")


def queue_counts(queue: DataFrame) -> DataFrame:
    """Candidates of a review queue by status."""
    return queue.groupBy("review_status").agg(F.count("*").alias("n"))


def triage(text: Column) -> Column:
    """Suggested type of an inbox item."""
    out, low = F.lit("facts"), F.lower(F.coalesce(text, F.lit("")))
    for kind, marks in reversed(TRIAGE):
        any_mark = F.lit(False)
        for m in marks:
            any_mark |= low.contains(m)
        out = F.when(any_mark, kind).otherwise(out)
    return out


def commit_kind(message: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(COMMITS):
        out = F.when(message.rlike(f"(?i)(?:{pattern})"), kind).otherwise(out)
    return out


def promote(queue: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue with approved rows promoted, newly promoted rows): approved candidates whose key isn't known yet."""
    approved = queue.where("review_status = 'approved'").join(known.select("key"), "key", "left_anti")
    fresh = approved.select("key").distinct().withColumn("fresh", F.lit(True))
    done = F.when((F.col("review_status") == "approved") & F.col("fresh"), "promoted").otherwise(F.col("review_status"))
    return queue.join(fresh, "key", "left").withColumn("review_status", done).drop("fresh"), approved
