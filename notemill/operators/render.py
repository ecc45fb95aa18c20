"""Lines of text for people: listings, ranked results, briefings, A/B reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def listing(width: int = 60) -> Column:
    """One note: title, status of loops, confidence where it is low."""
    status = F.when((F.col("type") == "loop") & (F.col("status") != ""), F.concat(F.lit(" ["), "status", F.lit("]"))).otherwise("")
    low = F.when(F.col("confidence") < 0.7, F.format_string(" (confidence %.2f)", "confidence")).otherwise("")
    return F.concat(F.lit("- "), t.shorten(F.col("title"), width), status, low)


def compact(width: int = 100, show_path: bool = False) -> Column:
    """One note with what it says: a loop's status, question and next action, another note's title and statement; shortened to width."""
    or_else = lambda c, word: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(word)
    day = F.when(F.coalesce("updated", F.lit("")) != "", F.element_at(F.split("updated", "T"), 1)).otherwise("unknown")
    low = F.when(F.col("confidence") < 0.7, F.concat(F.lit(" conf "), F.regexp_replace(F.format_string("%.2f", "confidence"), r"\.?0+$", ""))).otherwise("")
    head = F.when(F.col("type") == "loop", F.concat(or_else("status", "?"), F.lit(" | "), or_else("question", "untitled"), F.lit(" - next: "), or_else("next_action", "none")))
    line = F.concat(head.otherwise(F.concat(or_else("title", "untitled"), F.lit(" - "), or_else("statement", "no summary"))), F.lit(" (updated "), day, low, F.lit(")"))
    return t.shorten(F.concat(line, F.lit(" ["), F.col("rel_path"), F.lit("]")) if show_path else line, width)


def detail() -> Column:
    """Lines of one note in full: where it is, how sure and whose it is, and its sections (of compose.parts)."""
    some = lambda title, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"\n{title}:\n  "), F.col(c)))
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("none")
    return F.concat_ws(
        "\n", F.concat(F.lit("Path: "), "rel_path"), F.concat(F.lit("Updated: "), F.coalesce("updated", F.lit("unknown"))), F.concat(F.lit("Confidence: "), F.col("confidence"), F.lit(" (source: "), F.coalesce("source", F.lit("unknown")), F.lit(")")),
        F.concat(F.lit("Scope: "), F.coalesce("scope", F.lit("unknown")), F.lit(" (tags: "), tags, F.lit(")")), F.when(F.col("type") == "loop", F.concat(F.lit("Status: "), "status")),
        some("Question or task", "question"), some("Why it matters", "why"), some("Next action", "next_action"), some("Statement", "statement"), some("Context", "context"), some("Implications", "implications"),
    )


def result() -> Column:
    """One ranked note."""
    return F.format_string("%d. %s %.3f %s", F.col("rank").cast("int"), F.col("rel_path"), F.col("score"), F.col("type"))


def briefing(stale: DataFrame) -> DataFrame:
    """Lines of active loops, stalest first (analytics.staleness)."""
    band = F.when(F.col("band") != "", F.concat(F.lit(" **["), "band", F.lit("]**"))).otherwise("")
    blocked = F.when(F.col("status") == "blocked", " [blocked]").otherwise("")
    line = F.concat(F.lit("- "), "title", blocked, band, F.lit(" ("), "days", F.lit("d ago)"))
    return stale.select("rel_path", "days", line.alias("line"))


def report(metrics: DataFrame, name: str = "metric") -> DataFrame:
    """Markdown table rows of (metric, base, new)."""
    return metrics.select(F.format_string("| %s | %.4f | %.4f | %+.4f |", F.col(name), F.col("base"), F.col("new"), F.col("new") - F.col("base")).alias("line"))
