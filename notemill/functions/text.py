"""Column functions over Markdown and plain text; all of them stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SECTION_ALIASES, STOPWORDS


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Sorted set of lower-case ASCII alphanumeric tokens without stopwords."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.sort_array(F.array_except(parts, strings("", *STOPWORDS)))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normalise_statement(text: Column) -> Column:
    return F.lower(collapse(text))


def slug(text: Column, longest: int = 80) -> Column:
    s = F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), "['`\"]+", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    s = F.regexp_replace(F.substring(s, 1, longest), "^_+|_+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def shorten(text: Column, width: int, mark: str = "...") -> Column:
    """Cut at a word so that text and mark fit the width; white space is collapsed first."""
    flat = collapse(text)
    fold = F.aggregate(
        F.split(F.substring(flat, 1, width + 1), " "),  # a word that ends later doesn't fit, whole or cut
        F.struct(F.lit("").alias("s"), F.lit(False).alias("full")),
        lambda acc, w: F.struct(
            F.when(~acc["full"] & (F.length(acc["s"]) + F.when(acc["s"] == "", 0).otherwise(1) + F.length(w) + len(mark) <= width), F.when(acc["s"] == "", w).otherwise(F.concat(acc["s"], F.lit(" "), w)))
            .otherwise(acc["s"]).alias("s"),
            (acc["full"] | (F.length(acc["s"]) + F.when(acc["s"] == "", 0).otherwise(1) + F.length(w) + len(mark) > width)).alias("full"),
        ),
    )["s"]
    cut = F.concat(fold, F.lit(mark))
    return F.when(F.length(flat) <= width, flat).otherwise(F.when(F.length(cut) <= width, cut).otherwise(F.lit("")))


def strip_private(text: Column) -> Column:
    """Remove <private> fences: nested ones whole, an unclosed one to the end; a stray close stays."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)(</?private>)", "\x01$1\x01")
    fold = F.aggregate(
        F.split(marked, "\x01"),
        F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")),
        lambda acc, part: F.struct(
            F.when(F.lower(part) == "<private>", acc["depth"] + 1).when((F.lower(part) == "</private>") & (acc["depth"] > 0), acc["depth"] - 1).otherwise(acc["depth"]).alias("depth"),
            F.when((acc["depth"] > 0) | (F.lower(part) == "<private>"), acc["out"]).otherwise(F.concat(acc["out"], part)).alias("out"),
        ),
    )
    return fold["out"]


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def body_and_front(text: Column) -> tuple[Column, Column]:
    """(front matter block or null, body); an unclosed block is body."""
    pattern = r"(?s)\A---[ \t]*\r?\n(.*?)(?:(?<=\n)|\A)---[ \t]*(?:\r?\n|\z)(.*)\z"
    has = F.coalesce(text, F.lit("")).rlike(pattern)
    return F.when(has, F.regexp_extract(text, pattern, 1)), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(F.coalesce(text, F.lit("")))


#: A string in double quotes. The possessive loop takes no stack of a text of any length, as a plain one over alternatives does.
QUOTED = r'"(?:[^"\\]|\\.)*+"'


def without_comment(value: Column) -> Column:
    """A scalar, stripped, without the comment after it if it is quoted."""
    return F.regexp_replace(strip(value), rf"(?s)^({QUOTED}|'[^']*')\s+#.*$", "$1")


def unquote(value: Column) -> Column:
    inner = lambda v: F.when(v.rlike('(?s)^".*"$') | v.rlike("(?s)^'.*'$"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(strip(F.regexp_replace(v, r"(?s)(^|\s)#.*$", "")))
    return once(without_comment(value), inner)


def front_value(front: Column, key: str) -> Column:
    """Scalar of a known key, unquoted, null where the key is missing or empty."""
    v = unquote(F.regexp_extract(F.coalesce(front, F.lit("")), rf"(?m)^{key}:[ \t]*(.*?)[ \t]*\r?$", 1))
    return F.when(v != "", v)


def front_list(front: Column, key: str) -> Column:
    """List of a known key, in flow or block form, or a scalar as a list of one."""
    front = F.coalesce(front, F.lit(""))
    flow = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\[(.*)\]", 1)
    block = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\r?\n|\z))+)", 1)
    items = F.when(flow != "", F.split(flow, ",")).when(block != "", F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t]*$"), 1)).otherwise(F.filter(F.array(front_value(front, key)), lambda x: x.isNotNull() & ~x.startswith("[")))
    return F.filter(F.transform(items, unquote), lambda x: x != "")


def normalise_tags(tags: Column) -> Column:
    """Lower-cased, split at commas, in order of first occurrence."""
    parts = F.flatten(F.transform(F.coalesce(tags, strings()), lambda t: F.split(F.regexp_replace(F.lower(t), r"[\[\]\"']", ""), ",")))
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda t: t != ""))


def timestamp(value: Column) -> Column:
    """Strict YYYY-MM-DDTHH:MM:SSZ, else null."""
    strict = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), value)
    return F.try_to_timestamp(strict, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def section_name(header: Column) -> Column:
    name = strip(F.regexp_replace(F.lower(header), "[^a-z0-9]+", " "))
    out = name
    for alias, canonical in SECTION_ALIASES.items():
        out = F.when(name == alias, F.lit(canonical)).otherwise(out)
    return out


def section_lines(body: Column) -> Column:
    """Array of (name, line) of every line under a ## or ### header; repeated headers continue."""
    fold = F.aggregate(
        lines(body),
        F.struct(F.lit(None).cast("string").alias("name"), F.array().cast("array<struct<name:string,line:string>>").alias("out")),
        lambda acc, line: F.struct(
            F.when(line.startswith("## "), section_name(F.substring(line, 4, 100000))).when(line.startswith("### "), section_name(F.substring(line, 5, 100000))).otherwise(acc["name"]).alias("name"),
            F.when(line.startswith("## ") | line.startswith("### ") | acc["name"].isNull(), acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.struct(acc["name"].alias("name"), line.alias("line"))))).alias("out"),
        ),
    )
    return fold["out"]


def section(of: Column, name: str) -> Column:
    """Text of one section from section_lines()."""
    return F.array_join(F.transform(F.filter(of, lambda x: x["name"] == name), lambda x: x["line"]), "\n")


def title(body: Column) -> Column:
    t = strip(F.regexp_extract(F.coalesce(body, F.lit("")), r"(?m)^# (.*)$", 1))
    return strip(F.regexp_replace(t, "(?i)^loop:", ""))


def first_content_line(body: Column) -> Column:
    kept = F.filter(F.transform(F.filter(lines(body), lambda x: ~x.startswith("#")), strip), lambda x: x != "")
    first = F.coalesce(F.get(kept, F.lit(0)), F.lit(""))
    return F.when(first.startswith("- "), strip(F.substring(first, 3, 100000))).otherwise(first)


def first_checkbox(text: Column) -> Column:
    return strip(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^\s*-\s*\[[ xX]\][ \t]+(.*)$", 1))


def has_checkbox(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?m)^\s*-\s*\[[ xX]\]\s+")


def links(body: Column) -> Column:
    """Array of (line, target, display, wiki): by line, wiki links first."""
    def on(line: Column, i: Column) -> Column:
        wiki = F.transform(F.regexp_extract_all(line, F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda x: F.struct(
            (i + 1).alias("line"), strip(F.element_at(F.split(x, r"\|"), 1)).alias("target"), strip(F.element_at(F.split(x, r"\|"), -1)).alias("display"), F.lit(True).alias("wiki")))
        plain = F.zip_with(F.regexp_extract_all(line, F.lit(r"\[([^\]]+)\]\(([^)]+\.md)\)"), 2), F.regexp_extract_all(line, F.lit(r"\[([^\]]+)\]\(([^)]+\.md)\)"), 1), lambda u, d: F.struct(
            (i + 1).alias("line"), strip(u).alias("target"), strip(d).alias("display"), F.lit(False).alias("wiki")))
        return F.concat(wiki, plain)
    return F.flatten(F.transform(lines(body), on))


def link_tokens(body: Column) -> Column:
    """Tokens of link targets and wiki displays."""
    text = F.coalesce(body, F.lit(""))
    urls = F.transform(F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]\(([^)]+)\)"), 1), lambda u: F.regexp_replace(u, "[/_-]", " "))
    wiki = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda w: F.regexp_replace(w, r"[|/_-]", " "))
    return tokens(F.concat_ws(" ", F.array_join(urls, " "), F.array_join(wiki, " ")))


def logical_path(path: Column) -> Column:
    """The part of a physical path from notes/ on."""
    found = F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"(?:^|/)(notes/.*)$", 1)
    return F.when(found != "", found).otherwise(path)


def canonical_scope(scope: Column) -> Column:
    return F.when(F.lower(strip(scope)) == "life", "personal").otherwise(F.lower(strip(scope)))


def scope_matches(note_scope: Column, query_scope: Column) -> Column:
    return (query_scope == "all") | (canonical_scope(F.coalesce(note_scope, F.lit(""))) == query_scope)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
