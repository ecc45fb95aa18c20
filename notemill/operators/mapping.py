"""Small YAML and JSON configuration as column functions: nested keys and lists to typed entries, and what is read from them.

A text is folded over its lines with a stack of open keys and list items, told apart by indentation, to an array of
entries (path, value, kind) in order. A path is the keys from the top down, list items by their number from 0. Blank
lines and comments are passed over, a line that is neither key nor item ends what it stands in, an item may stand as
far left as its key. A key with nothing after it has an entry of kind `empty` of its own, before its children's.
Lists in brackets become items. Kinds are those of front-matter scalars. The fold copies its output once a line, so
it is meant for configuration, cases and front matter, not for bulk data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import compose

_EVENT = "struct<indent:int,kind:string,name:string,value:string>"
_FRAME = "array<struct<indent:int,name:string,item:boolean>>"
_RAW = "array<struct<path:array<string>,value:string>>"


def _events(line: Column) -> Column:
    """What a line says: an item, a key, both, or something else."""
    indent, pattern, none = F.length(F.regexp_extract(line, r"^(\s*)", 1)), r"^(\"[^\"]*\"|'[^']*'|[A-Za-z0-9_.-]+):(?:\s+((?s:.*)))?$", F.lit(None).cast("string")
    event = lambda at, kind, name, value: F.struct(at.cast("int").alias("indent"), F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))

    def of(body: Column) -> Column:
        item = body.rlike(r"^-(\s|$)")

        def told(rest: Column) -> Column:
            keyed = rest.rlike(pattern)
            inner = F.when(item, indent + F.length(body) - F.length(rest)).otherwise(indent)
            key = event(inner, "key", t.unquote(F.regexp_extract(rest, pattern, 1)), F.regexp_extract(rest, pattern, 2))
            return (
                F.when(item & keyed, F.array(event(indent, "item", none, F.lit("")), key)).when(item, F.array(event(indent, "item", none, rest)))
                .when(keyed, F.array(key)).otherwise(F.array(event(indent, "other", none, F.lit(""))))
            )

        return t.once(F.when(item, t.strip(F.substring(body, F.lit(2), F.length(body)))).otherwise(body), told)

    return t.once(t.strip(line), of)


def _step(acc: Column, e: Column) -> Column:
    stack, item = acc["stack"], e["kind"] == "item"
    kept = F.filter(stack, lambda f: (f["indent"] < e["indent"]) | ((f["indent"] == e["indent"]) & item & ~f["item"]))
    popped = F.get(stack, F.size(kept))
    number = F.when(popped["item"] & (popped["indent"] == e["indent"]), popped["name"].cast("int") + 1).otherwise(0)
    name = F.when(item, F.coalesce(number, F.lit(0)).cast("string")).otherwise(e["name"])
    path = F.concat(F.transform(kept, lambda f: f["name"]), F.array(name))
    told = (e["kind"] != "other") & ~(item & (e["value"] == ""))
    return F.struct(
        F.when(e["kind"] == "other", kept).otherwise(F.concat(kept, F.array(F.struct(e["indent"].alias("indent"), name.alias("name"), item.alias("item"))))).alias("stack"),
        F.when(told, F.concat(acc["out"], F.array(F.struct(path.alias("path"), e["value"].alias("value"))))).otherwise(acc["out"]).alias("out"),
    )


def _plain(value: Column, escapes: bool) -> Column:
    """A scalar without quotes and comment; with escapes, JSON's in double quotes are read."""
    if not escapes:
        return t.unquote(t.without_comment(value))
    json = lambda v: F.when(v.rlike(r'(?s)^".*"$'), F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), F.lit(0)))
    return t.once(t.without_comment(value), lambda v: F.coalesce(json(v), t.unquote(v)))


def entries(text: Column, escapes: bool = False) -> Column:
    """array<struct<path,value,kind>> of a text; null text has none."""
    said = F.filter(t.lines(text), lambda x: ~x.rlike(r"(?s)^\s*(#.*)?$"))
    events = F.flatten(F.transform(said, _events)).cast(f"array<{_EVENT}>")
    raw = F.aggregate(events, F.struct(F.array().cast(_FRAME).alias("stack"), F.array().cast(_RAW).alias("out")), _step)["out"]
    entry = lambda path, value, kind: F.struct(path.alias("path"), value.alias("value"), kind.alias("kind"))

    def spread(e: Column) -> Column:
        def told(bare: Column) -> Column:
            inside = F.regexp_extract_all(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit(rf"(\s*{t.QUOTED}\s*|\s*'[^']*'\s*|[^,]+)"), 1)
            items = F.filter(inside, lambda x: t.strip(x) != "")
            listed = F.transform(items, lambda x, i: entry(F.concat(e["path"], F.array(i.cast("string"))), _plain(x, escapes), compose.scalar_kind(x)))
            nothing = F.array(entry(e["path"], F.lit(""), F.lit("empty")))
            return (
                F.when(e["value"] == "", nothing).when(bare.rlike(r"(?s)^\[.*\]$"), F.concat(nothing, listed))
                .otherwise(F.array(entry(e["path"], _plain(e["value"], escapes), compose.scalar_kind(e["value"]))))
            )

        return t.once(t.strip(F.regexp_replace(e["value"], r"\s+#[^\"'\]]*$", "")), told)

    return F.flatten(F.transform(raw, spread))


def _path(parts: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(p) for p in parts])


def scalar_at(found: Column, *path: str) -> Column:
    """The last value said for a path, null where there is none, or no scalar."""
    return F.try_element_at(F.filter(found, lambda e: (e["path"] == _path(path)) & (e["kind"] != "empty")), F.lit(-1))["value"]


def list_at(found: Column, *path: str) -> Column:
    """The values of the items below a path in order, null where the path isn't there; a scalar is a list of one."""
    here, n = _path(path), len(path)
    items = F.filter(found, lambda e: (F.size(e["path"]) == n + 1) & (F.slice(e["path"], 1, n) == here) & F.element_at(e["path"], -1).rlike(r"^\d+$") & (e["kind"] != "null"))
    there = F.exists(found, lambda e: e["path"] == here)
    scalar = scalar_at(found, *path)
    return F.when(there & scalar.isNotNull(), F.array(scalar)).when(there, F.transform(items, lambda e: e["value"]))


def scalars(found: Column) -> Column:
    """map<dotted path, value> of all scalars; the last of several wins."""
    values = F.filter(found, lambda e: e["kind"] != "empty")
    named = F.transform(values, lambda e: F.struct(F.array_join(e["path"], ".").alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def any_front_matter(files: DataFrame, escapes: bool = False) -> DataFrame:
    """path, key, value, kind of every front-matter entry of notes (path, text), known keys or not."""
    front, _ = t.body_and_front(F.col("text"))
    rows = files.select("path", F.explode(entries(front, escapes)).alias("e"))
    return rows.select("path", F.array_join("e.path", ".").alias("key"), "e.value", "e.kind")


def eval_cases(files: DataFrame, escapes: bool = False) -> DataFrame:
    """file, pos, query_id, query, query_scope, expected of the cases in texts (path, text), whether they stand at the top or under a key.

    A case without a scope, or with an empty one, has all; one without an id or query has an empty one. Expected paths are in the order of the text.
    """
    rows = files.select(F.col("path").alias("file"), F.posexplode(entries(F.col("text"), escapes)).alias("at", "e"))
    size = F.size("e.path")
    last, before = F.element_at("e.path", -1), F.try_element_at(F.col("e.path"), F.lit(-2))
    field = last.isin("id", "query", "scope") & before.rlike(r"^\d+$") & (F.col("e.kind") != "empty")
    hit = (before == "expected_any") & last.rlike(r"^\d+$")
    known = rows.withColumn("field", field).withColumn("hit", F.coalesce(hit, F.lit(False))).where("field OR hit OR (e.kind = 'empty' AND e.path[size(e.path) - 1] = 'expected_any')")
    keyed = known.withColumn("case", F.array_join(F.slice("e.path", F.lit(1), F.when(F.col("hit"), size - 2).otherwise(size - 1)), "."))
    of = lambda name: F.max_by(F.when(F.col("field") & (last == name), F.col("e.value")), F.when(F.col("field") & (last == name), F.col("at")))
    cases = keyed.groupBy("file", "case").agg(
        F.min("at").alias("pos"), F.coalesce(of("id"), F.lit("")).alias("query_id"), F.coalesce(of("query"), F.lit("")).alias("query"), of("scope").alias("query_scope"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("hit"), F.struct("at", F.col("e.value").alias("value"))))), lambda x: x["value"]).alias("expected"),
    )
    return cases.select("file", "pos", "query_id", "query", F.when(F.coalesce("query_scope", F.lit("")) == "", "all").otherwise(F.col("query_scope")).alias("query_scope"), "expected")


# Keys of a vault's configuration with their type, default, and the least and most that is allowed; folders that are left out
# beside the library's own.
VAULT = {
    "version": ("int", 1, None, None), "auto_write_confidence_min": ("double", 0.90, 0.0, 1.0), "queue_confidence_min": ("double", 0.70, 0.0, 1.0), "file_signal_min": ("double", 1.5, 0.0, None),
    "max_files_per_cycle": ("int", 50, 1, None), "max_notes_per_cycle": ("int", 100, 1, None), "debounce_seconds": ("double", 3.0, 0.25, None),
}
EXCLUDED = (".obsidian", ".git", ".trash", ".smart-env", ".smartchats", "attachments", "notemill")


def vault_config(files: DataFrame) -> DataFrame:
    """path, the vault's settings and problems of JSON configurations (path, text). Texts that aren't JSON objects, and keys without a value,
    have the defaults; excluded folders are stripped, distinct and sorted."""
    schema = "struct<" + ",".join(f"{k}:string" for k in VAULT) + ",exclude_dirs:array<string>>"
    rows = files.select("path", F.from_json("text", schema).alias("c"))
    typed = {k: F.coalesce(F.expr(f"try_cast(c.{k} AS {kind})"), F.lit(default).cast(kind)) for k, (kind, default, _, _) in VAULT.items()}
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("c.exclude_dirs", t.strings()), lambda x: t.strip(x)), lambda x: x != "")))
    out = rows.select("path", *[c.alias(k) for k, c in typed.items()], F.when(F.size(clean) > 0, clean).otherwise(F.array_sort(t.strings(*EXCLUDED))).alias("exclude_dirs"))
    bad = []
    for k, (_, _, least, most) in VAULT.items():
        if least is not None:
            wrong = F.col(k) < least if most is None else (F.col(k) < least) | (F.col(k) > most)
            bad.append(F.when(wrong, F.lit(f"{k} is out of range")))
    bad.append(F.when(F.col("queue_confidence_min") > F.col("auto_write_confidence_min"), F.lit("queue_confidence_min exceeds auto_write_confidence_min")))
    return out.withColumn("problems", F.array_compact(F.array(*bad)))


def vault_text(config: DataFrame) -> DataFrame:
    """path, text: vault configurations as JSON with keys in order."""
    return config.select("path", F.to_json(F.struct(*sorted([*VAULT, "exclude_dirs"])), {"pretty": "true"}).alias("text"))
