"""A/B runs: both arms over all cases in one plan, outcomes paired case by case, and reports made of the rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, evaluate, mapping
from ..operators import rank as r
from ..functions import text as t
from ..schema import DEFAULTS, TYPE_DIRS, Settings
from . import retrieval

#: Parts of a corpus that both arms must share, as globs below its root; the cases file belongs to it too.
CORPUS_GLOBS = tuple(f"{folder}/*.md" for folder in TYPE_DIRS)
METRICS = ("hit1", "hitk", "mrr")


@dataclass(frozen=True)
class Arm:
    """One side of a comparison."""

    name: str
    mode: str = "legacy"
    settings: Settings = DEFAULTS


def corpus(spark: SparkSession, root: str, cases: str) -> DataFrame:
    """(path, hash) of the corpus below root and of the cases file, paths relative to root. A missing cases file is an error, a missing folder is not."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(cases if "/" in cases and cases.startswith(("/", "file:", "hdfs:", "viewfs:")) else f"{root}/{cases}")
    if not file.getFileSystem(conf).exists(file):
        raise ValueError(f"there is no cases file {cases}")
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    found = [f"{root}/{g}" for g in CORPUS_GLOBS if len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{g}")) or [])]
    rows = spark.read.format("text").option("wholetext", True).load([*found, file.toString()])
    below = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:/*", "/")
    base = root.split(":", 1)[-1].rstrip("/")
    base = "/" + base.lstrip("/")
    return rows.select(F.when(F.startswith(below, F.lit(base + "/")), F.substring(below, F.lit(len(base) + 2), F.length(below))).otherwise(below).alias("path"), F.sha2("value", 256).alias("hash"))


def same_corpus(base: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) of files that are not the same on both sides: added, deleted or modified. Empty if the arms can be compared."""
    return analytics.diff(base, new).where("state <> 'unchanged'").select("path", "state")


def cases(files: DataFrame) -> DataFrame:
    """query_id, query, query_scope, expected with what ranking asks of queries, from case files (path, text)."""
    rows = mapping.eval_cases(files).withColumn("query_id", F.when(F.col("query_id") == "", F.concat("file", F.lit("#"), F.col("pos").cast("string"))).otherwise(F.col("query_id")))
    return prepared(rows.select("query_id", "query", "query_scope", "expected"))


def prepared(rows: DataFrame) -> DataFrame:
    """Cases (query_id, query, query_scope, expected) with tokens and intents."""
    return r.with_intents(rows.withColumn("query_tokens", t.tokens(F.col("query"))))


def outcomes(
    asked: DataFrame, expected: DataFrame, index: r.Index, arms: Iterable[Arm], now: Column, k: int = 3, depth: int = 50,
    signals: DataFrame | None = None, vectors: DataFrame | None = None,
) -> DataFrame:
    """arm, query_id, query_scope, intent, rank (of the best expected path, null if none is among the first depth), hit1, hitk, rr, results:
    a row for each case and arm, all of one plan. asked holds queries, expected (query_id, rel_path) what they should find; cases without
    an expected path have no row."""
    arms = list(arms)
    sides = [
        retrieval.rank_notes(asked, index, now, arm.mode, depth, arm.settings, signals, vectors).select(F.lit(arm.name).alias("arm"), "query_id", "rel_path", F.col("rank").cast("int").alias("rank"))
        for arm in arms
    ]
    ranked = reduce(DataFrame.unionByName, sides)
    marked = ranked.join(expected.select("query_id", "rel_path", F.lit(True).alias("wanted")).distinct(), ["query_id", "rel_path"], "left")
    found = marked.groupBy("arm", "query_id").agg(F.count("*").alias("results"), F.min(F.when(F.col("wanted"), F.col("rank"))).alias("rank"))
    intent = F.when(F.col("history"), "history").when(F.col("loop"), "loop").when(F.col("pref"), "preference").otherwise("other")
    every = asked.join(expected.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "query_scope", intent.alias("intent"), F.explode(F.array(*[F.lit(a.name) for a in arms])).alias("arm"))
    at = F.coalesce("rank", F.lit(2**30))
    return every.join(found, ["arm", "query_id"], "left").select(
        "arm", "query_id", "query_scope", "intent", "rank", (at <= 1).cast("int").alias("hit1"), (at <= k).cast("int").alias("hitk"),
        F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"), F.coalesce("results", F.lit(0)).alias("results"),
    )


def quality(rows: DataFrame) -> DataFrame:
    """cases, hit1, hitk, mrr of each arm (part `all`), and by scope and by intent, of outcomes: one pass of grouping sets."""
    sets = [[F.col("arm")], [F.col("arm"), F.col("query_scope")], [F.col("arm"), F.col("intent")]]
    part = F.when(F.grouping("query_scope") == 0, "scope").when(F.grouping("intent") == 0, "intent").otherwise("all")
    out = rows.groupingSets(sets, "arm", "query_scope", "intent").agg(
        part.alias("part"), F.count("*").alias("cases"), F.avg("hit1").alias("hit1"), F.avg("hitk").alias("hitk"), F.avg("rr").alias("mrr")
    )
    return out.select("arm", "part", F.coalesce("query_scope", "intent", F.lit("")).alias("value"), "cases", *METRICS)


def paired(rows: DataFrame, base: str, new: str) -> DataFrame:
    """query_id, base_rank, new_rank, gain (of the reciprocal rank), outcome: better, worse, same or missed (by both)."""
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    both = rows.where(F.col("arm").isin(base, new)).groupBy("query_id").agg(
        of(base, "rank").alias("base_rank"), of(new, "rank").alias("new_rank"), (F.coalesce(of(new, "rr"), F.lit(0.0)) - F.coalesce(of(base, "rr"), F.lit(0.0))).alias("gain")
    )
    missed = F.col("base_rank").isNull() & F.col("new_rank").isNull()
    return both.withColumn("outcome", F.when(missed, "missed").when(F.col("gain") > 1e-9, "better").when(F.col("gain") < -1e-9, "worse").otherwise("same"))


def timed(spark: SparkSession, asked: DataFrame, arms: Iterable[Arm], run: Callable[[Arm, DataFrame], object], runs: int = 1, cold: bool = False, reset: Callable[[], None] | None = None, most: int = 200) -> DataFrame:
    """(arm, kind, run, query_id, ms): times of whole evaluations (kind eval, no query_id) and of single queries (kind query).

    A probe times queries one by one, so it takes at most `most` of them, in order of their ids. What was kept is dropped before each run
    by reset, and before each query if cold.
    """
    ids = [x[0] for x in asked.select("query_id").orderBy("query_id").limit(most).collect()]
    forget, rows = reset or (lambda: None), []

    def once(arm: Arm, part: DataFrame) -> float:
        began = time.perf_counter()
        run(arm, part)
        return (time.perf_counter() - began) * 1000

    for arm in arms:
        for n in range(runs):
            forget()
            rows.append((arm.name, "eval", n, None, once(arm, asked)))
            forget()
            for i in ids:
                if cold:
                    forget()
                rows.append((arm.name, "query", n, str(i), once(arm, asked.where(F.col("query_id") == i))))
    return spark.createDataFrame(rows, "arm string, kind string, run int, query_id string, ms double")


def verdict(qualities: DataFrame, times: DataFrame, base: str, new: str, percent: float = 0.05, slack_ms: float = 2.0) -> DataFrame:
    """One row: base_ and new_ metrics and p95 times, deltas, and the decision."""
    arm = {"base": base, "new": new}
    whole = qualities.where("part = 'all'")
    m = whole.agg(*[F.max(F.when(F.col("arm") == name, F.col(c))).alias(f"{side}_{c}") for side, name in arm.items() for c in METRICS])
    late = times.groupBy("arm", "kind").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95"))
    p = late.agg(*[F.coalesce(F.max(F.when((F.col("arm") == name) & (F.col("kind") == kind), F.col("p95"))), F.lit(0.0)).alias(f"{side}_{kind}_p95") for side, name in arm.items() for kind in ("eval", "query")])
    rows = m.join(p)  # a row each
    return rows.withColumns({f"delta_{c}": F.round(F.col(f"new_{c}") - F.col(f"base_{c}"), 6) for c in METRICS}).withColumn("decision", evaluate.decide(percent, slack_ms))


def report_json(decided: DataFrame, qualities: DataFrame, pairs: DataFrame, top: int = 20, facts: dict[str, str] | None = None) -> DataFrame:
    """json: one row of a report: facts, decision, qualities of all parts, how many cases of each outcome, and the cases that changed most."""
    parts = qualities.agg(F.array_sort(F.collect_list(F.struct("part", "value", "arm", "cases", *METRICS))).alias("quality"))
    counts = pairs.groupBy("outcome").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))
    moved = _moved(pairs, top).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.abs("gain"), "query_id", "base_rank", "new_rank", "outcome"))), lambda x: F.struct(x["query_id"].alias("query_id"), x["base_rank"].alias("base_rank"), x["new_rank"].alias("new_rank"), x["outcome"].alias("outcome"))).alias("changed"))
    told = F.map_from_arrays(F.array(*[F.lit(k) for k in (facts or {})]).cast("array<string>"), F.array(*[F.lit(v) for v in (facts or {}).values()]).cast("array<string>"))
    row = decided.select(F.struct(*decided.columns).alias("verdict")).join(parts).join(counts).join(moved)  # a row each
    return row.select(F.to_json(F.struct(told.alias("facts"), "verdict", "quality", "outcomes", "changed")).alias("json"))


def _moved(pairs: DataFrame, top: int) -> DataFrame:
    return pairs.where("outcome IN ('better', 'worse')").orderBy(F.desc(F.abs("gain")), "query_id").limit(top)


def report_markdown(decided: DataFrame, qualities: DataFrame, pairs: DataFrame, base: str, new: str, top: int = 20) -> DataFrame:
    """(section, pos, line) of the report for people; in that order the lines are the text."""
    line = lambda section, pos, text: F.struct(F.lit(section).alias("section"), (F.lit(pos) if isinstance(pos, int) else pos).cast("long").alias("pos"), text.alias("line"))
    row = lambda name, c, digits: F.format_string(f"| {name} | %.{digits}f | %.{digits}f | %+.{digits}f |", F.col(f"base_{c}"), F.col(f"new_{c}"), F.col(f"new_{c}") - F.col(f"base_{c}"))
    head = decided.select(F.explode(F.array(
        line(0, 0, F.concat(F.lit(f"# {base} against {new}: "), "decision")), line(0, 1, F.lit("")), line(1, 0, F.lit(f"| metric | {base} | {new} | change |")), line(1, 1, F.lit("|---|---|---|---|")),
        *[line(1, 2 + i, row(c, c, 4)) for i, c in enumerate(METRICS)], *[line(1, 5 + i, row(f"{k} p95, ms", f"{k}_p95", 1)) for i, k in enumerate(("eval", "query"))],
    )).alias("l")).select("l.*")
    wide = qualities.where("part <> 'all'").groupBy("part", "value").agg(F.max("cases").alias("cases"), *[F.max(F.when(F.col("arm") == arm, F.col("mrr"))).alias(side) for side, arm in (("b", base), ("n", new))])
    text = F.format_string("| %s | %s | %d | %.4f | %.4f |", "part", "value", "cases", "b", "n")
    titles = lambda section, *said: decided.limit(1).select(F.explode(F.array(*[line(section, -len(said) + i, F.lit(x)) for i, x in enumerate(said)])).alias("l")).select("l.*")
    by_part = wide.orderBy("part", "value").select(F.lit(2).alias("section"), F.row_number().over(_in_order("part", "value")).cast("long").alias("pos"), text.alias("line"))
    moved = _moved(pairs, top).withColumn("by", F.abs("gain"))
    shown = F.format_string("| %s | %s | %s | %s |", F.col("query_id").cast("string"), F.coalesce(F.col("base_rank").cast("string"), F.lit("-")), F.coalesce(F.col("new_rank").cast("string"), F.lit("-")), "outcome")
    changed = moved.select(F.lit(3).alias("section"), F.row_number().over(_in_order(F.desc("by"), "query_id")).cast("long").alias("pos"), shown.alias("line"))
    out = head.unionByName(titles(2, "", f"| by | value | cases | {base} mrr | {new} mrr |", "|---|---|---|---|---|")).unionByName(by_part)
    return out.unionByName(titles(3, "", f"| case | {base} rank | {new} rank | outcome |", "|---|---|---|---|")).unionByName(changed)


def _in_order(*columns):
    from pyspark.sql import Window

    return Window.orderBy(*columns)  # of a report's few rows


def save_baseline(base, qualities: DataFrame, name: str = "baseline"):
    """Commit the whole-set metrics of a run (one arm's `all` row) as a baseline of the state folder."""
    from ..sources import state

    return state.commit(base, {f"eval_{name}": qualities.where("part = 'all'").select("arm", "cases", *METRICS)}, relies_on=[])


def against_baseline(base, qualities: DataFrame, name: str = "baseline") -> DataFrame:
    """Deltas of each arm's metrics against the stored baseline of the same arm, and whether it regressed."""
    old = base.table(f"eval_{name}", "arm string, cases long, hit1 double, hitk double, mrr double")
    both = qualities.where("part = 'all'").join(old.select("arm", *[F.col(c).alias(f"b_{c}") for c in METRICS]), "arm")
    rows = both.select("arm", *[F.round(F.col(c) - F.col(f"b_{c}"), 6).alias(f"delta_{c}") for c in METRICS])
    return rows.withColumn("regressed", (F.col("delta_hitk") < 0) | (F.col("delta_mrr") < 0))
