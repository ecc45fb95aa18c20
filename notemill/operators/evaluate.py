"""Retrieval quality and A/B decisions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULTS, Settings


def case_ranks(ranked: DataFrame, expected: DataFrame, depth: int = 50) -> DataFrame:
    """Best rank of any expected path of each case, null if none is among the first depth."""
    hits = ranked.where(F.col("rank") <= depth).join(expected, ["query_id", "rel_path"])
    best = hits.groupBy("query_id").agg(F.min("rank").alias("rank"))
    return expected.select("query_id").distinct().join(best, "query_id", "left")


def quality(ranks: DataFrame, k: int = 3) -> DataFrame:
    return ranks.agg(
        F.count("*").alias("cases"), F.avg((F.coalesce("rank", F.lit(2**30)) <= 1).cast("double")).alias("hit1"),
        F.avg((F.coalesce("rank", F.lit(2**30)) <= k).cast("double")).alias("hitk"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


def passes(quality: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return quality.withColumn("passed", (F.col("hitk") >= settings.hit_at_k) & (F.col("mrr") >= settings.mrr))


def latency(times: DataFrame, group: str = "arm") -> DataFrame:
    """Minimum, mean, median and nearest-rank p95."""
    return times.groupBy(group).agg(
        F.min("ms").alias("least"), F.max("ms").alias("most"), F.avg("ms").alias("mean"),
        F.percentile("ms", F.lit(0.5)).alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95"),
    )


def decide(percent: float = 0.05, slack_ms: float = 2.0) -> Column:
    """Of base_/new_ hit1, hitk, mrr, eval_p95 and query_p95: beneficial, regression or neutral."""
    delta = lambda m: F.col(f"new_{m}") - F.col(f"base_{m}")
    worse = (delta("hit1") < -1e-9) | (delta("hitk") < -1e-9) | (delta("mrr") < -1e-9)
    better = (delta("hit1") > 1e-9) | (delta("hitk") > 1e-9) | (delta("mrr") > 1e-9)
    slow = F.lit(False)
    for m in ("eval_p95", "query_p95"):
        slow |= F.col(f"new_{m}") > F.col(f"base_{m}") * (1 + percent) + slack_ms
    return F.when(worse, "regression").when(better, "beneficial").when(slow, "regression").otherwise("neutral")


def compare(base: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas of a quality row against a stored one, and whether it regressed."""
    b = base.select(*[F.col(m).alias(f"b_{m}") for m in ("hit1", "hitk", "mrr")])
    rows = new.crossJoin(F.broadcast(b))
    deltas = [F.round(F.col(m) - F.col(f"b_{m}"), 6).alias(f"delta_{m}") for m in ("hit1", "hitk", "mrr")]
    return rows.select(*deltas).withColumn("regressed", (F.col("delta_hitk") < 0) | (F.col("delta_mrr") < 0))


def deltas(base: DataFrame, new: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """metric, base, new, delta of two rows of metrics, rounded to four digits."""
    pick = lambda df, name: df.select(F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", name))
    both = pick(base, "base").join(pick(new, "new"), "metric")
    return both.select("metric", F.round("base", 4).alias("base"), F.round("new", 4).alias("new"), F.round(F.col("new") - F.col("base"), 4).alias("delta"))


def run(cases: DataFrame, ranker: Callable[[DataFrame], DataFrame], k: int = 3) -> DataFrame:
    """Quality of a ranker, a function from queries to ranked rows (query_id, rel_path, rank), over cases with their expected paths."""
    expected = cases.select("query_id", F.explode("expected").alias("rel_path"))
    return quality(case_ranks(ranker(cases.drop("expected")), expected), k)


def probe(run: Callable[[], object], repeats: int = 5, reset: Callable[[], None] | None = None) -> list[float]:
    """Milliseconds of repeated runs, each from a cold start if reset clears what was kept."""
    out = []
    for _ in range(repeats):
        if reset:
            reset()
        began = time.perf_counter()
        run()
        out.append((time.perf_counter() - began) * 1000)
    return out


def ab_row(base: DataFrame, new: DataFrame, base_ms: dict[str, list[float]], new_ms: dict[str, list[float]]) -> DataFrame:
    """One row for the decision: qualities of both arms, and nearest-rank p95 of their eval and query times."""
    spark, p95 = base.sparkSession, lambda x: sorted(x)[max(0, -(-len(x) * 95 // 100) - 1)]
    times = {f"{arm}_{kind}_p95": float(p95(ms[kind])) for arm, ms in (("base", base_ms), ("new", new_ms)) for kind in ("eval", "query")}
    of = lambda df, arm: df.select(*[F.col(m).alias(f"{arm}_{m}") for m in ("hit1", "hitk", "mrr")])
    return of(base, "base").join(of(new, "new")).join(spark.createDataFrame([tuple(times.values())], list(times)))  # one row each
