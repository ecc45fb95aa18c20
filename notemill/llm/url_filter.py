"""URL filter by a character language-model ratio (operator 7).

Rules (host, path) judge first. What no rule fits is judged by two variable-order Markov models over characters, one of
accepted and one of rejected URLs, smoothed by Witten-Bell interpolation down to single characters. The verdict comes
from their log-likelihood difference for each character, turned into a probability by a logistic calibration that is
fitted on URLs which the models did not see.

The models are fitted on at most ``TRAIN_URLS`` distinct URLs of each verdict that a rule gave, chosen by hash; every URL
is judged. Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and is scored by the
models on its own characters (null: on none); equal rows get equal verdicts; without examples of both
verdicts everything that no rule blocks is allowed; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .worker import releasing


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
TRAIN_URLS = 4000
ORDER = 5


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


class CharModel:
    """Witten-Bell interpolated character model with contexts of up to order characters."""

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order = order
        self.counts: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for text in texts:
            padded = "\x02" * order + text + "\x03"
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    self.counts[padded[i - k : i]][padded[i]] += 1
        self.counts = {k: dict(v) for k, v in self.counts.items()}
        self.totals = {k: (sum(v.values()), len(v)) for k, v in self.counts.items()}

    def log2(self, text: str) -> float:
        padded, out = "\x02" * self.order + text + "\x03", 0.0
        for i in range(self.order, len(padded)):
            p = 1 / 65536
            for k in range(self.order + 1):
                context = padded[i - k : i]
                if context not in self.counts:
                    break
                n, kinds = self.totals[context]
                p = (self.counts[context].get(padded[i], 0) + kinds * p) / (n + kinds)
            out += math.log2(p)
        return out


@dataclass(frozen=True)
class UrlJudge:
    accepted: CharModel
    rejected: CharModel
    slope: float
    shift: float

    def ratio(self, text: str) -> float:
        return (self.accepted.log2(text) - self.rejected.log2(text)) / (len(text) + 1)

    def probability(self, text: str) -> float:
        z = self.slope * self.ratio(text) + self.shift
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _calibrate(x: list[float], y: list[int], steps: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic regression by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, a * u + b)))) for u in x]
        ga = sum((q - t) * u for q, t, u in zip(p, y, x, strict=True)) + 1e-3 * a
        gb = sum(q - t for q, t in zip(p, y, strict=True))
        w = [q * (1 - q) + 1e-9 for q in p]
        haa, hab, hbb = sum(k * u * u for k, u in zip(w, x, strict=True)) + 1e-3, sum(k * u for k, u in zip(w, x, strict=True)), sum(w) + 1e-6
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def train(accepted: list[str], rejected: list[str]) -> UrlJudge | None:
    """Models of four fifths of the URLs, calibrated on the rest; None without examples of both kinds."""
    if not accepted or not rejected:
        return None
    fit = [[t for i, t in enumerate(x) if i % 5 or len(x) < 5] for x in (accepted, rejected)]
    held = [[t for i, t in enumerate(x) if not i % 5 or len(x) < 5] for x in (accepted, rejected)]
    judge = UrlJudge(CharModel(fit[0]), CharModel(fit[1]), 1.0, 0.0)
    slope, shift = _calibrate([judge.ratio(t) for x in held for t in x], [1] * len(held[0]) + [0] * len(held[1]))
    return UrlJudge(judge.accepted, judge.rejected, max(slope, 1e-6), shift)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, bound: int = TRAIN_URLS, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and, where no rule fits, the calibrated probability of being acceptable."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "by_rule": verdict})
    ruled = rows.where(F.col("by_rule").isNotNull()).select("by_rule", "url").distinct()
    samples = [[r[0] for r in ruled.where(F.col("by_rule") == kind).select("url").orderBy(F.xxhash64("url"), "url").limit(bound).collect()] for kind in ("allow", "block")]
    judge = train(*samples)

    def run(batches):
        seen: dict[str, float] = {}
        for batch in batches:
            scores = []
            for url, known in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), strict=True):
                url = url or ""
                if known is not None or judge is None:
                    scores.append(None)
                    continue
                if url not in seen:
                    if len(seen) > 100_000:
                        seen = {}
                    seen[url] = judge.probability(url)
                scores.append(seen[url])
            verdicts = [k or ("allow" if s is None or s >= threshold else "block") for k, s in zip(batch.column(5).to_pylist(), scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:5], pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())],
                names=["page_id", "host", "path", "rule", "verdict", "probability"],
            )

    return rows.mapInArrow(releasing(run), "page_id long, host string, path string, rule string, verdict string, probability double")
