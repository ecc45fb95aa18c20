"""Every retrieval mode against all pairs of a small corpus, ranked in plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from notemill.operators import notes as n
from notemill.operators import rank as r
from notemill.plans import retrieval
from notemill.sources import index as stored

NOW = dt.datetime(2026, 3, 21)
WORDS = "alpha beta gamma delta loop history style release deploy cluster answer note plan".split()
SCHEMA = "rel_path string, type string, status string, scope string, updated string, updated_ts timestamp, confidence double, note_tokens array<string>, tag_tokens array<string>, body string, title string, statement string"


def corpus(rng, size, scopes):
    rows = []
    for k in range(size):
        kind = rng.choice(["id", "fact", "pref", "goal", "loop", "concept"])
        day = NOW - dt.timedelta(days=rng.randrange(120))
        tags = sorted(rng.sample(WORDS, rng.randrange(2)))
        tokens = sorted({*rng.sample(WORDS, rng.randrange(1, 4)), *tags})
        rows.append((f"notes/{k:03d}", kind, rng.choice(["open", "closed"]) if kind == "loop" else "", rng.choice(scopes), f"{day:%Y-%m-%dT%H:%M:%SZ}", day, rng.randrange(11) / 10, tokens, tags, "b", "t", "s"))
    return rows


def brute(rows, tokens, scope, flags, mode, limit):
    history, loop, pref = flags
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [dict(zip(names, x, strict=True)) for x in rows]
    size = max(1, len(tokens))
    age = lambda x: (x["updated"], x["rel_path"])
    for x in rows:
        x["lex"], x["tag"] = len(tokens & set(x["note_tokens"])), len(tokens & set(x["tag_tokens"]))
        own = "personal" if x["scope"] == "life" else x["scope"]
        x["match"], x["over"], x["closed"] = float(scope == "all" or own == scope), x["lex"] + x["tag"] > 0, x["type"] == "loop" and x["status"] == "closed"
        x["open"] = x["type"] == "loop" and x["status"] == "open"
    minimum = min(len(rows), max(24, 2 * limit))

    def padded(pool):
        rest = sorted((x for x in rows if x not in pool), key=age, reverse=True)
        return pool + rest[: max(0, minimum - len(pool))]

    pool = rows
    if mode in ("legacy", "scope_type_prefilter"):
        fits = lambda x: x["match"] and (not pref or x["type"] in ("pref", "concept")) and (not loop or x["type"] in ("loop", "goal")) and (not history or x["type"] in ("loop", "fact", "concept"))
        pool = [x for x in rows if x["over"] or fits(x)]
        if not pool:
            pool = rows
        elif not (scope == "all" and any(flags)):
            pool = padded(pool)
    elif mode == "precomputed_index":
        pool = [x for x in rows if x["over"] or (scope != "all" and x["match"])]
        pool = padded(pool) if pool else rows

    def coarse(x):
        s = 0.70 * x["lex"] / size + 0.20 * x["tag"] / size + 0.10 * x["match"] + (0 if scope == "all" else 0.03 if x["match"] else -0.03)
        return s + (0.05 if history else -0.05) * x["closed"] + 0.04 * (loop and x["open"]) + 0.04 * (pref and x["type"] == "pref")

    short = pool
    if mode != "progressive_disclosure" and limit <= 36:
        short = [x for x in pool if scope != "all" or (x["over"] and coarse(x) > 0)]
        short = sorted(short, key=lambda x: (round(coarse(x), 9), *age(x)), reverse=True)[: max(24, min(36, 3 * limit))]
    count, total = len(short), sum(len(x["note_tokens"]) for x in short)
    df = {}
    for x in short:
        for w in x["note_tokens"]:
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(count - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(idf.values()) / max(1, len(idf))
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    raw = [sum(idf[w] for w in tokens & set(x["note_tokens"])) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(x["note_tokens"]) / (total / count))) for x in short]
    top, out = max(raw, default=0), []
    for x, bm in zip(short, raw, strict=True):
        bm = max(0.0, bm / top) if top > 0 else 0.0
        recency = min(1.0, max(0.0, 1 - (NOW - x["updated_ts"]).total_seconds() / 86400 / 90))
        s = 0.30 * bm + 0.15 * x["lex"] / size + 0.15 * x["tag"] / size + 0.15 * x["match"] + 0.15 * recency + 0.10 * x["confidence"] + 0.15 * (x["type"] == "id")
        s += (0 if scope == "all" else 0.05 if x["match"] else -0.05) - 0.20 * (x["closed"] and not history) + 0.12 * (history and x["closed"]) - 0.05 * (history and x["open"])
        s += 0.07 * (loop and x["open"]) + 0.07 * (pref and x["type"] == "pref") - 0.05 * (pref and x["type"] not in ("pref", "fact"))
        s = min(1.0, max(0.0, s))
        if s > 0 and (x["over"] or scope != "all"):
            out.append((round(s, 9), *age(x)))
    return [(path, s) for s, _, path in sorted(out, reverse=True)[:limit]]


QUERIES = [("alpha release", "all"), ("alpha release", "work"), ("zzz", "work"), ("zzz", "personal"), ("style beta", "dev"), ("loop gamma", "all"), ("history", "home"), ("zzz loop", "meta"), ("history style", "all"), ("zzz", "all"), ("", "dev")]


@pytest.mark.parametrize("size,scopes,limit", [(13, ["work", "home", "home", "home"], 8), (60, ["work", "dev", "life", "home"], 3), (130, ["dev", "work", "home"], 50), (40, ["home"], 40)])
def test_modes_equal_all_pairs(spark, size, scopes, limit):
    rows = corpus(random.Random(size), size, scopes)
    asked = spark.createDataFrame([(i, sorted(q.split()), s) for i, (q, s) in enumerate(QUERIES)], "query_id int, query_tokens array<string>, query_scope string")
    index = r.index_of(spark.createDataFrame(rows, SCHEMA).cache())
    asked = r.with_intents(asked).cache()
    flags = {x.query_id: (x.history, x.loop, x.pref) for x in asked.collect()}
    for mode in ("legacy", "two_stage", "scope_type_prefilter", "precomputed_index", "progressive_disclosure"):
        got: dict[int, list] = {}
        for x in retrieval.rank_notes(asked, index, F.lit(NOW.isoformat(" ")).cast("timestamp"), mode, limit).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.rel_path, round(x.score, 9)))
        for i, (q, s) in enumerate(QUERIES):
            want = brute(rows, set(q.split()), s, flags[i], mode, limit)
            have = got.get(i, [])
            assert len(have) == len(want) and all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(have, want, strict=True)), (mode, q, s)
            last = want[-1][1] + 1e-8 if len(want) == limit else -1  # equal scores may stand in either order, as sums differ in their last digit
            assert {p for p, x in have if x > last} == {p for p, x in want if x > last}, (mode, q, s)


def test_index_pool_and_postings(spark):
    rows = corpus(random.Random(5), 50, ["work", "home"])
    notes = spark.createDataFrame(rows, SCHEMA)
    asked = r.with_intents(spark.createDataFrame([(0, ["zzz"], "dev"), (1, ["zzz"], "work"), (2, ["alpha"], "all")], "query_id int, query_tokens array<string>, query_scope string"))
    got = n.index_pool(asked, r.index_of(notes), 40).collect()
    assert sum(x.query_id == 0 for x in got) == 50 and not any(x.matched for x in got if x.query_id == 0)
    one = [x for x in got if x.query_id == 1]
    assert len(one) == 40 and {x.rel_path for x in one if x.matched} == {x[0] for x in rows if x[3] == "work"}
    lists = n.postings(notes, 5).collect()
    want = {(w, x[0]) for x in rows for w in {*x[7], *x[8]}}
    assert {(x.token, p) for x in lists for p in x.paths} == want and sum(len(x.paths) for x in lists) == len(want)
    assert max(len(x.paths) for x in lists) < 15


def test_stored_index_follows_the_files(spark, tmp_path):
    root, time = str(tmp_path / "index"), dt.datetime(2026, 1, 1)
    assert stored.load(spark, root) is None

    def files(**texts):
        rows = [(f"/v/notes/02_facts/{k}.md", f"# {k}\n## Statement\n{x}\n", time + dt.timedelta(days=d), len(x)) for k, (x, d) in texts.items()]
        return spark.createDataFrame(rows, "path string, text string, mtime timestamp, size long")

    held = lambda: {(x.rel_path[-4:-3], x.title, x.statement) for x in stored.load(spark, root).entries.collect()}
    assert stored.refresh(files(a=("one", 0), b=("two", 0), c=("three", 0)), root) == {"parsed": 3}
    assert held() == {("a", "a", "one"), ("b", "b", "two"), ("c", "c", "three")}
    before = (tmp_path / "index").stat().st_mtime_ns
    assert stored.refresh(files(a=("one", 0), b=("two", 0), c=("three", 0)), root) == {"reused": 3} and (tmp_path / "index").stat().st_mtime_ns == before
    assert stored.refresh(files(a=("one", 5), b=("new", 5), d=("four", 0)), root) == {"touched": 1, "parsed": 2, "removed": 1}
    assert held() == {("a", "a", "one"), ("b", "b", "new"), ("d", "d", "four")}
    asked = r.with_intents(spark.createDataFrame([(0, ["four"], "all")], "query_id int, query_tokens array<string>, query_scope string"))
    assert [x.rel_path for x in retrieval.rank_notes(asked, stored.load(spark, root), F.current_timestamp(), "precomputed_index", 3).collect()] == ["notes/02_facts/d.md"]
    stored.sinks.point(spark, root, "x", {"format": "2"})
    assert stored.load(spark, root) is None
