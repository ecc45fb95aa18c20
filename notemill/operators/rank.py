"""Batched ranking: every operator takes all queries at once and joins on tokens, groups or ids.

queries: query_id, query_tokens (sorted set), query_scope, history, loop, pref (intent flags).
candidates: rel_path (unique), type, status, scope, updated, updated_ts, confidence, note_tokens, tag_tokens, body, title, statement.

No step pairs all queries with all candidates. Overlapping pairs are counted block by block (``tiles``), which only the best leave, or, where
whole pools are needed, by an equi-join on tokens that carries narrow columns alone. What a
candidate without overlap scores depends on its group (scope, type, status), its age and confidence, and the query's profile (scope and
intents); so the best of each group (as many as a result can hold) serve all queries of a profile. There are at most
168 groups and 64 profiles. Weights of the final score must not let a candidate without overlap exceed 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..schema import DEFAULTS, HISTORY_HINTS, LOOP_HINTS, PREFERENCE_HINTS, SCOPES, STATUSES, TYPE_DIRS, Settings
from . import tiles


def with_intents(queries: DataFrame) -> DataFrame:
    """Add the intent flags of the unexpanded query tokens."""
    flag = lambda hints: F.arrays_overlap("query_tokens", t.strings(*hints))
    return queries.withColumns({"history": flag(HISTORY_HINTS), "loop": flag(LOOP_HINTS), "pref": flag(PREFERENCE_HINTS)})


def expand_aliases(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id, expanded, events: tokens plus those of their aliases' phrases; only original tokens are looked up.

    An event (alias, phrase) is one that adds a token, in the order of aliases and phrases (pos).
    """
    hits = queries.select("query_id", F.explode("query_tokens").alias("alias")).join(aliases, "alias")
    hits = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("alias", "pos", "phrase", t.tokens(F.col("phrase")).alias("tokens")))).alias("hits"))
    start = F.struct(F.col("query_tokens").alias("have"), F.array().cast("array<struct<alias:string,phrase:string>>").alias("events"))

    def step(acc: Column, h: Column) -> Column:
        new = F.size(F.array_except(h["tokens"], acc["have"])) > 0
        return F.struct(
            F.array_union(acc["have"], h["tokens"]).alias("have"),
            F.when(new, F.concat(acc["events"], F.array(F.struct(h["alias"].alias("alias"), h["phrase"].alias("phrase"))))).otherwise(acc["events"]).alias("events"),
        )

    joined = queries.select("query_id", "query_tokens").join(hits, "query_id", "left")
    folded = F.aggregate(F.coalesce("hits", F.array().cast("array<struct<alias:string,pos:int,phrase:string,tokens:array<string>>>")), start, step)
    return joined.select("query_id", F.array_sort(folded["have"]).alias("expanded"), folded["events"].alias("events"))


#: Narrow columns that a pair carries until it is ranked.
CARRIED = ("type", "scope", "status", "updated", "updated_ts", "confidence", "dl")
PROFILE, GROUP = ("profile_scope", "history", "loop", "pref"), ("group_scope", "group_type", "group_status")


@dataclass(frozen=True)
class Index:
    """Notes as ranking reads them: entries (candidates) and postings (token, rel_path, n, g, CARRIED): a row for each token of a
    note, n if it is one of the note's and g if of its tags."""

    entries: DataFrame
    postings: DataFrame


def with_length(candidates: DataFrame) -> DataFrame:
    return candidates if "dl" in candidates.columns else candidates.withColumn("dl", F.size("note_tokens"))


def postings(candidates: DataFrame) -> DataFrame:
    rows = with_length(candidates)
    kept = ["rel_path", *CARRIED]
    note = rows.select(*kept, F.explode("note_tokens").alias("token")).withColumns({"n": F.lit(1), "g": F.lit(0)})
    tag = rows.select(*kept, F.explode("tag_tokens").alias("token")).withColumns({"n": F.lit(0), "g": F.lit(1)})
    return note.unionByName(tag)


def index_of(candidates: DataFrame) -> Index:
    """An index made on the way; ``sources.index`` stores one and reads it."""
    return Index(with_length(candidates), postings(candidates))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("query_tokens").alias("token"))


def overlaps(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, rel_path, lexical_count, tag_count of every pair that shares a token."""
    return index.postings.select("token", "rel_path", "n", "g").join(_asked(queries), "token").groupBy("query_id", "rel_path").agg(F.sum("n").alias("lexical_count"), F.sum("g").alias("tag_count"))


def _profiles() -> Column:
    """Every profile a query can have; a scope that no note has counts as one."""
    return F.array(*[
        F.struct(F.lit(s).alias("profile_scope"), *[F.lit(bool(bits >> k & 1)).alias(c) for k, c in enumerate(PROFILE[1:])]) for s in (*SCOPES, "") for bits in range(8)
    ])


def with_profile(queries: DataFrame) -> DataFrame:
    return queries.withColumn("profile_scope", F.when(F.col("query_scope").isin(*SCOPES), F.col("query_scope")).otherwise(""))


def with_group(candidates: DataFrame) -> DataFrame:
    known = lambda c, values: F.when(c.isin(*values), c).otherwise("")
    return candidates.withColumns({
        "group_scope": known(t.canonical_scope(F.col("scope")), SCOPES), "group_type": known(F.col("type"), TYPE_DIRS.values()), "group_status": known(F.col("status"), STATUSES),
    })


def _suits(mode: str) -> Column:
    """Which candidates are in a query's pool without an overlap, by scope and type."""
    matches, kind = (F.col("profile_scope") == "all") | (F.col("group_scope") == F.col("profile_scope")), F.col("group_type")
    if mode == "index":
        return matches & (F.col("profile_scope") != "all")
    if mode == "prefilter":
        return matches & (~F.col("pref") | kind.isin("pref", "concept")) & (~F.col("loop") | kind.isin("loop", "goal")) & (~F.col("history") | kind.isin("loop", "fact", "concept"))
    return F.lit(True)


def _alone(rows: DataFrame, suits: Column, score: Column | None, depth: int, base: Column | None = None) -> DataFrame:
    """For each profile the best suiting candidates as if none overlapped, by score and age; base orders a group, newest first without it."""
    age = [F.desc("updated"), F.desc("rel_path")]
    heads = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*GROUP).orderBy(*([] if base is None else [base.desc()]), *age))).where(F.col("rn") <= depth)
    spread = heads.withColumn("profile", F.explode(_profiles())).select(*rows.columns, "profile.*").where(suits)
    zero = F.lit(0).cast("long")
    spread = components(spread.withColumns({"lexical_count": zero, "tag_count": zero, "query_scope": F.col("profile_scope"), "query_tokens": t.strings(), "bm25": F.lit(0.0)}))
    best = Window.partitionBy(*PROFILE).orderBy(*([] if score is None else [score.desc()]), *age)
    return spread.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= depth).select("rel_path", *[c for c in rows.columns if c != "rel_path"], *PROFILE)


def _suiting(rows: DataFrame, suits: Column) -> tuple[DataFrame, DataFrame]:
    """(group, profile) pairs that suit, and how many candidates suit each profile of how many."""
    spread = rows.groupBy(*GROUP).agg(F.count("*").alias("n")).withColumn("profile", F.explode(_profiles())).select(*GROUP, "n", "profile.*")
    counts = spread.groupBy(*PROFILE).agg(F.sum(F.when(suits, F.col("n")).otherwise(0)).alias("suiting"), F.sum("n").alias("whole"))
    return spread.where(suits).drop("n"), counts


def _few(queries: DataFrame, rows: DataFrame, suits: Column, minimum: int) -> DataFrame:
    """Queries that too few candidates suit."""
    return queries.join(_suiting(rows, suits)[1], list(PROFILE)).where(F.col("suiting") < F.least("whole", F.lit(minimum)))


def _short(queries: DataFrame, rows: DataFrame, met: DataFrame, suits: Column, minimum: int) -> DataFrame:
    """Queries whose pool has fewer candidates than minimum, with how many it has and how many all are."""
    few = _few(queries, rows, suits, minimum)
    more = with_group(met).join(_asked(few), "token").select("query_id", "rel_path", *GROUP).distinct().join(few.select("query_id", *PROFILE), "query_id").where(~suits)
    more = more.groupBy("query_id").agg(F.count("*").alias("more"))
    found = few.join(more, "query_id", "left").withColumn("found", F.col("suiting") + F.coalesce("more", F.lit(0)))
    return found.where(F.col("found") < F.least("whole", F.lit(minimum)))


def _padding(short: DataFrame, rows: DataFrame, met: DataFrame, mode: str, minimum: int) -> DataFrame:
    """What pools are padded with (a prefiltered one of all scopes and some intent is not): the newest candidates outside the pools of queries that found some, but fewer than minimum. Of the newest as many as
    minimum that don't suit, those that overlap are among the found ones, so enough are left."""
    some = short.where("found > 0 AND NOT (profile_scope = 'all' AND (history OR loop OR pref))" if mode == "prefilter" else "found > 0")
    newest = some.join(_alone(rows, ~_suits(mode), None, minimum), list(PROFILE))
    others = newest.join(met.join(_asked(some), "token").select("query_id", "rel_path").distinct(), ["query_id", "rel_path"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("updated"), F.desc("rel_path"))
    return others.withColumn("rn", F.row_number().over(order)).where(F.col("rn") + F.col("found") <= F.least("whole", F.lit(minimum)))


def members(queries: DataFrame, index: Index, mode: str, minimum: int) -> DataFrame:
    """query_id, rel_path, matched: the whole pool of each query, padded with the newest others up to minimum; where none
    matches, all notes."""
    q, rows, suits = with_profile(queries), with_group(index.entries.select("rel_path", *CARRIED)), _suits(mode)
    short = _short(q, rows, index.postings, suits, minimum)
    of_group = lambda which, asked: rows.select("rel_path", *GROUP).join(_suiting(rows, which)[0], list(GROUP)).join(asked.select("query_id", *PROFILE), list(PROFILE)).select("query_id", "rel_path")
    met = index.postings.join(_asked(q), "token").select("query_id", "rel_path")
    more = of_group(F.lit(True), short.where("found = 0")).unionByName(_padding(short, rows, index.postings, mode, minimum).select("query_id", "rel_path"))
    return of_group(suits, q).unionByName(met).distinct().withColumn("matched", F.lit(True)).unionByName(more.withColumn("matched", F.lit(False)))


def _signalled(rows: DataFrame, signals: DataFrame | None) -> DataFrame:
    """With the signal_score of each note (signals: note, signal_score), 0 without one."""
    if signals is None:
        return rows.withColumn("signal_score", F.lit(0.0))
    return rows.join(signals.select(F.col("note").alias("rel_path"), "signal_score"), "rel_path", "left").withColumn("signal_score", F.coalesce("signal_score", F.lit(0.0)))


def pairs(
    queries: DataFrame, index: Index, mode: str = "all", depth: int = DEFAULTS.shortlist_max, minimum: int = 0, now: Column | None = None,
    settings: Settings = DEFAULTS, signals: DataFrame | None = None, weights: DataFrame | None = None, ungated: bool = False, best: bool = False,
) -> DataFrame:
    """Pairs of the queries' pools with overlap counts, carried columns and the queries' columns: all that overlap, and of the others the
    best ``depth``, by the coarse score, or by the final one where now is given.

    weights (token, weight): adds their sum over shared note tokens. ungated: queries of all scopes get pairs without
    overlap too. best: of the overlapping pairs only those that can be among the best ``depth`` by the coarse score leave their block
    (tiles.overlap_best); a job counts the notes, and another looks whether any pool is short of ``minimum``.
    """
    q, suits, rows = with_profile(queries), _suits(mode), with_group(index.entries.select("rel_path", *CARRIED))
    scoped = q if ungated else q.where("query_scope <> 'all'")
    score, base, placed = coarse_score(), None, rows
    if now is not None:
        placed = _signalled(rows, signals).withColumn("recency", recency(F.col("updated_ts"), now, settings.recency_days))
        score, base = final_score(now, settings), settings.recency * F.col("recency") + settings.confidence * F.coalesce("confidence", F.lit(0.0)) + settings.signal * F.col("signal_score")
    kept = ["query_id", "rel_path", *CARRIED]
    alone = scoped.join(_alone(placed, suits, score, depth, base), list(PROFILE)).select(*kept)
    if minimum and not (best and _few(scoped, rows, suits, minimum).isEmpty()):
        short = _short(scoped, rows, index.postings, suits, minimum)
        alone = alone.unionByName(_padding(short, rows, index.postings, mode, minimum).select(*kept))
        alone = alone.unionByName(short.where("found = 0").join(_alone(placed, F.lit(True), score, depth, base), list(PROFILE)).select(*kept))
    if best:
        hits = tiles.overlap_best(queries, index.postings, CARRIED, depth, tiles.n_blocks(index.entries))
        met = hits.select(*kept, F.col("lexical_count").alias("n"), F.col("tag_count").alias("g"), F.lit(0.0).alias("w"))
        return _pooled(met, alone, kept, queries, signals)
    asked = _asked(q).withColumn("w", F.lit(0.0)) if weights is None else _asked(q).join(weights, "token", "left").select("query_id", "token", F.coalesce("weight", F.lit(0.0)).alias("w"))
    hits = index.postings.join(asked, "token").select(*kept, "n", "g", (F.col("n") * F.col("w")).alias("w"))
    return _pooled(hits, alone, kept, queries, signals)


def _pooled(hits: DataFrame, alone: DataFrame, kept: list[str], queries: DataFrame, signals: DataFrame | None) -> DataFrame:
    both = hits.unionByName(alone.withColumns({"n": F.lit(0), "g": F.lit(0), "w": F.lit(0.0)}))
    both = both.groupBy(*kept).agg(F.sum("n").alias("lexical_count"), F.sum("g").alias("tag_count"), F.sum("w").alias("weight"))
    return _signalled(both.join(queries, "query_id"), signals)


def components(pairs: DataFrame) -> DataFrame:
    size = F.greatest(F.size("query_tokens"), F.lit(1))
    return pairs.withColumns({
        "lexical_match": F.col("lexical_count") / size, "tag_overlap": F.col("tag_count") / size,
        "scope_match": t.scope_matches(F.col("scope"), F.col("query_scope")).cast("double"),
    })


def coarse_score() -> Column:
    closed = (F.col("type") == "loop") & (F.col("status") == "closed")
    score = 0.70 * F.col("lexical_match") + 0.20 * F.col("tag_overlap") + 0.10 * F.col("scope_match")
    score += F.when(F.col("query_scope") == "all", 0.0).when(F.col("scope_match") >= 1, 0.03).otherwise(-0.03)
    score += F.when(closed, F.when(F.col("history"), 0.05).otherwise(-0.05)).otherwise(0.0)
    score += F.when(F.col("loop") & (F.col("type") == "loop") & (F.col("status") == "open"), 0.04).otherwise(0.0)
    return score + F.when(F.col("pref") & (F.col("type") == "pref"), 0.04).otherwise(0.0)


def shortlist(pairs: DataFrame, limit: int, settings: Settings = DEFAULTS) -> DataFrame:
    """The pairs with the best coarse scores of each query; across all scopes a pair must overlap."""
    scored = components(pairs).withColumn("coarse", coarse_score())
    scored = scored.where("query_scope <> 'all' OR (lexical_count + tag_count > 0 AND coarse > 0)")
    best = Window.partitionBy("query_id").orderBy(F.desc("coarse"), F.desc("updated"), F.desc("rel_path"))
    return scored.withColumn("coarse_rank", F.row_number().over(best)).where(F.col("coarse_rank") <= settings.shortlist(limit))


def _idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def length_part(dl: Column, avgdl: Column, settings: Settings) -> Column:
    k1, b = settings.bm25_k1, settings.bm25_b
    return (k1 + 1) / (1 + k1 * (1 - b + b * dl / avgdl))


def bm25(pool: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, rel_path, bm25 in [0, 1]: Okapi over each query's own pool of token sets, divided by its maximum.

    pool: query_id, query_tokens, rel_path, dl, note_tokens; it is read three times, so it should be a stored table.
    """
    stats = pool.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = pool.select("query_id", F.explode("note_tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("df"))
    df = df.join(stats, "query_id").withColumn("idf", _idf(F.col("n"), F.col("df")))
    df = df.withColumn("mean", F.avg("idf").over(Window.partitionBy("query_id")))
    idf = F.when(F.col("idf") < 0, settings.bm25_epsilon * F.col("mean")).otherwise(F.col("idf"))
    hits = pool.select("query_id", "rel_path", "dl", F.explode(F.array_intersect("note_tokens", "query_tokens")).alias("token"))
    scored = hits.join(df.select("query_id", "token", "avgdl", idf.alias("idf")), ["query_id", "token"])
    raw = scored.groupBy("query_id", "rel_path").agg(F.sum(F.col("idf") * length_part(F.col("dl"), F.col("avgdl"), settings)).alias("raw"))
    top = F.max("raw").over(Window.partitionBy("query_id"))
    return raw.withColumn("top", top).where("top > 0").select("query_id", "rel_path", F.greatest(F.lit(0.0), F.col("raw") / F.col("top")).alias("bm25"))


def corpus_idf(queries: DataFrame, index: Index, settings: Settings = DEFAULTS) -> DataFrame:
    """token, weight of the tokens asked for: inverse document frequencies over all notes."""
    df = index.postings.where("n = 1").groupBy("token").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(index.entries.agg(F.count("*").alias("n")))).withColumn("idf", _idf(F.col("n"), F.col("df")))  # one row
    mean = idf.agg(F.avg("idf").alias("mean"))
    kept = idf.join(_asked(queries).select("token").distinct(), "token", "left_semi").join(F.broadcast(mean))  # one row too
    return kept.select("token", F.when(F.col("idf") < 0, settings.bm25_epsilon * F.col("mean")).otherwise(F.col("idf")).alias("weight"))


def recency(ts: Column, now: Column, days: float = DEFAULTS.recency_days) -> Column:
    """1 now, falling to 0 at the horizon; null is 0, the future is 1."""
    age = (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - age / days)), F.lit(0.0))


def final_score(now: Column, settings: Settings = DEFAULTS) -> Column:
    s, loop, closed = settings, F.col("type") == "loop", F.col("status") == "closed"
    is_open = F.col("status") == "open"
    score = s.bm25 * F.col("bm25") + s.lexical * F.col("lexical_match") + s.tag * F.col("tag_overlap") + s.scope * F.col("scope_match") + s.recency * F.col("recency") + s.confidence * F.coalesce("confidence", F.lit(0.0))
    score += F.when(F.col("type") == "id", s.identity_boost).otherwise(0.0) + s.signal * F.coalesce("signal_score", F.lit(0.0))
    score += F.when(F.col("query_scope") == "all", 0.0).when(F.col("scope_match") >= 1, 0.05).otherwise(-0.05)
    score += F.when(loop & closed & ~F.col("history"), -0.20).otherwise(0.0)
    score += F.when(F.col("history") & loop & closed, 0.12).when(F.col("history") & loop & is_open, -0.05).otherwise(0.0)
    score += F.when(F.col("loop") & loop & is_open, 0.07).otherwise(0.0)
    score += F.when(F.col("pref") & (F.col("type") == "pref"), 0.07).otherwise(0.0)
    score += F.when(F.col("pref") & ~F.col("type").isin("pref", "fact"), -0.05).otherwise(0.0)
    return t.clamp(score)


def reasons(settings: Settings = DEFAULTS) -> Column:
    """Why a pair has its score, in a fixed order."""
    loop, scoped = F.col("type") == "loop", F.col("query_scope") != "all"
    closed, is_open = F.col("status") == "closed", F.col("status") == "open"
    given = [
        F.when(F.col("type") == "id", F.lit(f"identity_boost=+{settings.identity_boost:.2f}")),
        F.when((F.lit(settings.signal) > 0) & (F.coalesce("signal_score", F.lit(0.0)) != 0), F.format_string("signal=%.3f", "signal_score")),
        F.when(F.col("bm25") > 0, F.format_string("bm25=%.3f", "bm25")),
        F.when(F.col("lexical_count") > 0, F.format_string("lexical_overlap=%d", "lexical_count")),
        F.when(F.col("tag_count") > 0, F.format_string("tag_overlap=%d", "tag_count")),
        F.when(scoped & (F.col("scope_match") >= 1), "scope_boost"), F.when(scoped & (F.col("scope_match") < 1), "scope_demote"),
        F.when(loop & closed & ~F.col("history"), "closed_loop_penalty"),
        F.when(F.col("history") & loop & closed, "history_closed_loop_boost"), F.when(F.col("history") & loop & is_open, "history_open_loop_demote"),
        F.when(F.col("loop") & loop & is_open, "open_loop_intent_boost"), F.when(F.col("pref") & (F.col("type") == "pref"), "preference_intent_boost"),
        F.when(F.col("pref") & ~F.col("type").isin("pref", "fact"), "preference_non_pref_demote"),
        F.when(F.col("recency") > 0, F.format_string("recency=%.2f", "recency")), F.format_string("confidence=%.2f", F.coalesce("confidence", F.lit(0.0))),
    ]
    return F.filter(F.array(*given), lambda x: x.isNotNull())


def rank(pool: DataFrame, now: Column, limit: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Score, gate and order a pool of pairs (with components and bm25); rank 1 is best."""
    scored = pool.withColumn("recency", recency(F.col("updated_ts"), now, settings.recency_days)).withColumn("score", final_score(now, settings))
    kept = scored.where("score > 0 AND (query_scope <> 'all' OR lexical_count + tag_count > 0)")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("updated"), F.desc("rel_path"))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def hybrid(pool: DataFrame, now: Column, limit: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Rank pairs with components and a cosine by cosine, lexical, scope and recency; a missing cosine counts as 0."""
    scored = pool.withColumn("cosine", t.clamp(F.coalesce("cosine", F.lit(0.0)))).withColumn("recency", recency(F.col("updated_ts"), now, settings.recency_days))
    lexical = t.clamp(0.70 * F.col("lexical_match") + 0.30 * F.col("tag_overlap"))
    scored = scored.withColumn("lexical_component", lexical).where("cosine > 0 OR lexical_component > 0")
    s = settings
    score = s.hybrid_vector * F.col("cosine") + s.hybrid_lexical * F.col("lexical_component") + s.hybrid_scope * F.col("scope_match") + s.hybrid_recency * F.col("recency")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("updated"), F.desc("rel_path"))
    return scored.withColumn("score", t.clamp(score)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def disclose(ranked: DataFrame, limit: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Progressive disclosure: the first few keep reasons, the others are compact."""
    top = F.col("rank") <= min(settings.rationale_top, limit)
    return ranked.withColumn("disclosure", F.when(top, "rationale").otherwise("compact")).withColumn("reasons", F.when(top, reasons(settings)).otherwise(t.strings()))


def bundle(ranked: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, rel_path, taken words and excerpt: ranked bodies packed one after another under a word budget."""
    rows = ranked.select("query_id", F.struct("rank", "rel_path", t.words(F.col("body")).alias("words")).alias("r")).groupBy("query_id").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    empty = F.array().cast("array<struct<rank:int,rel_path:string,taken:int,excerpt:string>>")

    def step(acc: Column, r: Column) -> Column:
        take = F.least(F.size(r["words"]), F.greatest(F.lit(settings.bundle_least), F.least(acc["left"], F.lit(settings.bundle_most))))
        use = (acc["left"] > 0) & (F.size(r["words"]) > 0)
        item = F.struct(r["rank"].alias("rank"), r["rel_path"].alias("rel_path"), take.alias("taken"), F.array_join(F.slice(r["words"], 1, F.greatest(take, F.lit(1))), " ").alias("excerpt"))
        return F.struct(F.when(use, acc["left"] - take).otherwise(acc["left"]).alias("left"), F.when(use, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate("rows", F.struct(F.lit(settings.bundle_words).alias("left"), empty.alias("out")), step)
    return rows.select("query_id", F.inline(folded["out"]))


def view(ranked: DataFrame, level: str = "index") -> DataFrame:
    """Columns of a result at one of three levels of detail."""
    base = ["query_id", "rank", "rel_path", "type", "scope", F.when(F.col("type") == "loop", F.col("status")).alias("status"), F.round("score", 6).alias("score")]
    context = [*base, "title", t.shorten(F.col("statement"), 200).alias("snippet"), "updated", "tags"]
    return ranked.select(*{"index": [*base, "title"], "context": context, "detail": [*context, "body", "confidence"]}[level])


def related(text_tokens: DataFrame, index: Index, now: Column, top_k: int = 5, settings: Settings = DEFAULTS) -> DataFrame:
    """Notes most related to free text: final score without BM25 and intents over the index pool, zero overlaps included.

    Equal scores are in the order of the pool: matching notes first, then the newest.
    """
    asked = text_tokens.where(F.size("query_tokens") > 0).withColumns({"history": F.lit(False), "loop": F.lit(False), "pref": F.lit(False)})
    pool = components(pairs(asked, index, "index", top_k, settings.shortlist_min, now, settings, ungated=True)).withColumn("bm25", F.lit(0.0))
    pool = pool.withColumn("recency", recency(F.col("updated_ts"), now, settings.recency_days)).withColumn("score", final_score(now, settings))
    matched = (F.col("lexical_count") + F.col("tag_count") > 0) | ((F.col("query_scope") != "all") & (F.col("scope_match") >= 1))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), matched.desc(), F.desc("updated"), F.desc("rel_path"))
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).withColumn("score", F.round("score", 4))


def ingest_context(sources: DataFrame, index: Index, now: Column, first: int = 2000, top_k: int = 5, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, text, related of new source texts: the text, and the paths of the notes most related to its beginning, best first."""
    asked = sources.select("query_id", t.tokens(F.substring("text", 1, first)).alias("query_tokens"), F.lit("all").alias("query_scope"))
    found = related(asked, index, now, top_k, settings).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "rel_path"))).alias("r"))  # top_k at most
    return sources.join(found, "query_id", "left").select("query_id", "text", F.coalesce(F.transform("r", lambda x: x["rel_path"]), t.strings()).alias("related"))
