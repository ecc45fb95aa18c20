r"""Line dedup over levelled sorted runs (operator 11), in DataFrame functions alone.

A line's key is the line without white space (0x20, 0x09-0x0D) at its ends, with A-Z in lower case; it is known by two
64-bit hashes. A store of runs holds the keys of all batches so far, each run sorted by hash: a new batch is
merge-joined with the runs, its keys without a partner there (the anti-join) are fresh and carry the document that
keeps them, the others carry their counts alone, and both become a run of level 0. As soon as a level holds `fanout`
runs they are merged into one run of the next level. Batches arrive in descending order of ids, so the document that
keeps a key is the largest that holds it. What the store names in at least `min_documents` documents is dropped
elsewhere.

The most frequent keys (HOT of them, a fixed number of rows) meet the lines by broadcast, the others by a shuffle in
which no key holds more than a HOT-th of the lines. No task gathers more than the positions of one text.

Defined results: null and empty texts have one empty line; documents are counted by id, so repeated rows are one
document and a null id is one, below all others; rows of the largest id keep all their lines with the key, and a key
of null ids alone stays; texts that lose all lines are empty; other columns are left out; an empty table gives an
empty table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

MIN_CHARS = 20
MIN_DOCUMENTS = 3
BATCHES = 6
FANOUT = 3
#: Keys that are broadcast, 32 bytes each.
HOT = 4096
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _row_hashes() -> tuple[Column, Column]:
    return F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("r2")


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(r1, r2, doc_id, pos, h1, h2) of every line whose key has at least min_chars code points; r1, r2 stand for the row."""
    cut = documents.select("doc_id", *_row_hashes(), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.octet_length("line") >= min_chars)
    keyed = cut.withColumn("bare", F.btrim("line", F.lit(SPACE))).where(F.length("bare") >= min_chars).withColumn("key", lower_ascii(F.col("bare")))
    return keyed.select("r1", "r2", "doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """Levelled runs of (h1, h2, n, keeper, fresh) in a shared folder; a numbered list names the runs that count.

    A list is written after its runs and never changed, so a stopped job leaves the store as it was; opening the
    folder again takes the newest list.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = self._fs.globStatus(self._path(f"{self.path}/list-*.json")) or []
        names = sorted(s.getPath().getName() for s in found)
        self.version, self.levels = 0, []
        if names:
            self.version = int(names[-1][5:-5])
            self.levels = json.loads("\n".join(r[0] for r in spark.read.text(f"{self.path}/{names[-1]}").collect()))

    def _commit(self, levels: list[list[str]]) -> None:
        out = self._fs.create(self._path(f"{self.path}/list-{self.version + 1:08d}.json"), False)
        try:
            out.write(bytearray(json.dumps(levels).encode()))
        finally:
            out.close()
        self.version, self.levels = self.version + 1, levels

    def _write(self, rows: DataFrame, level: int) -> str:
        path = f"{self.path}/run-{self.version + 1:08d}-{level}"
        rows.select("h1", "h2", "n", "keeper", "fresh").sortWithinPartitions("h1", "h2").write.mode("overwrite").parquet(path)
        return path

    def rows(self) -> DataFrame | None:
        """The rows of all runs: one fresh row for each key, and a row of counts for each further run that holds it."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema("h1 long, h2 long, n long, keeper long, fresh boolean").parquet(*paths) if paths else None

    def add(self, keys: DataFrame) -> None:
        """Take a batch's keys (h1, h2, n, keeper): each key once, its documents all new to the store."""
        runs = self.rows()
        if runs is None:
            flagged = keys.withColumn("fresh", F.lit(True))
        else:
            held = runs.where("fresh").select("h1", "h2", F.lit(True).alias("held"))
            flagged = keys.join(held.hint("merge"), ["h1", "h2"], "left").withColumn("fresh", F.col("held").isNull())
        own = flagged.select("h1", "h2", "n", F.when(F.col("fresh"), F.col("keeper")).alias("keeper"), "fresh")
        levels = [list(level) for level in self.levels] or [[]]
        levels[0].append(self._write(own, 0))
        self._commit(levels)
        self.compact()

    def compact(self) -> None:
        """Merge each full level into a run of the next; the merged runs stay until the store is dropped."""
        for level in range(64):
            if level >= len(self.levels) or len(self.levels[level]) < self.fanout:
                return
            full = self.spark.read.schema("h1 long, h2 long, n long, keeper long, fresh boolean").parquet(*self.levels[level])
            merged = self._write(_merged(full), level + 1)
            levels = [list(x) for x in self.levels] + ([[]] if level + 1 == len(self.levels) else [])
            levels[level] = []
            levels[level + 1].append(merged)
            self._commit(levels)

    def frequent(self, min_documents: int) -> DataFrame | None:
        """(h1, h2, n, keeper) of the keys held by at least min_documents documents."""
        runs = self.rows()
        return None if runs is None else _merged(runs).where(F.col("n") >= min_documents).select("h1", "h2", "n", "keeper")


def _merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"), F.max("fresh").alias("fresh"))


def _batches(rows: DataFrame, n: int) -> Column:
    """Number of each row's batch: ranges of doc_id, the largest ids in batch 0, null in the last."""
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 1000)).first()[0] or [] if n > 1 else []
    batch = F.lit(0)
    for cut in sorted(set(cuts)):
        batch = batch + F.when(F.col("doc_id") > cut, 0).otherwise(1)
    return batch.cast("int")


def dedup_lines(spark: SparkSession, documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, hot: int = HOT) -> DataFrame:
    """doc_id, text without the dropped lines, n_lines (before), n_dropped."""
    scratch = Scratch(spark, "lines")
    docs = _documents(documents)
    all_lines = scratch.write(lines(docs, min_chars), "lines")
    held = all_lines.withColumn("batch", _batches(all_lines, batches)).select("batch", "h1", "h2", "doc_id").distinct()
    keys = scratch.write(held.groupBy("batch", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).sortWithinPartitions("batch", "h1", "h2"), "keys")
    runs = LineRuns(spark, f"{scratch.path}/runs", fanout)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b))
    frequent = scratch.write(runs.frequent(min_documents), "frequent")

    top = scratch.write(frequent.orderBy(F.desc("n"), "h1", "h2").limit(hot), "hot").select("h1", "h2", F.col("keeper").alias("hot_keeper"), F.lit(True).alias("is_hot"))
    met = all_lines.join(F.broadcast(top), ["h1", "h2"], "left")
    others = F.col("doc_id").isNull() | (F.col("doc_id") != F.col("k"))
    by_broadcast = met.where("is_hot").withColumn("k", F.col("hot_keeper"))
    by_shuffle = met.where(F.col("is_hot").isNull()).join(frequent.select("h1", "h2", F.col("keeper").alias("k")), ["h1", "h2"])
    dropped = by_broadcast.select("r1", "r2", "pos", "doc_id", "k").unionByName(by_shuffle.select("r1", "r2", "pos", "doc_id", "k")).where(F.col("k").isNotNull() & others)
    places = dropped.groupBy("r1", "r2").agg(F.collect_set("pos").alias("drop"))
    return _without(docs.select("doc_id", "text", *_row_hashes()).join(places, ["r1", "r2"], "left"))


def _without(rows: DataFrame) -> DataFrame:
    def rest(cut: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("drop"))
        return F.array_join(F.transform(stay, lambda i: F.get(cut, i)), "\n")

    # The text is split once, bound to a lambda's variable, and each line is fetched by its place.
    kept = F.transform(F.array(F.split("text", "\n", -1)), rest)[0]
    return rows.select(
        "doc_id",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
    )


def digest(deduplicated: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of dedup_lines' rows."""
    return deduplicated.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
