"""Token-id output (operator 2): Parquet list columns in ascending doc_id order.

A stored table has a row for each document: doc_id, part and local_start (ids of the part's documents before it),
n_tokens and the list of ids. Ids are dictionary-encoded; the integer columns are delta-encoded. Row groups and
pages are small and bounded, and their min/max indexes let a reader fetch a few documents, or metadata alone.

Defined results: null text is empty and has the end id alone; rows with equal doc_id follow each other in the order
of a hash of their texts; a null doc_id comes first; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokenise
from .worker import releasing

#: Bytes of text encoded at once; the more, the fewer words are looked up again.
SLICE = 2 << 20
STORED = "doc_id long, part long, local_start long, n_tokens long, tokens array<int>"
#: Of the files; parquet.block.size bounds a row group, the page limits bound what a selective read fetches.
FORMAT = {
    "compression": "snappy",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def write_tokens(documents: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Encode whole texts, append end_id to each and write them in ascending doc_id order."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        encode = tokenise.encoder(vocabulary)
        for batch in batches:
            for i, j, texts in tokenise.slices(batch.column(1), SLICE):
                ids = [x + end for x in encode(texts)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.zeros(len(n) + 1, np.int64)
                np.cumsum(n, out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.full(len(n), part)), pa.array(total + offsets[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)],
                    names=["doc_id", "part", "local_start", "n_tokens", "tokens"],
                )
                total += int(offsets[-1])

    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text"))
    # Parts are ranges of ids, and of text hashes within an id, in ascending order.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    writer = ordered.mapInArrow(releasing(run), STORED).write.mode("overwrite")
    for key, value in FORMAT.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The stored rows; of ids from first to last if given, for which files, row groups and pages of other ids are passed over."""
    rows = spark.read.schema(STORED).parquet(path)
    rows = rows if first is None else rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, local_start, n_tokens of the stored rows; no token is read."""
    return spark.read.schema(STORED).parquet(path).drop("tokens")


def part_starts(stored: DataFrame) -> dict[int, int]:
    """Ids before each part; a row for each file's worth of documents reaches the driver."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens")).collect()
    starts, n = {}, 0
    for part, total in sorted(totals):
        starts[part] = n
        n += total
    return starts


def digest(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the stored ids."""
    starts = part_starts(stored)

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
            values = memoryview(np.asarray(lists.values)).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            base = np.array([starts[p] for p in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base + np.asarray(batch.column(2))), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return stored.select("doc_id", "part", "local_start", "tokens").mapInArrow(releasing(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
