"""Folds by crc32 of the id as text, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32(id as text) mod parts; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int, parts: int = 5) -> list[tuple[str, int]]:
    """(text, label) of at most bound labelled rows outside fold 0, chosen by a hash of the id, for the driver.

    The bound is what the classifiers are fitted on; everything they score is the whole table.
    """
    rows = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & (fold("_id", parts) != 0))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(bound)
    )
    texts = documents.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    got = texts.join(F.broadcast(rows), "_id").groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"), F.max("_y").alias("_y"))  # a text of each id
    return [(r[1], r[2]) for r in sorted(got.collect())]
