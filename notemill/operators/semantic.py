"""Vectors: items to embed, encoders, cosine, block-wise ranking, incremental rebuild."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import browse, mapping, tiles
from .notes import note_type


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def half_away(value: Column, digits: int) -> Column:
    """Rounded to digits in floating point, halves away from zero (F.round rounds the decimal text of a number)."""
    return F.signum(value) * F.floor(F.abs(value) * 10.0**digits + 0.5) / 10.0**digits


def item_hash(*columns: str) -> Column:
    """Content hash of an item's fields."""
    return F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


#: Fixed value: the fields that an item's hash is made of, in their order.
HASHED = ("body", "confidence", "lang", "scope", "status", "tags", "title", "updated")


def items(files: DataFrame, target: str = "notes") -> DataFrame:
    """id, rel_path, path, type, scope, status, lang, updated, hash, text of what is embedded of files (path, text, mtime).

    The hash is of a record of eight fields as JSON with sorted keys: a change of any of them, and of nothing else, makes an item a new one.
    A note without a heading has its file's stem as a title; one without a time has its file's. The text is title and body.
    """
    front, body = t.body_and_front(F.col("text"))
    rows = files.select("path", "mtime", mapping.entries(front).alias("e"), t.strip(body).alias("body"))
    said = lambda k: t.strip(F.coalesce(mapping.scalar_at(F.col("e"), k), F.lit("")))
    tags = F.array_join(F.array_sort(F.filter(F.transform(F.coalesce(mapping.list_at(F.col("e"), "tags"), t.strings()), t.strip), lambda x: x != "")), ",")
    number = said("confidence")
    confidence = F.when(number.rlike(r"^[+-]?(\d+\.\d*|\.\d+)$"), number.cast("double").cast("string")).otherwise(number)
    heading = t.strip(t.title(F.col("body")))
    rows = rows.select(
        "path", "mtime", "body", said("lang").alias("lang"), said("scope").alias("scope"), said("status").alias("status"), said("updated").alias("updated"), tags.alias("tags"), confidence.alias("confidence"),
        F.when(heading != "", heading).otherwise(F.regexp_replace(browse.stem(F.col("path")), "_", " ")).alias("title"),
    )
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    record = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), quoted(F.col(c))) for c in HASHED]), F.lit("}"))
    path = t.logical_path(F.col("path")) if target == "notes" else F.col("path")
    return rows.select(
        F.concat(F.lit(target + ":"), path).alias("id"), path.alias("rel_path"), "path", (note_type(F.col("path")) if target == "notes" else F.lit("source")).alias("type"), "scope", "status", "lang",
        F.when(F.col("updated") != "", F.col("updated")).otherwise(F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated"), F.sha1(record).alias("hash"), t.strip(F.concat_ws("\n", "title", "body")).alias("text"),
    )


_LOADED: dict[str, Callable[[list[str]], list[list[float]]]] = {}


@dataclass(frozen=True)
class Encoder:
    """An encoder of texts: load() gives the function from texts to vectors, once in each worker process; it gets `batch` texts at a time."""

    name: str
    load: Callable[[], Callable[[list[str]], list[list[float]]]]
    batch: int = 256

    def vectors(self, rows: DataFrame) -> DataFrame:
        """id, hash, embedding of items (id, hash, text)."""
        name, load, size = self.name, self.load, self.batch

        def run(batches):
            if name not in _LOADED:
                _LOADED[name] = load()
            for batch in batches:
                for i in range(0, batch.num_rows, size):
                    part = batch.slice(i, size)
                    made = _LOADED[name]([x or "" for x in part.column(2).to_pylist()])
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([list(map(float, v)) for v in made], pa.list_(pa.float32()))], names=["id", "hash", "embedding"])

        return rows.select("id", "hash", "text").mapInArrow(run, "id string, hash string, embedding array<float>")


def ranked(vectors: DataFrame, queries: DataFrame, limit: int, digits: int = tiles.DIGITS, undefined: bool = False) -> DataFrame:
    """The best vectors (id, embedding) of each query (query_id, query_vector) by cosine, ties by id; cosines that agree when rounded to digits
    are ties. queries is a stated set; a block of vectors is multiplied by a tile of queries at once, and only each block's best rows
    of a query leave it. undefined: see tiles.nearest."""
    scored = tiles.nearest(vectors, queries, limit, digits, undefined)
    order = Window.partitionBy("query_id").orderBy(F.desc("tied"), F.asc_nulls_last("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("tied")


def encoded(items: DataFrame, previous: DataFrame, encoder: Encoder) -> DataFrame:
    """id, hash, embedding of all items (id, hash, text): stored vectors of the same id and hash, new ones of the others alone."""
    held = items.select("id", "hash").join(previous.select("id", "hash", "embedding"), ["id", "hash"])
    fresh = items.join(previous.select("id", "hash"), ["id", "hash"], "left_anti")
    return held.select("id", "hash", "embedding").unionByName(encoder.vectors(fresh))


def rebuild(items: DataFrame, previous: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """How each item stands to the stored vectors: reused (same id and hash), embedded, or removed.

    With embed, a column function of the text (such as a pandas_udf), the vectors of new items are computed as well.
    """
    old = previous.select("id", F.col("hash").alias("old_hash"), F.col("embedding").alias("old_embedding"))
    state = F.when(F.col("hash").isNull(), "removed").when(F.col("hash") == F.col("old_hash"), "reused").otherwise("embedded")
    rows = items.join(old, "id", "full_outer").withColumn("state", state)
    if embed is None:
        return rows.select("id", "state")
    return rows.where("state <> 'removed'").select("id", "hash", "state", F.when(F.col("state") == "reused", F.col("old_embedding")).otherwise(embed(F.col("text"))).alias("embedding"))
