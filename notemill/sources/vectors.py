"""Stored vectors of items, one table for each back-end and model: build, status, clean, load."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import semantic
from . import sinks

#: Fixed value: what a model's name may hold in a path.
UNSAFE = "[^A-Za-z0-9._-]+"


def key(model: Column) -> Column:
    """A model's name as a part of a path."""
    return F.regexp_replace(model, UNSAFE, "_")


def _root(root: str, backend: str, model: str) -> str:
    import re

    return f"{root}/{backend}/{re.sub(UNSAFE, '_', model)}"


def allowed(backend: str, target: str, confirmed: bool = False) -> bool:
    """Whether texts of a target may go to a back-end: source files leave for an outside one only if that is confirmed."""
    return backend == "local" or target != "source" or confirmed


def store(items: DataFrame, root: str, backend: str, model: str) -> None:
    """Write vectors (id, hash, embedding) as the current version, with how many there are and their length."""
    at, version = _root(root, backend, model), sinks.new_version()
    spark = items.sparkSession
    items.select("id", "hash", "embedding").write.parquet(f"{at}/{version}")
    n, dims = spark.read.parquet(f"{at}/{version}").agg(F.count("*"), F.max(F.size("embedding"))).first()
    sinks.point(spark, at, version, {"items": str(n), "dims": str(dims or 0)})


def load(spark: SparkSession, root: str, backend: str, model: str) -> DataFrame | None:
    """The stored vectors; None without any, or where their number or their length isn't the one noted."""
    at = _root(root, backend, model)
    facts = sinks.pointer(spark, at)
    if facts is None:
        return None
    rows = spark.read.parquet(f"{at}/{facts['version']}")
    n, odd = rows.agg(F.count("*"), F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != int(facts["dims"]))).first()
    return rows if str(n) == facts["items"] and not odd else None


def status(spark: SparkSession, root: str, backend: str, model: str) -> dict[str, int]:
    facts = sinks.pointer(spark, _root(root, backend, model)) or {"items": "0", "dims": "0"}
    return {"items": int(facts["items"]), "dims": int(facts["dims"])}


def build(items: DataFrame, root: str, embed: Callable[[Column], Column] | semantic.Encoder, backend: str, model: str) -> dict[str, int]:
    """Bring stored vectors up to the items (id, hash, text): those of the same id and hash are taken over, others embedded by the
    encoder or column function, gone ones dropped. Returns how many there were of each."""
    spark = items.sparkSession
    previous = load(spark, root, backend, model)
    if previous is None:
        previous = spark.createDataFrame([], "id string, hash string, embedding array<float>")
    found = {r["state"]: r["count"] for r in semantic.rebuild(items, previous).groupBy("state").count().collect()}
    made = semantic.encoded(items, previous, embed) if isinstance(embed, semantic.Encoder) else semantic.rebuild(items, previous, embed)
    store(made, root, backend, model)
    return {s: found.get(s, 0) for s in ("embedded", "reused", "removed")}


def search(queries: DataFrame, root: str, encoder: semantic.Encoder, backend: str, model: str, limit: int = 8) -> tuple[DataFrame | None, str]:
    """((query_id, rank, id, cosine), reason) of query texts (query_id, text). Without vectors the reason is missing_index and there is no
    result; empty queries have no rows, and where all are empty the reason is empty_query; else it is empty."""
    spark = queries.sparkSession
    held = load(spark, root, backend, model)
    if held is None:
        return None, "missing_index"
    asked = queries.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    if asked.isEmpty():
        return None, "empty_query"
    made = encoder.vectors(asked.select(F.to_json(F.struct("query_id")).alias("id"), F.lit("").alias("hash"), "text"))
    kind = queries.schema["query_id"].dataType.simpleString()
    vectors = made.select(F.from_json("id", f"struct<query_id:{kind}>")["query_id"].alias("query_id"), F.col("embedding").alias("query_vector"))
    return semantic.ranked(held.select("id", "embedding"), vectors, limit).select("query_id", "rank", "id", "cosine"), ""


def told(spark: SparkSession, root: str, backends: dict[str, list[str]]) -> list[str]:
    """Lines for people: what is stored of each back-end's models."""
    lines = []
    for backend, models in sorted(backends.items()):
        for model in models:
            at = status(spark, root, backend, model)
            lines.append(f"- {backend}/{model} items={at['items']} dims={at['dims']}" if at["items"] else f"- {backend}/{model} none")
    return lines


def clean(spark: SparkSession, root: str, backend: str, model: str) -> None:
    """Remove all versions of a model's vectors."""
    fs, path = sinks.file_system(spark, _root(root, backend, model))
    fs.delete(path, True)


def corpus(notes: DataFrame, target: str) -> DataFrame:
    """The notes that a target's vectors are made of, in the order of paths: of notes all types but identity, of sources all files."""
    rows = notes if target == "source" else notes.where((F.col("type") != "id") & (F.col("type") != "other"))
    return rows.orderBy("rel_path")


class QueryVectors:
    """Vectors of query texts, the last few of them kept on the driver."""

    def __init__(self, encode: Callable[[str], list[float]], most: int = 256):
        self.encode = lru_cache(maxsize=most)(encode)

    def __call__(self, spark: SparkSession, texts: dict[object, str]) -> DataFrame:
        """query_id, query_vector of queries by id; empty texts have none."""
        rows = [(k, self.encode(x.strip())) for k, x in texts.items() if x.strip()]
        kind = "long" if all(isinstance(k, int) for k in texts) else "string"
        return spark.createDataFrame(rows, f"query_id {kind}, query_vector array<float>")
