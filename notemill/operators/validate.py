"""Checks of input at the boundary: as columns over tables, and of single settings on the driver."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t
from ..schema import SCOPES, STATUSES, TYPE_DIRS, Settings

#: Settings that must lie within a range.
RANGES = {"import_write": (0.0, 1.0), "import_queue": (0.0, 1.0), "import_files": (1, 10_000), "import_notes": (1, 10_000), "boot_min_confidence": (0.0, 1.0), "shortlist_min": (1, 10_000), "shortlist_max": (1, 10_000)}


def query(text: Column, longest: int = 2000) -> Column:
    """Why a query can't be asked; null if it can."""
    q = t.strip(F.coalesce(text, F.lit("")))
    return F.when(q == "", "empty").when(F.length(q) > longest, "too_long").when(q.contains("\x00"), "null_bytes")


def one_of(value: Column, values: tuple[str, ...], why: str) -> Column:
    return F.when(~F.lower(t.strip(F.coalesce(value, F.lit("")))).isin(*values), why)


def scope(value: Column) -> Column:
    return one_of(value, SCOPES, "bad_scope")


def status(value: Column) -> Column:
    return one_of(value, (*STATUSES, "all"), "bad_status")


def note_type(value: Column) -> Column:
    return one_of(value, (*TYPE_DIRS.values(), "all"), "bad_type")


def limit(value: Column, most: int = 1000) -> Column:
    return F.when(value.isNull() | (value < 1) | (value > most), "bad_limit")


def inside(path: Column, root: str) -> Column:
    """Why a path isn't within root once . and .. are followed; null if it is."""
    given = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    step = lambda acc, part: F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))
    resolved = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(given, "/"), t.strings(), step), "/"))
    return F.when(path.contains("\x00"), "null_bytes").when((resolved != root.rstrip("/")) & ~resolved.startswith(root.rstrip("/") + "/"), "escapes_root")


def settings(given: Settings) -> list[str]:
    """What is wrong with settings: values out of range, and weights of the final score that could exceed 1."""
    wrong = [f"{k} must be from {lo} to {hi}" for k, (lo, hi) in RANGES.items() if not lo <= getattr(given, k) <= hi]
    if given.import_queue > given.import_write:
        wrong.append("import_queue must not exceed import_write")
    if given.lexical + given.tag + given.scope + given.recency + given.confidence + given.bm25 > 1 + 1e-9:
        wrong.append("weights of the final score must add up to at most 1")
    return wrong


def known_keys(overrides: dict) -> list[str]:
    """Keys that no setting has, removed ones among them."""
    names = {f.name for f in fields(Settings)}
    return sorted(k for k in overrides if k not in names)
