"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space (of Unicode) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def nonempty(text: Column) -> Column:
    """Stripped; null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def decision_key(decision: Column) -> Column:
    return F.lower(strip(decision))


def decision_text(decision: Column, reason: Column) -> Column:
    """The fact that a decision becomes."""
    why = nonempty(reason)
    return F.when(why.isNotNull(), F.concat(strip(decision), F.lit(" (Reason: "), why, F.lit(")"))).otherwise(strip(decision))


def basename(path: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1), F.lit("")), F.lit("unknown"))


def path_key(path: Column) -> Column:
    """Hex key of a project path."""
    return F.md5(path)


def cache_key(text: Column) -> Column:
    """Sixteen raw bytes that an embedding is cached under."""
    return F.unhex(F.md5(text))


def words(text: Column) -> Column:
    """Search terms of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def searchable(content: Column, context: Column) -> Column:
    """What a fact is found by: its content and its neighbours'."""
    return F.when(F.coalesce(F.size(context), F.lit(0)) > 0, F.concat(content, F.lit(" "), F.array_join(context, " "))).otherwise(content)
