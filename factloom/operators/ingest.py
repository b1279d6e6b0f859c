"""Saving: decisions and general facts of save calls become fact rows.

A call's input comes as rows: decisions (call_id, pos, decision, reason) and statements (call_id, pos, content).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import text
from factloom.operators.windows import with_context


def decisions(rows: DataFrame) -> DataFrame:
    """(call_id, pos, content): stripped, empty ones dropped, the first of equal ones (case aside) within a call kept, reason appended."""
    good = rows.where(text.nonempty(F.col("decision")).isNotNull()).withColumn("_key", text.decision_key(F.col("decision")))
    first = Window.partitionBy("call_id", "_key").orderBy("pos")
    kept = good.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select("call_id", "pos", text.decision_text(F.col("decision"), F.col("reason")).alias("content"))


def facts(decided: DataFrame, stated: DataFrame, context: int = 2) -> DataFrame:
    """(call_id, ord, content, category, context_window): decisions first, then statements verbatim; neighbours within the call."""
    both = decided.select("call_id", F.lit(0).alias("_leg"), "pos", "content", F.lit(schemas.DECISION).alias("category")).union(stated.select("call_id", F.lit(1), "pos", "content", F.lit(schemas.GENERAL)))
    own = Window.partitionBy("call_id").orderBy("_leg", "pos")
    numbered = both.withColumn("ord", (F.row_number().over(own) - 1).cast("long"))
    return with_context(numbered, context, ("call_id",)).select("call_id", "ord", "content", "category", "context_window")


def appended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows after a project's existing ones: `ord` goes on from the project's greatest."""
    last = existing.groupBy("project_id").agg(F.max("ord").alias("_last"))
    moved = new.join(last, "project_id", "left").withColumn("ord", F.col("ord") + F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last")
    return existing.unionByName(moved)


def session_facts(rows: DataFrame) -> DataFrame:
    """(project_id, session_id, fact_ids): ids of a session's facts, in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "fact_id"))), lambda x: x["fact_id"])
    return rows.groupBy("project_id", "session_id").agg(ids.alias("fact_ids"))
