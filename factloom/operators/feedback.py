"""Implicit feedback: rewards for returned facts from what was saved since.

A returned fact is rewarded by its greatest cosine with the project's last facts.  As in the original behaviour the fact itself may be
among these, which gives it full reward; `exclude_self` leaves it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import vectors
from factloom.operators.rerank import Reranker, Stats, features_of, stats_of
from factloom.operators.windows import newest

RECENT = 50
HIGH, LOW = 0.55, 0.3


def reward_of(similarity: Column) -> Column:
    """The similarity itself above HIGH, 0 below LOW, null (no observation) between, both bounds included."""
    return F.when(similarity > HIGH, similarity).when(similarity < LOW, 0.0)


def similarities(log: DataFrame, facts: DataFrame, recent: int = RECENT, exclude_self: bool = False) -> DataFrame:
    """(search_id, project_id, fact_id, query_embedding, embedding, similarity) of each returned fact that has a vector.

    `recent` bounds the facts that each one meets; records whose fact is not in the project fall out.
    """
    known = facts.where("embedding IS NOT NULL").select("project_id", "fact_id", "ord", "embedding")
    last = newest(facts, ["project_id"], [F.desc("ord")], recent).where("embedding IS NOT NULL").select("project_id", F.col("fact_id").alias("_other"), F.col("embedding").alias("_recent"))
    returned = log.select("search_id", "project_id", "query_embedding", F.explode("returned_fact_ids").alias("fact_id")).join(known, ["project_id", "fact_id"])
    # one fact may be returned by many searches: meet the recent facts once
    each = returned.select("project_id", "fact_id", "embedding").dropDuplicates(["project_id", "fact_id"]).join(last, "project_id", "left")
    if exclude_self:
        each = each.withColumn("_recent", F.when(F.col("_other") != F.col("fact_id"), F.col("_recent")))
    near = each.groupBy("project_id", "fact_id").agg(F.greatest(F.lit(0.0), F.coalesce(F.max(vectors.cosine(F.col("embedding"), F.col("_recent"))), F.lit(0.0))).alias("similarity"))
    return returned.join(near, ["project_id", "fact_id"]).select("search_id", "project_id", "fact_id", "query_embedding", "embedding", "similarity")


def rewards(log: DataFrame, facts: DataFrame, recent: int = RECENT, exclude_self: bool = False) -> DataFrame:
    """`similarities` with `reward`, observations only."""
    return similarities(log, facts, recent, exclude_self).withColumn("reward", reward_of(F.col("similarity"))).where("reward IS NOT NULL AND size(query_embedding) = size(embedding)")


def observed(log: DataFrame, facts: DataFrame, model: Reranker, recent: int = RECENT, exclude_self: bool = False) -> Stats:
    rows = rewards(log, facts, recent, exclude_self)
    return stats_of(rows.select(features_of(model, F.col("query_embedding"), F.col("embedding")).alias("phi"), "reward"), len(model.mu))


def learned(log: DataFrame, facts: DataFrame, model: Reranker, recent: int = RECENT, exclude_self: bool = False) -> Reranker:
    """The model after the feedback in a search log."""
    return model.updated(observed(log, facts, model, recent, exclude_self))
