"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.shared import kept

#: Skinny rows that are broadcast at most.
BROADCAST = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a skinny result once, replicated in the shared folder, so that several consumers (and retries) reuse it."""
    return kept(df)


def small(df: DataFrame) -> DataFrame:
    """Marked for a broadcast join if it has at most BROADCAST rows (it is counted); left to a shuffled one beyond that."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def hex_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable over `edges`, by alternating large-star and small-star rounds; nodes that
    are their own label are left out.

    A round only groups with partial minima and joins; no neighbourhood is collected.  Lineage is cut by a checkpoint per
    round.  The number of rounds is logarithmic in practice.  Self loops and repeated edges are harmless; nodes are of any type with an order.
    """
    links = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("l")).select("l.u", "l.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # the row of the least neighbour stands for the node itself
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = cut(small.where("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("label"))


def group_pairs(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of n items, given index pairs."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label
