"""Embedding cache: look up by key, compute what is missing, append it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.functions.embedding import Embedder, HashingEmbedder, embedded


def latest(cache: DataFrame, order: str = "pos") -> DataFrame:
    """(key, embedding): of a key that was written repeatedly, the last."""
    return cache.groupBy("key").agg(F.max_by("embedding", order).alias("embedding"))


def looked_up(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of `texts` with key, embedding (null if not cached) and hit."""
    keyed = texts.withColumn("key", text.cache_key(F.col("text")))
    return keyed.join(cache.select("key", "embedding"), "key", "left").withColumn("hit", F.col("embedding").isNotNull())


def missing(texts: DataFrame, cache: DataFrame, make: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """(key, embedding) to append: each text that is not cached, once."""
    keyed = texts.select(text.cache_key(F.col("text")).alias("key"), "text").where("text IS NOT NULL").dropDuplicates(["key"])
    return keyed.join(cache, "key", "left_anti").select("key", embedded(F.col("text"), make).alias("embedding"))


def append(rows: DataFrame, path: str) -> None:
    """Adds (key, embedding) rows to the stored cache; of a key that is there twice, `latest` takes the last."""
    rows.withColumn("pos", F.unix_micros(F.current_timestamp())).write.mode("append").parquet(path)
