"""Reranker weights and posterior states on any store that Spark reads."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom.operators.rerank import Reranker, decode, encode

STATE = "updates long, mu array<double>, sigma array<double>"


def read_weights(spark: SparkSession, path: str) -> Reranker:
    """The weights of one file; they are small enough to broadcast by nature (features times vector width)."""
    return decode(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def write_weights(spark: SparkSession, model: Reranker, path: str) -> None:
    """The weights as one file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(encode(model)))
    out.close()


def append_state(spark: SparkSession, model: Reranker, path: str) -> None:
    """A version of the posterior, by its number of updates."""
    row = [(model.updates, model.mu.tolist(), model.sigma.ravel().tolist())]
    spark.createDataFrame(row, STATE).coalesce(1).write.mode("append").parquet(path)


def latest_state(spark: SparkSession, prior: Reranker, path: str) -> Reranker:
    """The version with the most updates, if it fits the model."""
    row = spark.read.schema(STATE).parquet(path).orderBy(F.desc("updates")).first()
    if row is None:
        return prior
    d = len(prior.mu)
    if len(row.mu) != d or len(row.sigma) != d * d:
        raise ValueError(f"a posterior of {len(row.mu)} features; the model has {d}")
    return replace(prior, mu=np.array(row.mu), sigma=np.array(row.sigma).reshape(d, d), updates=row.updates)
