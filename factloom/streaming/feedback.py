"""Draining the search log as a stream, and the posterior as its state.

foreachBatch writes are at least once, so each micro-batch overwrites the part of the state that bears its id; a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.rerank import Reranker, Stats, stats_of


def drain(stream: DataFrame, to: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame]) -> None:
    """Takes all records that the checkpoint has not seen, once each, and appends `shape(batch)` to Parquet under `to`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/*")


def learn(stream: DataFrame, to: str, checkpoint: str, hidden: int, observe: Callable[[DataFrame], DataFrame]) -> None:
    """Adds up the feedback sums of each micro-batch: `observe(batch)` has rows (phi, reward)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        own = stats_of(observe(batch), hidden)
        row = [(own.gram.ravel().tolist(), own.moment.tolist(), own.total.tolist(), own.n)]
        batch.sparkSession.createDataFrame(row, "gram array<double>, moment array<double>, total array<double>, n long").write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def state(spark: SparkSession, path: str, hidden: int) -> Stats:
    """The sums of all micro-batches so far."""
    flat = drained(spark, path).select("n", F.posexplode(F.concat("gram", "moment", "total"))).groupBy("pos").agg(F.sum("col").alias("x"), F.sum("n").alias("n")).orderBy("pos").collect()
    x, size = np.array([r.x for r in flat]), hidden * hidden
    return Stats(x[:size].reshape(hidden, hidden), x[size : size + hidden], x[size + hidden :], int(flat[0].n))


def posterior(spark: SparkSession, path: str, prior: Reranker) -> Reranker:
    return prior.updated(state(spark, path, len(prior.mu)))
