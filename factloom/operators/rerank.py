"""Reranking by a small frozen feature layer and a Bayesian linear last layer.

Features are relu(W1 x + b1) with x = [q, c] (version 1) or [q, c, q*c, |q-c|] (version 2).  The last layer has a Gaussian
posterior N(mu, Sigma) over its weights and a fixed bias.  As features and rewards depend on neither, the posterior after any
number of updates is a function of sums (`Stats`), which add up over tasks and micro-batches in any order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = 0.3
FLOOR = 1e-8
WIDTHS = {1: 2, 2: 4}
MAGIC = {b"BLL1": 1, b"BLL2": 2}
POSTERIOR = b"BPO1"


@dataclass(frozen=True)
class Reranker:
    version: int
    w1: np.ndarray
    b1: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    bias: float
    sigma_sq: float
    updates: int = 0
    dim: int = field(init=False)

    def __post_init__(self) -> None:
        if self.w1.shape[1] % WIDTHS[self.version]:
            raise ValueError("the feature layer's width does not fit its version")
        object.__setattr__(self, "dim", self.w1.shape[1] // WIDTHS[self.version])

    def features(self, query: np.ndarray, facts: np.ndarray) -> np.ndarray:
        """A row of features for each row of `facts`; `query` is one vector or a row for each."""
        c = np.asarray(facts, dtype=float)
        q = np.broadcast_to(np.asarray(query, dtype=float), c.shape)
        if c.shape[1] != self.dim:
            raise ValueError(f"vectors of {c.shape[1]} components; the reranker takes {self.dim}")
        x = [q, c] if self.version == 1 else [q, c, q * c, np.abs(q - c)]
        return np.maximum(np.concatenate(x, axis=1) @ self.w1.T + self.b1, 0)

    def predict(self, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance for rows of features."""
        return phi @ self.mu + self.bias, np.maximum(np.einsum("ij,jk,ik->i", phi, self.sigma, phi) + self.sigma_sq, FLOOR)

    def updated(self, stats: Stats) -> Reranker:
        """The posterior after all observations in `stats`; this one is the prior."""
        if not stats.n:
            return self
        before = np.linalg.inv(self.sigma)
        after = np.linalg.inv(before + stats.gram / self.sigma_sq)
        mu = after @ (before @ self.mu + (stats.moment - self.bias * stats.total) / self.sigma_sq)
        return replace(self, mu=mu, sigma=(after + after.T) / 2, updates=self.updates + stats.n)


@dataclass
class Stats:
    """Sums over observations (phi, reward): phi phi^T, phi reward, phi, and their number."""

    gram: np.ndarray
    moment: np.ndarray
    total: np.ndarray
    n: int

    @classmethod
    def of(cls, phi: np.ndarray, reward: np.ndarray) -> Stats:
        return cls(phi.T @ phi, phi.T @ reward, phi.sum(axis=0), len(phi))

    def __add__(self, other: Stats) -> Stats:
        return Stats(self.gram + other.gram, self.moment + other.moment, self.total + other.total, self.n + other.n)


def _floats(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    if len(data) < 4 * n:
        raise ValueError("the weight file is too short")
    return np.frombuffer(data[: 4 * n], dtype="<f4").astype(float), data[4 * n :]


def decode(content: bytes) -> Reranker:
    """Weights: magic, dim and features (u32), noise (f32), then W1, b1, prior mean, its bias, prior variances (f32, little-endian)."""
    version = MAGIC.get(bytes(content[:4]))
    if version is None:
        raise ValueError("not a weight file")
    dim, hidden, noise = struct.unpack_from("<IIf", content, 4)
    rest = memoryview(content)[16:]
    w1, rest = _floats(rest, hidden * dim * WIDTHS[version])
    b1, rest = _floats(rest, hidden)
    mu, rest = _floats(rest, hidden)
    bias, rest = _floats(rest, 1)
    variance, _ = _floats(rest, hidden)
    return Reranker(version, w1.reshape(hidden, -1), b1, mu, np.diag(variance), float(bias[0]), noise)


def encode(model: Reranker) -> bytes:
    """The prior's file; of Sigma only the diagonal is kept."""
    parts = [model.w1.ravel(), model.b1, model.mu, [model.bias], np.diag(model.sigma)]
    return b"BLL%d" % model.version + struct.pack("<IIf", model.dim, len(model.b1), model.sigma_sq) + b"".join(np.asarray(p, dtype="<f4").tobytes() for p in parts)


def encode_posterior(model: Reranker) -> bytes:
    return POSTERIOR + struct.pack("<IQ", len(model.mu), model.updates) + model.mu.astype("<f4").tobytes() + model.sigma.astype("<f4").tobytes()


def decode_posterior(content: bytes, prior: Reranker) -> Reranker:
    """Nothing is taken over unless the whole file is good."""
    if bytes(content[:4]) != POSTERIOR:
        raise ValueError("not a posterior file")
    d, updates = struct.unpack_from("<IQ", content, 4)
    if d != len(prior.mu):
        raise ValueError(f"a posterior of {d} features; the model has {len(prior.mu)}")
    mu, rest = _floats(memoryview(content)[16:], d)
    sigma, _ = _floats(rest, d * d)
    return replace(prior, mu=mu, sigma=sigma.reshape(d, d), updates=updates)


def try_load(weights: str | Path, posterior: str | Path | None = None) -> Reranker | None:
    """The model of a weight file, with its posterior if there is a good one; None if there are no good weights."""
    try:
        model = decode(Path(weights).read_bytes())
    except (OSError, ValueError, struct.error):
        return None
    try:
        return decode_posterior(Path(posterior).read_bytes(), model) if posterior else model
    except (OSError, ValueError, struct.error):
        return model


def features_of(model: Reranker, query: Column, fact: Column) -> Column:
    """array<double> of features for two vector columns of the model's dimension; null where a vector is null or of another length."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, c in parts:
            out = pd.Series([None] * len(q), dtype=object)
            good = [i for i, (a, b) in enumerate(zip(q, c, strict=True)) if a is not None and b is not None and len(a) == len(b) == model.dim]
            if good:
                for i, row in zip(good, model.features(np.stack(q.iloc[good].to_list()), np.stack(c.iloc[good].to_list())), strict=True):
                    out.iat[i] = row
            yield out

    return run(query, fact)


def predicted_of(model: Reranker, query: Column, fact: Column) -> Column:
    """struct<mean, variance> for two vector columns of the model's dimension; null where a vector is null or of another length."""

    @F.pandas_udf("mean double, variance double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for phi in parts:
            out = np.full((len(phi), 2), np.nan)
            good = phi.notna().to_numpy()
            if good.any():
                out[good] = np.stack(model.predict(np.stack(phi[good].to_list())), axis=1)
            yield pd.DataFrame(out, columns=["mean", "variance"])

    phi = features_of(model, query, fact)
    return F.when(phi.isNotNull(), run(phi))


def mean_of(model: Reranker, query: list[float], fact: Column) -> Column:
    """The posterior mean for each fact vector; null where the vector is null or of another length than the query."""
    q = np.asarray(query, dtype=float)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in parts:
            out = np.full(len(c), np.nan)
            good = [i for i, x in enumerate(c) if x is not None and len(x) == len(q)]
            if good:
                out[good] = model.predict(model.features(q, np.stack(c.iloc[good].to_list())))[0]
            yield pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run(fact)


def reranked(hits: DataFrame, query: list[float], model: Reranker) -> DataFrame:
    """Replaces `score`: 0.7 norm + 0.3 sigmoid(mean).  Hits without a vector go; where lengths differ, norm itself is the score."""
    mean = F.col("_mean")
    rows = hits.where("embedding IS NOT NULL").withColumn("_mean", mean_of(model, query, F.col("embedding")))
    score = F.when(mean.isNull(), F.col("norm")).otherwise((1 - WEIGHT) * F.col("norm") + WEIGHT / (1 + F.exp(-mean)))
    return rows.withColumn("score", score)


def stats_of(observations: DataFrame, hidden: int) -> Stats:
    """Sums over rows (phi array<double>, reward double): a partial row from each task, added on the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Stats(np.zeros((hidden, hidden)), np.zeros(hidden), np.zeros(hidden), 0)
        for batch in batches:
            if len(batch):
                own = own + Stats.of(np.stack(batch["phi"].to_list()), batch["reward"].to_numpy(dtype=float))
        yield pd.DataFrame({"gram": [own.gram.ravel()], "moment": [own.moment], "total": [own.total], "n": [own.n]})

    parts = observations.where("phi IS NOT NULL AND reward IS NOT NULL").select("phi", "reward").mapInPandas(run, "gram array<double>, moment array<double>, total array<double>, n long")
    flat = parts.select("n", F.posexplode(F.concat("gram", "moment", "total"))).groupBy("pos").agg(F.sum("col").alias("x"), F.sum("n").alias("n")).orderBy("pos").collect()
    x = np.array([r.x for r in flat])
    size = hidden * hidden
    return Stats(x[:size].reshape(hidden, hidden), x[size : size + hidden], x[size + hidden :], int(flat[0].n)) if flat else Stats(np.zeros((hidden, hidden)), np.zeros(hidden), np.zeros(hidden), 0)
