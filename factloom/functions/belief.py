"""Beta beliefs about a fact's utility."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6
SAME_MEAN = 1e-4


def mean(alpha: Column, beta: Column) -> Column:
    return alpha.cast("double") / (alpha.cast("double") + beta.cast("double"))


def uninformed(alpha: Column, beta: Column) -> Column:
    """Still at the uniform prior."""
    return (F.abs(alpha - 1) < EPSILON) & (F.abs(beta - 1) < EPSILON)


def equals(alpha: Column, beta: Column, value: Column) -> Column:
    return F.abs(mean(alpha, beta) - value) < SAME_MEAN


def compared(alpha: Column, beta: Column, value: Column) -> Column:
    """-1, 0 or 1: how the mean stands to a value; null where it can't be told."""
    m = mean(alpha, beta)
    return F.when(~F.isnan(m) & ~F.isnan(value), F.signum(m - value).cast("int"))


def sample(alpha: Column, beta: Column, key: Column, seed: int = 0) -> Column:
    """A draw from Beta(alpha, beta) for each key; invalid parameters count as (1, 1).  Keyed, so that a retried task draws the same."""

    @F.pandas_udf("double")
    def draw(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, k in parts:
            a, b = a.to_numpy(dtype=float), b.to_numpy(dtype=float)
            bad = ~((a > 0) & (b > 0) & np.isfinite(a) & np.isfinite(b))
            a, b = np.where(bad, 1.0, a), np.where(bad, 1.0, b)
            yield pd.Series([np.random.default_rng((seed, int(x) & (2**63 - 1))).beta(p, q) for p, q, x in zip(a, b, k, strict=True)])

    return draw(alpha.cast("double"), beta.cast("double"), F.xxhash64(key))
