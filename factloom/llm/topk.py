"""Exact top-k inner products by norm buckets.

Vectors are grouped by length: at most RANGES ranges of norm (limits from all rows' quantiles), each dealt into buckets of about BUCKET
rows.  Every query first scores one bounded set, SEEDS vectors of the greatest norm, which gives a lower limit of its k-th best score.  A query
meets a bucket only if its norm times the bucket's greatest norm reaches that limit.  Within a bucket the limit becomes a local
cosine threshold, limit / (|q| |p|max) (none for limits below zero), and the bucket takes one of two prunings: where the threshold is low, by length (the
prefix of its vectors, longest first, that can reach the limit), where it is high, by coordinate (the vectors whose component in
the query's largest coordinate lies in the interval that the threshold allows).  What is left is verified by exact products.
Queries meet buckets in blocks; a task holds QUERIES queries and one bucket, and returns at most k rows for each query.  Queries are
put into blocks by the norm that they need of a candidate, and a bucket goes only to the blocks of which a query asks for it.

Edge cases: vectors that are null or hold null or non-finite components take no part; vectors of unlike lengths are padded with zeros;
ties go to the smaller id; fewer than k candidates: all; rows of one id are one item, as a query and as a candidate: two items' score is the
greatest of their rows' products, and an item never meets itself; products beyond 64 bits are reported as the nearest 64-bit
number; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut
from factloom.llm.vectors import ranked, usable

RANGES = 32
BUCKET = 8192
QUERIES = 2048
SEEDS = 2048
#: Ranges of the norm that queries need, by which they are put into blocks.
SHELVES = 64
#: Local cosine threshold from which a bucket is pruned by coordinate.
STEEP = 0.6
#: Products below this are exact in doubles.
EXACT = 2.0**53


def matrix(rows: pd.Series) -> np.ndarray:
    width = max((len(x) for x in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if q.size and p.size and np.abs(q).max() * np.abs(p).max() * q.shape[1] >= EXACT:
        whole = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in p] for x in q]
        return np.array([[max(-(2**63), min(2**63 - 1, v)) for v in row] for row in whole], dtype=np.int64).reshape(len(q), len(p))
    return (q @ p.T).astype(np.int64)


def best_of(score: np.ndarray, ids: np.ndarray, k: int, repeated: bool = True) -> np.ndarray:
    """Indices of the k best by (score desc, id), one for each id; `repeated`: whether ids can occur more than once."""
    if not repeated and len(score) > 4 * k:
        at = np.nonzero(score >= np.partition(score, len(score) - k)[len(score) - k])[0]
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    order = np.lexsort((ids, -score))
    if repeated:
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    return order[:k]


def search_bucket(q: np.ndarray, q_ids: np.ndarray, limit: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) rows of one bucket: each query's k best that reach its limit."""
    q, p = widened(q, p)
    p_norm, q_norm = np.linalg.norm(p, axis=1), np.linalg.norm(q, axis=1)
    order = np.argsort(-p_norm, kind="stable")
    p, p_ids, p_norm = p[order], p_ids[order], p_norm[order]
    reach = q_norm * p_norm[0] * (1 + 1e-9) + 1e-6
    todo = np.nonzero(reach >= limit)[0]
    if not len(todo):
        return []
    # below zero, shorter vectors reach the limit at smaller cosines than the longest do: no threshold holds for all
    local = np.where(limit[todo] < 0, -1.0, limit[todo] / reach[todo])
    out: list[tuple[int, int, int]] = []
    repeated = len(np.unique(p_ids)) < len(p_ids)

    def verify(i: int, some: np.ndarray | slice, score: np.ndarray | None = None) -> None:
        ids = p_ids[some]
        score = products(q[i : i + 1], p[some])[0] if score is None else score
        at = np.nonzero((ids != q_ids[i]) & (score >= limit[i]))[0]
        at = at[best_of(score[at], ids[at], k, repeated)]
        out.extend((int(q_ids[i]), int(ids[j]), int(score[j])) for j in at)

    if np.median(local) >= STEEP:  # by coordinate
        unit = p / np.maximum(p_norm, 1e-300)[:, None]
        sorted_by: dict[int, np.ndarray] = {}
        for i, theta in zip(todo, local, strict=True):
            f = int(np.argmax(np.abs(q[i])))
            if f not in sorted_by:
                sorted_by[f] = np.argsort(unit[:, f], kind="stable")
            # unit vectors at angles alpha and beta to axis f: their cosine is at most cos(alpha - beta)
            alpha, phi = np.arccos(np.clip(q[i, f] / max(q_norm[i], 1e-300), -1, 1)), np.arccos(np.clip(theta, -1, 1))
            low, high = np.cos(min(np.pi, alpha + phi)), np.cos(max(0.0, alpha - phi))
            column = unit[sorted_by[f], f]
            a, b = np.searchsorted(column, low - 1e-9), np.searchsorted(column, high + 1e-9, side="right")
            verify(i, sorted_by[f][a:b])
        return out
    # by length: each query's prefix; blocks of queries share a matrix product
    counts = np.searchsorted(-p_norm, -(limit[todo] / np.maximum(q_norm[todo], 1e-300)) * (1 - 1e-9) + 1e-9, side="right")
    counts = np.where(limit[todo] <= 0, len(p), counts)
    for at in range(0, len(todo), 256):
        some, n = todo[at : at + 256], counts[at : at + 256]
        if not n.max():
            continue
        score = products(q[some], p[: n.max()])
        for row, (i, many) in enumerate(zip(some, n, strict=True)):
            verify(i, slice(0, many), score[row, :many])
    return out


def search(items: DataFrame, queries: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) over rows (vec_id, v array<double> of integers); `queries` tells which rows are queries."""
    rows = cut(items.distinct().select("vec_id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")))
    spark = rows.sparkSession
    n, limits = rows.agg(F.count("*"), F.percentile_approx("norm", [i / RANGES for i in range(1, RANGES)], 10000)).first()
    schema = "query_id long, vec_id long, score long"
    if not n:
        return ranked(spark.createDataFrame([], schema), k)
    limits = sorted(set(limits))
    level = F.lit(0)
    for i, x in enumerate(limits):
        level = F.when(F.col("norm") > x, i + 1).otherwise(level)
    dealt = rows.withColumn("level", level)
    sizes = {r.level: (max(1, -(-r.n // BUCKET)), r.most) for r in dealt.groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()}
    many = F.coalesce(*(F.when(F.col("level") == x, m) for x, (m, _) in sizes.items()))
    bucket = (F.col("level") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), many)).cast("long")

    # a limit for each query, from the longest vectors
    top = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).toPandas()
    seeds = spark.sparkContext.broadcast((matrix(top["v"]), top["vec_id"].to_numpy()))

    def limited(batches):
        p, p_ids = seeds.value
        repeated = len(np.unique(p_ids)) < len(p_ids)
        for batch in batches:
            out = np.full(len(batch), -np.inf)
            if len(batch):
                q, wide = widened(matrix(batch["v"]), p)
                score = products(q, wide)
                for i, x in enumerate(batch["vec_id"]):
                    some = np.nonzero(p_ids != x)[0]
                    own = best_of(score[i][some], p_ids[some], k, repeated)
                    if len(own) == k:
                        out[i] = score[i][some[own[-1]]]
            yield batch.assign(limit=out)

    asked = cut(rows.where(queries).mapInPandas(limited, "vec_id long, v array<double>, norm double, limit double"))
    blocks = max(1, -(-asked.count() // QUERIES))
    none = F.expr("cast(array() as array<long>)")

    def buckets(x: int) -> Column:
        """The buckets of a level that a query has to meet."""
        many, most = sizes[x]
        meets = (F.col("norm") * most * (1 + 1e-9) + 1e-6 >= F.col("limit")) | (F.col("limit") == float("-inf"))
        return F.when(meets, F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda s: (F.lit(x) * (1 << 32) + s).cast("long"))).otherwise(none)

    places = F.flatten(F.array(*(buckets(x) for x in sizes)))
    # the norm that a candidate needs for this query; queries that need alike share blocks
    need = F.when(F.col("norm") > 0, F.col("limit") / F.col("norm")).otherwise(F.lit(float("-inf")))
    shelves = min(blocks, SHELVES)
    points = [] if shelves == 1 else sorted(set(asked.agg(F.percentile_approx(need, [i / shelves for i in range(1, shelves)], 10000)).first()[0] or []))
    shelf = F.lit(0)
    for i, x in enumerate(points):
        shelf = F.when(need > x, i + 1).otherwise(shelf)
    block = shelf.cast("long") * blocks + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(-(-blocks // shelves)))
    asks = asked.withColumn("block", block).withColumn("bucket", F.explode(places)).select("block", "bucket", "vec_id", "v", "limit")
    pairs = asks.select(F.col("block").alias("_block"), F.col("bucket").alias("_bucket")).distinct()
    have = dealt.withColumn("_own", bucket).join(pairs, F.col("_own") == F.col("_bucket")).select(F.col("_block").alias("block"), F.col("_bucket").alias("bucket"), "vec_id", "v")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            rows = search_bucket(matrix(left["v"]), left["vec_id"].to_numpy(), left["limit"].to_numpy(), matrix(right["v"]), right["vec_id"].to_numpy(), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = asks.groupBy("block", "bucket").cogroup(have.groupBy("block", "bucket")).applyInPandas(meet, schema)
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def integers(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): components turned into floor(scale * x), x as double; held as doubles, which is exact for them."""
    own = vectors.where(usable(F.col(f"`{vector_col}`")))

    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return own.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(F.col(f"`{vector_col}`"), whole).alias("v"))


def exact_top(vectors: DataFrame, every: int, k: int, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Queries: rows whose id is divisible by `every`."""
    return search(integers(vectors, scale, id_col, vector_col).where("vec_id IS NOT NULL"), F.col("vec_id") % every == 0, k)
