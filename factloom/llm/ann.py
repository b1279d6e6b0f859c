"""Approximate nearest neighbours by cosine: a forest of random-projection trees and exact reranking.

The trees are fitted on the driver on a bounded sample (SAMPLE rows) of the unit vectors: a node's direction is random, its cut the
median of its points' projections.  Every row is then indexed: it goes to one leaf of each tree.  A query searches all trees
through one shared priority queue, ordered by the squared margins by which it misses a node's cuts, and takes leaves until they
hold PROBE of the sample, or LEAST points where that is more.  Queries and rows meet by leaf; leaves get smaller as the table grows, and a
leaf of many rows (told from the sample) is dealt to several tasks.  Candidates are scored exactly on the original vectors in
doubles, and a task returns at most k rows for each query.  With `exact`, queries visit all leaves of one tree, that is, all rows.

Copies of one vector would all meet in one leaf.  They have the same score and ties go to the smaller id, so of equal vectors
only the k + 1 smallest ids can be in a result (one may be the query itself); only those are indexed, all of them are queries.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part; vectors of unlike lengths are padded
with zeros; fewer than k candidates found: all that were; rows of one id are one item, as a query and as a candidate: two items' score is the
greatest of their rows' cosines, and an item never meets itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut
from factloom.llm.topk import best_of, matrix, widened
from factloom.llm.vectors import ranked, usable

SAMPLE = 65536
TREES = 4
#: Leaves of a tree at least and, where the table has a leaf for every TASK rows, at most; and the fewest sample points of one.
LEAVES = 128
MOST_LEAVES = 1024
LEAF = 48
#: What a query's leaves hold of the sample, over all trees, as a share of it; at least LEAST points.  Recall needs it this large
#: for vectors without structure (measured in README); vectors with clusters do with far less.
PROBE = 0.8
LEAST = 4096
#: Rows of a leaf that one task takes, on average.
TASK = 16384


class Forest:
    def __init__(self, sample: np.ndarray, total: int = 0, exact: bool = False, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.width, self.n, self.exact = sample.shape[1], len(sample), exact
        leaves = min(MOST_LEAVES, max(LEAVES, total // TASK))
        self.roots: list[int] = []
        direction: list[np.ndarray] = []
        self.cut: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.held: list[int] = []  # sample points of a leaf
        for _ in range(1 if exact else TREES):
            self.roots.append(len(self.kids))
            todo = [(self._node(), np.arange(len(sample)))]
            while todo:
                node, rows = todo.pop()
                v = rng.normal(size=self.width)
                x = sample[rows] @ v
                cut = float(np.median(x)) if len(rows) else 0.0
                left = x <= cut
                if len(rows) <= max(LEAF, self.n // leaves) or left.all():
                    self.held[node] = len(rows)
                    continue
                kids = self._node(), self._node()
                self.kids[node], self.cut[node] = kids, cut
                direction.append((node, v / np.linalg.norm(v)))
                self.cut[node] = cut / np.linalg.norm(v)
                todo += [(kids[0], rows[left]), (kids[1], rows[~left])]
        self.direction = np.zeros((len(self.kids), self.width), dtype=np.float32)
        for node, v in direction:
            self.direction[node] = v
        self.cut = np.array(self.cut)
        # tasks of each leaf, if it holds the sample's share of all rows
        self.tasks = {i: -(-x * total // (self.n * TASK)) for i, x in enumerate(self.held) if x * total > self.n * TASK}

    def _node(self) -> int:
        self.kids.append((-1, -1))
        self.cut.append(0.0)
        self.held.append(0)
        return len(self.kids) - 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        kids, out = np.array(self.kids), []
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := np.nonzero(kids[at, 0] >= 0)[0]).size:
                node = at[inner]
                side = np.einsum("ij,ij->i", x[inner], self.direction[node]) > self.cut[node]
                at[inner] = kids[node, side.astype(int)]
            out.append(at)
        return np.stack(out, axis=1)

    def probe(self, x: np.ndarray) -> list[int]:
        """Leaves in the order of the shared queue, until they hold enough."""
        margin = self.direction @ x - self.cut
        want, out = float("inf") if self.exact else max(PROBE * self.n, LEAST), []
        queue = [(0.0, root) for root in self.roots]
        while queue and want > 0:
            missed, node = heapq.heappop(queue)
            if self.kids[node][0] < 0:
                out.append(node)
                want -= max(1, self.held[node])
                continue
            m = float(margin[node])
            heapq.heappush(queue, (missed + max(0.0, m) ** 2, self.kids[node][0]))
            heapq.heappush(queue, (missed + max(0.0, -m) ** 2, self.kids[node][1]))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]


def best(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine): each query's k nearest of p.

    Matrix products find them; the cosines that count are then summed pair by pair, so that equal vectors have equal scores
    wherever they lie.
    """
    q, p = widened(q, p)
    q_norm, p_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((p * p).sum(axis=1))
    out = []
    repeated = len(np.unique(p_ids)) < len(p_ids)
    for at in range(0, len(q), 512):
        rough = (q[at : at + 512] @ p.T) / (q_norm[at : at + 512, None] * p_norm[None, :])
        for i, own in enumerate(q_ids[at : at + 512], at):
            some = np.nonzero(p_ids != own)[0]
            near = rough[i - at, some]
            if len(some) > k and not repeated:
                some = some[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9]
            score = (q[i] * p[some]).sum(axis=1) / (q_norm[i] * p_norm[some])
            out += [(own, p_ids[some[j]], score[j]) for j in best_of(score, p_ids[some], k, repeated)]
    return out


def nearest(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by `every`; `exact` looks at all rows."""
    spark = vectors.sparkSession
    good = usable(F.col(f"`{vector_col}`")) & F.exists(F.col(f"`{vector_col}`"), lambda x: x != 0) & F.col(f"`{id_col}`").isNotNull()
    rows = vectors.where(good).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double")).alias("v"))
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    # one more than k of each vector, as one may be the query itself
    items = cut(rows.distinct().withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n"))
    sample = items.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    schema = "query_id long, vec_id long, score double"
    if not len(sample):
        return ranked(spark.createDataFrame([], schema), k)
    forest = spark.sparkContext.broadcast(Forest(unit(matrix(sample["v"])), items.count(), exact))

    def index(batches):
        own = forest.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                some = batch.iloc[at : at + 2048]
                found = own.leaves(fitted(unit(matrix(some["v"])), own.width))
                ids, trees = some["vec_id"].to_numpy(), found.shape[1]
                many = np.array([own.tasks.get(x, 1) for x in found.ravel().tolist()], dtype=np.uint64)
                task = (np.repeat(ids, trees).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % many
                yield pd.DataFrame({"leaf": found.ravel(), "task": task.astype(np.int64), "vec_id": np.repeat(ids, trees), "v": some["v"].repeat(trees).to_numpy()})

    def probe(batches):
        own = forest.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                rows = [(i, leaf, task) for i, x in enumerate(fitted(unit(matrix(some["v"])), own.width)) for leaf in own.probe(x) for task in range(own.tasks.get(leaf, 1))] if len(some) else []
                i, leaf, task = np.array(rows, dtype=np.int64).reshape(-1, 3).T
                yield pd.DataFrame({"leaf": leaf, "task": task, "vec_id": some["vec_id"].to_numpy()[i], "v": some["v"].to_numpy()[i]})

    shape = "leaf long, task long, vec_id long, v array<double>"
    have = items.mapInPandas(index, shape)
    asked = rows.where(F.col("vec_id") % every == 0).mapInPandas(probe, shape)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            out = best(matrix(left["v"]), left["vec_id"].to_numpy(), matrix(right["v"]), right["vec_id"].to_numpy(), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = asked.groupBy("leaf", "task").cogroup(have.groupBy("leaf", "task")).applyInPandas(meet, schema)
    # one candidate may come from several trees
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
