"""SimHash near-duplicate groups found with vantage-point trees.

Fingerprints: 64 bits over 4-word shingles.  Linking is exact: every pair of fingerprints at Hamming distance <= radius
is found.  The way there:

1. Equal fingerprints become one class (a map-side combined minimum), so copies never meet as pairs.
2. The driver grows the top of a vantage-point tree from a bounded sample (`SAMPLE` fingerprints); its leaves are the shards.
   The sample only steers balance; any tree gives the same links.
3. Each fingerprint has one home shard, and by the triangle inequality it can only have neighbours in the shards whose
   boundary its ball of radius r overlaps.  A task owns a pair of shards and gets of each side only what reaches the other.
4. A task grows a vantage-point tree over one side, walks the other side through it in batches pruning by the triangle bounds,
   and returns a spanning forest of the links it saw, so a group of g near copies yields fewer than g rows, not g^2.
5. Components of the links.  A class is known by its smallest doc_id (and its fingerprint), so the smallest node of a component
   bears the smallest doc_id: nothing is grouped or joined by component.

Edge cases: null text counts as empty; very long texts are hashed whole, in blocks of shingles; rows without a doc_id have the greatest place in the order; no words give fingerprint zero, linked like any other; under four words the whole
sequence is the only shingle; repeated rows (also of one doc_id) keep their rows; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import components, cut, group_pairs, small

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints that the driver sees to lay out shards.
SAMPLE = 8192
#: Fingerprints of a shard, on average.
SHARD = 65536
LEAF = 48
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, counts = n - width + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, total, BLOCK):
        to = min(total, at + BLOCK)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def distance(codes: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(codes ^ vantage)


class Shards:
    """The top of a vantage-point tree in heap order: node i has children 2i+1 (inside) and 2i+2 (outside)."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.vantage = np.zeros((1 << depth) - 1, dtype=np.uint64)
        self.cut = np.full((1 << depth) - 1, 32, dtype=np.int16)
        held = {0: sample}
        for node in range(len(self.vantage)):
            codes = held.pop(node, sample[:0])
            if len(codes):
                self.vantage[node] = codes[len(codes) // 3]
                far = distance(codes, self.vantage[node])
                self.cut[node] = np.partition(far, (len(far) - 1) // 2)[(len(far) - 1) // 2]
                held[2 * node + 1], held[2 * node + 2] = codes[far <= self.cut[node]], codes[far > self.cut[node]]

    def place(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Home leaf of each code, and which leaves its ball overlaps."""
        home = np.zeros(len(codes), dtype=np.int32)
        reach = [np.ones(len(codes), dtype=bool)]
        for node in range(len(self.vantage)):
            far = distance(codes, self.vantage[node]).astype(np.int16)
            at = home == node
            home[at] = np.where(far[at] <= self.cut[node], 2 * node + 1, 2 * node + 2)
            reach += [reach[node] & (far <= self.cut[node] + radius), reach[node] & (far > self.cut[node] - radius)]
        first = (1 << self.depth) - 1
        return home - first, np.stack(reach[first:], axis=1)


def near_pairs(points: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (point, query) within the radius, by a vantage-point tree over the points walked by all queries at once."""
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF:
            v = points[p[len(p) // 2]]
            far = distance(points[p], v).astype(np.int16)
            mid = np.partition(far, (len(far) - 1) // 2)[(len(far) - 1) // 2]
            inside = far <= mid
            if not inside.all():
                own = distance(queries[q], v).astype(np.int16)
                todo += [(p[inside], q[own <= mid + radius]), (p[~inside], q[own > mid - radius])]
                continue
        for at in range(0, len(q), step := max(1, (1 << 21) // len(p))):
            some = q[at : at + step]
            left, right = np.nonzero(np.bitwise_count(points[p][:, None] ^ queries[some][None, :]) <= radius)
            yield p[left], some[right]


def spanning(codes: np.ndarray, sides: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two index sets of codes, as index pairs."""
    left, right, pending = [], [], 0
    label = np.arange(len(codes))
    for a, b in near_pairs(codes[sides[0]], codes[sides[1]], radius):
        left.append(sides[0][a])
        right.append(sides[1][b])
        pending += len(a)
        if pending > 1 << 21:
            label = group_pairs(len(codes), np.concatenate(left), np.concatenate(right))
            left, right, pending = [np.arange(len(codes))], [label], 0
    if left:
        label = group_pairs(len(codes), np.concatenate(left), np.concatenate(right))
    moved = np.nonzero(label != np.arange(len(codes)))[0]
    return moved, label[moved]


def node(least: Column, fp: Column) -> Column:
    """A class of equal fingerprints, in the order of its smallest doc_id; classes without one come last."""
    return F.struct(least.isNull().alias("none"), least.alias("least"), fp.alias("fp"))


def link(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges between nodes, whose components are those of all links between the distinct fingerprints of `classes` (fp, least)."""
    spark = classes.sparkSession
    n = classes.count()
    sample = classes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    depth = max(0, math.ceil(math.log2(max(1, n) / SHARD)))
    shards = spark.sparkContext.broadcast(Shards(sample, depth))
    width = 1 << depth
    kind = classes.schema["least"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                codes = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                home, reach = shards.value.place(codes.view(np.uint64), radius)
                row, other = np.nonzero(reach)
                own = home[row].astype(np.int64)
                pair = np.minimum(own, other) * width + np.maximum(own, other)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(own.astype(np.int32)), pa.array(codes[row]), batch.column(1).take(pa.array(row + at))], names=["pair", "home", "fp", "least"])

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = divmod(key[0].as_py(), width)
        codes, home = rows.column("fp").to_numpy().astype(np.int64).view(np.uint64), rows.column("home").to_numpy()
        ends = spanning(codes, (np.nonzero(home == low)[0], np.nonzero(home == high)[0]), radius)
        return pa.table({f"{side}_{c}": rows.column(c).take(pa.array(x)) for side, x in zip("ab", ends, strict=True) for c in ("fp", "least")})

    placed = classes.select("fp", "least").mapInArrow(place, f"pair long, home int, fp long, least {kind}")
    edges = placed.groupBy("pair").applyInArrow(search, f"a_fp long, a_least {kind}, b_fp long, b_least {kind}")
    return edges.select(node(F.col("a_least"), F.col("a_fp")).alias("a"), node(F.col("b_least"), F.col("b_fp")).alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: (doc_id, fp, component_id), component_id being the smallest doc_id reachable over links."""
    marks = cut(fingerprints(docs, id_col, text_col))
    classes = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(link(classes, radius)).select(F.col("node.fp").alias("_fp"), F.col("label.least").alias("_first"), F.lit(True).alias("_linked"))
    named = classes.join(groups, classes.fp == groups._fp, "left").select("fp", F.when(F.col("_linked"), F.col("_first")).otherwise(F.col("least")).alias("component_id"))
    # many documents may share a fingerprint: few classes are broadcast, beyond that Spark splits the documents of a skewed one
    return marks.join(small(cut(named)), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents less all but the smallest doc_id of each group; repeated rows of that doc_id leave one.

    Rows without a doc_id have no place in a group's order and stay.
    """
    quoted = F.col(f"`{id_col}`")
    columns = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), quoted.alias("_id"))
    found = cut(near_duplicates(docs.where(quoted.isNotNull()), id_col, text_col).select("doc_id", "component_id"))
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    out = rows.join(small(gone), F.col("_id") == F.col("_gone"), "left_anti")
    repeated = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1")
    if repeated.limit(1).count():
        out = out.where("_id IS NULL").union(out.where("_id IS NOT NULL").dropDuplicates(["_id"]))
    return out.select(*columns)
