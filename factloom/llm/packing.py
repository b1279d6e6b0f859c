"""Harmonic packing of token pieces into fixed-capacity sequences.

A piece of length l belongs to reciprocal class k = capacity // l: k pieces of the class fill one bin.  `pieces` cuts a document
so that each of its pieces wastes little in its class; `pack` then fills the bins of each class with exactly k pieces, on each
of many workers independently.  Class 1, a piece a bin, needs no worker.  What does not fill a bin on a worker (under k pieces a class) is
filled again by groups of FAN workers, what is left there by groups of FAN groups, and so on, so that no task sees more than FAN
times k pieces of a class.  The under k pieces a class that are left of the one last group stay together, as they fit one bin, and
these bundles, one a class, go first-fit into common bins.

Edge cases: null text counts as empty and still has its end id; documents of any length work (a piece never exceeds the
capacity); repeated rows are packed each; pieces that tie in length are taken in the order they were read; an empty table gives an
empty result; `pieces` reads no other columns, `pack` passes them through, whatever their names, and replaces sequence_id and offset.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

CAPACITY = 2048
END_ID = 1
#: Most of a bin that a class may leave empty before a piece is cut to the next class's size.
WASTE = 0.02
#: Pieces that one worker packs, on average, and workers (or groups of them) whose remainders meet in one task.
PER_WORKER = 1 << 14
FAN = 64
#: Bits of a sequence_id: level, class, worker or group, bin; a piece of class 1 has its own number in place of the last three.
LEVEL, CLASS, GROUP = 58, 46, 22
LAST = 15
VOCABULARY = "byte_bpe_50k.json"
#: Texts of these code points only: the two libraries' Unicode tables agree on them.
PLAIN = regex.compile(r"[\x00-\x7E¡-ɏ‐-‧€]*")
_encoders: dict = {}


def encoder(path: str, ranks_path: str | None):
    """texts -> list of id lists, equal to tokenizers' encode_batch(texts, add_special_tokens=False).

    Where the same vocabulary is at hand as ranks, texts of plain code points are encoded by the ranks, which gives the same
    ids at a third of the CPU time; all other texts, and those that hold an added token's string, go through tokenizers.
    """
    if (path, ranks_path) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(path)
        added = [x.content for x in full.get_added_tokens_decoder().values()]
        fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(texts: list[str]) -> list[list[int]]:
            plain = [fast is not None and PLAIN.fullmatch(x) is not None and not any(t in x for t in added) for x in texts]
            other = iter(full.encode_batch([x for x, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
            return [fast.encode_ordinary(x) if p else next(other).ids for x, p in zip(texts, plain, strict=True)]

        _encoders[path, ranks_path] = encode
    return _encoders[path, ranks_path]


def cuts(length: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Piece lengths that sum to `length`."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= waste * capacity:
            out.append(rest)
            break
        out.append(part := capacity // (k + 1))
        rest -= part
    return out


def pieces(docs: DataFrame, path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the pieces of each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                row, start, length, crc, total, held = [], [], [], [], [], []
                for i, found in enumerate(encode(texts)):
                    ids = np.array([*found, end_id], dtype="<u4")
                    to = 0
                    for n in cuts(len(ids), capacity):
                        part = ids[to : to + n]
                        row.append(i)
                        start.append(to)
                        length.append(n)
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(ids))
                        if with_ids:
                            held.append(part.astype(np.int32))
                        to += n
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, pa.list_(pa.int32()))] if with_ids else []), names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with `length`; the rows of a sequence lie gapless from offset 0."""
    row = F.struct(*(F.col(f"`{c}`") for c in found.columns))
    held = cut(found.select(row.alias("_row"), F.col("length").cast("long").alias("_length"), F.monotonically_increasing_id().alias("_key")))
    groups = max(1, -(-held.count() // PER_WORKER))
    whole = F.col("_length") * 2 > capacity
    out = [held.where(whole).select("_row", F.col("_key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = held.where(~whole).withColumn("_class", F.floor(F.lit(capacity) / F.col("_length")).cast("long")).withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups)))
    order = (F.desc("_length"), "_key")
    before = F.coalesce(F.sum("_length").over(Window.partitionBy("_group", "_class", "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    for level in range(1, LAST):
        own = Window.partitionBy("_group", "_class")
        filled = rest.withColumn("_bin", F.floor((F.row_number().over(own.orderBy(*order)) - 1) / F.col("_class"))).withColumn("_full", F.col("_bin") < F.floor(F.count("*").over(own) / F.col("_class")))
        name = F.lit(level << LEVEL) + F.shiftleft(F.col("_class"), CLASS) + F.shiftleft(F.col("_group"), GROUP) + F.col("_bin")
        out.append(filled.where("_full").withColumn("offset", before).select("_row", name.alias("sequence_id"), "offset"))
        rest = filled.where("NOT _full").drop("_bin", "_full")
        if groups == 1:
            break
        groups = -(-groups // FAN)
        rest = rest.withColumn("_group", F.floor(F.col("_group") / FAN))

    def first_fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_size", "descending"), ("_class", "ascending")])
        room: list[int] = []
        bins, bases = [], []
        for n in rows.column("_size").to_pylist():
            at = next((i for i, x in enumerate(room) if x >= n), len(room))
            if at == len(room):
                room.append(capacity)
            bins.append((LAST << LEVEL) + at)
            bases.append(capacity - room[at])
            room[at] -= n
        return pa.table({"_of": rows.column("_class"), "sequence_id": pa.array(bins, pa.int64()), "_base": pa.array(bases, pa.int64())})

    # a row a class, of which there are no more than the capacity
    bundles = rest.groupBy("_class").agg(F.sum("_length").alias("_size")).withColumn("_all", F.lit(0))
    bundles = bundles.groupBy("_all").applyInArrow(lambda rows: first_fit(rows), "_of long, sequence_id long, _base long")
    last = rest.withColumn("_bin", F.lit(0)).withColumn("_before", before).join(F.broadcast(bundles), F.col("_class") == F.col("_of"))
    out.append(last.select("_row", "sequence_id", (F.col("_base") + F.col("_before")).alias("offset")))
    packed = out[0]
    for part in out[1:]:
        packed = packed.union(part)
    return packed.select(*(F.col(f"_row.`{c}`").alias(c) for c in found.columns if c not in ("sequence_id", "offset")), "sequence_id", "offset")


def padded(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, tokens, size): size is the length after padding, tokens itself where that is a power of two."""
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return sums.withColumn("size", F.when(power, F.col("tokens")).otherwise(F.lit(capacity).cast("long")))
