"""The fixed-width embedding cache file: records of a 16-byte key and little-endian 32-bit floats, and an embedder that keeps one."""

from __future__ import annotations

import hashlib
import logging
import threading
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.functions.embedding import Embedder

log = logging.getLogger(__name__)
KEY = 16
DIMENSION = 768
RECORDS = 4096


def scan_cache(spark: SparkSession, path: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, pos, embedding) of each whole record; a partial record at the end is ignored."""
    kind = np.dtype([("key", f"V{KEY}"), ("embedding", "<f4", (dimension,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                rows = np.frombuffer(data, dtype=kind, count=len(data) // kind.itemsize)
                for at in range(0, len(rows), RECORDS):
                    some = rows[at : at + RECORDS]
                    vectors = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * dimension, pa.array(np.ascontiguousarray(some["embedding"]).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in some["key"]], pa.binary()), pa.array(np.arange(at, at + len(some))), vectors], names=["key", "pos", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key binary, pos long, embedding array<float>")


def cache_records(rows: list[tuple[bytes, list[float]]]) -> bytes:
    return b"".join(key + np.asarray(vector, dtype="<f4").tobytes() for key, vector in rows)


class CachedEmbedder:
    """Asks `inner` only for texts whose vector is not in the cache file, and appends what it says.

    The file is read once; of a text that it has twice the last vector counts, and a partial record at its end is cut off.  Where the file can't be
    used, the cache is kept in memory only.
    """

    def __init__(self, inner: Embedder, path: str | Path):
        self.inner, self.path, self.lock = inner, Path(path), threading.Lock()
        self.known: dict[bytes, list[float]] = {}
        self.size = KEY + 4 * getattr(inner, "dimension", DIMENSION)
        self.durable = True
        try:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.touch()
            data = self.path.read_bytes()
            whole = len(data) // self.size * self.size
            for at in range(0, whole, self.size):
                self.known[data[at : at + KEY]] = np.frombuffer(data[at + KEY : at + self.size], dtype="<f4").tolist()
            if whole < len(data):
                log.warning("%s ends with a partial record", self.path)
                with self.path.open("r+b") as file:
                    file.truncate(whole)
        except OSError:
            log.exception("the embedding cache is kept in memory only")
            self.durable = False

    def embed(self, texts: list[str]) -> list[list[float]]:
        keys = [hashlib.md5(t.encode()).digest() for t in texts]
        with self.lock:
            new = {k: t for k, t in zip(keys, texts, strict=True) if k not in self.known}
            if new:
                vectors = [[float(x) for x in v] for v in self.inner.embed(list(new.values()))]
                self.known |= dict(zip(new, vectors, strict=True))
                self._append([(k, v) for k, v in zip(new, vectors, strict=True) if KEY + 4 * len(v) == self.size])
            return [self.known[k] for k in keys]

    def _append(self, rows: list[tuple[bytes, list[float]]]) -> None:
        if self.durable:
            try:
                with self.path.open("ab") as file:
                    file.write(cache_records(rows))
            except OSError:
                log.exception("the embedding cache is kept in memory only")
                self.durable = False
