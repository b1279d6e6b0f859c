"""Language ID by a byte convolutional network: multi-width filters, max pooling and softmax, in numpy.

A window is WINDOW bytes of the lower-cased text.  Filters of 2, 3 and 4 bytes over one-hot bytes are table look-ups (one table a
filter position; applied, two positions share one table of byte pairs).  Each filter's maximum over the window feeds a softmax
layer.  A text is scored on all its windows: the mean of their class probabilities, weighted by their bytes.

Training takes a bounded sample of the labelled rows (`PER_LABEL` rows a label, the first by a hash of their id, of each
`PER_TEXT` evenly spread windows): rows, so that an id that many rows share counts no more than others.  Ids only choose the sample and
are never inputs of the network.  What reaches the driver is PER_LABEL times PER_TEXT windows a label.

Edge cases: a null text, or one without a letter, is `und` with score 0, and so is every text where there is nothing to learn
from; very long texts are scored in blocks of windows; labels of equal probability: the first in alphabetical order; repeated rows get
repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.llm.common import crc_mod

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the training sample.
PER_LABEL = 400
PER_TEXT = 3
PARTS = 16
EPOCHS = 6
BATCH = 64
RATE = 0.01
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Windows that are scored at once.
BLOCK = 512


def windows(text: str) -> np.ndarray:
    """The bytes of a text as rows of WINDOW, zero-padded; zero stands for no byte."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros(max(1, -(-len(data) // WINDOW)) * WINDOW, dtype=np.uint8)
    out[: len(data)] = data
    return out.reshape(-1, WINDOW)


class Network:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.weights = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.offset = np.zeros(len(labels), dtype=np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.tables, *self.bias, self.weights, self.offset]

    def gradients(self, bytes_: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of some windows, and its gradient for each of `params`; only the positions that won the pooling pass one on."""
        best, parts, rows = [], [], np.arange(len(y))
        for table, bias, w in zip(self.tables, self.bias, WIDTHS, strict=True):
            n = bytes_.shape[1] - w + 1
            act = table[0][bytes_[:, :n]]
            for k in range(1, w):
                act = act + table[k][bytes_[:, k : k + n]]
            top = act.argmax(axis=1)
            best.append(top)
            parts.append(np.take_along_axis(act, top[:, None, :], axis=1)[:, 0] + bias)
        pooled = np.concatenate(parts, axis=1)
        hidden = np.maximum(pooled, 0)
        out = hidden @ self.weights + self.offset
        p = np.exp(out - out.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(np.maximum(p[rows, y], 1e-30)).mean())
        p[rows, y] -= 1
        p /= len(y)
        back = (p @ self.weights.T) * (pooled > 0)
        grads = []
        for i, w in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad = np.zeros_like(self.tables[i])
            for k in range(w):
                np.add.at(grad[k], (np.take_along_axis(bytes_, best[i] + k, axis=1), np.arange(FILTERS)[None, :]), own)
            grad[:, 0] = 0  # no byte, no weight
            grads.append(grad)
        grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))]
        return loss, [*grads, hidden.T @ p, p.sum(axis=0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        first, second = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                _, grads = self.gradients(x[rows], y[rows])
                step += 1
                for q, g, m, v in zip(self.params(), grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        for table in self.tables:
            table[:, 0] = 0
        return self

    def prepare(self) -> Network:
        """Tables for applying: byte pairs, and single bytes where a filter has an odd position left."""
        self.steps = []
        for table, w in zip(self.tables, WIDTHS, strict=True):
            own = [(k, True, (table[k][:, None, :] + table[k + 1][None, :, :]).reshape(65536, FILTERS)) for k in range(0, w - 1, 2)]
            self.steps.append(own + ([(w - 1, False, table[w - 1])] if w % 2 else []))
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        flat = x.ravel()
        pair = flat.astype(np.int32) << 8
        pair[:-1] |= flat[1:]
        pair = pair.reshape(x.shape)
        parts = []
        for own, bias, w in zip(self.steps, self.bias, WIDTHS, strict=True):
            n, act = WINDOW - w + 1, None
            for k, two, table in own:
                some = np.take(table, (pair if two else x)[:, k : k + n], axis=0)
                act = some if act is None else np.add(act, some, out=act)
            parts.append(act.max(axis=1) + bias)
        out = np.maximum(np.concatenate(parts, axis=1), 0) @ self.weights + self.offset
        p = np.exp(out - out.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and score of each text."""
        sums = np.zeros((len(texts), max(1, len(self.labels))))
        total = np.zeros(len(texts))
        held, owner, weight, size = [], [], [], 0

        def flush() -> None:
            nonlocal held, owner, weight, size
            if held:
                x, own, w = np.concatenate(held), np.concatenate(owner), np.concatenate(weight)
                for at in range(0, len(x), BLOCK):
                    some = slice(at, at + BLOCK)
                    np.add.at(sums, own[some], self.probabilities(x[some]) * w[some, None])
                np.add.at(total, own, w)
                held, owner, weight, size = [], [], [], 0

        known = [bool(self.labels) and t is not None and LETTER.search(t) is not None for t in texts]
        for i, text in enumerate(texts):
            if known[i]:
                x = windows(text)
                held.append(x)
                owner.append(np.full(len(x), i))
                weight.append(np.count_nonzero(x, axis=1).astype(float) + 1e-9)
                size += len(x)
                if size >= 4 * BLOCK:
                    flush()
        flush()
        mean = sums / np.maximum(total, 1e-9)[:, None]
        best = mean.argmax(axis=1)
        score = np.where(known, np.clip(mean[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Network:
    """Learns from the labelled texts of `rows`; label values are taken as they are."""
    own = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{text_col}`").cast("string").alias("text")).where("label IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    # evenly spread windows, cut on the executors
    span = F.greatest(F.lit(0), F.length("text") - WINDOW)
    starts = [(span * k / max(1, PER_TEXT - 1)).cast("int") + 1 for k in range(PER_TEXT)]
    cuts = [f"w{k}" for k in range(PER_TEXT)]
    found = own.select("id", "label", F.pmod(F.hash("id"), F.lit(PARTS)).alias("part"), *(F.substring("text", s, F.lit(WINDOW)).alias(c) for c, s in zip(cuts, starts, strict=True)))
    # first within PARTS parts of each label, so that no task sorts all rows of a common label
    order = (F.xxhash64("id"), "id", *cuts)
    for keys in (("label", "part"), ("label",)):
        found = found.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= PER_LABEL)
    found = found.select("label", *cuts).collect()
    labels = sorted({r.label for r in found})
    if not labels:
        return Network([])
    known = [(labels.index(r.label), windows(x)[0]) for r in sorted(found) for x in dict.fromkeys(r[1:]) if LETTER.search(x)]
    if not known:
        return Network([])
    return Network(labels).train(np.stack([x for _, x in known]), np.array([y for y, _ in known]))


def predict(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """(doc_id, *keep, lang_pred, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *(keep or []), F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = StructType([f for f in base.schema if f.name != "_text"]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(sent.value).prepare()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                label, score = net.classify(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(label, pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return base.mapInArrow(run, schema)


def held_out_split(id_col: str = "doc_id", mod: int = 5) -> Column:
    return crc_mod(F.col(f"`{id_col}`"), mod) == 0


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on the documents that are not held out."""
    model = train(docs.where(~held_out_split()))
    return predict(docs, model, keep=[held_out_split().alias("held_out")])


def keep_known(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is recognised with at least this mean probability; `und` ones go."""
    model = train(docs.where(~held_out_split()))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    found = predict(docs, model, keep=[whole])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
