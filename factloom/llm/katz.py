"""Word n-gram model with Katz backoff, learned from and applied to whole corpora.

Tokens are the ASCII-lower-cased words of a text and one end token.  The history of a token are the words before it, up to ORDER - 1 and
no further than to a start mark before the text's first word.  With c for training counts and h' for h without its first word:

    p(w | h) = D(c(h w)) / c(h)               if c(h w) > 0
               alpha(h) * p(w | h')           otherwise; alpha = 1 where h never occurred
    p(w)     = D(c(w)) / N                    if c(w) > 0,   p0 = what that leaves of 1, for all unknown words together

D is the Good-Turing discounted count up to K (by the counts of counts of all training n-grams of the order), and c - DELTA above K, so
that every history leaves some mass; alpha(h) makes the sum over the vocabulary and the unknown word exactly one.

The model is built order by order, and each order is stored before the next one: for every partition of histories its n-grams with
their counts (`counts` reads them as rows).  Texts are read once, into chunks of about CHUNK tokens, stored in buckets by chunk.  For
each order a chunk asks the partitions about its distinct n-grams, with their training counts in the chunk; a partition adds
up, stores its part of the table and answers each chunk from it with the counts, and, for histories that need one, with what makes
the backoff weight.  So what travels is bounded by the chunks' distinct n-grams, less those of which a part never
occurred.  Words get numbers with the first order, which is what later orders send.  Discounts need counts of counts over all partitions, a dozen sums an order.  At last the chunks evaluate their tokens: from the
longest history, recursively through the shorter ones.

Partitions follow the number of tokens (PART tokens each).  A history with a large share of all tokens is dealt by its words to
several partitions, as its count, known from the order before, tells; chunks add up what these say of its weight.
Blocks that travel are numpy arrays, compressed.  Words are told apart by 64-bit hashes.

Edge cases: null text counts as empty (an end token only); very long texts are cut nowhere; repeated rows are repeated documents;
without training rows all scores are 0 (p0 = 1); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.shared import working_dir

ORDER = 3
K = 5
DELTA = 0.5
#: Tokens of a chunk, and one document more; tokens of a partition; partitions at least.
CHUNK = 1_500_000
PART = 2_500_000
LEAST_PARTS = 8
#: Bytes of input for a bucket of chunks.
BUCKET = 8 << 20
END, START = np.uint64(xxhash.xxh64_intdigest(b"")), np.uint64(xxhash.xxh64_intdigest(b" "))
MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# Blocks


def _planes(x: np.ndarray) -> tuple:
    """Bytes of like significance together, which compresses far better."""
    x = np.asarray(x)
    if len(x) and x.dtype.kind in "iu" and x.min() >= 0:
        x = x.astype(np.min_scalar_type(x.max()))
    return x.dtype.str, np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""


def _flat(kind: str, data: bytes) -> np.ndarray:
    kind = np.dtype(kind)
    x = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
    return x.astype(np.int64) if kind.kind in "iu" else x  # of hashes the same bits


def block(**columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps({k: _planes(v) for k, v in columns.items()}, protocol=5))


def unblock(blob: bytes | memoryview) -> dict[str, np.ndarray]:
    return {k: _flat(*v) for k, v in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)).items()}


def deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending.astype(np.uint64), prepend=np.uint64(0)).astype(np.uint64)


def sums(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x.astype(np.uint64), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * MIX
    return x ^ (x >> np.uint64(29))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mixed(keys) >> np.uint64(31)) % np.uint64(parts)).astype(np.int64)


# Figures of a whole order


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounted counts D(1) to D(K), from the numbers of types that occur once to K+1 times: what they free is the mass of types that occur once."""
    n = n.astype(float)
    r = np.arange(1, K + 1)
    plain = r - DELTA  # where the counts of counts are too few for Good-Turing
    if n[: K + 1].min() <= 0:
        return plain
    most = (K + 1) * n[K] / n[0]
    ratio = ((r + 1) * n[1:] / (r * n[:K]) - most) / (1 - most) if most != 1 else np.full(K, -1.0)
    return np.where((ratio > 0) & (ratio < 1), ratio * r, plain)


class Totals:
    """Global figures of one order, from the partitions' counts of counts (1 to K+1, then above) and sum of counts."""

    def __init__(self, x: np.ndarray):
        self.low = discounts(x[: K + 1])
        self.v, self.n = int(x[: K + 2].sum()), int(x[K + 2])
        left = ((np.arange(1, K + 1) - self.low) * x[:K]).sum() + DELTA * x[K : K + 2].sum()
        self.p0 = left / self.n if self.n else 1.0

    def cut(self, c: np.ndarray) -> np.ndarray:
        """The discounted count; 0 for n-grams that the model does not have."""
        return np.where(c < 1, 0.0, np.where(c > K, c - DELTA, self.low[np.clip(c, 1, K) - 1]))


def _figures(c: np.ndarray) -> np.ndarray:
    return np.append(np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1:], c.sum())


# Chunks


def places(many: np.ndarray) -> np.ndarray:
    """Places of words in a chunk, from their numbers of tokens: small numbers for frequent words; place 0 is the start mark."""
    out = np.empty(len(many), dtype=np.int64)
    out[np.argsort(-many, kind="stable")] = 1 + np.arange(len(many))
    return out


def cut_up(size: int = CHUNK):
    """Documents (key, id, held out, text) -> chunks (chunk, tokens, blob): their words, and tokens as places in these."""

    def emit(words: dict[bytes, int], ids: list[np.ndarray], docs: list[tuple]) -> pa.RecordBatch:
        hashes = np.array([START, END, *(xxhash.xxh64_intdigest(w) for w in list(words)[2:])], dtype=np.uint64)
        lengths = np.array([len(x) + 1 for x in ids])
        ends = np.cumsum(lengths) - 1
        w = np.ones(ends[-1] + 1, dtype=np.int32)
        w[np.delete(np.arange(len(w)), ends)] = np.concatenate(ids)
        keys, own, known, held = (np.array(x) for x in zip(*docs, strict=True))
        by_hash = 1 + np.argsort(hashes[1:])
        many = np.bincount(w, minlength=len(hashes))[by_hash]
        rank = np.zeros(len(hashes), dtype=np.int32)
        rank[by_hash] = places(many)
        blob = block(words=deltas(hashes[by_hash]), many=many, w=rank[w], n=lengths, id=own, known=known.astype(np.uint8), held=held.astype(np.uint8))
        return pa.RecordBatch.from_arrays([pa.array(keys[:1]), pa.array([len(w)], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "tokens", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, int] = {}
        ids: list[np.ndarray] = []
        docs: list[tuple] = []
        many = 0
        for batch in batches:
            for key, own, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not docs:
                    words, many = {b"\x00 start": 0, b"\x00 end": 1}, 0
                found = tokens(text)
                ids.append(np.array([words.setdefault(x, len(words)) for x in found], dtype=np.int32))
                docs.append((key, own or 0, own is not None, bool(held)))
                many += len(found) + 1
                if many >= size:
                    yield emit(words, ids, docs)
                    ids, docs = [], []
        if docs:
            yield emit(words, ids, docs)

    return run


class Chunk:
    """A chunk's tokens and distinct n-grams, and what is known of these so far.

    Of each order m: `code` (the m-gram that ends at a token, or -1), and of the m-grams `pre` (the m-1-gram that they begin
    with), `last` (their last word), `suf` (the m-1-gram that they end with), `times` (in training texts) and `c` (count of all training texts).
    """

    def __init__(self, blob: bytes, parts: int):
        x = unblock(blob)
        self.parts, self.own = parts, x
        self.words, self.place = sums(x["words"]), places(x["many"])  # in order of hashes
        self.w, self.n, self.size = x.pop("w").astype(np.int32), x["n"], len(x["words"]) + 1
        self.first = np.cumsum(self.n) - self.n
        self.pos = (np.arange(len(self.w)) - np.repeat(self.first, self.n)).astype(np.int32)
        self.learn = np.repeat(x["held"] == 0, self.n)
        every = np.arange(self.size)
        self.code, self.pre, self.last, self.suf = [None, self.w], [None, None], [None, every], [None, None]
        self.times, self.c, self.alpha = [None, np.bincount(self.w[self.learn], minlength=self.size)], [None], [None, None]

    def ask_words(self) -> list[tuple[int, np.ndarray]]:
        """Words of each partition, as indices of `words`."""
        dest = part_of(self.words, self.parts)
        return list(_split(dest, np.argsort(dest, kind="stable")))

    def receive_words(self, answers: dict[int, dict]) -> None:
        self.ids, c = np.zeros(self.size, dtype=np.int64), np.zeros(self.size, dtype=np.int64)
        for p, some in self.ask_words():
            x, some = answers[p], self.place[some]
            c[some] = x["c"]
            known = np.argsort(-x["c"], kind="stable")[: len(x["id"])]
            self.ids[some[known]] = sums(x["id"]).astype(np.int64) * self.parts + p + 1
        c[0] = c[self.place[np.searchsorted(self.words, END)]]  # as often as texts begin, they end
        self.c.append(c)

    def extend(self, m: int) -> None:
        """The distinct m-grams."""
        pair = np.zeros(len(self.w), dtype=np.int64)
        pair[1:] = self.code[m - 1][:-1]
        if m == 2:
            pair[self.first] = 0
        pair *= self.size
        pair += self.w
        some = self.pos >= m - 2
        pair, at = np.unique(pair[some], return_inverse=True)
        at = at.astype(np.int32)
        code = np.full(len(self.w), -1, dtype=np.int32)
        code[some] = at
        suf = np.empty(len(pair), dtype=np.int32)
        suf[at] = self.code[m - 1][some]
        pre, last = np.divmod(pair, self.size)
        self.code.append(code)
        self.pre.append(pre.astype(np.int32))
        self.last.append(last.astype(np.int32))
        self.suf.append(suf)
        self.times.append(np.bincount(at[self.learn[some]], minlength=len(pair)).astype(np.int32))

    def spelt(self, m: int, grams: np.ndarray) -> list[np.ndarray]:
        """Numbers of the words of m-grams."""
        return [self.ids[grams]] if m == 1 else [*self.spelt(m - 1, self.pre[m][grams]), self.ids[self.last[m][grams]]]

    def ask(self, m: int, total: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each partition: histories (m-1-grams, in order of their words), how many m-grams of each, whether its weight is needed, and the m-grams."""
        good = self.c[m - 1] > 0
        known = good[self.pre[m]]
        asked = np.nonzero(known & good[self.suf[m]])[0]
        hist = self.pre[m][known]  # ascending
        hist = hist[np.diff(hist, prepend=-1) != 0]
        if not len(hist):
            return []
        spelt = self.spelt(m - 1, hist)
        order = _sorted(*spelt)
        hist, spelt = hist[order], [x[order] for x in spelt]
        place = np.zeros(len(good), dtype=np.int64)
        place[hist] = np.arange(len(hist))
        need = np.zeros(len(hist), dtype=bool)
        known[asked] = False
        need[place[self.pre[m][known]]] = True
        key = np.zeros(len(hist), dtype=np.uint64)
        for x in spelt:
            key = mixed(key + x.astype(np.uint64) + np.uint64(1))
        home = part_of(key, self.parts)
        width = np.minimum(self.parts, 1 + self.c[m - 1][hist] * 2 * self.parts // max(1, total))
        # a history's home, and for wide ones the partitions after it
        start = np.cumsum(width) - width
        copies = np.repeat(np.arange(len(hist)), width)
        entry = (home[copies] + np.arange(len(copies)) - start[copies]) % self.parts * len(hist) + copies
        by = np.argsort(entry)
        slot = np.empty(len(entry), dtype=np.int64)
        slot[by] = np.arange(len(entry))
        entry = entry[by]
        own, word = place[self.pre[m][asked]], self.ids[self.last[m][asked]]
        at = start[own]
        wide = width[own] > 1
        at[wide] += part_of(word[wide], 1 << 30) % width[own[wide]]
        at = slot[at]
        order = _sorted(at, word)
        asked, at = asked[order], at[order]
        many = np.bincount(at, minlength=len(entry))
        dest, rows = np.divmod(entry, len(hist))
        out, edge = [], np.cumsum(many)
        for p, some in _split(dest, np.arange(len(dest))):
            a, b = some[0], some[-1] + 1
            out.append((p, hist[rows[a:b]], many[a:b], need[rows[a:b]] | (width[rows[a:b]] > 1), asked[edge[a] - many[a] : edge[b - 1]]))
        return out

    def receive(self, m: int, totals: list[Totals], answers: dict[int, dict]) -> None:
        c = np.zeros(len(self.pre[m]), dtype=np.int64)
        kept, used = np.zeros(len(self.c[m - 1])), np.zeros(len(self.c[m - 1]))
        for p, hist, _, _, grams in self.ask(m, totals[1].n):
            x = answers[p]
            c[grams] = x["c"]
            if len(x["at"]):
                at = hist[np.cumsum(x["at"])]  # a history is told of once by a partition
                kept[at] += (sum(x[f"n{r}"] * totals[m].low[r - 1] for r in range(1, K + 1)) + x["mass"] - DELTA * x["many"])[x["row"]]
                used[at] += x["used"][x["row"]]
        self.c.append(c)
        own = self.c[m - 1]
        below = totals[1].n if m == 2 else self.c[m - 2][self.suf[m - 1]]
        alpha, some = np.zeros(len(own)), np.nonzero(kept > 0)[0]
        alpha[some] = np.log10(np.maximum(1 - kept[some] / own[some], 1e-300)) - np.log10(np.maximum(1 - used[some] / (below if m == 2 else below[some]), 1e-300))
        self.alpha.append(alpha)

    def scores(self, totals: list[Totals]) -> pa.Table:
        first, order = totals[1], len(totals) - 1
        c = self.c[1]
        log = np.log10(np.where(c > 0, first.cut(c) / max(1, first.n), first.p0))
        token = np.zeros(len(self.w))
        for m in range(2, order + 1):
            c, own = self.c[m], self.c[m - 1][self.pre[m]]
            seen = c > 0
            here = self.alpha[m][self.pre[m]] + log[self.suf[m]]
            here[seen] = np.log10(totals[m].cut(c[seen])) - np.log10(own[seen])
            log, some = here, self.code[m] >= 0
            token[some] = log[self.code[m][some]]
        if order == 1:
            token = log[self.w]
        add = lambda x: np.add.reduceat(x, self.first)
        c = self.c[1][self.w]
        base = add(np.log10(c + 1.0)) - self.n * np.log10(first.n + first.v + 1)
        ids = pa.array(self.own["id"].astype(np.int64), mask=self.own["known"] == 0)
        return pa.table({"doc_id": ids, "held_out": pa.array(self.own["held"] > 0), "n_tokens": self.n, "n_known": add((c > 0).astype(np.int64)), "train_tokens": np.full(len(self.n), first.n), "base_score": base, "score": add(token)})


def _sorted(*keys: np.ndarray) -> np.ndarray:
    """The order by the keys, the first one foremost, all below 2^32; rows differ."""
    if len(keys) > 2:
        return np.lexsort(keys[::-1])
    key = keys[0].astype(np.uint64)
    return np.argsort(key << np.uint64(32) | keys[1].astype(np.uint64) if len(keys) == 2 else key)


def _split(dest: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows by destination; `order` sorts by it."""
    if len(order):
        at = np.nonzero(np.diff(dest[order], prepend=-1))[0]
        for i, j in zip(at, [*at[1:], len(order)], strict=True):
            yield int(dest[order[i]]), order[i:j]


def _restored(left: pa.Table, right: pa.Table, parts: int, totals: list[Totals], order: int) -> Chunk:
    """A chunk with all that has been answered, ready to ask about `order`."""
    answers: dict[int, dict] = {}
    for m, p, blob in zip(right.column("answers").to_pylist(), right.column("part").to_pylist(), right.column("blob"), strict=True):
        answers.setdefault(m, {})[p] = blob.as_buffer()
    out = Chunk(left.column("blob")[0].as_buffer(), parts)
    if order > 1:
        out.receive_words({p: unblock(b) for p, b in answers[1].items()})
    for m in range(2, order + 1):
        out.extend(m)
        if m < order:
            out.receive(m, totals, {p: unblock(b) for p, b in answers.get(m, {}).items()})
    return out


ASK = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])


def asking(order: int, parts: int, totals: list[Totals]):
    """Chunk side of an order: (part, chunk, blob) for each partition."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return ASK.empty_table()
        own, rows = _restored(left, right, parts, totals, order), []
        chunk = left.column("chunk")[0].as_py()
        if order == 1:
            rows = [(p, chunk, block(words=deltas(own.words[some]), times=own.times[1][own.place[some]])) for p, some in own.ask_words()]
        else:
            for p, hist, many, need, grams in own.ask(order, totals[1].n):
                spelt = own.spelt(order - 1, hist)
                columns = {"h0": deltas(spelt[0])} | {f"h{i}": x for i, x in enumerate(spelt[1:], 1)}
                rows.append((p, chunk, block(**columns, many=many, need=need.view(np.uint8), w=own.ids[own.last[order][grams]], times=own.times[order][grams], below=own.c[order - 1][own.suf[order][grams]])))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ASK, strict=True)], schema=ASK) if rows else ASK.empty_table()

    return run


# Partitions

SAID = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("part", pa.int32()), ("blob", pa.binary()), ("figures", pa.list_(pa.int64()))])


def _said(part: int, figures: np.ndarray, stored: bytes, answers: list[tuple[int, bytes]]) -> pa.Table:
    rows = [("figures", None, part, None, figures.tolist()), ("counts", None, part, stored, None), *(("answer", chunk, part, blob, None) for chunk, blob in answers)]
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SAID, strict=True)], schema=SAID)


def _asked(table: pa.Table) -> tuple[int, list[int], list[dict]]:
    chunks = table.column("chunk").to_pylist()
    order = np.argsort(chunks, kind="stable").tolist()
    return table.column("part")[0].as_py(), [chunks[i] for i in order], [unblock(table.column("blob")[i].as_buffer()) for i in order]


def count_words(table: pa.Table) -> pa.Table:
    """Partition of words: counts, numbers for those that occur in training (small ones for frequent words, which compress), and answers."""
    part, chunks, asked = _asked(table)
    words = [sums(x["words"]) for x in asked]
    every = np.unique(np.concatenate(words))
    at = [np.searchsorted(every, x) for x in words]
    c = np.bincount(np.concatenate(at), weights=np.concatenate([x["times"] for x in asked]), minlength=len(every)).astype(np.int64)
    ident = np.empty(len(every), dtype=np.int64)
    ident[np.argsort(-c, kind="stable")] = np.arange(len(every))
    stored = block(word=deltas(every[c > 0]), c=c[c > 0], id=ident[c > 0])
    answers = []
    for chunk, a in zip(chunks, at, strict=True):
        known = a[np.argsort(-c[a], kind="stable")[: np.count_nonzero(c[a])]]  # numbers ascend in this order
        answers.append((chunk, block(c=c[a], id=deltas(ident[known]))))
    return _said(part, _figures(c[c > 0]), stored, answers)


def _history(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of histories, in order of their words, for parallel columns of these; and the words of each."""
    key, folded = columns[0].astype(np.uint64), []
    for x in columns[1:]:
        every, key = np.unique(key, return_inverse=True)
        folded.append(every)
        key = key.astype(np.uint64) << np.uint64(32) | x.astype(np.uint64)
    every, at = np.unique(key, return_inverse=True)
    spelt, rest = [], every
    for before in reversed(folded):
        spelt.insert(0, (rest & np.uint64(0xFFFFFFFF)).astype(np.int64))
        rest = before[(rest >> np.uint64(32)).astype(np.int64)]
    return at, [rest.astype(np.int64), *spelt]


def counting(order: int, below: Totals):
    """Partition of histories: counts of its n-grams, and answers with these and with what makes the histories' weights."""

    def run(table: pa.Table) -> pa.Table:
        part, chunks, asked = _asked(table)
        columns = [np.concatenate([sums(x["h0"]).astype(np.int64) for x in asked]), *(np.concatenate([x[f"h{i}"] for x in asked]) for i in range(1, order - 1))]
        at, spelt = _history(columns)
        starts = np.cumsum([0, *(len(x["h0"]) for x in asked)])
        hist = np.concatenate([np.repeat(at[a:b], x["many"]) for x, a, b in zip(asked, starts, starts[1:], strict=False)])
        w, times, low = (np.concatenate([x[name] for x in asked]).astype(np.int64) for name in ("w", "times", "below"))
        pair, back = np.unique(hist.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64), return_inverse=True)
        under = np.empty(len(pair), dtype=np.int64)
        under[back] = low  # the same from all chunks
        c = np.bincount(back, weights=times, minlength=len(pair)).astype(np.int64)
        kept = np.nonzero(c)[0]
        own, size = (pair[kept] >> np.uint64(32)).astype(np.int64), len(spelt[0])
        stats = {f"n{r}": np.bincount(own[c[kept] == r], minlength=size) for r in range(1, K + 1)}
        large = c[kept] > K
        stats |= {"many": np.bincount(own[large], minlength=size), "mass": np.bincount(own[large], weights=c[kept][large], minlength=size).astype(np.int64), "used": np.bincount(own, weights=below.cut(under[kept]), minlength=size)}
        # histories are alike in few ways: `way` numbers these, small numbers for frequent ones
        mark = np.zeros(size, dtype=np.uint64)
        for x in stats.values():
            mark = mixed(mark + np.ascontiguousarray(x).view(np.uint64))
        _, way, often = np.unique(mark, return_inverse=True, return_counts=True)
        rank = np.empty(len(often), dtype=np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
        way, sample = rank[way], np.empty(len(often), dtype=np.int64)
        sample[way] = np.arange(size)
        some = np.unique(own)
        stored = block(**{f"h{i}": x[some] for i, x in enumerate(spelt)}, many=np.bincount(own, minlength=size)[some], w=(pair[kept] & np.uint64(0xFFFFFFFF)).astype(np.int64), c=c[kept])
        here, grams = np.bincount(own, minlength=size) > 0, np.cumsum([0, *(len(x["w"]) for x in asked)])
        answers = []
        for i, (chunk, x) in enumerate(zip(chunks, asked, strict=True)):
            count = c[back[grams[i] : grams[i + 1]]]
            mine = at[starts[i] : starts[i + 1]]
            missed = np.bincount(np.repeat(np.arange(len(mine)), x["many"])[count == 0], minlength=len(mine)) > 0
            tell = np.nonzero(here[mine] & (missed | (x["need"] > 0)))[0]
            ways, row = np.unique(way[mine[tell]], return_inverse=True)
            answers.append((chunk, block(c=count, at=np.diff(tell, prepend=0), row=row, **{k: v[sample[ways]] for k, v in stats.items()})))
        return _said(part, _figures(c[c > 0]), stored, answers)

    return run


# The whole

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
TABLE = "chunk long, part int, blob binary, figures array<long>, `order` int, kind string"


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk: int = CHUNK, path: str | None = None) -> DataFrame:
    """Scores every row of `docs`; rows with `held_out` false are what the model learns from.  The model's tables are stored under `path`."""
    spark, path = docs.sparkSession, path or working_dir(docs.sparkSession, "katz")
    own = docs.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = min(100_000, max(LEAST_PARTS, -(-size // BUCKET))) if size < 1 << 55 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"katz_{uuid.uuid4().hex}"
    cut = own.mapInArrow(cut_up(chunk), "chunk long, tokens long, blob binary")
    cut.write.format("parquet").option("path", f"{path}/chunks").option("compression", "none").bucketBy(buckets, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    many = chunks.agg(F.sum("tokens")).first()[0] or 0
    parts = max(LEAST_PARTS, -(-many // PART))
    totals: list = [None]
    for m in range(1, order + 1):
        asked = _met(chunks, path, m - 1).applyInArrow(asking(m, parts, totals), "part int, chunk long, blob binary")
        said = asked.groupBy("part").applyInArrow(count_words if m == 1 else counting(m, totals[-1]), "kind string, chunk long, part int, blob binary, figures array<long>")
        said.write.option("compression", "none").partitionBy("kind").parquet(f"{path}/model/order={m}")
        figures = _read(spark, path, "figures").where(F.col("order") == m).select(F.posexplode("figures")).groupBy("pos").agg(F.sum("col").alias("x")).collect()
        x = np.zeros(K + 3, dtype=np.int64)
        for r in figures:
            x[r.pos] = r.x
        totals.append(Totals(x))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SCHEMA.empty_table()
        done = _restored(left, right, parts, totals, order + 1) if order == 1 else _finished(left, right, parts, totals, order)
        return done.scores(totals)

    return _met(chunks, path, order).applyInArrow(finish, SCORES)


def _finished(left: pa.Table, right: pa.Table, parts: int, totals: list[Totals], order: int) -> Chunk:
    out = _restored(left, right, parts, totals, order)
    out.receive(order, totals, {p: unblock(b.as_buffer()) for m, p, b in zip(right.column("answers").to_pylist(), right.column("part").to_pylist(), right.column("blob"), strict=True) if m == order})
    return out


def _read(spark, path: str, kind: str) -> DataFrame:
    return spark.read.schema(TABLE).option("basePath", f"{path}/model").parquet(f"{path}/model/*").where(F.col("kind") == kind)


def _met(chunks: DataFrame, path: str, order: int):
    """Chunks, and the answers up to an order, by chunk."""
    spark = chunks.sparkSession
    if order:
        answers = _read(spark, path, "answer").where(F.col("order") <= order).select("chunk", F.col("order").alias("answers"), "part", "blob")
    else:
        answers = spark.createDataFrame([], "chunk long, answers int, part int, blob binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))


def counts(spark, path: str) -> DataFrame:
    """The stored model as rows (order, part, words array<long>, c): of order 1 the word's hash, above the numbers of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for order, part, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                x, m = unblock(blob.as_buffer()), order.as_py()
                c = x["c"].astype(np.int64)
                columns = [sums(x["word"]).view(np.int64)] if m == 1 else [*(np.repeat(x[f"h{i}"].astype(np.int64), x["many"]) for i in range(m - 1)), x["w"].astype(np.int64)]
                words = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(columns, axis=1).ravel()), m).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), m, dtype=np.int32)), pa.array(np.full(len(c), part.as_py(), dtype=np.int32)), words, pa.array(c)], names=["order", "part", "words", "c"])

    return _read(spark, path, "counts").select("order", "part", "blob").mapInArrow(run, "`order` int, part int, words array<long>, c long")
