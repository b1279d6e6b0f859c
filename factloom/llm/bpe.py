"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Theory used: a token sequence is the encoding of its bytes iff each adjacent pair of tokens is (the pair's bytes encode to that
pair).  So the encoding of a prefix is the encoding of some shorter prefix plus one token that goes with its last token, and the
encoder needs, of what it has read, only the prefixes from which a vocabulary entry is still being spelled ("live" prefixes).

The transducer's states are these sets: for each live prefix its tokens that are not emitted yet, next to the last emitted
token.  Reading a byte extends all spellings, drops the dead ones, and emits what all live prefixes' encodings share; as no
spelling is longer than the longest entry, the lookahead is bounded by it.  States and moves are built when first needed and kept in a
table that is emptied when it reaches `STATES` entries, as is the older half of the memo of whole matches at `WORDS`; neither
changes any result.

As the public encoding does, a match that is a vocabulary entry itself is that one token.

Edge cases: null text counts as empty (no ids); very long matches run through the same transducer in memory bounded by its
tables; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Moves and matches that are kept at once, in each worker.
STATES = 800_000
WORDS = 500_000
PAIRS = 500_000
#: Longer matches are not memoised.
LONG = 64


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelt = {n: b for b, n in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        # trie: node -> {byte: node}; `ends` has the token spelled at a node, if merges can produce it
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for entry, token in ranks.items():
            node = 0
            for byte in entry:
                after = self.trie[node].get(byte)
                if after is None:
                    after = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                node = after
            self.ends[node] = token
        self.borders: dict[int, tuple | None] = {}
        self.reset()

    def reset(self) -> None:
        """State 0: nothing read; its one live prefix is the empty one, at the trie's root."""
        self.states: list[tuple] = [(-1, (((), 0),))]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.size = 0

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the adjacent pair of lowest rank, leftmost first, until none can be."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > 1:
            low, at = min((r, i) if (r := rank(parts[i] + parts[i + 1])) is not None else (1 << 60, i) for i in range(len(parts) - 1))
            if low == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def spines(self, token: int) -> tuple[list[int], list[int]] | None:
        """The pieces at the right and at the left border of `token` while it is merged, last first; None if merges can't be told from ranks alone."""
        found = self.borders.get(token, 0)
        if found == 0:
            data = self.spelt[token]
            parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
            while len(parts) > 2:
                low, at = min((r, i) if (r := rank(parts[i] + parts[i + 1])) is not None else (1 << 60, i) for i in range(len(parts) - 1))
                if low == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 1:
                found = ([token], [token])
            elif len(parts) == 2 and (left := self.spines(self.ranks[parts[0]])) and (right := self.spines(self.ranks[parts[1]])) and max(left[0][0], right[0][0]) < token:
                found = ([token, *right[0]], [token, *left[1]])
            else:
                found = None
            self.borders[token] = found
        return found

    def goes(self, last: int, token: int) -> bool:
        """Whether `token` may follow `last` (-1: the start): no piece at their common border merges across it before each has grown whole."""
        found = self.pairs.get((last, token))
        if found is None:
            right = self.spines(token)
            if last < 0:
                found = right is not None or self.merged(self.spelt[token]) == [token]
            elif right is None or (left := self.spines(last)) is None:
                found = self.goes(-1, token) and self.merged(self.spelt[last] + self.spelt[token]) == [last, token]
            else:
                x, y, spelt, rank, never = left[0], right[1], self.spelt, self.ranks.get, 1 << 60
                i, j = len(x) - 1, len(y) - 1
                while True:
                    across = rank(spelt[x[i]] + spelt[y[j]], never)
                    own, other = x[i - 1] if i else never, y[j - 1] if j else never
                    if across < own and across <= other:
                        found = across == never
                        break
                    if own == never and other == never:
                        found = True
                        break
                    if own <= other:
                        i -= 1
                    else:
                        j -= 1
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[last, token] = found
        return found

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one move: the state after reading `byte`, and the tokens emitted."""
        emitted, live = self.states[state]
        trie, ends, pairs = self.trie, self.ends, self.pairs
        after, whole = [], None
        for pending, node in live:
            step = trie[node].get(byte)
            if step is None:
                continue
            token = ends[step]
            if whole is None and token >= 0:
                last = pending[-1] if pending else emitted
                goes = pairs.get((last, token))
                if goes or goes is None and self.goes(last, token):
                    whole = (*pending, token)
            if trie[step]:
                after.append((pending, step))
        assert whole is not None, "a byte is missing from the vocabulary"
        after.append((whole, 0))
        shared = 0
        for some in zip(*[p for p, _ in after], strict=False):
            if any(x != some[0] for x in some):
                break
            shared += 1
        out = whole[:shared]
        if shared:
            emitted = out[-1]
            after = [(p[shared:], n) for p, n in after]
        if all(p for p, _ in after):
            emitted = -2  # no spelling starts there any more
        key = (emitted, tuple(after))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][byte] = number, out
        self.size += 1
        return number, out

    def encode(self, match: bytes) -> tuple[int, ...]:
        """The ids of one match."""
        own = self.ranks.get(match)
        if own is not None:
            return (own,)
        if self.size > STATES:
            self.reset()
        state, out, moves = 0, [], self.moves
        for byte in match:
            found = moves[state].get(byte)
            if found is None:
                if self.size > 4 * STATES:  # within one endless match: start over from this state alone
                    kept = self.states[state]
                    self.reset()
                    moves = self.moves
                    state = self.number.setdefault(kept, len(self.states))
                    if state == len(self.states):
                        self.states.append(kept)
                        moves.append({})
                found = self.move(state, byte)
            state, more = found
            if more:
                out += more
        live = self.states[state][1]
        return (*out, *live[-1][0])


class Codec:
    """Encodes and decodes whole texts by ranks and a pre-splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.transducer = Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
        self.split = regex.compile(pattern)
        # two generations: what is used while the younger fills up outlives the older
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> np.ndarray:
        words, out = self.words, []
        for match in self.split.findall(text):
            ids = words.get(match)
            if ids is None:
                ids = self.older.get(match) or self.transducer.encode(match.encode())
                if len(match) <= LONG:
                    if len(words) >= WORDS:
                        self.older, self.words = words, {}
                        words = self.words
                    words[match] = ids
            out += ids
        return np.array(out, dtype="<u4")

    def decode(self, ids: Iterable[int], chunk: int = 1 << 16) -> Iterator[str]:
        """Text pieces as soon as their characters are whole."""
        spelt, stream = self.transducer.spelt, Utf8Stream()
        ids = np.asarray(ids).tolist()
        for at in range(0, len(ids), chunk):
            yield stream.feed(b"".join([spelt[x] for x in ids[at : at + chunk]]))
        yield stream.close()


class Utf8Stream:
    """An incremental UTF-8 state machine: its state is the bytes of a character begun, and how many it still needs.

    Bytes that can't belong to a character come out as U+FFFD, as in any lenient decoder.
    """

    def __init__(self) -> None:
        self.begun = b""

    @staticmethod
    def needs(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0

    def feed(self, data: bytes) -> str:
        data = self.begun + data
        whole = len(data)
        for back in range(1, min(3, len(data)) + 1):  # only the last three bytes can belong to an unfinished character
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if self.needs(byte) > back:
                    whole = len(data) - back
                break
        self.begun = data[whole:]
        return data[:whole].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.begun = self.begun, b""
        return rest.decode("utf-8", "replace")


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process, so that its tables stay warm between tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
        # the tables have no cycles: don't walk them over and over in search of some
        gc.freeze()
        gc.set_threshold(1_000_000, 50, 1000)
    return _codecs[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]): encodes each text, then decodes the ids again."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows: list[list] = [[] for _ in range(5)]
                for text in batch.column(1).to_pylist():
                    ids = own.encode(text or "")
                    digest, parts = hashlib.sha256(), []
                    for part in own.decode(ids):
                        digest.update(part.encode())
                        if with_ids:
                            parts.append(part)
                    values = len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), digest.hexdigest(), ids.astype(np.int32), "".join(parts)
                    for column, x in zip(rows, values, strict=True):
                        column.append(x)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 3 + 2 * with_ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=False))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)
