"""The training-data operators against brute force, round trips and held-out accuracy, with the cases that rows can hold."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import ann, bpe, chat, katz, langid, packing, pii, simhash, topk, warc
from factloom.llm.common import components, crc_mod

LONG = "une phrase qui revient " * 6000
TEXTS = [None, "", "one", "one", "two words", "Straße ÀÉ ß ñ 日本語 \U0001f600", "a b c d e f g h", "A B C D E F G H", LONG, LONG, "   \n\t ", "12 34 56", "\x00null\x00"]
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    """Texts of all kinds, repeated rows, a null id, and extra columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(TEXTS)] + [(2, "one", None), (None, "one", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("fp", "key", "part", "_key", "id", "label", "score", "_spans", "_m_email", "spans", "held", "length")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def whole(text):
    return text or ""


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (1000, 1001)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(x, x) == y for x, y in label.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 chat


def test_chat(spark):
    rows = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", r"</s> <\/s> [INST]"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "x<"), (2, 1, "tool [/ROLE]", "y["), (3, 0, None, "z"), (3, 0, None, "z"), (None, None, "system", "<<SYS>> <</SYS>>"), (4, 0, "user", LONG), (4, 1, "assistant", LONG)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    found = {r.conv_id: r for r in chat.read_chats(chat.format_chats(frame)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        turns = [x[1:] for x in sorted(turns, key=lambda x: (x[0] or 0, x[1], x[2]))]
        assert [(t.role, t.text) for t in found[c].turns] == turns
        assert "".join(s.text for s in found[c].segments) == found[c].formatted
        loss = [s.text for s in found[c].segments if s.loss]
        assert len(loss) == sum(r == "assistant" for r, _ in turns)
    assert found[1].valid and found[4].valid and not found[2].valid and found[2].first_error == 0 and not found[None].valid
    assert chat.format_chats(frame.where("false")).count() == 0


CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/TURN]", "\\", "<", "[", "x", "\n"]


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(CONTROL) for _ in range(rng.randrange(12))) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    out = frame.select("text", chat.escape(F.col("text")).alias("e")).select("text", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(r.text == r.u for r in out)
    assert not any(re.search(r"</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[/TURN\]", r.e) for r in out)


# 2 packing


@pytest.mark.parametrize("length", [1, 2, 67, 1024, 1500, 2047, 2048, 2049, 4096, 99999])
def test_cuts(length):
    parts = packing.cuts(length)
    assert sum(parts) == length and all(0 < p <= packing.CAPACITY for p in parts)
    assert all(packing.CAPACITY - packing.CAPACITY // p * p <= packing.WASTE * packing.CAPACITY for p in parts)


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    full = Tokenizer.from_file(path)
    found = packing.pack(packing.pieces(docs, path, public_tokenizers.path("byte_bpe_50k.tiktoken"))).toPandas()
    expected = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*full.encode(whole(r.text), add_special_tokens=False).ids, 1]
        expected[r.doc_id, len(ids)] += len(ids)
        for x in found[found.doc_id == r.doc_id].itertuples() if r.doc_id is not None else []:
            part = np.array(ids[x.start : x.start + x.length], dtype="<u4")
            assert list(x.ids) == part.tolist() and x.ids_crc32 == zlib.crc32(part.tobytes()) and x.doc_tokens == len(ids)
    assert found.length.sum() == sum(expected.values())
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= packing.CAPACITY
    assert packing.padded(packing.pack(packing.pieces(docs, path))).where("size < tokens OR size > 2048").count() == 0
    assert packing.pack(packing.pieces(empty, path)).count() == 0


@pytest.mark.parametrize("fan", [2, 64])
def test_packing_many_workers(spark, monkeypatch, fan):
    monkeypatch.setattr(packing, "PER_WORKER", 300)
    monkeypatch.setattr(packing, "FAN", fan)
    rng = random.Random(2)
    lengths = [n for _ in range(1500) for n in packing.cuts(rng.choice([3, 40, 70, 700, 1500, 2600]))]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").withColumns({c: F.lit("x") for c in ("_key", "_row", "_bin", "a.b", "offset")})
    found = packing.pack(rows)
    assert set(found.columns) == {*rows.columns, "sequence_id"}
    found = found.select("doc_id", "length", "sequence_id", "offset").toPandas()
    sums = found.groupby("sequence_id").length.sum()
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert sorted(found.doc_id) == list(range(len(lengths))) and sums.max() <= 2048
    power = (sums & (sums - 1)) == 0
    assert (2048 - sums[~power]).sum() / sums.sum() < 0.02


def test_fast_encoder_equals_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    fast, full = packing.encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken")), packing.encoder(path, None)
    texts = [whole(t) for t in TEXTS] + ["<|endoftext|> it's I'LL", "…–’ €", "ͰͱͲ а б", "\x85\xa0  x", "a\r\n\tb   c"]
    assert fast(texts) == full(texts)


def test_added_tokens_are_encoded_as_by_default():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "<|endoftext|>", "日本語<|endoftext|><|endoftext|>x", "<|endoftext |>", "plain"]
    expected = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [64, 220, 50256, 275]
    for ranks in (public_tokenizers.path("byte_bpe_50k.tiktoken"), None):
        assert packing.encoder(path, ranks)(texts) == expected


# 3 WARC


def test_warc(spark, tmp_path):
    same = "<p>é</p>" * 200
    rows = [(1, "http://a/", same), (2, None, same), (7, "http://b/\r\nX: y", same), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", "no id"), (8, "u", "a\r\n\r\nb WARC/1.1\r\n\r\n" * 3), (9, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("y") for c in ("payload", "digest", "first", "value")})
    path = str(tmp_path / "warc")
    found = {r.page_id: r for r in warc.archived(spark, pages, path).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        assert (found[page].payload_bytes, found[page].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert found[page].has_request and found[page].has_metadata
        assert (found[page].record_type, found[page].refers_to) == (("revisit", 7) if page in (1, 2) else ("response", None))
    captures = warc.assemble(warc.read(spark, path)).collect()
    assert {r.page_id: bytes(r.main.payload).decode() for r in captures if r.main.record_type == "response"}[8] == rows[8][2]
    assert all(bytes(r.request.payload).startswith(b"GET ") or r.request.payload is not None for r in captures)
    assert warc.archived(spark, pages.where("false"), str(tmp_path / "none")).count() == 0
    assert warc.archived(spark, pages.union(pages), str(tmp_path / "twice")).count() == 2 * len(rows)


def test_warc_large_captures(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BIG", 50_000)
    monkeypatch.setattr(warc, "FILE", 200_000)
    rows = [(i, f"http://h/{i}", chr(97 + i % 26) * n) for i, n in enumerate([10, 2000, 49_000, 60_000, 90_000, 150_000, 400_000] * 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    found = {r.page_id: r for r in warc.archived(spark, pages, str(tmp_path / "w")).collect()}
    assert {i: (len(h), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows} == {i: (r.payload_bytes, r.payload_digest) for i, r in found.items()}
    import gzip

    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").rglob("*.gz")]
    assert max(sizes) < 420_000 and len(sizes) > 20


def test_warc_parser_takes_members_and_refuses_damage():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    plain = list(warc.parse(record * 3))
    assert [b for _, b in plain] == [b"ab\r\nc"] * 3
    assert list(warc.parse(b"".join(gzip.compress(record) for _ in range(3)))) == plain
    with pytest.raises(ValueError):
        list(warc.parse(record[:-8]))


# 4 language ID


def test_langid(spark, docs, empty):
    rng = random.Random(5)
    parts = {"xx": ["bado", "ki", "lumo"], "yy": ["schtr", "eng", "orf"], "zz": ["été", "çou", "eaux"]}
    rows = [(i, " ".join("".join(rng.choice(parts[l]) for _ in range(3)) for _ in range(rng.choice([5, 60, 400]))), l) for i, l in enumerate(list(parts) * 80)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas().set_index("doc_id")
    held = [(i, l) for i, _, l in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(found.index[found.held_out]) == [i for i, _ in held]
    assert sum(found.lang_pred[i] == l for i, l in held) > 0.95 * len(held) and found.score.between(0, 1).all()
    mixed = langid.identify(docs).collect()
    assert len(mixed) == docs.count()
    assert all((r.lang_pred == "und") == (r.doc_id in (0, 1, 10, 11)) for r in mixed if r.doc_id is not None)
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert langid.identify(empty).count() == 0
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (0, 1, 10, 11)").count() == 0


def network(labels=3, seed=2):
    rng = np.random.default_rng(seed)
    own = langid.Network([f"l{i}" for i in range(labels)])
    own.tables = [rng.normal(0, 0.3, t.shape) for t in own.tables]
    for t in own.tables:
        t[:, 0] = 0
    own.bias = [rng.normal(0, 0.2, b.shape) for b in own.bias]
    own.weights, own.offset = rng.normal(0, 0.3, own.weights.shape), rng.normal(0, 0.2, own.offset.shape)
    x = rng.integers(1, 256, (5, langid.WINDOW)).astype(np.uint8)
    x[1, 100:] = 0
    x[2, 3:] = 0
    return own, x


def convolved(own, row):
    """Class probabilities of one window, filter by filter and place by place."""
    pooled = []
    for table, bias, w in zip(own.tables, own.bias, langid.WIDTHS, strict=True):
        for f in range(langid.FILTERS):
            pooled.append(max(sum(table[k][row[at + k]][f] for k in range(w)) for at in range(len(row) - w + 1)) + bias[f])
    out = [sum(max(0.0, h) * own.weights[i][c] for i, h in enumerate(pooled)) + own.offset[c] for c in range(len(own.labels))]
    return [math.exp(o - max(out)) / sum(math.exp(p - max(out)) for p in out) for o in out]


def test_langid_network_by_brute_force():
    own, x = network()
    found = own.prepare().probabilities(x)
    for row, p in zip(x, found, strict=True):
        assert p.tolist() == pytest.approx(convolved(own, row), rel=1e-9)
    text = "Été — grün " * 70
    data = langid.windows(text)
    size = np.count_nonzero(data, axis=1)
    mean = sum(np.array(convolved(own, r)) * n for r, n in zip(data, size, strict=True)) / size.sum()
    label, score = own.classify([text, None, "123", text])
    assert label == [f"l{mean.argmax()}", "und", "und", f"l{mean.argmax()}"] and score[0] == pytest.approx(mean.max()) and score[1] == 0


def test_langid_gradients_are_those_of_the_loss():
    own, x = network()
    y = np.array([0, 1, 2, 1, 0])
    loss, grads = own.gradients(x, y)
    assert loss == pytest.approx(-sum(math.log(convolved(own, r)[c]) for r, c in zip(x, y, strict=True)) / 5)
    for param, grad in zip(own.params(), grads, strict=True):
        for at in np.argsort(-np.abs(grad).ravel())[:6]:
            at = np.unravel_index(at, grad.shape)
            both = []
            for step in (1e-6, -1e-6):
                before = param[at]
                param[at] = before + step
                both.append(own.gradients(x, y)[0])
                param[at] = before
            assert grad[at] == pytest.approx((both[0] - both[1]) / 2e-6, rel=1e-3, abs=1e-7)


def test_langid_sample_is_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LABEL", 20)
    seen = []
    monkeypatch.setattr(langid.Network, "train", lambda self, x, y: seen.append(np.bincount(y).tolist()) or self)
    rows = [(1, f"text {i} of one id", "xx") for i in range(300)] + [(i, f"other {i}", "yy") for i in range(2, 50)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen == [[20, 20]]


# 5 BPE


@pytest.fixture(scope="module")
def pair():
    own = bpe.Codec(MULTI, public_tokenizers.PATTERN)
    with open(MULTI, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="abehinorst é'0 \n", max_size=80))
def test_bpe_equals_public_encoding(pair, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = pair[0].encode(text)
    assert ids.tolist() == pair[1].encode_ordinary(text)
    assert "".join(pair[0].decode(ids, chunk=1)) == text


def test_bpe_small_tables(pair, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "WORDS", 5)
    own = bpe.Codec(MULTI, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß ") for _ in range(n)) for n in (10, 300, 5000)):
        assert own.encode(text).tolist() == pair[1].encode_ordinary(text)


def test_bpe_pairs(pair):
    rng, own = random.Random(6), pair[0].transducer
    tokens = list(own.spelt)
    for _ in range(3000):
        a, b = rng.choice(tokens[:4000]), rng.choice(tokens)
        assert own.goes(a, b) == (own.merged(own.spelt[a] + own.spelt[b]) == [a, b])


@given(data=st.binary(max_size=40), at=st.integers(0, 40))
def test_utf8_stream(data, at):
    stream = bpe.Utf8Stream()
    text = stream.feed(data[:at]) + stream.feed(data[at:]) + stream.close()
    try:
        assert text == data.decode()
    except UnicodeDecodeError:
        assert "�" in text


def test_bpe_operator(spark, docs, empty, pair):
    found = bpe.encoded(docs, MULTI, public_tokenizers.PATTERN).collect()
    texts = {r.doc_id: whole(r.text) for r in docs.select("doc_id", "text").collect()}
    for r in found:
        ids = pair[1].encode_ordinary(texts[r.doc_id])
        assert list(r.ids) == ids and r.decoded == texts[r.doc_id] and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert len(found) == docs.count() and bpe.encoded(empty, MULTI, public_tokenizers.PATTERN).count() == 0


# 6, 9 vectors


def vectors(spark, n, seed=0, norms=(1.0,)):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x *= (rng.choice(norms, size=n) / np.linalg.norm(x, axis=1))[:, None]
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third are copies
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    bad = [(10 * n, None), (10 * n + 50, [1.0, None]), (10 * n + 100, [float("nan")] * 16), (10 * n + 150, [float("inf")] * 16), (10 * n + 200, [0.0] * 16)]
    return rows, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "norm", "level", "leaf", "task", "score")})


@pytest.mark.parametrize("norms", [(1.0,), (0.1, 1.0, 9.0)])
@pytest.mark.parametrize(("bucket", "queries"), [(8192, 2048), (64, 2)])
@pytest.mark.parametrize("steep", [0.6, -9.0, 9.0])
def test_topk(spark, monkeypatch, norms, bucket, queries, steep):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "QUERIES", queries)
    monkeypatch.setattr(topk, "STEEP", steep)
    monkeypatch.setattr(topk, "SEEDS", 40)
    rows, frame = vectors(spark, 400, norms=norms)
    rows = rows + [(4200, [0.0] * 16)]
    ids, x = np.array([i for i, _ in rows]), np.floor(1024 * np.array([v for _, v in rows]))
    found = collections.defaultdict(list)
    for r in topk.exact_top(frame, 100, 10).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    for q, best in found.items():
        score = (x @ x[ids == q][0]).astype(int)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:10]
        assert best == [(ids[j], score[j]) for j in order]


def test_topk_negative_limit_in_a_cone():
    rng = np.random.default_rng(5)
    p = np.column_stack([rng.integers(500, 1001, 60), rng.integers(-20, 21, (60, 3))]).astype(float)
    q = np.vstack([p[:20], [[-1000.0, 0, 0, 0], [-700.0, 30, 0, 0]]])
    p_ids, q_ids, k = np.arange(60), np.array([*range(20), 900, 901]), 5
    score = (q @ p.T).astype(int)
    score[np.arange(20), np.arange(20)] = -(2**62)  # own id
    seeds = np.argsort(-np.linalg.norm(p, axis=1), kind="stable")[:30]
    limit = np.sort(score[:, seeds], axis=1)[:, -k].astype(float)
    assert (limit[20:] < 0).all() and np.median(limit / (np.linalg.norm(q, axis=1) * np.linalg.norm(p, axis=1).max())) >= topk.STEEP
    found = collections.defaultdict(list)
    for a, b, s in topk.search_bucket(q, q_ids, limit, p, p_ids, k):
        found[a].append((b, s))
    for i, a in enumerate(q_ids.tolist()):
        assert sorted(found[a], key=lambda x: (-x[1], x[0])) == [(j, score[i, j]) for j in np.lexsort((p_ids, -score[i]))[:k]]


def test_vectors_small(spark):
    _, frame = vectors(spark, 30)
    for run in (lambda f: topk.exact_top(f, 10, 5), lambda f: ann.nearest(f, 10, 5)):
        assert run(frame.where("false")).count() == 0
        assert run(frame.where("vec_id = 10")).count() == 0
        assert run(frame.where("vec_id IN (10, 11, 12)")).count() == 2
        twice = frame.where("vec_id IN (10, 11, 12)")
        assert run(twice.union(twice)).where("query_id = vec_id").count() == 0


@pytest.mark.parametrize("bucket", [8192, 16])
def test_rows_of_one_id_are_one_item(spark, monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "SEEDS", 20)
    rng = np.random.default_rng(3)
    rows = [(int(i), v.tolist()) for i, v in zip(np.repeat(np.arange(40), 4), rng.normal(size=(160, 8)).round(3), strict=True)]
    rows += rows[:30]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by = collections.defaultdict(list)
    for i, v in rows:
        by[i].append(np.array(v))
    whole = {i: [np.floor(1024 * v) for v in x] for i, x in by.items()}
    cosine = lambda a, b: (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
    for run, items, score in ((lambda: topk.exact_top(frame, 10, 7), whole, lambda a, b: int(a @ b)), (lambda: ann.nearest(frame, 10, 7, exact=True), by, cosine), (lambda: ann.nearest(frame, 10, 7), by, cosine)):
        found = collections.defaultdict(list)
        for r in run().orderBy("query_id", "rank").collect():
            found[r.query_id].append((r.vec_id, pytest.approx(r.score, abs=1e-12)))
        for q in (0, 10, 20, 30):
            every = {i: max(score(a, b) for a in items[q] for b in items[i]) for i in items if i != q}
            assert [(i, every[i]) for i in sorted(every, key=lambda i: (-every[i], i))[:7]] == found[q]


@pytest.mark.parametrize("exact", [False, True])
def test_ann(spark, monkeypatch, exact):
    monkeypatch.setattr(ann, "TASK", 1000)
    if not exact:
        monkeypatch.setattr(ann, "LEAST", 0)  # the share alone
    rows, frame = vectors(spark, 3000, norms=(0.5, 2.0))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    found = collections.defaultdict(list)
    for r in ann.nearest(frame, 50, 5, exact=exact).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 50 == 0}
    hits, norm = 0, np.sqrt((x * x).sum(axis=1))
    for q, best in found.items():
        i = int(np.nonzero(ids == q)[0][0])
        score = (x[i] * x).sum(axis=1) / (norm[i] * norm)
        exact = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:5]
        hits += len({v for v, _ in best} & set(ids[exact].tolist()))
        assert all(s == score[v] for v, s in best)
    assert hits >= (1 if exact else 0.9) * 5 * len(found)


# 7 PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d or "0"), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_pii(spark, docs, empty):
    rng = random.Random(8)
    bits = ["a.b@c.de", "@", "x@y", "_z@q.r", "1.2.3.4", "256.1.1.1", "1.2.3", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-45.67", "+1", "+", "é", "日", " ", "-", ".", "7", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "card ", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(1500)] + ["1.2.3.4 " * 3000, "9" * 20000, "a" * 50000 + "@", "+1" + " " * 50000, "1 " * 30000, *(whole(t) for t in TEXTS)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.detect(frame).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in found[i] if s.kind in PATTERNS] == base_spans(t), t[:200]
    iban = pii.detect(spark.createDataFrame([("my IBAN GB82 WEST 1234 5698 7654 32.",), ("x GB82 WEST 1234 5698 7654 33.",)], "text string")).collect()
    assert sorted(len(r.spans) for r in iban) == [0, 1]
    assert pii.detect(docs).columns == [c for c in docs.columns if c != "spans"] + ["spans"]
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count() and pii.mask(empty).count() == 0
    out = pii.mask(spark.createDataFrame([("é a.b@c.de, card 4111 1111 1111 1111!", 1), (None, 2), ("no", 3)], "text string, n int")).orderBy("n").collect()
    assert [r.text for r in out] == ["é <EMAIL>, card <CARD>!", None, "no"]


def remainder(iban):
    bare = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def iban_spans(text):
    """By brute force: from each beginning, the valid run of words of the country's length, else the longest if a word of the kind is near."""
    out, at, since = [], 0, 0
    while at < len(text):
        ends = [e for e in range(at + 15, min(len(text), at + 70) + 1) if (e == len(text) or not re.match("[A-Za-z0-9]", text[e])) and re.fullmatch(r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}", text[at:e])]
        good = [e for e in ends if remainder(text[at:e]) == 1]
        exact = [e for e in good if len(text[at:e].replace(" ", "")) == pii.LENGTHS.get(text[at : at + 2])]
        near = re.search("iban|account|konto|compte|cuenta", text[max(since, at - 40) : at].lower())
        if good and (exact or near) and (at == 0 or not re.match("[A-Za-z0-9]", text[at - 1])):
            since = exact[0] if exact else max(good)
            out.append((at, since))
        at = since if out and out[-1][0] == at else at + 1
    return out


def test_iban_before_words(spark):
    bare, spaced, german = "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    expected = {f"{bare} Please pay": [bare], f"{spaced} Please": [spaced], f"{bare} BIC": [bare], f"{bare} 12 euros": [bare], f"{german} I paid": [german], f"{spaced} A1 {german}": [spaced, german], f"{bare} {german} {spaced}": [bare, german, spaced], f"AB12 {german} Z": [german], f"AB12CD34EF56GH78 {german}": [german], f"{bare}x": [], f"x{bare}": [], f"é\U0001f600 {bare} É": [bare], f"{bare[:-1]}3 Please": []}
    rng = random.Random(9)
    bits = [bare, spaced, german, "NO9386011117947", "ZZ65123456789012", "MT84MALT011000012345MTLCAST001S", "AB12", "A", "7", "Please", "12 euros", "BIC", " ", " ", " ", ".", "é", "\n", "iban "]
    texts = [*expected, *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(1500)), "AB12 " * 3000, "AB12" * 5000, f"{bare} " * 500]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in pii.detect(frame).collect()}
    for i, t in enumerate(texts):
        assert found[i] == iban_spans(t), t[:200]
    for i, t in enumerate(expected):
        assert [t[a:b] for a, b in found[i]] == expected[t], t
    scores = pii.detect(spark.createDataFrame([(f"my IBAN AB12 {german} and {spaced} Please",)], "text string")).first().spans
    assert [(s.kind, s.score) for s in scores if s.kind == "iban"] == [("iban", 0.95), ("iban", 0.7)]
    assert [r.text for r in pii.mask(spark.createDataFrame([(f"to {bare} Please",)], "text string")).collect()] == ["to <IBAN> Please"]


def test_context_decides_on_added_kinds(spark):
    odd = "ZZ65123456789012"  # valid, of no country
    assert remainder(odd) == 1
    cases = {
        f"iban {odd}": ["iban"], f"code {odd}": [], f"iban{'.' * 36}{odd}": ["iban"], f"iban{'.' * 37}{odd}": [], f"code GB82WEST12345698765432": ["iban"],
        "ssn 123-45-6789": ["ssn"], "part 123-45-6789": [], "ssn 000-45-6789": [], "ssn 123-45-67890": [], f"SSN{'.' * 37}123-45-6789": ["ssn"], f"SSN{'.' * 38}123-45-6789": [],
        "code 1.2.3.4": ["ip"], "server 1.2.3.4": ["ip"],
    }
    found = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    spans = {r.i: r.spans for r in pii.detect(found).collect()}
    assert [[s.kind for s in spans[i]] for i in range(len(cases))] == list(cases.values())
    assert [spans[i][0].score for i in (11, 12)] == [0.5, 0.75] and spans[0][0].score == pytest.approx(0.7)
    masked = {r.i: r.text for r in pii.mask(found).collect()}
    assert masked[0] == "iban <IBAN>" and masked[1] == f"code {odd}" and masked[5] == "ssn <SSN>"


def test_masking_by_brute_force(spark):
    rng = random.Random(12)
    bits = ["a.b@c.de", "1.2.3.4", "4111 1111 1111 1111", "+49 (30) 123-45.67", "GB82 WEST 1234 5698 7654 32", "+1.2.3.4.5.6.7.8.9.0", "é", "\U0001f600", " ", "-", "x", "ssn 123-45-6789"]
    texts = ["".join(rng.choice(bits) for _ in range(n)) for n in [*(rng.randrange(1, 30) for _ in range(400)), 3000, 3000]]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    spans, masked = ({r.i: r[1] for r in f.collect()} for f in (pii.detect(frame).select("i", "spans"), pii.mask(frame)))
    for i, t in enumerate(texts):
        out, at, end = "", 0, 0
        for s in spans[i]:
            if s.start >= end:
                out += t[max(at, end) : s.start] + f"<{s.kind.upper()}>"
                at = s.start
            end = max(end, s.end)
        assert masked[i] == out + t[end:], t[:100]


def test_masking_many_spans_is_linear(spark):
    import time

    frame = spark.createDataFrame([("1.2.3.4 " * 40000 + "iban GB82 WEST 1234 5698 7654 32 " * 2000,)], "text string")
    began = time.time()
    masked = pii.mask(frame).first().text
    assert masked == "<IP> " * 40000 + "iban <IBAN> " * 2000 and time.time() - began < 60


# 8 Katz


def katz_brute(texts, held, order):
    """Counts of all orders, N, V, and p(history, word) by the definition."""
    c = [collections.Counter() for _ in range(order + 1)]
    for t, h in zip(texts, held, strict=True):
        if not h:
            x = [1, *katz.tokens(t), 0]
            for i in range(1, len(x)):
                for m in range(1, min(order, i + 1) + 1):
                    c[m][tuple(x[i - m + 1 : i + 1])] += 1
    n, v = sum(c[1].values()), len(c[1])
    low = [None, *(katz.discounts(np.array([sum(k == r for k in c[m].values()) for r in range(1, katz.K + 2)])) for m in range(1, order + 1))]
    cut = lambda m, k: k - katz.DELTA if k > katz.K else low[m][k - 1]
    p0 = 1 - sum(cut(1, k) for k in c[1].values()) / n if n else 1.0
    after = collections.defaultdict(list)
    for m in range(2, order + 1):
        for g, k in c[m].items():
            after[g[:-1]].append(g[-1])
    own = collections.Counter()
    for m in range(2, order + 1):
        for g, k in c[m].items():
            own[g[:-1]] += k

    def p(h, w):
        if not h:
            return cut(1, c[1][(w,)]) / n if c[1][(w,)] else p0
        m = len(h) + 1
        if c[m][(*h, w)]:
            return cut(m, c[m][(*h, w)]) / own[h]
        if not after[h]:
            return p(h[1:], w)
        return p(h[1:], w) * (1 - sum(cut(m, c[m][(*h, x)]) for x in after[h]) / own[h]) / (1 - sum(p(h[1:], x) for x in after[h]))

    return c, n, v, p


def katz_texts(seed=9, many=300):
    rng = random.Random(seed)
    words = ["The", "the", "of", *(f"w{i}" for i in range(40))]
    return [" ".join(rng.choices(words, weights=[400, 200, 100, *(40 / (i + 1) for i in range(40))], k=rng.choice([0, 1, 2, 5, 60]))) for _ in range(many)] + ["new words only", "the new", None, "the " * 3000]


def katz_check(found, texts, order):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c, n, v, p = katz_brute(texts, held, order)
    for i, t in enumerate(texts):
        x, r = [1, *katz.tokens(t), 0], found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x) - 1, sum((w,) in c[1] for w in x[1:]), n)
        assert math.isclose(r.base_score, sum(math.log10((c[1][(w,)] + 1) / (n + v + 1)) for w in x[1:]), rel_tol=1e-9)
        memo = {}
        expected = 0.0
        for j in range(1, len(x)):
            h = tuple(x[max(0, j - order + 1) : j])
            if (h, x[j]) not in memo:
                memo[h, x[j]] = math.log10(p(h, x[j]))
            expected += memo[h, x[j]]
        assert math.isclose(r.score, expected, rel_tol=1e-9)
    for h in ((1,), (b"the",), (1, b"the"), (b"the", b"the"), (b"the", b"w3"), (b"unknown", b"the"), (b"of", b"unknown")):
        if len(h) < order:
            assert math.isclose(sum(p(h, w) for (w,) in c[1]) + p(h, b"never seen"), 1, rel_tol=1e-9)
    return c


@pytest.mark.parametrize(("order", "parts", "chunk"), [(1, 5, 200), (2, 64, 200), (3, 1, 200), (3, 64, 4_000_000), (3, 64, 1), (4, 5, 700)])
def test_katz(spark, monkeypatch, tmp_path, order, parts, chunk):
    monkeypatch.setattr(katz, "LEAST_PARTS", parts)
    texts = katz_texts()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3, "doc_id")
    found = {r.doc_id: r for r in katz.scored(frame, crc_mod(F.col("doc_id"), 7) == 2, order=order, chunk=chunk, path=str(tmp_path / "model")).collect()}
    c = katz_check(found, texts, order)
    stored = collections.defaultdict(list)
    for r in katz.counts(spark, str(tmp_path / "model")).collect():
        assert len(r.words) == r.order
        stored[r.order].append((tuple(r.words), r.c))
    for m in range(1, order + 1):
        assert sorted(k for _, k in stored[m]) == sorted(k for k in c[m].values() if k)
        assert len({g for g, _ in stored[m]}) == len(stored[m])
    assert {g: k for (g,), k in stored[1]} == {int(np.uint64(xxhash.xxh64_intdigest(w or b"")).view(np.int64)): k for (w,), k in c[1].items()}


def test_katz_query(spark, tmp_path):
    from factloom.llm import queries

    texts = katz_texts(seed=10)
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op8_katz(spark, str(tmp_path))
    assert katz.ORDER == 3 and found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    katz_check({r.doc_id: r for r in found.collect()}, texts, 3)


def test_katz_rows(spark, docs, empty):
    found = katz.scored(docs, crc_mod(F.col("doc_id"), 7) == 2)
    assert found.count() == docs.count() and found.where("score > 0 OR isnan(score)").count() == 0
    assert found.where("doc_id IS NULL").count() == 1
    assert katz.scored(empty, F.lit(False)).count() == 0
    assert katz.scored(docs, F.lit(True)).where("train_tokens <> 0 OR score <> 0 OR base_score <> 0").count() == 0


# 10 SimHash


def simhash_brute(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", whole(text).encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def groups_brute(ids, codes, radius=4):
    label = list(range(len(ids)))
    for _ in ids:
        before = list(label)
        for i, x in enumerate(codes):
            near = [j for j, y in enumerate(codes) if bin(x ^ y).count("1") <= radius]
            low = min(label[j] for j in near)
            for j in near:
                label[j] = min(label[j], low)
            label[i] = min(label[i], low)
        if label == before:
            break
    least = {}
    for i, k in zip(ids, label, strict=True):
        least[k] = min(least.get(k, i), i)
    return [least[k] for k in label]


@pytest.mark.parametrize("shard", [65536, 40])
def test_simhash_links(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(10)
    codes = [rng.getrandbits(64) for _ in range(250)]
    for i in range(120):  # near copies, also at the limit and just beyond it
        x = rng.choice(codes[:40])
        for b in rng.sample(range(64), rng.choice([1, 3, 4, 5, 6])):
            x ^= 1 << b
        codes.append(x)
    codes += [0, 0, (1 << 64) - 1, 15, codes[3]]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    least = {c: i for i, c in reversed(list(enumerate(signed)))}
    huge = (1 << 62) + 1  # ids that no double can tell apart
    edges = simhash.link(spark.createDataFrame([(c, huge + i) for c, i in least.items()], "fp long, least long"))
    label = {r.node.fp: r.label.least - huge for r in components(edges).collect()}
    assert all(r.node > r.label for r in components(edges).collect())
    found = [label.get(c, least[c]) for c in signed]
    assert found == groups_brute(list(range(len(codes))), codes)


def test_simhash(spark, docs, empty):
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL").collect()
    found = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()}
    codes = [simhash_brute(r.text) for r in rows]
    expected = groups_brute([r.doc_id for r in rows], codes)
    assert all(found[r.doc_id] == (c, e) for r, c, e in zip(rows, codes, expected, strict=True))
    assert simhash.near_duplicates(docs).count() == docs.count() and simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(expected)) and kept.where("doc_id IS NULL").count() == 1
