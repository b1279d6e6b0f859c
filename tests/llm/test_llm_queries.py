"""The registered queries on the smallest tables: against DuckDB where SQL says them, else against brute force."""

import base64
import collections
import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from factloom.llm import oracles, packing, queries
from tests.llm.test_operators import base_spans, groups_brute, simhash_brute
from tests.test_queries import plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF).toPandas()
    assert len(found) and plain(found) == plain(con.sql(oracles.SQL[name]).df())


def test_op2(spark, texts):
    full = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {i: [*full.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    found = queries.op2_packing(spark, SF).collect()
    by, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for i, rows in by.items():
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == np.cumsum([0, *(r.length for r in rows[:-1])]).tolist() and sum(r.length for r in rows) == len(ids[i])
        for r in rows:
            assert r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], dtype="<u4").tobytes())
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *(r.length for r in rows[:-1])]).tolist() and sum(r.length for r in rows) <= 2048


def test_op4(spark, texts):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    found = queries.op4_langid(spark, SF).collect()
    assert {r.doc_id for r in found} == set(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and lang[r.doc_id] is not None and any(c.isalpha() for c in texts[r.doc_id])]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op5(spark, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = queries.op5_bpe(spark, SF).collect()
    assert {r.doc_id for r in found} == set(texts)
    for r in found:
        ids = public.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_op7(spark, texts):
    found = queries.op7_pii(spark, SF).collect()
    assert {r.doc_id for r in found} == set(texts)
    for r in found:
        spans = base_spans(texts[r.doc_id])
        joined = [f"{k}:{s}:{e}" for k, s, e in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in ("email", "ip", "card", "phone")]
        own = r.spans.split(",") if r.spans else []
        assert set(joined) <= set(own) and len(r.scores.split(",") if r.scores else []) == len(own)


def test_op9(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    norm, hits, total = np.sqrt((x * x).sum(axis=1)), 0, 0
    found = collections.defaultdict(dict)
    for r in queries.op9_ann(spark, SF).collect():
        found[r.query_id][r.vec_id] = r.score
    assert set(found) == {i for i in ids.tolist() if i % 50 == 0}
    for q, best in found.items():
        i = int(np.nonzero(ids == q)[0][0])
        score = (x[i] * x).sum(axis=1) / (norm[i] * norm)
        exact = [ids[j] for j in np.lexsort((ids, -score)) if ids[j] != q][:5]
        hits, total = hits + len(set(exact) & set(best)), total + 5
        assert all(abs(s - score[ids == v][0]) < 1e-15 for v, s in best.items())
    assert hits >= 0.9 * total


def test_op10(spark, texts):
    found = {r.doc_id: r for r in queries.op10_simhash(spark, SF).collect()}
    codes = [simhash_brute(t) for t in texts.values()]
    for i, code, group in zip(texts, codes, groups_brute(list(texts), codes), strict=True):
        assert (found[i].fingerprint, found[i].component_id) == (f"{code:016x}", group)
