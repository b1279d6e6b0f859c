"""Vectors, hybrid search, reranking and beliefs on small fixtures with exact expectations."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import belief, english, text, vectors
from factloom.functions.embedding import HashingEmbedder, embedded
from factloom.operators import cache, feedback, search
from factloom.operators.rerank import Reranker, Stats, decode, decode_posterior, encode, encode_posterior, predicted_of, stats_of, try_load
from factloom.operators.windows import numbered, with_context
from factloom.sources.vectors import cache_records, scan_cache

FACTS = "project_id string, ord long, content string, embedding array<float>, context_window array<string>"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("p", 0, "tide tables", [2.0, 0.0, 0.0], []), ("p", 1, "moon tables", [3.0, 1.0, 0.0], []), ("p", 2, "sail repair", [0.0, -1.0, 5.0], [])]
    return spark.createDataFrame(rows, FACTS)


@pytest.mark.parametrize("a, b, expected", [([1, 2, 3], [1, 2, 3], 1), ([1, 0], [0, 1], 0), ([1, 2, 3], [-1, -2, -3], -1), ([1, 2], [1], 0), ([0, 0], [1, 0], 0), (None, [1], None)])
def test_cosine(spark, a, b, expected):
    a, b = ([float(x) for x in v] if v is not None else None for v in (a, b))
    row = spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b"))).first()[0]
    assert row == (None if expected is None else pytest.approx(expected, abs=1e-6))


def test_dense_only(facts):
    found = search.hybrid(facts, [1.0, 0.0, 0.0], "", 2, 0.5).orderBy("rank").collect()
    assert [(r.ord, r.score) for r in found] == [(0, pytest.approx(1 / 61)), (1, pytest.approx(1 / 62))]


def test_empty_store(facts):
    none = facts.where("false")
    assert search.hybrid(none, [1.0, 0.0, 0.0], "tide", 10, 0.0).count() == 0
    assert search.hybrid(none, [1.0, 0.0, 0.0], "", 10, 0.0, fixture(2, 3)).count() == 0


def test_context_is_searched(spark):
    rows = spark.createDataFrame([("p", 0, "tide tables", None, ["printed in the harbour", "read at dawn"])], FACTS)
    assert search.lexical(rows, "dawn").count() == 1 and search.lexical(rows, "dawn", with_context=False).count() == 0


def test_hybrid_is_bounded_and_ignores_row_order(facts):
    found = search.hybrid(facts, [1.0, 0.0, 0.0], "tide tables", 3, 0.0).orderBy("rank").collect()
    assert found[0].score == pytest.approx(2 / 61) and max(r.score for r in found) <= 2 / 61 + 1e-12
    turned = search.hybrid(facts.orderBy(F.desc("ord")), [1.0, 0.0, 0.0], "tide tables", 3, 0.0).orderBy("rank").collect()
    assert found == turned


def test_reranking_drops_hits_without_vector_and_keeps_mismatches_unscaled(spark):
    rows = spark.createDataFrame([("p", 0, "word one", [1.0, 0.0, 0.0, 0.0], []), ("p", 1, "word two", None, []), ("p", 2, "word three", [1.0], [])], FACTS)
    plain = {r.ord for r in search.hybrid(rows, [1.0, 0.0, 0.0, 0.0], "word", 5, 0.5).collect()}
    model = search.hybrid(rows, [1.0, 0.0, 0.0, 0.0], "word", 5, 0.5, fixture(2)).collect()
    assert plain == {0, 1, 2} and {r.ord for r in model} == {0, 2}
    assert next(r.score for r in model if r.ord == 2) in (0.0, 1.0)


def fixture(version, dim=4):
    w1 = np.zeros((2, dim * (2 if version == 1 else 4)))
    w1[0, 0] = w1[1, 1] = 1
    return Reranker(version, w1, np.zeros(2), np.array([0.5, 0.5]), np.eye(2), 0.0, 0.1)


@pytest.mark.parametrize("version", [1, 2])
def test_predict(version):
    model = fixture(version)
    phi = model.features(np.array([1, 0, 0, 0.0]), np.array([[0, 1, 0, 0.0]]))
    assert phi.tolist() == [[1, 0]]
    mean, variance = model.predict(phi)
    assert mean[0] == pytest.approx(0.5) and variance[0] == pytest.approx(1.1)
    phi = model.features(np.array([1, 0.5, 0, 0]), np.array([[0.5, 1, 0, 0]]))
    assert phi.tolist() == [[1, 0.5]]
    assert [x[0] for x in model.predict(phi)] == [pytest.approx(0.75), pytest.approx(1.35)]


def stats(*rows):
    return Stats.of(np.array([p for p, _ in rows], dtype=float), np.array([r for _, r in rows], dtype=float))


def test_update():
    assert fixture(2).updated(stats(([1, 0.5], 1))).mu == pytest.approx([0.685185, 0.592593], abs=1e-6)
    assert fixture(2).updated(stats(([1, 0], 1))).sigma[0, 0] == pytest.approx(0.090909, abs=1e-6)
    both = fixture(2).updated(stats(([1, 0.5], 0.8))).updated(stats(([1, 0.5], 0.9)))
    assert both.mu == pytest.approx([0.576923, 0.538462], abs=1e-6) and both.sigma[0, 0] == pytest.approx(0.230769, abs=1e-6) and both.updates == 2


def test_update_is_the_same_in_any_batches(spark):
    rng = random.Random(1)
    rows = [([rng.random(), rng.random()], rng.random()) for _ in range(60)]
    model = fixture(2)
    for r in rows:
        model = model.updated(stats(r))
    total = stats_of(spark.createDataFrame(rows, "phi array<double>, reward double").repartition(5), 2)
    once = fixture(2).updated(total)
    assert once.mu == pytest.approx(model.mu, abs=1e-12) and once.sigma == pytest.approx(model.sigma, abs=1e-12) and once.updates == 60
    assert stats_of(spark.createDataFrame([], "phi array<double>, reward double"), 2).n == 0


def test_weight_and_posterior_files(tmp_path):
    for version in (1, 2):
        model = fixture(version)
        same = decode(encode(model))
        assert (same.version, same.dim, same.w1.tolist(), same.sigma.tolist()) == (version, 4, model.w1.tolist(), model.sigma.tolist())
    learned = fixture(2).updated(stats(([1, 0.5], 0.8), ([1, 0.5], 0.9)))
    again = decode_posterior(encode_posterior(learned), fixture(2))
    assert again.updates == 2 and again.mu == pytest.approx(learned.mu, abs=1e-6)
    for bad in (b"XXXX" + encode_posterior(learned)[4:], encode_posterior(learned)[:-1]):
        with pytest.raises(ValueError):
            decode_posterior(bad, fixture(2))
    (tmp_path / "w").write_bytes(encode(fixture(2)))
    (tmp_path / "p").write_bytes(b"bad")
    assert try_load(tmp_path / "none") is None and try_load(tmp_path / "w", tmp_path / "p").updates == 0


def test_wrong_dimension_is_an_error():
    with pytest.raises(ValueError):
        fixture(2).features(np.zeros(3), np.zeros((1, 3)))


def test_beliefs(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (5.0, 2.0), (-1.0, 2.0)], "a float, b float")
    a, b = F.col("a"), F.col("b")
    found = rows.select(belief.mean(a, b), belief.uninformed(a, b), belief.equals(a, b, F.lit(0.5))).collect()
    assert found[0] == (0.5, True, True) and not found[1][1]
    assert [r[0] for r in rows.select(belief.compared(a, b, F.lit(0.5))).collect()] == [0, 1, 1, -1]
    draws = [r[0] for r in rows.where("a = 5").crossJoin(spark.range(100)).select(belief.sample(a, b, F.col("id"))).collect()]
    assert all(0 <= x <= 1 for x in draws) and len(set(draws)) > 90


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_context_windows(spark, n):
    rows = spark.createDataFrame([("p", "s", i, str(i)) for i in range(6)] + [("q", "s", 0, "x")], "project_id string, session_id string, ord long, content string")
    for r in with_context(rows, n).collect():
        size = 6 if r.project_id == "p" else 1
        assert r.context_window == [str(j) for j in range(max(0, r.ord - n), min(size, r.ord + n + 1)) if j != r.ord]


def test_rewards(spark):
    got = spark.createDataFrame([(x,) for x in (0.0, 0.29, 0.3, 0.4, 0.55, 0.56, 1.0)], "s double").select(feedback.reward_of(F.col("s"))).collect()
    assert [r[0] for r in got] == [0.0, 0.0, None, None, None, 0.56, 1.0]


def test_feedback_counts_the_fact_itself_unless_told_not_to(spark):
    facts = spark.createDataFrame([("p", "a", 0, [1.0, 0.0, 0.0, 0.0]), ("p", "b", 1, [0.0, 1.0, 0.0, 0.0]), ("p", "c", 2, None)], "project_id string, fact_id string, ord long, embedding array<float>")
    log = spark.createDataFrame([("s", "p", [1.0, 0.0, 0.0, 0.0], ["a", "gone", "c"])], "search_id string, project_id string, query_embedding array<float>, returned_fact_ids array<string>")
    assert [r.reward for r in feedback.rewards(log, facts).collect()] == [1.0]
    assert [r.reward for r in feedback.rewards(log, facts, exclude_self=True).collect()] == [0.0]
    assert feedback.learned(log, facts, fixture(2)).updates == 1


def test_texts(spark):
    row = spark.createDataFrame([(" 　Use X\t", "  ", "/a/b/", "/")], "d string, r string, p string, q string").select(text.strip(F.col("d")), text.decision_text(F.col("d"), F.col("r")), text.decision_text(F.col("d"), F.lit("fast")), text.basename(F.col("p")), text.basename(F.col("q")), text.words(F.lit("Ab-c  d"))).first()
    assert tuple(row) == ("Use X", "Use X", "Use X (Reason: fast)", "b", "unknown", ["ab", "c", "d"])


def test_embedding_cache(spark, tmp_path):
    key = hashlib.md5(b"a known line").digest()
    rows = [(key, [0.0] * 8), (hashlib.md5(b"another line").digest(), [7.0 - i for i in range(8)]), (key, [i / 16 for i in range(8)])]
    (tmp_path / "cache.bin").write_bytes(cache_records(rows) + b"partial")
    found = cache.latest(scan_cache(spark, str(tmp_path / "cache.bin"), 8))
    assert {bytes(r.key): r.embedding for r in found.collect()}[key] == [i / 16 for i in range(8)]
    texts = spark.createDataFrame([("a known line",), ("new",), ("new",), (None,)], "text string")
    assert [r.hit for r in cache.looked_up(texts, found).orderBy("text").collect()] == [False, True, False, False]
    assert cache.missing(texts, found).count() == 1


def test_embedder(spark):
    own = spark.createDataFrame([("a b",), (None,)], "t string").select(embedded(F.col("t"))).collect()
    assert own[0][0] == pytest.approx(HashingEmbedder().embed(["a b"])[0]) and own[1][0] is None


@pytest.mark.parametrize("word, expected", [w.split(":") for w in "consigned:consign knocking:knock happy:happi relational:relat running:run hopping:hop hoping:hope generously:generous skies:sky ties:tie cries:cri gas:gas kiwis:kiwi feed:feed agreed:agre dying:die by:by say:say conditional:condit digitizer:digit hopeful:hope goodness:good adjustment:adjust adoption:adopt rate:rate controll:control luxuriated:luxuri".split()])
def test_stems(word, expected):
    assert english.stem(word) == expected


def test_english_search_meets_other_forms(spark):
    rows = spark.createDataFrame([("p", 0, "The runner was running", None, []), ("p", 1, "the the the", None, [])], FACTS)
    assert [r.ord for r in search.lexical(rows, "the runs", english=True).collect()] == [0]
    assert search.lexical(rows, "runs").count() == 0 and search.lexical(rows, "the", english=True).count() == 0


def test_model_states(spark, tmp_path):
    from factloom.sources import model

    (tmp_path / "w").write_bytes(encode(fixture(2)))
    prior = model.read_weights(spark, str(tmp_path / "w"))
    for n in (1, 2):
        model.append_state(spark, prior.updated(stats(*[([1, 0.5], 0.8)] * n)), str(tmp_path / "state"))
    assert model.latest_state(spark, prior, str(tmp_path / "state")).updates == 2


def test_cache_append(spark, tmp_path):
    rows = spark.createDataFrame([(b"k", [1.0])], "key binary, embedding array<float>")
    cache.append(rows, str(tmp_path / "c"))
    cache.append(rows.withColumn("embedding", F.array(F.lit(2.0).cast("float"))), str(tmp_path / "c"))
    assert cache.latest(spark.read.parquet(str(tmp_path / "c"))).first().embedding == [2.0]


def test_predictions_as_columns(spark):
    rows = spark.createDataFrame([([1.0, 0.5, 0.0, 0.0], [0.5, 1.0, 0.0, 0.0]), ([1.0, 0.0, 0.0, 0.0], [1.0]), (None, None)], "q array<float>, c array<float>")
    found = rows.select(predicted_of(fixture(2), F.col("q"), F.col("c")).alias("p")).collect()
    assert (found[0].p.mean, found[0].p.variance) == (pytest.approx(0.75), pytest.approx(1.35)) and found[1].p is None and found[2].p is None


def test_numbers_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", "c"]), i) for i in range(500)]
    found = numbered(spark.createDataFrame(rows, "k string, i int").repartition(7), [F.desc("k"), "i"]).collect()
    assert [(r.k, r.i) for r in sorted(found, key=lambda r: r.place)] == sorted(rows, key=lambda x: (x[0] is None, -ord(x[0] or "a"), x[1]))
    assert [r.place for r in sorted(found, key=lambda r: r.place)] == list(range(1, 501))
    assert numbered(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_english_words_and_candidates(spark):
    rng = random.Random(6)
    bits = ["run", "ning", "ies", "y", "abil", "ity", "iz", "ation", "al", "'s", "'", "the", "don't", "é", "ß", "日", "٣", "_", " ", " ", "-", "sky", "skies", "dying", "ly", "ful", "ness", "ed"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", english.stems(english.content_words(F.lower("t"))).alias("s")).collect()
    assert all(r.s == english.terms(r.t) for r in found)
    words = {w for t in texts for w in re.findall(r"[^\W_]+(?:'[^\W_]+)?", t.lower())} | set(english.SPECIAL)
    assert all(w.startswith(english.stem(w)[:-1]) or w in english.SPECIAL for w in words)


def test_sampled_order_is_the_blend(spark):
    rows = spark.createDataFrame([("p", i, [1.0, i / 9], (1.0 + i % 3, 1.0, 0.0)) for i in range(9)], "project_id string, ord long, embedding array<float>, utility struct<alpha:float,beta:float,decay_rate:float>")
    found = search.dense(rows, [1.0, 0.0], utility_lambda=0.2, seed=7).collect()
    draws = {r.ord: r.d for r in rows.select("ord", belief.sample(F.col("utility.alpha"), F.col("utility.beta"), F.struct("project_id", "ord"), 7).alias("d")).collect()}
    near = {i: 1 / (1 + (i / 9) ** 2) ** 0.5 for i in range(9)}
    order = {i: near[i] if i % 3 == 0 else 0.8 * near[i] + 0.2 * draws[i] for i in near}
    assert [r.ord for r in sorted(found, key=lambda r: r.rank)] == sorted(order, key=lambda i: -order[i])
    assert all(r.cosine == pytest.approx(near[r.ord], abs=1e-6) for r in found)
