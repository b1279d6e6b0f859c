"""The engine's queries over the test data, and their DuckDB oracles.

Scores are rounded to six digits, and ranks compare scores at nine, so that the order of summation can't show.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import belief, text, vectors
from factloom.operators import cache, catalog, feedback, ingest, search
from factloom.operators.rerank import Reranker, features_of, predicted_of, stats_of
from factloom.operators.windows import numbered, top
from factloom.plans.tables import FACTS_SQL, QUERY_TEXT, SESSIONS_SQL, facts, lexical_sql, query_vector, sessions, table
from factloom.sources import documents, model
from factloom.sources.shared import kept, working_dir
from factloom.streaming import feedback as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LIMIT = 5
NOW = "2025-01-01 00:00:00"
TERMS = search.terms_of(QUERY_TEXT)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def six(name: str):
    return F.round(name, 6).alias(name)


# Retrieval


@query(FACTS_SQL + "SELECT project_id, ord, round(cosine, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY round(cosine, 9) DESC, ord) AS rank FROM cosines) WHERE rank <= 5")
def cosine_topk(spark, sf_dir):
    near = vectors.cosine(F.col("embedding"), vectors.literal(query_vector(spark, sf_dir)))
    rows = facts(spark, sf_dir, context=False).where("embedding IS NOT NULL").select("project_id", "ord", near.alias("cosine"))
    return top(rows, ["project_id"], "cosine", ["ord"], LIMIT).select("project_id", "ord", six("cosine"), "rank")


@query(FACTS_SQL + "SELECT project_id, ord, round(cosine, 6) AS cosine, rank FROM dense")
def cosine_threshold(spark, sf_dir):
    return search.dense(facts(spark, sf_dir, context=False), query_vector(spark, sf_dir)).select("project_id", "ord", six("cosine"), "rank")


@query(FACTS_SQL + "SELECT project_id, ord, len(context_window) AS n, md5(array_to_string(context_window, '|')) AS context FROM facts")
def context_window(spark, sf_dir):
    return facts(spark, sf_dir).select("project_id", "ord", F.size("context_window").cast("long").alias("n"), F.md5(F.array_join("context_window", "|")).alias("context"))


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("ord"), F.col("text").alias("content"))


CORPUS_SQL = "SELECT source AS project_id, doc_id AS ord, text AS body FROM documents"


@query("WITH " + lexical_sql(CORPUS_SQL, TERMS, limit=20) + "SELECT project_id, ord, round(bm25, 6) AS bm25, rank FROM lexical")
def bm25_topk(spark, sf_dir):
    return search.lexical(corpus(spark, sf_dir), QUERY_TEXT, 20, with_context=False).select("project_id", "ord", six("bm25"), "rank")


BODY_SQL = "SELECT project_id, ord, CASE WHEN len(context_window) > 0 THEN content || ' ' || array_to_string(context_window, ' ') ELSE content END AS body FROM facts"


@query(FACTS_SQL + "," + lexical_sql(BODY_SQL, TERMS) + "SELECT project_id, ord, round(bm25, 6) AS bm25, rank FROM lexical")
def bm25_context_augmented(spark, sf_dir):
    return search.lexical(facts(spark, sf_dir), QUERY_TEXT).select("project_id", "ord", six("bm25"), "rank")


@query(f"""
WITH w AS (SELECT source AS project_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT project_id, count(*) AS n, avg(len(words)) AS avgdl FROM w GROUP BY 1),
d AS (SELECT project_id, term, count(*) AS df FROM (SELECT project_id, unnest(list_distinct(words)) AS term FROM w) GROUP BY ALL)
SELECT project_id, term, df, n, round(avgdl, 6) AS avgdl FROM d JOIN s USING (project_id)
""")
def bm25_corpus_stats(spark, sf_dir):
    return search.corpus_stats(corpus(spark, sf_dir)).select("project_id", "term", "df", "n", six("avgdl"))


def fused_sql(limit: int) -> str:
    return FACTS_SQL + "," + lexical_sql(BODY_SQL, TERMS, limit=3 * limit) + ", fused AS (SELECT project_id, ord, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT project_id, ord, rank FROM dense UNION ALL SELECT project_id, ord, rank FROM lexical) GROUP BY ALL), best AS (SELECT project_id, ord, rrf AS score, row_number() OVER (PARTITION BY project_id ORDER BY round(rrf, 9) DESC, ord) AS rank FROM fused)"


@query(fused_sql(LIMIT) + "SELECT project_id, ord, round(rrf, 6) AS rrf FROM fused")
def rrf_fusion(spark, sf_dir):
    rows = facts(spark, sf_dir)
    return search.fused(search.dense(rows, query_vector(spark, sf_dir)), search.lexical(rows, QUERY_TEXT, 3 * LIMIT)).select("project_id", "ord", six("rrf"))


@query(fused_sql(LIMIT) + "SELECT project_id, ord, round((rrf - min(rrf) OVER p) / greatest(max(rrf) OVER p - min(rrf) OVER p, 1e-8), 6) AS norm FROM fused WINDOW p AS (PARTITION BY project_id)")
def minmax_normalize(spark, sf_dir):
    rows = facts(spark, sf_dir)
    hits = search.fused(search.dense(rows, query_vector(spark, sf_dir)), search.lexical(rows, QUERY_TEXT, 3 * LIMIT))
    return search.normalised(hits).select("project_id", "ord", six("norm"))


@query(fused_sql(LIMIT) + "SELECT project_id, ord, round(score, 6) AS score, rank FROM best WHERE rank <= 5")
def hybrid_search(spark, sf_dir):
    return search.hybrid(facts(spark, sf_dir), query_vector(spark, sf_dir), QUERY_TEXT, LIMIT).select("project_id", "ord", six("score"), "rank")


@query(fused_sql(LIMIT) + "SELECT project_id, ord, round(score, 6) AS score, content FROM best JOIN facts USING (project_id, ord) WHERE rank <= 5 ORDER BY round(score, 9) DESC, project_id, ord LIMIT 20")
def hybrid_search_cross_project(spark, sf_dir):
    rows = facts(spark, sf_dir)
    hits = search.across(search.hybrid(rows, query_vector(spark, sf_dir), QUERY_TEXT, LIMIT), 20)
    return hits.join(rows.select("project_id", "ord", "content"), ["project_id", "ord"]).select("project_id", "ord", six("score"), "content")


@query(FACTS_SQL + f", {SESSIONS_SQL} SELECT project_id, ord, category, summary AS session_summary FROM facts LEFT JOIN s USING (project_id)")
def session_summary_join(spark, sf_dir):
    rows, own = facts(spark, sf_dir, context=False), sessions(spark, sf_dir)
    return rows.join(own, ["project_id", "session_id"], "left").select("project_id", "ord", "category", F.col("summary").alias("session_summary"))


@query(fused_sql(LIMIT) + f", {SESSIONS_SQL} SELECT project_id, rank, fact_id, content, category, round(score, 6) AS score, array_to_string(context_window, '|') AS context, summary AS session_summary, 0.5::DOUBLE AS utility_mean, 0::BIGINT AS access_count, TIMESTAMP '2025-01-01' AS created_at FROM best JOIN facts USING (project_id, ord) LEFT JOIN s USING (project_id) WHERE rank <= 5")
def search_result_projection(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumns({"utility": F.expr("named_struct('alpha', 1f, 'beta', 1f, 'decay_rate', 0f)"), "access_count": F.lit(0).cast("long"), "created_at": F.lit(NOW).cast("timestamp")})
    found = search.results(search.hybrid(rows, query_vector(spark, sf_dir), QUERY_TEXT, LIMIT), rows, sessions(spark, sf_dir))
    return found.withColumns({"score": F.round("score", 6), "context": F.array_join("context", "|")})


@query(fused_sql(LIMIT) + f", {SESSIONS_SQL} SELECT content, category, round(score, 6) AS score, array_to_string(context_window, '|') AS context, summary AS session_summary, '/conv/' || project_id AS project_path, TIMESTAMP '2025-01-01' AS created_at FROM best JOIN facts USING (project_id, ord) LEFT JOIN s USING (project_id) WHERE rank <= 5 ORDER BY round(best.score, 9) DESC, project_id, ord LIMIT 20")
def search_result_projection_cross_project(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("created_at", F.lit(NOW).cast("timestamp"))
    hits = search.across(search.hybrid(rows, query_vector(spark, sf_dir), QUERY_TEXT, LIMIT), 20)
    projects = rows.select("project_id").distinct().withColumn("project_path", F.concat(F.lit("/conv/"), F.col("project_id").cast("string")))
    found = search.results_across(hits, rows, sessions(spark, sf_dir), projects)
    return found.withColumns({"score": F.round("score", 6), "context": F.array_join("context", "|")})


# Reranking


def weights(version: int, dim: int = 64, hidden: int = 2) -> Reranker:
    """Small weights by a formula."""
    width = dim * (2 if version == 1 else 4)
    i, j = np.arange(hidden)[:, None], np.arange(width)[None, :]
    return Reranker(version, ((i * 7 + j * 3) % 11 - 5) / 16, np.array([0.25, 0.5]), np.array([0.5, -0.25]), np.array([[1.0, 0.25], [0.25, 0.5]]), 0.1, 0.1)


def phi_sql(version: int, source: str = "facts") -> str:
    x = "q.q || f.embedding" + ("" if version == 1 else " || list_transform(range(1, 65), lambda i: q.q[i] * f.embedding[i]) || list_transform(range(1, 65), lambda i: abs(q.q[i] - f.embedding[i]))")
    n = 128 if version == 1 else 256
    unit = [f"greatest(0, list_dot_product(x, list_transform(range({n}), lambda j: (({i * 7} + j * 3) % 11 - 5) / 16.0::DOUBLE)) + {b})" for i, b in enumerate((0.25, 0.5))]
    return f"inputs AS (SELECT f.project_id, f.ord, {x} AS x FROM {source} f, q WHERE f.embedding IS NOT NULL), phis AS (SELECT project_id, ord, {unit[0]} AS a, {unit[1]} AS b FROM inputs)"


def predict_sql(version: int) -> str:
    return FACTS_SQL + "," + phi_sql(version) + "SELECT project_id, ord, round(0.5 * a - 0.25 * b + 0.1, 6) AS mean, round(greatest(a * a + 0.5 * a * b + 0.5 * b * b + 0.1, 1e-8), 6) AS variance FROM phis"


def predicted(spark, sf_dir, model):
    q = vectors.literal(query_vector(spark, sf_dir)).cast("array<float>")
    rows = facts(spark, sf_dir, context=False).where("embedding IS NOT NULL").select("project_id", "ord", predicted_of(model, q, F.col("embedding")).alias("p"))
    return rows.select("project_id", "ord", F.round("p.mean", 6).alias("mean"), F.round("p.variance", 6).alias("variance"))


@query(predict_sql(1))
def bll_v1_predict(spark, sf_dir):
    return predicted(spark, sf_dir, weights(1))


@query(predict_sql(2))
def bll_v2_predict(spark, sf_dir):
    return predicted(spark, sf_dir, weights(2))


@query(fused_sql(LIMIT) + "," + phi_sql(2) + """, norms AS (SELECT project_id, ord, (rrf - min(rrf) OVER p) / greatest(max(rrf) OVER p - min(rrf) OVER p, 1e-8) AS norm FROM fused WINDOW p AS (PARTITION BY project_id)),
blended AS (SELECT project_id, ord, 0.7 * norm + 0.3 / (1 + exp(-(0.5 * a - 0.25 * b + 0.1))) AS score FROM norms JOIN phis USING (project_id, ord)),
final AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY round(score, 9) DESC, ord) AS rank FROM blended)
SELECT project_id, ord, round(score, 6) AS score, rank FROM final WHERE rank <= 5""")
def bll_rerank(spark, sf_dir):
    return search.hybrid(facts(spark, sf_dir), query_vector(spark, sf_dir), QUERY_TEXT, LIMIT, reranker=weights(2)).select("project_id", "ord", six("score"), "rank")


REWARDS = "r AS (SELECT phis.*, list_dot_product(f.embedding, q.q) AS reward FROM phis JOIN facts f USING (project_id, ord), q)"


def observations(spark, sf_dir):
    q = query_vector(spark, sf_dir)
    rows = facts(spark, sf_dir, context=False).where("embedding IS NOT NULL")
    return rows.select(features_of(weights(2), vectors.literal(q).cast("array<float>"), F.col("embedding")).alias("phi"), vectors.dot(F.col("embedding"), vectors.literal(q)).alias("reward"))


@query(FACTS_SQL + "," + phi_sql(2) + "," + REWARDS + "SELECT count(*) AS n, round(sum(a * a), 4) AS aa, round(sum(a * b), 4) AS ab, round(sum(b * b), 4) AS bb, round(sum(a * reward), 4) AS ar, round(sum(b * reward), 4) AS br FROM r")
def bll_sufficient_stats(spark, sf_dir):
    s = stats_of(observations(spark, sf_dir), 2)
    values = [s.n, *(float(x) for x in (s.gram[0, 0], s.gram[0, 1], s.gram[1, 1], *s.moment))]
    return spark.createDataFrame([values], "n long, aa double, ab double, bb double, ar double, br double").select("n", *(F.round(c, 4).alias(c) for c in ("aa", "ab", "bb", "ar", "br")))


#: Prior precision of `weights`: the inverse of [[1, .25], [.25, .5]]; noise .1; all in closed form for two features.
POSTERIOR_SQL = """, s AS (SELECT count(*) AS n, 8 / 7.0 + 10 * sum(a * a) AS p, -4 / 7.0 + 10 * sum(a * b) AS q, 16 / 7.0 + 10 * sum(b * b) AS t,
  (8 / 7.0 * 0.5 + 4 / 7.0 * 0.25) + 10 * sum(a * (reward - 0.1)) AS u, (-4 / 7.0 * 0.5 - 16 / 7.0 * 0.25) + 10 * sum(b * (reward - 0.1)) AS v FROM r)
SELECT n AS updates, round((t * u - q * v) / (p * t - q * q), 4) AS mu0, round((p * v - q * u) / (p * t - q * q), 4) AS mu1, round(t / (p * t - q * q), 6) AS sigma00 FROM s"""


def posterior_row(spark, after):
    return spark.createDataFrame([(after.updates, *(float(x) for x in after.mu), float(after.sigma[0, 0]))], "updates long, mu0 double, mu1 double, sigma00 double").select("updates", F.round("mu0", 4).alias("mu0"), F.round("mu1", 4).alias("mu1"), F.round("sigma00", 6).alias("sigma00"))


@query(FACTS_SQL + "," + phi_sql(2) + "," + REWARDS + POSTERIOR_SQL)
def bll_posterior(spark, sf_dir):
    return posterior_row(spark, weights(2).updated(stats_of(observations(spark, sf_dir), 2)))


@query(predict_sql(1).replace("a * a + 0.5 * a * b + 0.5 * b * b", "a * a + 0.5 * b * b"))
def bll_weights_scan(spark, sf_dir):
    """Predictions by weights that were written as a file, which has the variances only, and read again."""
    to = f"{working_dir(spark, 'weights')}/model.bin"
    model.write_weights(spark, weights(1), to)
    return predicted(spark, sf_dir, model.read_weights(spark, to))


@query(FACTS_SQL + "," + phi_sql(2) + "," + REWARDS + POSTERIOR_SQL)
def bll_state_scan(spark, sf_dir):
    """The posterior after it was stored in two versions and read again."""
    to, prior = working_dir(spark, "state"), weights(2)
    model.append_state(spark, prior, to)
    model.append_state(spark, prior.updated(stats_of(observations(spark, sf_dir), 2)), to)
    return posterior_row(spark, model.latest_state(spark, prior, to))


# Feedback


def search_log(spark, sf_dir):
    """A search in each project, which returned all of its facts."""
    q = vectors.literal(query_vector(spark, sf_dir)).cast("array<float>")
    rows = facts(spark, sf_dir, context=False)
    return rows.groupBy("project_id").agg(F.collect_list("fact_id").alias("returned_fact_ids")).select(F.concat(F.lit("s"), F.col("project_id").cast("string")).alias("search_id"), "project_id", q.alias("query_embedding"), "returned_fact_ids")


def reward_sql(other: str) -> str:
    return FACTS_SQL + f""", recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ord DESC) AS n FROM facts) WHERE n <= 50 AND embedding IS NOT NULL),
s AS (SELECT f.project_id, f.fact_id, greatest(0, coalesce(max(list_dot_product(f.embedding, r.embedding) / sqrt(list_dot_product(f.embedding, f.embedding) * list_dot_product(r.embedding, r.embedding))), 0)) AS similarity
  FROM facts f LEFT JOIN recent r ON r.project_id = f.project_id {other} WHERE f.embedding IS NOT NULL GROUP BY ALL)
SELECT 's' || project_id AS search_id, fact_id, round(similarity, 6) AS similarity, round(CASE WHEN similarity > 0.55 THEN similarity ELSE 0 END, 6) AS reward FROM s WHERE similarity > 0.55 OR similarity < 0.3"""


def rewarded(spark, sf_dir, exclude_self):
    found = feedback.rewards(search_log(spark, sf_dir), facts(spark, sf_dir, context=False), exclude_self=exclude_self)
    return found.select("search_id", "fact_id", six("similarity"), six("reward"))


@query(reward_sql(""))
def feedback_reward(spark, sf_dir):
    return rewarded(spark, sf_dir, False)


@query(reward_sql("AND r.fact_id <> f.fact_id"))
def feedback_reward_exclude_self(spark, sf_dir):
    return rewarded(spark, sf_dir, True)


# Saving


def decision_rows(spark, sf_dir):
    """A save call for each brand: part types, which repeat in differing case and space, as decisions."""
    p = table(spark, sf_dir, "part")
    odd = F.col("p_partkey") % 3
    decision = F.when(odd == 0, F.upper("p_type")).when(odd == 1, F.concat(F.lit("  "), F.col("p_type"), F.lit("\t"))).otherwise(F.col("p_type"))
    reason = F.when(F.col("p_size") % 4 == 0, " ").when(F.col("p_size") % 4 == 1, None).otherwise(F.concat(F.lit("size "), F.col("p_size").cast("string")))
    return p.select(F.col("p_brand").alias("call_id"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") == 7, "  ").otherwise(decision).alias("decision"), reason.alias("reason"))


DECISIONS_SQL = """
WITH d AS (SELECT p_brand AS call_id, p_partkey AS pos, trim(CASE WHEN p_size = 7 THEN '' WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE p_type END) AS decision, CASE WHEN p_size % 4 > 1 THEN 'size ' || p_size END AS reason FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY call_id, lower(decision) ORDER BY pos) AS n FROM d WHERE decision <> ''),
decided AS (SELECT call_id, pos, decision || coalesce(' (Reason: ' || reason || ')', '') AS content FROM k WHERE n = 1)
"""


@query(DECISIONS_SQL + "SELECT * FROM decided")
def decision_dedup_format(spark, sf_dir):
    return ingest.decisions(decision_rows(spark, sf_dir))


@query(DECISIONS_SQL + """, legs AS (SELECT call_id, 0 AS leg, pos, content, 'decision' AS category FROM decided UNION ALL SELECT p_brand, 1, p_partkey, p_name, 'general' FROM part)
SELECT call_id, row_number() OVER w - 1 AS ord, content, category, array_to_string(coalesce(list(content) OVER (PARTITION BY call_id ORDER BY leg, pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), [])
  || coalesce(list(content) OVER (PARTITION BY call_id ORDER BY leg, pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []), '|') AS context FROM legs WINDOW w AS (PARTITION BY call_id ORDER BY leg, pos)""")
def ingest_facts(spark, sf_dir):
    stated = table(spark, sf_dir, "part").select(F.col("p_brand").alias("call_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("content"))
    return ingest.facts(ingest.decisions(decision_rows(spark, sf_dir)), stated).select("call_id", "ord", "content", "category", F.array_join("context_window", "|").alias("context"))


@query("SELECT conv_id AS project_id, conv_id AS session_id, string_agg(conv_id || '-' || turn, ',' ORDER BY turn) AS fact_ids FROM conversations GROUP BY conv_id")
def session_fact_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), F.concat_ws("-", "conv_id", "turn").alias("fact_id"))
    return ingest.session_facts(rows).withColumn("fact_ids", F.array_join("fact_ids", ","))


@query("""WITH c AS (SELECT conv_id AS project_id, role = 'assistant' AS new, text AS content, row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn) - 1 AS pos FROM conversations),
n AS (SELECT project_id, count(*) AS n FROM c WHERE NOT new GROUP BY 1)
SELECT project_id, CASE WHEN new THEN pos + coalesce(n, 0) ELSE pos END AS ord, md5(content) AS content FROM c LEFT JOIN n USING (project_id)""")
def facts_append(spark, sf_dir):
    """The assistants' turns saved after all others of their conversation."""
    own = Window.partitionBy("conv_id", F.col("role") == "assistant").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("ord", (F.row_number().over(own) - 1).cast("long"))
    part = lambda some: rows.where(some).select(F.col("conv_id").alias("project_id"), "ord", F.md5("text").alias("content"))
    return ingest.appended(part("role <> 'assistant'"), part("role = 'assistant'"))


# Catalog


def project_path(key: str = "c_custkey", nation: str = "c_nationkey"):
    return F.concat(F.lit("/home/"), F.col(nation).cast("string"), F.lit("/p"), F.col(key).cast("string"))


PATH_SQL = "'/home/' || c_nationkey || '/p' || c_custkey"


def order_sessions(spark, sf_dir):
    """Orders as sessions of their customers; ord is the order's place among them."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), (F.row_number().over(own) - 1).alias("ord"), F.col("o_orderpriority").alias("summary"), (F.col("o_orderkey") % 7).cast("long").alias("facts_count"), F.col("o_orderdate").alias("created_at"))


ORDER_SESSIONS_SQL = "s AS (SELECT o_custkey AS project_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ord, o_orderpriority AS summary, o_orderkey % 7 AS facts_count, o_orderdate AS created_at FROM orders), rs AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ord DESC) AS recency FROM s)"


@query("WITH " + ORDER_SESSIONS_SQL + "SELECT project_id, recency, summary, facts_count, created_at FROM rs WHERE recency <= 5")
def recent_sessions(spark, sf_dir):
    return catalog.recent_sessions(order_sessions(spark, sf_dir)).select("project_id", "recency", "summary", "facts_count", "created_at")


@query("SELECT conv_id AS project_id, turn AS ord, role AS category, md5(text) AS content, coalesce(len(text), 0) % 2 = 0 AS even FROM conversations WHERE text IS NOT NULL")
def document_scan(spark, sf_dir):
    """Conversations written as documents, scanned and normalised again."""
    to = working_dir(spark, "documents")
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    item = F.struct("turn", F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"), F.col("role").alias("category")).alias("fact"))
    docs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    own = docs.select(F.concat(F.lit("/conv/"), F.col("conv_id").cast("string")).alias("project_path"), F.col("conv_id").cast("string").alias("project_hash"), F.transform("items", lambda x: x["fact"]).alias("facts"), F.expr("cast(array() as array<string>)").alias("sessions"))
    own.write.json(to)
    _, found, _ = documents.normalised(documents.scan(spark, [to], lines=True))
    return found.select(F.element_at(F.split("fact_id", "-"), 1).cast("long").alias("project_id"), F.element_at(F.split("fact_id", "-"), 2).cast("long").alias("ord"), "category", F.md5("content").alias("content"), (F.length("content") % 2 == 0).alias("even"))


@query("SELECT conv_id AS project_id, turn AS ord, role AS category, md5(text) AS content FROM conversations WHERE text IS NOT NULL")
def directory_scan(spark, sf_dir):
    """Conversations as documents of a storage root, beside broken ones and one without required fields, which a scan of all leaves out."""
    to = working_dir(spark, "root")
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    item = F.struct("turn", F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"), F.col("role").alias("category")).alias("fact"))
    docs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.expr("cast(array() as array<string>)")
    own = docs.select(F.concat(F.lit("/conv/"), F.col("conv_id").cast("string")).alias("project_path"), F.col("conv_id").cast("string").alias("project_hash"), F.transform("items", lambda x: x["fact"]).alias("facts"), none.alias("sessions"), F.expr("map('k', 1)").alias("metadata"))
    own.write.option("maxRecordsPerFile", 1).json(f"{to}/projects/some/thread.json")
    spark.createDataFrame([("{ not json",), ("{}",)], "value string").write.option("maxRecordsPerFile", 1).text(f"{to}/projects/bad/thread.json")
    _, found, _ = documents.normalised(documents.scan_directory(spark, to))
    return found.select(F.element_at(F.split("fact_id", "-"), 1).cast("long").alias("project_id"), F.element_at(F.split("fact_id", "-"), 2).cast("long").alias("ord"), "category", F.md5("content").alias("content"))


@query(f"SELECT c_custkey::VARCHAR AS project_id, c_name AS name, {PATH_SQL} AS last_known_path, TIMESTAMP '2024-01-01' + to_days((c_custkey % 300)::INT) AS last_seen FROM customer WHERE c_mktsegment <> 'BUILDING'")
def registry_scan(spark, sf_dir):
    """A registry document for each nation, written and scanned."""
    to = working_dir(spark, "registry")
    rows = registered(spark, sf_dir).withColumn("nation", F.element_at(F.split("last_known_path", "/"), 3))
    entry = F.struct(F.col("project_id").cast("string").alias("key"), F.struct("name", "last_known_path", F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_seen")).alias("value"))
    docs = rows.groupBy("nation").agg(F.map_from_entries(F.collect_list(entry)).alias("projects"))
    docs.select(F.lit(1).alias("version"), "projects").write.option("maxRecordsPerFile", 1).json(to)
    return documents.scan_registry(spark, to)


@query()
def english_search(spark, sf_dir):
    """Stemmed search over the documents."""
    return search.lexical(corpus(spark, sf_dir), QUERY_TEXT + " anding", 20, with_context=False, english=True).select("project_id", "ord", six("bm25"), "rank")


def item_facts(spark, sf_dir):
    """Returned line items as decisions of their supplier, the others as general facts."""
    own = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    content = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project_id"), (F.row_number().over(own) - 1).alias("ord"), content.alias("content"), F.when(F.col("l_returnflag") == "R", "decision").otherwise("general").alias("category"))


ITEMS_SQL = "f AS (SELECT l_suppkey AS project_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS ord, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS content, CASE WHEN l_returnflag = 'R' THEN 'decision' ELSE 'general' END AS category FROM lineitem), rd AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ord DESC) AS recency FROM f WHERE category = 'decision')"


@query("WITH " + ITEMS_SQL + "SELECT project_id, recency, content FROM rd WHERE recency <= 10")
def recent_decisions(spark, sf_dir):
    return catalog.recent_decisions(item_facts(spark, sf_dir)).select("project_id", "recency", "content")


@query("WITH " + ORDER_SESSIONS_SQL + "," + ITEMS_SQL + """SELECT s_suppkey AS project_id, s_name AS architecture,
  coalesce((SELECT string_agg(summary || ':' || facts_count, ',' ORDER BY recency) FROM rs WHERE rs.project_id = s_suppkey AND recency <= 5), '') AS recent_sessions,
  coalesce((SELECT string_agg(content, ',' ORDER BY recency) FROM rd WHERE rd.project_id = s_suppkey AND recency <= 10), '') AS recent_decisions,
  (SELECT count(*) FROM f WHERE f.project_id = s_suppkey) AS total_facts, (SELECT count(*) FROM s WHERE s.project_id = s_suppkey) AS total_sessions FROM supplier""")
def thread_overview(spark, sf_dir):
    projects = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("architecture"))
    out = catalog.overview(projects, item_facts(spark, sf_dir), order_sessions(spark, sf_dir))
    listed = F.array_join(F.transform("recent_sessions", lambda s: F.concat_ws(":", s["summary"], s["facts_count"])), ",")
    return out.select("project_id", "architecture", listed.alias("recent_sessions"), F.array_join("recent_decisions", ",").alias("recent_decisions"), "total_facts", "total_sessions")


def registered(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), project_path().alias("last_known_path"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(c_custkey % 300 AS int))").alias("last_seen"))


def live_paths(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(project_path().alias("path"))


def stored_threads(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("facts_count"), F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"), F.max(F.col("o_orderstatus") == "F").alias("has_architecture"))
    return per.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(project_path().alias("project_path"), "facts_count", "created_at", "updated_at", "has_architecture")


def listed(spark, sf_dir):
    return catalog.listing(registered(spark, sf_dir), live_paths(spark, sf_dir), stored_threads(spark, sf_dir), F.lit(NOW).cast("timestamp"))


LISTING_SQL = f"""
WITH t AS (SELECT {PATH_SQL} AS path, c_custkey, count(*) AS facts_count, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at, bool_or(o_orderstatus = 'F') AS has_architecture FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
r AS (SELECT c_custkey, {PATH_SQL} AS path, c_name AS name, CASE WHEN c_acctbal >= 0 THEN 'valid' ELSE 'invalid' END AS status, TIMESTAMP '2024-01-01' + to_days((c_custkey % 300)::INT) AS last_seen FROM customer WHERE c_mktsegment <> 'BUILDING'),
listed AS (
  SELECT r.path, name, status, CASE WHEN status = 'valid' THEN coalesce(facts_count, 0) ELSE 0 END AS facts_count, CASE WHEN status = 'invalid' THEN last_seen ELSE coalesce(created_at, TIMESTAMP '{NOW}') END AS created_at,
    CASE WHEN status = 'invalid' THEN last_seen ELSE coalesce(updated_at, TIMESTAMP '{NOW}') END AS updated_at, status = 'valid' AND coalesce(has_architecture, false) AS has_architecture FROM r LEFT JOIN t USING (path)
  UNION ALL SELECT path, 'p' || t.c_custkey, CASE WHEN c_acctbal >= 0 THEN 'valid' ELSE 'invalid' END, facts_count, created_at, updated_at, has_architecture FROM t JOIN customer c ON c.c_custkey = t.c_custkey WHERE c_mktsegment = 'BUILDING')
"""


@query(LISTING_SQL + "SELECT *, row_number() OVER (ORDER BY updated_at DESC, path) AS place FROM listed")
def project_listing(spark, sf_dir):
    return numbered(listed(spark, sf_dir), [F.desc("updated_at"), "path"])


@query(LISTING_SQL + "SELECT status, path FROM listed")
def valid_invalid_split(spark, sf_dir):
    return catalog.by_status(listed(spark, sf_dir))


@query(f"""
WITH r AS (SELECT c_custkey AS project_id, c_name AS name, {PATH_SQL} AS path, TIMESTAMP '2024-01-01' + to_days((c_custkey % 300)::INT) AS last_seen FROM customer WHERE c_mktsegment <> 'BUILDING'),
m AS (SELECT o_custkey AS project_id, max((o_orderdate, 'order ' || o_orderkey, '/moved/' || o_orderkey)) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(m.project_id, r.project_id) AS project_id, CASE WHEN m.x IS NULL THEN name ELSE struct_extract(x, 2) END AS name, CASE WHEN m.x IS NULL THEN path ELSE struct_extract(x, 3) END AS last_known_path, CASE WHEN m.x IS NULL THEN last_seen ELSE struct_extract(x, 1) END AS last_seen FROM r FULL JOIN m ON m.project_id = r.project_id""")
def path_fix_upsert(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("project_id"), F.concat(F.lit("order "), key).alias("name"), F.concat(F.lit("/moved/"), key).alias("last_known_path"), F.col("o_orderdate").alias("last_seen"))
    return catalog.upserted(registered(spark, sf_dir), seen)


@query("SELECT s_suppkey AS path, CASE WHEN s_acctbal >= 0 THEN 'local' ELSE 'global' END AS place, CASE WHEN s_acctbal >= 0 THEN s_acctbal ELSE -s_acctbal END AS value FROM supplier")
def local_global_fallback(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    local = s.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("path"), F.lit("local").alias("place"), F.col("s_acctbal").alias("value"))
    return catalog.preferred(local, s.select(F.col("s_suppkey").alias("path"), F.lit("global").alias("place"), (-F.col("s_acctbal")).alias("value")), "path")


@query("SELECT l_suppkey AS project_id, l_partkey AS fact_id, count(*) FILTER (WHERE l_returnflag = 'R') AS access_count, max(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS last_used_at FROM lineitem GROUP BY ALL")
def access_tracking(spark, sf_dir):
    """Parts as facts of their suppliers; a returned item is a use."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project_id"), F.col("l_partkey").alias("fact_id"), F.col("l_shipdate").alias("used_at"), "l_returnflag")
    return catalog.with_usage(items.select("project_id", "fact_id").distinct(), items.where("l_returnflag = 'R'"))


@query("""WITH c AS (SELECT md5(text) AS key, max(doc_id) AS cached FROM documents WHERE lang = 'en' AND text IS NOT NULL GROUP BY 1)
SELECT doc_id, md5(text) AS key, cached IS NOT NULL AS hit, cached FROM documents LEFT JOIN c ON key = md5(text)""")
def embedding_cache_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    written = docs.where("lang = 'en' AND text IS NOT NULL").select(text.cache_key(F.col("text")).alias("key"), F.array(F.col("doc_id").cast("double")).alias("embedding"), F.col("doc_id").alias("pos"))
    found = cache.looked_up(docs, cache.latest(written))
    return found.select("doc_id", F.lower(F.hex("key")).alias("key"), "hit", F.col("embedding")[0].cast("long").alias("cached"))


@query("""WITH c AS (SELECT DISTINCT md5(text) AS key FROM documents WHERE lang = 'en' AND text IS NOT NULL)
SELECT doc_id, key IS NOT NULL AS before, text IS NOT NULL AS after FROM documents LEFT JOIN c ON key = md5(text)""")
def embedding_cache_fill(spark, sf_dir):
    """Look up, compute what is missing, append, look up again."""
    to, docs = working_dir(spark, "cache"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    none = spark.createDataFrame([], "key binary, embedding array<float>, pos long")
    cache.append(cache.missing(docs.where("lang = 'en'"), none), to)
    stored = cache.latest(spark.read.parquet(to))
    # kept: two scans of one path in one plan would share the files listed first
    before = kept(cache.looked_up(docs, stored).select("doc_id", F.col("hit").alias("before")))
    cache.append(cache.missing(docs, stored), to)
    after = cache.looked_up(docs, cache.latest(spark.read.parquet(to))).select("doc_id", F.col("hit").alias("after"))
    return before.join(after, "doc_id")


@query("SELECT s_suppkey, (1 + s_suppkey % 5) / (2.0::DOUBLE + s_suppkey % 5 + s_nationkey % 3) AS mean, s_suppkey % 5 = 0 AND s_nationkey % 3 = 0 AS uninformed FROM supplier")
def belief_mean(spark, sf_dir):
    a, b = (1 + F.col("s_suppkey") % 5).cast("float"), (1 + F.col("s_nationkey") % 3).cast("float")
    return table(spark, sf_dir, "supplier").select("s_suppkey", belief.mean(a, b).alias("mean"), belief.uninformed(a, b).alias("uninformed"))


@query()
def thompson_blend(spark, sf_dir):
    rows = facts(spark, sf_dir, context=False).withColumn("utility", F.struct((1 + F.col("ord") % 3).cast("float").alias("alpha"), F.lit(1.0).cast("float").alias("beta"), F.lit(0.0).cast("float").alias("decay_rate")))
    return search.dense(rows, query_vector(spark, sf_dir), utility_lambda=0.2, seed=7).select("project_id", "ord", six("cosine"), "rank")


# Streams


def event_stream(spark, sf_dir):
    kind = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT user_id AS project_id, count(*) AS records, round(sum(value), 4) AS total FROM events WHERE event_type <> 'error' GROUP BY 1")
def stream_search_log_drain(spark, sf_dir):
    to = working_dir(spark, "drain")
    stream.drain(event_stream(spark, sf_dir), f"{to}/out", f"{to}/checkpoint", lambda batch: batch.where("event_type <> 'error'").select(F.col("user_id").alias("project_id"), "event_id", "value"))
    return stream.drained(spark, f"{to}/out").groupBy("project_id").agg(F.count("*").alias("records"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH r AS (SELECT 1.0::DOUBLE AS a, (event_id % 10) / 10.0::DOUBLE AS b, (user_id % 7) / 7.0::DOUBLE AS reward FROM events)" + POSTERIOR_SQL)
def stream_posterior(spark, sf_dir):
    to, prior = working_dir(spark, "posterior"), weights(2)
    stream.learn(event_stream(spark, sf_dir), f"{to}/out", f"{to}/checkpoint", 2, lambda batch: batch.select(F.array(F.lit(1.0), (F.col("event_id") % 10) / 10).alias("phi"), ((F.col("user_id") % 7) / 7).alias("reward")))
    return posterior_row(spark, stream.posterior(spark, f"{to}/out", prior))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


