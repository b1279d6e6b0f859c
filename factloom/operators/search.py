"""Hybrid retrieval: dense and lexical legs, reciprocal rank fusion, optional reranking.

All of it is partitioned by project, so that one plan serves a single project and all of them: statistics, ranks and
normalisation are each project's own.  Facts are rows (project_id, ord, content, embedding, context_window, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import belief, text, vectors
from factloom.functions import english as analysis
from factloom.operators.rerank import Reranker, reranked
from factloom.operators.windows import top
from factloom.sources.shared import kept

RRF_K = 60
LEXICAL_FACTOR = 3
K1, B = 1.2, 0.75
KEY = ["project_id", "ord"]


def dense(facts: DataFrame, query: list[float], threshold: float = 0.15, utility_lambda: float = 0.0, seed: int = 0) -> DataFrame:
    """(project_id, ord, cosine, rank): facts whose raw cosine reaches the threshold, ranked without a limit.

    With a positive lambda, informed beliefs (column `utility`) blend a sampled utility into the order, and into nothing else.
    """
    near = vectors.cosine(F.col("embedding"), vectors.literal(query))
    blend = utility_lambda > 0
    rows = facts.where("embedding IS NOT NULL").select(*KEY, *(["utility"] if blend else []), vectors.kept(near, lambda x: x >= threshold).alias("cosine"))
    order = F.col("cosine")
    if blend:
        a, b = F.col("utility.alpha"), F.col("utility.beta")
        drawn = belief.sample(a, b, F.struct(*KEY), seed)
        rows = rows.withColumn("_drawn", F.when(belief.uninformed(a, b), F.col("cosine")).otherwise((1 - utility_lambda) * F.col("cosine") + utility_lambda * drawn))
        order = F.col("_drawn")
    return top(rows.withColumn("_order", order), ["project_id"], "_order", ["ord"]).select(*KEY, "cosine", "rank")


def terms_of(query: str) -> list[str]:
    """Search terms of a query, each once."""
    return list(dict.fromkeys("".join(c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in query.lower()).split()))


def lexical(facts: DataFrame, query: str, limit: int | None = None, with_context: bool = True, english: bool = False) -> DataFrame:
    """(project_id, ord, bm25, rank): Okapi BM25 within each project, facts with a matching term only.

    Texts are read once: of each fact its length and its counts of the query's terms are kept, which statistics (one partial row a
    project) and scores are then made of.  With `english`, stop words go and stems are compared.
    """
    body = text.searchable(F.col("content"), F.col("context_window")) if with_context else F.col("content")
    low = F.lower(F.coalesce(body, F.lit("")))
    if english:
        terms = list(dict.fromkeys(analysis.terms(query)))
        # words that can have a stem of the query are few: only they are stemmed
        words = facts.select(*KEY, analysis.content_words(low).alias("_words"))
        found = words.select(*KEY, F.size("_words").alias("_dl"), F.filter("_words", analysis.candidate(terms)).alias("_near"))
        found = found.select(*KEY, "_dl", F.when(F.size("_near") > 0, analysis.stems(F.col("_near"))).otherwise(F.col("_near")).alias("_hits"))
    else:
        terms = terms_of(query)
        words = facts.select(*KEY, F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)).alias("_words"))
        found = words.select(*KEY, F.size("_words").alias("_dl"), F.filter("_words", lambda x: x.isin(terms)).alias("_hits"))
    counted = kept(found.select(*KEY, "_dl", *(F.size(F.filter("_hits", _is(t))).alias(f"_tf{i}") for i, t in enumerate(terms))))
    stats = counted.groupBy("project_id").agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avgdl"), *(F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avgdl")))).otherwise(0.0)
    matching = F.lit(False)
    for i in range(len(terms)):
        matching = matching | (F.col(f"_tf{i}") > 0)
    hits = counted.where(matching).join(stats, "project_id").select(*KEY, score.alias("bm25"))
    return top(hits, ["project_id"], "bm25", ["ord"], limit)


def _is(term: str):
    return lambda x: x == term


def corpus_stats(facts: DataFrame, body: Column | None = None) -> DataFrame:
    """(project_id, term, df, n, avgdl) of every term: the persistent form of the lexical statistics."""
    rows = facts.select("project_id", F.coalesce(text.words(F.col("content") if body is None else body), F.expr("cast(array() as array<string>)")).alias("_words"))
    per = rows.groupBy("project_id").agg(F.count("*").alias("n"), F.avg(F.size("_words")).alias("avgdl"))
    df = rows.select("project_id", F.explode(F.array_distinct("_words")).alias("term")).groupBy("project_id", "term").agg(F.count("*").alias("df"))
    return df.join(per, "project_id").select("project_id", "term", "df", "n", "avgdl")


def fused(*legs: DataFrame) -> DataFrame:
    """(project_id, ord, rrf): sum of 1 / (60 + rank) over the legs; a union and one aggregate, no join."""
    every = None
    for leg in legs:
        own = leg.select(*KEY, (1 / (RRF_K + F.col("rank"))).alias("_part"))
        every = own if every is None else every.union(own)
    return every.groupBy(*KEY).agg(F.sum("_part").alias("rrf"))


def normalised(rows: DataFrame, score: str = "rrf", by: str = "project_id") -> DataFrame:
    """Adds `norm`: the score between its project's least (0) and greatest (1)."""
    own = Window.partitionBy(by)
    low, high = F.min(score).over(own), F.max(score).over(own)
    return rows.withColumn("norm", (F.col(score) - low) / F.greatest(high - low, F.lit(vectors.SMALL)))


def hybrid(facts: DataFrame, query: list[float], query_text: str, limit: int, threshold: float = 0.15, reranker: Reranker | None = None, utility_lambda: float = 0.0, seed: int = 0, english: bool = False) -> DataFrame:
    """(project_id, ord, score, rank): each project's `limit` best facts."""
    legs = [dense(facts, query, threshold, utility_lambda, seed)]
    if query_text and (analysis.terms(query_text) if english else terms_of(query_text)):
        legs.append(lexical(facts, query_text, limit * LEXICAL_FACTOR, english=english))
    hits = fused(*legs).withColumnRenamed("rrf", "score")
    if reranker is not None:
        hits = normalised(hits, "score")
        hits = reranked(hits.join(facts.select(*KEY, "embedding"), KEY), query, reranker)
    return top(hits, ["project_id"], "score", ["ord"], limit).select(*KEY, "score", "rank")


def across(hits: DataFrame, limit: int) -> DataFrame:
    """The best of all projects' results: a top-k over at most `limit` rows a project."""
    return hits.orderBy(F.desc(F.round("score", 9)), "project_id", "ord").limit(limit)


def results(hits: DataFrame, facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """The single-project result: facts with their session's summary; counts are those before the search."""
    rows = hits.join(facts, KEY).join(sessions.select("project_id", "session_id", F.col("summary").alias("session_summary")), ["project_id", "session_id"], "left")
    return rows.select("project_id", "rank", "fact_id", "content", "category", "score", F.col("context_window").alias("context"), "session_summary", belief.mean(F.col("utility.alpha"), F.col("utility.beta")).alias("utility_mean"), "access_count", "created_at")


def results_across(hits: DataFrame, facts: DataFrame, sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """The cross-project result: with the project's path, without ids and usage."""
    rows = hits.join(facts, KEY).join(sessions.select("project_id", "session_id", F.col("summary").alias("session_summary")), ["project_id", "session_id"], "left").join(projects.select("project_id", "project_path"), "project_id", "left")
    return rows.select("content", "category", "score", F.col("context_window").alias("context"), "session_summary", "project_path", "created_at")
