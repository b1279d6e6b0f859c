"""The memory store's tables as views over the test data.

A conversation is a project with one session, a turn a fact, its role the category.  The facts of all roles but `system` are numbered,
the vectors too, and fact i has vector i modulo their number: where there are as many facts as vectors, every vector takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.windows import numbered, with_context

QUERY_TEXT = "the that of and heed tion"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the smallest id."""
    return table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").agg(F.min_by("embedding", "vec_id")).first()[0]


def facts(spark: SparkSession, sf_dir: str, context: bool = True) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("ord"), F.col("conv_id").alias("session_id"), F.concat_ws("-", "conv_id", "turn").alias("fact_id"), F.col("text").alias("content"), F.col("role").alias("category"))
    vectors = numbered(table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding"), ["vec_id"], "slot").drop("vec_id")
    rows = numbered(turns, [F.col("category") == "system", "project_id", "ord", "category", "content"], "slot")
    many = vectors.count()
    slot = F.when(F.col("category") != "system", (F.col("slot") - 1) % many + 1) if many else F.lit(None).cast("long")
    rows = rows.withColumn("slot", slot).join(vectors, "slot", "left").drop("slot")
    return with_context(rows) if context else rows


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each conversation that has a turn of the system; its summary tells how many turns it has."""
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.col("role") == "system").alias("briefed"))
    return own.where("briefed").select(F.col("conv_id").alias("project_id"), F.col("conv_id").alias("session_id"), F.concat(F.lit("turns: "), F.col("n").cast("string")).alias("summary"))


#: The same views in DuckDB.
FACTS_SQL = """
WITH q AS (SELECT arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings WHERE embedding IS NOT NULL),
slots AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, embedding::DOUBLE[] AS embedding FROM embeddings WHERE embedding IS NOT NULL),
turns AS (SELECT *, CASE WHEN role <> 'system' THEN (row_number() OVER (ORDER BY role = 'system' NULLS FIRST, conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1) % (SELECT count(*) FROM slots) END AS slot FROM conversations),
facts AS (
  SELECT c.conv_id AS project_id, c.turn AS ord, c.conv_id AS session_id, c.conv_id || '-' || c.turn AS fact_id, c.text AS content, c.role AS category, s.embedding,
    coalesce(list(c.text) OVER (PARTITION BY c.conv_id ORDER BY c.turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), [])
      || coalesce(list(c.text) OVER (PARTITION BY c.conv_id ORDER BY c.turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS context_window
  FROM turns c LEFT JOIN slots s ON s.slot = c.slot),
cosines AS (SELECT f.*, list_dot_product(f.embedding, q.q) / (sqrt(list_dot_product(f.embedding, f.embedding)) * sqrt(list_dot_product(q.q, q.q))) AS cosine FROM facts f, q WHERE f.embedding IS NOT NULL),
dense AS (SELECT project_id, ord, cosine, row_number() OVER (PARTITION BY project_id ORDER BY round(cosine, 9) DESC, ord) AS rank FROM cosines WHERE cosine >= 0.15)
"""


def lexical_sql(source: str, terms: list[str], name: str = "lexical", limit: int | None = None) -> str:
    """CTEs for BM25 over `source` (project_id, ord, body)."""
    words = ", ".join(f"('{t}')" for t in terms)
    cut = f" WHERE rank <= {limit}" if limit else ""
    return f"""
bodies AS ({source}),
split AS (SELECT project_id, ord, list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM bodies),
sizes AS (SELECT project_id, count(*) AS n, avg(len(words)) AS avgdl FROM split GROUP BY 1),
terms(term) AS (VALUES {words}),
tfs AS (SELECT project_id, ord, len(words) AS dl, term, len(list_filter(words, lambda x: x = term)) AS tf FROM split, terms),
dfs AS (SELECT project_id, term, count(*) AS df FROM tfs WHERE tf > 0 GROUP BY ALL),
scores AS (SELECT t.project_id, t.ord, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM tfs t JOIN dfs USING (project_id, term) JOIN sizes USING (project_id) WHERE tf > 0 GROUP BY ALL),
ranked_bm25 AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY round(bm25, 9) DESC, ord) AS rank FROM scores),
{name} AS (SELECT * FROM ranked_bm25{cut})
"""


#: Summaries of the sessions, by project.
SESSIONS_SQL = "s AS (SELECT conv_id AS project_id, 'turns: ' || count(*) AS summary FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system'))"
