"""A training-data pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of
documents.  No stage keeps a limit or a sample of its input; only the language network is trained on a bounded, labelled sample.

Edge cases: those of the operators (see their modules); null texts have no language and go in the first stage; an empty table gives an empty
result; extra columns of documents, whatever their names, are carried to the last stage; n_chars is the length of the masked text, where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import langid, pii, simhash
from factloom.llm.common import table
from factloom.llm.queries import packed
from factloom.session import importable
from factloom.sources.shared import working_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: texts without a recognisable language go."""
    importable(spark)
    return langid.keep_known(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each near-duplicate group stays."""
    importable(spark)
    return simhash.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data is masked; n_chars follows the text."""
    masked = pii.mask(docs)
    return masked.select(*(F.length("text").cast(masked.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in masked.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the texts as pieces of 2048-token sequences."""
    importable(spark)
    return packed(docs)


STAGES = [("language", language), ("deduplicate", deduplicate), ("private", private), ("pack", pack)]

#: Network training and tokenisation can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs, at = table(spark, sf_dir, "documents"), working_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{i}-{name}")
        docs = spark.read.parquet(f"{at}/{i}-{name}")
    return docs
