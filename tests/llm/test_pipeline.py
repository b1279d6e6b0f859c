"""The pipeline's stages against what each should leave, and the queries' registration."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from factloom.llm import simhash

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent / "factloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "factloom.llm" in p.read_text()]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("kept"))
    first = corpus_pipeline.language(spark, docs, SF)
    assert first.columns == docs.columns and first.count() >= 0.95 * docs.count()
    second = corpus_pipeline.deduplicate(spark, first, SF)
    groups = simhash.near_duplicates(first)
    assert sorted(r[0] for r in second.select("doc_id").collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    third = corpus_pipeline.private(spark, second, SF)
    assert third.columns == docs.columns and third.count() == second.count() and third.where("n_chars <> length(text)").count() == 0
    assert not [r for r in third.collect() if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)]
    packed = corpus_pipeline.pack(spark, third, SF)
    assert packed.select("doc_id").distinct().count() == third.count()
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_on_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_pipeline_on_difficult_rows(spark):
    """Nulls in any column, repeated rows, a very long text, and columns whose names clash or hold dots, through all stages."""
    long = "one long text that goes on and on with a.b@c.de and 1.2.3.4 in it " * 8000
    rows = [(1, "the same words in a text of some length", "en", "s", 1), (1, "the same words in a text of some length", "en", "s", 1), (2, "the same words in a text of some length", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, "a text without a number that is kept", "en", "s", 3), (5, long, "en", "s", 9), (6, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for name in ("a.b", "_row", "_id", "doc", "label", "w0", "_gone", "component_id", "fp", "_key", "spans", "score", "lang_pred", "length"):
        docs = docs.withColumn(name, F.lit("x"))
    first = corpus_pipeline.language(spark, docs, SF)
    assert first.schema == docs.schema and sorted(r.doc_id or 0 for r in first.select("doc_id").collect()) == [0, 1, 1, 2, 5]
    second = corpus_pipeline.deduplicate(spark, first, SF)
    assert second.columns == docs.columns and sorted(r.doc_id or 0 for r in second.select("doc_id").collect()) == [0, 1, 5]
    third = corpus_pipeline.private(spark, second, SF)
    assert third.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in third.collect()}[5] == ((masked := long.replace("a.b@c.de", "<EMAIL>").replace("1.2.3.4", "<IP>")), len(masked))
    last = corpus_pipeline.pack(spark, third, SF)
    assert {r.doc_id for r in last.collect()} == {None, 1, 5}
