"""Every registered query against its oracle on the smallest tables."""

import collections
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from factloom.functions import english
from factloom.plans import registry
from factloom.plans.tables import QUERY_TEXT

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def text(v):
        if pd.isna(v):
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return [tuple(columns), *sorted(tuple(map(text, r)) for r in frame[columns].astype(object).values.tolist())]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        assert plain(found) == plain(duck.sql(registry.oracle_sql()[name]).df())
    assert len(found)


def test_thompson_draws_repeat(spark):
    if not Path(SF).exists():
        pytest.skip("no test data")
    run = registry.queries()["thompson_blend"]
    assert plain(run(spark, SF).toPandas()) == plain(run(spark, SF).toPandas())


def test_english_search_by_brute_force(spark):
    if not Path(SF).exists():
        pytest.skip("no test data")
    asked = list(dict.fromkeys(english.terms(QUERY_TEXT + " anding")))
    by = collections.defaultdict(dict)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        by[r.source][r.doc_id] = english.terms(r.text or "")
    expected = set()
    for source, docs in by.items():
        mean, score = sum(map(len, docs.values())) / len(docs), collections.Counter()
        for term in asked:
            df = sum(term in words for words in docs.values())
            for i, words in docs.items():
                if tf := words.count(term):
                    score[i] += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:20]
        expected |= {(source, i, f"{score[i]:.6f}", n) for n, i in enumerate(best, 1)}
    found = registry.queries()["english_search"](spark, SF).collect()
    assert {(r.project_id, r.ord, f"{r.bm25:.6f}", r.rank) for r in found} == expected and expected
