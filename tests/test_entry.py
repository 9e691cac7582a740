"""Registered queries against their SQL on the smallest tables, where these are at hand."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from normweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4) + 0.0
    return x


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, views, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(value(r[c]) for c in columns) for r in df.collect()], key=repr)
    told = views.sql(registry.oracle_sql()[name])
    assert sorted(told.columns) == columns
    places = [told.columns.index(c) for c in columns]
    assert got == sorted([tuple(value(r[i]) for i in places) for r in told.fetchall()], key=repr)
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_repealed_parts_are_found_in_whole_texts(spark, tmp_path):
    rows = [(1, "가" * 5000 + "\n② 삭제 <2019. 1. 2.>", "ko", "s", 1), (2, "short", "ko", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.clause_date for r in entry.queries()["l8_repealed_parts"](spark, str(tmp_path)).collect()}
    assert got == {1: "2019-01-02", 2: "2020-06-03"}
