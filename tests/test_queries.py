"""Every registered query of the library against its SQL in an independent engine."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from docloom.plans import ORACLE_SQL, QUERIES
from tests.test_engine import plain_windows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == sorted([plain(r[k]) for k in at] for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows_or_a_schema(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns


def test_windows_query_equals_the_rule(spark, sf_dir):
    plain = {r.doc_id: plain_windows(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {}
    for r in QUERIES["windows"](spark, sf_dir).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append(r.window)
    assert got == plain


def test_entry_is_the_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score"]
    assert df.count() == 50


def test_nothing_else_imports_the_removable_subpackage():
    root = Path(__spark_entry__.__file__).parent
    for f in (root / "docloom").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "docloom.llm" not in f.read_text(), f


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["filter_source_date"](spark, sf_dir))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1]


def test_top_k_keeps_k_rows_a_task(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["bm25_topk"](spark, sf_dir))
    assert "WindowGroupLimit" in plan_of(QUERIES["knn_batch"](spark, sf_dir))
