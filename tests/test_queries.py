"""Every query of the reference's operators against its SQL twin, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

CORE = [n for n in entry.queries() if n != "pipeline" and not n.startswith("op")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(SMALL + "/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows_of(frame):
    names = sorted(frame.columns)
    rows = frame[names].astype(object).where(frame[names].notna(), None).values.tolist()
    plain = lambda x: str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return names, sorted([plain(x) for x in r] for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, SMALL).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert rows_of(found) == rows_of(duck.sql(sql).fetchdf())
    else:
        assert len(found.columns)


def test_some_dense_search_is_over_all_rows(spark):
    rows = spark.read.parquet(SMALL + "/embeddings.parquet").where("embedding is not null")
    found = entry.queries()["dense_topk"](spark, SMALL).toPandas()
    asked = {r.vec_id for r in rows.where("vec_id % 100 = 0").select("vec_id").collect()}
    assert set(found.qid) == asked and (found.groupby("qid").size() == min(10, rows.count())).all()
    assert asked <= set(found.doc[found.doc == found.qid])  # a query finds itself, which is divisible by 25


def test_entry(spark):
    assert entry.entry(spark).count() == 7  # one row for each run of the workflow


def test_core_does_not_need_the_subpackage():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder in ("operators", "functions", "plans", "sources", "streaming"):
        for f in glob.glob(f"{top}/citeweave/{folder}/*.py"):
            assert "citeweave.llm" not in open(f).read()
