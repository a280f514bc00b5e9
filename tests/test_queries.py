"""Every query with SQL gives DuckDB's rows on the smallest test tables."""

import math
import os

import duckdb
import pytest

from pagewright.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in NAMES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_caption_clusters_reach_as_far_as_the_lookback(spark, tmp_path):
    docs = [(n, "\n".join("x" * n)) for n in (1, 4, 12, 13, 15, 16, 40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.above, r.below) for r in QUERIES["caption_clusters"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 0), 4: (3, 0), 12: (3, 8), 13: (3, 9), 15: (3, 11), 16: (3, 11), 40: (3, 11)}


def test_the_other_queries_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, DATA).count() > 0, name


def test_parsed_plan_reads_only_its_columns(spark):
    plan = QUERIES["page_routes"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "BatchEvalPython" not in plan
