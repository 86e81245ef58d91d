"""Registered queries against their SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from evidara.plans import registry

SF = "/root/testdata/sf0.001"


def _rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v for v in r))
    return list(frame.columns), sorted(out, key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", ["bm25_topk", "pooled_robust_mean", "retrieval_metrics", "vector_topk", "sentence_spans", "span_coverage", "class_metrics", "upsert_merge", "budgeted_admission", "stratified_audit"])
def test_query_equals_sql(spark, duck, name):
    got = _rows(registry.queries()[name](spark, SF).toPandas())
    assert got == _rows(duck.execute(registry.oracle_sql()[name]).df())
