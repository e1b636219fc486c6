"""The registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from spanforge.functions.ids import article_key, prefixes, unit_key
from spanforge.plans import grounded, records, retrieval

QUICK = ("bm25_topk", "dense_topk", "weighted_article_rrf", "recall_by_topic", "label_mapping", "leave_group_out", "split_policy", "chunk_units", "chunk_coverage", "case_rule_report", "edition_at_notice", "manifest")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (str, bool, int)) else round(float(v), 6)


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, data, sql, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    want = sql.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_names():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    assert set(retrieval.QUERIES) | set(records.QUERIES) | set(grounded.QUERIES) <= set(known)


def test_grounded_pipeline(spark, data):
    rows = grounded.grounded_pipeline(spark, data).collect()
    assert rows and all((r["status"] == "remark") == (r["reason"] is None) for r in rows)

    def silent(batch):
        return batch.assign(decision="abstain", doc_quote=None, chunk_id=None, norm_id=None, norm_quote=None)[["decision", "doc_quote", "chunk_id", "norm_id", "norm_quote"]].reset_index(drop=True)

    assert {r["reason"] for r in grounded.grounded_pipeline(spark, data, silent).collect()} == {"model_abstained"}


def test_ids(spark):
    df = spark.createDataFrame([("L:2020-01-01:art.24.1:ch.2:p.3",)], "n string")
    r = df.select(article_key(df["n"]).alias("a"), unit_key(df["n"]).alias("u"), prefixes(df["n"]).alias("p")).first()
    assert r["a"] == "L:art.24.1" and r["u"] == "L:art.24.1:ch.2:p.3" and r["p"][:2] == ["L:2020-01-01:art.24.1:ch.2:p.3", "L:2020-01-01:art.24.1:ch.2"]
    with pytest.raises(Exception, match="no article"):
        spark.createDataFrame([("L:x",)], "n string").select(article_key(df["n"])).collect()
