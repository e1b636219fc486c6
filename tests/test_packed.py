"""The packed lexical search and the queries that read it."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import lexical
from spanforge.plans import evaluation, retrieval, retrieval_sql


def _rows(spark, n, words, seed):
    r = random.Random(seed)
    texts = [" ".join(r.choices(["и", *(f"w{i}" for i in range(words))], [words, *range(words, 0, -1)], k=r.randint(0, 12))) for _ in range(n)]
    return spark.createDataFrame([(f"k{i:03d}", t) for i, t in enumerate(texts)], "item string, text string")


def _found(df):
    return {(r["query_id"], r["rank"]): (r["item"], round(r["score"], 8)) for r in df.collect()}


def test_packed_search_equals_the_joins_and_shuffles_no_pair(spark, monkeypatch):
    """On blocks of few texts, groups of few queries and several passes; ties by key, texts without a shared word, empty texts and lists over the end of the corpus."""
    corpus, queries = _rows(spark, 150, 30, 1).repartition(3), _rows(spark, 20, 40, 2).select(F.col("item").alias("id"), "text")
    posted = lexical.postings(corpus, "item", "text").cache()
    for block, pass_bytes in ((8192, 1 << 28), (7, 1000)):
        monkeypatch.setattr(lexical, "BLOCK", block)
        monkeypatch.setattr(lexical, "PASS_BYTES", pass_bytes)
        blocks = lexical.packed(corpus, "item", "text").cache()
        index = lexical.sent_index(blocks, lexical.packed_weights(blocks))
        assert (len(index[0]) > 1) == (pass_bytes == 1000)
        for k in (5, 200):
            got = lexical.packed_search(index, "item", queries, "id", "text", {"bm25": k, "cosine": k}).cache()
            assert _found(got.filter("source = 'bm25'")) == _found(lexical.bm25_search(posted, "item", queries, "id", "text", k))
            assert _found(got.filter("source = 'cosine'")) == _found(lexical.set_cosine_search(posted, "item", queries, "id", "text", k))
    assert lexical.packed_search(index, "item", queries, "id", "text", {"bm25": 0}).count() == 0
    weights = lexical.term_weights(posted, "item").orderBy("term").collect()
    assert [(r["term"], r["df"], r["n"], round(r["idf"], 9)) for r in lexical.packed_weights(blocks).orderBy("term").collect()] == [(r["term"], r["df"], r["n"], round(r["idf"], 9)) for r in weights]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_protected_shortlist_joins_no_pairs_of_query_and_chunk(spark, data):
    b = retrieval.base(spark, data)
    assert "Join" not in _plan(b.bm25()) and "Join" not in _plan(b.cosine())
    assert "Generate" not in _plan(retrieval.protected_shortlist(spark, data))


def test_select_evidence_serves_every_case(spark, data):
    cases = retrieval.base(spark, data).cases.filter("complaint_argument_blind is not null")
    got = {r["query_id"] for r in retrieval.select_evidence(spark, data).select("query_id").distinct().collect()}
    assert got == {r["case_id"] for r in cases.collect()}
    assert "% 50" not in retrieval_sql.SQL["select_evidence"] and "% 50" in retrieval_sql.SQL["source_quota"]


@pytest.mark.parametrize("name", ("source_quota", "oracle_breakdown", "winner_tie_band", "chunks_of_articles",))
def test_no_query_joins_pairs(spark, data, monkeypatch, name):
    """The searches by join, which shuffle every pair of query and chunk, are not called."""
    monkeypatch.delattr(lexical, "bm25_search")
    monkeypatch.delattr(lexical, "set_cosine_search")
    monkeypatch.setattr(retrieval, "_kept_bases", {})
    assert (retrieval.QUERIES | evaluation.QUERIES)[name](spark, data).count()
