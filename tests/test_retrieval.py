import math

import pytest
from pyspark.sql import functions as F

from spanforge.operators import dense, evidence, fusion, lexical, metrics


def ranking(spark, lists, query="q"):
    rows = [(query, source, rank, item) for source, items in lists.items() for rank, item in enumerate(items, 1)]
    return spark.createDataFrame(rows, "query_id string, source string, rank int, item string")


def items(df):
    return [r["item"] for r in df.orderBy("query_id", "rank").collect()]


def test_bm25_against_brute_force(spark):
    texts = {"c1": "закупка товара ёлка", "c2": "закупка услуг закупка", "c3": "", "c4": None, "c5": "работа"}
    corpus = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "item string, text string, score int")
    queries = spark.createDataFrame([("q1", "Закупка ЁЛКА елка"), ("q2", None), ("q3", "нигде")], "id string, text string")
    got = lexical.bm25_search(lexical.postings(corpus, "item", "text"), "item", queries, "id", "text", 4)
    own = {k: (v or "").replace("ё", "е").split() or ["_empty"] for k, v in texts.items()}
    avg = sum(map(len, own.values())) / 5
    df = {t: sum(t in w for w in own.values()) for w in own.values() for t in w}
    idf = {t: math.log(5 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    score = lambda w: sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in ("закупка", "елка", "елка") if t in w)
    want = sorted(((k, score(w)) for k, w in own.items()), key=lambda x: (-round(x[1], 9), x[0]))[:4]
    rows = got.filter("query_id = 'q1'").orderBy("rank").collect()
    assert [(r["item"], round(r["score"], 6)) for r in rows] == [(k, round(s, 6)) for k, s in want]
    assert items(got.filter("query_id = 'q3'")) == ["c1", "c2", "c3", "c4"]
    assert lexical.bm25_search(lexical.postings(corpus, "item", "text"), "item", queries, "id", "text", 0).count() == 0


def test_dense_ties_nulls_and_blocks(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "id long, v array<float>")
    one = dense.dense_search(rows, "id", "v", rows.filter("id in (1, 3)"), "id", "v", 3)
    assert [(r["query_id"], r["id"]) for r in one.orderBy("query_id", "rank").collect()] == [(1, 1), (1, 2), (1, 3), (3, 3), (3, 1), (3, 2)]
    many = dense.dense_search(rows, "id", "v", rows.filter("id in (1, 3)"), "id", "v", 3, block=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert dense.dense_search(rows.limit(0), "id", "v", rows, "id", "v", 3).count() == 0


def test_fusion(spark):
    r = ranking(spark, {"a": ["s", "x"], "b": ["s", "b"]})
    assert items(fusion.rrf(r)) == ["s", "b", "x"]
    assert items(fusion.weighted_rrf(r, {"a": 2.0, "b": 1.0})) == ["s", "x", "b"]
    assert items(fusion.interleave(r, ["a", "b"])) == ["s", "x", "b"]
    assert items(fusion.source_quota(r, {"b": 2, "a": 1})) == ["s", "b"]


def test_protected_prefixes_that_fill_the_list_let_the_fallback_run_on(spark):
    r = ranking(spark, {"a": ["1", "2"], "b": ["3", "1"], "f": ["9", "1", "8"]})
    part = lambda s: r.filter(F.col("source") == s)
    ok = r.select("query_id", "item")
    assert items(fusion.protected_shortlist(part("a"), part("b"), part("f"), ok, 1, 1, 2)) == ["1", "3", "9", "8"]
    assert items(fusion.protected_shortlist(part("a"), part("b"), part("f"), ok, 1, 1, 3)) == ["1", "3", "9"]
    with pytest.raises(ValueError):
        fusion.protected_shortlist(part("a"), part("b"), part("f"), ok, 2, 2, 3)


def test_articles(spark):
    r = ranking(spark, {"a": ["c1", "c2", "c3", "c4"]})
    bridge = spark.createDataFrame([("c1", "x"), ("c2", "x"), ("c2", "y"), ("c3", "y"), ("c3", "z"), ("c4", "z")], "item string, article string")
    assert items(fusion.project_articles(r, bridge)) == ["x", "y", "z"]
    assert items(fusion.article_diversify(r, bridge)) == ["c1", "c3"]
    assert items(fusion.article_then_points(r, bridge, 50, 1)) == ["c1", "c2"]


def candidates(spark, rows):
    return spark.createDataFrame([("q", *r) for r in rows], "query_id string, article string, article_rank int, within int, item string, score double, tokens int, paths array<string>")


def test_packs(spark):
    c = candidates(spark, [("a", 1, 1, "a1", 1.0, 10, ["a1"]), ("a", 1, 2, "a2", 0.55, 10, ["a2"]), ("a", 1, 3, "a3", 0.6, 10, ["a1"]), ("b", 2, 1, "b1", 0.8, 10, ["b1"])])
    assert items(evidence.adaptive_pack(c, 20, 30, 2, 0.5, 0.1)) == ["a1", "b1", "a2"]
    assert items(evidence.evidence_pack(c.select("query_id", "article", "article_rank", "within", "item", "score"), 3, 2, 2)) == ["a1", "b1", "a3"]
    assert evidence.adaptive_pack(c.limit(0), 20, 30).count() == 0


def test_diverse_selection(spark):
    rows = [("q", "a", 1.0, ["x"], ["n1"]), ("q", "b", 1.0, ["x"], ["n1"]), ("q", "c", 1.0, ["y"], ["n2"])]
    pool = spark.createDataFrame(rows, "query_id string, item string, score double, words array<string>, norm_ids array<string>")
    assert items(evidence.diverse_selection(pool, 2, 0.5)) == ["a", "c"]


def test_metrics(spark):
    gold = spark.createDataFrame([("q", "n1", "a1"), ("q", "n2", "a2"), ("p", "n1", "a1")], "query_id string, norm_id string, article string")
    got = spark.createDataFrame([("q", 1, "i", "n1", "a1"), ("q", 12, "j", "n9", "a2")], "query_id string, rank int, item string, norm_id string, article string")
    rows = {r["query_id"]: (r["exact"], r["article"], r["article_all"]) for r in metrics.score_cases(gold, got, 20).collect()}
    assert rows == {"q": (0.5, 1.0, True), "p": (0.0, 0.0, False)}
    assert {r["query_id"]: r["bucket"] for r in metrics.best_rank(gold, got, "article").collect()} == {"q": "<=10", "p": ">100"}
    assert {r["query_id"]: r["label"] for r in metrics.complementarity(gold, got, got.limit(0)).collect()} == {"q": "only_left", "p": "neither"}


def test_bootstrap_is_seeded(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 1.0), ("b", 0.0, 0.0)], "g string, x double, y double")
    one, two = (metrics.group_bootstrap(rows, "g", "x", "y", 200, 7) for _ in range(2))
    assert one == two and abs(one[0] - 1 / 3) < 1e-9


def test_rank_bucket(spark):
    df = spark.createDataFrame([(x,) for x in (1, 10, 11, 20, 21, 50, 51, 100, 101, None)], "r int").select(metrics.rank_bucket(F.col("r")).alias("b"))
    assert [r["b"] for r in df.collect()] == ["<=10"] * 2 + ["11-20"] * 2 + ["21-50"] * 2 + ["51-100"] * 2 + [">100"] * 2
