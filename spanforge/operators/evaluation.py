"""Reranking passes, losses by stage, paired outcomes and predictions from label tables.

Scores are (query_id, item, score), bridges (item, article), gold (query_id, norm_id, article); ties are documented at each operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.corpus import covered_fraction
from spanforge.operators.evidence import candidate_map, candidate_pool
from spanforge.operators.fusion import first_seen
from spanforge.operators.lexical import top_k


def encoded(texts: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]], prefix: str = "", batch: int = 16) -> DataFrame:
    """(key, vector): unit vectors of ``prefix`` + text by an injected encoder, called with at most ``batch`` texts.

    Null texts are encoded as the prefix alone.  An encoder that returns another number of vectors than texts is an error.
    """
    key_type = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), batch):
                part = b.iloc[s : s + batch]
                vectors = encode([prefix + (t or "") for t in part["text"]])
                if len(vectors) != len(part):
                    raise ValueError("the encoder must return one vector for each text")
                norms = [max(sum(x * x for x in v) ** 0.5, 1e-12) for v in vectors]
                yield pd.DataFrame({"key": part["key"], "vector": [[float(x) / n for x in v] for v, n in zip(vectors, norms)]})

    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {key_type}, vector array<float>").withColumnRenamed("key", key)


def truncated_count(texts: DataFrame, text: str, tokens: Callable[[str], int], most: int) -> DataFrame:
    """One row: texts, and how many an encoder of ``most`` tokens would cut; ``tokens`` counts those of a text."""
    over = F.pandas_udf(lambda column: pd.Series([tokens(t or "") > most for t in column]), "boolean")
    return texts.agg(F.count("*").alias("texts"), F.count_if(over(F.col(text))).alias("truncated"))


def scored_pairs(pairs: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]], batch: int = 8) -> DataFrame:
    """(query_id, item, score) of (query_id, item, query_text, item_text) by an injected pair scorer; a wrong number of scores is an error."""
    query_type, item_type = (pairs.schema[c].dataType.simpleString() for c in ("query_id", "item"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), batch):
                part = b.iloc[s : s + batch]
                scores = score(list(zip(part["query_text"], part["item_text"])))
                if len(scores) != len(part):
                    raise ValueError("the scorer must return one score for each pair")
                yield pd.DataFrame({"query_id": part["query_id"], "item": part["item"], "score": [float(x) for x in scores]})

    return pairs.select("query_id", "item", "query_text", "item_text").mapInPandas(run, f"query_id {query_type}, item {item_type}, score double")


def best_of_articles(scores: DataFrame, chunk_articles: DataFrame) -> DataFrame:
    """(query_id, article, item, score): the best chunk of each article, by falling score, then item."""
    w = Window.partitionBy("query_id", "article").orderBy(F.desc("score"), "item")
    return scores.join(chunk_articles, "item").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("query_id", "article", "item", "score")


def article_evidence(scores: DataFrame, chunk_articles: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, article, item, score, rank): articles by their best chunk, ties by that chunk and only then by article; chunks may recur."""
    return top_k(best_of_articles(scores, chunk_articles), limit, F.desc("score"), "item", "article")


def best_chunks_once(scores: DataFrame, chunk_articles: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, item, rank): best chunks of articles by (-score, article, item), one that serves several articles once."""
    best = best_of_articles(scores, chunk_articles)
    return first_seen(best, F.desc("score"), "article", "item").filter(F.col("rank") <= limit).select("query_id", "item", "rank")


def best_chunks_in_order(scores: DataFrame, chunk_articles: DataFrame, articles: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, item, rank): best chunks in the given order of ``articles`` (query_id, rank, item=article), each chunk once."""
    order = articles.select("query_id", F.col("item").alias("article"), F.col("rank").alias("_at"))
    best = best_of_articles(scores, chunk_articles).join(order, ["query_id", "article"])
    return first_seen(best, "_at").filter(F.col("rank") <= limit).select("query_id", "item", "rank")


def two_pass(rankings: DataFrame, sources: list[str], chunk_articles: DataFrame, articles: DataFrame, scores: DataFrame, first: int, shortlist: int, final: int, limit: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A broad cheap pass, then more chunks for a shortlist: (shortlist, output, scored), all of (query_id, item, rank).

    The first pass scores ``first`` chunks of each article and keeps the ``shortlist`` best articles by (-score, article); the second
    takes ``final`` chunks of each and gives the best of each article once.  ``scored`` are all pairs that both passes score.
    """
    if first <= 0 or final <= 0:
        raise ValueError("chunks per article must be positive")
    if shortlist < limit:
        raise ValueError("the shortlist must hold the limit")
    pool = candidate_map(rankings, sources, chunk_articles, articles, first)
    ranked = best_of_articles(scores.join(pool.select("query_id", "item").distinct(), ["query_id", "item"]), chunk_articles.join(articles.select(F.col("item").alias("article")).distinct(), "article", "left_semi"))
    ranked = ranked.join(articles.select("query_id", F.col("item").alias("article")), ["query_id", "article"], "left_semi")
    short = top_k(ranked, shortlist, F.desc("score"), "article").select("query_id", F.col("article").alias("item"), "rank")
    wide = candidate_map(rankings, sources, chunk_articles, short, final)
    own = scores.join(wide.select("query_id", "item").distinct(), ["query_id", "item"])
    best = best_of_articles(own, chunk_articles).join(short.select("query_id", F.col("item").alias("article")), ["query_id", "article"], "left_semi")
    output = first_seen(best, F.desc("score"), "article", "item").filter(F.col("rank") <= limit).select("query_id", "item", "rank")
    union = candidate_pool(pool, articles).unionByName(candidate_pool(wide, short)).select("query_id", "item").distinct()
    return short, output, union.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("item")))


def article_chunk_fusion(rankings: DataFrame, chunk_articles: DataFrame, articles: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, article, item, score, rank): chunks of each article by the sum of 1/(k + rank) over the sources, ranks being those of
    the whole source; ties by item."""
    chosen = articles.select("query_id", F.col("item").alias("article")).distinct()
    rows = rankings.join(chunk_articles, "item").join(chosen, ["query_id", "article"])
    fused = rows.groupBy("query_id", "article", "item").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "article").orderBy(F.desc("score"), "item")))


def evidence_scores(fused: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, article, item, score, rank): a chunk's place in its article as 1/place, a thousandth of its model score beside it; ties by item.

    A chunk without a model score has 0.
    """
    rows = fused.select("query_id", "article", "item", F.col("rank").alias("_place")).join(scores, ["query_id", "item"], "left")
    rows = rows.withColumn("score", F.round(1.0 / F.col("_place") + F.coalesce("score", F.lit(0.0)) * 1e-3, 9)).drop("_place")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "article").orderBy(F.desc("score"), "item")))


def union_at_k(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """(query_id, item, rank): the first k of one ranking, then what the first k of another add."""
    rows = first.filter(F.col("rank") <= k).select("query_id", "item", F.lit(0).alias("_part"), F.col("rank").alias("_at"))
    more = second.filter(F.col("rank") <= k).select("query_id", "item", F.lit(1).alias("_part"), F.col("rank").alias("_at"))
    return first_seen(rows.unionByName(more), "_part", "_at").select("query_id", "item", "rank")


def chunks_of_articles(chunk_articles: DataFrame, articles: DataFrame) -> DataFrame:
    """(query_id, item, rank): every chunk of the articles of each query, once, in the order of their ids."""
    rows = articles.select("query_id", F.col("item").alias("article")).join(chunk_articles, "article").select("query_id", "item").distinct()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("item")))


def overlay(mapping: DataFrame, overrides: DataFrame, most: int = 10, service: tuple[str, ...] = ("other", "unclear")) -> DataFrame:
    """(label, norm_id, rank): ``mapping`` with the labels of ``overrides`` (label, norm_id, rank) replaced as a whole, each id once.

    An override of a service label is an error.
    """
    if overrides.filter(F.col("label").isin(*service)).limit(1).count():
        raise ValueError("a service label has no ids")
    once = overrides.groupBy("label", "norm_id").agg(F.min("rank").alias("_at"))
    again = once.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("_at", "norm_id"))).drop("_at")
    kept = mapping.join(overrides.select("label").distinct(), "label", "left_anti").select("label", "norm_id", "rank")
    return kept.unionByName(again).filter(F.col("rank") <= most)


def predicted(cases: DataFrame, mapping: DataFrame, k: int = 10, service: tuple[str, ...] = ("other", "unclear")) -> DataFrame:
    """(case_id, norm_id, rank): the first k ids of each case's label; null, unknown and service labels predict nothing."""
    wanted = cases.filter(~F.col("label").isin(*service)).select("case_id", "label").distinct()
    return wanted.join(mapping.filter(F.col("rank") <= k), "label").select("case_id", "norm_id", "rank")


def prediction_scores(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(case_id, exact, article): shares of each case's gold ids and articles that are predicted, in rows (case_id, norm_id, article)."""
    hit = lambda level: gold.select("case_id", level).distinct().join(predictions.select("case_id", level, F.lit(1).alias("_hit")).distinct(), ["case_id", level], "left").groupBy("case_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias(level))
    return hit("norm_id").withColumnRenamed("norm_id", "exact").join(hit("article"), "case_id")


def breakdown(scores: DataFrame, by: str, least: int = 5) -> DataFrame:
    """(by, n, exact, article, status): means by a column; fewer than ``least`` cases are marked as few."""
    out = scores.groupBy(F.coalesce(F.col(by), F.lit("")).alias(by)).agg(F.count("*").alias("n"), F.round(F.avg("exact"), 6).alias("exact"), F.round(F.avg("article"), 6).alias("article"))
    return out.withColumn("status", F.when(F.col("n") >= least, "ok").otherwise("few"))


def first_loss(gold: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(query_id, loss): the first stage, in order, whose rows (query_id, article) lack every gold article; none where all have one."""
    out = gold.select("query_id").distinct()
    for name, rows in stages:
        held = rows.select("query_id", "article").distinct().join(gold.select("query_id", "article").distinct(), ["query_id", "article"], "left_semi")
        out = out.join(held.select("query_id", F.lit(True).alias(f"_{name}")).distinct(), "query_id", "left")
    chain: Column | None = None
    for name, _ in stages:
        lacks = F.col(f"_{name}").isNull()
        chain = F.when(lacks, name) if chain is None else chain.when(lacks, name)
    return out.select("query_id", chain.otherwise("none").alias("loss"))


def oracle_breakdown(gold: DataFrame, corpus: DataFrame, articles: DataFrame, candidates: DataFrame, final: DataFrame) -> DataFrame:
    """(reason, golds): why a gold id is not in the end, by the first of hit, unavailable, article_not_selected, candidate_miss, selection_miss.

    ``corpus`` holds norm_id, ``articles`` (query_id, article), ``candidates`` and ``final`` (query_id, norm_id).
    """
    flag = lambda df, name: df.withColumn(name, F.lit(True)).distinct()
    rows = gold.select("query_id", "norm_id", "article").distinct()
    rows = rows.join(flag(final.select("query_id", "norm_id"), "_f"), ["query_id", "norm_id"], "left").join(flag(corpus.select("norm_id"), "_k"), "norm_id", "left")
    rows = rows.join(flag(articles.select("query_id", "article"), "_a"), ["query_id", "article"], "left").join(flag(candidates.select("query_id", "norm_id"), "_c"), ["query_id", "norm_id"], "left")
    reason = F.when(F.col("_f"), "hit").when(F.col("_k").isNull(), "unavailable").when(F.col("_a").isNull(), "article_not_selected").when(F.col("_c").isNull(), "candidate_miss").otherwise("selection_miss")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("golds"))


def paired_outcomes(baseline: DataFrame, candidate: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, delta, outcome, gained, lost): article recall of two rankings (query_id, rank, article) in the first k, gold articles gained and lost."""
    wanted = gold.select("query_id", "article").distinct()
    hit = lambda df, n: df.filter(F.col("rank") <= k).select("query_id", "article").distinct().withColumn(n, F.lit(1))
    rows = wanted.join(hit(baseline, "b"), ["query_id", "article"], "left").join(hit(candidate, "c"), ["query_id", "article"], "left")
    moved = lambda test: F.array_join(F.sort_array(F.collect_set(F.when(test, F.col("article")))), "|")
    out = rows.groupBy("query_id").agg(
        F.round(F.avg(F.coalesce("c", F.lit(0)) - F.coalesce("b", F.lit(0))), 6).alias("delta"), moved(F.col("c").isNotNull() & F.col("b").isNull()).alias("gained"), moved(F.col("b").isNotNull() & F.col("c").isNull()).alias("lost")
    )
    return out.withColumn("outcome", F.when(F.col("delta") > 0, "gain").when(F.col("delta") < 0, "loss").otherwise("tie"))


def wrong_routes(gold: DataFrame, retrieved: DataFrame, most: int = 20) -> DataFrame:
    """(gold_article, wrong_article, cases, rank): which first article comes in the place of which gold one, the ``most`` frequent routes; ties by both names."""
    first = retrieved.filter("rank = 1").select("query_id", F.col("article").alias("wrong_article")).distinct()
    own = gold.select("query_id", F.col("article").alias("gold_article")).distinct()
    missed = own.join(first, "query_id").join(own.select("query_id", F.col("gold_article").alias("wrong_article")), ["query_id", "wrong_article"], "left_anti")
    counted = missed.groupBy("gold_article", "wrong_article").agg(F.count("*").alias("cases"))
    ranked = counted.orderBy(F.desc("cases"), "gold_article", "wrong_article").limit(most)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cases"), "gold_article", "wrong_article")))


def outside_share(packed: DataFrame, spans: DataFrame) -> DataFrame:
    """(query_id, outside): the share of packed characters outside the selected spans, 0 for a pack without characters.

    ``packed`` is (query_id, item, law, char_start, char_end), ``spans`` (query_id, law, start, end); spans that overlap count once.
    """
    rows = packed.filter("char_end > char_start").select("query_id", "item", "law", F.col("char_start").alias("start"), F.col("char_end").alias("end")).distinct()
    pieces = rows.select("query_id", "item", "law").join(spans.select("query_id", "law", F.col("start").alias("char_start"), F.col("end").alias("char_end")), ["query_id", "law"]).select("query_id", "item", "char_start", "char_end")
    inside = covered_fraction(rows.select("query_id", "item", "start", "end"), pieces, ["query_id", "item"]).join(rows, ["query_id", "item"])
    size = F.col("end") - F.col("start")
    share = 1 - F.sum(F.col("covered") * size) / F.sum(size)
    kept = inside.groupBy("query_id").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 4).alias("outside"))
    return packed.select("query_id").distinct().join(kept, "query_id", "left").select("query_id", F.coalesce("outside", F.lit(0.0)).alias("outside"))


def score_quality(reference: DataFrame, other: DataFrame) -> DataFrame:
    """One row: pairs, mean absolute and greatest difference of two score relations (query_id, item, score), and the share of queries whose first item (ties by item) is the same."""
    both = reference.select("query_id", "item", F.col("score").alias("a")).join(other.select("query_id", "item", F.col("score").alias("b")), ["query_id", "item"])
    gap = F.abs(F.col("a") - F.col("b"))
    best = lambda c: F.min(F.struct((-F.col(c)).alias("s"), "item"))["item"]
    per = both.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(gap).alias("d"), F.max(gap).alias("m"), (best("a") == best("b")).cast("int").alias("same"))
    return per.agg(F.sum("n").alias("pairs"), F.round(F.sum("d") / F.sum("n"), 6).alias("mean_gap"), F.round(F.max("m"), 6).alias("greatest_gap"), F.round(F.avg("same"), 6).alias("first_agrees"))


#: The last keys of each chain by which a winner is chosen, after the main gain within its band, then the exact one and the share of whole hits.
WINNER_CHAINS: dict[str, tuple[str, ...]] = {
    "hybrid": ("latency", "size", "name"), "conservative": ("rounded_latency", "size", "name", "latency"), "wide": ("mean_chunks", "mean_articles", "name"),
    "chunk_budget": ("mean_cost", "max_cost", "name"), "bm25_size": ("latency", "size"), "dense_config": ("latency", "model", "size"), "method_grid": ("latency", "name"),
}


def chain_winner(rows: DataFrame, chain: str, band: float = 0.01) -> DataFrame:
    """The winner of a table of results by one of ``WINNER_CHAINS``; "evidence" and "refinement" know no band and take article, exact, all_hit and cost in turn."""
    if chain in ("evidence", "refinement"):
        return rows.orderBy(F.desc("article"), F.desc("exact"), F.desc("all_hit"), "mean_cost", "name").limit(1)
    best = F.broadcast(rows.agg(F.max("article").alias("_best")))
    near = rows.crossJoin(best).filter(F.col("_best") - F.col("article") < band).drop("_best")
    return near.orderBy(F.desc("exact"), F.desc("all_hit"), *WINNER_CHAINS[chain]).limit(1)


def fusion_grid(rankings: DataFrame, grid: DataFrame, limit: int = 10) -> DataFrame:
    """(spec, query_id, item, score, rank): weighted reciprocal ranks for every setting of a grid at once.

    ``grid`` is (spec, source, k, weight), a list of settings and so small by nature; a source without a weight does not count.
    Ties as in ``fusion.weighted_rrf``.
    """
    rows = rankings.join(F.broadcast(grid), "source")
    fused = rows.groupBy("spec", "query_id", "item").agg(F.round(F.sum(F.col("weight") / (F.col("k") + F.col("rank"))), 9).alias("score"), F.min("rank").alias("_best"))
    w = Window.partitionBy("spec", "query_id").orderBy(F.desc("score"), "_best", "item")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("_best")


def grid_recall(gold: DataFrame, results: DataFrame) -> DataFrame:
    """(spec, cases, article, all_hit): mean article recall of each setting's results (spec, query_id, item=article), and the share of cases with all."""
    wanted = results.select("spec").distinct().crossJoin(gold.select("query_id", "article").distinct())
    hits = wanted.join(results.select("spec", "query_id", F.col("item").alias("article"), F.lit(1).alias("_hit")).distinct(), ["spec", "query_id", "article"], "left")
    per = hits.groupBy("spec", "query_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("r"))
    return per.groupBy("spec").agg(F.count("*").alias("cases"), F.round(F.avg("r"), 6).alias("article"), F.round(F.avg((F.col("r") == 1).cast("int")), 6).alias("all_hit"))


def pack_flags(gold: DataFrame, packed: DataFrame) -> DataFrame:
    """(query_id, gold_in_pack, gold_article_in_pack) of packs (query_id, norm_id, article)."""
    has = lambda level, name: gold.select("query_id", level).distinct().join(packed.select("query_id", level).distinct(), ["query_id", level], "left_semi").select("query_id", F.lit(True).alias(name)).distinct()
    rows = gold.select("query_id").distinct().join(has("norm_id", "a"), "query_id", "left").join(has("article", "b"), "query_id", "left")
    return rows.select("query_id", F.col("a").isNotNull().alias("gold_in_pack"), F.col("b").isNotNull().alias("gold_article_in_pack"))
