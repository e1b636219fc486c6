"""Fusion and set operations over rankings.

A ranking is a relation (query_id, source, rank, item) with ranks from 1 in each query and source; ``item`` is a chunk
or an article.  Every operator ends in a rank by a documented chain of keys, sums of scores being rounded to nine
places before they are compared.  Limits of 0 give no rows, queries without rows give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.lexical import top_k


def _weight(weights: dict[str, float]) -> Column:
    return reduce(lambda c, kv: c.when(F.col("source") == kv[0], F.lit(float(kv[1]))), weights.items(), F.when(F.lit(False), F.lit(0.0)))


def ranked(df: DataFrame, limit: int, *order) -> DataFrame:
    return top_k(df, limit, *order)


def first_seen(df: DataFrame, *order) -> DataFrame:
    """One row for each (query_id, item), its first by ``order``, ranked anew by the same order."""
    once = df.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "item").orderBy(*order))).filter("_n = 1").drop("_n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def weighted_rrf(rankings: DataFrame, weights: dict[str, float], k: int = 60, pool: int = 50, limit: int = 10) -> DataFrame:
    """(query_id, item, score, rank): sum of weight/(k + rank) over the first ``pool`` ranks; ties by best rank, then item."""
    rows = rankings.filter((F.col("rank") <= pool) & F.col("source").isin(*weights))
    fused = rows.groupBy("query_id", "item").agg(F.round(F.sum(_weight(weights) / (k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"))
    return ranked(fused, limit, F.desc("score"), "best_rank", "item").drop("best_rank")


def rrf(rankings: DataFrame, k: int = 60, limit: int = 10) -> DataFrame:
    """Unweighted, over whole rankings; ties by item."""
    fused = rankings.groupBy("query_id", "item").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return ranked(fused, limit, F.desc("score"), "item")


def project_articles(rankings: DataFrame, chunk_articles: DataFrame, pool: int = 50) -> DataFrame:
    """(query_id, source, rank, item=article): articles of the first ``pool`` chunks in first-seen order, ranked without gaps.

    ``chunk_articles`` is (item, article); articles of one chunk follow in their own order.
    """
    seen = rankings.filter(F.col("rank") <= pool).join(chunk_articles, "item").groupBy("query_id", "source", "article").agg(F.min("rank").alias("first"))
    w = Window.partitionBy("query_id", "source").orderBy("first", "article")
    return seen.select("query_id", "source", F.row_number().over(w).alias("rank"), F.col("article").alias("item"))


def weighted_article_rrf(rankings: DataFrame, chunk_articles: DataFrame, weights: dict[str, float], k: int = 60, pool: int = 50, limit: int = 10) -> DataFrame:
    """``project_articles`` of each source, then weighted reciprocal ranks."""
    return weighted_rrf(project_articles(rankings, chunk_articles, pool), weights, k, pool=1 << 30, limit=limit)


def fuse_candidates(rankings: DataFrame, candidates: DataFrame, weights: dict[str, float], k: int = 60, limit: int = 10) -> DataFrame:
    """Only ``candidates`` (query_id, item) score, at their ranks in the whole sources; an unseen one scores 0 and ranks past all."""
    eligible = candidates.select("query_id", "item").distinct()
    size = eligible.groupBy("query_id").agg((F.count("*") + 1).alias("past"))
    hits = rankings.filter(F.col("source").isin(*weights)).groupBy("query_id", "item").agg(F.sum(_weight(weights) / (k + F.col("rank"))).alias("s"), F.min("rank").alias("b"))
    fused = eligible.join(hits, ["query_id", "item"], "left").join(size, "query_id")
    fused = fused.select("query_id", "item", F.round(F.coalesce("s", F.lit(0.0)), 9).alias("score"), F.least(F.coalesce("b", "past"), "past").alias("best_rank"))
    return ranked(fused, limit, F.desc("score"), "best_rank", "item").drop("best_rank")


def protected_shortlist(first: DataFrame, second: DataFrame, fallback: DataFrame, candidates: DataFrame, first_keep: int, second_keep: int, limit: int) -> DataFrame:
    """(query_id, item, rank): a prefix of ``first``, unseen items of ``second``, then all the rest of ``fallback``.

    All three are (query_id, rank, item), and only ``candidates`` (query_id, item) count.  The limit ends the list where
    filling reaches it; prefixes that fill it exactly leave it to the fallback to run on past it.
    """
    if first_keep + second_keep > limit:
        raise ValueError("protected prefixes must fit into the limit")
    ok = candidates.select("query_id", "item").distinct()
    by = Window.partitionBy("query_id").orderBy("rank")
    take = lambda df: df.join(ok, ["query_id", "item"], "left_semi").withColumn("n", F.row_number().over(by))
    a = take(first).filter(F.col("n") <= first_keep).select("query_id", "item", F.lit(0).alias("part"), "n")
    b = take(second.join(a, ["query_id", "item"], "left_anti")).filter(F.col("n") <= second_keep).select("query_id", "item", F.lit(1).alias("part"), "n")
    kept = a.unionByName(b)
    c = take(fallback.join(kept, ["query_id", "item"], "left_anti")).select("query_id", "item", F.lit(2).alias("part"), "n")
    size = kept.groupBy("query_id").agg(F.count("*").alias("kept"))
    rows = kept.unionByName(c).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "n"))).join(size, "query_id", "left")
    over = F.coalesce("kept", F.lit(0)) == limit
    return rows.filter((F.col("rank") <= limit) | (over & F.lit(limit > 0))).select("query_id", "item", "rank")


def retrieval_bonus(scores: DataFrame, rankings: DataFrame, candidates: DataFrame, alpha: float, k: int = 10, limit: int = 10) -> DataFrame:
    """Model score plus ``alpha`` times the reciprocal-rank prior at maximum 1; a missing score is minus infinity."""
    base = fuse_candidates_all(rankings, candidates, k)
    top = Window.partitionBy("query_id")
    scaled = F.when(F.max("prior").over(top) > 0, F.col("prior") / F.max("prior").over(top)).otherwise(0.0)
    joined = base.withColumn("scaled", scaled).join(scores.select("query_id", "item", F.col("score").alias("model")), ["query_id", "item"], "left")
    total = F.coalesce("model", F.lit(float("-inf"))) + alpha * F.col("scaled")
    return ranked(joined.select("query_id", "item", F.round(total, 9).alias("score"), "best_rank"), limit, F.desc("score"), "best_rank", "item").drop("best_rank")


def fuse_candidates_all(rankings: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, item, prior, best_rank) of every candidate."""
    eligible = candidates.select("query_id", "item").distinct()
    size = eligible.groupBy("query_id").agg((F.count("*") + 1).alias("past"))
    hits = rankings.groupBy("query_id", "item").agg(F.sum(1.0 / (k + F.col("rank"))).alias("s"), F.min("rank").alias("b"))
    return eligible.join(hits, ["query_id", "item"], "left").join(size, "query_id").select("query_id", "item", F.coalesce("s", F.lit(0.0)).alias("prior"), F.least(F.coalesce("b", "past"), "past").alias("best_rank"))


def quota_fusion(rankings: DataFrame, chunk_articles: DataFrame, protected: str, keep: int, weights: dict[str, float], k: int = 60, pool: int = 50, limit: int = 10) -> DataFrame:
    """(query_id, item, rank): a prefix of one source's articles, the rest from ``weighted_article_rrf``; a full prefix leaves the rest unlimited."""
    own = project_articles(rankings.filter(F.col("source") == protected), chunk_articles, pool).filter(F.col("rank") <= keep)
    fused = weighted_article_rrf(rankings, chunk_articles, weights, k, pool, 2 * pool)
    rest = fused.join(own, ["query_id", "item"], "left_anti").select("query_id", "item", F.lit(1).alias("part"), "rank")
    both = own.select("query_id", "item", F.lit(0).alias("part"), "rank").unionByName(rest)
    size = own.groupBy("query_id").agg(F.count("*").alias("kept"))
    rows = both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank"))).join(size, "query_id", "left")
    return rows.filter((F.col("place") <= limit) | (F.coalesce("kept", F.lit(0)) == limit)).select("query_id", "item", F.col("place").alias("rank"))


def interleave(rankings: DataFrame, sources: list[str], pool: int = 50, limit: int = 10) -> DataFrame:
    """(query_id, item, rank): round robin by rank, then by the order of ``sources``; each item once."""
    place = reduce(lambda c, kv: c.when(F.col("source") == kv[1], F.lit(kv[0])), enumerate(sources), F.when(F.lit(False), F.lit(0)))
    rows = rankings.filter((F.col("rank") <= pool) & F.col("source").isin(*sources)).select("query_id", "item", F.col("rank").alias("at"), place.alias("src"))
    return first_seen(rows, "at", "src").filter(F.col("rank") <= limit).select("query_id", "item", "rank")


def article_diversify(ranking: DataFrame, chunk_articles: DataFrame, pool: int = 50, limit: int = 10) -> DataFrame:
    """(query_id, item, rank): greedily, a chunk is skipped if any of its articles is taken; a kept one takes them all.

    The fold runs inside the ``pool`` rows of one query, which is its only state.
    """
    articles = chunk_articles.groupBy("item").agg(F.sort_array(F.collect_set("article")).alias("articles"))
    rows = ranking.filter(F.col("rank") <= pool).join(articles, "item", "left").groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "item", F.coalesce("articles", F.array().cast("array<string>")).alias("articles")))).alias("rows")
    )
    empty = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, row: Column) -> Column:
        clash = F.arrays_overlap(state["used"], row["articles"])
        return F.when(clash, state).otherwise(F.struct(F.array_union(state["used"], row["articles"]).alias("used"), F.array_append(state["kept"], row["item"].cast("string")).alias("kept")))

    folded = rows.select("query_id", F.posexplode(F.slice(F.aggregate("rows", empty, step)["kept"], 1, limit)).alias("p", "item"))
    return folded.select("query_id", "item", (F.col("p") + 1).alias("rank"))


def top_articles(ranking: DataFrame, chunk_articles: DataFrame, pool: int, n: int) -> DataFrame:
    """(query_id, item=article, rank): the first n articles by first rank, then name."""
    return project_articles(ranking, chunk_articles, pool).filter(F.col("rank") <= n).select("query_id", "item", "rank")


def article_then_points(ranking: DataFrame, chunk_articles: DataFrame, pool: int, n: int, limit: int = 10) -> DataFrame:
    """(query_id, item, rank): the chunks of the top n articles in the order of the ranking."""
    chosen = top_articles(ranking, chunk_articles, pool, n).select("query_id", F.col("item").alias("article"))
    inside = ranking.join(chunk_articles, "item").join(chosen, ["query_id", "article"], "left_semi").select("query_id", "item", F.col("rank").alias("at")).distinct()
    return ranked(inside, limit, "at").select("query_id", "item", "rank")


def select_evidence(ranking: DataFrame, chunk_articles: DataFrame, articles: DataFrame, n_articles: int, limit: int) -> DataFrame:
    """(query_id, item, rank): the best chunk of each of the first n articles in their order, then the rest of those articles' chunks by rank."""
    chosen = articles.filter(F.col("rank") <= n_articles).select("query_id", F.col("item").alias("article"), F.col("rank").alias("article_rank"))
    inside = ranking.select("query_id", "item", F.col("rank").alias("at")).join(chunk_articles, "item").join(chosen, ["query_id", "article"])
    best = inside.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "article").orderBy("at"))).filter("n = 1")
    rows = best.select("query_id", "item", F.lit(0).alias("part"), F.col("article_rank").alias("place")).unionByName(inside.select("query_id", "item", F.lit(1).alias("part"), F.col("at").alias("place")))
    return first_seen(rows, "part", "place").filter(F.col("rank") <= limit).select("query_id", "item", "rank")


def source_quota(rankings: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(query_id, item, rank): ordered distinct union of the sources' prefixes."""
    names = list(quotas)
    place = reduce(lambda c, kv: c.when(F.col("source") == kv[1], F.lit(kv[0])), enumerate(names), F.when(F.lit(False), F.lit(0)))
    quota = reduce(lambda c, kv: c.when(F.col("source") == kv[0], F.lit(kv[1])), quotas.items(), F.when(F.lit(False), F.lit(0)))
    rows = rankings.filter(F.col("rank") <= quota).select("query_id", "item", place.alias("src"), F.col("rank").alias("at"))
    return first_seen(rows, "src", "at").select("query_id", "item", "rank")
