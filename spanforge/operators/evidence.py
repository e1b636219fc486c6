"""Candidates, reranking and evidence packs per query.

Chunk scores are a relation (query_id, item, score), bridges are (item, article).  What is greedy by nature runs in one
task per query over that query's bounded pool.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.fusion import first_seen


def candidate_map(rankings: DataFrame, sources: list[str], chunk_articles: DataFrame, articles: DataFrame, per_article: int) -> DataFrame:
    """(query_id, article, item, place): the first distinct chunks of each article, sources taken in turn by rank."""
    index = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    rows = rankings.filter(F.col("source").isin(*sources)).join(chunk_articles, "item").join(articles.select("query_id", F.col("item").alias("article")).distinct(), ["query_id", "article"], "left_semi")
    once = rows.groupBy("query_id", "article", "item").agg(F.min(F.struct("rank", index.alias("src"))).alias("first"))
    w = Window.partitionBy("query_id", "article").orderBy("first", "item")
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_article).select("query_id", "article", "item", "place")


def candidate_pool(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """(query_id, item, rank): the candidates in the order of ``articles`` (query_id, rank, item), each chunk once."""
    order = articles.select("query_id", F.col("item").alias("article"), F.col("rank").alias("article_rank"))
    return first_seen(candidates.join(order, ["query_id", "article"]).select("query_id", "item", "article_rank", "place"), "article_rank", "place").select("query_id", "item", "rank")


def rerank(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, item, score, rank) by falling score, then item."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item")))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def best_chunks(scores: DataFrame, chunk_articles: DataFrame, limit: int) -> DataFrame:
    """(query_id, article, item, score, rank): each article's best chunk by (-score, item), articles by (-score, article)."""
    own = scores.join(chunk_articles, "item").withColumn("n", F.row_number().over(Window.partitionBy("query_id", "article").orderBy(F.desc("score"), "item"))).filter("n = 1")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "article", "item"))).filter(F.col("rank") <= limit).select("query_id", "article", "item", "score", "rank")


def neighbors(chunks: DataFrame, chunk_articles: DataFrame, anchors: DataFrame, radius: int = 1) -> DataFrame:
    """(item, article, neighbor, distance): chunks up to ``radius`` places before (negative) and after an anchor in its article.

    ``chunks`` is (item, char_start, char_end); order is by place, then item.
    """
    w = Window.partitionBy("article").orderBy("char_start", "char_end", "item")
    placed = chunks.join(chunk_articles, "item")
    cols = [F.struct((F.lag("item", d) if sign < 0 else F.lead("item", d)).over(w).alias("neighbor"), F.lit(sign * d).alias("distance")) for d in range(1, radius + 1) for sign in (-1, 1)]
    around = placed.select("item", "article", F.array(*cols).alias("all")).join(anchors.select("item").distinct(), "item", "left_semi")
    return around.select("item", "article", F.explode("all").alias("n")).filter("n.neighbor is not null").select("item", "article", "n.neighbor", "n.distance")


def overlap_weighted(ranking: DataFrame, spans: DataFrame, limit: int, pool: int = 50, rank_k: int = 60) -> DataFrame:
    """(query_id, item=article, score, rank): articles by the greatest overlap share/(rank_k + rank) of a chunk; ties by its rank, then name.

    ``ranking`` carries char_start and char_end, ``spans`` (law, article, start, end) what a chunk may overlap in its law.
    """
    rows = ranking.filter((F.col("rank") <= pool) & (F.col("char_end") > F.col("char_start"))).join(spans, "law")
    part = F.greatest(F.lit(0), F.least("char_end", "end") - F.greatest("char_start", "start"))
    scored = rows.withColumn("part", part).filter("part > 0").withColumn("score", F.round(F.col("part") / (F.col("char_end") - F.col("char_start")) / (rank_k + F.col("rank")), 9))
    best = scored.groupBy("query_id", "article").agg(F.max(F.struct("score", (-F.col("rank")).alias("at"))).alias("b"))
    w = Window.partitionBy("query_id").orderBy(F.desc("b.score"), F.desc("b.at"), "article")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", F.col("article").alias("item"), "b.score", "rank")


def _per_query(rows: DataFrame, run: Callable[[pd.DataFrame], list[str]]) -> DataFrame:
    query_type = rows.schema["query_id"].dataType.simpleString()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        items = run(group)
        return pd.DataFrame({"query_id": [group["query_id"].iloc[0]] * len(items), "item": items, "rank": range(1, len(items) + 1)})

    return rows.groupBy("query_id").applyInPandas(one, f"query_id {query_type}, item string, rank int")


def diverse_selection(pool: DataFrame, limit: int, diversity: float) -> DataFrame:
    """(query_id, item, rank): maximal marginal relevance over (query_id, item, score, words, norm_ids).

    Utility is (1 - diversity) times the score scaled to 0..1 (1 where all are equal) plus diversity times one less the
    greatest likeness to what is chosen: the larger Jaccard of words and of norm ids, 0 for empty unions.  Ties by item.
    """
    if not 0 <= diversity <= 1:
        raise ValueError("diversity must be between 0 and 1")

    def run(g: pd.DataFrame) -> list[str]:
        g = g.drop_duplicates("item").sort_values("item")
        score = g["score"].astype(float)
        span = score.max() - score.min()
        value = dict(zip(g["item"], (score - score.min()) / span if span else score * 0 + 1.0))
        sets = {i: (set(w), set(n)) for i, w, n in zip(g["item"], g["words"], g["norm_ids"])}
        share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
        closest, chosen = dict.fromkeys(value, 0.0), []
        while closest and len(chosen) < limit:
            best = min(closest, key=lambda i: (-((1 - diversity) * value[i] + diversity * (1 - closest[i])), i))
            chosen.append(best)
            del closest[best]
            for i in closest:
                closest[i] = max(closest[i], *(share(a, b) for a, b in zip(sets[i], sets[best])))
        return chosen

    return _per_query(pool.select("query_id", "item", "score", "words", "norm_ids"), run)


def evidence_pack(candidates: DataFrame, budget: int, per_article: int, primaries: int) -> DataFrame:
    """(query_id, item, rank) of at most ``budget`` chunks from (query_id, article, article_rank, within, item, score).

    The first chunk of each of the first ``primaries`` articles, then all others by (-score, article_rank, within, item), an
    article's cap and a chunk taken already being passed over.
    """
    if primaries > budget:
        raise ValueError("primaries must fit into the budget")

    def run(g: pd.DataFrame) -> list[str]:
        taken: dict[str, int] = {}
        out: list[str] = []
        leads = g[g["within"] == g.groupby("article")["within"].transform("min")].sort_values("article_rank")
        order = sorted(set(g["article_rank"]))[:primaries]
        rest = g.assign(neg=-g["score"]).sort_values(["neg", "article_rank", "within", "item"])
        for rows, forced in ((leads[leads["article_rank"].isin(order)], True), (rest, False)):
            for r in rows.itertuples():
                if not forced and len(out) >= budget:
                    break
                if r.item not in out and taken.get(r.article, 0) < per_article:
                    out.append(r.item)
                    taken[r.article] = taken.get(r.article, 0) + 1
        return out

    return _per_query(candidates, run)


def adaptive_pack(candidates: DataFrame, max_chunks: int, token_budget: int, per_article: int = 2, ratio: float = 0.0, bonus: float = 0.0) -> DataFrame:
    """(query_id, item, rank) from (query_id, article, article_rank, within, item, score, tokens, paths).

    Every article's first chunk is taken even past the token budget, as far as there is room for chunks; then, one at a time,
    the chunk of greatest score plus ``bonus`` for a structure path new to its article, if its score reaches ``ratio`` of
    its article's first one and its tokens fit.  Ties by (article_rank, within, item).
    """

    def run(g: pd.DataFrame) -> list[str]:
        rows = g.sort_values(["article_rank", "within", "item"]).to_dict("records")
        out: list[str] = []
        count: dict[str, int] = {}
        known: dict[str, set] = {}
        lead: dict[str, float] = {}
        used = 0

        def take(r: dict) -> None:
            nonlocal used
            out.append(r["item"])
            count[r["article"]] = count.get(r["article"], 0) + 1
            known.setdefault(r["article"], set()).update(r["paths"])
            used += r["tokens"]

        waiting = []
        for r in rows:
            if r["article"] not in lead and len(out) < max_chunks and r["within"] == 1:
                lead[r["article"]] = r["score"]
                if r["item"] not in out and per_article > 0:
                    take(r)
            elif r["article"] in lead:
                waiting.append(r)
        while len(out) < max_chunks:
            fit = [
                r for r in waiting
                if r["item"] not in out and count.get(r["article"], 0) < per_article and r["score"] >= max(lead[r["article"]], 1e-9) * ratio and used + r["tokens"] <= token_budget
            ]
            if not fit:
                break
            take(min(fit, key=lambda r: (-(r["score"] + bonus * (not set(r["paths"]) <= known.get(r["article"], set()))), r["article_rank"], r["within"], r["item"])))
        return out

    return _per_query(candidates, run)


def budget_pack(ranking: DataFrame, char_budget: int) -> DataFrame:
    """(query_id, item, rank) from (query_id, article, article_rank, at, item, chars): a first chunk for each article in order, then by rank; what does not fit is passed over."""

    def run(g: pd.DataFrame) -> list[str]:
        g = g.sort_values(["at", "item"])
        firsts = g.drop_duplicates("article").sort_values("article_rank")
        out: list[str] = []
        left = char_budget
        for r in [*firsts.itertuples(), *g.itertuples()]:
            if r.item not in out and r.chars <= left:
                out.append(r.item)
                left -= r.chars
        return out

    return _per_query(ranking, run)
