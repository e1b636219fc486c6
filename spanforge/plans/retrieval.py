"""Retrieval queries: arguments of complaints against the chunks of the laws.

The query set is stated: every case whose number is divisible by 50, against all chunks; ``select_evidence`` asks for every case.  Two
sources rank them: BM25 and the cosine of term sets.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import ids
from spanforge.functions.latest import latest
from spanforge.functions.text import jaccard, token_cost, word_set
from spanforge.operators import dense, evidence, fusion, lexical, metrics
from spanforge.session import cut, signature, still_there, table

POOL = 50
BOTH = {"bm25": 2.0, "cosine": 1.0}


class Base:
    """The relations that the queries share: an index, written once for each state of its tables and read by every query.

    With ``every``, the query set is all cases.
    """

    def __init__(self, spark: SparkSession, d: str, every: bool = False) -> None:
        self.spark, self.d, self.every = spark, d, every
        self.cuts: list[DataFrame] = []

    def _kept(self, df: DataFrame) -> DataFrame:
        out = cut(df)
        self.cuts.append(out)
        return out

    @cached_property
    def cases(self) -> DataFrame:
        return latest(table(self.spark, self.d, "eval_cases"), ["case_id"], "loaded_at", ["complaint_argument_blind", "gold_norms", "topic", "split", "case_group_id", "issue_type"])

    @cached_property
    def chosen(self) -> DataFrame:
        number = F.regexp_extract("case_id", r"(\d+)$", 1).cast("long")
        rows = table(self.spark, self.d, "eval_cases").filter(F.col("case_id").isNotNull() if self.every else number % 50 == 0)
        one = latest(rows, ["case_id"], "loaded_at", ["complaint_argument_blind", "gold_norms", "topic", "split", "case_group_id"])
        return self._kept(one.filter(F.col("complaint_argument_blind").isNotNull()))

    @cached_property
    def asked(self) -> DataFrame:
        return self.chosen.select(F.col("case_id").alias("query_id"), F.col("complaint_argument_blind").alias("text"), "topic", F.lower(F.regexp_replace("split", r"\s", "")).alias("split"))

    @cached_property
    def corpus(self) -> DataFrame:
        return self._kept(latest(table(self.spark, self.d, "chunks"), ["chunk_id"], None, ["text", "norm_ids", "char_start", "char_end"]).withColumnRenamed("chunk_id", "item"))

    @cached_property
    def bridge(self) -> DataFrame:
        return self._kept(self.corpus.select("item", F.explode(F.array_distinct(F.transform("norm_ids", ids.article_key))).alias("article")))

    @cached_property
    def gold(self) -> DataFrame:
        rows = self.chosen.select(F.col("case_id").alias("query_id"), F.explode("gold_norms").alias("n"))
        return rows.select("query_id", ids.unit_key(F.col("n")).alias("norm_id"), ids.article_key(F.col("n")).alias("article")).distinct()

    @cached_property
    def weights(self) -> DataFrame:
        return self._kept(lexical.packed_weights(self.packed))

    @cached_property
    def packed(self) -> DataFrame:
        return self._kept(lexical.packed(self.corpus, "item", "text"))

    @cached_property
    def index(self) -> tuple:
        return lexical.sent_index(self.packed, self.weights)

    @cached_property
    def rankings_(self) -> DataFrame:
        return self._kept(self._search({"bm25": POOL, "cosine": POOL}).select("query_id", "source", "rank", "item"))

    def _search(self, ks: dict[str, int]) -> DataFrame:
        return lexical.packed_search(self.index, "item", self.asked, "query_id", "text", ks)

    def bm25(self, k: int = POOL) -> DataFrame:
        return self._search({"bm25": k}).drop("source")

    def cosine(self, k: int = POOL) -> DataFrame:
        return self._search({"cosine": k}).drop("source")

    def rankings(self) -> DataFrame:
        """(query_id, source, rank, item)."""
        return self.rankings_

    @cached_property
    def projected(self) -> DataFrame:
        """The rankings at the level of articles, written once for the queries that read them several times."""
        return self._kept(fusion.project_articles(self.rankings(), self.bridge))

    def retrieved(self, ranking: DataFrame) -> DataFrame:
        """A ranking with the units (without edition) and articles of its chunks."""
        units = self.corpus.select("item", F.explode("norm_ids").alias("n")).select("item", ids.unit_key(F.col("n")).alias("norm_id"), ids.article_key(F.col("n")).alias("article"))
        return ranking.join(units, "item").select("query_id", "rank", "item", "norm_id", "article")


_kept_bases: dict[tuple, Base] = {}


def base(spark: SparkSession, d: str, every: bool = False) -> Base:
    """The index of a folder's tables; a kept one serves again as long as its tables have not been written anew and its files are there."""
    key = (spark.sparkContext.applicationId, d, signature(spark, d, ("eval_cases", "chunks")), every)
    known = _kept_bases.get(key)
    if known is None or not all(map(still_there, known.cuts)):
        while len(_kept_bases) >= 4:
            _kept_bases.pop(next(iter(_kept_bases)))
        known = _kept_bases[key] = Base(spark, d, every)
    return known


def bm25_index(s, d):
    """One row: the texts, terms and postings of the index that the lexical queries read."""
    b = base(s, d)
    return b.weights.agg(F.max("n").alias("texts"), F.count("*").alias("terms"), F.sum("df").alias("postings"))


def _articles(b: Base, weights: dict[str, float] | None = None, limit: int = 10) -> DataFrame:
    return fusion.weighted_rrf(b.projected, weights or BOTH, k=30, pool=1 << 30, limit=limit)


def _model(b: Base) -> DataFrame:
    """(query_id, item, score): a deterministic pair score in the place of a cross-encoder: the likeness of word sets."""
    pairs = b.rankings().select("query_id", "item").distinct()
    left = b.asked.select("query_id", word_set(F.col("text")).alias("l"))
    right = b.corpus.select("item", word_set(F.col("text")).alias("r"))
    return pairs.join(left, "query_id").join(right, "item").select("query_id", "item", F.round(jaccard(F.col("l"), F.col("r")), 6).alias("score"))


def bm25_topk(s, d):
    return base(s, d).bm25(10)


def bm25_terms(s, d):
    return base(s, d).weights.select("term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


def set_cosine_topk(s, d):
    return base(s, d).cosine(10)


def dense_topk(s, d):
    rows = table(s, d, "embeddings")
    return dense.dense_search(rows, "vec_id", "embedding", rows.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)


def rrf(s, d):
    return fusion.rrf(base(s, d).rankings())


def weighted_rrf(s, d):
    return fusion.weighted_rrf(base(s, d).rankings(), BOTH, k=30)


def article_projection(s, d):
    b = base(s, d)
    return fusion.project_articles(b.rankings(), b.bridge)


def weighted_article_rrf(s, d):
    return _articles(base(s, d))


def fuse_candidates(s, d):
    b = base(s, d)
    projected = fusion.project_articles(b.rankings(), b.bridge)
    candidates = projected.filter("rank <= 10").select("query_id", "item")
    return fusion.fuse_candidates(projected, candidates, BOTH, k=30)


def protected_shortlist(s, d):
    b = base(s, d)
    p = b.projected
    one, two = (p.filter(F.col("source") == x).select("query_id", "rank", "item") for x in ("bm25", "cosine"))
    return fusion.protected_shortlist(one, two, _articles(b, limit=100), p.filter("rank <= 10"), 4, 3, 10)


def retrieval_bonus(s, d):
    b = base(s, d)
    p = fusion.project_articles(b.rankings(), b.bridge)
    scores = evidence.best_chunks(_model(b), b.bridge, 1000).select("query_id", F.col("article").alias("item"), "score")
    return fusion.retrieval_bonus(scores, p, p.filter("rank <= 10"), 0.5)


def quota_fusion(s, d):
    b = base(s, d)
    return fusion.quota_fusion(b.rankings(), b.bridge, "cosine", 5, BOTH, k=30)


def interleave(s, d):
    return fusion.interleave(base(s, d).rankings(), ["cosine", "bm25"], limit=20)


def article_diversify(s, d):
    b = base(s, d)
    return fusion.article_diversify(b.bm25().select("query_id", "rank", "item"), b.bridge)


def top_articles(s, d):
    b = base(s, d)
    return fusion.top_articles(b.rankings().filter("source = 'bm25'"), b.bridge, 30, 5)


def article_then_points(s, d):
    b = base(s, d)
    return fusion.article_then_points(b.rankings().filter("source = 'bm25'"), b.bridge, 30, 5)


def select_evidence(s, d):
    """Of every case."""
    b = base(s, d, every=True)
    return fusion.select_evidence(b.rankings().filter("source = 'bm25'").select("query_id", "rank", "item"), b.bridge, _articles(b), 5, 10)


def source_quota(s, d):
    b = base(s, d)
    return fusion.source_quota(b.projected, {"cosine": 4, "bm25": 6})


def _candidates(b: Base, per: int = 2) -> tuple[DataFrame, DataFrame]:
    articles = fusion.source_quota(b.projected, {"cosine": 4, "bm25": 6})
    return articles, evidence.candidate_map(b.rankings(), ["cosine", "bm25"], b.bridge, articles, per)


def candidate_map(s, d):
    return _candidates(base(s, d))[1]


def candidate_pool(s, d):
    articles, candidates = _candidates(base(s, d))
    return evidence.candidate_pool(candidates, articles)


def best_chunks(s, d):
    b = base(s, d)
    return evidence.best_chunks(_model(b), b.bridge, 10)


def neighbors(s, d):
    b = base(s, d)
    return evidence.neighbors(b.corpus.select("item", "char_start", "char_end"), b.bridge, b.bm25(10), 2)


def overlap_weighted(s, d):
    b = base(s, d)
    law = F.regexp_extract(F.get("norm_ids", F.lit(0)), "^([^:]*)", 1)
    spans = latest(table(s, d, "norm_units").filter("unit_level = 'article'"), ["norm_id"], "loaded_at", ["edition_id", "is_repealed", "char_start", "char_end"])
    newest = b.corpus.select(F.explode("norm_ids").alias("n")).select(F.regexp_extract("n", "^([^:]*)", 1).alias("law"), F.regexp_extract("n", "^[^:]*:([^:]*)", 1).alias("edition_id")).groupBy("law").agg(F.max("edition_id").alias("edition_id"))
    whole = latest(table(s, d, "norm_units"), ["norm_id"], "loaded_at", ["char_start", "char_end"]).groupBy(F.regexp_replace("norm_id", r"^([^:]*:[^:]*:art\.[^:]*).*$", "$1").alias("norm_id")).agg(F.min("char_start").alias("start"), F.max("char_end").alias("end"))
    live = spans.filter("not is_repealed").join(whole, "norm_id").select(F.regexp_extract("norm_id", "^([^:]*)", 1).alias("law"), "edition_id", ids.article_key(F.col("norm_id")).alias("article"), "start", "end").join(newest, ["law", "edition_id"], "left_semi")
    ranking = b.bm25().join(b.corpus.select("item", law.alias("law"), "char_start", "char_end"), "item")
    return evidence.overlap_weighted(ranking, live, 10)


def recall_by_topic(s, d):
    b = base(s, d)
    scores = metrics.score_cases(b.gold, b.retrieved(b.bm25(10)), 10)
    return metrics.aggregate_recall(scores.join(b.asked.select("query_id", "split", "topic"), "query_id"), ["split", "topic"])


def overlap_at_k(s, d):
    b = base(s, d)
    return metrics.overlap_at_k(b.retrieved(b.bm25(10)), b.retrieved(b.cosine(10)), b.gold.select("query_id", "article").distinct(), 10)


def best_rank_bucket(s, d):
    b = base(s, d)
    return metrics.best_rank(b.gold, b.retrieved(b.bm25(100)), "article")


def complementarity(s, d):
    b = base(s, d)
    return metrics.complementarity(b.gold, b.retrieved(b.bm25(10)), b.retrieved(b.cosine(10)))


def repeated_slots(s, d):
    b = base(s, d)
    return metrics.repeated_slots(b.gold, b.retrieved(b.bm25(10)))


def gold_status(s, d):
    b = base(s, d)
    corpus = b.corpus.select(F.explode("norm_ids").alias("n")).select(ids.unit_key(F.col("n")).alias("norm_id"))
    wanted = b.cases.select(F.explode("gold_norms").alias("n")).select(ids.unit_key(F.col("n")).alias("norm_id"))
    return metrics.gold_status(wanted, corpus)


def _labelled(s, d) -> DataFrame:
    cases = base(s, d).cases
    return cases.select("case_id", F.coalesce("case_group_id", "case_id").alias("group_id"), F.col("issue_type").alias("label"), F.explode(F.array_distinct("gold_norms")).alias("n")).select("case_id", "group_id", "label", ids.unit_key(F.col("n")).alias("norm_id")).distinct()


def label_mapping(s, d):
    return metrics.label_mapping(_labelled(s, d))


def leave_group_out(s, d):
    return metrics.leave_group_out(_labelled(s, d), 5)


def spearman(s, d):
    b = base(s, d)
    return metrics.spearman(b.bm25(), b.cosine())


def top_overlap(s, d):
    b = base(s, d)
    return metrics.top_overlap(b.bm25(), b.cosine(), 10)


def experiments(s, d) -> DataFrame:
    """A table of results: per depth and source, the recall of articles and units and its cost in chunks."""
    b = base(s, d)
    rows = b.rankings().join(b.retrieved(b.rankings().select("query_id", "rank", "item")).select("query_id", "item", "norm_id", "article").distinct(), ["query_id", "item"])
    first = rows.groupBy("source", "query_id", "norm_id").agg(F.min("rank").alias("at")), rows.groupBy("source", "query_id", "article").agg(F.min("rank").alias("at"))
    sources = s.createDataFrame([("bm25",), ("cosine",)], "source string")
    depth = F.explode(F.array(*(F.lit(k) for k in (1, 3, 5, 10, 20, 50)))).alias("k")
    means = []
    for level, hits in zip(("norm_id", "article"), first):
        wanted = b.gold.select("query_id", level).distinct().crossJoin(F.broadcast(sources)).join(hits, ["source", "query_id", level], "left").select("source", "query_id", "at", depth)
        share = wanted.groupBy("source", "query_id", "k").agg(F.avg(F.coalesce(F.col("at") <= F.col("k"), F.lit(False)).cast("int")).alias("share"))
        means.append(share.groupBy("source", "k").agg(F.round(F.avg("share"), 6).alias("exact" if level == "norm_id" else level)))
    joined = means[0].join(means[1], ["source", "k"])
    return cut(joined.select(F.format_string("%s@%02d", "source", "k").alias("name"), "article", "exact", F.col("k").cast("long").alias("cost")))


def pareto(s, d):
    return metrics.pareto(experiments(s, d), "name", ["article", "exact"], ["cost"])


def winner_tie_band(s, d):
    return metrics.winner(experiments(s, d), "article", ["exact"], "cost", "name")


def budget_winners(s, d):
    budgets = s.createDataFrame([(5,), (10,), (50,)], "budget long")
    return metrics.budget_winners(experiments(s, d), budgets, "cost", "article", "cost", "name")


def _packable(b: Base) -> DataFrame:
    """Candidates of each query's articles with model scores, costs and structure paths."""
    articles, candidates = _candidates(b, 8)
    order = articles.select("query_id", F.col("item").alias("article"), F.col("rank").alias("article_rank"))
    scored = candidates.join(_model(b), ["query_id", "item"]).join(order, ["query_id", "article"])
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", "article").orderBy(F.desc("score"), "item")
    text = b.corpus.select("item", token_cost(F.col("text")).alias("tokens"), F.transform("norm_ids", ids.unit_key).alias("paths"), F.length("text").alias("chars"), word_set(F.col("text")).alias("words"), "norm_ids")
    return scored.withColumn("within", F.row_number().over(w)).join(text, "item")


def evidence_pack(s, d):
    return evidence.evidence_pack(_packable(base(s, d)).select("query_id", "article", "article_rank", "within", "item", "score"), 10, 2, 5)


def adaptive_pack(s, d):
    return evidence.adaptive_pack(_packable(base(s, d)).select("query_id", "article", "article_rank", "within", "item", "score", "tokens", "paths"), 20, 3000, 2, 0.25, 0.05)


def diverse_selection(s, d):
    return evidence.diverse_selection(_packable(base(s, d)), 10, 0.5)


def budget_pack(s, d):
    rows = _packable(base(s, d)).select("query_id", "article", "article_rank", F.col("place").alias("at"), "item", "chars")
    return evidence.budget_pack(rows, 4000)


def _paired_recall(s, d) -> DataFrame:
    b = base(s, d)
    one = metrics.score_cases(b.gold, b.retrieved(b.bm25(10)), 10).select("query_id", F.col("article").alias("base"))
    two = metrics.score_cases(b.gold, b.retrieved(b.cosine(10)), 10).select("query_id", F.col("article").alias("cand"))
    return one.join(two, "query_id").join(b.chosen.select(F.col("case_id").alias("query_id"), F.coalesce("case_group_id", "case_id").alias("g")), "query_id")


def bootstrap_interval(s, d):
    """Article recall of the set cosine against BM25, groups of cases resampled by a seeded generator."""
    return s.createDataFrame([metrics.group_bootstrap(_paired_recall(s, d), "g", "base", "cand")], "mean_delta double, low double, high double")


def bootstrap_draws(s, d):
    """The same with draws by digest."""
    return metrics.hashed_bootstrap(_paired_recall(s, d), "g", "base", "cand")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_index, bm25_topk, bm25_terms, set_cosine_topk, dense_topk, rrf, weighted_rrf, article_projection, weighted_article_rrf, fuse_candidates, protected_shortlist,
        retrieval_bonus, quota_fusion, interleave, article_diversify, top_articles, article_then_points, select_evidence, source_quota, candidate_map, candidate_pool,
        best_chunks, neighbors, overlap_weighted, recall_by_topic, overlap_at_k, best_rank_bucket, complementarity, repeated_slots, gold_status, label_mapping,
        leave_group_out, spearman, top_overlap, pareto, winner_tie_band, budget_winners, evidence_pack, adaptive_pack, diverse_selection, budget_pack, bootstrap_interval, bootstrap_draws,
    )
}
