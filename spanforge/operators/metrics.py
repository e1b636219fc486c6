"""Retrieval metrics, overlaps, label tables, winners and resampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_cases(gold: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """(query_id, exact, article, exact_all, article_all): shares of the gold ids, and of their articles, in the first k.

    ``gold`` is (query_id, norm_id, article), ``retrieved`` (query_id, rank, norm_id, article).  Queries without gold have no row;
    repeated gold ids count once.
    """
    top = retrieved.filter(F.col("rank") <= k)
    exact = gold.select("query_id", "norm_id").distinct().join(top.select("query_id", "norm_id", F.lit(1).alias("hit")).distinct(), ["query_id", "norm_id"], "left")
    article = gold.select("query_id", "article").distinct().join(top.select("query_id", "article", F.lit(1).alias("hit")).distinct(), ["query_id", "article"], "left")
    share = lambda df, name: df.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias(name))
    both = share(exact, "exact").join(share(article, "article"), "query_id")
    return both.withColumns({"exact_all": F.col("exact") == 1, "article_all": F.col("article") == 1})


def aggregate_recall(scores: DataFrame, by: list[str]) -> DataFrame:
    """Macro means over cases by ``by`` and, with the last key as `*`, by the others: one pass of grouping sets."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("exact", "article")] + [F.round(F.avg(F.col(c).cast("int")), 6).alias(c) for c in ("exact_all", "article_all")]
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in by]
    rows = scores.select(*keys, "exact", "article", "exact_all", "article_all")
    sets = [[F.col(c) for c in by], [F.col(c) for c in by[:-1]]]
    out = rows.groupingSets(sets, *by).agg(F.count("*").alias("n"), *means)
    return out.withColumn(by[-1], F.coalesce(by[-1], F.lit("*")))


def overlap_at_k(left: DataFrame, right: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, jaccard, and shares of gold articles in left, right, union, only_left, only_right, both) of two rankings with (query_id, rank, item, article)."""
    from spanforge.functions.text import jaccard

    sets = lambda df, p: df.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("item").alias(f"{p}i"), F.collect_set("article").alias(f"{p}a"))
    wanted = gold.groupBy("query_id").agg(F.collect_set("article").alias("g"))
    none = F.array().cast("array<string>")
    rows = wanted.join(sets(left, "l"), "query_id", "left").join(sets(right, "r"), "query_id", "left")
    rows = rows.select("query_id", "g", *(F.coalesce(c, none).alias(c) for c in ("li", "la", "ri", "ra")))
    hit_l, hit_r = F.array_intersect("g", "la"), F.array_intersect("g", "ra")
    share = lambda a: F.round(F.size(a) / F.size("g"), 6)
    return rows.select(
        "query_id", F.round(jaccard(F.col("li"), F.col("ri")), 6).alias("jaccard"), share(hit_l).alias("left_share"), share(hit_r).alias("right_share"),
        share(F.array_union(hit_l, hit_r)).alias("union_share"), share(F.array_except(hit_l, hit_r)).alias("only_left"),
        share(F.array_except(hit_r, hit_l)).alias("only_right"), share(F.array_intersect(hit_l, hit_r)).alias("both_share"),
    )


def rank_bucket(rank: Column) -> Column:
    """<=10, 11-20, 21-50, 51-100, >100; null and beyond are the last."""
    out = F.when(rank <= 10, "<=10").when(rank <= 20, "11-20").when(rank <= 50, "21-50").when(rank <= 100, "51-100")
    return out.otherwise(">100")


def best_rank(gold: DataFrame, retrieved: DataFrame, level: str) -> DataFrame:
    """(query_id, best, bucket): the first rank with a gold ``level`` (norm_id or article); null where none has."""
    hits = gold.select("query_id", level).distinct().join(retrieved, ["query_id", level]).groupBy("query_id").agg(F.min("rank").alias("best"))
    return gold.select("query_id").distinct().join(hits, "query_id", "left").withColumn("bucket", rank_bucket(F.col("best")))


def complementarity(gold: DataFrame, left: DataFrame, right: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, label): which of two rankings has a gold article in its first k."""
    has = lambda df, n: df.filter(F.col("rank") <= k).join(gold.select("query_id", "article").distinct(), ["query_id", "article"], "left_semi").select("query_id", F.lit(True).alias(n)).distinct()
    rows = gold.select("query_id").distinct().join(has(left, "l"), "query_id", "left").join(has(right, "r"), "query_id", "left")
    label = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "only_left").when(F.col("r"), "only_right").otherwise("neither")
    return rows.select("query_id", label.alias("label"))


def repeated_slots(gold: DataFrame, retrieved: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, slots): places of the first k spent on a further chunk of an article that is not gold."""
    wrong = retrieved.filter(F.col("rank") <= k).select("query_id", "rank", "article").distinct().join(gold.select("query_id", "article").distinct(), ["query_id", "article"], "left_anti")
    per = wrong.groupBy("query_id", "article").agg(F.count("*").alias("n"))
    return gold.select("query_id").distinct().join(per.groupBy("query_id").agg(F.sum(F.col("n") - 1).alias("slots")), "query_id", "left").select("query_id", F.coalesce("slots", F.lit(0)).alias("slots"))


def gold_status(gold: DataFrame, corpus_ids: DataFrame) -> DataFrame:
    """(norm_id, status): exact, descendant (the corpus has a part of it), ancestor (the corpus has what it is part of) or absent.

    Ids are compared by the prefixes of both sides, so that each join is an equality.
    """
    from spanforge.functions.ids import prefixes

    ids = corpus_ids.select("norm_id").distinct()
    wanted = gold.select("norm_id").distinct()
    exact = ids.select("norm_id", F.lit(True).alias("exact"))
    below = ids.select(F.explode(F.slice(prefixes(F.col("norm_id")), 2, 20)).alias("norm_id")).distinct().withColumn("below", F.lit(True))
    above = wanted.select("norm_id", F.explode(F.slice(prefixes(F.col("norm_id")), 2, 20)).alias("up")).join(ids.withColumnRenamed("norm_id", "up"), "up", "left_semi").select("norm_id").distinct().withColumn("above", F.lit(True))
    rows = wanted.join(exact, "norm_id", "left").join(below, "norm_id", "left").join(above, "norm_id", "left")
    return rows.select("norm_id", F.when(F.col("exact"), "exact").when(F.col("below"), "descendant").when(F.col("above"), "ancestor").otherwise("absent").alias("status"))


def label_mapping(rows: DataFrame, most: int = 10, skip: tuple[str, ...] = ("other", "unclear"), by: list[str] | None = None) -> DataFrame:
    """(*by, label, norm_id, groups, cases, rank): the ids of each label by distinct groups, then cases, then id.

    ``rows`` is (*by, case_id, group_id, label, norm_id); service labels and null labels have none.
    """
    by = by or []
    ok = rows.filter(F.col("label").isNotNull() & ~F.col("label").isin(*skip))
    counted = ok.groupBy(*by, "label", "norm_id").agg(F.countDistinct("group_id").alias("groups"), F.countDistinct("case_id").alias("cases"))
    w = Window.partitionBy(*by, "label").orderBy(F.desc("groups"), F.desc("cases"), "norm_id")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def leave_group_out(rows: DataFrame, most: int = 10, skip: tuple[str, ...] = ("other", "unclear")) -> DataFrame:
    """(case_id, norm_id, rank): each case's ids predicted by the mapping of all groups but its own.

    Only support changes: what a group adds to a (label, id) is taken off, so that no pairs of groups are formed; a group
    predicts at most the ids of its own labels.
    """
    ok = rows.filter(F.col("label").isNotNull() & ~F.col("label").isin(*skip))
    total = ok.groupBy("label", "norm_id").agg(F.countDistinct("group_id").alias("groups"), F.countDistinct("case_id").alias("cases"))
    own = ok.groupBy("group_id", "label", "norm_id").agg(F.countDistinct("case_id").alias("own_cases"))
    held = ok.select("group_id", "label").distinct().join(total, "label").join(own, ["group_id", "label", "norm_id"], "left")
    left = held.select("group_id", "label", "norm_id", (F.col("groups") - F.when(F.col("own_cases").isNotNull(), 1).otherwise(0)).alias("groups"), (F.col("cases") - F.coalesce("own_cases", F.lit(0))).alias("cases"))
    w = Window.partitionBy("group_id", "label").orderBy(F.desc("groups"), F.desc("cases"), "norm_id")
    best = left.filter("groups > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ok.select("case_id", "group_id", "label").distinct().join(best, ["group_id", "label"]).select("case_id", "norm_id", "rank")


def spearman(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, n, rho): rank correlation of the items that two rankings share, ranked anew; 1 for fewer than two."""
    both = left.select("query_id", "item", F.col("rank").alias("a")).join(right.select("query_id", "item", F.col("rank").alias("b")), ["query_id", "item"])
    again = both.select("query_id", *(F.row_number().over(Window.partitionBy("query_id").orderBy(c)).alias(c) for c in ("a", "b")))
    n, d = F.count("*"), F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))
    return again.groupBy("query_id").agg(n.alias("n"), F.round(F.when(n < 2, 1.0).otherwise(1 - 6 * d / (n * (n * n - 1))), 6).alias("rho"))


def top_overlap(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(query_id, share): common items of the first k of two rankings over min(k, their lengths)."""
    cut_ = lambda df, c: df.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("item").alias(c))
    rows = cut_(left, "l").join(cut_(right, "r"), "query_id")
    least = F.least(F.lit(k), F.size("l"), F.size("r"))
    return rows.select("query_id", F.round(F.when(least == 0, 1.0).otherwise(F.size(F.array_intersect("l", "r")) / least), 6).alias("share"))


def pareto(rows: DataFrame, key: str, gains: list[str], costs: list[str]) -> DataFrame:
    """The rows that no other row beats: at least as good everywhere and better somewhere.  ``rows`` is a table of results, a few hundred at most by nature."""
    a, b = rows.alias("a"), rows.alias("b")
    good = [F.col(f"b.{g}") >= F.col(f"a.{g}") for g in gains] + [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in costs]
    better = [F.col(f"b.{g}") > F.col(f"a.{g}") for g in gains] + [F.col(f"b.{c}") < F.col(f"a.{c}") for c in costs]
    every, some = good[0], better[0]
    for g, x in zip(good[1:], better[1:]):
        every, some = every & g, some | x
    return a.join(F.broadcast(b), every & some, "left_anti")


def winner(rows: DataFrame, main: str, others: list[str], *order: str | Column, band: float = 0.01) -> DataFrame:
    """The row within ``band`` of the greatest ``main``, then of greatest ``others``, then first by ``order``."""
    near = rows.crossJoin(F.broadcast(rows.agg(F.max(main).alias("_best")))).filter(F.col("_best") - F.col(main) < band).drop("_best")
    return near.orderBy(*(F.desc(o) for o in others), *order).limit(1)


def budget_winners(rows: DataFrame, budgets: DataFrame, cost: str, main: str, *order: str) -> DataFrame:
    """For each budget, the affordable row of greatest ``main``, then first by ``order``."""
    ok = F.broadcast(budgets).join(rows, F.col(cost) <= F.col("budget"))
    w = Window.partitionBy("budget").orderBy(F.desc(main), *order)
    return ok.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def group_bootstrap(rows: DataFrame, group: str, baseline: str, candidate: str, samples: int = 10000, seed: int = 20261008) -> tuple[float, float, float]:
    """(mean difference, low, high) with whole groups drawn again and again; the bounds are the values at 2.5 and 97.5 per cent.

    Groups are first summed, so that only a sum and a size per group come to the driver; groups are the independent
    units of an evaluation, and more than a million are refused.
    """
    sums = rows.groupBy(F.col(group).cast("string").alias("g")).agg(F.sum(F.col(candidate) - F.col(baseline)).alias("d"), F.count("*").alias("n")).orderBy("g").limit(1_000_001).collect()
    if not sums:
        raise ValueError("no rows to resample")
    if len(sums) > 1_000_000:
        raise ValueError("too many groups for the driver")
    rng = random.Random(seed)
    means = []
    for _ in range(samples):
        drawn = [rng.choice(sums) for _ in sums]
        means.append(sum(r["d"] for r in drawn) / sum(r["n"] for r in drawn))
    means.sort()
    mean = sum(r["d"] for r in sums) / sum(r["n"] for r in sums)
    return mean, means[int(0.025 * (samples - 1))], means[int(0.975 * (samples - 1))]


def hashed_bootstrap(rows: DataFrame, group: str, baseline: str, candidate: str, samples: int = 2000) -> DataFrame:
    """One row (groups, mean_delta, low, high), rounded to six places, as ``group_bootstrap`` but with draws by digest, so that executors draw.

    The j-th draw of sample s is the group whose number, in the order of names, is the first 32 bits of md5("s|j") modulo their count.  No groups give no row.
    """
    spark = rows.sparkSession
    sums = rows.groupBy(F.col(group).cast("string").alias("g")).agg(F.sum(F.col(candidate) - F.col(baseline)).alias("d"), F.count("*").alias("n"))
    numbered = sums.withColumn("i", (F.row_number().over(Window.orderBy("g")) - 1).cast("long"))
    size = F.broadcast(sums.agg(F.count("*").alias("size"), (F.sum("d") / F.sum("n")).alias("mean")).filter("size > 0"))
    drawn = spark.range(samples).withColumnRenamed("id", "s").crossJoin(size).select("s", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("j"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "s", "j")), 1, 8), 16, 10).cast("long")
    means = drawn.select("s", F.pmod(number, F.col("size")).alias("i")).join(numbered, "i").groupBy("s").agg((F.sum("d") / F.sum("n")).alias("m"))
    ordered = means.agg(F.sort_array(F.collect_list("m")).alias("m"))
    at = lambda q: F.round(F.get("m", F.lit(int(q * (samples - 1)))), 6)
    return size.crossJoin(ordered).select(F.col("size").alias("groups"), F.round("mean", 6).alias("mean_delta"), at(0.025).alias("low"), at(0.975).alias("high"))
