"""Vectors and scores kept between runs: valid for one corpus and model, repaired row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.text import dot, l2_normalized


def corpus_fingerprint(chunks: DataFrame, key: str, text: str, buckets: int = 1024, position: str | None = None) -> DataFrame:
    """One row with the ``fingerprint`` of a corpus: it changes with any id or text and, where ``position`` names a chunk's place, with the order.

    Chunks are digested where they are, the digests of a bucket then in the order of their ids, and the buckets at last,
    so that no task and no string ever holds the corpus.
    """
    place = F.concat(F.coalesce(F.col(position).cast("string"), F.lit("")), F.lit("\0")) if position else F.lit("")
    own = chunks.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("b"), F.sha2(F.concat(place, F.col(key).cast("string"), F.lit("\0"), F.coalesce(F.col(text), F.lit("\1"))), 256).alias("d"))
    part = own.groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"))
    return part.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("fingerprint"))


def valid(cache: DataFrame, fingerprint: DataFrame, model: str) -> DataFrame:
    """The rows of a cache that were made by ``model`` for the corpus of this fingerprint."""
    return cache.filter(F.col("model") == model).join(F.broadcast(fingerprint), "fingerprint", "left_semi")


def missing_pairs(wanted: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, item) that have no score yet."""
    return wanted.select("query_id", "item").distinct().join(scores.select("query_id", "item"), ["query_id", "item"], "left_anti")


def merged_vectors(chunks: DataFrame, key: str, text: str, old: DataFrame, fresh: DataFrame) -> DataFrame:
    """(key, vector, is_new): each chunk's vector, by its text, from the old cache or else from the fresh one.

    ``old`` and ``fresh`` are (text, vector); a chunk that neither has is an error, as it would be ranked nowhere.
    """
    known = old.select(F.sha2(text, 256).alias("_t"), F.col("vector").alias("_old")).dropDuplicates(["_t"])
    new = fresh.select(F.sha2(text, 256).alias("_t"), F.col("vector").alias("_new")).dropDuplicates(["_t"])
    rows = chunks.select(key, F.sha2(text, 256).alias("_t")).join(known, "_t", "left").join(new, "_t", "left")
    vector = F.coalesce("_old", "_new", F.raise_error(F.concat(F.lit("no vector for "), F.col(key).cast("string"))))
    return rows.select(key, vector.alias("vector"), F.col("_old").isNull().alias("is_new"))


def drift(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, cosine) of the vectors that two caches hold under one key."""
    both = old.select(key, F.col("vector").alias("a")).join(new.select(key, F.col("vector").alias("b")), key)
    return both.select(key, F.round(dot(l2_normalized(F.col("a")), l2_normalized(F.col("b"))), 6).alias("cosine"))


def renumbered(scores: DataFrame, ids: DataFrame) -> DataFrame:
    """Scores under new item ids (item, new_item); rows without a new id are dropped with their items."""
    return scores.join(ids, "item").drop("item").withColumnRenamed("new_item", "item")


def truncated_share(lengths: Column, most: int) -> Column:
    """The share of texts longer than a model takes: an aggregate."""
    return F.avg(F.when(lengths > most, 1.0).otherwise(0.0))


def latency(rows: DataFrame, by: list[str], milliseconds: str) -> DataFrame:
    """Median, 95th percentile (linear between ranks) and throughput of runs."""
    return rows.groupBy(*by).agg(F.percentile(milliseconds, 0.5).alias("p50"), F.percentile(milliseconds, 0.95).alias("p95"), F.round(F.count("*") / F.sum(milliseconds) * 1000, 6).alias("per_second"))


def latency_ratio(rows: DataFrame, baseline: str, candidate: str, samples: int = 2000) -> DataFrame:
    """One row (runs, ratio, low, high), to six places: the ratio of two runtimes' sums over paired runs, and its interval when runs are drawn again by digest.

    The j-th draw of sample s is the run whose number, in the order of its (baseline, candidate), is the first 32 bits of md5("s|j") modulo the runs.
    """
    numbered = rows.select(F.col(baseline).alias("b"), F.col(candidate).alias("c")).withColumn("i", (F.row_number().over(Window.orderBy("b", "c")) - 1).cast("long"))
    size = F.broadcast(numbered.agg(F.count("*").alias("runs"), (F.sum("c") / F.sum("b")).alias("ratio")).filter("runs > 0"))
    drawn = rows.sparkSession.range(samples).crossJoin(size).select("id", "runs", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("j"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "id", "j")), 1, 8), 16, 10).cast("long")
    ratios = drawn.select("id", F.pmod(number, F.col("runs")).alias("i")).join(numbered, "i").groupBy("id").agg((F.sum("c") / F.sum("b")).alias("r"))
    at = lambda q: F.round(F.get("r", F.lit(int(q * (samples - 1)))), 6)
    return size.crossJoin(ratios.agg(F.sort_array(F.collect_list("r")).alias("r"))).select("runs", F.round("ratio", 6).alias("ratio"), at(0.025).alias("low"), at(0.975).alias("high"))


def token_parity(left: DataFrame, right: DataFrame, key: str, tokens: str) -> DataFrame:
    """One row (texts, equal): how many texts two tokenizers cut into the same sequence; a text that one side lacks is unequal."""
    both = left.select(key, F.col(tokens).alias("a")).join(right.select(key, F.col(tokens).alias("b")), key, "full")
    return both.agg(F.count("*").alias("texts"), F.count_if(F.col("a") == F.col("b")).alias("equal"))
