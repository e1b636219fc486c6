"""Exact dense ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.lexical import top_k


def dense_search(corpus: DataFrame, key: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, block: int = 2000) -> DataFrame:
    """(query_id, key, score, rank): the k nearest vectors by cosine (six places), ties by key.

    The query set is broadcast in blocks of at most ``block`` vectors, whatever its size, and the corpus is read once; each batch of it is one
    matrix product with each block and hands on only its own k best for each query, so that the shuffle holds k rows a query and batch.
    Null vectors are left out, zero vectors score 0; k of 0 or less gives no rows.
    """
    key_type, query_type = corpus.schema[key].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v")).filter("v is not null")
    n = asked.count()
    blocks = max(1, -(-n // block))
    rows = corpus.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter("vector is not null")
    shared = []
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        got = part.toPandas()
        if got.empty:
            continue
        matrix = np.stack([np.asarray(v, dtype=float) for v in got["v"]])
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        shared.append(corpus.sparkSession.sparkContext.broadcast((got["q"].tolist(), matrix)))
    if not shared or k <= 0:
        return corpus.sparkSession.createDataFrame([], f"query_id {query_type}, {key} {key_type}, score double, rank int")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            batch = batch.sort_values("key", kind="stable")
            own = np.stack([np.asarray(v, dtype=float) for v in batch["vector"]])
            own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
            keys = batch["key"].to_numpy()
            for block_ in shared:
                # Of several blocks of queries, a worker holds one at a time; they lie on its disk.
                ids, asked_ = block_.value if len(shared) == 1 else block_.load_from_path(block_._path)
                scores = np.round(asked_ @ own.T, 6) + 0.0
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(np.array(ids, dtype=object), order.shape[1]), "key": keys[order].ravel(), "score": np.take_along_axis(scores, order, axis=1).ravel()})

    out = rows.mapInPandas(best, f"query_id {query_type}, key {key_type}, score double")
    return top_k(out, k, F.desc("score"), F.col("key")).withColumnRenamed("key", key)
