"""From an argument to a checked remark: retrieval, packing, a drafting function, validation; all queries in one job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import quotes
from spanforge.operators import evidence, fusion, validation
from spanforge.plans import records as records_sql
from spanforge.plans import retrieval
from spanforge.plans.evaluation import _best, _map
from spanforge.plans.retrieval_sql import BASE

QUOTAS = {"cosine": 10, "bm25": 10}
WEIGHTS = {"cosine": 1.0, "bm25": 1.0, "model": 2.0}
LEAST_QUOTE = 20


def retrieve(b: retrieval.Base) -> tuple[DataFrame, DataFrame]:
    """Articles (query_id, item, rank) and the evidence pack (query_id, item, rank) of each query.

    Source rankings name up to twenty articles; two chunks of each are scored, which ranks the articles a third time; a
    weighted fusion of the three keeps ten, eight chunks of each are scored and packed under chunk and token budgets.
    """
    projected = fusion.project_articles(b.rankings(), b.bridge)
    first = fusion.source_quota(projected, QUOTAS)
    scores = retrieval._model(b)
    pool = evidence.candidate_pool(evidence.candidate_map(b.rankings(), list(QUOTAS), b.bridge, first, 2), first)
    reranked = evidence.best_chunks(scores.join(pool.select("query_id", "item"), ["query_id", "item"]), b.bridge, 1 << 30)
    model = reranked.select("query_id", F.lit("model").alias("source"), "rank", F.col("article").alias("item"))
    articles = fusion.fuse_candidates(projected.unionByName(model), first, WEIGHTS, k=30, limit=10).select("query_id", "item", "rank")
    wide = evidence.candidate_map(b.rankings(), list(QUOTAS), b.bridge, articles, 8).join(scores, ["query_id", "item"])
    order = articles.select("query_id", F.col("item").alias("article"), F.col("rank").alias("article_rank"))
    w = Window.partitionBy("query_id", "article").orderBy(F.desc("score"), "item")
    text = b.corpus.select("item", retrieval.token_cost(F.col("text")).alias("tokens"), F.transform("norm_ids", retrieval.ids.unit_key).alias("paths"))
    rows = wide.join(order, ["query_id", "article"]).withColumn("within", F.row_number().over(w)).join(text, "item")
    pack = evidence.adaptive_pack(rows.select("query_id", "article", "article_rank", "within", "item", "score", "tokens", "paths"), 20, 3000, 2, 0.25, 0.05)
    return articles, pack


def prompts(b: retrieval.Base, pack: DataFrame) -> DataFrame:
    """(query_id, prompt, spans): the argument and the evidence with labelled quotable spans, in the order of the pack."""
    rows = pack.join(b.corpus.select("item", "text", "norm_ids"), "item").withColumn("spans", quotes.quote_candidates(F.col("text")))
    line = F.format_string("[%s] %s", F.col("item"), F.array_join(F.transform("spans", lambda s: F.concat(F.lit("<"), s["span_id"], F.lit("> "), s["text"])), " "))
    shown = F.struct("rank", line.alias("line"), "item", "norm_ids", "spans")
    packed = rows.select("query_id", shown.alias("e")).groupBy("query_id").agg(F.sort_array(F.collect_list("e")).alias("evidence"))
    body = F.array_join(F.transform("evidence", lambda e: e["line"]), "\n")
    return b.asked.join(packed, "query_id").select("query_id", F.col("text").alias("argument"), F.concat_ws("\n\n", "text", body).alias("prompt"), "evidence")


def first_span_draft(rows: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a model: it quotes the first long span of the first chunk and the first long span of the argument."""
    out = []
    for argument, shown in zip(rows["argument"], rows["evidence"]):
        own = next((c for c in quotes.candidates(argument) if c[2] - c[1] >= LEAST_QUOTE), None)
        hit = next(((e, s) for e in shown for s in e["spans"] if s["char_end"] - s["char_start"] >= LEAST_QUOTE), None)
        if own is None or hit is None:
            out.append(("abstain", None, None, None, None))
        else:
            out.append(("remark", own[3], hit[0]["item"], hit[0]["norm_ids"][0], hit[1]["text"]))
    return pd.DataFrame(out, columns=["decision", "doc_quote", "chunk_id", "norm_id", "norm_quote"])


def refusal(argument: Column, chunk_text: Column, exposed: Column, norm_text: Column) -> Column:
    """The first rule that a draft breaks, or null."""
    return validation.first_refusal([
        ("model_abstained", F.col("decision") == "remark"),
        ("incomplete_remark", F.col("doc_quote").isNotNull() & F.col("norm_id").isNotNull() & F.col("norm_quote").isNotNull()),
        ("doc_quote_not_in_source", quotes.contains_quote(F.col("doc_quote"), argument)),
        ("norm_not_exposed", F.array_contains(exposed, F.col("norm_id"))),
        ("norm_quote_not_in_evidence", quotes.contains_quote(F.col("norm_quote"), chunk_text)),
        ("quote_too_short", F.length("norm_quote") >= LEAST_QUOTE),
        ("unknown_norm", norm_text.isNotNull()),
        ("norm_quote_not_in_unit", quotes.contains_quote(F.col("norm_quote"), norm_text)),
    ])


def grounded_pipeline(spark: SparkSession, d: str, draft=first_span_draft) -> DataFrame:
    """(query_id, status, reason, chunk_id, norm_id, doc_quote, norm_quote): a remark whose quotes are checked, or the reason for none."""
    from spanforge.plans.records import units

    b = retrieval.base(spark, d)
    _, pack = retrieve(b)
    asked = prompts(b, pack)
    query_type = asked.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([batch[["query_id"]].reset_index(drop=True), draft(batch)], axis=1)

    drafts = asked.mapInPandas(run, f"query_id {query_type}, decision string, doc_quote string, chunk_id string, norm_id string, norm_quote string")
    chunk = b.corpus.select(F.col("item").alias("chunk_id"), F.col("text").alias("chunk_text"), F.col("norm_ids").alias("exposed"))
    norms = units(spark, d).select("norm_id", F.col("text").alias("norm_text"))
    rows = drafts.join(b.asked.select("query_id", F.col("text").alias("argument")), "query_id").join(chunk, "chunk_id", "left").join(norms, "norm_id", "left")
    checked = rows.withColumn("reason", refusal(F.col("argument"), F.col("chunk_text"), F.col("exposed"), F.col("norm_text")))
    status = F.when(F.col("reason").isNull(), "remark").otherwise("insufficient_evidence")
    return checked.select("query_id", status.alias("status"), "reason", "chunk_id", "norm_id", "doc_quote", "norm_quote")


def retrieval_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many queries still hold a gold article after each stage."""
    b = retrieval.base(spark, d)
    articles, pack = retrieve(b)
    projected = fusion.project_articles(b.rankings(), b.bridge).select("query_id", "item")
    stages = {"1 candidates": projected, "2 shortlist": articles.select("query_id", "item"), "3 pack": pack.join(b.bridge, "item").select("query_id", F.col("article").alias("item"))}
    wanted = b.gold.select("query_id", F.col("article").alias("item")).distinct()
    out = None
    for name, rows in stages.items():
        hit = wanted.join(rows.distinct(), ["query_id", "item"], "left_semi").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("articles"))
        one = hit.select(F.lit(name).alias("stage"), "queries", "articles")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"grounded_pipeline": grounded_pipeline, "retrieval_funnel": retrieval_funnel}

_WHITE = records_sql.SPACE


def _folded(column: str) -> str:
    """``quotes.contains_quote``'s folding in SQL."""
    return f"trim(regexp_replace(translate({column}, '«»“”„‟‘’' || chr(700) || '`‐‑‒–—−', repeat(chr(34), 6) || repeat(chr(39), 4) || '------'), '[{_WHITE}]+', ' ', 'g'))"



def _first_span(rows: str, key: str, text: str) -> str:
    """The first quotable span of twenty characters or more of each text: the words that fit into 200 characters of a line without its marks."""
    body = f"regexp_replace(regexp_replace(line, '^[{_WHITE}#>*•·–—|-]+', ''), '[{_WHITE}|*]+$', '')"
    return f"""(SELECT {key}, arg_min(span, n) AS span FROM (SELECT {key}, n, regexp_replace(regexp_extract({body}, '^(.{{1,200}})(?:[{_WHITE}]|$)', 1), '[{_WHITE}]+$', '') AS span
        FROM (SELECT {key}, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT {key}, string_split({text}, chr(10)) AS l FROM {rows}))) WHERE length(span) >= {LEAST_QUOTE} GROUP BY {key})"""


_MODEL = """s2 AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY src, rank) AS rank FROM (SELECT query_id, item, src, rank, row_number() OVER (PARTITION BY query_id, item ORDER BY src, rank) AS n FROM (
    SELECT query_id, item, rank, CASE source WHEN 'cosine' THEN 0 ELSE 1 END AS src FROM pj WHERE rank <= 10)) WHERE n = 1)"""
_ARTICLES = """mr AS (SELECT query_id, article AS item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article, item) AS rank FROM b1),
    fa AS (SELECT query_id, item, rank FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b, item) AS rank FROM (SELECT query_id, item, round(sum(w / (30 + rank)), 9) AS score, min(rank) AS b FROM (
        SELECT query_id, item, rank, 1.0::DOUBLE AS w FROM pj UNION ALL SELECT query_id, item, rank, 2.0::DOUBLE FROM mr) JOIN (SELECT query_id, item FROM s2) USING (query_id, item) GROUP BY query_id, item)) WHERE rank <= 10)"""

# The first chunk of a pack is the best one of the first article, so that the stand-in's draft needs no further packing; a chunk without a long span would be passed over
# (the project's chunks have one).
SQL = {
    "grounded_pipeline": BASE + f""", nu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm_id ORDER BY loaded_at DESC) AS rn FROM norm_units) WHERE rn = 1),
        {_MODEL}, {_map("s2", "k2", 2)}, {_best("k2", "s2", "b1")}, {_ARTICLES}, {_map("fa", "k8", 8)},
        le AS (SELECT query_id, item FROM (SELECT k8.query_id, k8.item, row_number() OVER (PARTITION BY k8.query_id ORDER BY fa.rank, md.score DESC, k8.item) AS n FROM k8 JOIN fa ON fa.query_id = k8.query_id AND fa.item = k8.article JOIN md ON md.query_id = k8.query_id AND md.item = k8.item) WHERE n = 1),
        dq AS {_first_span("q", "query_id", "txt")}, nq AS {_first_span("c", "item", "txt")},
        dr AS (SELECT le.query_id, le.item AS chunk_id, c.norm_ids[1] AS norm_id, dq.span AS doc_quote, nq.span AS norm_quote, nu.text AS norm_text, q.txt AS argument FROM le JOIN q USING (query_id) JOIN c USING (item) JOIN dq USING (query_id) JOIN nq USING (item) LEFT JOIN nu ON nu.norm_id = c.norm_ids[1]),
        rs AS (SELECT *, CASE WHEN norm_text IS NULL THEN 'unknown_norm' WHEN NOT contains({_folded("norm_text")}, {_folded("norm_quote")}) THEN 'norm_quote_not_in_unit' END AS reason FROM dr)
        SELECT query_id, CASE WHEN reason IS NULL THEN 'remark' ELSE 'insufficient_evidence' END AS status, reason, chunk_id, norm_id, doc_quote, norm_quote FROM rs"""
}
# Each of the ten articles has its first chunk in the pack, so that the articles of a pack are those with a candidate.
SQL["retrieval_funnel"] = SQL["grounded_pipeline"].split("le AS (")[0] + "z AS (" + " UNION ALL ".join(
    f"SELECT '{stage}' AS stage, query_id, article FROM ga WHERE (query_id, article) IN (SELECT query_id, {column} FROM {rows})" for stage, column, rows in (("1 candidates", "item", "pj"), ("2 shortlist", "item", "fa"), ("3 pack", "article", "k8"))
) + ") SELECT stage, count(DISTINCT query_id) AS queries, count(article) AS articles FROM (SELECT unnest(['1 candidates', '2 shortlist', '3 pack']) AS stage) LEFT JOIN z USING (stage) GROUP BY stage"
