"""Queries of the evaluation operators over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import ids
from spanforge.functions.latest import latest
from spanforge.operators import evaluation, evidence, fusion, metrics
from spanforge.plans.retrieval import Base, _articles, _candidates, _labelled, _model, base
from spanforge.plans.retrieval_sql import _LABELLED, BASE
from spanforge.session import table


def _projected(b: Base) -> DataFrame:
    return b.projected


def article_evidence(s, d):
    b = base(s, d)
    return evaluation.article_evidence(_model(b), b.bridge)


def best_chunks_once(s, d):
    b = base(s, d)
    return evaluation.best_chunks_once(_model(b), b.bridge)


def best_chunks_in_order(s, d):
    b = base(s, d)
    return evaluation.best_chunks_in_order(_model(b), b.bridge, _candidates(b)[0])


def _two_pass(s, d):
    b = base(s, d)
    return evaluation.two_pass(b.rankings(), ["cosine", "bm25"], b.bridge, _candidates(b)[0], _model(b), 2, 6, 8, 5)


def two_pass_shortlist(s, d):
    return _two_pass(s, d)[0]


def two_pass_rerank(s, d):
    return _two_pass(s, d)[1]


def two_pass_scored(s, d):
    return _two_pass(s, d)[2].groupBy("query_id").agg(F.count("*").alias("pairs"))


def article_chunk_fusion(s, d):
    b = base(s, d)
    return evaluation.article_chunk_fusion(b.rankings(), b.bridge, _articles(b))


def evidence_scores(s, d):
    b = base(s, d)
    return evaluation.evidence_scores(evaluation.article_chunk_fusion(b.rankings(), b.bridge, _articles(b)), _model(b))


def union_at_k(s, d):
    b = base(s, d)
    return evaluation.union_at_k(b.cosine(), b.bm25(), 10)


def chunks_of_articles(s, d):
    b = base(s, d)
    return evaluation.chunks_of_articles(b.bridge, _projected(b).filter("source = 'bm25' and rank <= 3"))


def _overridden(s, d):
    rows = _labelled(s, d)
    mapping = metrics.label_mapping(rows)
    own = mapping.filter("label < 'm'").select("label", "norm_id", (11 - F.col("rank")).alias("rank"))
    return rows, evaluation.overlay(mapping, own, 3)


def overlay_mapping(s, d):
    """The label table with the labels before "m" replaced by their own ids in reverse."""
    return _overridden(s, d)[1]


def label_predictions(s, d):
    rows, mapping = _overridden(s, d)
    return evaluation.predicted(rows, mapping, 3)


def prediction_breakdown(s, d):
    """Recall of what a label table of all other groups predicts, by label."""
    rows = _labelled(s, d)
    with_article = lambda df: df.withColumn("article", F.regexp_extract("norm_id", r"^([^:]*:art\.[^:]*)", 1))
    known = rows.filter("label is not null and label not in ('other', 'unclear')")
    scores = evaluation.prediction_scores(with_article(known), with_article(metrics.leave_group_out(rows, 5)))
    return evaluation.breakdown(scores.join(known.select("case_id", "label").distinct(), "case_id"), "label")


def first_loss(s, d):
    b = base(s, d)
    p = _projected(b)
    named = lambda df: df.select("query_id", F.col("item").alias("article"))
    stages = [("retrieval", named(p)), ("shortlist", named(_candidates(b)[0])), ("fusion", named(_articles(b))), ("rerank", evidence.best_chunks(_model(b), b.bridge, 10).select("query_id", "article"))]
    return evaluation.first_loss(b.gold, stages)


def oracle_breakdown(s, d):
    b = base(s, d)
    units = b.corpus.select("item", F.explode(F.array_distinct(F.transform("norm_ids", ids.unit_key))).alias("norm_id"))
    articles, candidates = _candidates(b)
    final = evidence.best_chunks(_model(b), b.bridge, 10)
    of = lambda df: df.select("query_id", "item").distinct().join(units, "item").select("query_id", "norm_id")
    return evaluation.oracle_breakdown(b.gold, units, articles.select("query_id", F.col("item").alias("article")), of(candidates), of(final))


def _outcomes(b: Base) -> DataFrame:
    return evaluation.paired_outcomes(b.retrieved(b.bm25(10)), b.retrieved(b.cosine(10)), b.gold)


def paired_outcomes(s, d):
    return _outcomes(base(s, d))


def outcomes_by_topic(s, d):
    b = base(s, d)
    rows = _outcomes(b).join(b.asked.select("query_id", F.coalesce("topic", F.lit("")).alias("topic")), "query_id")
    return rows.groupBy("topic").agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("gain", "loss", "tie")), F.round(F.avg("delta"), 6).alias("mean_delta"))


def wrong_routes(s, d):
    b = base(s, d)
    return evaluation.wrong_routes(b.gold, b.retrieved(b.bm25(10)))


def outside_share(s, d):
    b = base(s, d)
    law = F.regexp_extract(F.get("norm_ids", F.lit(0)), "^([^:]*)", 1)
    packed = b.bm25(10).select("query_id", "item").join(b.corpus.select("item", law.alias("law"), "char_start", "char_end"), "item")
    newest = b.corpus.select(F.explode("norm_ids").alias("n")).groupBy(F.regexp_extract("n", "^([^:]*)", 1).alias("law")).agg(F.max(F.regexp_extract("n", "^[^:]*:([^:]*)", 1)).alias("edition"))
    units = latest(table(s, d, "norm_units"), ["norm_id"], "loaded_at", ["char_start", "char_end"])
    units = units.select(F.regexp_extract("norm_id", "^([^:]*)", 1).alias("law"), F.regexp_extract("norm_id", "^[^:]*:([^:]*)", 1).alias("edition"), ids.article_key(F.col("norm_id")).alias("article"), "char_start", "char_end")
    whole = units.join(newest, ["law", "edition"]).groupBy("law", "article").agg(F.min("char_start").alias("start"), F.max("char_end").alias("end"))
    chosen = _articles(b).filter("rank <= 5").select("query_id", F.col("item").alias("article")).join(whole, "article")
    return evaluation.outside_share(packed, chosen)


def score_quality(s, d):
    b = base(s, d)
    return evaluation.score_quality(_model(b), b.cosine().select("query_id", "item", "score"))


def stage_recall(s, d):
    """Mean article recall after each stage of the retrieval."""
    b = base(s, d)
    named = lambda df: df.select("query_id", F.col("item").alias("article"))
    stages = {"1 retrieved": named(_projected(b)), "2 shortlist": named(_candidates(b)[0]), "3 fused": named(_articles(b)), "4 reranked": evidence.best_chunks(_model(b), b.bridge, 10).select("query_id", "article")}
    out = None
    for name, rows in stages.items():
        share = b.gold.select("query_id", "article").distinct().join(rows.distinct().withColumn("_hit", F.lit(1)), ["query_id", "article"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("r"))
        one = share.agg(F.round(F.avg("r"), 6).alias("article")).select(F.lit(name).alias("stage"), "article")
        out = one if out is None else out.unionByName(one)
    return out


def gold_coverage(s, d):
    """Per status of the gold ids in the corpus: how many, and the shortest chunk that has one as it is."""
    b = base(s, d)
    units = b.corpus.select(F.length("text").alias("chars"), F.explode("norm_ids").alias("n")).select("chars", ids.unit_key(F.col("n")).alias("norm_id"))
    status = metrics.gold_status(b.cases.select(F.explode("gold_norms").alias("n")).select(ids.unit_key(F.col("n")).alias("norm_id")), units)
    return status.join(units.groupBy("norm_id").agg(F.min("chars").alias("chars")), "norm_id", "left").groupBy("status").agg(F.count("*").alias("golds"), F.min("chars").alias("shortest"))


_GRID = [(k, b, c) for k in (10, 30, 60) for b, c in ((1.0, 1.0), (2.0, 1.0), (1.0, 2.0))]


def fusion_grid(s, d):
    """Article recall of nine settings of the weighted fusion."""
    b = base(s, d)
    rows = [(f"k{k} {w:g}:{c:g}", source, k, x) for k, w, c in _GRID for source, x in (("bm25", w), ("cosine", c))]
    grid = s.createDataFrame(rows, "spec string, source string, k int, weight double")
    return evaluation.grid_recall(b.gold, evaluation.fusion_grid(_projected(b), grid))


def pack_flags(s, d):
    from spanforge.plans.retrieval import evidence_pack

    b = base(s, d)
    return evaluation.pack_flags(b.gold, b.retrieved(evidence_pack(s, d)))


def rank_histogram(s, d):
    b = base(s, d)
    return metrics.best_rank(b.gold, b.retrieved(b.bm25(100)), "norm_id").groupBy("bucket").agg(F.count("*").alias("cases"))


QUERIES = {
    f.__name__: f
    for f in (
        article_evidence, best_chunks_once, best_chunks_in_order, two_pass_shortlist, two_pass_rerank, two_pass_scored, article_chunk_fusion, evidence_scores, union_at_k, chunks_of_articles, overlay_mapping,
        label_predictions, prediction_breakdown, first_loss, oracle_breakdown, paired_outcomes, outcomes_by_topic, wrong_routes, outside_share, score_quality, stage_recall, gold_coverage, fusion_grid, pack_flags, rank_histogram,
    )
}

_ONE = "bo AS (SELECT query_id, article, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY score DESC, item) AS n FROM md JOIN ca USING (item)) WHERE n = 1)"
_ONCE = "SELECT query_id, item, rank FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY {0}) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item ORDER BY {0}) AS k FROM {1}) WHERE k = 1)"


def _map(articles: str, name: str, per: int) -> str:
    return f"""{name} AS (SELECT query_id, article, item, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY rank, src, item) AS place FROM (
       SELECT query_id, article, item, rank, src FROM (SELECT query_id, article, item, rank, src, row_number() OVER (PARTITION BY query_id, article, item ORDER BY rank, src) AS n
       FROM (SELECT query_id, item, rank, CASE source WHEN 'cosine' THEN 1 ELSE 2 END AS src FROM rk) JOIN ca USING (item)
       WHERE (query_id, article) IN (SELECT query_id, item FROM {articles})) WHERE n = 1)) WHERE place <= {per})"""


def _best(pool: str, articles: str, name: str) -> str:
    return f"{name} AS (SELECT query_id, article, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY score DESC, item) AS n FROM md JOIN ca USING (item) WHERE (query_id, item) IN (SELECT query_id, item FROM {pool}) AND (query_id, article) IN (SELECT query_id, item FROM {articles})) WHERE n = 1)"


_TWO = f"""{_best("cm", "sq", "b1")}, sh AS (SELECT query_id, article AS item, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article) AS rank FROM b1) WHERE rank <= 6),
    {_map("sh", "c2", 8)}, {_best("c2", "sh", "b2")}"""
_FUSED = """fu AS (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY score DESC, item) AS rank FROM (
    SELECT query_id, article, item, round(sum(1.0::DOUBLE / (30 + rank)), 9) AS score FROM rk JOIN ca USING (item) WHERE (query_id, article) IN (SELECT query_id, item FROM ar WHERE rank <= 10) GROUP BY ALL))"""
_MAPPED = f"""{_LABELLED}, lm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY groups DESC, cases DESC, norm_id) AS rank FROM (SELECT label, norm_id, count(DISTINCT group_id) AS groups, count(DISTINCT case_id) AS cases FROM lb GROUP BY label, norm_id)) WHERE rank <= 10),
    om AS (SELECT label, norm_id, rank FROM lm WHERE label >= 'm' AND rank <= 3 UNION ALL SELECT label, norm_id, rank FROM (SELECT label, norm_id, row_number() OVER (PARTITION BY label ORDER BY rank DESC) AS rank FROM lm WHERE label < 'm') WHERE rank <= 3)"""
_PAIRED = """po2 AS (SELECT query_id, round(avg(c - b), 6) AS delta, coalesce(string_agg(article, '|' ORDER BY article) FILTER (WHERE c > b), '') AS gained, coalesce(string_agg(article, '|' ORDER BY article) FILTER (WHERE b > c), '') AS lost FROM (
    SELECT query_id, article, CAST((query_id, article) IN (SELECT query_id, article FROM rb WHERE rank <= 10) AS INT) AS b, CAST((query_id, article) IN (SELECT query_id, article FROM rc WHERE rank <= 10) AS INT) AS c FROM ga) GROUP BY query_id),
    oc AS (SELECT *, CASE WHEN delta > 0 THEN 'gain' WHEN delta < 0 THEN 'loss' ELSE 'tie' END AS outcome FROM po2)"""
_STAGES = (("pj", "1 retrieved", "item", ""), ("sq", "2 shortlist", "item", ""), ("ar", "3 fused", "item", " WHERE rank <= 10"), ("bc", "4 reranked", "article", " WHERE rank <= 10"))
_HAS = "(query_id, article) IN (SELECT query_id, {2} FROM {0}{3})"

SQL = {
    # Every chunk of the project's table lies in one article, so that an article's cap is a rank within it.
    "evidence_pack": BASE + f""", {_map("sq", "c8", 8)}, pk AS (SELECT c8.query_id, c8.article, c8.item, sq.rank AS ar, score, row_number() OVER (PARTITION BY c8.query_id, c8.article ORDER BY score DESC, c8.item) AS within, dense_rank() OVER (PARTITION BY c8.query_id ORDER BY sq.rank) AS dr
        FROM c8 JOIN md ON md.query_id = c8.query_id AND md.item = c8.item JOIN sq ON sq.query_id = c8.query_id AND sq.item = c8.article),
        ld AS (SELECT query_id, item, 0 AS part, row_number() OVER (PARTITION BY query_id ORDER BY ar) AS n FROM pk WHERE within = 1 AND dr <= 5),
        rs AS (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY score DESC, ar, within, item) AS k FROM pk WHERE NOT (within = 1 AND dr <= 5)),
        mo AS (SELECT query_id, item, 1 AS part, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ar, within, item) AS n FROM rs WHERE k <= CASE WHEN dr <= 5 THEN 1 ELSE 2 END)
        SELECT query_id, item, rank FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY part, n) AS rank FROM (SELECT * FROM ld UNION ALL SELECT * FROM mo)) WHERE rank <= 10""",
    "fusion_grid": BASE + ", g AS (SELECT * FROM (VALUES " + ", ".join(f"('k{k} {w:g}:{c:g}', {k}, {w}::DOUBLE, {c}::DOUBLE)" for k, w, c in _GRID) + """) t(spec, k, wb, wc)),
        f AS (SELECT spec, query_id, item, round(sum(CASE source WHEN 'bm25' THEN wb ELSE wc END / (k + rank)), 9) AS score, min(rank) AS b FROM pj, g GROUP BY ALL),
        r AS (SELECT spec, query_id, item FROM (SELECT *, row_number() OVER (PARTITION BY spec, query_id ORDER BY score DESC, b, item) AS rank FROM f) WHERE rank <= 10),
        p AS (SELECT spec, query_id, avg(CAST((spec, query_id, article) IN (SELECT * FROM r) AS INT)) AS r FROM g, ga GROUP BY spec, query_id)
        SELECT spec, count(*) AS cases, round(avg(r), 6) AS article, round(avg(CAST(r = 1 AS INT)), 6) AS all_hit FROM p GROUP BY spec""",
    "rank_histogram": BASE + """SELECT CASE WHEN best <= 10 THEN '<=10' WHEN best <= 20 THEN '11-20' WHEN best <= 50 THEN '21-50' WHEN best <= 100 THEN '51-100' ELSE '>100' END AS bucket, count(*) AS cases
        FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN (SELECT query_id, min(rank) AS best FROM rb JOIN gold USING (query_id, norm_id) GROUP BY query_id) USING (query_id) GROUP BY 1""",
    "article_evidence": BASE + f", {_ONE} SELECT * FROM (SELECT query_id, article, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item, article) AS rank FROM bo) WHERE rank <= 10",
    "best_chunks_once": BASE + f", {_ONE}, z AS ({_ONCE.format('score DESC, article, item', 'bo')}) SELECT * FROM z WHERE rank <= 10",
    "best_chunks_in_order": BASE + f", {_ONE}, o AS (SELECT bo.query_id, bo.item, sq.rank AS place FROM bo JOIN sq ON sq.query_id = bo.query_id AND sq.item = bo.article), z AS ({_ONCE.format("place", "o")}) SELECT * FROM z WHERE rank <= 10",
    "two_pass_shortlist": BASE + f", {_TWO} SELECT query_id, item, rank FROM sh",
    "two_pass_rerank": BASE + f", {_TWO}, z AS ({_ONCE.format('score DESC, article, item', 'b2')}) SELECT * FROM z WHERE rank <= 5",
    "two_pass_scored": BASE + f", {_TWO} SELECT query_id, count(*) AS pairs FROM (SELECT query_id, item FROM cm UNION SELECT query_id, item FROM c2) GROUP BY query_id",
    "article_chunk_fusion": BASE + f", {_FUSED} SELECT query_id, article, item, score, rank FROM fu",
    "evidence_scores": BASE + f", {_FUSED}, z AS (SELECT query_id, article, item, round(1.0::DOUBLE / fu.rank + coalesce(md.score, 0) * 0.001::DOUBLE, 9) AS score FROM fu LEFT JOIN md USING (query_id, item)) SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY score DESC, item) AS rank FROM z",
    "union_at_k": BASE + f", u AS (SELECT query_id, item, 0 AS part, rank AS place FROM cs WHERE rank <= 10 UNION ALL SELECT query_id, item, 1, rank FROM bm WHERE rank <= 10) {_ONCE.format("part, place", "u")}",
    "chunks_of_articles": BASE + ", z AS (SELECT DISTINCT pj.query_id, ca.item FROM pj JOIN ca ON ca.article = pj.item WHERE source = 'bm25' AND rank <= 3) SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY item) AS rank FROM z",
    "overlay_mapping": BASE + f", {_MAPPED} SELECT label, norm_id, rank FROM om",
    "label_predictions": BASE + f", {_MAPPED} SELECT case_id, norm_id, rank FROM (SELECT DISTINCT case_id, label FROM lb) JOIN om USING (label)",
    "prediction_breakdown": BASE + rf""", {_LABELLED}, h AS (SELECT DISTINCT group_id, label FROM lb), o AS (SELECT h.group_id, h.label, lb.norm_id, count(DISTINCT lb.group_id) AS g, count(DISTINCT lb.case_id) AS k FROM h JOIN lb ON lb.label = h.label AND lb.group_id <> h.group_id GROUP BY ALL),
        m AS (SELECT group_id, label, norm_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, label ORDER BY g DESC, k DESC, norm_id) AS rank FROM o) WHERE rank <= 5),
        p AS (SELECT DISTINCT case_id, m.norm_id, regexp_extract(m.norm_id, '^([^:]*:art\.[^:]*)', 1) AS article FROM (SELECT DISTINCT case_id, group_id, label FROM lb) JOIN m USING (group_id, label)),
        e AS (SELECT case_id, avg(CAST((case_id, norm_id) IN (SELECT case_id, norm_id FROM p) AS INT)) AS exact FROM (SELECT DISTINCT case_id, norm_id FROM lb) GROUP BY case_id),
        a AS (SELECT case_id, avg(CAST((case_id, article) IN (SELECT case_id, article FROM p) AS INT)) AS article FROM (SELECT DISTINCT case_id, regexp_extract(norm_id, '^([^:]*:art\.[^:]*)', 1) AS article FROM lb) GROUP BY case_id)
        SELECT label, count(*) AS n, round(avg(exact), 6) AS exact, round(avg(article), 6) AS article, CASE WHEN count(*) >= 5 THEN 'ok' ELSE 'few' END AS status FROM e JOIN a USING (case_id) JOIN (SELECT DISTINCT case_id, label FROM lb) USING (case_id) GROUP BY label""",
    "first_loss": BASE + "SELECT query_id, CASE " + " ".join(f"WHEN NOT bool_or({_HAS.format(*st)}) THEN '{n}'" for st, n in zip(_STAGES, ("retrieval", "shortlist", "fusion", "rerank"))) + " ELSE 'none' END AS loss FROM ga GROUP BY query_id",
    "oracle_breakdown": BASE + """, fi AS (SELECT query_id, norm_id FROM bc JOIN un USING (item) WHERE rank <= 10), cd AS (SELECT query_id, norm_id FROM cm JOIN un USING (item))
        SELECT CASE WHEN (query_id, norm_id) IN (SELECT * FROM fi) THEN 'hit' WHEN norm_id NOT IN (SELECT norm_id FROM un) THEN 'unavailable' WHEN (query_id, article) NOT IN (SELECT query_id, item FROM sq) THEN 'article_not_selected'
        WHEN (query_id, norm_id) NOT IN (SELECT * FROM cd) THEN 'candidate_miss' ELSE 'selection_miss' END AS reason, count(*) AS golds FROM gold GROUP BY 1""",
    "paired_outcomes": BASE + f", {_PAIRED} SELECT query_id, delta, gained, lost, outcome FROM oc",
    "outcomes_by_topic": BASE + f", {_PAIRED} SELECT topic, count_if(outcome = 'gain') AS gain, count_if(outcome = 'loss') AS loss, count_if(outcome = 'tie') AS tie, round(avg(delta), 6) AS mean_delta FROM oc JOIN q USING (query_id) GROUP BY topic",
    "wrong_routes": BASE + """, z AS (SELECT ga.article AS gold_article, f.article AS wrong_article, count(*) AS cases FROM ga JOIN (SELECT DISTINCT query_id, article FROM rb WHERE rank = 1) f USING (query_id) WHERE (query_id, f.article) NOT IN (SELECT * FROM ga) GROUP BY ALL)
        SELECT *, row_number() OVER (ORDER BY cases DESC, gold_article, wrong_article) AS rank FROM z ORDER BY rank LIMIT 20""",
    "outside_share": BASE + r""", nw AS (SELECT split_part(n, ':', 1) AS law, max(split_part(n, ':', 2)) AS ed FROM cn GROUP BY 1),
        wh AS (SELECT split_part(norm_id, ':', 1) AS law, split_part(norm_id, ':', 1) || ':' || regexp_extract(norm_id, ':(art\.\d+(?:\.\d+)?)(?:$|:)', 1) AS article, min(char_start) AS s, max(char_end) AS e FROM (SELECT norm_id, arg_max(char_start, loaded_at) AS char_start, arg_max(char_end, loaded_at) AS char_end FROM norm_units GROUP BY norm_id)
            JOIN nw ON nw.law = split_part(norm_id, ':', 1) AND nw.ed = split_part(norm_id, ':', 2) GROUP BY 1, 2),
        sp AS (SELECT query_id, law, s, e FROM ar JOIN wh ON wh.article = ar.item WHERE rank <= 5),
        pk AS (SELECT query_id, item, split_part(norm_ids[1], ':', 1) AS law, char_start AS cs_, char_end AS ce FROM bm JOIN c USING (item) WHERE rank <= 10 AND char_end > char_start),
        x AS (SELECT query_id, item, cs_, ce, greatest(cs_, s) AS a, least(ce, e) AS b FROM pk JOIN sp USING (query_id, law) WHERE greatest(cs_, s) < least(ce, e)),
        y AS (SELECT *, max(b) OVER (PARTITION BY query_id, item ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
        z AS (SELECT query_id, sum(greatest(0, b - greatest(a, coalesce(m, a)))) AS inside FROM y GROUP BY query_id)
        SELECT query_id, round(coalesce(greatest(0.0::DOUBLE, 1 - coalesce(inside, 0) / CAST(total AS DOUBLE)), 0.0), 4) AS outside FROM (SELECT DISTINCT query_id FROM bm) LEFT JOIN (SELECT query_id, sum(ce - cs_) AS total FROM pk GROUP BY query_id) USING (query_id) LEFT JOIN z USING (query_id)""",
    "score_quality": BASE + """, z AS (SELECT query_id, item, md.score AS a, cs.score AS b FROM md JOIN cs USING (query_id, item)),
        f AS (SELECT query_id, first(item ORDER BY a DESC, item) = first(item ORDER BY b DESC, item) AS same FROM z GROUP BY query_id)
        SELECT count(*) AS pairs, round(avg(abs(a - b)), 6) AS mean_gap, round(max(abs(a - b)), 6) AS greatest_gap, (SELECT round(avg(CAST(same AS INT)), 6) FROM f) AS first_agrees FROM z""",
    "stage_recall": BASE + " UNION ALL ".join(f"SELECT '{st[1]}' AS stage, round(avg(r), 6) AS article FROM (SELECT query_id, avg(CAST({_HAS.format(*st)} AS INT)) AS r FROM ga GROUP BY query_id)" for st in _STAGES),
    "gold_coverage": BASE + r""", w AS (SELECT DISTINCT regexp_replace(n, '^([^:]*):[^:]*', '\1') AS norm_id FROM (SELECT unnest(gold_norms) AS n FROM ec)), i AS (SELECT DISTINCT norm_id FROM un),
        st AS (SELECT w.norm_id, CASE WHEN bool_or(i.norm_id = w.norm_id) THEN 'exact' WHEN bool_or(starts_with(i.norm_id, w.norm_id || ':')) THEN 'descendant' WHEN bool_or(starts_with(w.norm_id, i.norm_id || ':')) THEN 'ancestor' ELSE 'absent' END AS status FROM w, i GROUP BY w.norm_id)
        SELECT status, count(*) AS golds, min(chars) AS shortest FROM st LEFT JOIN (SELECT norm_id, min(length(txt)) AS chars FROM un JOIN c USING (item) GROUP BY norm_id) USING (norm_id) GROUP BY status""",
}
SQL["pack_flags"] = SQL["evidence_pack"].replace("SELECT query_id, item, rank FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY part, n)", ", ep AS (SELECT query_id, item, rank FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY part, n)") + """),
        pu AS (SELECT query_id, norm_id, article FROM ep JOIN un USING (item))
        SELECT query_id, bool_or((query_id, norm_id) IN (SELECT query_id, norm_id FROM pu)) AS gold_in_pack, bool_or((query_id, article) IN (SELECT query_id, article FROM pu)) AS gold_article_in_pack FROM gold GROUP BY query_id"""
SQL["budget_pack"] = BASE.replace("WITH ec", "WITH RECURSIVE ec", 1) + f""", {_map("sq", "c8", 8)}, pk AS (SELECT c8.query_id, c8.article, c8.item, c8.place, sq.rank AS ar, length(c.txt) AS chars FROM c8 JOIN sq ON sq.query_id = c8.query_id AND sq.item = c8.article JOIN c ON c.item = c8.item),
        fs AS (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY place, item) AS k FROM pk),
        se AS (SELECT query_id, item, chars, row_number() OVER (PARTITION BY query_id ORDER BY part, a, item) AS n FROM (SELECT query_id, item, chars, 0 AS part, ar AS a FROM fs WHERE k = 1 UNION ALL SELECT query_id, item, chars, 1, place FROM pk)),
        st AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS n, CAST(4000 AS BIGINT) AS room, CAST([] AS VARCHAR[]) AS items FROM pk
            UNION ALL SELECT st.query_id, se.n, CASE WHEN ok THEN room - chars ELSE room END, CASE WHEN ok THEN list_append(items, item) ELSE items END FROM st JOIN se ON se.query_id = st.query_id AND se.n = st.n + 1, LATERAL (SELECT NOT list_contains(items, item) AND chars <= room AS ok)),
        en AS (SELECT query_id, arg_max(items, n) AS items FROM st GROUP BY query_id)
        SELECT query_id, unnest(items) AS item, generate_subscripts(items, 1) AS rank FROM en"""
SQL["adaptive_pack"] = BASE.replace("WITH ec", "WITH RECURSIVE ec", 1) + rf""", {_map("sq", "c8", 8)}, pk AS (SELECT c8.query_id, c8.article, c8.item, sq.rank AS ar, score, greatest(1, CAST(ceil(length(c.txt) / 3.0) AS BIGINT)) AS tokens, row_number() OVER w AS within, first_value(score) OVER w AS lead_score,
        list_transform(norm_ids, lambda n: c8.article || '|' || regexp_replace(n, '^([^:]*):[^:]*', '\1')) AS paths FROM c8 JOIN md ON md.query_id = c8.query_id AND md.item = c8.item JOIN sq ON sq.query_id = c8.query_id AND sq.item = c8.article JOIN c ON c.item = c8.item
        WINDOW w AS (PARTITION BY c8.query_id, c8.article ORDER BY score DESC, c8.item)),
        st AS (SELECT query_id, list(item ORDER BY ar) AS items, list(article ORDER BY ar) AS arts, flatten(list(paths)) AS known, CAST(sum(tokens) AS BIGINT) AS used FROM pk WHERE within = 1 GROUP BY query_id
            UNION ALL SELECT query_id, list_append(items, item), list_append(arts, article), list_concat(known, paths), used + tokens FROM (
                SELECT st.*, pk.item, pk.article, pk.paths, pk.tokens, row_number() OVER (PARTITION BY st.query_id ORDER BY score + CASE WHEN list_has_all(known, paths) THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END DESC, ar, within, item) AS k FROM st JOIN pk ON pk.query_id = st.query_id
                WHERE within > 1 AND len(items) < 20 AND NOT list_contains(items, item) AND len(list_filter(arts, lambda x: x = article)) < 2 AND score >= greatest(lead_score, 0.000000001) * 0.25::DOUBLE AND used + tokens <= 3000) WHERE k = 1),
        en AS (SELECT query_id, arg_max(items, len(items)) AS items FROM st GROUP BY query_id)
        SELECT query_id, unnest(items) AS item, generate_subscripts(items, 1) AS rank FROM en"""
_ALIKE = "len(list_intersect({0}, {1})) / CAST(greatest(1, len({0}) + len({1}) - len(list_intersect({0}, {1}))) AS DOUBLE)"
SQL["diverse_selection"] = BASE.replace("WITH ec", "WITH RECURSIVE ec", 1) + f""", {_map("sq", "c8", 8)}, p0 AS (SELECT DISTINCT query_id, item, score, r AS words, list_distinct(norm_ids) AS norms FROM c8 JOIN md USING (query_id, item) JOIN ws USING (item) JOIN c USING (item)),
        pk AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0::DOUBLE END AS value FROM p0 WINDOW w AS (PARTITION BY query_id)),
        st AS (SELECT DISTINCT query_id, CAST([] AS VARCHAR[]) AS items, CAST([] AS VARCHAR[][]) AS ww, CAST([] AS VARCHAR[][]) AS nn FROM pk
            UNION ALL SELECT query_id, list_append(items, item), list_append(ww, words), list_append(nn, norms) FROM (
                SELECT st.*, pk.item, pk.words, pk.norms, row_number() OVER (PARTITION BY st.query_id ORDER BY 0.5::DOUBLE * value + 0.5::DOUBLE * (1 - coalesce(list_max(list_transform(range(1, len(items) + 1), lambda i: greatest({_ALIKE.format("words", "ww[i]")}, {_ALIKE.format("norms", "nn[i]")}))), 0.0::DOUBLE)) DESC, pk.item) AS k
                FROM st JOIN pk ON pk.query_id = st.query_id WHERE len(items) < 10 AND NOT list_contains(items, pk.item)) WHERE k = 1),
        en AS (SELECT query_id, arg_max(items, len(items)) AS items FROM st GROUP BY query_id)
        SELECT query_id, unnest(items) AS item, generate_subscripts(items, 1) AS rank FROM en"""
