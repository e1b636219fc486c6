"""The retrieval queries in SQL."""

BASE = r"""
WITH ec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loaded_at DESC) AS rn FROM eval_cases) WHERE rn = 1),
q AS (SELECT case_id AS query_id, complaint_argument_blind AS txt, gold_norms, coalesce(topic, '') AS topic, regexp_replace(lower(split), '\s', '', 'g') AS split
      FROM ec WHERE CAST(regexp_extract(case_id, '(\d+)$', 1) AS BIGINT) % 50 = 0 AND complaint_argument_blind IS NOT NULL),
c AS (SELECT chunk_id AS item, any_value(text) AS txt, any_value(norm_ids) AS norm_ids, any_value(char_start) AS char_start, any_value(char_end) AS char_end FROM chunks GROUP BY chunk_id),
cn AS (SELECT item, unnest(norm_ids) AS n FROM c),
un AS (SELECT DISTINCT item, regexp_replace(n, '^([^:]*):[^:]*', '\1') AS norm_id, regexp_extract(n, '^([^:]*)', 1) || ':' || regexp_extract(n, ':(art\.\d+(?:\.\d+)?)(?:$|:)', 1) AS article FROM cn),
ca AS (SELECT DISTINCT item, article FROM un),
gn AS (SELECT query_id, unnest(gold_norms) AS n FROM q),
gold AS (SELECT DISTINCT query_id, regexp_replace(n, '^([^:]*):[^:]*', '\1') AS norm_id, regexp_extract(n, '^([^:]*)', 1) || ':' || regexp_extract(n, ':(art\.\d+(?:\.\d+)?)(?:$|:)', 1) AS article FROM gn),
ga AS (SELECT DISTINCT query_id, article FROM gold),
t0 AS (SELECT item, regexp_extract_all(replace(lower(coalesce(txt, '')), 'ё', 'е'), '[0-9a-zа-я]+') AS t FROM c),
t1 AS (SELECT item, CASE WHEN len(t) = 0 THEN ['_empty'] ELSE t END AS t FROM t0),
po AS (SELECT item, term, dl, count(*) AS tf FROM (SELECT item, len(t) AS dl, unnest(t) AS term FROM t1) GROUP BY item, term, dl),
sz AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t1),
dfs AS (SELECT term, count(*) AS df FROM po GROUP BY term),
raw AS (SELECT term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, sz),
tw AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf, n, avgdl FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(replace(lower(txt), 'ё', 'е'), '[0-9a-zа-я]+')) AS term FROM q) GROUP BY query_id, term),
hit AS (SELECT query_id, item, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN tw USING (term) JOIN po USING (term) GROUP BY query_id, item),
al AS (SELECT query_id, item, coalesce(score, 0.0) AS score FROM (SELECT query_id, item FROM q, c) x LEFT JOIN hit USING (query_id, item)),
bm100 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM al) WHERE rank <= 100),
bm AS (SELECT * FROM bm100 WHERE rank <= 50),
cs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM (
   SELECT query_id, item, round(shared / sqrt(CAST(terms AS DOUBLE) * asked), 9) AS score
   FROM (SELECT query_id, item, count(*) AS shared FROM qt JOIN po USING (term) GROUP BY query_id, item)
   JOIN (SELECT item, count(*) AS terms FROM po GROUP BY item) USING (item) JOIN (SELECT query_id, count(*) AS asked FROM qt GROUP BY query_id) USING (query_id))) WHERE rank <= 50),
rk AS (SELECT query_id, 'bm25' AS source, rank, item, 2.0 AS w FROM bm UNION ALL SELECT query_id, 'cosine', rank, item, 1.0 FROM cs),
pj AS (SELECT query_id, source, w, row_number() OVER (PARTITION BY query_id, source ORDER BY f, article) AS rank, article AS item
       FROM (SELECT query_id, source, w, article, min(rank) AS f FROM rk JOIN ca USING (item) GROUP BY ALL)),
ar AS (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b, item) AS rank
       FROM (SELECT query_id, item, round(sum(w / (30 + rank)), 9) AS score, min(rank) AS b FROM pj GROUP BY query_id, item)),
cand AS (SELECT DISTINCT query_id, item FROM pj WHERE rank <= 10),
ws AS (SELECT item, list_distinct(regexp_extract_all(lower(txt), '[\p{L}\p{Nd}\p{M}\p{Pc}]+')) AS r FROM c),
wq AS (SELECT query_id, list_distinct(regexp_extract_all(lower(txt), '[\p{L}\p{Nd}\p{M}\p{Pc}]+')) AS l FROM q),
md AS (SELECT query_id, item, round(len(list_intersect(l, r)) / CAST(len(l) + len(r) - len(list_intersect(l, r)) AS DOUBLE), 6) AS score
       FROM (SELECT DISTINCT query_id, item FROM rk) JOIN wq USING (query_id) JOIN ws USING (item)),
bc AS (SELECT query_id, article, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article, item) AS rank
       FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY score DESC, item) AS n FROM md JOIN ca USING (item)) WHERE n = 1),
sq AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY src, rank) AS rank FROM (
       SELECT query_id, item, src, rank, row_number() OVER (PARTITION BY query_id, item ORDER BY src, rank) AS n FROM (
       SELECT query_id, item, rank, CASE source WHEN 'cosine' THEN 0 ELSE 1 END AS src FROM pj WHERE rank <= CASE source WHEN 'cosine' THEN 4 ELSE 6 END)) WHERE n = 1),
cm AS (SELECT query_id, article, item, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY rank, src, item) AS place FROM (
       SELECT query_id, article, item, rank, src FROM (SELECT query_id, article, item, rank, src, row_number() OVER (PARTITION BY query_id, article, item ORDER BY rank, src) AS n
       FROM (SELECT query_id, item, rank, CASE source WHEN 'cosine' THEN 1 ELSE 2 END AS src FROM rk) JOIN ca USING (item)
       WHERE (query_id, article) IN (SELECT query_id, item FROM sq)) WHERE n = 1)) WHERE place <= 2),
rb AS (SELECT query_id, rank, item, norm_id, article FROM bm100 JOIN un USING (item)),
rc AS (SELECT query_id, rank, item, norm_id, article FROM cs JOIN un USING (item))
"""

#: The same for every case.
EVERY = BASE.replace("CAST(regexp_extract(case_id, '(\\d+)$', 1) AS BIGINT) % 50 = 0 AND ", "")


def _score(source: str, k: int) -> str:
    return f"""SELECT query_id, e AS exact, a AS article FROM
 (SELECT query_id, avg(CAST((query_id, norm_id) IN (SELECT query_id, norm_id FROM {source} WHERE rank <= {k}) AS INT)) AS e FROM (SELECT DISTINCT query_id, norm_id FROM gold) GROUP BY query_id)
 JOIN (SELECT query_id, avg(CAST((query_id, article) IN (SELECT query_id, article FROM {source} WHERE rank <= {k}) AS INT)) AS a FROM ga GROUP BY query_id) USING (query_id)"""


_EXPERIMENTS = "ex AS (" + " UNION ALL ".join(
    f"SELECT '{name}@{k:02d}' AS name, round(avg(article), 6) AS article, round(avg(exact), 6) AS exact, CAST({k} AS BIGINT) AS cost FROM ({_score(rel, k)})"
    for name, rel in (("bm25", "rb"), ("cosine", "rc")) for k in (1, 3, 5, 10, 20, 50)
) + ")"

_LABELLED = r"""lb AS (SELECT DISTINCT case_id, group_id, label, regexp_replace(n, '^([^:]*):[^:]*', '\1') AS norm_id FROM
 (SELECT case_id, coalesce(case_group_id, case_id) AS group_id, issue_type AS label, unnest(gold_norms) AS n FROM ec) WHERE label IS NOT NULL AND label NOT IN ('other', 'unclear'))"""

_FIRST = "row_number() OVER (PARTITION BY query_id ORDER BY {0}) AS rank"

SQL = {
    "bm25_index": BASE + "SELECT max(n) AS texts, count(*) AS terms, sum(df) AS postings FROM tw",
    "bm25_topk": BASE + "SELECT query_id, item, score, rank FROM bm WHERE rank <= 10",
    "bm25_terms": BASE + "SELECT term, df, round(idf, 6) AS idf, n, round(avgdl, 6) AS avgdl FROM tw",
    "set_cosine_topk": BASE + "SELECT query_id, item, score, rank FROM cs WHERE rank <= 10",
    "dense_topk": """SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) + 0.0 AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""",
    "rrf": BASE + "SELECT * FROM (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM (SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM rk GROUP BY query_id, item)) WHERE rank <= 10",
    "weighted_rrf": BASE + "SELECT * FROM (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b, item) AS rank FROM (SELECT query_id, item, round(sum(w / (30 + rank)), 9) AS score, min(rank) AS b FROM rk GROUP BY query_id, item)) WHERE rank <= 10",
    "article_projection": BASE + "SELECT query_id, source, rank, item FROM pj",
    "weighted_article_rrf": BASE + "SELECT query_id, item, score, rank FROM ar WHERE rank <= 10",
    "fuse_candidates": BASE + """SELECT query_id, item, score, rank FROM (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b, item) AS rank FROM (
        SELECT query_id, item, round(sum(w / (30 + rank)), 9) AS score, min(rank) AS b FROM pj JOIN cand USING (query_id, item) GROUP BY query_id, item)) WHERE rank <= 10""",
    "protected_shortlist": BASE + """, a AS (SELECT query_id, item, 0 AS part, n FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM pj WHERE source = 'bm25' AND (query_id, item) IN (SELECT * FROM cand)) WHERE n <= 4),
        b AS (SELECT query_id, item, 1 AS part, n FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM pj WHERE source = 'cosine' AND (query_id, item) IN (SELECT * FROM cand) AND (query_id, item) NOT IN (SELECT query_id, item FROM a)) WHERE n <= 3),
        k AS (SELECT * FROM a UNION ALL SELECT * FROM b),
        f AS (SELECT query_id, item, 2 AS part, rank AS n FROM ar WHERE rank <= 100 AND (query_id, item) IN (SELECT * FROM cand) AND (query_id, item) NOT IN (SELECT query_id, item FROM k))
        SELECT query_id, item, rank FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY part, n) AS rank FROM (SELECT * FROM k UNION ALL SELECT * FROM f)) WHERE rank <= 10""",
    "retrieval_bonus": BASE + """, p AS (SELECT query_id, item, sum(1.0::DOUBLE / (10 + rank)) AS prior, min(rank) AS b FROM pj JOIN cand USING (query_id, item) GROUP BY query_id, item),
        sc AS (SELECT query_id, item, b, round(coalesce(score, '-infinity'::DOUBLE) + 0.5 * prior / max(prior) OVER (PARTITION BY query_id), 9) AS score FROM p LEFT JOIN (SELECT query_id, article AS item, score FROM bc WHERE rank <= 1000) USING (query_id, item))
        SELECT query_id, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b, item) AS rank FROM sc) WHERE rank <= 10""",
    "quota_fusion": BASE + """, o AS (SELECT query_id, item, 0 AS part, rank AS n FROM pj WHERE source = 'cosine' AND rank <= 5), r AS (SELECT query_id, item, 1 AS part, rank AS n FROM ar WHERE rank <= 100 AND (query_id, item) NOT IN (SELECT query_id, item FROM o))
        SELECT query_id, item, rank FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY part, n) AS rank FROM (SELECT * FROM o UNION ALL SELECT * FROM r)) WHERE rank <= 10""",
    "interleave": BASE + """, x AS (SELECT query_id, item, rank AS r, CASE source WHEN 'cosine' THEN 0 ELSE 1 END AS s FROM rk), y AS (SELECT *, row_number() OVER (PARTITION BY query_id, item ORDER BY r, s) AS n FROM x)
        SELECT query_id, item, rank FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY r, s) AS rank FROM y WHERE n = 1) WHERE rank <= 20""",
    # Every chunk of the project's table lies in one article, so that the greedy choice is the first chunk of each.
    "article_diversify": BASE + "SELECT query_id, item, rank FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT query_id, item, rank, row_number() OVER (PARTITION BY query_id, article ORDER BY rank) AS n FROM bm JOIN ca USING (item)) WHERE n = 1) WHERE rank <= 10",
    "top_articles": BASE + "SELECT query_id, item, rank FROM (SELECT query_id, article AS item, row_number() OVER (PARTITION BY query_id ORDER BY f, article) AS rank FROM (SELECT query_id, article, min(rank) AS f FROM bm JOIN ca USING (item) WHERE rank <= 30 GROUP BY query_id, article)) WHERE rank <= 5",
    "article_then_points": BASE + """, ta AS (SELECT query_id, article FROM (SELECT query_id, article, row_number() OVER (PARTITION BY query_id ORDER BY f, article) AS n FROM (SELECT query_id, article, min(rank) AS f FROM bm JOIN ca USING (item) WHERE rank <= 30 GROUP BY query_id, article)) WHERE n <= 5)
        SELECT query_id, item, rank FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (SELECT DISTINCT query_id, item, rank AS r FROM bm JOIN ca USING (item) WHERE (query_id, article) IN (SELECT * FROM ta))) WHERE rank <= 10""",
    "select_evidence": EVERY + """, ch AS (SELECT query_id, item AS article, rank AS ar FROM ar WHERE rank <= 5), ins AS (SELECT query_id, item, article, rank AS r, ch.ar FROM bm JOIN ca USING (item) JOIN ch USING (query_id, article)),
        u AS (SELECT query_id, item, 0 AS part, ar AS p FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY r) AS n FROM ins) WHERE n = 1 UNION ALL SELECT query_id, item, 1, r FROM ins),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, item ORDER BY part, p) AS n FROM u)
        SELECT query_id, item, rank FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY part, p) AS rank FROM o WHERE n = 1) WHERE rank <= 10""",
    "source_quota": BASE + "SELECT query_id, item, rank FROM sq",
    "candidate_map": BASE + "SELECT query_id, article, item, place FROM cm",
    "candidate_pool": BASE + """, x AS (SELECT cm.query_id, cm.item, sq.rank AS a, cm.place AS p FROM cm JOIN sq ON sq.query_id = cm.query_id AND sq.item = cm.article), y AS (SELECT *, row_number() OVER (PARTITION BY query_id, item ORDER BY a, p) AS n FROM x)
        SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY a, p) AS rank FROM y WHERE n = 1""",
    "best_chunks": BASE + "SELECT query_id, article, item, score, rank FROM bc WHERE rank <= 10",
    "neighbors": BASE + """, p AS (SELECT item, article, row_number() OVER (PARTITION BY article ORDER BY char_start, char_end, item) AS n FROM c JOIN ca USING (item))
        SELECT a.item, a.article, b.item AS neighbor, CAST(b.n - a.n AS INT) AS distance FROM p a JOIN p b ON a.article = b.article AND abs(a.n - b.n) BETWEEN 1 AND 2 WHERE a.item IN (SELECT item FROM bm WHERE rank <= 10)""",
    "overlap_weighted": BASE + r""", nu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm_id ORDER BY loaded_at DESC) AS rn FROM norm_units WHERE unit_level = 'article') WHERE rn = 1 AND NOT is_repealed),
        nw AS (SELECT split_part(n, ':', 1) AS law, max(split_part(n, ':', 2)) AS ed FROM cn GROUP BY 1),
        wh AS (SELECT regexp_replace(norm_id, '^([^:]*:[^:]*:art\.[^:]*).*$', '\1') AS norm_id, min(char_start) AS s, max(char_end) AS e FROM (SELECT norm_id, arg_max(char_start, loaded_at) AS char_start, arg_max(char_end, loaded_at) AS char_end FROM norm_units GROUP BY norm_id) GROUP BY 1),
        sp AS (SELECT split_part(norm_id, ':', 1) AS law, split_part(norm_id, ':', 1) || ':' || regexp_extract(norm_id, ':(art\.\d+(?:\.\d+)?)(?:$|:)', 1) AS article, s, e FROM nu JOIN wh USING (norm_id) JOIN nw ON nw.law = split_part(norm_id, ':', 1) AND nw.ed = edition_id),
        x AS (SELECT query_id, article, rank AS r, round((least(char_end, e) - greatest(char_start, s)) / CAST(char_end - char_start AS DOUBLE) / (60 + rank), 9) AS score FROM bm JOIN c USING (item) JOIN sp ON sp.law = split_part(norm_ids[1], ':', 1) WHERE char_end > char_start AND least(char_end, e) > greatest(char_start, s)),
        y AS (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY score DESC, r) AS n FROM x)
        SELECT query_id, item, score, rank FROM (SELECT query_id, article AS item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r, article) AS rank FROM y WHERE n = 1) WHERE rank <= 10""",
    "recall_by_topic": BASE + f""", sc AS ({_score("rb", 10)}), z AS (SELECT split, topic, exact, article, CAST(exact = 1 AS INT) AS ea, CAST(article = 1 AS INT) AS aa FROM sc JOIN q USING (query_id))
        SELECT split, coalesce(topic, '*') AS topic, count(*) AS n, round(avg(exact), 6) AS exact, round(avg(article), 6) AS article, round(avg(ea), 6) AS exact_all, round(avg(aa), 6) AS article_all FROM z GROUP BY GROUPING SETS ((split, topic), (split))""",
    "overlap_at_k": BASE + """, l AS (SELECT query_id, list_distinct(list(item)) AS li, list_distinct(list(article)) AS la FROM rb WHERE rank <= 10 GROUP BY query_id), r AS (SELECT query_id, list_distinct(list(item)) AS ri, list_distinct(list(article)) AS ra FROM rc WHERE rank <= 10 GROUP BY query_id),
        g AS (SELECT query_id, list(article) AS g FROM ga GROUP BY query_id), z AS (SELECT query_id, g, li, ri, list_intersect(g, la) AS hl, list_intersect(g, ra) AS hr FROM g JOIN l USING (query_id) JOIN r USING (query_id))
        SELECT query_id, round(len(list_intersect(li, ri)) / CAST(len(li) + len(ri) - len(list_intersect(li, ri)) AS DOUBLE), 6) AS jaccard, round(len(hl) / CAST(len(g) AS DOUBLE), 6) AS left_share, round(len(hr) / CAST(len(g) AS DOUBLE), 6) AS right_share,
        round((len(hl) + len(hr) - len(list_intersect(hl, hr))) / CAST(len(g) AS DOUBLE), 6) AS union_share, round((len(hl) - len(list_intersect(hl, hr))) / CAST(len(g) AS DOUBLE), 6) AS only_left,
        round((len(hr) - len(list_intersect(hl, hr))) / CAST(len(g) AS DOUBLE), 6) AS only_right, round(len(list_intersect(hl, hr)) / CAST(len(g) AS DOUBLE), 6) AS both_share FROM z""",
    "best_rank_bucket": BASE + """SELECT query_id, best, CASE WHEN best <= 10 THEN '<=10' WHEN best <= 20 THEN '11-20' WHEN best <= 50 THEN '21-50' WHEN best <= 100 THEN '51-100' ELSE '>100' END AS bucket
        FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN (SELECT query_id, min(rank) AS best FROM rb JOIN ga USING (query_id, article) GROUP BY query_id) USING (query_id)""",
    "complementarity": BASE + """SELECT query_id, CASE WHEN l AND r THEN 'both' WHEN l THEN 'only_left' WHEN r THEN 'only_right' ELSE 'neither' END AS label FROM (SELECT query_id,
        bool_or((query_id, article) IN (SELECT query_id, article FROM rb WHERE rank <= 10)) AS l, bool_or((query_id, article) IN (SELECT query_id, article FROM rc WHERE rank <= 10)) AS r FROM ga GROUP BY query_id)""",
    "repeated_slots": BASE + """SELECT query_id, coalesce(s, 0) AS slots FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN (SELECT query_id, sum(n - 1) AS s FROM (SELECT query_id, article, count(DISTINCT rank) AS n FROM rb WHERE rank <= 10 AND (query_id, article) NOT IN (SELECT * FROM ga) GROUP BY query_id, article) GROUP BY query_id) USING (query_id)""",
    "gold_status": BASE + r""", w AS (SELECT DISTINCT regexp_replace(n, '^([^:]*):[^:]*', '\1') AS norm_id FROM (SELECT unnest(gold_norms) AS n FROM ec)), i AS (SELECT DISTINCT norm_id FROM un)
        SELECT w.norm_id, CASE WHEN bool_or(i.norm_id = w.norm_id) THEN 'exact' WHEN bool_or(starts_with(i.norm_id, w.norm_id || ':')) THEN 'descendant' WHEN bool_or(starts_with(w.norm_id, i.norm_id || ':')) THEN 'ancestor' ELSE 'absent' END AS status FROM w, i GROUP BY w.norm_id""",
    "label_mapping": BASE + f""", {_LABELLED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY groups DESC, cases DESC, norm_id) AS rank FROM (SELECT label, norm_id, count(DISTINCT group_id) AS groups, count(DISTINCT case_id) AS cases FROM lb GROUP BY label, norm_id)) WHERE rank <= 10""",
    "leave_group_out": BASE + f""", {_LABELLED}, h AS (SELECT DISTINCT group_id, label FROM lb),
        o AS (SELECT h.group_id, h.label, lb.norm_id, count(DISTINCT lb.group_id) AS g, count(DISTINCT lb.case_id) AS k FROM h JOIN lb ON lb.label = h.label AND lb.group_id <> h.group_id GROUP BY ALL),
        m AS (SELECT *, row_number() OVER (PARTITION BY group_id, label ORDER BY g DESC, k DESC, norm_id) AS rank FROM o)
        SELECT case_id, norm_id, rank FROM (SELECT DISTINCT case_id, group_id, label FROM lb) JOIN (SELECT * FROM m WHERE rank <= 5) USING (group_id, label)""",
    "spearman": BASE + """, z AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY bm.rank) AS a, row_number() OVER (PARTITION BY query_id ORDER BY cs.rank) AS b FROM bm JOIN cs USING (query_id, item))
        SELECT query_id, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE 1 - 6 * sum((a - b) * (a - b)) / CAST(count(*) * (count(*) * count(*) - 1) AS DOUBLE) END, 6) AS rho FROM z GROUP BY query_id""",
    "top_overlap": BASE + """SELECT query_id, round(len(list_intersect(l, r)) / CAST(least(10, len(l), len(r)) AS DOUBLE), 6) AS share FROM (SELECT query_id, list(item) AS l FROM bm WHERE rank <= 10 GROUP BY query_id) JOIN (SELECT query_id, list(item) AS r FROM cs WHERE rank <= 10 GROUP BY query_id) USING (query_id)""",
    "pareto": BASE + f""", {_EXPERIMENTS} SELECT * FROM ex a WHERE NOT EXISTS (SELECT 1 FROM ex b WHERE b.article >= a.article AND b.exact >= a.exact AND b.cost <= a.cost AND (b.article > a.article OR b.exact > a.exact OR b.cost < a.cost))""",
    "winner_tie_band": BASE + f""", {_EXPERIMENTS} SELECT * FROM ex WHERE (SELECT max(article) FROM ex) - article < 0.01 ORDER BY exact DESC, cost, name LIMIT 1""",
    "bootstrap_draws": BASE + f""", b AS ({_score("rb", 10)}), t AS ({_score("rc", 10)}), g AS (SELECT coalesce(case_group_id, case_id) AS g, sum(t.article - b.article) AS d, count(*) AS n FROM b JOIN t USING (query_id) JOIN ec ON ec.case_id = query_id GROUP BY 1),
        z AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS i FROM g), k AS (SELECT count(*) AS size, sum(d) / sum(n) AS mean FROM g),
        w AS (SELECT s, CAST('0x' || substr(md5(s || '|' || j), 1, 8) AS BIGINT) % size AS i FROM k, (SELECT unnest(range(2000)) AS s), (SELECT unnest(range((SELECT size FROM k))) AS j)),
        m AS (SELECT list(x ORDER BY x) AS m FROM (SELECT sum(d) / sum(n) AS x FROM w JOIN z USING (i) GROUP BY s))
        SELECT size AS groups, round(mean, 6) AS mean_delta, round(m[50], 6) AS low, round(m[1950], 6) AS high FROM k, m""",
    "budget_winners": BASE + f""", {_EXPERIMENTS} SELECT budget, name, article, exact, cost FROM (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY article DESC, cost, name) AS n FROM (SELECT CAST(unnest([5, 10, 50]) AS BIGINT) AS budget) b JOIN ex ON cost <= budget) WHERE n = 1""",
}
