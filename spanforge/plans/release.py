"""Queries of release checks over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import ids
from spanforge.functions.latest import latest
from spanforge.operators import anonymize, metrics, release, validation
from spanforge.plans.records import _EC, units
from spanforge.plans.retrieval import base
from spanforge.plans.retrieval_sql import BASE
from spanforge.session import table

FIELDS = ("complaint_argument_raw", "complaint_argument_blind", "complaint_argument_summary")
_PUBLIC = ["schema_version", "case_group_id", "edition_id", "split", "topic", *FIELDS, "doc_fragment", "gold_evidence", "gold_norms", "issue_type", "outcome"]


def _public(s, d):
    return latest(table(s, d, "public_cases"), ["case_id"], "loaded_at", _PUBLIC).withColumn("split", F.lower(F.regexp_replace("split", r"\s", "")))


def _cases(s, d):
    return latest(table(s, d, "eval_cases"), ["case_id"], "loaded_at", [*FIELDS, "doc_fragment", "complaint_argument_source", "outcome_evidence", "gold_evidence", "gold_norms", "topic"])


def release_faults(s, d):
    return validation.broken_rules(_public(s, d), "case_id", release.release_rules(FIELDS)).groupBy("rule").agg(F.count("*").alias("cases"))


def public_split_conflicts(s, d):
    """Cases that stand in both splits of the public table, over all of its rows."""
    rows = table(s, d, "public_cases").select("case_id", F.lower(F.regexp_replace("split", r"\s", "")).alias("split"))
    return rows.groupBy("case_id").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("rows"))


def private_members(s, d):
    """How many members of the raw cases a release must drop, by rule and key."""
    rows = latest(table(s, d, "eval_cases"), ["case_id"], "loaded_at", ["doc_paths", "complaint_argument_source", "topic"])
    found = release.private_members(rows, "case_id")
    return found.groupBy("rule", F.regexp_replace("location", r"\[\d+\]", "[]").alias("place")).agg(F.count("*").alias("members"))


def publishable_fields(s, d):
    return release.publishable(_cases(s, d)).select("case_id", "field", F.length("text").alias("chars"))


def query_variants(s, d):
    rows = release.query_variants(_cases(s, d), {"raw": FIELDS[0], "blind": FIELDS[1], "summary": FIELDS[2]})
    return rows.groupBy("variant").agg(F.count("*").alias("cases"), F.count_if("missing").alias("missing"), F.sum(F.length("text")).alias("chars"))


def rank_tags(s, d):
    b = base(s, d)
    slots = metrics.repeated_slots(b.gold, b.retrieved(b.bm25(10))).withColumnRenamed("query_id", "case_id")
    return release.rank_tags(_cases(s, d).filter("complaint_argument_blind is not null").join(b.chosen.select("case_id"), "case_id", "left_semi"), slots)


def span_faults(s, d):
    return release.span_faults(_cases(s, d))


def titled_chunks(s, d):
    chunks = latest(table(s, d, "chunks"), ["chunk_id"], None, ["text", "norm_ids"])
    titles = units(s, d).filter("unit_level = 'article'").select(F.col("edition_id").alias("edition"), ids.article_key(F.col("norm_id")).alias("article"), "title")
    return release.titled_chunks(chunks, titles).select("chunk_id", "article_title_prefix", F.sha2("text", 256).alias("digest"))


def unit_faults(s, d):
    return release.unit_faults(units(s, d)).groupBy("rule").agg(F.count("*").alias("units"))


def second_scan(s, d):
    """Whether a second scan of each anonymised case finds nothing."""
    fields = [*FIELDS, "doc_fragment"]
    return release.clean_again(anonymize.anonymized(_cases(s, d), "case_id", fields), "case_id", fields)


def argument_percentiles(s, d):
    """Linear percentiles of the arguments' lengths by topic."""
    rows = _cases(s, d).filter("complaint_argument_raw is not null").select(F.coalesce("topic", F.lit("")).alias("topic"), F.length("complaint_argument_raw").alias("n"))
    return rows.groupBy("topic").agg(*(F.round(F.percentile("n", p), 4).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.95)))


def pointer_chunks(s, d):
    """Chunks that only point to another article."""
    from spanforge.functions.text import is_pointer_text

    chunks = latest(table(s, d, "chunks"), ["chunk_id"], None, ["text"])
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(is_pointer_text(F.col("text"))).alias("pointers"), F.count_if(F.col("text").rlike("(?iu)в соответствии со стать")).alias("mentions"))


QUERIES = {f.__name__: f for f in (release_faults, public_split_conflicts, private_members, publishable_fields, query_variants, rank_tags, span_faults, titled_chunks, unit_faults, second_scan, argument_percentiles, pointer_chunks)}

_PC = r"WITH pc AS (SELECT * REPLACE (regexp_replace(lower(split), '\s', '', 'g') AS split) FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loaded_at DESC) AS rn FROM public_cases) WHERE rn = 1) "
_HAS = "coalesce(length(trim({0})) > 0, false)"
_RULES = {"version": "coalesce(schema_version = 1, false)", "split": "coalesce(split IN ('dev', 'eval'), false)"} | {f"has_{c}": _HAS.format(c) for c in ("case_id", "case_group_id", "edition_id", "topic", *FIELDS)} | {
    "eval_labels_hidden": "coalesce(split <> 'eval' OR (gold_norms IS NULL AND gold_evidence IS NULL AND issue_type IS NULL AND outcome IS NULL), false)"
}
_TEXTS = " UNION ALL ".join([f"SELECT case_id, '{c}' AS field, {c} AS t FROM ec" for c in (*FIELDS, "doc_fragment")] + [f"SELECT case_id, '{c}.quote', {c}.quote FROM ec" for c in ("complaint_argument_source", "outcome_evidence")] + ["SELECT case_id, 'gold_evidence[' || i || '].quote', gold_evidence[i + 1].decision_span.quote FROM (SELECT case_id, gold_evidence, unnest(range(len(gold_evidence))) AS i FROM ec)"])
_SOUND = "(x IS NULL OR coalesce(x.char_start >= 0 AND x.char_end > x.char_start AND length(x.quote) = x.char_end - x.char_start, false))"
_SPANS = "SELECT case_id, 'complaint_argument_source' AS field, complaint_argument_source AS x FROM ec UNION ALL SELECT case_id, 'outcome_evidence', outcome_evidence FROM ec UNION ALL SELECT case_id, 'gold_evidence[' || i || ']', gold_evidence[i + 1].decision_span FROM (SELECT case_id, gold_evidence, unnest(range(len(gold_evidence))) AS i FROM ec)"
_CITES = r"(^|[^\p{L}\p{N}_])(стат(ья|ьи|ье|ью|ьёй|ей)|ст\.?|част(ь|и|ью)|ч\.?|пункт(а|е|ом|ы)?|п\.?)\s*\d+"

SQL = {
    "release_faults": _PC + "SELECT rule, count(*) AS cases FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule FROM pc WHERE NOT {c}" for n, c in _RULES.items()) + ") GROUP BY rule",
    "public_split_conflicts": r"SELECT case_id, count(DISTINCT regexp_replace(lower(split), '\s', '', 'g')) AS splits, count(*) AS rows FROM public_cases GROUP BY case_id",
    "private_members": _EC + """SELECT rule, place, count(*) AS members FROM (SELECT 'private_key' AS rule, 'record.doc_paths' AS place FROM ec WHERE doc_paths IS NOT NULL
        UNION ALL SELECT 'private_key', 'record.complaint_argument_source.path' FROM ec WHERE complaint_argument_source.path IS NOT NULL
        UNION ALL SELECT 'private_path', 'record.complaint_argument_source.' || k FROM (SELECT unnest(['path', 'quote', 'note']) AS k, unnest([complaint_argument_source.path, complaint_argument_source.quote, complaint_argument_source.note]) AS v FROM ec) WHERE regexp_matches(v, 'file://|/home/|/Users/|C:\\\\|data/raw')) GROUP BY ALL""",
    "publishable_fields": _EC + f"SELECT case_id, field, length(t) AS chars FROM ({_TEXTS}) WHERE t IS NOT NULL",
    "query_variants": _EC + "SELECT variant, count(*) AS cases, count_if(coalesce(length(trim(t)) = 0, true)) AS missing, sum(length(t)) AS chars FROM (" + " UNION ALL ".join(f"SELECT '{v}' AS variant, {c} AS t FROM ec" for v, c in zip(("raw", "blind", "summary"), FIELDS)) + ") GROUP BY variant",
    "rank_tags": BASE + rf""", sl AS (SELECT query_id, coalesce(s, 0) AS slots FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN (SELECT query_id, sum(n - 1) AS s FROM (SELECT query_id, article, count(DISTINCT rank) AS n FROM rb WHERE rank <= 10 AND (query_id, article) NOT IN (SELECT * FROM ga) GROUP BY query_id, article) GROUP BY query_id) USING (query_id)),
        w AS (SELECT ec.*, len(list_filter(regexp_split_to_array(trim(complaint_argument_blind), '\s+'), lambda x: x <> '')) AS n, slots FROM ec JOIN q ON q.query_id = ec.case_id LEFT JOIN sl ON sl.query_id = ec.case_id)
        SELECT case_id, concat_ws(',', CASE WHEN n >= 100 THEN 'long' END, CASE WHEN n <= 20 THEN 'short' END, CASE WHEN complaint_argument_raw = complaint_argument_blind THEN 'raw_equals_blind' END, CASE WHEN len(gold_norms) > 1 THEN 'multi_gold' END,
        CASE WHEN slots >= 2 THEN 'crowding' END, CASE WHEN regexp_matches(lower(complaint_argument_raw), '{_CITES}') THEN 'citation_sensitive' END) AS tags FROM w""",
    "span_faults": _EC + f"SELECT case_id, field FROM ({_SPANS}) WHERE NOT {_SOUND}",
    "titled_chunks": _EC + r""", ti AS (SELECT edition_id, split_part(norm_id, ':', 1) || ':' || regexp_extract(norm_id, ':(art\.\d+(?:\.\d+)?)(?:$|:)', 1) AS article, title FROM nu WHERE unit_level = 'article' AND length(title) > 0),
        na AS (SELECT DISTINCT chunk_id, split_part(n, ':', 2) AS edition_id, split_part(n, ':', 1) || ':' || regexp_extract(n, ':(art\.\d+(?:\.\d+)?)(?:$|:)', 1) AS article FROM (SELECT chunk_id, unnest(norm_ids) AS n FROM ck)),
        f AS (SELECT chunk_id, arg_min(title, article) AS title FROM na JOIN ti USING (edition_id, article) GROUP BY chunk_id)
        SELECT chunk_id, title IS NOT NULL AS article_title_prefix, sha256(coalesce(title || '.' || chr(10), '') || text) AS digest FROM ck LEFT JOIN f USING (chunk_id)""",
    "unit_faults": _EC + """, x AS (SELECT u.*, p.norm_id IS NOT NULL AS there, p.char_start AS ps, p.char_end AS pe FROM nu u LEFT JOIN nu p ON p.norm_id = u.parent_norm_id)
        SELECT rule, count(*) AS units FROM (SELECT 'empty_text' AS rule FROM x WHERE coalesce(length(trim(text)) = 0, true) UNION ALL SELECT 'no_span' FROM x WHERE NOT coalesce(char_start >= 0 AND char_end > char_start, false)
        UNION ALL SELECT 'outside_parent' FROM x WHERE there AND (char_start < ps OR char_end > pe) UNION ALL SELECT 'no_parent' FROM x WHERE parent_norm_id IS NOT NULL AND NOT there) GROUP BY rule""",
    "second_scan": _EC + "SELECT case_id, true AS clean FROM ec",
    "argument_percentiles": _EC + "SELECT coalesce(topic, '') AS topic, round(quantile_cont(length(complaint_argument_raw), 0.5), 4) AS p50, round(quantile_cont(length(complaint_argument_raw), 0.9), 4) AS p90, round(quantile_cont(length(complaint_argument_raw), 0.95), 4) AS p95 FROM ec WHERE complaint_argument_raw IS NOT NULL GROUP BY 1",
    "pointer_chunks": _EC + r"SELECT count(*) AS chunks, count_if(length(trim(regexp_replace(text, '[\s\x{a0}]+', ' ', 'g'))) <= 240 AND contains(lower(text), 'в соответствии со стать')) AS pointers, count_if(contains(lower(text), 'в соответствии со стать')) AS mentions FROM ck",
}
