"""Queries over the laws, the cases and the pages: structure, validation, release."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import ids, quotes, text
from spanforge.functions.latest import latest
from spanforge.operators import anonymize, corpus, validation
from spanforge.plans.history import edition_sequence
from spanforge.session import secret, table

CASE_COLUMNS = [
    "edition_id", "topic", "split", "outcome", "complaint_argument_raw", "complaint_argument_blind", "complaint_argument_source", "gold_norms", "gold_evidence",
    "outcome_evidence", "annotation_status", "exclusion_reasons", "case_group_id", "issue_type", "notice_date", "doc_fragment", "relies_on_bylaw", "duplicate_of",
]


def cases(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "eval_cases"), ["case_id"], "loaded_at", CASE_COLUMNS).withColumn("split", F.lower(F.regexp_replace("split", r"\s", "")))


def units(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "norm_units"), ["norm_id"], "loaded_at", ["edition_id", "article", "part", "point", "unit_level", "parent_norm_id", "title", "text", "char_start", "char_end", "unit_order", "is_retrieval_unit", "is_repealed"])


def law_stats(s, d):
    return corpus.corpus_stats(units(s, d), F.split("norm_id", ":")[0])


def unit_id_check(s, d):
    """Per level, the units and those whose id is not the one that its parts make."""
    law = F.split("norm_id", ":")[0]
    built = ids.make_norm_id(law, F.col("edition_id"), F.col("article"), F.col("part"), F.col("point"))
    return units(s, d).groupBy("unit_level").agg(F.count("*").alias("units"), F.count_if(~built.eqNullSafe(F.col("norm_id"))).alias("wrong"), F.max(built).alias("last_id"))


def unit_lineage(s, d):
    """Per depth, how many units have a parent row."""
    u = units(s, d)
    parents = u.select(F.col("norm_id").alias("parent_norm_id"), F.lit(1).alias("there"))
    joined = u.join(parents, "parent_norm_id", "left")
    return joined.groupBy("unit_level").agg(F.count("*").alias("units"), F.count("parent_norm_id").alias("with_parent_id"), F.count("there").alias("with_parent_row"))


def case_rule_report(s, d):
    return validation.rule_report(cases(s, d), validation.case_rules())


def missing_norms(s, d):
    """Per status: the gold ids of its cases, and those that no edition has as they are written or in upper case (none is, so that a fault shows)."""
    c = cases(s, d).select("case_id", "annotation_status", F.array_union("gold_norms", F.transform("gold_norms", F.upper)).alias("gold_norms"))
    missing = validation.missing_references(c, "case_id", "gold_norms", table(s, d, "norm_units"), "norm_id").groupBy("key").agg(F.count("*").alias("n"))
    rows = c.join(missing.withColumnRenamed("key", "case_id"), "case_id", "left")
    return rows.groupBy("annotation_status").agg(F.sum(F.coalesce(F.size("gold_norms"), F.lit(0))).alias("wanted"), F.coalesce(F.sum("n"), F.lit(0)).alias("missing"))


def split_groups(s, d):
    return validation.groups_across_splits(cases(s, d), "case_group_id", "split")


def split_policy(s, d):
    return validation.split_policy(cases(s, d), "split", "topic")


def edition_at_notice(s, d):
    """The edition of each law of a case's norms that was in force on its notice date, as of that day."""
    c = cases(s, d).filter(F.to_date("notice_date").isNotNull()).select("case_id", F.date_format(F.to_date("notice_date"), "yyyy-MM-dd").alias("day"), F.explode(F.array_distinct(F.transform("gold_norms", lambda n: F.split(n, ":")[0]))).alias("law_id"))
    e = edition_sequence(table(s, d, "editions"))
    w = Window.partitionBy("law_id").orderBy("position")
    periods = e.withColumn("until", F.coalesce(F.lead("start").over(w), F.lit("9999-12-31"))).select("law_id", F.col("edition_id").alias("edition_in_force"), "start", "until")
    return c.join(periods, "law_id").filter((F.col("start") <= F.col("day")) & (F.col("day") < F.col("until"))).select("case_id", "law_id", "day", "edition_in_force")


def citation_flags(s, d):
    c = cases(s, d).filter("complaint_argument_blind is not null")
    return c.select("case_id", text.contains_direct_citation(F.col("complaint_argument_blind")).alias("cites"), (F.size(text.word_set(F.col("complaint_argument_blind"))) >= 100).alias("long"), (F.col("complaint_argument_blind") == F.coalesce("complaint_argument_raw", F.lit(""))).alias("same_as_raw"))


def public_ids(s, d):
    """Fingerprints, and whether the salted pseudonyms of all ids are well-formed and as many as the ids."""
    c = cases(s, d).withColumn("public_id", text.public_id("case", secret(s, "public ids", lasting=False), F.col("case_id")))
    of = Window.partitionBy("public_id")
    return c.select("case_id", (F.col("public_id").rlike("^case_[0-9a-f]{12}$") & (F.count("*").over(of) == 1)).alias("sound"), text.fingerprint(F.coalesce("complaint_argument_raw", F.lit(""))).alias("fingerprint"))


def release_rows(s, d):
    """Public rows: labels of the eval split withheld, text normalised, ids replaced; without a set secret, the ids hold for one session."""
    c = cases(s, d)
    hide = lambda x: F.when(F.col("split") == "eval", F.lit(None)).otherwise(F.col(x)).alias(x)
    return c.select(text.public_id("case", secret(s, "public ids", lasting=False), F.col("case_id")).alias("case_id"), "split", hide("issue_type"), hide("outcome"), F.when(F.col("split") == "eval", F.lit(0)).otherwise(F.size("gold_norms")).alias("norms"), F.length(text.normalize_text(F.col("doc_fragment"))).alias("fragment_chars"))


def release_labels(s, d):
    """What a release says of each case: labels of the eval split withheld, and how long its normalised fragment is."""
    c = cases(s, d)
    hide = lambda x: F.when(F.col("split") == "eval", F.lit(None)).otherwise(F.col(x)).alias(x)
    return c.select("case_id", "split", hide("issue_type"), hide("outcome"), F.length(text.normalize_text(F.col("doc_fragment"))).alias("fragment_chars"))


def manifest(s, d):
    """Per split: cases, verified ones, and the digest of their ids in order."""
    c = cases(s, d)
    return c.groupBy("split").agg(F.count("*").alias("cases"), F.count_if(F.col("annotation_status") == "verified").alias("verified"), F.sha2(F.array_join(F.sort_array(F.collect_list("case_id")), "\n"), 256).alias("sha256"))


def chunk_faults(s, d):
    """Chunks too long for their size, with offsets that do not fit their text, or without a size."""
    c = latest(table(s, d, "chunks"), ["chunk_id"], None, ["text", "char_start", "char_end", "max_chunk"])
    rules = {"too_long": F.length("text") <= F.coalesce("max_chunk", F.lit(1 << 30)), "offsets": F.length("text") == F.col("char_end") - F.col("char_start"), "no_size": F.col("max_chunk").isNotNull()}
    return validation.broken_rules(c, "chunk_id", rules)


def chunk_units(s, d):
    """The units whose span each chunk meets, by an interval join in its edition."""
    c = latest(table(s, d, "chunks"), ["chunk_id"], None, ["norm_ids", "char_start", "char_end"])
    c = c.withColumn("edition", F.regexp_extract(F.get("norm_ids", F.lit(0)), "^([^:]*:[^:]*)", 1)).filter("char_end > char_start")
    u = units(s, d).filter("not is_repealed").withColumn("edition", F.regexp_extract("norm_id", "^([^:]*:[^:]*)", 1))
    return corpus.intersecting_units(c, u, "edition", "chunk_id").select("chunk_id", F.size("norm_ids").alias("units"), F.array_join("norm_ids", "|").alias("norm_ids"))


def chunk_coverage(s, d):
    """The share of each retrieval unit of the cut editions that its chunks cover."""
    c = latest(table(s, d, "chunks"), ["chunk_id"], None, ["norm_ids", "char_start", "char_end"])
    pieces = c.select(F.explode(F.array_distinct("norm_ids")).alias("norm_id"), "char_start", "char_end")
    spans = units(s, d).join(pieces.select("norm_id").distinct(), "norm_id", "left_semi").select("norm_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    return corpus.covered_fraction(spans, pieces, ["norm_id"])


def page_units(s, d):
    """Articles, parts and points found in the blocks of each page."""
    b = latest(table(s, d, "blocks"), ["block_id"], None, ["page_id", "block_order", "text", "char_start", "char_end"])
    found = corpus.unit_rows(corpus.parse_blocks(b, "page_id"), "page_id", F.lit("page"), F.col("page_id").cast("string"))
    return found.groupBy("page_id").agg(*(F.count_if(F.col("level") == x).alias(f"{x}s") for x in ("article", "part", "point")))


def page_chunks(s, d):
    """Structural chunks of the units found in pages."""
    b = latest(table(s, d, "blocks"), ["block_id"], None, ["page_id", "block_order", "text", "char_start", "char_end"])
    found = corpus.unit_rows(corpus.parse_blocks(b, "page_id"), "page_id", F.lit("page"), F.col("page_id").cast("string"))
    return corpus.structural_chunks(found, "page_id", 600)


def document_windows(s, d):
    return corpus.window_rows(table(s, d, "documents"), "doc_id", "text", 700, 200).select("doc_id", "place", "char_start", "char_end", "piece")


def quote_check(s, d):
    """Whether the argument's source quote stands in the case's texts, and where."""
    c = cases(s, d).filter("complaint_argument_source.quote is not null")
    found = quotes.quote_span(F.col("complaint_argument_source.quote"), F.col("complaint_argument_raw"))
    return c.select("case_id", found.alias("span"), quotes.contains_quote(F.col("complaint_argument_source.quote"), F.col("complaint_argument_raw")).alias("contained")).select("case_id", "contained", "span.*")


def anonymized_cases(s, d):
    """Cases with placeholders numbered across their fields in order of appearance."""
    return anonymize.anonymized(cases(s, d), "case_id", ["complaint_argument_raw", "complaint_argument_blind", "doc_fragment"])


def privacy_audit(s, d):
    return anonymize.audit(cases(s, d), "case_id", ["complaint_argument_raw", "complaint_argument_blind", "doc_fragment"])


def status_pivot(s, d):
    """Cases of each topic by status, a column for each."""
    c = cases(s, d).withColumn("topic", F.coalesce("topic", F.lit("")))
    return c.groupBy("topic").pivot("annotation_status", ["verified", "draft", "excluded"]).agg(F.count(F.lit(1))).na.fill(0)


def quotable_spans(s, d):
    """Per case, by a table function in SQL: whether the quotable spans of its argument stand where they say, in order and within their length."""
    quotes.register_quote_spans(s)
    cases(s, d).select("case_id", "complaint_argument_raw").createOrReplaceTempView("_quoted_cases")
    spans = s.sql("SELECT case_id, complaint_argument_raw AS text, q.* FROM _quoted_cases, LATERAL quote_spans(complaint_argument_raw) q")
    w = Window.partitionBy("case_id").orderBy(F.substring("span_id", 2, 10).cast("int"))
    size = F.col("char_end") - F.col("char_start")
    fits = (F.col("text").substr(F.col("char_start") + 1, size) == F.col("span")) & (F.coalesce(F.lag("char_end").over(w), F.lit(0)) <= F.col("char_start")) & ((size <= 200) | ~F.col("span").rlike(r"\s"))
    return spans.withColumn("ok", fits).groupBy("case_id").agg(F.bool_and("ok").alias("sound"))


def streamed_terms(s, d):
    """(term, texts, occurrences) of all documents, from postings that a stream has kept up to date."""
    from spanforge.session import shared_folder
    from spanforge.streaming.postings import current_postings, maintain_postings

    folder = f"{shared_folder(s)}/{s.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    schema = table(s, d, "documents").select("doc_id", "text").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(d)
    maintain_postings(stream, "doc_id", "text", f"{folder}/postings", f"{folder}/state").awaitTermination()
    posted = current_postings(s.read.parquet(f"{folder}/postings"), "doc_id")
    return posted.groupBy("term").agg(F.count("*").alias("texts"), F.sum("tf").alias("occurrences"))


QUERIES = {
    f.__name__: f
    for f in (
        law_stats, unit_id_check, unit_lineage, case_rule_report, missing_norms, split_groups, split_policy, edition_at_notice, citation_flags, public_ids, release_rows, release_labels,
        manifest, chunk_faults, chunk_units, chunk_coverage, page_units, page_chunks, document_windows, quote_check, anonymized_cases, privacy_audit, status_pivot, quotable_spans, streamed_terms,
    )
}

_EC = r"""WITH ec AS (SELECT * REPLACE (regexp_replace(lower(split), '\s', '', 'g') AS split) FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loaded_at DESC) AS rn FROM eval_cases) WHERE rn = 1),
nu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm_id ORDER BY loaded_at DESC) AS rn FROM norm_units) WHERE rn = 1),
ck AS (SELECT chunk_id, any_value(text) AS text, any_value(norm_ids) AS norm_ids, any_value(char_start) AS char_start, any_value(char_end) AS char_end, any_value(max_chunk) AS max_chunk FROM chunks GROUP BY chunk_id),
ed AS (SELECT law_id, edition_id, arg_max(effective_from, downloaded_at) AS ef FROM editions GROUP BY law_id, edition_id),
es AS (SELECT law_id, edition_id, CASE WHEN regexp_matches(ef, '^\d{4}-\d\d-\d\d$') THEN ef WHEN regexp_matches(ef, '^\d\d\.\d\d\.\d{4}$') THEN ef[7:10] || '-' || ef[4:5] || '-' || ef[1:2] ELSE edition_id END AS start FROM ed),
ep AS (SELECT law_id, edition_id, start, coalesce(lead(start) OVER (PARTITION BY law_id ORDER BY start, edition_id), '9999-12-31') AS until FROM es)
"""
_CITES = r"(^|[^\p{L}\p{N}_])(стат(ья|ьи|ье|ью|ьёй|ей)|ст\.?|част(ь|и|ью)|ч\.?|пункт(а|е|ом|ы)?|п\.?)[\s\x{a0}]*\d+"
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPAN = "({0} IS NULL OR coalesce({0}.char_start >= 0 AND {0}.char_end > {0}.char_start AND length({0}.quote) = {0}.char_end - {0}.char_start, false))"
_N, _R, _E = "coalesce(gold_norms, [])", "coalesce(exclusion_reasons, [])", "list_transform(coalesce(gold_evidence, []), lambda g: g.norm_id)"
_IF = "(annotation_status IS DISTINCT FROM 'verified' OR coalesce({0}, false))"
_UNIQUE = "len(list_distinct({0})) = len({0})"
_DUPLICATE = "coalesce(length(trim(duplicate_of)) > 0, false)"
_LABELS = ", ".join(f"'{x}'" for x in validation.ISSUE_TYPES)
_RULES = {
    "known_status": "coalesce(annotation_status IN ('draft', 'verified', 'excluded'), false)", "norms_unique": _UNIQUE.format(_N), "reasons_unique": _UNIQUE.format(_R), "evidence_unique": _UNIQUE.format(_E),
    **{f"verified_has_{c}": _IF.format(f"length(trim({c})) > 0") for c in ("complaint_argument_raw", "complaint_argument_blind", "notice_date", "issue_type")},
    **{f"verified_has_{c}": _IF.format(f"{c} IS NOT NULL") for c in ("complaint_argument_source", "outcome_evidence")},
    "verified_issue_known": _IF.format(f"issue_type IN ({_LABELS})"), "verified_is_upheld": _IF.format("outcome = 'upheld'"), "verified_no_bylaw": _IF.format("NOT coalesce(relies_on_bylaw, false)"),
    "verified_has_norms": _IF.format(f"len({_N}) > 0"), "evidence_is_of_norms": _IF.format(f"len(list_filter({_N}, lambda n: NOT list_contains({_E}, n))) + len(list_filter({_E}, lambda n: NOT list_contains({_N}, n))) = 0"),
    "verified_has_no_reason": _IF.format(f"len({_R}) = 0"), "verified_is_no_duplicate": _IF.format(f"NOT {_DUPLICATE}"), "other_has_reason": f"(annotation_status IS NOT DISTINCT FROM 'verified' OR len({_R}) > 0)",
    "duplicate_says_so": f"(NOT {_DUPLICATE} OR list_contains({_R}, 'duplicate_case'))",
    "source_span": _SPAN.format("complaint_argument_source"), "outcome_span": _SPAN.format("outcome_evidence"),
}

SQL = {
    "status_pivot": _EC + "SELECT coalesce(topic, '') AS topic, " + ", ".join(f"count_if(annotation_status = '{x}') AS {x}" for x in ("verified", "draft", "excluded")) + " FROM ec GROUP BY 1",
    "quotable_spans": _EC + "SELECT case_id, true AS sound FROM ec WHERE regexp_matches(complaint_argument_raw, '[\\p{L}\\p{N}]')",
    "streamed_terms": "SELECT term, count(DISTINCT doc_id) AS texts, count(*) AS occurrences FROM (SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN ['_empty'] ELSE t END) AS term FROM (SELECT doc_id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ё', 'е'), '[0-9a-zа-я]+') AS t FROM documents)) GROUP BY term",
    "page_units": r"""WITH b AS (SELECT block_id, any_value(page_id) AS page_id, any_value(block_order) AS o, any_value(text) AS t FROM blocks GROUP BY block_id),
        a AS (SELECT *, nullif(regexp_extract(coalesce(t, ''), '^Статья\s+(\d+(?:\.\d+)?)\.?\s*(.*)$', 1), '') AS art, coalesce(regexp_matches(t, '^Глава\s+\d+'), false) AS ch FROM b),
        c AS (SELECT *, CASE WHEN ch THEN '' ELSE art END AS op FROM a),
        d AS (SELECT *, count(op) OVER w AS an, nullif(last_value(op IGNORE NULLS) OVER w, '') AS article FROM c WINDOW w AS (PARTITION BY page_id ORDER BY o, block_id)),
        e AS (SELECT *, CASE WHEN article IS NOT NULL AND art IS NULL THEN nullif(regexp_extract(t, '^(\d+(?:\.\d+)?)\.\s', 1), '') END AS p0, CASE WHEN article IS NOT NULL AND art IS NULL THEN nullif(regexp_extract(t, '^(\d+(?:\.\d+)?)\)\s', 1), '') END AS q0 FROM d),
        f AS (SELECT *, count(p0) OVER w AS pn, last_value(p0 IGNORE NULLS) OVER w AS p1 FROM e WINDOW w AS (PARTITION BY page_id, an ORDER BY o, block_id)),
        g AS (SELECT *, last_value(q0 IGNORE NULLS) OVER (PARTITION BY page_id, an, pn ORDER BY o, block_id) AS point FROM f),
        h AS (SELECT page_id, article, point, CASE WHEN p1 IS NULL AND point IS NOT NULL THEN '0' ELSE p1 END AS part FROM g WHERE article IS NOT NULL)
        SELECT page_id, count(DISTINCT article) AS articles, count(DISTINCT CASE WHEN part IS NOT NULL THEN article || '|' || part END) AS parts, count(DISTINCT CASE WHEN point IS NOT NULL THEN article || '|' || part || '|' || point END) AS points FROM h GROUP BY page_id""",
    "citation_flags": _EC + rf"SELECT case_id, regexp_matches(lower(complaint_argument_blind), '{_CITES}') AS cites, len(list_distinct(regexp_extract_all(lower(complaint_argument_blind), '[\p{{L}}\p{{Nd}}\p{{M}}\p{{Pc}}]+'))) >= 100 AS long, complaint_argument_blind = coalesce(complaint_argument_raw, '') AS same_as_raw FROM ec WHERE complaint_argument_blind IS NOT NULL",
    "release_labels": _EC + r"""SELECT case_id, split, CASE WHEN split <> 'eval' THEN issue_type END AS issue_type, CASE WHEN split <> 'eval' THEN outcome END AS outcome,
        length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(doc_fragment, chr(160), ' '), '\r\n?', chr(10), 'g'), '[ \t\f\x{0b}]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS fragment_chars FROM ec""",
    "document_windows": rf"""WITH RECURSIVE w AS (
        SELECT doc_id, text, 0 AS i, 0 AS j, 0 AS n FROM documents WHERE length(text) > 700
        UNION ALL SELECT doc_id, text, b, CASE WHEN e < length(text) AND sp > 0 AND b + 350 + length(s) - sp > b THEN b + 350 + length(s) - sp ELSE e END, n + 1 FROM (
            SELECT *, strpos(reverse(s), ' ') AS sp FROM (SELECT *, substring(text, b + 351, e - b - 350) AS s FROM (SELECT *, least(b + 700, length(text)) AS e FROM (SELECT doc_id, text, n, j, CASE WHEN n = 0 THEN 0 ELSE greatest(j - 200, i + 1) END AS b FROM w WHERE j < length(text)))))),
        p AS (SELECT doc_id, n, i, substring(text, i + 1, j - i) AS t FROM w WHERE n > 0 UNION ALL SELECT doc_id, 1, 0, text FROM documents WHERE length(text) <= 700),
        x AS (SELECT doc_id, n, i, t, regexp_extract(t, '(?s)[^{SPACE}](?:.*[^{SPACE}])?') AS body, regexp_extract(t, '^[{SPACE}]*') AS head, length(d.text) <= 700 AS whole FROM p JOIN documents d USING (doc_id)),
        y AS (SELECT doc_id, n, CASE WHEN whole THEN i ELSE i + length(head) END AS a, CASE WHEN whole THEN t ELSE body END AS piece FROM x WHERE length(body) > 0)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS place, a AS char_start, a + length(piece) AS char_end, piece FROM y""",
    "law_stats": _EC + "SELECT split_part(norm_id, ':', 1) AS law_id, count_if(unit_level = 'article') AS articles, count_if(unit_level = 'part') AS parts, count_if(unit_level = 'point') AS points, count_if(is_repealed) AS repealed, count_if(is_retrieval_unit) AS retrieval_units, sum(length(text)) AS chars FROM nu GROUP BY 1",
    "unit_id_check": _EC + "SELECT unit_level, count(*) AS units, count_if(built IS DISTINCT FROM norm_id) AS wrong, max(built) AS last_id FROM (SELECT norm_id, unit_level, concat_ws(':', split_part(norm_id, ':', 1), edition_id, 'art.' || article, 'ch.' || part, CASE WHEN part IS NOT NULL THEN 'p.' || point END) AS built FROM nu) GROUP BY unit_level",
    "unit_lineage": _EC + "SELECT unit_level, count(*) AS units, count(parent_norm_id) AS with_parent_id, count(CASE WHEN parent_norm_id IN (SELECT norm_id FROM nu) THEN 1 END) AS with_parent_row FROM nu GROUP BY unit_level",
    "case_rule_report": _EC + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS cases, count_if(NOT {c}) AS broken FROM ec" for n, c in _RULES.items()),
    "missing_norms": _EC + ", w AS (SELECT case_id, annotation_status, list_distinct(list_concat(gold_norms, list_transform(gold_norms, lambda n: upper(n)))) AS g FROM ec), m AS (SELECT DISTINCT case_id, n FROM (SELECT case_id, unnest(g) AS n FROM w) WHERE n NOT IN (SELECT norm_id FROM norm_units)) SELECT annotation_status, CAST(sum(coalesce(len(g), 0)) AS BIGINT) AS wanted, (SELECT count(*) FROM m JOIN ec USING (case_id) WHERE ec.annotation_status IS NOT DISTINCT FROM w.annotation_status) AS missing FROM w GROUP BY annotation_status",
    "split_groups": _EC + "SELECT case_group_id AS group_id, count(DISTINCT split) AS splits, count(*) AS cases FROM ec WHERE case_group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "split_policy": _EC + "SELECT CAST(sum(n) AS BIGINT) AS cases, CAST(sum(e) AS BIGINT) AS eval_cases, CAST(round_even(sum(n) * 0.3::DOUBLE, 0) AS BIGINT) AS wanted, count_if(n >= 2 AND (e = 0 OR d = 0)) AS uneven_topics FROM (SELECT topic, count_if(split = 'eval') AS e, count_if(split = 'dev') AS d, count(*) AS n FROM ec GROUP BY topic)",
    "edition_at_notice": _EC + "SELECT case_id, x.law_id, day, edition_id AS edition_in_force FROM (SELECT DISTINCT case_id, day, split_part(n, ':', 1) AS law_id FROM (SELECT case_id, strftime(try_cast(notice_date AS DATE), '%Y-%m-%d') AS day, unnest(gold_norms) AS n FROM ec WHERE try_cast(notice_date AS DATE) IS NOT NULL)) x JOIN ep ON ep.law_id = x.law_id AND start <= day AND day < until",
    "public_ids": _EC + "SELECT case_id, true AS sound, substr(sha256(coalesce(complaint_argument_raw, '')), 1, 16) AS fingerprint FROM ec",
    "manifest": _EC + "SELECT split, count(*) AS cases, count_if(annotation_status = 'verified') AS verified, sha256(string_agg(case_id, chr(10) ORDER BY case_id)) AS sha256 FROM ec GROUP BY split",
    "chunk_faults": _EC + "SELECT chunk_id AS key, 'too_long' AS rule FROM ck WHERE NOT coalesce(length(text) <= coalesce(max_chunk, 1073741824), false) UNION ALL SELECT chunk_id, 'offsets' FROM ck WHERE NOT coalesce(length(text) = char_end - char_start, false) UNION ALL SELECT chunk_id, 'no_size' FROM ck WHERE max_chunk IS NULL",
    "chunk_units": _EC + r"SELECT chunk_id, count(*) AS units, string_agg(norm_id, '|' ORDER BY u.char_start, u.char_end, norm_id) AS norm_ids FROM ck JOIN nu u ON NOT u.is_repealed AND regexp_extract(ck.norm_ids[1], '^([^:]*:[^:]*)', 1) = regexp_extract(u.norm_id, '^([^:]*:[^:]*)', 1) AND u.char_start < ck.char_end AND ck.char_start < u.char_end WHERE ck.char_end > ck.char_start GROUP BY chunk_id",
    "chunk_coverage": _EC + """, pc AS (SELECT DISTINCT unnest(norm_ids) AS norm_id, chunk_id, char_start, char_end FROM ck), sp AS (SELECT norm_id, char_start AS s, char_end AS e FROM nu WHERE norm_id IN (SELECT norm_id FROM pc)),
        x AS (SELECT sp.norm_id, s, e, greatest(s, pc.char_start) AS a, CASE WHEN greatest(s, pc.char_start) < least(e, pc.char_end) THEN least(e, pc.char_end) END AS b FROM sp JOIN pc USING (norm_id)),
        y AS (SELECT *, max(b) OVER (PARTITION BY norm_id ORDER BY a, b NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x)
        SELECT norm_id, CASE WHEN any_value(e) > any_value(s) THEN round(sum(coalesce(greatest(0, b - greatest(a, coalesce(m, a))), 0)) / CAST(any_value(e - s) AS DOUBLE), 6) ELSE 0.0 END AS covered FROM y GROUP BY norm_id""",
}
