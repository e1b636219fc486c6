"""Rules on records: each yields rows (key, rule) for what breaks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken_rules(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule whose condition is not true; an unknown condition is a broken one."""
    marks = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(F.col(key).alias("key"), F.explode(marks).alias("rule"))


def span_is_sound(span: Column) -> Column:
    """A span starts at 0 or later, ends past its start and is as long as its quote; a null span is sound."""
    return span.isNull() | F.coalesce((span["char_start"] >= 0) & (span["char_end"] > span["char_start"]) & (F.length(span["quote"]) == span["char_end"] - span["char_start"]), F.lit(False))


# The labels that a verified case may have.
ISSUE_TYPES = """restrictive_object_description defective_object_description unrelated_items_in_one_lot improper_participant_requirements rejection_product_or_information
rejection_documents_or_qualification other_unlawful_rejection unlawful_admission inconsistent_procurement_documents electronic_procedure_failure contract_conclusion_violation
statutory_preference_violation other unclear""".split()


def case_rules() -> dict[str, Column]:
    """The rules of a case: what is unique, what a verified case must and must not have, and why another one is left out."""
    status = F.col("annotation_status")
    texts = F.array().cast("array<string>")
    norms, reasons = F.coalesce("gold_norms", texts), F.coalesce("exclusion_reasons", texts)
    covered = F.coalesce(F.transform("gold_evidence", lambda g: g["norm_id"]), texts)
    if_verified = lambda ok: ~status.eqNullSafe("verified") | F.coalesce(ok, F.lit(False))
    there = lambda c: F.length(F.trim(c)) > 0
    unique = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    duplicate = F.coalesce(there("duplicate_of"), F.lit(False))
    return {
        "known_status": status.isin("draft", "verified", "excluded"), "norms_unique": unique(norms), "reasons_unique": unique(reasons), "evidence_unique": unique(covered),
        **{f"verified_has_{c}": if_verified(there(c)) for c in ("complaint_argument_raw", "complaint_argument_blind", "notice_date", "issue_type")},
        **{f"verified_has_{c}": if_verified(F.col(c).isNotNull()) for c in ("complaint_argument_source", "outcome_evidence")},
        "verified_issue_known": if_verified(F.col("issue_type").isin(ISSUE_TYPES)), "verified_is_upheld": if_verified(F.col("outcome") == "upheld"), "verified_no_bylaw": if_verified(~F.coalesce("relies_on_bylaw", F.lit(False))),
        "verified_has_norms": if_verified(F.size(norms) > 0), "evidence_is_of_norms": if_verified((F.size(F.array_except(norms, covered)) == 0) & (F.size(F.array_except(covered, norms)) == 0)),
        "verified_has_no_reason": if_verified(F.size(reasons) == 0), "verified_is_no_duplicate": if_verified(~duplicate), "other_has_reason": status.eqNullSafe("verified") | (F.size(reasons) > 0),
        "duplicate_says_so": ~duplicate | F.array_contains(reasons, "duplicate_case"),
        "source_span": span_is_sound(F.col("complaint_argument_source")), "outcome_span": span_is_sound(F.col("outcome_evidence")),
    }


def rule_report(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, cases, broken) for every rule, those that nothing breaks too, in one pass."""
    counts = rows.agg(F.count("*").alias("cases"), *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return counts.select("cases", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules))).alias("r")).select("r.rule", "cases", "r.broken")


def draft_refusals(drafts: DataFrame, fragments: DataFrame, norms: DataFrame, chunks: DataFrame, least: int = 20) -> DataFrame:
    """(request_id, reason, doc_quote, doc_start, doc_end, norm_quote): the first rule that each draft breaks, or its checked quotes.

    ``drafts``: request_id, edition_id, decision, remark_text, source_fragment_id, doc_span_id, norm_chunk_id, norm_id, norm_span_id; ``fragments``: request_id, fragment_id, role,
    char_start, char_end, text, source_text; ``norms``: norm_id, edition_id, is_repealed, text; ``chunks``, the evidence shown: request_id, chunk_id, norm_ids, text.
    A null member of a draft is a missing one.
    """
    from spanforge.functions.quotes import contains_quote, quote_candidates

    f = fragments.select("request_id", F.col("fragment_id").alias("source_fragment_id"), F.lit(True).alias("_f"), "role", "char_start", F.col("text").alias("_ft"), F.substring("source_text", 1, 1 << 30).alias("_st"), "char_end")
    n = norms.select("norm_id", F.col("edition_id").alias("_ne"), F.coalesce("is_repealed", F.lit(False)).alias("_nr"), F.col("text").alias("_nt"))
    c = chunks.select("request_id", F.col("chunk_id").alias("norm_chunk_id"), "norm_ids", F.col("text").alias("_ct"))
    rows = drafts.join(f, ["request_id", "source_fragment_id"], "left").join(n, "norm_id", "left").join(c, ["request_id", "norm_chunk_id"], "left")
    named = lambda text, span: F.get(F.filter(quote_candidates(F.col(text)), lambda s: s["span_id"] == F.col(span)), F.lit(0))
    rows = rows.withColumn("_ds", named("_ft", "doc_span_id")).withColumn("_ns", named("_ct", "norm_span_id"))
    at = F.col("char_start") + F.col("_ds.char_start")
    whole = lambda col: F.length(F.trim(col)) > 0
    reason = first_refusal([
        ("model_abstained", F.col("decision") == "remark"), ("incomplete_remark", whole("remark_text") & whole("source_fragment_id") & whole("norm_id")), ("unknown_source_fragment", F.col("_f")),
        ("doc_quote_not_claim_evidence", F.col("role") == "claim"), ("doc_span_not_in_fragment", F.col("_ds").isNotNull()), ("source_changed", F.col("_st").substr(F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("_ft")),
        ("doc_quote_not_in_source", F.col("_st").substr(at + 1, F.length("_ds.text")) == F.col("_ds.text")), ("unknown_or_wrong_edition_norm", (F.col("_ne") == F.col("edition_id")) & ~F.col("_nr")),
        ("norm_not_exposed", F.array_contains("norm_ids", F.col("norm_id"))), ("norm_span_not_in_evidence", F.col("_ns").isNotNull()), ("quote_too_short", F.least(F.length(F.trim("_ds.text")), F.length(F.trim("_ns.text"))) >= least),
        ("norm_quote_not_in_unit", contains_quote(F.col("_ns.text"), F.col("_nt"))), ("norm_quote_not_in_evidence", F.col("_ct").substr(F.col("_ns.char_start") + 1, F.length("_ns.text")) == F.col("_ns.text")),
    ])
    kept = lambda x, name: F.when(F.col("reason").isNull(), x).alias(name)
    return rows.withColumn("reason", reason).select("request_id", "reason", kept(F.col("_ds.text"), "doc_quote"), kept(at, "doc_start"), kept(at + F.length("_ds.text"), "doc_end"), kept(F.col("_ns.text"), "norm_quote"))


def missing_references(rows: DataFrame, key: str, ids: str, known: DataFrame, known_id: str) -> DataFrame:
    """(key, missing) for every id of the array ``ids`` that ``known`` lacks."""
    wanted = rows.select(F.col(key).alias("key"), F.explode(ids).alias("missing")).distinct()
    return wanted.join(known.select(F.col(known_id).alias("missing")).distinct(), "missing", "left_anti")


def groups_across_splits(rows: DataFrame, group: str, split: str) -> DataFrame:
    """(group, splits, cases) of groups that stand in more than one split; null groups are none."""
    return rows.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_id")).agg(F.countDistinct(split).alias("splits"), F.count("*").alias("cases")).filter("splits > 1")


def split_policy(rows: DataFrame, split: str, topic: str, share: float = 0.3) -> DataFrame:
    """One row: cases, those in the eval split, the number wanted (halves to even), and topics that a split lacks."""
    per = rows.groupBy(topic).agg(F.count_if(F.col(split) == "eval").alias("e"), F.count_if(F.col(split) == "dev").alias("d"), F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("cases"), F.sum("e").alias("eval_cases"), F.bround(F.sum("n") * share, 0).cast("long").alias("wanted"),
        F.count_if((F.col("n") >= 2) & ((F.col("e") == 0) | (F.col("d") == 0))).alias("uneven_topics"),
    )


def checksums(files: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, state): ok, changed, missing or unlisted, of binary files (path, content) against (path, sha256); unsafe paths are refused."""
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    own = files.select("path", F.sha2("content", 256).alias("own"))
    rows = listed.select("path", "sha256").join(own, "path", "full")
    return rows.select("path", F.when(unsafe, "refused").when(F.col("own").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("own") == F.lower("sha256"), "ok").otherwise("changed").alias("state"))


def first_refusal(conditions: list[tuple[str, Column]]) -> Column:
    """The code of the first condition that is not met, in order; null where all are."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in conditions))
