"""What a record must satisfy before it is published, and the texts that a release shows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import ids, text
from spanforge.operators.anonymize import scan
from spanforge.operators.corpus import intersecting_units, window_rows
from spanforge.operators.validation import span_is_sound

# Keys that name private sources, and what a private or local path looks like.
PRIVATE_KEYS = ("doc_paths", "path", "source_path", "local_path", "annotator")
PATH_MARKS = ("file://", "/home/", "/Users/", "C:\\", "data/raw")
HIDDEN_LABELS = ("gold_norms", "gold_evidence", "issue_type", "outcome")


def walked(record: str | None) -> list[tuple[str, str, str | None]]:
    """(location, key, text) of every member of a JSON object, however deep; text is null for what is no string."""
    out: list[tuple[str, str, str | None]] = []
    open_ = [("record", json.loads(record))] if record else []
    while open_:
        at, value = open_.pop()
        if isinstance(value, list):
            open_ += [(f"{at}[{n}]", x) for n, x in reversed(list(enumerate(value)))]
        elif isinstance(value, dict):
            for key, x in value.items():
                out.append((f"{at}.{key}", key, x if isinstance(x, str) else None))
                open_.append((f"{at}.{key}", x))
    return out


def private_members(rows: DataFrame, key: str, private: tuple[str, ...] = PRIVATE_KEYS, marks: tuple[str, ...] = PATH_MARKS) -> DataFrame:
    """(key, location, rule): members of the records, nested ones too, with a private key or a text that shows a path.

    Members that are null count as absent; ``key`` itself is a member like any other.
    """
    key_type = rows.schema[key].dataType.simpleString()

    def check(batches):
        for b in batches:
            found = []
            for k, record in zip(b["key"], b["record"]):
                for location, name, value in walked(record):
                    if name in private:
                        found.append((k, location, "private_key"))
                    if value is not None and any(m in value for m in marks):
                        found.append((k, location, "private_path"))
            yield pd.DataFrame(found, columns=["key", "location", "rule"])

    records = rows.select(F.col(key).alias("key"), F.to_json(F.struct(*rows.columns)).alias("record"))
    return records.mapInPandas(check, f"key {key_type}, location string, rule string").withColumnRenamed("key", key)


def release_rules(texts: tuple[str, ...]) -> dict[str, Column]:
    """The rules of a public record: version, split, ids, texts that are there, and no labels in the eval split."""
    there = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    hidden = [F.col(c).isNull() for c in HIDDEN_LABELS]
    none_shown = hidden[0]
    for h in hidden[1:]:
        none_shown = none_shown & h
    rules = {"version": F.col("schema_version") == 1, "split": F.coalesce(F.col("split").isin("dev", "eval"), F.lit(False))}
    rules |= {f"has_{c}": there(c) for c in ("case_id", "case_group_id", "edition_id", "topic", *texts)}
    return rules | {"eval_labels_hidden": (F.col("split") != "eval") | none_shown}


def residual(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, kind, spans): personal data that the rules still find in the fields; null texts have none."""
    found = F.pandas_udf(lambda column: pd.Series([[k for k, *_ in scan(t)] for t in column]), "array<string>")
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("t")) for f in fields))).alias("p")
    kinds = rows.select(F.col(key), parts).select(key, "p.field", F.explode(found(F.col("p.t"))).alias("kind"))
    return kinds.groupBy(key, "field", "kind").agg(F.count("*").alias("spans"))


def clean_again(anonymised: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, clean): whether a second scan of the anonymised fields finds nothing."""
    left = residual(anonymised, key, fields).select(key).distinct().withColumn("_left", F.lit(True))
    return anonymised.select(key).join(left, key, "left").select(key, F.col("_left").isNull().alias("clean"))


def outgoing(rows: DataFrame, column: str, into: str = "outgoing") -> DataFrame:
    """``rows`` with a text that may leave: paths masked and personal data replaced; null where a second scan still finds some."""
    from spanforge.operators.anonymize import replaced

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        masked = pd.Series([t]).str.replace(r"(?:file://|/home/|/Users/|[A-Z]:\\)\S*", "<PATH>", regex=True)[0]
        out = replaced([masked])[0][0]
        return None if scan(out) else out

    return rows.withColumn(into, F.pandas_udf(lambda c: pd.Series([one(t) for t in c], dtype=object), "string")(F.col(column)))


def publishable(cases: DataFrame) -> DataFrame:
    """(case_id, field, text): the texts of a case that a release shows, evidence quotes numbered from 0; null texts are left out."""
    plain = [F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("complaint_argument_raw", "complaint_argument_blind", "complaint_argument_summary", "doc_fragment")]
    spans = [F.struct(F.lit(f"{c}.quote").alias("field"), F.col(f"{c}.quote").alias("text")) for c in ("complaint_argument_source", "outcome_evidence")]
    quotes = F.transform("gold_evidence", lambda g, n: F.struct(F.concat(F.lit("gold_evidence["), n.cast("string"), F.lit("].quote")).alias("field"), g["decision_span"]["quote"].alias("text")))
    every = F.concat(F.array(*plain, *spans), F.coalesce(quotes, F.array().cast("array<struct<field:string,text:string>>")))
    return cases.select("case_id", F.explode(every).alias("t")).select("case_id", "t.*").filter("text is not null")


def query_variants(cases: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(case_id, variant, text, missing): each wording of a query; a null or blank one is marked, not passed over."""
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(c).alias("text")) for v, c in columns.items()))).alias("v")
    return cases.select("case_id", rows).select("case_id", "v.*", F.coalesce(F.length(F.trim("v.text")) == 0, F.lit(True)).alias("missing"))


def rank_tags(cases: DataFrame, crowded: DataFrame) -> DataFrame:
    """(case_id, tags): long (100 words or more), short (20 or fewer), raw_equals_blind, multi_gold, crowding (two repeated places or more), citation_sensitive.

    ``crowded`` is (case_id, slots); tags are joined by "," in this order.
    """
    words = F.size(F.filter(F.split(F.trim("complaint_argument_blind"), r"\s+"), lambda w: w != ""))
    c = cases.join(crowded, "case_id", "left")
    tags = {
        "long": words >= 100, "short": words <= 20, "raw_equals_blind": F.col("complaint_argument_raw") == F.col("complaint_argument_blind"), "multi_gold": F.size("gold_norms") > 1,
        "crowding": F.col("slots") >= 2, "citation_sensitive": text.contains_direct_citation(F.col("complaint_argument_raw")),
    }
    return c.select("case_id", F.array_join(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tags.items()))), ",").alias("tags"))


def span_faults(cases: DataFrame) -> DataFrame:
    """(case_id, field): spans that end before they begin or are not as long as their quote."""
    own = [F.struct(F.lit(c).alias("field"), F.col(c).alias("span")) for c in ("complaint_argument_source", "outcome_evidence")]
    of_span = cases.schema["complaint_argument_source"].dataType.simpleString()
    gold = F.transform("gold_evidence", lambda g, n: F.struct(F.concat(F.lit("gold_evidence["), n.cast("string"), F.lit("]")).alias("field"), g["decision_span"].alias("span")))
    every = F.concat(F.array(*own), F.coalesce(gold, F.array().cast(f"array<struct<field:string,span:{of_span}>>")))
    return cases.select("case_id", F.explode(every).alias("e")).filter(~span_is_sound(F.col("e.span"))).select("case_id", "e.field")


def titled_chunks(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """(chunk_id, text, article_title_prefix): chunks under the title of their first article, by id, that has one.

    ``titles`` is (edition, article, title), one row each; ``chunks`` (chunk_id, text, norm_ids).
    """
    edition = F.regexp_extract("n", "^[^:]*:([^:]*)", 1)
    named = chunks.select("chunk_id", F.explode("norm_ids").alias("n")).select("chunk_id", edition.alias("edition"), ids.article_key(F.col("n")).alias("article")).distinct()
    first = named.join(titles.filter("length(title) > 0"), ["edition", "article"]).groupBy("chunk_id").agg(F.min(F.struct("article", "title")).alias("t"))
    rows = chunks.join(first, "chunk_id", "left")
    return rows.select("chunk_id", F.when(F.col("t").isNotNull(), F.concat("t.title", F.lit(".\n"), "text")).otherwise(F.col("text")).alias("text"), F.col("t").isNotNull().alias("article_title_prefix"))


def unit_faults(units: DataFrame) -> DataFrame:
    """(norm_id, rule): units without a text, with a span that is none or lies outside their parent's, or whose parent is not there."""
    known = units.select(F.col("norm_id").alias("parent_norm_id"), F.col("char_start").alias("_ps"), F.col("char_end").alias("_pe"), F.lit(True).alias("_there"))
    rows = units.join(known, "parent_norm_id", "left")
    rules = {
        "empty_text": F.coalesce(F.length(F.trim("text")) == 0, F.lit(True)), "no_span": ~F.coalesce((F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")), F.lit(False)),
        "outside_parent": F.col("_there") & ((F.col("char_start") < F.col("_ps")) | (F.col("char_end") > F.col("_pe"))), "no_parent": F.col("parent_norm_id").isNotNull() & F.col("_there").isNull(),
    }
    marks = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
    return rows.select("norm_id", F.explode(marks).alias("rule"))


def fixed_window_chunks(texts: DataFrame, units: DataFrame, size: int, overlap: int) -> DataFrame:
    """(edition, chunk_id, norm_ids, char_start, char_end, piece): windows over whole editions with the live units that they meet.

    ``texts`` is (edition, text), ``units`` (edition, norm_id, char_start, char_end, is_repealed).  Windows that meet no unit are left out, and the
    others numbered in the order of their places.
    """
    pieces = window_rows(texts, "edition", "text", size, overlap).withColumn("_w", F.concat_ws("|", "edition", "place"))
    met = intersecting_units(pieces, units.filter(~F.coalesce("is_repealed", F.lit(False))), "edition", "_w")
    w = Window.partitionBy("edition").orderBy("place")
    rows = pieces.join(met, ["edition", "_w"]).withColumn("_n", F.row_number().over(w))
    return rows.select("edition", F.format_string("win_%s_%05d", "edition", "_n").alias("chunk_id"), "norm_ids", "char_start", "char_end", "piece")
