"""The pN_ queries over the project's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import lookalike
from spanforge.functions.latest import latest
from spanforge.llm import boilerplate, cross_split, grouped_splits, leaks, lookalikes, packing, personal, reading_level, splitting
from spanforge.session import secret, table


def _p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """(field, row_key, version, text) of all texts of the problem."""
    norms = table(spark, d, "norm_units").select(F.lit("norm_units.text").alias("field"), F.col("norm_id").alias("row_key"), F.col("loaded_at").alias("version"), "text")
    blocks = table(spark, d, "blocks").select(F.lit("blocks.text").alias("field"), F.col("block_id").alias("row_key"), F.lit(None).cast("timestamp").alias("version"), "text")
    quotes = F.array_union(
        F.array(
            F.struct(F.lit("complaint_argument_source.quote").alias("field"), F.col("complaint_argument_source.quote").alias("text")),
            F.struct(F.lit("outcome_evidence.quote").alias("field"), F.col("outcome_evidence.quote").alias("text")),
        ),
        F.coalesce(F.transform("gold_evidence", lambda g: F.struct(F.lit("gold_evidence.decision_span.quote").alias("field"), g["decision_span"]["quote"].alias("text"))), F.array().cast("array<struct<field:string,text:string>>")),
    )
    cases = table(spark, d, "eval_cases").select(F.col("case_id").alias("row_key"), F.col("loaded_at").alias("version"), F.explode(quotes).alias("q"))
    return norms.unionByName(blocks).unionByName(cases.select("q.field", "row_key", "version", "q.text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose canonical form differs; of a key's rows the latest counts."""
    texts = _p7_texts(spark, d)
    changed = lookalikes.canonical_texts(texts, "text", changed_only=True).select("field", "row_key", "version").distinct()
    current = texts.filter("version is not null").groupBy("field", "row_key").agg(F.max("version").alias("version"))
    return changed.filter("version is null").select("field", "row_key").unionByName(changed.join(current, ["field", "row_key", "version"]).select("field", "row_key"))


def split_limits(spark: SparkSession, d: str, purpose: str, most: int = 1000) -> list[tuple[int, int]]:
    """(max_size, overlap_size) of a purpose, smallest first; the table is a list of settings and checked to be one."""
    rows = table(spark, d, "size_limits").filter((F.col("purpose") == purpose) & (F.col("max_size") > 0)).select("max_size", F.coalesce("overlap_size", F.lit(0))).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"size_limits holds more than {most} settings")
    return sorted((int(a), int(b)) for a, b in rows)


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every unit in force that exceeds a limit, char_start counting in its edition."""
    units = latest(table(spark, d, "norm_units"), ["norm_id"], "loaded_at", ["text", "char_start", "is_repealed"])
    return splitting.split_texts(units.filter(~F.coalesce("is_repealed", F.lit(False))), "norm_id", "text", split_limits(spark, d, "split"), "char_start")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).filter("piece_no = 0").select("norm_id", "max_chunk")


def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """Per cut unit and limit: whether all pieces fit, share exactly the overlap and rebuild the text."""
    units = latest(table(spark, d, "norm_units"), ["norm_id"], "loaded_at", ["text", "char_start", "is_repealed"]).filter(~F.coalesce("is_repealed", F.lit(False)))
    limits = split_limits(spark, d, "split")
    overlap = F.create_map(*(F.lit(x) for size, o in limits for x in (size, o)))[F.col("max_chunk")] if limits else F.lit(0)
    w = Window.partitionBy("norm_id", "max_chunk").orderBy("piece_no")
    pieces = splitting.split_texts(units, "norm_id", "text", limits, "char_start").withColumn("shared", F.lag("char_end").over(w) - F.col("char_start"))
    own = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.col("piece").substr(F.col("shared").cast("int") + 1, F.length("piece")))
    whole = pieces.groupBy("norm_id", "max_chunk").agg(
        (F.max(F.length("piece")) <= F.first("max_chunk")).alias("fits"), F.coalesce(F.bool_and(F.col("shared") == overlap), F.lit(True)).alias("overlaps"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", own.alias("own")))), lambda p: p["own"]), ""), 256).alias("digest"),
    )
    return whole.join(units.select("norm_id", F.sha2("text", 256).alias("of_text")), "norm_id").select("norm_id", "max_chunk", "fits", "overlaps", (F.col("digest") == F.col("of_text")).alias("rebuilt"))


def _p4_judged(spark: SparkSession, d: str) -> DataFrame:
    pages = latest(table(spark, d, "pages"), ["page_id"], "fetched_at", ["site"])
    return boilerplate.judged_blocks(table(spark, d, "blocks"), "block_id", "page_id", "kind", "text", pages, "site")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4_judged(spark, d).filter("is_frame").select("block_id")


def p4_main(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of the main body of each page with their place in it."""
    blocks = latest(table(spark, d, "blocks"), ["block_id"], None, ["page_id", "block_order", "text"])
    w = Window.partitionBy("page_id").orderBy("block_order", "block_id")
    main = blocks.join(_p4_judged(spark, d).filter("not is_frame").select("block_id"), "block_id")
    return main.select("page_id", F.row_number().over(w).alias("place"), "block_id", "text")


def _p5_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cases = latest(table(spark, d, "eval_cases"), ["case_id"], "loaded_at", ["case_group_id", "procurement_id", "procurement_url", "fas_decision_id", "duplicate_of", "topic"])
    of = lambda kind, c: F.concat(F.lit(kind), grouped_splits.link_value(c))
    number = F.regexp_extract("procurement_url", r"(?i)regNumber=([^&#\s]+)", 1)
    keys = F.array(
        of("group ", F.col("case_group_id")), of("purchase ", F.col("procurement_id")), of("purchase ", number),
        of("decision ", F.col("fas_decision_id")), of("case ", F.col("case_id")), of("case ", F.col("duplicate_of")),
    )
    return cases, cases.select("case_id", F.explode(keys).alias("key"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    _, links = _p5_links(spark, d)
    return grouped_splits.components(links, "case_id", "key").filter("root <> case_id").select(F.col("root").alias("root_case_id"), "case_id")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """A train, validation or test split for every case, linked cases together."""
    cases, links = _p5_links(spark, d)
    roots = grouped_splits.components(links, "case_id", "key")
    members = cases.select("case_id", "topic").join(roots, "case_id")
    return grouped_splits.grouped_splits(members, "case_id", "root", "topic", {"train": 0.8, "validation": 0.1, "test": 0.1})


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """How many cases have a split, and whether each has one and linked ones have the same."""
    placed = p5_splits(spark, d)
    of = Window.partitionBy("root")
    together = placed.withColumn("same", F.min("split").over(of) == F.max("split").over(of))
    return together.agg(F.countDistinct("case_id").alias("cases"), (F.count("*") == F.countDistinct("case_id")).alias("placed_once"), F.bool_and("same").alias("linked_together"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per topic and split: its cases and their share of the topic's."""
    cases = latest(table(spark, d, "eval_cases"), ["case_id"], "loaded_at", ["topic"]).select("case_id", F.coalesce("topic", F.lit("")).alias("topic"))
    counted = p5_splits(spark, d).join(cases, "case_id").groupBy("topic", "split").agg(F.count("*").alias("cases"))
    return counted.withColumn("share", F.round(F.col("cases") / F.sum("cases").over(Window.partitionBy("topic")), 4))


def _p3_records(spark: SparkSession, d: str) -> DataFrame:
    cases = latest(table(spark, d, "eval_cases"), ["case_id"], "loaded_at", ["split", "topic", "complaint_argument_raw"])
    return cases.withColumn("split", F.lower(F.regexp_replace("split", r"\s", ""))).filter(F.col("split").isin("dev", "eval"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members, linked, _ = cross_split.overlap_report(_p3_records(spark, d), "case_id", "split", "complaint_argument_raw")
    return cross_split.member_pairs(members, linked).select(F.col("key_1").alias("case_id_1"), F.col("key_2").alias("case_id_2"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per split and topic: cases, those that stand in the other split too, and their pairs."""
    records = _p3_records(spark, d)
    members, linked, _ = cross_split.overlap_report(records, "case_id", "split", "complaint_argument_raw")
    pairs = cross_split.partner_counts(members, linked).filter("partners > 0").select(F.col("key").alias("case_id"), F.col("partners").alias("pairs"))
    joined = records.select("case_id", "split", F.coalesce("topic", F.lit("")).alias("topic")).join(pairs, "case_id", "left")
    return joined.groupBy("split", "topic").agg(F.count("*").alias("cases"), F.count("pairs").alias("overlapping_cases"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def _p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, field, item_no, text) of all texts of the problem, the latest row of each case."""
    cases = latest(table(spark, d, "eval_cases"), ["case_id"], "loaded_at", ["complaint_argument_raw"])
    public = latest(table(spark, d, "public_cases"), ["case_id"], "loaded_at", ["doc_fragment", "gold_evidence"])
    raw = cases.select("case_id", F.lit("complaint_argument_raw").alias("field"), F.lit(-1).alias("item_no"), F.col("complaint_argument_raw").alias("text"))
    part = public.select("case_id", F.lit("doc_fragment").alias("field"), F.lit(-1).alias("item_no"), F.col("doc_fragment").alias("text"))
    quotes = public.select("case_id", F.posexplode("gold_evidence").alias("item_no", "e"))
    quoted = quotes.select("case_id", F.lit("decision_quote").alias("field"), "item_no", F.col("e.decision_quote").alias("text"))
    return raw.unionByName(part).unionByName(quoted)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_data(_p6_texts(spark, d), "text").select("case_id", "field", "item_no", "kind", "char_start", "char_end")


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The same texts with typed placeholders; the key is the session's (``session.secret``)."""
    return personal.redacted(_p6_texts(spark, d), "text", secret(spark, "pseudonyms")).select("case_id", "field", "item_no", "redacted")


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """Per text, whether its redacted form is the text with its pieces replaced and nothing else, and holds no mail address or phone."""
    texts = personal.redacted(personal.with_pieces(_p6_texts(spark, d), "text", "pieces"), "text", secret(spark, "pseudonyms"))
    mark = r"\[(?:EMAIL|SNILS|TAX_ID|PASSPORT|PHONE|ADDRESS|PERSON|BIRTH_DATE):[^\]]*\]"
    step = lambda at, p: F.struct(F.concat(at["kept"], F.substring("text", at["upto"] + 1, p["char_start"] - at["upto"])).alias("kept"), p["char_end"].alias("upto"))
    rest = F.aggregate("pieces", F.struct(F.lit("").alias("kept"), F.lit(0).alias("upto")), step, lambda at: F.concat(at["kept"], F.col("text").substr(at["upto"] + 1, F.length("text"))))
    kept = F.regexp_replace("redacted", mark, "")
    return texts.select("case_id", "field", "item_no", F.col("text").isNull().alias("is_null"), F.coalesce(kept == rest, F.lit(True)).alias("rest_unchanged"), (~F.coalesce(kept.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]"), F.lit(False))).alias("no_mail"))


def tokenizer_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Place and splitting pattern of a public tokenizer; SPANFORGE_TOKENIZER names another file of ranks."""
    import public_tokenizers

    return os.environ.get("SPANFORGE_TOKENIZER") or str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each `pack` capacity."""
    counted = packing.token_counts(table(spark, d, "documents"), "doc_id", "text", *tokenizer_file())
    return packing.containers(counted, "doc_id", "n_tokens", [c for c, _ in split_limits(spark, d, "pack")])


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers, tokens, and the share of the containers' room that is used."""
    placed = p8_containers(spark, d).withColumn("n", F.col("token_end") - F.col("token_start"))
    return placed.groupBy("capacity").agg(
        F.countDistinct("container").alias("containers"), F.sum("n").alias("tokens"), F.round(F.sum("n") / (F.countDistinct("container") * F.first("capacity")), 4).alias("fill")
    )


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: documents placed, and whether all of their tokens are, no container overflows and only larger documents are cut."""
    counted = packing.token_counts(table(spark, d, "documents"), "doc_id", "text", *tokenizer_file())
    placed = packing.containers(counted, "doc_id", "n_tokens", [c for c, _ in split_limits(spark, d, "pack")])
    placed = placed.withColumn("n", F.col("token_end") - F.col("token_start"))
    loads = placed.groupBy("capacity", "container").agg(F.sum("n").alias("load")).groupBy("capacity").agg(F.max("load").alias("most"))
    parts = placed.groupBy("capacity", "doc_id").agg(F.sum("n").alias("placed"), F.count("*").alias("parts")).join(counted, "doc_id")
    sound = (F.col("placed") == F.col("n_tokens")) & ((F.col("parts") == 1) | (F.col("n_tokens") > F.col("capacity")))
    return parts.groupBy("capacity").agg(F.count("*").alias("documents"), F.bool_and(sound).alias("whole")).join(loads, "capacity").select("capacity", "documents", "whole", (F.col("most") <= F.col("capacity")).alias("fits"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Each affected document with the items it holds, the passage, its edits and its similarity."""
    return leaks.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "bench_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    documents, labels = table(spark, d, "documents"), table(spark, d, "reading_labels")
    return reading_level.reading_levels(documents, "doc_id", "text", "source", labels, "doc_id", "level_label")[0]


def p10_check(spark: SparkSession, d: str) -> DataFrame:
    """The documents that have a level, and whether it is one of the three."""
    return p10_found(spark, d).select("doc_id", F.col("reading_level").between(1, 3).alias("rated"))


def p10_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per source: rated documents and the share whose cross-validated level, from trees that have not seen the source, is the raters'."""
    documents, labels = table(spark, d, "documents"), table(spark, d, "reading_labels")
    model = reading_level.reading_levels(documents, "doc_id", "text", "source", labels, "doc_id", "level_label")[1]
    rows = [(g, int(n), float(a)) for g, (n, a) in sorted(model.by_group.items())] if model else []
    return spark.createDataFrame(rows, "source string, documents int, agreement double")


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_pieces": p1_pieces, "p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p4_main": p4_main, "p5_found": p5_found, "p5_splits": p5_splits, "p6_found": p6_found, "p6_redacted": p6_redacted, "p6_check": p6_check, "p7_found": p7_found,
        "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found,
        "p1_check": p1_check, "p5_check": p5_check, "p5_shares": p5_shares, "p8_check": p8_check, "p10_check": p10_check, "p10_agreement": p10_agreement,
    }


def _sql_link(value: str) -> str:
    """``grouped_splits.link_value`` as SQL."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"

    def translated(x: str, mapping: dict[str, str]) -> str:
        kept, gone = [(a, b) for a, b in mapping.items() if b], [a for a, b in mapping.items() if not b]
        return f"translate({x}, {quoted(''.join(a for a, _ in kept) + ''.join(gone))}, {quoted(''.join(b for _, b in kept))})"

    bare = f"regexp_replace(regexp_replace(upper({value}), '№', '', 'g'), '^\\s*(?:NO?|Н)[.\\s°º]+(\\d)', '\\1')"
    shape = translated(f"upper({translated(bare, lookalike.PLAIN)})", lookalike.TO_SKELETON)
    for pair, one in lookalike.COMPOSED.items():
        shape = f"replace({shape}, {quoted(pair)}, {quoted(one)})"
    folded = f"regexp_replace({shape}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    unknown = sorted({lookalike.skeleton_text(u.replace(" ", "").upper()) for u in grouped_splits.UNKNOWN})
    return f"(SELECT CASE WHEN f IN ({', '.join(map(quoted, unknown))}) OR regexp_matches(f, '^0*$') THEN NULL ELSE f END FROM (SELECT {folded} AS f))"


def oracle_sql() -> dict[str, str]:
    units = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm_id ORDER BY loaded_at DESC) AS rn FROM norm_units) JOIN (SELECT DISTINCT max_size FROM size_limits WHERE purpose = 'split') ON length(text) > max_size WHERE rn = 1 AND NOT coalesce(is_repealed, false)"
    ec = "ec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loaded_at DESC) AS rn FROM eval_cases) WHERE rn = 1)"
    pc = "pc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loaded_at DESC) AS rn FROM public_cases) WHERE rn = 1)"
    keys = [("group ", "case_group_id"), ("purchase ", "procurement_id"), ("purchase ", "nullif(regexp_extract(procurement_url, '(?i)regNumber=([^&#\\s]+)', 1), '')"), ("decision ", "fas_decision_id"), ("case ", "case_id"), ("case ", "duplicate_of")]
    linked = " UNION ".join(f"SELECT case_id, '{k}' || {_sql_link(c)} AS key FROM ec" for k, c in keys)
    return {
        "p1_found": f"SELECT norm_id, max_size AS max_chunk FROM ({units})",
        "p1_check": f"SELECT norm_id, max_size AS max_chunk, true AS fits, true AS overlaps, true AS rebuilt FROM ({units})",
        "p5_found": f"""WITH RECURSIVE {ec}, keyed AS (SELECT DISTINCT case_id, key FROM ({linked}) WHERE key IS NOT NULL),
            near AS (SELECT DISTINCT a.case_id AS a, b.case_id AS b FROM keyed a JOIN keyed b USING (key)),
            walk AS (SELECT a, b FROM near UNION SELECT w.a, n.b FROM walk w JOIN near n ON w.b = n.a)
            SELECT min(b) AS root_case_id, a AS case_id FROM walk GROUP BY a HAVING min(b) <> a""",
        "p5_check": "SELECT count(DISTINCT case_id) AS cases, true AS placed_once, true AS linked_together FROM eval_cases",
        "p6_check": f"""WITH {ec}, {pc} SELECT case_id, 'complaint_argument_raw' AS field, -1 AS item_no, complaint_argument_raw IS NULL AS is_null, true AS rest_unchanged, true AS no_mail FROM ec
            UNION ALL SELECT case_id, 'doc_fragment', -1, doc_fragment IS NULL, true, true FROM pc
            UNION ALL SELECT case_id, 'decision_quote', i, gold_evidence[i + 1].decision_quote IS NULL, true, true FROM (SELECT case_id, gold_evidence, unnest(range(len(gold_evidence))) AS i FROM pc)""",
        "p8_check": "SELECT max_size AS capacity, (SELECT count(*) FROM documents) AS documents, true AS whole, true AS fits FROM (SELECT DISTINCT max_size FROM size_limits WHERE purpose = 'pack')",
        "p10_check": r"""SELECT doc_id, true AS rated FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+')) >= 40
            AND length(regexp_replace(text, '[^А-Яа-яЁё]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g'))""",
    }
