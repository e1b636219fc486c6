import json
import os

import pytest
from pyspark.sql import functions as F

from spanforge.operators import corpus, evaluation, release, validation
from spanforge.sources import catalog


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def pool(spark):
    scores = spark.createDataFrame([("q", "c1", 0.9), ("q", "c2", 0.9), ("q", "c3", 0.1), ("q", "c4", 0.5)], "query_id string, item string, score double")
    bridge = spark.createDataFrame([("c1", "b"), ("c2", "a"), ("c2", "z"), ("c3", "a"), ("c4", "d")], "item string, article string")
    return scores, bridge


def test_chains_of_ties_differ(pool):
    scores, bridge = pool
    assert [r["article"] for r in sorted(evaluation.article_evidence(scores, bridge).collect(), key=lambda r: r["rank"])] == ["b", "a", "z", "d"]
    assert [r["item"] for r in sorted(evaluation.best_chunks_once(scores, bridge).collect(), key=lambda r: r["rank"])] == ["c2", "c1", "c4"]
    order = scores.sparkSession.createDataFrame([("q", "d", 1), ("q", "z", 2), ("q", "a", 3), ("q", "none", 4)], "query_id string, item string, rank int")
    assert [r["item"] for r in sorted(evaluation.best_chunks_in_order(scores, bridge, order).collect(), key=lambda r: r["rank"])] == ["c4", "c2"]


def test_two_passes(spark, pool):
    scores, bridge = pool
    rankings = spark.createDataFrame([("q", "x", i, c) for i, c in enumerate(("c3", "c1", "c4", "c2"), 1)], "query_id string, source string, rank int, item string")
    articles = spark.createDataFrame([("q", a, n) for n, a in enumerate("abd", 1)], "query_id string, item string, rank int")
    short, output, scored = evaluation.two_pass(rankings, ["x"], bridge, articles, scores, 1, 2, 4, 2)
    # One chunk of each article: a has only c3 in the first pass and loses its place.
    assert rows(short, "rank", "item") == [(1, "b"), (2, "d")] and rows(output, "rank", "item") == [(1, "c1"), (2, "c4")]
    assert [x for _, x in rows(scored, "rank", "item")] == ["c1", "c3", "c4"]
    with pytest.raises(ValueError):
        evaluation.two_pass(rankings, ["x"], bridge, articles, scores, 1, 1, 4, 2)


def test_injected_models(spark):
    texts = spark.createDataFrame([(1, "аб"), (2, None), (3, "")], "id int, t string")
    got = {r["id"]: r["vector"] for r in evaluation.encoded(texts, "id", "t", lambda ts: [[3.0 * len(t), 4.0 * len(t)] for t in ts], "q: ", 2).collect()}
    assert all(abs(got[i][0] - 0.6) < 1e-6 and abs(got[i][1] - 0.8) < 1e-6 for i in (1, 2, 3))
    assert evaluation.truncated_count(texts, "t", len, 1).first()["truncated"] == 1
    pairs = spark.createDataFrame([("q", i, "a", "b" * i) for i in range(5)], "query_id string, item int, query_text string, item_text string")
    assert rows(evaluation.scored_pairs(pairs, lambda ps: [len(b) for _, b in ps], 2), "item", "score") == [(i, float(i)) for i in range(5)]
    with pytest.raises(Exception, match="one score"):
        evaluation.scored_pairs(pairs, lambda ps: [1.0], 2).collect()


def test_label_tables(spark):
    mapping = spark.createDataFrame([("x", "n1", 1), ("x", "n2", 2), ("y", "n3", 1)], "label string, norm_id string, rank int")
    over = spark.createDataFrame([("x", "n9", 1), ("x", "n9", 2), ("x", "n8", 3)], "label string, norm_id string, rank int")
    merged = evaluation.overlay(mapping, over, 10)
    assert rows(merged, "label", "rank", "norm_id") == [("x", 1, "n9"), ("x", 2, "n8"), ("y", 1, "n3")]
    cases = spark.createDataFrame([("c1", "x"), ("c2", "other"), ("c3", None), ("c4", "w")], "case_id string, label string")
    assert rows(evaluation.predicted(cases, merged, 1), "case_id", "norm_id") == [("c1", "n9")]
    with pytest.raises(ValueError):
        evaluation.overlay(mapping, spark.createDataFrame([("other", "n", 1)], "label string, norm_id string, rank int"))


def test_winner_chains(spark):
    table = spark.createDataFrame(
        [("a", 0.800, 0.5, 0.5, 9.0, 700, 9.0, "m", 1.0, 1.0, 3.0, 5.0), ("b", 0.795, 0.6, 0.4, 5.0, 700, 5.0, "m", 2.0, 1.0, 2.0, 5.0), ("c", 0.796, 0.6, 0.4, 4.0, 1000, 5.0, "k", 1.0, 1.0, 2.0, 9.0), ("d", 0.700, 0.9, 0.9, 1.0, 500, 1.0, "m", 1.0, 1.0, 1.0, 1.0)],
        "name string, article double, exact double, all_hit double, latency double, size int, rounded_latency double, model string, mean_chunks double, mean_articles double, mean_cost double, max_cost double",
    )
    got = {chain: evaluation.chain_winner(table, chain).first()["name"] for chain in [*evaluation.WINNER_CHAINS, "evidence"]}
    assert got == {"hybrid": "c", "conservative": "b", "wide": "c", "chunk_budget": "b", "bm25_size": "c", "dense_config": "c", "method_grid": "c", "evidence": "a"}


def test_outside_share_and_uncovered_spans(spark):
    packed = spark.createDataFrame([("q", "c1", "L", 0, 10), ("q", "c2", "M", 0, 10), ("r", "c3", "L", 5, 5)], "query_id string, item string, law string, char_start int, char_end int")
    spans = spark.createDataFrame([("q", "L", 0, 4), ("q", "L", 2, 6), ("q", "L", 50, 60)], "query_id string, law string, start int, end int")
    assert rows(evaluation.outside_share(packed, spans), "query_id", "outside") == [("q", 0.7), ("r", 0.0)]
    whole = spark.createDataFrame([("k", 0, 10), ("n", 0, 10)], "key string, start int, end int")
    pieces = spark.createDataFrame([("k", 0, 5)], "key string, char_start int, char_end int")
    assert rows(corpus.covered_fraction(whole, pieces, ["key"]), "key", "covered") == [("k", 0.5), ("n", 0.0)]


def test_fixed_windows_meet_units(spark):
    texts = spark.createDataFrame([("e", "слово " * 40), ("empty", None)], "edition string, text string")
    units = spark.createDataFrame([("e", "u1", 0, 45, False), ("e", "u2", 50, 90, True), ("e", "u3", 40, 120, None)], "edition string, norm_id string, char_start int, char_end int, is_repealed boolean")
    got = sorted(release.fixed_window_chunks(texts, units, 60, 10).collect(), key=lambda r: r["chunk_id"])
    assert got[0]["chunk_id"] == "win_e_00001" and got[0]["norm_ids"] == ["u1", "u3"] and got[1]["norm_ids"] == ["u3"] and all(r["char_start"] < 120 for r in got)


def test_private_members_and_outgoing(spark):
    df = spark.createDataFrame([("1", ["a"], "в /home/x/y лежит"), ("2", None, "чисто")], "case_id string, doc_paths array<string>, note string")
    assert rows(release.private_members(df, "case_id"), "case_id", "location", "rule") == [("1", "record.doc_paths", "private_key"), ("1", "record.note", "private_path")]
    texts = spark.createDataFrame([(1, "Пишите на a.b@c.test, файл /home/x/y.txt"), (2, None)], "id int, t string")
    got = {r["id"]: r["outgoing"] for r in release.outgoing(texts, "t").collect()}
    assert got == {1: "Пишите на <EMAIL_1>, файл <PATH>", 2: None}


def test_catalog(spark, tmp_path):
    (tmp_path / "ed").mkdir()
    (tmp_path / "ed/edition.json").write_text('{"law_id": "L"}')
    (tmp_path / "ed/blocks.jsonl").write_text('{"block_order": 1, "text": "б"}\n\n{"block_order": 0, "text": "а"}\n')
    (tmp_path / "ed/full_text.txt").write_text("а\n\nб\n")
    description, blocks, full = catalog.load_edition(spark, str(tmp_path / "ed"))
    assert description == {"law_id": "L"} and [r["text"] for r in blocks.collect()] == ["а", "б"] and full == "а\n\nб"
    for split in ("dev", "eval"):
        (tmp_path / f"{split}.jsonl").write_text("".join(json.dumps({"case_id": f"{split}{i}", "split": split, "gold_norms": ["n"] if i else []}) + "\n" for i in range(2)))
    schema = "case_id string, split string, gold_norms array<string>, annotation_status string"
    assert catalog.load_public_cases(spark, str(tmp_path), schema).count() == 4 and catalog.load_cases(spark, str(tmp_path), schema).count() == 1
    (tmp_path / "eval.jsonl").write_text('{"case_id": "dev0", "split": "eval"}\n')
    with pytest.raises(ValueError, match="several"):
        catalog.load_public_cases(spark, str(tmp_path), schema)
    (tmp_path / "eval.jsonl").write_text('{"case_id": "x", "split": "dev"}\n')
    with pytest.raises(ValueError, match="split eval"):
        catalog.load_public_cases(spark, str(tmp_path), schema)
    (tmp_path / "known.txt").write_text("1 # раз\n# нет\n\n2\n1\n")
    known = catalog.known_numbers(spark, str(tmp_path / "known.txt"))
    found = spark.createDataFrame([("3", 5), ("1", 1), ("3", 2), (None, 0)], "number string, place int")
    fresh = catalog.new_numbers(found, known)
    assert rows(known, "number") == [("1",), ("2",)] and rows(fresh, "number", "place") == [("3", 2)]
    catalog.append_queue(spark, fresh, str(tmp_path / "queue"))
    catalog.append_queue(spark, fresh, str(tmp_path / "queue"))
    assert spark.read.text(str(tmp_path / "queue")).count() == 2
    for name in ("chunks_a_m700.jsonl", "chunks_a_m1500.jsonl", "other"):
        (tmp_path / "ed" / name).write_text("")
    (tmp_path / "v").mkdir()
    for name in ("bge_m700.parquet", "bge_m900.parquet"):
        (tmp_path / "v" / name).write_text("")
    assert catalog.chunk_sizes(spark, str(tmp_path / "ed")) == [700, 1500] and catalog.cached_configurations(spark, str(tmp_path / "v"), str(tmp_path / "ed")) == [("bge", 700)]
    table = catalog.markdown_rows(spark, "# т\n\n| a | b |\n|---|---|\n| 1 | x\\|y |\n| 2 | z |\n\nконец")
    assert rows(table, "a", "b") == [("1", "x|y"), ("2", "z")]
    with pytest.raises(ValueError):
        catalog.markdown_rows(spark, "нет")


def test_redactions_fragments_publishing_and_state(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"global": [{"text": "Альфа", "kind": "PERSON"}], "cases": {"c": [{"text": "б", "kind": "OTHER", "ignore_case": True}]}}))
    assert catalog.manual_redactions(spark, str(path)) == ((("PERSON", "Альфа", False),), {"c": (("OTHER", "б", True),)})
    for bad in ({"x": []}, {"global": [{"text": "а", "kind": "WRONG"}]}, []):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            catalog.manual_redactions(spark, str(path))
    requests = spark.createDataFrame([("r", "f1", "d.txt", 1, 3), ("r", "f2", "/etc/x", 0, 1), ("r", "f3", "a/../../x", 0, 1), ("r", "f4", "no.txt", 0, 1), ("r", "f5", "d.txt", 2, 99)], "request_id string, fragment_id string, path string, char_start int, char_end int")
    documents = spark.createDataFrame([("d.txt", "абвг")], "path string, text string")
    assert rows(catalog.load_fragments(requests, documents).fillna(""), "fragment_id", "text", "refusal") == [("f1", "бв", ""), ("f2", "", "absolute_path"), ("f3", "", "outside_root"), ("f4", "", "unknown_document"), ("f5", "", "out_of_range")]
    out = str(tmp_path / "published")
    manifest = catalog.publish({"docs": documents, "none": documents.limit(0)}, out)
    assert manifest["docs"]["rows"] == 1 and catalog.published_faults(spark, out) == []
    with pytest.raises(FileExistsError):
        catalog.publish({"docs": documents}, out)
    spark.createDataFrame([("{}",)], "value string").write.mode("append").text(os.path.join(out, "none"))
    assert catalog.published_faults(spark, out) == ["none"]
    state = spark.createDataFrame([("a", "pending", 0), ("b", "done", 1)], "source string, status string, at int")
    updates = spark.createDataFrame([("a", "error", 1), ("a", "done", 2), ("c", "done", 1)], "source string, status string, at int")
    assert rows(catalog.upserted(state, updates, "source", "at"), "source", "status") == [("a", "done"), ("b", "done"), ("c", "done")]
    parts = spark.createDataFrame([(1, "b", "pdf", "второй"), (1, "z", "html", "первый"), (1, "c", None, ""), (2, "a", None, None)], "d int, name string, kind string, text string")
    assert rows(catalog.combined_text(parts, "d"), "d", "text") == [(1, "первый\n\nвторой")]
    meta = spark.createDataFrame([("1", "done", [("done",)]), ("2", "done", [("pending",)]), ("3", "error", None)], "id string, status string, documents array<struct<status:string>>")
    assert rows(catalog.crawl_rollup(meta), "status", "items", "documents", "ready") == [("done", 2, 2, 1), ("error", 1, 0, 0)]
    placed = catalog.numbered_places(spark.range(100).select((F.lit(99) - F.col("id")).alias("x")), "x")
    assert rows(placed, "pos", "x") == [(i, i) for i in range(100)]


def test_refusals_of_drafts(spark):
    claim, law = "Заказчик не указал срок поставки товара в извещении.", "Извещение должно содержать срок поставки товара и цену контракта."
    good = ["e1", "remark", "Нарушен срок", "f1", "s0", "k1", "n1", "s0"]
    changes = {
        None: {}, "model_abstained": {1: "abstain"}, "incomplete_remark": {2: " "}, "unknown_source_fragment": {3: "f9"}, "doc_quote_not_claim_evidence": {3: "f2"}, "doc_span_not_in_fragment": {4: "s7"}, "source_changed": {3: "f3"},
        "unknown_or_wrong_edition_norm": {0: "e2"}, "norm_not_exposed": {5: "k2"}, "norm_span_not_in_evidence": {7: "s9"}, "quote_too_short": {5: "k3"}, "norm_quote_not_in_unit": {5: "k4"},
    }
    rows = [(str(reason), *[change.get(i, v) for i, v in enumerate(good)]) for reason, change in changes.items()]
    drafts = spark.createDataFrame(rows, "request_id string, edition_id string, decision string, remark_text string, source_fragment_id string, doc_span_id string, norm_chunk_id string, norm_id string, norm_span_id string")
    ids = [r[0] for r in rows]
    source = "До. " + claim
    fragments = spark.createDataFrame([(i, f, role, 4, 4 + len(claim), text, source) for i in ids for f, role, text in (("f1", "claim", claim), ("f2", "context", claim), ("f3", "claim", claim.upper()))], "request_id string, fragment_id string, role string, char_start int, char_end int, text string, source_text string")
    norms = spark.createDataFrame([("n1", "e1", None, "1. " + law)], "norm_id string, edition_id string, is_repealed boolean, text string")
    chunks = spark.createDataFrame([(i, k, [n], t) for i in ids for k, n, t in (("k1", "n1", law), ("k2", "n5", law), ("k3", "n1", "срок поставки"), ("k4", "n1", "Совсем другой текст без связи с нормой."))], "request_id string, chunk_id string, norm_ids array<string>, text string")
    got = {r["request_id"]: r for r in validation.draft_refusals(drafts, fragments, norms, chunks).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {str(k): k for k in changes}
    assert (got["None"]["doc_quote"], got["None"]["doc_start"], got["None"]["doc_end"], got["None"]["norm_quote"]) == (claim, 4, 4 + len(claim), law)


def test_rules_of_cases_are_each_broken_once(spark):
    span = ("p", 0, 2, "аб", None)
    good = dict(annotation_status="verified", gold_norms=["n"], exclusion_reasons=[], gold_evidence=[("n", span)], complaint_argument_raw="а", complaint_argument_blind="а", notice_date="2020-01-01", issue_type="other", outcome="upheld", relies_on_bylaw=False, duplicate_of=None, complaint_argument_source=span, outcome_evidence=span)
    bad = {
        "known_status": dict(annotation_status="x", exclusion_reasons=["r"]), "norms_unique": dict(gold_norms=["n", "n"]), "reasons_unique": dict(annotation_status="draft", exclusion_reasons=["r", "r"]), "evidence_unique": dict(gold_evidence=[("n", span)] * 2),
        "verified_has_notice_date": dict(notice_date=None), "verified_has_outcome_evidence": dict(outcome_evidence=None), "verified_issue_known": dict(issue_type="new"), "verified_is_upheld": dict(outcome="rejected"), "verified_no_bylaw": dict(relies_on_bylaw=True),
        "evidence_is_of_norms": dict(gold_norms=["n", "m"]), "verified_has_no_reason": dict(exclusion_reasons=["r"]), "other_has_reason": dict(annotation_status="draft"), "duplicate_says_so": dict(annotation_status="draft", exclusion_reasons=["r"], duplicate_of="d"),
        "source_span": dict(complaint_argument_source=("p", 2, 1, "а", None)),
    }
    of = "struct<path:string,char_start:int,char_end:int,quote:string,note:string>"
    schema = f"key string, annotation_status string, gold_norms array<string>, exclusion_reasons array<string>, gold_evidence array<struct<norm_id:string,decision_span:{of}>>, complaint_argument_raw string, complaint_argument_blind string, notice_date string, issue_type string, outcome string, relies_on_bylaw boolean, duplicate_of string, complaint_argument_source {of}, outcome_evidence {of}"
    df = spark.createDataFrame([("good", *good.values()), *((k, *(good | v).values()) for k, v in bad.items())], schema)
    assert rows(validation.broken_rules(df, "key", validation.case_rules()), "key", "rule") == sorted((k, k) for k in bad)
    report = {r["rule"]: r["broken"] for r in validation.rule_report(df, validation.case_rules()).collect()}
    assert report["norms_unique"] == 1 and report["outcome_span"] == 0 and len(report) == len(validation.case_rules())


def test_small_helpers(spark):
    from spanforge.functions import web
    from spanforge.operators import caches
    from spanforge.sources import extract

    r = spark.createDataFrame([("a/b c", "до [[тело]] после", None)], "r string, t string, n string").select(
        web.safe_revision(F.col("r")).alias("r"), web.between(F.col("t"), "[[", "]]").alias("b"), web.between(F.col("t"), "((", "]]").alias("none"), web.address("https://x.test/?a=%s", F.col("r")).alias("u"), web.address("https://x.test/?a=%s", F.col("n")).alias("un")
    ).first()
    assert r["r"] == "a_b_c" and (r["b"]["char_start"], r["b"]["char_end"]) == (3, 9) and r["none"] is None and r["u"] == "https://x.test/?a=a%2Fb+c" and r["un"] is None
    assert extract.corrected_name("a.doc", b"%PDF-1", {"a.pdf"}) == "a_1.pdf" and extract.corrected_name("a.csv", b"1;2", set()) == "a.csv" and extract.corrected_name("b", b"%PDF", set()) == "b.pdf"
    runs = spark.createDataFrame([(10.0, 5.0), (20.0, 10.0), (30.0, 15.0)], "b double, c double")
    q = caches.latency_ratio(runs, "b", "c", 50).first()
    assert (q["runs"], q["ratio"], q["low"], q["high"]) == (3, 0.5, 0.5, 0.5)
    left, right = (spark.createDataFrame(x, "id int, t array<int>") for x in ([(1, [1, 2]), (2, [3])], [(1, [1, 2]), (3, [3])]))
    assert tuple(caches.token_parity(left, right, "id", "t").first()) == (3, 1)
    chunks = spark.createDataFrame([("a", "x", 0), ("b", "y", 1)], "id string, t string, pos int")
    moved = chunks.withColumn("pos", 1 - F.col("pos"))
    f = lambda df, p: caches.corpus_fingerprint(df, "id", "t", position=p).first()[0]
    assert f(chunks, None) == f(moved, None) and f(chunks, "pos") != f(moved, "pos")
    blocks = spark.createDataFrame([("Статья 91. О",), ("прочее",)], "text string")
    assert catalog.complete_edition(blocks).count() == 2
    with pytest.raises(ValueError):
        catalog.complete_edition(blocks, 95)


def test_dense_ranking_in_blocks_of_queries(spark):
    import random

    from spanforge.operators.dense import dense_search

    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.random() - 0.5 for _ in range(4)] if i % 7 else None) for i in range(60)], "id int, v array<double>")
    one, many = (rows(dense_search(df, "id", "v", df.filter("id < 20").withColumnRenamed("id", "q"), "q", "v", 3, block), "query_id", "rank", "id", "score") for block in (2000, 4))
    assert one == many and len(one) == 17 * 3 and all(q == i for q, r, i, _ in one if r == 1)
