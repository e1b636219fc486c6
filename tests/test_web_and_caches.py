import datetime

import pytest
from pyspark.sql import functions as F

from spanforge.functions import web
from spanforge.operators import caches


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numbers(spark):
    a, b, c = "0" * 19, "1" * 18, "20" + "3" * 16
    html = f"<a href='?regNumber={a}'></a> purchaseNumber={b} regNumber={c} orderNumber={a}"
    assert one(spark, web.linked_numbers(F.lit(html))) == [a, b]
    assert one(spark, web.linked_numbers(F.lit(html), F.array(F.lit(b)))) == [a]
    assert one(spark, web.labelled_numbers(F.lit(f"НОМЕР извещения № {a}"))) == [a]
    text = f"извещение {a}, затем долго ничего не происходило и потом наконец-то контракт {b}. " + "Прошло ещё много времени, и ничего нового не случилось. " * 2 + c
    assert web.number_contexts(text) == [(a, "notice"), (b, "contract"), (c, "unknown")]
    assert [tuple(r) for r in one(spark, web.classified_numbers(F.lit(text)))] == web.number_contexts(text) and web.number_contexts(None) == []


def test_revisions(spark):
    html = "<select><option value='9,1'>9 - от 04.08.2026 № 330-ФЗ</option><option value='7,1' >7 - первая</option></select>"
    rows = one(spark, web.revisions(F.lit(html)))
    assert [(r["number"], r["amended_on"], r["law"], r["selected"]) for r in rows] == [(7, None, None, False), (9, datetime.date(2026, 8, 4), "330-ФЗ", True)]
    ids = one(spark, F.transform(web.revisions(F.lit(html)), web.edition_of))
    assert ids == ["rdk-7", "2026-08-04"] and one(spark, web.revisions(F.lit("<p>"))) == []
    note = "Утратил силу. (от 01.01.2020 № 1-ФЗ; в ред. от 02.02.2021 № 22-ФЗ)"
    assert one(spark, web.repeal_basis(F.lit(note))) == "02.02.2021 № 22-ФЗ" and one(spark, web.repeal_basis(F.lit("нет"))) is None


def test_links_and_names(spark):
    html = "<a href='/d/1'>Скачать <b>решение</b></a><a href='#top'>документ</a><a href='/d/1'>ещё документ</a><a href='/x'>прочее</a>"
    assert web.document_links(html) == [("/d/1", "Скачать решение")] and web.document_links(None) == []
    assert one(spark, web.safe_name(F.lit(" a/б в?.pdf "))) == "a_б_в_.pdf" and one(spark, web.safe_name(F.lit(".."))) == "file"
    assert one(spark, web.extension(F.lit("Text/HTML; charset=x"))) == ".html" and one(spark, web.extension(F.lit(None).cast("string"))) == ".bin"


def test_caches(spark):
    chunks = spark.createDataFrame([("a", "раз"), ("b", "два"), ("c", None)], "id string, text string")
    print_ = lambda df: caches.corpus_fingerprint(df, "id", "text").first()["fingerprint"]
    assert print_(chunks) == print_(chunks.orderBy(F.desc("id"))) != print_(chunks.filter("id <> 'c'"))
    assert caches.corpus_fingerprint(chunks.limit(0), "id", "text").count() == 1
    old = spark.createDataFrame([("раз", [1.0, 0.0])], "text string, vector array<double>")
    new = spark.createDataFrame([("два", [0.0, 2.0]), ("раз", [9.0, 9.0])], "text string, vector array<double>")
    got = {r["id"]: (r["vector"], r["is_new"]) for r in caches.merged_vectors(chunks.filter("id <> 'c'"), "id", "text", old, new).collect()}
    assert got == {"a": ([1.0, 0.0], False), "b": ([0.0, 2.0], True)}
    with pytest.raises(Exception, match="no vector"):
        caches.merged_vectors(chunks, "id", "text", old, new).collect()
    assert caches.drift(old, new, "text").first()["cosine"] == pytest.approx(0.707107)
    wanted = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, item string")
    assert [tuple(r) for r in caches.missing_pairs(wanted, wanted.filter("item = 'a'")).collect()] == [("q", "b")]
    runs = spark.createDataFrame([("m", 10.0), ("m", 20.0), ("m", 30.0)], "m string, ms double")
    assert tuple(caches.latency(runs, ["m"], "ms").first()) == ("m", 20.0, 29.0, 50.0)


def test_document_links_and_pointers(spark):
    from pyspark.sql import functions as F

    from spanforge.functions import text, web

    page = '<a href="#x">решение</a><a href="/a/decision.PDF">скан</a><a href="getdocs?id=1" title="Папка">x</a><a href="/epz/complaint/search/results.html">жалобы</a><a href="/n">Решение</a> href="/filestore/9" <a href="/other">прочее</a>'
    assert web.document_links(page, "https://e.test/") == [("https://e.test/a/decision.PDF", "скан"), ("https://e.test/getdocs?id=1", "Папка"), ("https://e.test/n", "Решение"), ("https://e.test/filestore/9", "")]
    rows = spark.createDataFrame([("Контракт заключается в соответствии со статьей 33.",), ("в следующих случаях: 1",), ("статьи 5 и п 3",), (None,)], "t string")
    got = rows.select(text.is_pointer_text(F.col("t")).alias("p"), text.contains_direct_citation(F.col("t")).alias("c"), web.safe_name(F.concat(F.lit("a" * 150), F.lit(".pdf"))).alias("n")).collect()
    assert [r["p"] for r in got] == [True, False, False, None] and [r["c"] for r in got] == [False, False, True, None]
    assert got[0]["n"].endswith(".pdf") and len(got[0]["n"]) <= 120
