import io
import zipfile

import pytest
from pyspark.sql import functions as F

from spanforge.functions import lookalike, quotes, text
from spanforge.operators import anonymize, corpus, validation
from spanforge.sources import extract, records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_fold_yo_and_split_foreign_letters(spark):
    assert one(spark, text.tokenize(F.lit("Ёлка — №5 café"))) == ["елка", "5", "caf"]
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0


def test_folding_in_both_worlds_agrees(spark):
    samples = ["cбoр", "и" + chr(0x306), "е" + chr(0x308) + "ж", "а" + chr(0xA0) + "б", "ＡＢ１", "а" + chr(0x200B) + "б", "Lіmmаs", "насо" + chr(0x301) + "сов", ""]
    df = spark.createDataFrame([(s,) for s in samples], "s string").select("s", lookalike.skeleton(F.col("s")).alias("k"), lookalike.plain(F.col("s")).alias("p"))
    for r in df.collect():
        assert r["k"] == lookalike.skeleton_text(r["s"])
        assert r["p"] == lookalike.plain_text(r["s"])
    assert one(spark, lookalike.skeleton(F.lit(None).cast("string"))) is None
    assert lookalike.one_script("Lіmmаs") == "Limmas" and lookalike.one_script("cбoр") == "сбор"


def test_quotes():
    source = "«Текст»:  он — сказал\nмного слов, «и ещё» больше слов."
    a, b = quotes.located('он - сказал много слов, "и ещё"', source)
    assert source[a:b] == "он — сказал\nмного слов, «и ещё»"
    assert quotes.located("нет такого", source) is None and quotes.located(None, source) is None
    spans = quotes.candidates("- первое второе\n\nтретье " + "ы" * 300, 20)
    assert [s[3] for s in spans] == ["первое второе", "третье", "ы" * 300]


def test_windows():
    words = "слово " * 100
    got = corpus.windows(words, 10, 100, 20)
    assert all(len(t) <= 100 and words[a - 10 : b - 10] == t for a, b, t in got) and len(got) > 5
    assert corpus.windows("", 0, 10, 2) == [] and corpus.windows("аб", 5, 10, 2) == [(5, 7, "аб")]


def test_blocks_to_units_to_chunks(spark):
    lines = ["Глава 1. О", "Статья 24.1. Заголовок", "1. Первая часть:", "1) первый пункт;", "а) подпункт;", "2) второй пункт.", "2. Вторая часть.", "Статья 25. Утратила силу"]
    at, rows = 0, []
    for n, t in enumerate(lines):
        rows.append((1, n, f"b{n}", t, at, at + len(t)))
        at += len(t) + 2
    blocks = spark.createDataFrame(rows, "page_id long, block_order int, block_id string, text string, char_start int, char_end int")
    units = corpus.unit_rows(corpus.parse_blocks(blocks, "page_id"), "page_id", F.lit("L"), F.lit("E"))
    got = {r["norm_id"]: r for r in units.collect()}
    assert set(got) == {"L:E:art.24.1", "L:E:art.24.1:ch.1", "L:E:art.24.1:ch.1:p.1", "L:E:art.24.1:ch.1:p.2", "L:E:art.24.1:ch.2", "L:E:art.25"}
    assert got["L:E:art.24.1:ch.1:p.1"]["text"] == "1) первый пункт;\nа) подпункт;" and got["L:E:art.25"]["is_repealed"]
    assert got["L:E:art.24.1:ch.1:p.1"]["parent_norm_id"] == "L:E:art.24.1:ch.1"
    whole = corpus.structural_chunks(units, "page_id", 500).collect()
    assert [r["norm_ids"] for r in sorted(whole, key=lambda r: r["chunk_id"])] == [["L:E:art.24.1:ch.1", "L:E:art.24.1:ch.1:p.1", "L:E:art.24.1:ch.1:p.2"], ["L:E:art.24.1:ch.2"]]
    assert corpus.structural_chunks(units, "page_id", 35).count() == 3


def test_intervals(spark):
    w = spark.createDataFrame([(1, "w1", 0, 10), (1, "w2", 10, 25)], "d int, w string, char_start int, char_end int")
    u = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 9, 11), (1, "c", 25, 30), (1, "d", 0, 100)], "d int, norm_id string, char_start int, char_end int")
    for bucket in (3, 7, 1000):
        got = {r["w"]: r["norm_ids"] for r in corpus.intersecting_units(w, u, "d", "w", bucket).collect()}
        assert got == {"w1": ["a", "d", "b"], "w2": ["d", "b"]}
    spans = spark.createDataFrame([("n", 0, 100), ("m", 5, 5)], "k string, start int, end int")
    pieces = spark.createDataFrame([("n", 0, 60), ("n", 40, 80), ("n", 50, 55)], "k string, char_start int, char_end int")
    assert {r["k"]: r["covered"] for r in corpus.covered_fraction(spans, pieces, ["k"]).collect()} == {"n": 0.8, "m": 0.0}


def test_anonymize_shares_numbers_across_fields():
    fields, counts = anonymize.replaced(["Иванов Пётр Львович, a@b.ru, +7 900 111-22-33", "a@b.ru и Петрова А. Б.", None, ""])
    assert fields == ["<PERSON_1>, <EMAIL_1>, <PHONE_1>", "<EMAIL_1> и <PERSON_2>", None, ""] and counts["EMAIL"] == 2
    assert anonymize.replaced(["секрет СЕКРЕТ"], (("PERSON", "секрет", True),))[0] == ["<PERSON_1> <PERSON_1>"]


def test_rules(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, x int")
    assert [tuple(r) for r in validation.broken_rules(rows, "k", {"positive": F.col("x") > 0}).collect()] == [("b", "positive")]
    files = spark.createDataFrame([("x", bytearray(b"1"))], "path string, content binary")
    listed = spark.createDataFrame([("x", "0" * 64), ("../y", "1")], "path string, sha256 string")
    assert {r["path"]: r["state"] for r in validation.checksums(files, listed).collect()} == {"x": "changed", "../y": "refused"}


def test_extraction():
    assert extract.extract("<html><p>Раз&nbsp;два</p><script>нет</script><p>три</p>".encode("cp1251")) == ("Раз два\n\nтри", "html")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>Один</w:t></w:p><w:p><w:t>два</w:t></w:p></w:d>')
    assert extract.extract(buffer.getvalue()) == ("Один\nдва", "docx")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.txt", "текст")
        z.writestr("../b.txt", "вне")
        inner = io.BytesIO()
        with zipfile.ZipFile(inner, "w") as y:
            y.writestr("c.html", "<html><p>внутри</p>")
        z.writestr("b.zip", inner.getvalue())
    assert extract.extract(outer.getvalue()) == ("текст\n\nвнутри", "archive:zip")
    assert [(n, state) for n, _, state in extract.members(outer.getvalue(), "z")] == [("z!../b.txt", "unsafe"), ("z!a.txt", "read"), ("z!b.zip!c.html", "read")]
    assert extract.extract(b"%PDF-1.4")[1] == "unsupported:pdf" and extract.extract(b"PK\x03broken")[1].startswith("error") and extract.extract(b"") == ("", "txt")
    blocks = extract.html_blocks('<p class="H">Статья 24<sup>1</sup>. О</p><p>1. Часть</p>')
    assert [(b["kind"], b["text"]) for b in blocks] == [("article_title", "Статья 24.1. О"), ("body", "1. Часть")] and blocks[1]["char_start"] == len("Статья 24.1. О") + 2


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("б", 1, ["x"]), (None, 2, None)], "a string, b int, c array<string>")
    records.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(map(str, records.read_jsonl(spark, str(tmp_path / "out"), df.schema).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "n.txt").write_text("12 # да\nhttp://x?complaintNumber=A-7&z\n12\n# нет\n")
    assert sorted(r["number"] for r in records.read_numbers(spark, str(tmp_path / "n.txt")).collect()) == ["12", "A-7"]


def test_streamed_postings(spark, tmp_path):
    from spanforge.operators.lexical import postings
    from spanforge.streaming.postings import current_postings, maintain_postings

    source = tmp_path / "in"
    spark.createDataFrame([("a", "раз два"), ("b", None)], "id string, text string").write.parquet(str(source))
    run = lambda: maintain_postings(spark.readStream.schema("id string, text string").parquet(str(source)), "id", "text", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    spark.createDataFrame([("a", "три")], "id string, text string").write.mode("append").parquet(str(source))
    run()
    got = current_postings(spark.read.parquet(str(tmp_path / "out")), "id").select("term", "id", "dl", "tf")
    want = postings(spark.createDataFrame([("a", "три"), ("b", None)], "id string, text string"), "id", "text").select("term", "id", "dl", "tf")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_members_of_archives_are_rows(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "раз")
        z.writestr("b.pdf", b"%PDF-1.4")
    files = spark.createDataFrame([("f.zip", buffer.getvalue()), ("g.txt", "два".encode()), ("h", None)], "path string, content binary")
    got = {(r["path"], r["member"]): (r["text"], r["method"]) for r in extract.extracted_members(files).collect()}
    assert got == {("f.zip", "a.txt"): ("раз", "txt"), ("f.zip", "b.pdf"): ("", "unsupported:pdf"), ("g.txt", ""): ("два", "txt"), ("h", ""): ("", "txt")}


def test_release_rows_run_on_a_cluster_without_a_secret(spark, data, monkeypatch):
    from spanforge.plans import records
    from spanforge.session import secret

    monkeypatch.delenv("SPANFORGE_SECRET", raising=False)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.warns(UserWarning, match="random key"):
        rows = [r["case_id"] for r in records.release_rows(spark, data).collect()]
    assert len(set(rows)) == len(rows) == records.cases(spark, data).count() and all(r.startswith("case_") for r in rows)
    with pytest.raises(ValueError, match="must be set"):
        secret(spark, "pseudonyms")


def test_public_ids_run_on_a_cluster_without_a_secret(spark, data, monkeypatch):
    from spanforge.plans import records

    monkeypatch.delenv("SPANFORGE_SECRET", raising=False)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.warns(UserWarning, match="random key"):
        rows = records.public_ids(spark, data).collect()
    assert len(rows) == records.cases(spark, data).count() and all(r["sound"] for r in rows)
