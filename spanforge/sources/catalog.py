"""Loaders and sinks with state: editions, queues, redactions, fragments, published folders, tables kept up to date."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators.anonymize import MANUAL_KINDS
from spanforge.sources.records import read_jsonl

BLOCK = "block_order int, block_id string, kind string, text string, article_hint int, article_title_hint string, char_start int, char_end int"


def _files(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of any file system that Spark reads, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    listing = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(x.getPath().getName() for x in listing)


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def load_edition(spark: SparkSession, folder: str) -> tuple[dict, DataFrame, str]:
    """An edition's description, its blocks in order, and its full text without one last line end."""
    full = _text(spark, f"{folder}/full_text.txt")
    return json.loads(_text(spark, f"{folder}/edition.json")), read_jsonl(spark, f"{folder}/blocks.jsonl", BLOCK).orderBy("block_order"), full.removesuffix("\n")


def load_cases(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Verified cases: dev.jsonl with labels if it is there, else the verified ones of all other JSON files but the example of the schema."""
    names = _files(spark, folder)
    if "dev.jsonl" in names:
        return read_jsonl(spark, f"{folder}/dev.jsonl", schema).filter(F.size(F.coalesce("gold_norms", F.array())) > 0)
    wanted = [f"{folder}/{n}" for n in names if n.endswith(".json") and n != "schema_example.json"]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(wanted).filter("annotation_status = 'verified'")


def load_public_cases(spark: SparkSession, folder: str, schema: str, split: str | None = None) -> DataFrame:
    """dev.jsonl and eval.jsonl together; a row of another split than its file's, or a case in two rows, is an error."""
    parts = [read_jsonl(spark, f"{folder}/{name}.jsonl", schema).withColumn("_file", F.lit(name)) for name in ("dev", "eval") if split in (None, name)]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    wrong = rows.filter(~F.col("split").eqNullSafe(F.col("_file"))).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['case_id']} is not of the split {wrong[0]['_file']}")
    twice = rows.groupBy("case_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['case_id']} stands in several rows")
    return rows.drop("_file")


def known_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(number): the distinct numbers of a queue file; what follows # on a line is a comment."""
    return spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("number")).filter("number <> ''").distinct()


def new_numbers(found: DataFrame, known: DataFrame) -> DataFrame:
    """(number, place): numbers of ``found`` (number, place) that ``known`` (number) lacks, each at its first place."""
    return found.filter("number is not null").groupBy("number").agg(F.min("place").alias("place")).join(known.select("number").distinct(), "number", "left_anti")


def append_queue(spark: SparkSession, numbers: DataFrame, path: str) -> None:
    """Adds numbers to a queue folder in the order of their places, earlier files untouched."""
    numbers.select(F.col("number").alias("value"), "place").sortWithinPartitions("place").select("value").write.mode("append").text(path)


def chunk_sizes(spark: SparkSession, folder: str, pattern: str = r"chunks_\w+_m(\d+)\.jsonl") -> list[int]:
    """The sizes that the chunk files of a folder have in their names, ascending."""
    return sorted({int(m[1]) for n in _files(spark, folder) if (m := re.fullmatch(pattern, n))})


def cached_configurations(spark: SparkSession, vectors: str, chunks: str, pattern: str = r"(?P<model>.+)_m(?P<size>\d+)\.parquet") -> list[tuple[str, int]]:
    """(model, size) of the vector files for whose size there are chunks too."""
    sizes = set(chunk_sizes(spark, chunks))
    found = (re.fullmatch(pattern, n) for n in _files(spark, vectors))
    return sorted((m["model"], int(m["size"])) for m in found if m and int(m["size"]) in sizes)


def markdown_rows(spark: SparkSession, report: str) -> DataFrame:
    """The first pipe table of a report as rows of strings; a report without one, or with an uneven row, is an error."""
    lines = [line.strip() for line in report.splitlines()]
    start = next((n for n, line in enumerate(lines[:-1]) if line.startswith("|") and re.fullmatch(r"[|\s:-]+", lines[n + 1])), None)
    if start is None:
        raise ValueError("no table in the report")
    cells = lambda line: [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line)[1:-1]]
    names, rows = cells(lines[start]), []
    for line in lines[start + 2 :]:
        if not line.startswith("|"):
            break
        rows.append(cells(line))
        if len(rows[-1]) != len(names):
            raise ValueError(f"uneven row: {line}")
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def manual_redactions(spark: SparkSession, path: str) -> tuple[tuple, dict[str, tuple]]:
    """Redactions (kind, text, ignore case) for all cases and by case, from {"global": [...], "cases": {id: [...]}}; any other key or kind is an error."""
    root = json.loads(_text(spark, path))
    if not isinstance(root, dict) or (unknown := set(root) - {"global", "cases"}):
        raise ValueError(f"unknown keys: {sorted(unknown) if isinstance(root, dict) else type(root).__name__}")

    def parsed(items: list, where: str) -> tuple:
        if not isinstance(items, list):
            raise ValueError(f"{where} must be a list")
        for x in items:
            if not isinstance(x, dict) or set(x) - {"text", "kind", "ignore_case"} or not x.get("text") or x.get("kind") not in MANUAL_KINDS:
                raise ValueError(f"{where}: {x}")
        return tuple((x["kind"], x["text"], bool(x.get("ignore_case", False))) for x in items)

    return parsed(root.get("global", []), "global"), {k: parsed(v, f"cases.{k}") for k, v in root.get("cases", {}).items()}


def load_fragments(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(request_id, fragment_id, text, refusal) of (request_id, fragment_id, path, char_start, char_end) cut from (path, text).

    Absolute paths, paths that climb out of their root, unknown documents and places beyond the text are refused, the first that applies.
    """
    rows = requests.join(documents.select("path", F.col("text").alias("_t")), "path", "left")
    refusal = (
        F.when(F.col("path").isNull() | F.col("path").rlike(r"^(/|[A-Za-z]:)"), "absolute_path").when(F.array_contains(F.split("path", r"[/\\]"), ".."), "outside_root")
        .when(F.col("_t").isNull(), "unknown_document").when(~F.coalesce((F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")) & (F.col("char_end") <= F.length("_t")), F.lit(False)), "out_of_range")
    )
    text = F.when(refusal.isNull(), F.col("_t").substr(F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    return rows.select("request_id", "fragment_id", text.alias("text"), refusal.alias("refusal"))


def publish(tables: dict[str, DataFrame], folder: str) -> dict[str, dict]:
    """Writes tables as line-delimited JSON under a new folder, and last a manifest of rows and digests, so that a folder without one is unfinished.

    An existing folder is never overwritten.  The digest of a table is that of its rows in order of their own digests.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileExistsError(folder)
    manifest = {}
    for name, df in sorted(tables.items()):
        lines = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
        lines.write.mode("errorifexists").text(f"{folder}/{name}")
        manifest[name] = published_digest(spark, f"{folder}/{name}")
    body = json.dumps({"tables": manifest}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest")
    return manifest


def published_digest(spark: SparkSession, path: str) -> dict:
    """Rows of a text folder, and a digest that does not depend on how they are spread: two sums of the halves of row digests."""
    h = F.sha2("value", 256)
    half = lambda a: F.coalesce(F.sum(F.conv(F.substring(h, a, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    r = spark.read.text(path).agg(F.count("*").alias("rows"), half(1).alias("a"), half(16).alias("b")).first()
    return {"rows": r["rows"], "digest": hashlib.sha256(f"{r['a']}|{r['b']}".encode()).hexdigest()}


def published_faults(spark: SparkSession, folder: str) -> list[str]:
    """The tables of a published folder whose rows are no longer those of its manifest; names that climb out of it are an error."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])["tables"]
    if odd := [n for n in manifest if "/" in n or ".." in n]:
        raise ValueError(f"unsafe names: {odd}")
    return [n for n, want in sorted(manifest.items()) if published_digest(spark, f"{folder}/{n}") != want]


def upserted(state: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """``state`` with the rows of ``updates`` in the place of those of the same key, of several updates the greatest by ``order``.

    A pending row stays only as long as no update says done or error; both sides have the same columns.
    """
    columns = [c for c in state.columns if c != key]
    rows = state.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    best = rows.groupBy(key).agg(F.max(F.struct("_new", F.col(order).alias("_o"), F.struct(*columns).alias("_r"))).alias("_b"))
    return best.select(key, "_b._r.*").select(*state.columns)


def combined_text(parts: DataFrame, document: str, kinds: tuple[str, ...] = ("html",)) -> DataFrame:
    """(document, text): texts of (document, name, kind, text) under each other, those of ``kinds`` first, then by name; empty ones are left out."""
    late = (~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).cast("int")
    rows = parts.filter("length(text) > 0").groupBy(document).agg(F.sort_array(F.collect_list(F.struct(late.alias("late"), "name", "text"))).alias("p"))
    return rows.select(document, F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def crawl_rollup(meta: DataFrame) -> DataFrame:
    """(status, items, documents, ready): items of a crawl (id, status, documents array<struct<status>>) by status; an item is ready if it is done and none of its documents is pending."""
    pending = F.exists("documents", lambda d: d["status"] == "pending")
    ready = (F.col("status") == "done") & ~F.coalesce(pending, F.lit(False))
    return meta.groupBy("status").agg(F.count("*").alias("items"), F.sum(F.coalesce(F.size("documents"), F.lit(0))).alias("documents"), F.count_if(ready).alias("ready"))


def numbered_places(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a persisted ``pos`` from 0 by ``order``: what the order of lines is in a file.

    Ranks are counted within ranges of the sorted rows and shifted by the ranges before, so that no task holds all of them.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    inside = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("_i")))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(sizes.select("_p", "_before")), "_p").withColumn("pos", F.col("_before") + F.col("_n") - 1).drop("_p", "_i", "_n", "_before")


def complete_edition(blocks: DataFrame, least_article: int = 90) -> DataFrame:
    """``blocks`` of a fetched edition; an error where no title of an article numbered ``least_article`` or higher is among them, as the page was cut then."""
    number = F.regexp_extract("text", r"^Статья\s+(\d+)", 1).try_cast("int")
    last = blocks.agg(F.max(number).alias("n")).first()["n"]
    if last is None or last < least_article:
        raise ValueError(f"the edition ends at article {last}")
    return blocks
