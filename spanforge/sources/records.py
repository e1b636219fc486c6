"""Strict readers and writers of line-delimited records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPAN = "struct<path:string,char_start:int,char_end:int,quote:string,note:string>"
CHUNK = "chunk_id string, edition_id string, chunking string, text string, char_start int, char_end int, norm_ids array<string>, max_chunk int, article_title_prefix boolean"
UNIT = "norm_id string, edition_id string, article string, part string, point string, unit_level string, parent_norm_id string, title string, text string, char_start int, char_end int, unit_order int, is_retrieval_unit boolean, is_repealed boolean"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """The objects of a JSONL file; blank lines are passed over.

    Strict reading fails at a line that is no object of the schema; otherwise such lines stay in ``_corrupt_record``.
    """
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if not strict:
        schema = f"{schema}, _corrupt_record string" if isinstance(schema, str) else schema.add("_corrupt_record", "string")
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, keys in order, nulls kept."""
    columns = [F.col(c) for c in sorted(df.columns)]
    df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(number, place): numbers or links with complaintNumber=, first occurrence each; # starts a comment."""
    line = F.trim(F.split("value", "#")[0])
    number = F.coalesce(F.nullif(F.regexp_extract(line, r"complaintNumber=([^&\s]+)", 1), F.lit("")), F.when(line.rlike(r"^[0-9]+$"), line))
    rows = spark.read.text(path).select(number.alias("number"), F.monotonically_increasing_id().alias("place")).filter("number is not null")
    return rows.groupBy("number").agg(F.min("place").alias("place"))


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """Parquet by partition columns; an existing path is an error, never overwritten."""
    df.write.mode("errorifexists").partitionBy(*columns).parquet(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    """CSV with arrays joined by ";"."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("header", True).mode("errorifexists").csv(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A pipe table of a small result; more than ``most`` rows are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *([show(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
