"""Quotes and spans of evidence."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

# Quotation marks and hyphens that count as one character each.
_KINDS = {'"': "«»“”„‟", "'": "‘’" + chr(0x2BC) + "`", "-": "‐‑‒–—−"}
_FOLD = {ord(c): k for k, chars in _KINDS.items() for c in chars}
_TRIM = re.compile(r"^[\s#>*•·\-–—|]+|[\s|*]+$")


def located(quote: str | None, source: str | None) -> tuple[int, int] | None:
    """(start, end) of the quote in the source, quotation marks, hyphens and space being folded; None where it is not found."""
    if not quote or not source or not quote.strip():
        return None
    text, places, blank = [], [], True
    for i, c in enumerate(source.translate(_FOLD)):
        if c.isspace():
            if not blank:
                text.append(" ")
                places.append(i)
            blank = True
        else:
            text.append(c)
            places.append(i)
            blank = False
    wanted = " ".join(quote.translate(_FOLD).split())
    at = "".join(text).find(wanted)
    return None if at < 0 else (places[at], places[at + len(wanted) - 1] + 1)


def candidates(text: str | None, most: int = 200) -> list[tuple[str, int, int, str]]:
    """(id, start, end, text) of quotable spans: whole words of a line, packed up to ``most`` characters; a longer word stands alone."""
    out: list[tuple[str, int, int, str]] = []
    at = 0
    for line in (text or "").split("\n"):
        lead = re.match(r"^[\s#>*•·\-–—|]*", line).end()
        body = _TRIM.sub("", line)
        start = end = None
        for m in re.finditer(r"\S+", body):
            a, b = at + lead + m.start(), at + lead + m.end()
            if start is not None and b - start > most:
                out.append((f"s{len(out)}", start, end, text[start:end]))
                start = None
            start, end = (a if start is None else start), b
        if start is not None:
            out.append((f"s{len(out)}", start, end, text[start:end]))
        at += len(line) + 1
    return out


_SPAN = T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())])
_CANDIDATES = T.ArrayType(T.StructType([T.StructField("span_id", T.StringType()), *_SPAN.fields, T.StructField("text", T.StringType())]))


def quote_span(quote: Column, source: Column) -> Column:
    """Struct of char_start and char_end, null members where the quote is not in the source."""

    def all_(quotes: pd.Series, sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([located(q, s) or (None, None) for q, s in zip(quotes, sources)], columns=["char_start", "char_end"])

    return F.pandas_udf(all_, _SPAN)(quote, source)


def quote_candidates(text: Column) -> Column:
    """Array of (span_id, char_start, char_end, text)."""

    def all_(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("span_id", "char_start", "char_end", "text"), c)) for c in candidates(t)] for t in texts])

    return F.pandas_udf(all_, _CANDIDATES)(text)


def contains_quote(quote: Column, source: Column) -> Column:
    """Whether the quote is in the source, marks, hyphens and space folded, without leaving the JVM."""
    fold = lambda c: F.trim(F.regexp_replace(F.translate(c, "".join(_KINDS.values()), "".join(k * len(v) for k, v in _KINDS.items())), r"(?U)\s+", " "))
    return F.coalesce((F.length(fold(quote)) > 0) & F.contains(fold(source), fold(quote)), F.lit(False))


def register_quote_spans(spark: SparkSession, name: str = "quote_spans") -> None:
    """Makes the quotable spans of a text a table function of SQL: ``SELECT ... FROM t, LATERAL quote_spans(t.text)``; a null text has none."""

    @udtf(returnType="span_id string, char_start int, char_end int, span string")
    class QuoteSpans:
        def eval(self, text: str):
            yield from candidates(text)

    spark.udtf.register(name, QuoteSpans)
