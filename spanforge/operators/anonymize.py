"""Numbered placeholders for names, contacts and numbers across the fields of a record."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CAP = "[А-ЯЁ][а-яё]+"
#: (kind, pattern) in order of precedence; the group `value` is what is replaced, or the whole match.
RULES = (
    ("EMAIL", re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")),
    ("SNILS", re.compile(r"(?i)снилс\D{0,20}(?P<value>\d{3}[- ]?\d{3}[- ]?\d{3}[- ]?\d{2})(?!\d)")),
    ("SNILS", re.compile(r"(?<!\d)(?P<value>\d{3}[- ]\d{3}[- ]\d{3}[ -]\d{2})(?!\d)")),
    ("PHONE", re.compile(r"(?<![\d-])(?P<value>(?:\+7|8)[\s-]*\(?\d{3}\)?[\s-]*\d{3}[\s-]*\d{2}[\s-]*\d{2})(?!\d)")),
    ("PASSPORT", re.compile(r"(?i)паспорт\D{0,20}(?P<value>\d{2}\s?\d{2}\s?(?:№\s?)?\d{6})(?!\d)")),
    ("TAX_ID", re.compile(r"(?i)инн\D{0,5}(?P<value>\d{10}(?:\d{2})?)(?!\d)")),
    ("TAX_ID", re.compile(r"(?i)\b(?:инн|кпп|огрн(?:ип)?)\W{0,3}(?P<value>\d{9,15})\b")),
    ("BANK_ACCOUNT", re.compile(r"(?i)\b(?:бик|[рк]/?с|(?:расч[её]тн|корреспондентск)\w+\s+сч[её]т\w*)\W{0,3}(?P<value>\d{9,20})\b")),
    ("BANK_ACCOUNT", re.compile(r"(?i)сч[её]т\D{0,10}(?P<value>\d{20})(?!\d)")),
    ("BIRTH_DATE", re.compile(r"(?i)(?P<value>\d{2}\.\d{2}\.\d{4})(?=\s*(?:года рождения|г\.\s?р\.))")),
    ("BIRTH_DATE", re.compile(r"(?i)\b(?:дата\s+рождения|родил(?:ся|ась))\W{0,3}(?P<value>\d{1,2}[./-]\d{1,2}[./-]\d{2,4})\b")),
    ("ADDRESS", re.compile(r"(?i)\b(?:адрес\s+(?:регистрации|проживания|места\s+жительства)|место\s+жительства)\s*[:—-]\s*(?P<value>[^\s;<][^\n;]{4,179})")),
    ("ADDRESS", re.compile(r"(?:г\.|ул\.|пр-кт|пер\.)\s?" + _CAP + r"(?:,?\s(?:ул\.|пр-кт|пер\.|д\.|кв\.|оф\.|корп\.)\s?[\w/-]+)+")),
    ("PERSON", re.compile(rf"{_CAP}(?:-{_CAP})?\s{_CAP}\s[А-ЯЁ][а-яё]+(?:вич|вна|вича|вны|вичу|вне|вичем|вной|виче)\b")),
    ("PERSON", re.compile(rf"{_CAP}\s[А-ЯЁ][а-яё]+(?:вич|вна|вича|вны|вичу|вне|вичем|вной|виче)\s{_CAP}")),
    ("PERSON", re.compile(rf"{_CAP}(?:-{_CAP})?\s[А-ЯЁ]\.\s?[А-ЯЁ]\.")),
    ("PERSON", re.compile(rf"[А-ЯЁ]\.\s?[А-ЯЁ]\.\s?{_CAP}(?:-{_CAP})?")),
    ("PERSON", re.compile(rf"\b(?i:Ф\.?\s?И\.?\s?О\.?|индивидуальн(?:ый|ого)\s+предпринимател[ья]|представител[ья]|заявител[ья])\s*[:—-]?\s*(?P<value>{_CAP}(?:-{_CAP})?(?:\s{_CAP}){{1,2}})")),
)


#: Kinds that a manual redaction may have.
MANUAL_KINDS = frozenset(k for k, _ in RULES) | {"ORGANIZATION", "OTHER"}


def scan(text: str | None, manual: tuple[tuple[str, str, bool], ...] = ()) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, rule) without overlap; ``manual`` (kind, literal, ignore case) goes before all rules and must be of a known kind.

    Spans are taken by start, then the longer, then the earlier rule; one that begins before the last ended is dropped.
    """
    if not text:
        return []
    if unknown := {k for k, _, _ in manual} - MANUAL_KINDS:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    rules = [(k, re.compile(re.escape(v), re.I if fold else 0)) for k, v, fold in manual] + list(RULES)
    spans = []
    for n, (kind, pattern) in enumerate(rules):
        for m in pattern.finditer(text):
            a, b = m.span("value") if "value" in pattern.groupindex else m.span()
            spans.append((a, a - b, n, kind, b))
    out, last = [], -1
    for a, _, n, kind, b in sorted(spans):
        if a >= last and b > a:
            out.append((kind, a, b, n))
            last = b
    return out


def replaced(fields: list[str | None], manual: tuple = ()) -> tuple[list[str | None], Counter]:
    """The fields with <KIND_n>, numbered per kind by first appearance in field order; equal values, case folded, share a number."""
    numbers: dict[tuple[str, str], int] = {}
    seen: Counter = Counter()
    counts: Counter = Counter()
    out: list[str | None] = []
    for text in fields:
        if text is None:
            out.append(None)
            continue
        parts, at = [], 0
        for kind, a, b, _ in scan(text, manual):
            key = (kind, text[a:b].strip().casefold())
            if key not in numbers:
                seen[kind] += 1
                numbers[key] = seen[kind]
            parts += [text[at:a], f"<{kind}_{numbers[key]}>"]
            at = b
            counts[kind] += 1
        out.append("".join(parts) + text[at:])
    return out, counts


def anonymized(rows: DataFrame, key: str, fields: list[str], manual: tuple = ()) -> DataFrame:
    """(key, *fields, detections): anonymised fields of each record and how many spans of each kind were replaced."""
    schema = T.StructType([*(T.StructField(f, T.StringType()) for f in fields), T.StructField("detections", T.MapType(T.StringType(), T.IntegerType()))])

    def all_(*columns: pd.Series) -> pd.DataFrame:
        done = [replaced(list(values), manual) for values in zip(*columns)]
        return pd.DataFrame([[*texts, dict(counts)] for texts, counts in done], columns=[*fields, "detections"])

    return rows.select(key, F.pandas_udf(all_, schema)(*fields).alias("_a")).select(key, "_a.*")


def audit(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(kind, spans, records) found in the fields."""
    done = anonymized(rows, key, fields)
    return done.select(key, F.explode("detections").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("spans"), F.countDistinct(key).alias("records"))
