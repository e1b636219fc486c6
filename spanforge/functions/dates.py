"""Dates written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Russian month names in the genitive, by number.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def iso_date(written: Column) -> Column:
    """The date as DATE from ISO, day.month.year, day/month/year, year/month/day, compact and spelled-out Russian forms.

    Null where the text is null, empty, in no known form or no calendar date.
    """
    text = F.lower(F.trim(F.regexp_replace(written, r"[\s\x{a0}]+", " ")))
    month = F.regexp_extract(text, "(" + "|".join(MONTHS) + ")", 1)
    number = F.coalesce(*(F.when(month == m, F.lit(f"{i:02d}")) for i, m in enumerate(MONTHS, 1)), F.lit(""))
    spelled = F.concat_ws("-", F.regexp_extract(text, r"(\d{4})", 1), number, F.lpad(F.regexp_extract(text, r"^(\d{1,2}) ", 1), 2, "0"))
    tries = [F.try_to_date(text, f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd")]
    clean = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})[t ]", 1)
    return F.coalesce(*tries, F.try_to_date(F.when(clean != "", clean), "yyyy-MM-dd"), F.when(month != "", F.try_to_date(spelled, "yyyy-MM-dd")))
