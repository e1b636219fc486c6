"""The valid row of a key that stands in several rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: str | None, columns: list[str | Column]) -> DataFrame:
    """One row for each key with ``columns`` of its row with the greatest ``version``.

    Rows with equal versions are exact copies, so any of them serves; the greatest by value is taken, for a stable
    result.  A null version is older than any other.  Without ``version`` the greatest row is taken.  Null keys form a
    key of their own.  Partial aggregates leave one row for each key and task before the shuffle, so that a key
    that holds a third of all rows is no hot spot.
    """
    chosen = df.select(*keys, *([version] if version else []), F.struct(*columns).alias("_row"))
    order = F.struct(*([F.col(version)] if version else []), F.col("_row"))
    return chosen.groupBy(*keys).agg(F.max(order).alias("_best")).select(*keys, "_best._row.*")
