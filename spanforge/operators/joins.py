"""Joins that stand a key with a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows, or from ``1 / MOST_HOT`` of all rows if that is more, so that there are at most
#: ``MOST_HOT`` hot keys to broadcast, whatever the data, and no other key fills a task.
HOT_ROWS, MOST_HOT = 500_000, 100_000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which holds one row for each key and in ``weight`` how many of ``rows`` have it.

    The rows of hot keys stay where they are, their table rows being broadcast; all others are shuffled.  Where no key can
    be hot, as there are too few rows, one plain join does.  ``how`` is inner or left; rows with a null key match nothing
    and, in a left join of hot keys, stay where they are too.  The weight is dropped.  Columns of both sides must differ but for the keys.
    ``total`` spares the count of the rows to a caller that knows it, or a number it is not far from.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if total is None:
        total, most = table.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    else:
        most = total
    least = max(HOT_ROWS, -(-total // MOST_HOT))
    if most < least:
        return rows.join(table.drop(weight), keys, how)
    hot = table.filter(F.col(weight) >= least).drop(weight)
    cold = table.filter(F.col(weight) < least).drop(weight)
    first = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    if how == "inner":
        return first.unionByName(rest.join(cold, keys))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return first.unionByName(rest.filter(known).join(cold, keys, "left")).unionByName(rest.filter(~known), allowMissingColumns=True)
