"""Hierarchical ids of units: law:edition:art.N[:ch.M[:p.K]]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_norm_id(law: Column, edition: Column, article: Column, part: Column, point: Column) -> Column:
    """The id of a unit; a point needs its part, null levels are left out."""
    return F.concat_ws(":", law, edition, F.concat(F.lit("art."), article), F.concat(F.lit("ch."), part), F.when(part.isNotNull(), F.concat(F.lit("p."), point)))


def article_key(norm_id: Column) -> Column:
    """law:art.N of a unit id in any edition; an id without an article is an error."""
    number = F.regexp_extract(norm_id, r":(art\.\d+(?:\.\d+)?)(?:$|:)", 1)
    return F.when(number == "", F.raise_error(F.concat(F.lit("no article in "), norm_id))).otherwise(F.concat(F.regexp_extract(norm_id, "^([^:]*)", 1), F.lit(":"), number))


def unit_key(norm_id: Column) -> Column:
    """The id without its edition."""
    return F.regexp_replace(norm_id, "^([^:]*):[^:]*", "$1")


def part_of(norm_id: Column) -> Column:
    return F.nullif(F.regexp_extract(norm_id, r":ch\.([^:]+)", 1), F.lit(""))


def point_of(norm_id: Column) -> Column:
    return F.nullif(F.regexp_extract(norm_id, r":p\.([^:]+)", 1), F.lit(""))


def prefixes(norm_id: Column) -> Column:
    """The id and all its ancestors' ids, longest first."""
    parts = F.split(norm_id, ":")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), ":"))
