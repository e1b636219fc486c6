"""History of the units of laws (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.dates import iso_date
from spanforge.functions.latest import latest
from spanforge.functions.lookalike import COMPOSED, SKELETON, skeleton
from spanforge.operators.history import entity_history
from spanforge.session import table

FOREVER = "9999-12-31"


def edition_sequence(editions: DataFrame) -> DataFrame:
    """(law_id, edition_id, start, position): the editions of each law in the order of their starts.

    A missing or unreadable effective_from leaves edition_id as the start; of repeated rows the latest download counts;
    equal starts are ordered by edition_id.
    """
    one = latest(editions, ["law_id", "edition_id"], "downloaded_at", ["effective_from"])
    start = F.coalesce(iso_date(F.col("effective_from")), iso_date(F.col("edition_id")))
    dated = one.select("law_id", "edition_id", F.date_format(start, "yyyy-MM-dd").alias("start"))
    return dated.withColumn("position", F.row_number().over(Window.partitionBy("law_id").orderBy("start", "edition_id")))


def unit_versions(editions: DataFrame, norm_units: DataFrame) -> DataFrame:
    """(unit_key, law_id, title, text, is_repealed, valid_from, valid_to): every version of every unit of a law.

    title and text are digests of what the reader sees, so that disguised texts are equal to plain ones.
    """
    parts = F.split("norm_id", ":")
    key = F.concat_ws(":", F.get(parts, F.lit(0)), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))))
    seen = lambda c: F.sha2(skeleton(F.col(c)), 256).alias(c)
    units = latest(norm_units, ["norm_id"], "loaded_at", ["edition_id", seen("title"), seen("text"), "is_repealed"])
    units = units.select(F.get(parts, F.lit(0)).alias("law_id"), "edition_id", key.alias("unit_key"), "title", "text", F.col("is_repealed").cast("string").alias("is_repealed"))
    sequence = edition_sequence(editions)
    placed = units.join(sequence, ["law_id", "edition_id"]).groupBy("law_id", "unit_key", "position").agg(F.max(F.struct("title", "text", "is_repealed")).alias("_v"))
    placed = placed.select("law_id", "unit_key", "position", "_v.*")
    runs = entity_history(placed, ["law_id", "unit_key"], "position", ["title", "text", "is_repealed"])
    starts = sequence.select("law_id", "position", "start")
    begun = runs.join(starts.select("law_id", F.col("position").alias("from_position"), F.col("start").alias("valid_from")), ["law_id", "from_position"])
    ended = begun.join(starts.select("law_id", F.col("position").alias("to_position"), F.col("start").alias("valid_to")), ["law_id", "to_position"], "left")
    return ended.select("law_id", "unit_key", "title", "text", "is_repealed", "valid_from", F.coalesce("valid_to", F.lit(FOREVER)).alias("valid_to"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return unit_versions(table(spark, d, "editions"), table(spark, d, "norm_units")).select("unit_key", "valid_from", "valid_to")


def _sql_skeleton(x: str) -> str:
    """``skeleton`` as SQL: characters of one shape translated, invisible ones dropped, accents composed."""
    kept, gone = [(a, b) for a, b in SKELETON.items() if b], [a for a, b in SKELETON.items() if not b]
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    out = f"translate({x}, {quoted(''.join(a for a, _ in kept) + ''.join(gone))}, {quoted(''.join(b for _, b in kept))})"
    for pair, one in COMPOSED.items():
        out = f"replace({out}, {quoted(pair)}, {quoted(one)})"
    return out


SQL = {
    "p2_found": rf"""WITH nu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm_id ORDER BY loaded_at DESC) AS rn FROM norm_units) WHERE rn = 1),
    ed AS (SELECT law_id, edition_id, arg_max(effective_from, downloaded_at) AS ef FROM editions GROUP BY law_id, edition_id),
    es AS (SELECT law_id, edition_id, CASE WHEN regexp_matches(ef, '^\d{{4}}-\d\d-\d\d$') THEN ef WHEN regexp_matches(ef, '^\d\d\.\d\d\.\d{{4}}$') THEN ef[7:10] || '-' || ef[4:5] || '-' || ef[1:2] ELSE edition_id END AS start FROM ed),
    sq AS (SELECT *, row_number() OVER w AS pos, lead(start) OVER w AS nx FROM es WINDOW w AS (PARTITION BY law_id ORDER BY start, edition_id)),
    u AS (SELECT regexp_replace(norm_id, '^([^:]*):[^:]*', '\1') AS unit_key, pos, start, nx, {_sql_skeleton("title")} AS t, {_sql_skeleton("text")} AS x, is_repealed AS r
          FROM nu JOIN sq ON sq.law_id = split_part(norm_id, ':', 1) AND sq.edition_id = nu.edition_id),
    f AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(t) OVER w IS NOT DISTINCT FROM t AND lag(x) OVER w IS NOT DISTINCT FROM x AND lag(r) OVER w IS NOT DISTINCT FROM r THEN 0 ELSE 1 END AS fresh FROM u WINDOW w AS (PARTITION BY unit_key ORDER BY pos)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY unit_key ORDER BY pos) AS run FROM f)
    SELECT unit_key, min(start) AS valid_from, CASE WHEN bool_or(nx IS NULL) THEN '9999-12-31' ELSE max(nx) END AS valid_to FROM g GROUP BY unit_key, run"""
}
