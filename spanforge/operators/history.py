"""Histories of entities whose attributes change, from periodic snapshots.

The history is event-sourced: each attribute has a change log of its own, with the interval in which each of its
values held.  The logs of an entity are combined by splitting time at the union of their boundaries, reading every
attribute in each piece, and coalescing pieces with equal values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_log(snapshots: DataFrame, entity: list[str], position: str, attributes: list[str]) -> DataFrame:
    """(*entity, attribute, value, from_position, to_position) of each attribute's own intervals.

    ``snapshots`` holds one row for each entity and snapshot position that has it, positions counting 1, 2, 3, ...
    Attributes are compared as strings, null being a value of its own.  An interval covers the positions from
    ``from_position`` up to, not including, ``to_position``; a position without the entity ends all its intervals.
    No rows give no log.
    """
    w = Window.partitionBy(*entity).orderBy(position)
    before, after = F.lag(position).over(w), F.lead(position).over(w)
    fresh = before.isNull() | (before != F.col(position) - 1)
    flagged = snapshots.select(
        *entity,
        F.col(position).alias("_at"),
        fresh.alias("_fresh"),
        (after.isNull() | (after != F.col(position) + 1)).alias("_last"),
        *(F.col(a).cast("string").alias(a) for a in attributes),
        *((fresh | ~F.lag(F.col(a).cast("string")).over(w).eqNullSafe(F.col(a).cast("string"))).alias(f"_new_{a}") for a in attributes),
    )
    events = F.filter(
        F.array(
            *(F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value"), F.col(f"_new_{a}").alias("starts")) for a in attributes),
        ),
        lambda e: e["starts"],
    )
    ends = F.when(F.col("_last"), F.array(*(F.struct(F.lit(a).alias("attribute"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("starts")) for a in attributes)))
    started = flagged.select(*entity, "_at", F.explode(events).alias("_e"))
    ended = flagged.filter("_last").select(*entity, (F.col("_at") + 1).alias("_at"), F.explode(ends).alias("_e"))
    log = started.unionByName(ended).select(*entity, "_at", "_e.attribute", "_e.value", "_e.starts")
    # At one position an end comes before a start: after a gap of no length there is none, as fresh rows start anew.
    by_attribute = Window.partitionBy(*entity, "attribute").orderBy("_at", "starts")
    closed = log.withColumn("to_position", F.lead("_at").over(by_attribute))
    return closed.filter("starts").select(*entity, "attribute", "value", F.col("_at").alias("from_position"), "to_position")


def combine_logs(log: DataFrame, entity: list[str], attributes: list[str]) -> DataFrame:
    """(*entity, *attributes, from_position, to_position): maximal intervals in which all attributes hold.

    Time is split at the union of the logs' boundaries; pieces in which the entity is absent vanish and adjacent pieces
    with equal values are coalesced.
    """
    marks = log.select(*entity, F.explode(F.array("from_position", "to_position")).alias("_at")).distinct()
    changes = log.groupBy(*entity, F.col("from_position").alias("_at")).agg(
        *(F.max(F.when(F.col("attribute") == a, F.struct("to_position", "value"))).alias(f"_{a}") for a in attributes)
    )
    w = Window.partitionBy(*entity).orderBy("_at")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = marks.join(changes, [*entity, "_at"], "left").select(
        *entity, "_at", F.lead("_at").over(w).alias("_to"), *(F.last(f"_{a}", ignorenulls=True).over(upto).alias(f"_{a}") for a in attributes)
    )
    alive = pieces.filter(F.col("_to").isNotNull() & F.greatest(*(F.col(f"_{a}.to_position") for a in attributes), F.lit(0)).__gt__(F.col("_at")))
    rows = alive.select(*entity, "_at", "_to", *(F.col(f"_{a}.value").alias(a) for a in attributes))
    same = F.lag("_to").over(w).eqNullSafe(F.col("_at"))
    for a in attributes:
        same = same & F.lag(a).over(w).eqNullSafe(F.col(a))
    run = rows.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(upto))
    return run.groupBy(*entity, "_run").agg(F.min("_at").alias("from_position"), F.max("_to").alias("to_position"), *(F.first(a).alias(a) for a in attributes)).drop("_run")


def entity_history(snapshots: DataFrame, entity: list[str], position: str, attributes: list[str]) -> DataFrame:
    """All versions of each entity with the positions in which each held: ``change_log`` and ``combine_logs``.

    An entity's rows are as many as its snapshots; they are hashes and flags, not texts, when the caller passes digests of
    long attributes, and windows over them spill to disk.
    """
    return combine_logs(change_log(snapshots, entity, position, attributes), entity, attributes)
