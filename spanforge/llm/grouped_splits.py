"""Splits that keep linked records together: connected components, then grouped iterative stratification."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.lookalike import caseless_skeleton
from spanforge.operators.joins import lookup
from spanforge.session import cut, shared_folder

# Ways of writing "unknown", as letters and digits only.
UNKNOWN = ("", "нет", "нетгруппы", "нетданных", "unknown", "na", "nan", "none", "null", "неуказано", "неуказан", "неизвестно", "неопределено", "отсутствует", "бн", "без номера", "безномера", "н д", "нд", "x", "xxx")


def link_value(value: Column) -> Column:
    """Letters and digits of a linking value, without case and look-alikes; null where it means "unknown" or holds only zeros."""
    # "№" and its abbreviations stand before the number and are no part of it.
    bare = F.regexp_replace(F.upper(value), r"№|^\s*(?:NO?|Н)[.\s°º]+(?=\d)", "")
    folded = F.regexp_replace(caseless_skeleton(bare), r"[^\p{L}\p{N}]", "")
    unknown = [caseless_skeleton(F.lit(u.replace(" ", ""))) for u in UNKNOWN]
    return F.when(folded.isin(unknown) | folded.rlike("^0*$"), None).otherwise(folded)


def components(links: DataFrame, node: str, key: str, most_rounds: int = 60) -> DataFrame:
    """(node, root): each node of ``links`` (node, key) with the smallest node linked to it, directly or through others.

    Nodes that share a key are linked; null keys link nothing and null nodes are left out.  Large-star and small-star
    rounds run until the edges stand still; a component of a third of all nodes is a star after the first rounds, and a
    round moves each of its edges once, its minimum being found by partial aggregates and handed to hot nodes'
    and keys' rows where they lie.  Every round is written to the shared folder.
    """
    rows = links.select(F.col(node).alias("u"), F.col(key).alias("k")).filter("u is not null")
    nodes = rows.select("u").distinct()
    keyed = rows.filter("k is not null").distinct()
    centre = keyed.groupBy("k").agg(F.min("u").alias("m"), F.count("*").alias("n")).filter("n > 1")
    state = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    edges, before = cut(lookup(keyed, centre, ["k"], "n").filter("u <> m").select("u", F.col("m").alias("v")).distinct(), *state)
    for _ in range(most_rounds):
        # Large star: every greater neighbour of a node is tied to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (both sides of an edge: a node's weight in ``both`` is its degree)
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = cut(lookup(both.filter("v > u"), least, ["u"], "n", total=before["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # Small star: a node and its lesser neighbours are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = lookup(large, low, ["u"], "n", total=before["n"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges, now = cut(small.select("e.*").filter("u <> v").distinct(), *state)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(edges, "u", "left").select(F.col("u").alias(node), F.coalesce("v", "u").alias("root"))


def stratify(types: Iterable[tuple], left: list[float], wanted: dict) -> Iterator[list[int]]:
    """How many of each type's components go to each split; a type is (count of components, size, {label: count}, leading label).

    Types come rarest leading label first, a label's largest components before its small ones.  The components of a type
    are alike, so that all but a few are dealt at once, in proportion to what the splits still want of the leading label;
    each of the others goes to the split that wants most of it, ties to the one with most room, then to the first.
    ``left`` (records) and ``wanted`` ({label: [records of each split]}) shrink.  What is held grows with the labels only.
    """
    k = len(left)
    for many, size, labels, leading in types:
        open_ = [max(0.0, x) for x in wanted[leading]]
        total = sum(open_)
        quota = [0] * k
        if many > k and total > 0:
            quota = [min(int(many * x / total), int(x / labels[leading])) for x in open_]

        def take(s: int, n: int) -> None:
            left[s] -= n * size
            for x, c in labels.items():
                wanted[x][s] -= n * c

        for s in range(k):
            take(s, quota[s])
        for _ in range(min(many - sum(quota), 4 * k)):
            s = max(range(k), key=lambda s: (wanted[leading][s], left[s], -s))
            quota[s] += 1
            take(s, 1)
        if rest := many - sum(quota):
            # Nothing is wanted any more: the rest goes where there is room.
            room = [max(0.0, x) for x in left]
            share = [x / sum(room) if sum(room) else 1 / k for x in room]
            more = [int(rest * x) for x in share]
            more[max(range(k), key=lambda s: share[s])] += rest - sum(more)
            for s in range(k):
                quota[s] += more[s]
                take(s, more[s])
        yield quota


def grouped_splits(members: DataFrame, node: str, root: str, label: str, proportions: dict[str, float], block: int = 50_000) -> DataFrame:
    """(node, root, split): whole components in splits with about the given proportions of records and of each label.

    Grouped iterative stratification: components are aggregated to label vectors, and components with equal vectors, which
    are interchangeable, to types.  The types are placed in one sequence at any size of the data: the type whose
    rarest label is the rarest of all comes first, the largest components of a label before its small ones.  The driver
    streams over the types, holds what each split still wants of each label and hands on ``block`` decisions at a time, so that it
    holds neither components nor types; which components of a type go where is found by their order, in parallel.

    A null label is a label of its own; no rows give no splits; repeated nodes count once.
    """
    spark, names = members.sparkSession, list(proportions)
    share = [proportions[n] / sum(proportions.values()) for n in names]
    rows = members.select(F.col(node).alias("node"), F.col(root).alias("root"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label")).dropDuplicates(["node"])
    counted = cut(rows.groupBy("root", "label").agg(F.count("*").alias("n")))
    labels = counted.groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("_rows"))
    totals = {r["label"]: r["total"] for r in labels.toLocalIterator()}
    known = lookup(counted, labels, ["label"], "_rows")
    entry = F.struct("total", "label", "n")
    vectors = known.groupBy("root").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(entry)).alias("labels"))
    vectors = cut(vectors.withColumn("type", F.xxhash64("labels")))
    types = vectors.groupBy("type", "size", "labels").agg(F.count("*").alias("many"))
    types = cut(types)
    leading = F.col("labels")[0]
    ordered = types.orderBy(leading["total"], leading["label"], F.desc(leading["n"]), F.desc("size"), "type")
    numbers: list[tuple[int, int]] = []

    def stream() -> Iterator[tuple]:
        for r in ordered.toLocalIterator():
            numbers.append((r["type"], r["size"]))
            yield r["many"], r["size"], {x["label"]: x["n"] for x in r["labels"]}, r["labels"][0]["label"]

    folder, schema = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}", "type long, size long, upto array<long>"
    spark.createDataFrame([], schema).write.parquet(folder)
    done: list[tuple] = []
    wanted = {x: [n * s for s in share] for x, n in totals.items()}
    for quota in stratify(stream(), [sum(totals.values()) * s for s in share], wanted):
        done.append((*numbers.pop(), list(accumulate(quota))))
        if len(done) >= block:
            spark.createDataFrame(done, schema).write.mode("append").parquet(folder)
            done = []
    if done:
        spark.createDataFrame(done, schema).write.mode("append").parquet(folder)
    placed = spark.read.schema(schema).parquet(folder)
    # The place of a component among its type: places within a bucket, after the counts of the buckets before.
    spread = vectors.select("root", "type", "size", F.pmod(F.xxhash64("root", F.lit(1)), F.lit(1024)).alias("bucket"))
    inside = spread.withColumn("place", F.row_number().over(Window.partitionBy("type", "size", "bucket").orderBy("root")))
    before = Window.partitionBy("type", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("type", "size", "bucket").agg(F.count("*").alias("here"))
    starts = counts.withColumn("start", F.coalesce(F.sum("here").over(before), F.lit(0)))
    found = lookup(inside, starts.join(placed, ["type", "size"]), ["type", "size", "bucket"], "here")
    index = F.size(F.filter("upto", lambda u: u < F.col("place") + F.col("start")))
    names_ = F.array(*(F.lit(n) for n in names))
    chosen = found.select("root", F.get(names_, index).alias("split"))
    weights = chosen.join(vectors.select("root", "size"), "root")
    return lookup(rows.select("node", "root"), weights, ["root"], "size").select(F.col("node").alias(node), F.col("root").alias(root), "split")
