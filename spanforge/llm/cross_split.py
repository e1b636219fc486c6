"""The same or nearly the same records in different splits, by a weighted cosine join over inverted lists.

A record is a vector over its word pairs (neighbouring words); a pair that stands f times in it and whose list is rare has the weight
root(f * rarity).  The dot product of two vectors is at least the rarity of the pairs that the records share.  Two records of
words that differ by an edit distance of at most a share s of the longer one lose few pairs (``_lost``), the rarest at
worst, so that each record knows the least dot product that a partner must reach.  Pruning, which loses no pair:

* maximum weight: what a list can add is bounded by the greatest count that a record of another split has in it.  Lists
  that no other split is in add nothing; a record that cannot reach its bound even with all its lists has no partner; only the
  rarest pairs enter the inverted lists, until all others together cannot reach the bound;
* residual norm: where two records meet in their first common list, the rest of the product is at most the product of the
  norms of what follows there;
* a bitmap of the record's words: a bit that only one of two records has stands for a word that an edit must take away;
* the exact dot product and then the exact word edit distance decide about what is left.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.words import cached_words, within
from spanforge.operators.joins import lookup
from spanforge.session import cut

#: Slots of the table of pair counts by which rarity is judged: its size is fixed, whatever the input.
COUNT_SLOTS = 1 << 20
BITMAP_LONGS = 6
#: Entries of one list that meet in a task; a longer list is cut into parts that all meet each other.
LIST_PART = 4000
#: A broadcast table of long lists has at most so many rows, or it is joined by shuffle.
MOST_BROADCAST = 100_000


_KNOWN_WORDS = 400_000


def _word_hashes(tokens: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; ``known`` keeps those of words seen before and is emptied when it is large."""
    if len(known) > _KNOWN_WORDS:
        known.clear()
    for w in tokens:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def _pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words, in their order."""
    mixed = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each distinct word, by its hash."""
    bits = np.zeros(64 * BITMAP_LONGS, dtype=np.uint8)
    bits[(hashes >> np.uint64(8)) % np.uint64(64 * BITMAP_LONGS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def text_classes(records: DataFrame, key: str, side: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Members (key, side, class_id) and classes (class_id, side, words, n, rows): equal texts, once folded, are one class.

    Records without a word, and null texts, are in no class.
    """
    key_type, side_type = records.schema[key].dataType.simpleString(), records.schema[side].dataType.simpleString()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}
        for b in batches:
            folded = [" ".join(cached_words(t, known)) if t is not None else "" for t in b["text"]]
            ids = [hashlib.blake2b(t.encode(), digest_size=12).hexdigest() if t else None for t in folded]
            yield pd.DataFrame({"key": b["key"], "side": b["side"], "class_id": ids, "words": folded})[[i is not None for i in ids]]

    rows = records.select(F.col(key).alias("key"), F.col(side).alias("side"), F.col(text).alias("text")).filter("text is not null")
    members = cut(rows.mapInPandas(digest, f"key {key_type}, side {side_type}, class_id string, words string"))
    classes = cut(members.groupBy("class_id", "side").agg(F.count("*").alias("rows"), F.first("words").alias("words")))
    return members.drop("words"), classes


def _slot_table(classes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per slot: how many classes have a pair there, the greatest count of a pair in one split's class, and in the others'.

    A task hands on its used slots only, so that the table's fixed size bounds what is shuffled and collected.
    """
    side_type = classes.schema["side"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        known: dict[str, int] = {}
        for b in batches:
            for side, t in zip(b["side"], b["words"]):
                slots, times = np.unique(_pair_hashes(_word_hashes(t.split(), known)), return_counts=True)
                slots = (slots % COUNT_SLOTS).astype(np.int64)
                if side not in total:
                    total[side] = np.zeros((2, COUNT_SLOTS), dtype=np.int32)
                np.add.at(total[side][0], slots, 1)
                np.maximum.at(total[side][1], slots, times.astype(np.int32))
        for side, (n, most) in total.items():
            used = np.flatnonzero(n)
            yield pd.DataFrame({"side": side, "slot": used, "n": n[used].astype(np.int64), "most": most[used].astype(np.int64)})

    per_side = classes.filter("side is not null").select("side", "words").mapInPandas(count, f"side {side_type}, slot long, n long, most long").groupBy("slot", "side").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    best = F.max(F.struct("most", "side"))
    got = per_side.groupBy("slot").agg(F.sum("n").alias("n"), best.alias("first"), F.slice(F.sort_array(F.collect_list("most"), False), 2, 1).alias("second"), F.count("*").alias("sides"))
    got = got.select("slot", "n", F.col("first.most").alias("first"), F.xxhash64("first.side").alias("owner"), F.coalesce(F.get("second", F.lit(0)), F.lit(0)).alias("second")).toPandas()
    slots = got["slot"].to_numpy(dtype=np.int64)
    n, owner, most = np.zeros(COUNT_SLOTS, dtype=np.int64), np.zeros(COUNT_SLOTS, dtype=np.int64), np.zeros((2, COUNT_SLOTS), dtype=np.float32)
    n[slots], owner[slots] = got["n"], got["owner"]
    most[0, slots], most[1, slots] = got["first"], got["second"]
    return n, owner, most


def _lost(n: int, share: float) -> int:
    """How many of its n - 1 pairs a record of n words can lose to a partner whose edits are at most ``share`` of the longer one."""
    longest = int(n / (1 - share) + 1e-9) if share < 1 else 2 * n
    return max(n - m + 2 * int(share * m + 1e-9) for m in range(n, longest + 1))


def _postings(classes: DataFrame, share: float) -> DataFrame:
    """(term, class_id, side, n, own, rest, least, b0, b1, ...): the lists that each class must enter.

    ``own`` is the weight in the list, ``rest`` the norm of what follows it, ``least`` the dot product that a partner must reach.
    """
    table = classes.sparkSession.sparkContext.broadcast((*_slot_table(classes), max(1, classes.count())))
    names = [f"b{i}" for i in range(BITMAP_LONGS)]

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, owner, most, total = table.value
        known: dict[str, int] = {}
        for b in batches:
            lengths, bitmaps, bounds = np.zeros(len(b), dtype=np.int32), np.zeros((len(b), BITMAP_LONGS), dtype=np.int64), np.zeros(len(b))
            entries: list[tuple] = [(np.empty(0, dtype=np.int64),) + (np.empty(0),) * 2]
            many = np.zeros(len(b), dtype=np.int64)
            for i, (side_id, text) in enumerate(zip(b["side_id"], b["words"])):
                tokens = text.split()
                hashes = _word_hashes(tokens, known)
                terms, tf = np.unique(_pair_hashes(hashes), return_counts=True)
                slots = (terms % COUNT_SLOTS).astype(np.int64)
                order = np.lexsort((terms, counts[slots]))
                terms, tf, slots = terms[order].astype(np.int64), tf[order], slots[order]
                rarity = np.log1p(total / np.maximum(counts[slots], 1))
                lost, mass = _lost(len(tokens), share), np.cumsum(tf)
                # The lost pairs are the rarest, which stand first.
                gone = np.minimum(tf, np.maximum(0, lost - (mass - tf)))
                least = float(((tf - gone) * rarity).sum())
                other = np.where(owner[slots] == side_id, most[1, slots], most[0, slots])
                # (what two records share in a list is at most the smaller of their counts)
                adds = rarity * np.minimum(tf, other)
                after = np.concatenate([np.cumsum(adds[::-1])[::-1], [0.0]])
                if after[0] < least - 1e-6:
                    continue
                norms = np.sqrt(np.concatenate([np.cumsum((rarity * tf * (other > 0))[::-1])[::-1], [0.0]]))
                kept = np.flatnonzero((after[:-1] >= least - 1e-6) & (other > 0))
                lengths[i], bitmaps[i], bounds[i], many[i] = len(tokens), _bitmap(hashes), least, len(kept)
                entries.append((terms[kept], np.sqrt(rarity * tf)[kept], norms[kept + 1]))
            term, own, rest = (np.concatenate(x) for x in zip(*entries))
            of = np.repeat(np.arange(len(b)), many)
            yield pd.DataFrame({
                "term": term, "class_id": b["class_id"].to_numpy()[of], "side": b["side"].to_numpy()[of], "n": lengths[of], "own": own, "rest": rest, "least": bounds[of],
                **{x: bitmaps[of, k] for k, x in enumerate(names)},
            })

    side_type = classes.schema["side"].dataType.simpleString()
    known = classes.filter("side is not null").select("class_id", "side", F.xxhash64("side").alias("side_id"), "words")
    return known.mapInPandas(lists, f"term long, class_id string, side {side_type}, n int, own double, rest double, least double, " + ", ".join(f"{x} long" for x in names))


def links(classes: DataFrame, share: float = 0.2) -> DataFrame:
    """(class_a, side_a, class_b, side_b, cosine, edits): classes of different sides whose words differ by at most ``share``.

    ``side_a`` < ``side_b``.  Sides that are null are in no link.  Equal classes on two sides are no link but one class.
    ``share`` is below a third, so that no record of two words or more can lose all its pairs.  Lists of one side only go no further, and a long list is cut into parts, each pair of
    which meets in a task of its own, so that a template in a third of the records fills no task.
    """
    if not 0 <= share < 1 / 3:
        raise ValueError("share must be below a third")
    posted = cut(_postings(classes, share))
    names = [f"b{i}" for i in range(BITMAP_LONGS)]
    facts = ("class_id", "side", "n", "own", "rest", "least", *names)
    sizes = posted.groupBy("term").agg(F.count("*").alias("size"), F.min("side").alias("low"), F.max("side").alias("high")).filter("low < high")
    long_lists = cut(sizes.filter(F.col("size") > LIST_PART).select("term", F.ceil(F.col("size") / LIST_PART).cast("int").alias("parts")))
    first, last = posted.agg(F.min("side"), F.max("side")).first()
    small = long_lists.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    marked = posted.join(F.broadcast(long_lists) if small else long_lists, "term", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # (the smaller side of a link is never the last, nor the greater one the first)
    a = marked.filter(F.col("side") < F.lit(last)).select("term", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int").alias("part"), *(F.col(c).alias(f"a_{c}") for c in facts))
    b = marked.filter(F.col("side") > F.lit(first)).select("term", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"b_{c}") for c in facts))
    most = F.floor(F.greatest("a_n", "b_n") * F.lit(share) + F.lit(1e-9))
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}_{c}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{c}")))) for c in names), F.lit(0))
    met = a.join(b, ["term", "part"]).filter(
        (F.col("a_side") < F.col("b_side")) & (F.col("a_class_id") != F.col("b_class_id")) & (F.abs(F.col("a_n") - F.col("b_n")) <= most)
        & (F.col("a_own") * F.col("b_own") + F.col("a_rest") * F.col("b_rest") >= F.greatest("a_least", "b_least") - F.lit(1e-6))
        & (only("a", "b") <= most) & (only("b", "a") <= most)
    )
    pairs = met.select("a_class_id", "a_side", "b_class_id", "b_side").distinct()
    text = classes.select("class_id", "side", "words")
    full = pairs.join(text.select(F.col("class_id").alias("a_class_id"), F.col("side").alias("a_side"), F.col("words").alias("a_words")), ["a_class_id", "a_side"])
    full = full.join(text.select(F.col("class_id").alias("b_class_id"), F.col("side").alias("b_side"), F.col("words").alias("b_words")), ["b_class_id", "b_side"])
    side_type = classes.schema["side"].dataType.simpleString()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                x, y = r.a_words.split(), r.b_words.split()
                longest = max(len(x), len(y))
                cx, cy = Counter(zip(x, x[1:])), Counter(zip(y, y[1:]))
                shared = sum(min(v, cy[t]) for t, v in cx.items() if t in cy)
                if shared < longest - 1 - 2 * int(share * longest + 1e-9):
                    continue
                edits = within(x, y, int(share * longest + 1e-9))
                if edits is not None:
                    dot = sum((v * cy[t]) ** 0.5 for t, v in cx.items() if t in cy)
                    norm = ((len(x) - 1) * (len(y) - 1)) ** 0.5
                    rows.append((r.a_class_id, r.a_side, r.b_class_id, r.b_side, dot / norm if norm else 0.0, edits))
            yield pd.DataFrame(rows, columns=["class_a", "side_a", "class_b", "side_b", "cosine", "edits"])

    return full.mapInPandas(verify, f"class_a string, side_a {side_type}, class_b string, side_b {side_type}, cosine double, edits int")


def partner_counts(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, side, partners): in how many pairs of records of different sides each record is; no pair is written out.

    The partners of a class are the sizes of the classes it is linked to and those of its own text on other sides.
    """
    sizes = members.groupBy("class_id", "side").agg(F.count("*").alias("size")).filter("side is not null")
    ends = linked.select(F.explode(F.array(F.struct(F.col("class_a").alias("class_id"), F.col("side_a").alias("side"), F.col("class_b").alias("to_class"), F.col("side_b").alias("to_side")), F.struct(F.col("class_b").alias("class_id"), F.col("side_b").alias("side"), F.col("class_a").alias("to_class"), F.col("side_a").alias("to_side")))).alias("e")).select("e.*")
    to = sizes.select(F.col("class_id").alias("to_class"), F.col("side").alias("to_side"), F.col("size").alias("n"))
    near = ends.join(to, ["to_class", "to_side"]).select("class_id", "side", "n")
    whole = sizes.groupBy("class_id").agg(F.sum("size").alias("all"))
    same = sizes.join(whole, "class_id").select("class_id", "side", (F.col("all") - F.col("size")).alias("n"))
    totals = near.unionByName(same).groupBy("class_id", "side").agg(F.sum("n").alias("partners")).join(sizes, ["class_id", "side"])
    return lookup(members, totals, ["class_id", "side"], "size").select("key", "side", "partners")


def overlap_report(records: DataFrame, key: str, side: str, text: str, share: float = 0.2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (key, side, class_id), links between classes, and per class its number of links.

    Copies are not expanded into pairs.  Null texts and texts without a word are members of nothing.
    """
    members, classes = text_classes(records, key, side, text)
    linked = cut(links(classes, share))
    ends = linked.select(F.explode(F.array("class_a", "class_b")).alias("class_id"))
    counts = ends.groupBy("class_id").agg(F.count("*").alias("links"))
    return members, linked, members.join(counts, "class_id", "left").select("key", "side", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def member_pairs(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(key_1, key_2, class_1, class_2), the smaller key first: all pairs of records of different sides that a link or a common class joins."""
    one = members.select(F.col("key").alias("ka"), F.col("side").alias("side_a"), F.col("class_id").alias("class_a"))
    two = members.select(F.col("key").alias("kb"), F.col("side").alias("side_b"), F.col("class_id").alias("class_b"))
    near = linked.select("class_a", "side_a", "class_b", "side_b").join(one, ["class_a", "side_a"]).join(two, ["class_b", "side_b"])
    same = one.join(two.withColumnRenamed("class_b", "class_a"), "class_a").filter("side_a < side_b").withColumn("class_b", F.col("class_a"))
    both = near.select("ka", "kb", "class_a", "class_b").unionByName(same.select("ka", "kb", "class_a", "class_b"))
    swap = F.col("ka") > F.col("kb")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return both.select(pick("ka", "kb").alias("key_1"), pick("kb", "ka").alias("key_2"), pick("class_a", "class_b").alias("class_1"), pick("class_b", "class_a").alias("class_2"))
