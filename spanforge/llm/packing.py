"""Filling containers of fixed capacity by a grouping genetic algorithm on islands.

Documents are measured in tokens of a public tokenizer; one that exceeds the capacity is cut into full pieces and a
rest.  Pieces are dealt by hash to groups of bounded size.  In a group, pieces that an optimal filling may hold alone or in twos are
settled first.  The rest of each group is evolved on several islands, as tasks of their own: an individual is a set of containers, crossover injects whole well-filled containers of one parent into the
other, removes the containers that hold one of their pieces already, and fills containers with the displaced pieces and those of
the emptiest containers, each as full as any of the pieces can make it; mutation does so with the pieces of a few containers.  The
first individuals are best fits that exchange the pieces of their emptiest containers for smaller ones where that fills a container
better; the fitness is the mean square fill.  Groups of any size are searched for as many
generations, or until a lower bound proves the filling optimal.  After each epoch the elite of an island moves
on to the next one.  The poorly filled containers of all groups are opened again and their pieces meet in groups of their
own, so that a group's last container costs nothing.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import random
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import cut

#: Pieces in a group, about; what a task holds at once does not grow with the corpus.
GROUP = 1000
ISLANDS, EPOCHS, POPULATION = 2, 2, 8
#: Generations of one epoch, for a group of any size.
GENERATIONS = 200
#: Searches of one group on one island, in a task.
SEARCHES = 16
#: Sums of pieces are told apart up to this capacity; in larger containers they are counted in so many parts of it, pieces rounded up.
SUMS = 1 << 17
#: Containers below this fill are opened again, to meet those of other groups.
REOPENED = 0.97

_encodings: dict = {}


def encoding(ranks: bytes, pattern: str):
    """The byte-pair encoding of the content of a file of ranks, built once for each worker."""
    import tiktoken

    name = hashlib.sha256(ranks).hexdigest()
    if (name, pattern) not in _encodings:
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encodings[name, pattern] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _encodings[name, pattern]


def token_counts(documents: DataFrame, key: str, text: str, tokenizer: str, pattern: str) -> DataFrame:
    """(key, n_tokens) of whole texts; null and empty texts have 0.

    ``tokenizer`` is a file of ranks that the driver has, a few megabytes at most; its content goes to the workers.
    """
    key_type = documents.schema[key].dataType.simpleString()
    ranks = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoding(ranks.value, pattern)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "n_tokens": [len(own.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(count, f"key {key_type}, n_tokens long").withColumnRenamed("key", key)


class Packing:
    """Containers, each the sorted numbers of its pieces, with their loads.

    Containers never change and are shared by individuals, so that two individuals are told apart by the containers that only one holds.
    """

    __slots__ = ("held", "order", "squares")

    def __init__(self, bins: list[list[int]], loads: list[int]) -> None:
        self.held = dict(zip((tuple(sorted(b)) for b in bins), loads))
        #: (load, container), the emptiest first.
        self.order = sorted((load, x) for x, load in self.held.items())
        self.squares = sum(x * x for x in loads)

    bins = property(lambda self: list(self.held))
    loads = property(lambda self: list(self.held.values()))
    #: Fewer containers, then a greater mean square fill.
    score = property(lambda self: (-len(self.held), self.squares))

    def copy(self) -> Packing:
        out = Packing.__new__(Packing)
        out.held, out.order, out.squares = self.held.copy(), self.order.copy(), self.squares
        return out

    def put(self, x: tuple[int, ...], load: int) -> None:
        self.held[x] = load
        bisect.insort(self.order, (load, x))
        self.squares += load * load

    def take(self, x: tuple[int, ...]) -> int:
        load = self.held.pop(x)
        del self.order[bisect.bisect_left(self.order, (load, x))]
        self.squares -= load * load
        return load

    def dissolve(self, containers: list[tuple[int, tuple[int, ...]]]) -> list[int]:
        """Removes some (load, container); their pieces."""
        for _, x in containers:
            self.take(x)
        return [p for _, x in containers for p in x]

    def few(self) -> int:
        """How many of the emptiest containers are opened at once."""
        return max(1, len(self.order) // 50)

    def fitness(self, capacity: int) -> float:
        return self.squares / capacity**2 / len(self.held) if self.held else 1.0


def best_fit(packing: Packing, pieces: list[int], sizes: list[int], capacity: int) -> Packing:
    """The pieces, in the given order, each into the fullest container with room for it."""
    for p in pieces:
        size = sizes[p]
        at = bisect.bisect_left(packing.order, (capacity - size + 1,)) - 1
        if at < 0:
            packing.put((p,), size)
        else:
            x = packing.order[at][1]
            packing.put(tuple(sorted((*x, p))), packing.take(x) + size)
    return packing


def fill(packing: Packing, pieces: list[int], sizes: list[int], capacity: int) -> Packing:
    """The pieces in containers of their own, one after the other: the largest piece left, with those that make it as full as any can, the larger first.

    As full counts in units of capacity / ``SUMS``.  Pieces without size go to the fullest container.
    """
    left = sorted((p for p in pieces if sizes[p]), key=sizes.__getitem__)
    unit = -(-capacity // SUMS)
    n, within = [-(-sizes[p] // unit) for p in left], (1 << (capacity // unit + 1)) - 1
    total = sum(sizes[p] for p in left)
    # Bit s of reach[i]: some of the i smallest pieces have s units together.
    some, reach = 1, [1]
    for x in n:
        some = (some | some << x) & within
        reach.append(some)
    while total > capacity:
        container = [left.pop()]
        i = len(left)
        del n[i:], reach[i + 1 :]
        load = sizes[container[0]]
        room = (reach[i] & ((1 << ((capacity - load) // unit + 1)) - 1)).bit_length() - 1
        while room:
            i = bisect.bisect_right(n, room, 0, i) - 1
            while not reach[i] >> (room - n[i]) & 1:
                i -= 1
            p = left.pop(i)
            container.append(p)
            load += sizes[p]
            room -= n.pop(i)
        container.sort()
        packing.put(tuple(container), load)
        total -= load
        some = reach[i]
        del reach[i + 1 :]
        for x in n[i:]:
            some = (some | some << x) & within
            reach.append(some)
    # What is left fits into one.
    if left:
        packing.put(tuple(sorted(left)), total)
    return best_fit(packing, [p for p in pieces if not sizes[p]], sizes, capacity)


def _offers(x: tuple[int, ...], load: int, sizes: list[int], capacity: int) -> list[tuple[int, int, tuple[int, ...], tuple[int, ...]]]:
    """(size, most, container, pieces): what may leave a container with room for a piece of at most ``most``; pairs of neighbours in a ring stand for its pairs."""
    room = capacity - load
    # Full containers have nothing to offer.
    if not room:
        return []
    out = [(sizes[p], sizes[p] + room, x, (p,)) for p in x]
    ring = zip(x, x[1:] + x[:1] if len(x) > 2 else x[1:])
    return out + [(n, n + room, x, (p, q)) for p, q in ring for n in (sizes[p] + sizes[q],)]


def exchange(packing: Packing, loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Puts loose pieces, the largest first, in the place of one or two smaller ones where the container gets fuller; what is loose now.

    Every exchange makes a container fuller and the loose pieces smaller; it ends when none is left.
    """
    out: list[int] = []
    waiting = sorted(loose, key=sizes.__getitem__)
    offers = sorted(o for x, load in packing.held.items() for o in _offers(x, load, sizes, capacity))
    while waiting:
        p = waiting.pop()
        n = sizes[p]
        # The least that leaves is the first offer that is high enough, of a container that is still there; none is whose size
        # and the room of the emptiest container are less.
        least = n - capacity + packing.order[0][0] if packing.order else n
        for low, most, x, gone in offers[bisect.bisect_left(offers, (least,)) : bisect.bisect_left(offers, (n,))]:
            if most >= n and x in packing.held:
                break
        else:
            out.append(p)
            continue
        fuller, load = tuple(sorted([q for q in x if q not in gone] + [p])), packing.take(x) + n - low
        packing.put(fuller, load)
        for o in _offers(fuller, load, sizes, capacity):
            bisect.insort(offers, o)
        for q in gone:
            bisect.insort(waiting, q, key=sizes.__getitem__)
    return out


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """``a`` with some well-filled containers of ``b`` injected whole, of those that it doesn't hold itself.

    The pieces that they displace and those of the emptiest containers are filled anew.
    """
    child = a.copy()
    # (sorted by pieces first, as a set has no order)
    order = sorted(sorted(b.held.keys() - a.held.keys()), key=lambda x: -b.held[x] + rng.random() * capacity * 0.05)
    if not order:
        return child
    chosen = [x for x in order[: max(1, len(order) // 2)] if rng.random() < 0.5] or order[:1]
    injected = {p for x in chosen for p in x}
    # What both hold has none of the injected pieces.
    displaced = child.dissolve([(a.held[x], x) for x in sorted(a.held.keys() - b.held.keys()) if not injected.isdisjoint(x)])
    loose = [p for p in displaced if p not in injected] + child.dissolve(child.order[: child.few()])
    for x in chosen:
        child.put(x, b.held[x])
    return fill(child, loose, sizes, capacity)


def mutate(a: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """``a`` with its emptiest containers and a few others, of the full ones fewer, dissolved and their pieces filled anew."""
    child, few = a.copy(), a.few()
    others = [x for x in a.order[few:] if rng.random() < (0.05 if x[0] < capacity else 0.03)]
    return fill(child, child.dissolve(a.order[:few] + others), sizes, capacity)


def _from_codes(codes: list[int], sizes: list[int]) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(codes, default=-1) + 1)]
    loads = [0] * len(bins)
    for p, b in enumerate(codes):
        bins[b].append(p)
        loads[b] += sizes[p]
    return Packing(bins, loads)


def _codes(packing: Packing, n: int) -> list[int]:
    out = [0] * n
    for b, pieces in enumerate(packing.held):
        for p in pieces:
            out[p] = b
    return out


def least_containers(sizes: list[int], capacity: int) -> int:
    """A number of containers that no filling can do without (Martello and Toth's second bound)."""
    a = np.sort(np.array([x for x in sizes if x > 0], dtype=np.int64))
    if not len(a):
        return min(1, len(sizes))
    sums = np.concatenate([[0], np.cumsum(a)])
    half = int(np.searchsorted(a, capacity // 2, "right"))
    # Pieces over half a container have one each; those of at least k can use the room of the ones that leave as much only.
    k = np.unique(np.concatenate([[0], a[:half]]))
    top, small = np.searchsorted(a, capacity - k, "right"), np.searchsorted(a, k, "left")
    over = sums[half] - sums[np.minimum(small, half)] - ((top - half) * capacity - (sums[top] - sums[half]))
    return len(a) - half + max(0, int((-(-over // capacity)).max()))


def settled(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Containers that some optimal filling has, and the pieces left.

    A piece that no other fits beside is alone.  One whose room no set of pieces can use better than a single piece does is
    with that piece: in any filling the two can change places with what stands beside the one.  Pieces without size are left.
    """
    empty = [p for p, x in enumerate(sizes) if not x]
    left = sorted((x, p) for p, x in enumerate(sizes) if x)
    done: list[list[int]] = []
    before = -1
    while len(left) != before:
        before, sums = len(left), 1
        for x, _ in left:
            sums |= (sums << x) & ((1 << (capacity + 1)) - 1)
        for x, p in left[::-1]:
            at = bisect.bisect_left(left, (x, p))
            if at == len(left) or left[at] != (x, p):
                continue
            # The fullest any pieces can make the room, itself among them: never too little.
            used = (sums & ((1 << (capacity - x + 1)) - 1)).bit_length() - 1
            mate = bisect.bisect_left(left, (used + 1, -1)) - 1
            mate -= mate == at
            if not used:
                done.append([left.pop(at)[1]])
            elif mate >= 0 and left[mate][0] == used:
                done.append([p, left[mate][1]])
                for i in sorted((at, mate), reverse=True):
                    left.pop(i)
    return done, sorted([*empty, *(p for _, p in left)])


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[int]], generations: int = GENERATIONS, population: int = POPULATION) -> list[int]:
    """The container of each piece in the best individual; ``elites`` are individuals to start from.

    It ends early only when no fewer containers can hold the pieces.
    """
    falling = lambda n: sorted(range(len(n)), key=lambda p: (-n[p], p))
    whole = [_from_codes(list(e), sizes) for e in elites] or [best_fit(Packing([], []), falling(sizes), sizes, capacity)]
    if min(len(x.held) for x in whole) > least_containers(sizes, capacity):
        done, left = settled(sizes, capacity)
        rest = [sizes[p] for p in left]
        starts = [_dense([e[p] for p in left]) for e in elites]
        best = _evolve(rest, capacity, random.Random(seed), [_from_codes(x, rest) for x in starts] or [best_fit(Packing([], []), falling(rest), rest, capacity)], generations, population)
        bins = [*done, *([left[p] for p in b] for b in best.held)]
        whole.append(Packing(bins, [sum(sizes[p] for p in b) for b in bins]))
    return _codes(max(whole, key=lambda x: x.score), len(sizes))


def _dense(codes: list[int]) -> list[int]:
    names = {c: i for i, c in enumerate(sorted(set(codes)))}
    return [names[c] for c in codes]


def _evolve(sizes: list[int], capacity: int, rng: random.Random, starts: list[Packing], generations: int, population: int) -> Packing:
    lower = least_containers(sizes, capacity)
    falling = sorted(range(len(sizes)), key=lambda p: (-sizes[p], p))
    people = list(starts)
    while len(people) < population and min(len(x.held) for x in people) > lower:
        order = sorted(falling, key=lambda p: -sizes[p] * (1 + 0.25 * rng.random()))
        x = best_fit(Packing([], []), order, sizes, capacity)
        loose = exchange(x, x.dissolve(x.order[: x.few()]), sizes, capacity)
        people.append(best_fit(x, sorted(loose, key=lambda p: -sizes[p]), sizes, capacity))
    people.sort(key=lambda x: x.score, reverse=True)
    for _ in range(generations):
        if len(people[0].held) <= lower:
            break
        children: list[Packing] = []
        for _ in range(max(1, population // 2)):
            a, b = rng.sample(people[: max(2, len(people) // 2 + 1)], 2) if len(people) > 1 else (people[0], people[0])
            child = crossover(a, b, sizes, capacity, rng)
            child = mutate(child, sizes, capacity, rng) if rng.random() < 0.5 else child
            # Crossing equals gives nothing new, so that nobody is there twice.
            if not any(child.squares == x.squares and child.held == x.held for x in [*people, *children]):
                children.append(child)
        people = sorted([*people, *children], key=lambda x: x.score, reverse=True)[:population]
    return people[0]


def containers(counted: DataFrame, key: str, tokens: str, capacities: list[int], group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(capacity, container, key, part_no, token_start, token_end): every document in containers of each capacity.

    No container exceeds its capacity, and only documents that do are cut.  Null and negative counts are 0; such documents
    are in a container too.  A key in several rows is several documents.  No documents or no capacities give no rows.
    """
    docs = counted.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    sizes = F.explode(F.array(*(F.lit(int(c)) for c in capacities)).cast("array<int>")).alias("capacity")
    pieces = docs.select("key", "n", sizes).withColumn("part_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1)).cast("int") - 1)))
    pieces = pieces.select("capacity", "key", "part_no", (F.col("part_no").cast("long") * F.col("capacity")).alias("token_start"), F.least(F.col("n"), (F.col("part_no").cast("long") + 1) * F.col("capacity")).alias("token_end"))
    # A full piece is a container of its own.
    full = F.col("token_end") - F.col("token_start") == F.col("capacity")
    pieces = cut(pieces)
    first = _packed(pieces.filter(~full), "g", group, islands, epochs)
    load = Window.partitionBy("capacity", "container")
    first = cut(first.withColumn("load", F.sum(F.col("token_end") - F.col("token_start")).over(load)))
    poor = F.col("load") < F.col("capacity") * F.lit(REOPENED)
    columns = ("capacity", "key", "part_no", "token_start", "token_end")
    second = _packed(first.filter(poor).select(*columns), "r", group, islands, 1)
    name = F.concat_ws("-", F.lit("full"), "capacity", F.col("key").cast("string"), "part_no").alias("container")
    alone = pieces.filter(full).select("capacity", name, *columns[1:])
    kept = first.filter(~poor).select("capacity", "container", *columns[1:])
    return kept.unionByName(second).unionByName(alone).withColumnRenamed("key", key)


def _packed(loose: DataFrame, prefix: str, group: int, islands: int, epochs: int) -> DataFrame:
    """(capacity, container, key, part_no, token_start, token_end) of pieces, each within its capacity, dealt to groups by hash."""
    groups = {r["capacity"]: max(1, -(-r["n"] // group)) for r in loose.groupBy("capacity").agg(F.count("*").alias("n")).collect()}
    number = F.element_at(F.create_map(*(F.lit(int(x)) for c, n in groups.items() for x in (c, n))), F.col("capacity")) if groups else F.lit(1)
    piece = F.struct((F.col("token_end") - F.col("token_start")).cast("int").alias("size"), "key", "part_no", "token_start", "token_end")
    dealt = loose.withColumn("bucket", F.pmod(F.xxhash64("key", "part_no"), number)).groupBy("capacity", "bucket").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    schema = "capacity int, bucket long, island int, elite array<int>, loads double, sizes array<int>"

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for capacity, bucket, island, own, elites in zip(b["capacity"], b["bucket"], b["island"], b["sizes"], b["elites"]):
                    own = [int(x) for x in own]
                    best = evolve(own, int(capacity), (int(capacity) * 1_000_003 + int(bucket)) * 31 + int(island) * 7 + number, [[int(x) for x in e] for e in elites] if elites is not None else [])
                    rows.append((capacity, bucket, island, best, _from_codes(best, own).fitness(capacity), own))
                yield pd.DataFrame(rows, columns=["capacity", "bucket", "island", "elite", "loads", "sizes"])

        return run

    # Only sizes travel through the epochs; ids and places join again at the end.
    dealt = cut(dealt)
    state = dealt.select("capacity", "bucket", F.transform("pieces", lambda p: p["size"]).alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast("array<array<int>>").alias("elites"))
    # A number of partitions that is given is kept: small data, long work.
    tasks = max(1, -(-sum(groups.values()) * islands // SEARCHES))
    for e in range(epochs):
        evolved = cut(state.repartition(tasks, "capacity", "bucket", "island").mapInPandas(epoch(e), schema))
        moved = evolved.select("capacity", "bucket", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
        state = evolved.join(moved, ["capacity", "bucket", "island"]).select("capacity", "bucket", "sizes", "island", F.array_distinct(F.array("elite", "guest")).alias("elites"))
    best = evolved.groupBy("capacity", "bucket").agg(F.max(F.struct((-F.array_max("elite")).alias("fewest"), "loads", "island", "elite")).alias("best"))
    packed = dealt.join(best, ["capacity", "bucket"]).select("capacity", "bucket", F.explode(F.arrays_zip("pieces", F.col("best.elite").alias("bin"))).alias("x"))
    name = F.format_string(f"{prefix}-%d-%d-%d", "capacity", "bucket", F.col("x.bin"))
    return packed.select("capacity", name.alias("container"), *(F.col(f"x.pieces.{c}").alias(c) for c in ("key", "part_no", "token_start", "token_end")))
