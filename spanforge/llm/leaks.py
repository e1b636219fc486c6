"""Passages of held-out items inside a corpus.

Windows are item-sized: an item is cut into windows of the longest run of words that any of its good passages must leave
unbroken.  A whole item of n words with at most n/10 edits leaves a run of n words (n < 10) or of (n - 1)/2 (n < 20);
a passage of 20 words or more leaves one of at least six ((20 - 2) / 3).  Each size of window that the items have
is taken over the documents too, down to windows of one word, and each window has a 64-bit SimHash of its words.
So equal fingerprints alone find every passage; the radius lets windows with a slight change in too.  Fingerprints are
cut into radius + 1 blocks: two fingerprints within the radius agree in one block at least, so that looking up each
block finds all of them.

A candidate is verified in two steps.  Its word-pair shingles, weighted by their rarity among the items, must leave no more
weight unmatched near by than the edits of a good passage can take: this rejects most windows that are common turns of
phrase.  Then the exact number of edits decides.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.words import fold, joined_breaks, plain_words, reach, words

RADIUS = 3
BLOCKS, BLOCK_BITS = RADIUS + 1, 64 // (RADIUS + 1)
_SLICE = 1 << 16
_KNOWN_WORDS = 400_000


def window_of(n: int, least: int = 20, share: float = 0.1) -> int:
    """The longest run of words that every good passage of an item of ``n`` words leaves unbroken."""
    lengths = [n] if n < least else range(least, min(n, 2 * least) + 1)
    return max(1, min(-(-(m - int(share * m + 1e-9)) // (int(share * m + 1e-9) + 1)) for m in lengths))


def fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of each window of ``size`` successive word hashes: a bit is set where most words set it."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if size == 1:
        return hashes.copy()
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, _SLICE):
        part = hashes[at : at + _SLICE + size - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        m = len(part) - size + 1
        votes = bits[:m].copy()
        for k in range(1, size):
            votes += bits[k : k + m]
        out[at : at + m] = np.packbits(votes > size // 2, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


@dataclass
class WindowIndex:
    """Windows of one size under each block of their fingerprint."""

    prints: np.ndarray
    item: np.ndarray
    place: np.ndarray
    starts: list[np.ndarray]
    rows: list[np.ndarray]


@dataclass
class ItemIndex:
    """Items as word hashes with the weights of their word pairs, and their windows by size."""

    ids: list
    tokens: list[list[int]]
    weights: list[np.ndarray]
    windows: dict[int, WindowIndex]
    known: set[str]


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def index_items(items: list[tuple], least: int = 20, share: float = 0.1) -> ItemIndex:
    ids, tokens, known = [], [], set()
    for item_id, text in items:
        w = words(text or "")
        if w:
            ids.append(item_id)
            tokens.append([_hash(x) for x in w])
            known.update(w)
    seen = Counter(pair for t in tokens for pair in set(zip(t, t[1:])))
    weights = [np.array([math.log(1 + len(tokens) / seen[pair]) for pair in zip(t, t[1:])]) for t in tokens]
    by_size: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        by_size.setdefault(window_of(len(t), least, share), []).append(i)
    windows = {}
    for size, members in sorted(by_size.items()):
        prints = [fingerprints(np.array(tokens[i], dtype=np.uint64), size) for i in members]
        flat = np.concatenate(prints)
        item = np.repeat(np.array(members, dtype=np.int64), [len(p) for p in prints])
        place = np.concatenate([np.arange(len(p)) for p in prints]).astype(np.int64)
        starts, rows = [], []
        for b in range(BLOCKS):
            key = ((flat >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            rows.append(order)
            starts.append(np.searchsorted(key[order], np.arange((1 << BLOCK_BITS) + 1)))
        windows[size] = WindowIndex(flat, item, place, starts, rows)
    return ItemIndex(ids, tokens, weights, windows, known)


def _near(prints: np.ndarray, index: WindowIndex) -> tuple[np.ndarray, np.ndarray]:
    """(position, item window) of all fingerprints within the radius."""
    at, to = [], []
    for b in range(BLOCKS):
        key = ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
        first = index.starts[b][key]
        count = index.starts[b][key + 1] - first
        some = np.flatnonzero(count)
        count, first = count[some], first[some]
        position = np.repeat(some, count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        window = index.rows[b][np.repeat(first, count) + offset]
        close = np.bitwise_count(prints[position] ^ index.prints[window]) <= RADIUS
        at.append(position[close])
        to.append(window[close])
    return np.concatenate(at), np.concatenate(to)


def _similarity(item: list[int], weights: np.ndarray, doc: list[int]) -> float:
    """The share of the weight of the item's word pairs that the document's passage has; 1 for a single word."""
    pairs = list(zip(item, item[1:]))
    have = Counter(zip(doc, doc[1:]))
    met = sum(w * min(1.0, have[p] / n) for p, w, n in zip(pairs, weights.tolist(), map(Counter(pairs).__getitem__, pairs)))
    total = float(weights.sum())
    return met / total if total else 1.0


def plausible(item: list[int], weights: np.ndarray, doc: list[int], i: int, j: int, least: int, share: float) -> bool:
    """Whether a good passage around item[i] = doc[j] can exist by the weights of the pairs that stand near by.

    An edit takes two pairs at most, so some passage of ``least`` words or more (or the whole item) must lack no more weight than
    its heaviest pairs, two for each edit it is allowed.  Only lengths at which one more edit is allowed need be tried, as a passage
    of twice the least length has a good half.
    """
    n = len(item)
    if n < 2:
        return True
    reach_ = 2 * least
    low, high = (0, n) if n < least else (max(0, i - reach_ + 1), min(n, i + reach_))
    around = doc[max(0, j - (i - low) - int(share * reach_) - 1) : j + (high - i) + int(share * reach_) + 1]
    have = set(zip(around, around[1:]))
    own = weights[low : high - 1]
    lack = np.where([p in have for p in zip(item[low:high], item[low + 1 : high])], 0.0, own)
    sums = np.concatenate([[0.0], np.cumsum(lack)])
    lengths = [n] if n < least else sorted({m for m in (least, *(k for k in range(least + 1, reach_) if int(share * k + 1e-9) > int(share * (k - 1) + 1e-9))) if m <= high - low})
    for m in lengths:
        edits = int(share * m + 1e-9)
        gone = sums[m - 1 :] - sums[: len(sums) - m + 1]
        if not edits:
            if (gone <= 1e-9).any():
                return True
            continue
        views = np.lib.stride_tricks.sliding_window_view(own, m - 1)
        few = min(2 * edits, m - 1)
        allowed = np.partition(views, m - 1 - few, axis=1)[:, m - 1 - few :].sum(axis=1)
        if (gone <= allowed + 1e-9).any():
            return True
    return False


def _around(item: list[int], doc: list[int], i: int, j: int, most: int) -> tuple[list[int], list[int]]:
    """How far the item can be followed to the left and to the right of item[i] = doc[j] with 0, 1, ..., ``most`` edits."""
    low, high = max(0, j - len(item) - most), j + len(item) + most + 1
    near, k = doc[low:high], j - low
    right = reach(item, near, i, k, 1, most)
    left = reach(item, near, i - 1, k - 1, -1, most) if i and k else [min(i, e) for e in range(most + 1)]
    return left, right


def passage(item: list[int], doc: list[int], i: int, j: int, least: int, share: float) -> tuple[int, int, int] | None:
    """(start, end, edits) in the item of the longest good passage around the common word item[i] = doc[j].

    Good: the whole item or at least ``least`` successive words of it, with at most ``share`` of them edited.  A good
    passage of twice the least length or more has a half that is good, so only shorter ones are tried first.
    """

    def best(most: int) -> tuple[int, int, int] | None:
        left, right = _around(item, doc, i, j, most)
        good = [(x + y, -a - b, i - x, i + y) for a, x in enumerate(left) for b, y in enumerate(right) if (x + y >= least or x + y == len(item)) and a + b <= share * (x + y) + 1e-9]
        return (max(good)[2], max(good)[3], -max(good)[1]) if good else None

    if best(int(share * min(len(item), 2 * least - 1) + 1e-9)) is None:
        return None
    return best(int(share * len(item) + 1e-9))


def _seeds(flat: np.ndarray, ends: np.ndarray, size: int, index: WindowIndex) -> np.ndarray:
    """(document, item, diagonal, place) of the first window of each run of near windows of one size on one diagonal."""
    prints = fingerprints(flat, size)
    at, window = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for s in range(0, len(prints), 1 << 18):
        x, y = _near(prints[s : s + (1 << 18)], index)
        at.append(x + s)
        window.append(y)
    at, window = np.concatenate(at), np.concatenate(window)
    doc = np.searchsorted(ends, at, side="right")
    inside = at + size <= ends[doc] if len(at) else np.empty(0, dtype=bool)
    at, window, doc = at[inside], window[inside], doc[inside]
    begin = np.concatenate([[0], ends[:-1]])
    seeds = np.unique(np.stack([doc, index.item[window], at - begin[doc] - index.place[window], index.place[window]], axis=1), axis=0)
    new = np.ones(len(seeds), dtype=bool)
    if len(seeds) > 1:
        new[1:] = (seeds[1:, :3] != seeds[:-1, :3]).any(axis=1) | (seeds[1:, 3] > seeds[:-1, 3] + 1)
    return seeds[new]


def _leaks_of(batch: pd.DataFrame, index: ItemIndex, known: dict[str, int], least: int, share: float) -> list[tuple]:
    rows = []
    if not index.windows:
        return rows
    smallest = min(index.windows)
    hashes, owner = [], []
    for d, text in enumerate(batch["text"]):
        if not text:
            continue
        mine = []
        for w in plain_words(joined_breaks(text, index.known)):
            h = known.get(w)
            if h is None:
                if len(known) > _KNOWN_WORDS:
                    known.clear()
                known[w] = h = _hash(fold(w))
            mine.append(h)
        if len(mine) >= smallest:
            hashes.append(np.array(mine, dtype=np.uint64))
            owner.append(d)
    if not hashes:
        return rows
    flat = np.concatenate(hashes)
    ends = np.cumsum([len(h) for h in hashes])
    lists: dict[int, list[int]] = {}
    found: dict[tuple[int, int], tuple] = {}
    for size, windows in index.windows.items():
        for d, it, diagonal, place in _seeds(flat, ends, size, windows).tolist():
            item = index.tokens[it]
            if (d, it) in found and found[d, it][1] - found[d, it][0] == len(item):
                continue
            words_ = lists.get(d)
            if words_ is None:
                words_ = lists[d] = hashes[d].tolist()
            for i in range(place, min(place + size, len(item))):
                if item[i] == words_[i + diagonal]:
                    if not plausible(item, index.weights[it], words_, i, i + diagonal, least, share):
                        break
                    hit = passage(item, words_, i, i + diagonal, least, share)
                    if hit and ((d, it) not in found or hit[1] - hit[0] > found[d, it][1] - found[d, it][0]):
                        near = words_[max(0, hit[0] + diagonal - hit[2]) : hit[1] + diagonal + hit[2]]
                        found[d, it] = (*hit, _similarity(item[hit[0] : hit[1]], index.weights[it][hit[0] : hit[1] - 1], near))
                    break
    ids = batch["id"].tolist()
    return [(ids[owner[d]], index.ids[it], a, b, e, s) for (d, it), (a, b, e, s) in found.items()]


def leaked_items(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 20, share: float = 0.1, block_chars: int = 20_000_000
) -> DataFrame:
    """(doc_id, item_id, item_start, item_end, edits, similarity): documents that hold an item or a passage of it.

    A passage is at least ``least`` successive words of the item, or the whole item, of which at most ``share`` are
    changed, added or dropped; item_start and item_end count its words.  Letter case, punctuation, spacing, line breaks
    and look-alikes make no difference.  Items of any length down to one word are searched; null
    and empty texts hold nothing.  Repeated rows yield repeated results.  Where both ids have one name, the item's gets the
    prefix item_.

    The items are the query set: they are broadcast in blocks of at most ``block_chars`` characters, of which a worker holds one at
    a time; a block is built on the driver.  The documents are read once, whatever the number of blocks, and are not shuffled.
    """
    key_type, item_type = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    spark = documents.sparkSession
    chars = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    schema = f"doc_id {key_type}, item_id {item_type}, item_start int, item_end int, edits int, similarity double"
    corpus = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    indexes = []
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == block)
        indexes.append(spark.sparkContext.broadcast(index_items([tuple(r) for r in part.select(item_id, item_text).distinct().collect()], least, share)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            for shared in indexes:
                # Of several blocks, a worker holds one at a time; they lie on its disk.
                index = shared.value if len(indexes) == 1 else shared.load_from_path(shared._path)
                for s in range(0, len(batch), 500):
                    rows = _leaks_of(batch.iloc[s : s + 500], index, known, least, share)
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_start", "item_end", "edits", "similarity"])

    out = corpus.mapInPandas(search, schema)
    return out.withColumnsRenamed({"doc_id": doc_id, "item_id": item_id if item_id != doc_id else f"item_{item_id}"})
