"""Cutting oversized texts into overlapping pieces at natural boundaries.

Lexical-cohesion segmentation: the words before and after every natural boundary form two blocks that slide along the
text; the cosine of the blocks is the cohesion there and its fall below the nearest peaks on both sides the depth of
the valley.  A piece ends at the deepest valley within its size window; where the window holds no boundary of one
kind, the next finer kind serves (line, sentence, clause, word), and a cut inside a word is the last resort.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 40
#: A piece takes at least this share of the limit if a boundary of the preferred kind lies beyond it.
LEAST_FILL = 0.5
_WORD = re.compile(r"\w+")
# Ends of sentences and lines, then of clauses, then of words; a match ends where the next piece may begin.
_SENTENCE = re.compile(r"\n+\s*|[.!?…]+[»\"”)]*\s+(?=[^a-zа-яё])|;\s+")
_CLAUSE = re.compile(r"[,:;—–)]\s+")
_SPACE = re.compile(r"\s+")


def _valleys(text: str) -> tuple[list[int], list[float]]:
    """The sentence boundaries of a text and the depth of the cohesion valley at each."""
    ends = [m.end() for m in _SENTENCE.finditer(text) if m.end() < len(text)]
    if not ends:
        return [], []
    starts, words = [], []
    for m in _WORD.finditer(text):
        starts.append(m.start())
        words.append(m[0].lower()[:6])
    cohesion, i = [], 0
    for e in ends:
        while i < len(starts) and starts[i] < e:
            i += 1
        before, after = Counter(words[max(0, i - BLOCK_WORDS) : i]), Counter(words[i : i + BLOCK_WORDS])
        norm = sum(v * v for v in before.values()) * sum(v * v for v in after.values())
        cohesion.append(sum(v * after[w] for w, v in before.items() if w in after) / norm**0.5 if norm else 0.0)
    # The peak next to a boundary is where the cohesion stops rising, so a boundary hands its peak on to its neighbour.
    left = list(cohesion)
    for k in range(1, len(left)):
        if cohesion[k - 1] >= cohesion[k]:
            left[k] = left[k - 1]
    right = list(cohesion)
    for k in range(len(right) - 2, -1, -1):
        if cohesion[k + 1] >= cohesion[k]:
            right[k] = right[k + 1]
    depths = [a + b - 2 * c for a, b, c in zip(left, right, cohesion)]
    return ends, depths


def _last_end(pattern: re.Pattern, text: str, low: int, high: int) -> int | None:
    last = None
    for m in pattern.finditer(text, max(0, low - 1), high):
        if low < m.end() <= high:
            last = m.end()
    return last


def cuts(text: str, limit: int, overlap: int, valleys: tuple[list[int], list[float]] | None = None) -> list[tuple[int, int]]:
    """Half-open (start, end) of the pieces: each at most ``limit`` long, each sharing ``overlap`` with the one before.

    A text within the limit is one piece, an empty one too.  An overlap of the limit or more is cut to the limit less one.
    """
    overlap = max(0, min(overlap, limit - 1))
    ends, depths = valleys if valleys is not None else _valleys(text)
    out, start = [], 0
    while len(text) - start > limit:
        low = start + max(overlap, int(limit * LEAST_FILL))
        high = start + limit
        window = range(bisect_right(ends, low), bisect_right(ends, high))
        if window:
            end = ends[max(window, key=lambda k: (depths[k], ends[k]))]
        else:
            end = _last_end(_CLAUSE, text, low, high) or _last_end(_SPACE, text, low, high) or high
            if end == high and start + overlap + 1 < high:
                while end > start + overlap + 1 and end > low and not text[end].isalnum() and not text[end].isspace() and not text[end].isprintable():
                    end -= 1
        out.append((start, end))
        start = end - overlap
    out.append((start, len(text)))
    return out


def split_texts(items: DataFrame, key: str, text: str, limits: list[tuple[int, int]], offset: str | None = None) -> DataFrame:
    """(key, max_chunk, piece_no, char_start, char_end, piece) of every text longer than a limit.

    ``limits`` are (size, overlap) in characters; a text yields pieces for each limit it exceeds, none where it is null,
    empty or short enough.  ``offset`` is the column with the place of the text's first character, null counting as 0.
    Repeated keys are cut each on its own.  Texts are cut where they lie: nothing is shuffled.
    """
    if not limits:
        limits = []
    least = min((size for size, _ in limits), default=None)
    key_type = items.schema[key].dataType.simpleString()
    at = F.coalesce(F.col(offset), F.lit(0)).cast("long") if offset else F.lit(0).cast("long")
    wanted = items.select(F.col(key).alias("key"), F.col(text).alias("text"), at.alias("at"))
    wanted = wanted.filter(F.length("text") > F.lit(least)) if limits else wanted.filter(F.lit(False))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, place in zip(batch["key"], batch["text"], batch["at"]):
                valleys = _valleys(t)
                for size, overlap in limits:
                    if len(t) > size:
                        rows += [(k, size, n, place + a, place + b, t[a:b]) for n, (a, b) in enumerate(cuts(t, size, overlap, valleys))]
            yield pd.DataFrame(rows, columns=["key", "max_chunk", "piece_no", "char_start", "char_end", "piece"])

    out = wanted.mapInPandas(pieces, f"key {key_type}, max_chunk int, piece_no int, char_start long, char_end long, piece string")
    return out.withColumnRenamed("key", key)
