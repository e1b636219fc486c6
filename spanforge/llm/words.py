"""Words of a text as the matching operators see them, and edit distances between word sequences."""

from __future__ import annotations

import re
from collections.abc import Sequence

from spanforge.functions.lookalike import one_script, plain_text

_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(f"[{chr(0x300)}-{chr(0x36F)}]")
_BREAK = re.compile(r"(\w+)-\n\s*(\w+)")


def plain_words(text: str) -> list[str]:
    """The runs of letters and digits as they stand, after look-alike spaces, widths and marks are made plain."""
    text = plain_text(text)
    return _WORD.findall(text if text.isascii() else _MARK.sub("", text))


def fold(word: str) -> str:
    """The word without letter case and disguises."""
    return one_script(word).lower()


def words(text: str) -> list[str]:
    """Folded words: letter case, punctuation, spacing and look-alikes make no difference."""
    return [fold(w) for w in plain_words(text)]


def cached_words(text: str, known: dict[str, str], most: int = 400_000) -> list[str]:
    """``words``, with the folded forms of words seen before taken from ``known``, which is emptied when it holds ``most``."""
    out = []
    for w in plain_words(text):
        folded = known.get(w)
        if folded is None:
            if len(known) >= most:
                known.clear()
            known[w] = folded = fold(w)
        out.append(folded)
    return out


def joined_breaks(text: str, known: set[str]) -> str:
    """``text`` with a word that a hyphen and a line break split made whole, where the whole word is a known one."""
    return _BREAK.sub(lambda m: m[1] + m[2] if fold(m[1] + m[2]) in known else m[0], text) if "-\n" in text else text


def reach(a: Sequence, b: Sequence, i: int, j: int, step: int, most: int) -> list[int]:
    """For 0, 1, ..., ``most`` edits, how many items of ``a`` can be matched from a[i] on against b from b[j] on.

    ``step`` is 1 or -1; an edit changes, adds or drops one item.  Furthest-reaching diagonals, O(most^2 + matches).
    """
    n, m = (len(a) - i, len(b) - j) if step == 1 else (i + 1, j + 1)
    front: dict[int, int] = {}
    out: list[int] = []
    for e in range(most + 1):
        new: dict[int, int] = {}
        for d in range(-e, e + 1):
            if e == 0:
                x = 0
            else:
                x = max(front.get(d, -2) + 1, front.get(d - 1, -2) + 1 if d - 1 in front else -1, front.get(d + 1, -1))
            # d: items of a taken more than of b.
            if x < 0 or x < d:
                continue
            x = min(x, n, m + d)
            y = x - d
            if y < 0:
                continue
            while x < n and y < m and a[i + step * x] == b[j + step * y]:
                x += 1
                y += 1
            new[d] = x
        front = new
        best = max(new.values(), default=0)
        out.append(max(best, out[-1] if out else 0))
        if best >= n:
            out += [n] * (most - e)
            break
    return out


def within(a: Sequence, b: Sequence, most: int) -> int | None:
    """The edit distance of two sequences if it is at most ``most``, else None."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    goal, front = n - m, {}
    for e in range(most + 1):
        new: dict[int, int] = {}
        for d in range(-e, e + 1):
            if e == 0:
                x = 0
            else:
                x = max(front.get(d, -2) + 1, front.get(d - 1, -2) + 1, front.get(d + 1, -1))
            if x < 0:
                continue
            x = min(x, n, m + d)
            y = x - d
            if y < 0 or x < 0:
                continue
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            new[d] = x
        if new.get(goal, -1) >= n:
            return e
        front = new
    return None
