"""Bringing text that looks the same to one form.

A vocabulary of all words of the input is counted.  Suspicious words (letters of two scripts, invisible or full-width
characters, detached accents, letters of blocks full of look-alikes, words made only of letters with a twin) walk through a trie
of the ordinary words with a weighted edit automaton: twins and ignorable characters cost nothing, a strange letter (one
of no alphabet at hand, of which no table knows what it looks like) may stand for any letter at a small cost, and any other edit
costs one.  The budget lets three strange letters pass and no edit, as that would change what the reader sees; where two
words are reached at one cost, the more frequent one must be so by far.  The word reached is the canonical spelling.  Words that
reach none are normalised by table (``functions.lookalike``).

Words meet in a trie by blocks: all words of one shape, and, for words with strange letters, all words that share
the first or the second half of the shape, one of which is free of up to one strange letter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import lookalike as L
from spanforge.operators.joins import lookup
from spanforge.session import cut

_x = lambda chars: "".join(f"\\x{{{ord(c):x}}}" for c in chars)
_INVISIBLE, _GREEK = _x(L.INVISIBLE), r"\x{370}-\x{3ff}"
_ACCENTS = r"\x{300}\x{302}-\x{36f}"
_FOREIGN = _x(L.FOREIGN_CYRILLIC)
_WIDE = r"\x{ff01}-\x{ff5e}"
_TWIN_LATIN, _TWIN_CYRILLIC = "ABCEHKMOPTXYaceopxy", "АВСЕНКМОРТХУасеорху"
_CYRILLIC = r"\x{400}-\x{4ff}"
_LETTERISH = rf"\p{{L}}\p{{M}}{_INVISIBLE}"
#: A word of a text as it stands, with what may hide in it.
WORD = rf"[{_LETTERISH}][{_LETTERISH}\p{{N}}]*"
_ODD_CHARACTER = rf"[{_INVISIBLE}{_x(L.SPACES)}{_x(L.HYPHENS)}{_WIDE}]"
_ODD_WORD = (
    rf"[{_INVISIBLE}{_WIDE}{_FOREIGN}{_GREEK}]|[\p{{L}}][{_ACCENTS}]|[A-Za-z]\p{{M}}*[{_CYRILLIC}]|[{_CYRILLIC}]\p{{M}}*[A-Za-z]"
    rf"|(?<![\p{{L}}\p{{N}}\p{{M}}])[{_TWIN_LATIN}]++(?![\p{{L}}\p{{N}}\p{{M}}])"
)
_ODD_CYRILLIC = rf"(?<![\p{{L}}\p{{N}}\p{{M}}])[{_TWIN_CYRILLIC}]++(?![\p{{L}}\p{{N}}\p{{M}}])"
# Blocks of letters that look like those of other alphabets: phonetic, Armenian, Georgian, Cherokee, Coptic, Lisu, letter-like and mathematical ones.
_STRANGE_BLOCKS = ((0x250, 0x2AF), (0x531, 0x587), (0x10A0, 0x10FF), (0x13A0, 0x13FF), (0x1D00, 0x1DBF), (0x2100, 0x214F), (0x2C80, 0x2CFF), (0xA4D0, 0xA4FF), (0xAB30, 0xABBF), (0x1D400, 0x1D7FF))
_STRANGE = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _STRANGE_BLOCKS)
_STRANGE_WORD = rf"[A-Za-z{_CYRILLIC}]\p{{M}}*[{_STRANGE}]|[{_STRANGE}]\p{{M}}*[A-Za-z{_CYRILLIC}]"
_ODD_WORD = rf"{_ODD_WORD}|{_STRANGE_WORD}"
#: Finds every text that may need a change; characters beyond the ordinary ones only make a text a candidate.
_ORDINARY = r"\x00-\x7f\x{401}\x{410}-\x{44f}\x{451}\x{301}" + _x("№«»—–…²³·©→←›¦“”„’")
_ODD_TEXT = (
    rf"[^{_ORDINARY}]|[A-Za-z](?:(?=\x{{301}}?[{_CYRILLIC}])|(?<=[{_CYRILLIC}]\x{{301}}?.)"
    rf"|(?<=[{_TWIN_LATIN}])(?<![\p{{L}}\p{{N}}\p{{M}}].)[{_TWIN_LATIN}]*+(?![\p{{L}}\p{{N}}\p{{M}}])"
    rf"|(?<=[A-Za-z]{{2}})[ ,.]++{_ODD_CYRILLIC}[ ,.]++[A-Za-z]{{2,}})"
)

_WORD = re.compile("[^\\W_" + "".join(map(re.escape, L.INVISIBLE)) + chr(0x300) + "-" + chr(0x36F) + "][\\w" + "".join(map(re.escape, L.INVISIBLE)) + chr(0x300) + "-" + chr(0x36F) + "]*|[" + "".join(map(re.escape, L.INVISIBLE)) + "][\\w" + "".join(map(re.escape, L.INVISIBLE)) + chr(0x300) + "-" + chr(0x36F) + "]*")
_MARK = re.compile(f"[{chr(0x300)}-{chr(0x36F)}]")
_LATIN_ONLY, _CYRILLIC_ONLY = re.compile(f"[{_TWIN_LATIN}]+"), re.compile(f"[{_TWIN_CYRILLIC}]+")
_GREEK_OWN = re.compile("[" + "".join(c for c in map(chr, range(0x391, 0x3CA)) if c.isalpha() and c not in L.GREEK_CYRILLIC and c not in L.GREEK_LATIN) + "]")
MAPPING = "token string, canonical string, only_in string, cost double, n long"
_STRANGE_LETTER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _STRANGE_BLOCKS) + "]")
#: What a strange letter costs, what a word may cost in all, and how much more frequent than its rivals a word must be.
STRANGE_COST, BUDGET, FAR = 0.3, 0.95, 4


class Trie:
    """Ordinary words with their counts."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = node.get("", 0) + count

    def reach(self, token: str, budget: float = 0.0) -> list[tuple[float, int, str]]:
        """(cost, -count, word) of every word within ``budget``: twins and ignorable characters cost 0, a strange letter for any other ``STRANGE_COST``, all else 1."""
        found: dict[str, tuple[float, int]] = {}
        open_, seen = [(0, self.root, "", 0.0)], set()
        while open_:
            i, node, word, cost = open_.pop()
            if (i, word, cost) in seen:
                continue
            seen.add((i, word, cost))
            if i == len(token):
                if "" in node and (word not in found or found[word][0] > cost):
                    found[word] = (cost, node[""])
                if cost + 1 <= budget:
                    open_ += [(i, n, word + c, cost + 1) for c, n in node.items() if c]
                continue
            here, step = token[i], 1
            if here in L.INVISIBLE:
                open_.append((i + 1, node, word, cost))
                continue
            if i + 1 < len(token) and token[i : i + 2] in _PAIRS:
                here, step = _PAIRS[token[i : i + 2]], 2
            for c, n in node.items():
                if not c:
                    continue
                if c in _TWINS.get(here, here):
                    open_.append((i + step, n, word + c, cost))
                elif cost + (change := STRANGE_COST if _STRANGE_LETTER.match(here) and c.isalpha() else 1.0) <= budget:
                    open_.append((i + step, n, word + c, cost + change))
            if cost + 1 <= budget:
                open_.append((i + step, node, word, cost + 1))
        return sorted((cost, -n, w) for w, (cost, n) in found.items())


def _twins() -> tuple[dict[str, str], dict[str, str]]:
    groups: dict[str, set[str]] = {}
    for a, b in L.TO_SKELETON.items():
        groups.setdefault(b, {b}).add(a)
    same = {c: "".join(sorted(g)) for g in groups.values() for c in g}
    for wide, c in L.FULL_WIDTH.items():
        same[wide] = same.get(c, c) + wide
    pairs = {}
    for pair, one in L.COMPOSED.items():
        for c in same.get(pair[0], pair[0]):
            pairs[c + pair[1]] = one
    return same, pairs


_TWINS, _PAIRS = _twins()


def _with_marks(token: str, word: str) -> str:
    """``word`` with the stress marks of ``token`` in their places."""
    out, letters = [], iter(word)
    for i, c in enumerate(token):
        if c in L.INVISIBLE:
            continue
        if _MARK.match(c):
            if token[i - 1 : i + 1] not in _PAIRS:
                out.append(c)
        else:
            out.append(next(letters, ""))
    return "".join(out) + "".join(letters)


def _bare(token: str) -> str:
    """Without stress marks; breves and diaereses that belong to a letter stay."""
    return "".join(c for i, c in enumerate(token) if not _MARK.match(c) or token[i - 1 : i + 1] in _PAIRS) if _MARK.search(token) else token


def spell(token: str, trie: Trie, own_count: int) -> tuple[str, str, float, int]:
    """The canonical spelling, the script that must prevail around it if it depends on that, its cost and its count; cost 9 is the table's."""
    if _GREEK_OWN.search(token):
        return L.plain_text(token), "", 9.0, 0
    bare = _bare(token)
    if _STRANGE_LETTER.search(token):
        reached = trie.reach(bare, BUDGET)
        best = [r for r in reached if r[0] == reached[0][0]]
        if best and (len(best) == 1 or best[0][1] <= FAR * best[1][1]):
            return _with_marks(token, best[0][2]), "", best[0][0], -best[0][1]
        flat = L.plain_text(bare)
        return _with_marks(token, flat if flat.isascii() else L.one_script(flat)), "", 9.0, 0
    reached = [(n, w) for _, n, w in trie.reach(bare)]
    if _LATIN_ONLY.fullmatch(token) or _CYRILLIC_ONLY.fullmatch(token):
        latin = bool(_LATIN_ONLY.fullmatch(token))
        # One-letter words are frequent in both scripts, so that only the text around can tell.
        other = [(n, w) for n, w in reached if w.isascii() != latin and (-n >= own_count or len(bare) == 1)]
        return (min(other)[1], "cyrillic" if latin else "latin", 0.0, -min(other)[0]) if other else (token, "", 0.0, own_count)
    flat = L.plain_text(bare)
    word = min(reached)[1] if reached else flat if flat.isascii() else L.one_script(flat)
    return _with_marks(token, word), "", 0.0 if reached else 9.0, -min(reached)[0] if reached else 0


def _map_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for words, halves in zip(batch["words"], batch["halves"]):
            trie, suspicious = Trie(), []
            for w in words:
                if w["odd"]:
                    if not halves or _STRANGE_LETTER.search(w["token"]):
                        suspicious.append((w["token"], w["n"]))
                    if _LATIN_ONLY.fullmatch(w["token"]) or _CYRILLIC_ONLY.fullmatch(w["token"]):
                        trie.add(w["token"], w["n"])
                elif not _MARK.search(w["token"]):
                    trie.add(w["token"], w["n"])
            found = [(t, *spell(t, trie, n)) for t, n in suspicious]
            # (a half that reaches nothing has nothing to say)
            rows += [r for r in found if r[0] != r[1] and not (halves and r[3] == 9.0)]
        yield pd.DataFrame(rows, columns=["token", "canonical", "only_in", "cost", "n"])


def spellings(texts: DataFrame, column: str) -> DataFrame:
    """(token, canonical, only_in) of every suspicious word of ``column`` whose canonical spelling is another.

    Words are counted over all rows; only spellings that share a skeleton, or a half of one, meet in a task.  Null and
    empty texts have no words.  ``only_in`` names the script that must prevail in a text for the spelling to hold there.
    """
    pieces = texts.select(F.explode(F.split(F.col(column), " ")).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    words = pieces.select("n", F.explode(F.regexp_extract_all("piece", F.lit(WORD), F.lit(0))).alias("token"))
    counted = words.groupBy("token").agg(F.sum("n").alias("n"))
    odd = F.col("token").rlike(_ODD_WORD) | F.col("token").rlike(f"^{_ODD_CYRILLIC}$")
    shape = F.regexp_replace(L.skeleton(F.col("token")), r"[\x{300}-\x{36f}]", "")
    judged = cut(counted.select("token", "n", odd.alias("odd"), F.col("token").rlike(_STRANGE_WORD).alias("strange"), shape.alias("shape")))

    def mapped(blocked: DataFrame, flag: str, halves: bool) -> DataFrame:
        words = F.collect_list(F.struct("token", "n", "odd")).alias("words")
        grouped = blocked.groupBy("block").agg(F.max(flag).alias("any"), words).filter("any")
        return grouped.select("words", F.lit(halves).alias("halves")).mapInPandas(_map_batches, MAPPING)

    size = F.length("shape")
    half = F.floor(size / 2).cast("int")
    both = F.explode(F.array(F.concat(F.lit("l"), size, F.col("shape").substr(F.lit(1), half)), F.concat(F.lit("r"), size, F.col("shape").substr(half + 1, size)))).alias("block")
    by_half = judged.filter("(strange or not odd) and length(shape) > 3").select("token", "n", "odd", "strange", both)
    # Only the halves that a strange word has are grouped.
    by_half = by_half.join(by_half.filter("strange").select("block").distinct(), "block", "left_semi")
    found = mapped(judged.withColumn("block", F.col("shape")), "odd", False).unionByName(mapped(by_half, "strange", True))
    best = F.min(F.struct("cost", (-F.col("n")).alias("n"), "canonical", "only_in")).alias("best")
    return found.groupBy("token").agg(best).select("token", "best.canonical", "best.only_in")


_CYR, _LAT = re.compile(f"[{chr(0x400)}-{chr(0x4FF)}]"), re.compile("[A-Za-z]")


def _rewrite(text: str, words: dict[str, tuple[str, str]]) -> str:
    if words:
        prevails = ""

        def one(m: re.Match) -> str:
            nonlocal prevails
            if (hit := words.get(m[0])) is None:
                return m[0]
            if hit[1]:
                prevails = prevails or ("cyrillic" if len(_CYR.findall(text)) >= len(_LAT.findall(text)) else "latin")
                if hit[1] != prevails:
                    return m[0]
            return hit[0]

        text = _WORD.sub(one, text)
    return L.plain_text(text)


def _rewrite_all(texts: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _rewrite(t, {} if w is None else {x["token"]: (x["canonical"], x["only_in"]) for x in w}) for t, w in zip(texts, words)])


def canonical_texts(texts: DataFrame, column: str, into: str = "canonical_text", changed_only: bool = False) -> DataFrame:
    """``texts`` with ``column`` in canonical form as ``into``; with ``changed_only`` just the rows where it differs.

    Rows without a suspicious character pass through unshuffled.  The others are written once (they are read for their
    words and again for the result) and joined, by a hash of their text, with
    the spellings of their own suspicious words; a hot text is one row of that side, however often it stands.
    Null texts stay null, empty ones empty, repeated rows stay repeated; other columns are untouched, and a column
    called like ``into`` is replaced.
    """
    suspicious = F.coalesce(F.col(column).rlike(_ODD_TEXT), F.lit(False))
    rest = [F.col(f"`{c}`") for c in texts.columns if c != into]
    found = spellings(texts, column)
    dirty = cut(texts.filter(suspicious))
    keyed = dirty.select(F.sha2(F.col(column), 256).alias("_text_id"), F.col(column).alias("_text")).distinct()
    odd = lambda t: t.rlike(_ODD_WORD) | t.rlike(f"^{_ODD_CYRILLIC}$")
    tokens = keyed.select("_text_id", F.explode(F.array_distinct(F.filter(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), odd))).alias("token"))
    tokens = cut(tokens)
    used = found.join(tokens.groupBy("token").agg(F.count("*").alias("_n")), "token")
    words = lookup(tokens, cut(used), ["token"], "_n").groupBy("_text_id").agg(F.collect_list(F.struct("token", "canonical", "only_in")).alias("_words"))
    # (copies of a hot text stay where they are)
    copies = dirty.groupBy(F.sha2(F.col(column), 256).alias("_text_id")).agg(F.count("*").alias("_copies"))
    joined = lookup(dirty.withColumn("_text_id", F.sha2(F.col(column), 256)), copies.join(words, "_text_id", "left"), ["_text_id"], "_copies", "left")
    changed = joined.select(*rest, F.pandas_udf(_rewrite_all, T.StringType())(F.col(column), F.col("_words")).alias(into))
    if changed_only:
        return changed.filter(F.col(into) != F.col(column))
    return texts.filter(~suspicious).select(*rest, F.col(column).alias(into)).unionByName(changed)
