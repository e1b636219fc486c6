"""Folding of characters that look alike.

Two forms are offered, each as a Spark column expression and as plain Python:

* ``plain``: spaces, full-width forms, invisible characters and non-breaking hyphens become the ordinary
  character; the short and double-dot accents are composed.  Scripts are left alone.
* ``skeleton``: the plain form in which letters of different scripts that share a shape are one letter.
  Two texts with the same skeleton look the same.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible characters, spaces that look like the ordinary one, hyphens that look like "-".
INVISIBLE = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x200E, 0x200F, 0x2061, 0x2062, 0x2063, 0x2064, 0x180E)))
SPACES = "".join(map(chr, (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
HYPHENS = chr(0x2010) + chr(0x2011)

# Letters of other scripts and the Cyrillic letter of the same shape.
LATIN_CYRILLIC = {
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О",
    "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "У", "a": "а", "c": "с", "e": "е", "i": "і", "j": "ј",
    "o": "о", "p": "р", "s": "ѕ", "x": "х", "y": "у", chr(0xCB): "Ё", chr(0xEB): "ё",
    "d": "ԁ", "h": "һ", "l": "ӏ", "q": "ԛ", "w": "ԝ", "G": "Ԍ", "Q": "Ԛ", "W": "Ԝ",
}
GREEK_CYRILLIC = {
    "Α": "А", "Β": "В", "Ε": "Е", "Η": "Н", "Ι": "І", "Κ": "К", "Μ": "М", "Ο": "О", "Ρ": "Р", "Τ": "Т",
    "Χ": "Х", "Υ": "У", "Ѕ": "Ѕ", "α": "а", "ο": "о", "ρ": "р", "ϲ": "с", "Ϲ": "С", "ϳ": "ј", "χ": "х",
}
GREEK_LATIN = {"Ν": "N", "Ζ": "Z", "ν": "v"}
# Cyrillic letters outside Russian that exist in no Russian word; with a Latin twin they are taken for it.
FOREIGN_CYRILLIC = "ІЈЅіјѕԁһӏԛԝԌԚԜЇї"

CYRILLIC_LATIN = {c: a for a, c in LATIN_CYRILLIC.items()}
TO_SKELETON = LATIN_CYRILLIC | GREEK_CYRILLIC | GREEK_LATIN

FULL_WIDTH = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
PLAIN = {c: " " for c in SPACES} | {c: "-" for c in HYPHENS} | FULL_WIDTH | {c: "" for c in INVISIBLE}
# Base letters that carry a breve or a diaeresis in the languages at hand; both scripts, since the base may be disguised.
BREVE, DIAERESIS = chr(0x306), chr(0x308)
COMPOSED = {a + BREVE: chr(c) for a, c in (("и", 0x439), ("И", 0x419), ("у", 0x45E), ("У", 0x40E))} | {
    a + DIAERESIS: chr(c) for a, c in (("е", 0x451), ("Е", 0x401), ("і", 0x457), ("І", 0x407))
}

# One pass does both steps, so that a full-width letter ends as the letter of its shape.
SKELETON = {a: TO_SKELETON.get(b, b) for a, b in PLAIN.items()} | TO_SKELETON

_PLAIN_TABLE = str.maketrans(PLAIN)
_SKELETON_TABLE = str.maketrans(SKELETON)
_NOT_PLAIN = re.compile("[" + re.escape("".join(PLAIN)) + "]")
_MARKED = re.compile(f"[{chr(0x300)}-{chr(0x36F)}]")


def _translate(column: Column, mapping: dict[str, str]) -> Column:
    """``translate`` with the characters that vanish put last, as it drops those without a counterpart."""
    kept = [(a, b) for a, b in mapping.items() if b]
    gone = [a for a, b in mapping.items() if not b]
    return F.translate(column, "".join(a for a, _ in kept) + "".join(gone), "".join(b for _, b in kept))


def _compose(column: Column) -> Column:
    out = column
    for pair, one in COMPOSED.items():
        out = F.replace(out, F.lit(pair), F.lit(one))
    return F.when(column.rlike(f"[{BREVE}{DIAERESIS}]"), out).otherwise(column)


def plain(column: Column) -> Column:
    """Ordinary spaces, widths and hyphens, nothing invisible, accents composed.  Null stays null."""
    return _compose(_translate(column, PLAIN))


def skeleton(column: Column) -> Column:
    """Equal for texts that look the same (letter case matters).  Null stays null."""
    return _compose(_translate(column, SKELETON))


def caseless_skeleton(column: Column) -> Column:
    """As ``skeleton``, ignoring letter case: the text is upper-cased first, so that shapes are compared as capitals."""
    return _compose(_translate(F.upper(_translate(column, PLAIN)), TO_SKELETON))


def plain_text(text: str) -> str:
    if text.isascii():
        return text
    out = text.translate(_PLAIN_TABLE) if _NOT_PLAIN.search(text) else text
    return unicodedata.normalize("NFC", out) if _MARKED.search(out) else out


def skeleton_text(text: str) -> str:
    out = text.translate(_SKELETON_TABLE)
    if _MARKED.search(out):
        for pair, one in COMPOSED.items():
            out = out.replace(pair, one)
    return out


_TO_CYRILLIC = str.maketrans(LATIN_CYRILLIC | GREEK_CYRILLIC)
_TO_LATIN = str.maketrans(CYRILLIC_LATIN | GREEK_LATIN | {g: CYRILLIC_LATIN[c] for g, c in GREEK_CYRILLIC.items() if c in CYRILLIC_LATIN})
_OWN_CYRILLIC = re.compile("[" + "".join(chr(c) for c in [*range(0x410, 0x450), 0x401, 0x451] if chr(c) not in CYRILLIC_LATIN) + "]")
_OWN_LATIN = re.compile("[" + "".join(c for c in map(chr, [*range(65, 91), *range(97, 123)]) if c not in LATIN_CYRILLIC or LATIN_CYRILLIC[c] in FOREIGN_CYRILLIC) + "]")


def one_script(word: str) -> str:
    """The word in the script of its letters without a twin: Cyrillic first, then Latin; undecided words become Cyrillic."""
    if word.isascii() and _OWN_LATIN.search(word):
        return word
    if _OWN_CYRILLIC.search(word) or not _OWN_LATIN.search(word):
        return word.translate(_TO_CYRILLIC)
    return word.translate(_TO_LATIN)
