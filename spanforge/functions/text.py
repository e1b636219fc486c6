"""Scalar text and array functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrase of a short text that only points to another article, and the numbered citations of articles, parts and points.
POINTER = "(?iu)в соответствии со стать"
CITATION = r"(?iuU)(?:\bстат(?:ья|ьи|ье|ью|ьёй|ей)|\bст\.?|\bчаст(?:ь|и|ью)|\bч\.?|\bпункт(?:а|е|ом|ы)?|\bп\.?)\s*\d+(?:\.\d+)*"


def tokenize(text: Column) -> Column:
    """Lower-case runs of digits, basic Latin and Russian letters, ё as е; null for null."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), F.lit("[0-9a-zа-я]+"), F.lit(0))


def word_set(text: Column) -> Column:
    """The distinct Unicode words of the lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)))


def normalize_text(text: Column) -> Column:
    """Ordinary spaces and line ends, no runs of blanks, at most one empty line between lines, no outer space."""
    nbsp = chr(0xA0)
    out = F.replace(text, F.lit(nbsp), F.lit(" "))
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\f\x0B]+", " ")
    out = F.regexp_replace(out, r"(?m)^ | $", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def normalized(text: str) -> str:
    """``normalize_text`` outside of Spark."""
    lines = [" ".join(filter(None, re.split(r"[ \t\f\v]+", line))).strip() for line in re.split(r"\r\n?|\n", text.replace(chr(0xA0), " "))]
    # Of neighbouring empty lines one is left.
    kept = [line for line, before in zip(lines, ["", *lines]) if line or before]
    return "\n".join(kept).strip()


def unescape_markdown(text: Column) -> Column:
    """Without inline data images and without backslashes before punctuation."""
    return F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\(data:[^)]*\)", ""), r"\\([\\`*_{}\[\]()#+\-.!>~|])", "$1")


def is_pointer_text(text: Column, most: int = 240) -> Column:
    """Short once its space is folded, and pointing to another article."""
    folded = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return (F.length(folded) <= most) & folded.rlike(POINTER)


def contains_direct_citation(text: Column) -> Column:
    """Whether a numbered article, part or point is cited."""
    return text.rlike(CITATION)


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two sets; 1 where both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def overlap_length(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Length of the common part of two half-open intervals."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def token_cost(text: Column) -> Column:
    """Estimated tokens of a text: a third of its characters, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 3))


def public_id(prefix: str, salt: str, value: Column) -> Column:
    """Pseudonym of an id: prefix and 12 hexadecimal digits of its salted digest."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 12))


def fingerprint(value: Column) -> Column:
    """The first 16 hexadecimal digits of the digest."""
    return F.substring(F.sha2(value, 256), 1, 16)


def l2_normalized(vector: Column) -> Column:
    """The vector at length 1, lengths under 1e-12 counting as that."""
    norm = F.greatest(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.lit(1e-12))
    return F.transform(vector, lambda x: x.cast("double") / norm)


def dot(left: Column, right: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
