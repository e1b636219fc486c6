"""Reading level of documents by gradient-boosted regression trees.

Each sentence is described by its length, vocabulary, syntax and cohesion with the one before; trees fitted on a bounded
sample of rated documents predict its grade, which isotonic regression calibrates on predictions for sources that a
fold has not seen.  A document has the distribution of its sentences' grades, weighted by their letters, and the level of
the greater part of its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_SENTENCE = re.compile(r"(?<=[.!?…])[»\"”)]*\s+(?=[^a-zа-яё])|\n+")
_CYRILLIC, _LATIN = re.compile("[А-Яа-яЁё]+"), re.compile("[A-Za-z]+")

# Endings of abstract nouns and of participles (a stem's last letters and an adjective's ending), linking words.
_ABSTRACT = frozenset("ение ения ению ении ание ания анию ании ость ости ация ации ацию иция иции ство ства ству стве".split())
_PARTICIPLE = frozenset(a + b for a in ("ющ", "ящ", "ущ", "ащ", "вш", "нн", "ем") for b in ("ий", "ая", "ее", "ие", "ей", "их", "ую", "ый", "ое", "ые", "ым", "ых", "ой", "ом", "им"))
_PARTICIPLE_LONG = frozenset(a + b for a in ("ющ", "ящ", "ущ", "ащ", "вш", "нн", "ем") for b in ("его", "ему", "ими", "ого", "ому", "ыми"))
_LINKS = frozenset("что чтобы если когда хотя пока ибо либо поскольку вследствие ввиду согласно посредством путём включая относительно".split())
_LINK_STEMS = frozenset(("котор",))

#: The number of rated documents the trees are fitted on, at most, taken by a hash of their ids, and of the sentences of
#: each, evenly spaced; grading takes all sentences of all documents.
SAMPLE, SENTENCES = 4000, 200
LEVELS = (1, 2, 3)
FEATURES = 12


def is_russian(text: str) -> bool:
    """Whether more letters of a text are Russian ones than Latin ones."""
    return not text.isascii() and sum(map(len, _CYRILLIC.findall(text))) > sum(map(len, _LATIN.findall(text)))


def has_words(text: str, least: int) -> bool:
    return next(islice(_WORD.finditer(text), least - 1, None), None) is not None if least > 0 else True


def features(text: str) -> list[list[float]]:
    """One row for each sentence of at least two words; the first column is its letters.  No words, no rows."""
    rows, before = [], set()
    for s in _SENTENCE.split(text):
        w = _LETTERS.findall(s.lower())
        n = len(w)
        if n < 2:
            continue
        sizes = [len(x) for x in w]
        letters = sum(sizes)
        stems = {x[:5] for x in w if len(x) > 3}
        shared = len(before & stems) / min(len(before), len(stems)) if before and stems else 0.0
        before = stems
        rows.append([
            letters, n, letters / n, sum(x >= 10 for x in sizes) / n, sum(x <= 4 for x in sizes) / n, max(sizes), s.count(",") / n,
            sum(x[-4:] in _ABSTRACT for x in w) / n, sum(x[-4:] in _PARTICIPLE or x[-5:] in _PARTICIPLE_LONG for x in w) / n,
            sum(x in _LINKS or x[:5] in _LINK_STEMS for x in w) / n, len(set(w)) / n, shared,
        ])
    return rows


@dataclass
class Trees:
    """Boosted regression trees of one depth over binned features."""

    edges: list[np.ndarray]
    base: float
    rate: float
    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self.bins(x)
        rows = np.arange(len(binned))
        out = np.full(len(binned), self.base)
        for f, b, v in zip(self.feature, self.bound, self.value):
            node = np.zeros(len(binned), dtype=np.int64)
            while True:
                inner = node < len(f)
                if not inner.any():
                    break
                at = np.minimum(node, len(f) - 1)
                node = np.where(inner, 2 * node + 1 + (binned[rows, f[at]] > b[at]), node)
            out += self.rate * v[node - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.12, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Least-squares boosting with histogram splits; constant features are never chosen."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    model = Trees(edges, float(np.average(y, weights=weight)), rate, np.empty((0, 2**depth - 1), int), np.empty((0, 2**depth - 1), int), np.empty((0, 2**depth)))
    binned = model.bins(x).astype(np.int64)
    n, k = binned.shape
    flat = binned + np.arange(k) * bins
    guess = np.full(n, model.base)
    all_f, all_b, all_v = [], [], []
    for _ in range(trees):
        gradient = (y - guess) * weight
        node = np.zeros(n, dtype=np.int64)
        f_, b_ = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, bins, dtype=np.int64)
        for at in range(2**depth - 1):
            rows = np.flatnonzero(node == at)
            if len(rows):
                cells = flat[rows].ravel()
                g = np.bincount(cells, weights=np.repeat(gradient[rows], k), minlength=k * bins).reshape(k, bins).cumsum(axis=1)
                h = np.bincount(cells, weights=np.repeat(weight[rows], k), minlength=k * bins).reshape(k, bins).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[(h < least) | (ht - h < least)] = -1
                best = int(gain.argmax())
                if gain.flat[best] > 1e-9:
                    f_[at], b_[at] = divmod(best, bins)
                node[rows] = 2 * at + 1 + (binned[rows, f_[at]] > b_[at])
        leaf = node - (2**depth - 1)
        g = np.bincount(leaf, weights=gradient, minlength=2**depth)
        h = np.bincount(leaf, weights=weight, minlength=2**depth)
        v = g / (h + ridge)
        guess += rate * v[leaf]
        all_f.append(f_)
        all_b.append(b_)
        all_v.append(v)
    model.feature, model.bound, model.value = np.array(all_f), np.array(all_b), np.array(all_v)
    return model


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function closest to y over x: its starts and values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([y[i] * weight[i], weight[i], x[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _ = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class LevelModel:
    trees: Trees
    starts: np.ndarray
    grades: np.ndarray
    agreement: float = 0.0
    by_group: dict = field(default_factory=dict)

    def calibrated(self, predicted: np.ndarray) -> np.ndarray:
        grade = self.grades[np.maximum(np.searchsorted(self.starts, predicted, side="right") - 1, 0)]
        return np.clip(np.rint(grade), LEVELS[0], LEVELS[-1]).astype(np.int64)

    def levels(self, sentences: list[list[list[float]]], predicted: np.ndarray | None = None) -> np.ndarray:
        """The level of the greater part of each text; ties go to the lower level, a text without sentences gets the lowest."""
        flat = [row for rows in sentences for row in rows]
        shares = np.zeros((len(sentences), len(LEVELS)))
        if flat:
            x = np.array(flat)
            grade = self.calibrated(self.trees.predict(x) if predicted is None else predicted)
            np.add.at(shares, (np.repeat(np.arange(len(sentences)), [len(r) for r in sentences]), grade - LEVELS[0]), x[:, 0])
        return shares.argmax(axis=1) + LEVELS[0]


def train(sentences: list[list[list[float]]], y: np.ndarray, raters: np.ndarray, groups: np.ndarray, folds: int = 5) -> LevelModel:
    """Fitted on the sentences of all rated texts, calibrated on predictions for groups (sources) their fold has not seen.

    ``agreement`` is the share of texts whose cross-validated level is the raters' one, ``by_group`` has it with the number of texts by group.
    """
    counts = [len(r) for r in sentences]
    x = np.array([row for rows in sentences for row in rows])
    text = np.repeat(np.arange(len(y)), counts)
    letters = np.bincount(text, weights=x[:, 0], minlength=len(y))
    weight = x[:, 0] / letters[text] * raters[text]
    weight = weight * (len(weight) / weight.sum())
    names = {g: i % folds for i, g in enumerate(sorted(set(groups)))}
    fold = np.array([names[g] for g in groups])[text]
    held = np.full(len(x), np.nan)
    for f in range(folds):
        out = fold == f
        if out.any() and (~out).any():
            held[out] = fit(x[~out], y[text][~out], weight[~out]).predict(x[out])
    trees = fit(x, y[text], weight)
    if np.isnan(held).any():
        held = trees.predict(x)
    model = LevelModel(trees, *isotonic(held, y[text], weight))
    given = np.clip(np.rint(y), LEVELS[0], LEVELS[-1])
    right = model.levels(sentences, held) == given
    model.agreement = float(np.average(right, weights=raters))
    model.by_group = {str(g): (int((groups == g).sum()), float(right[groups == g].mean())) for g in set(groups)}
    return model


def reading_levels(documents: DataFrame, doc_id: str, text: str, source: str, labels: DataFrame, label_doc: str, label: str, least_words: int = 40, sample: int = SAMPLE) -> tuple[DataFrame, LevelModel | None]:
    """(doc_id, reading_level) of each Russian document of at least ``least_words`` words, and the fitted model.

    Russian is told by the letters, not by a language column.  The raters' labels of a document are averaged, more raters
    weighing more; labels outside the levels and null ones are ignored.  At most ``sample`` rated documents, by a hash of
    their ids, are collected for the fit; all documents are graded, whole, where they lie.  Null and short texts have
    no level; null sources are one source.  Without rated documents nothing can be fitted: no rows and no model.
    """
    rated = labels.filter(F.col(label).between(LEVELS[0], LEVELS[-1])).groupBy(F.col(label_doc).alias("id")).agg(F.avg(label).alias("y"), F.count("*").alias("n"))
    some = rated.orderBy(F.xxhash64("id"), "id").limit(sample)
    known = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    key_type = documents.schema[doc_id].dataType.simpleString()

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [features(t) if t is not None and is_russian(t) else [] for t in b["text"]]
            x = [r if len(r) <= SENTENCES else [r[i * len(r) // SENTENCES] for i in range(SENTENCES)] for r in x]
            yield b[["id", "source", "y", "n"]].assign(x=x)[[bool(r) for r in x]]

    rows = known.join(F.broadcast(some), "id").mapInPandas(describe, f"id {key_type}, source string, y double, n long, x array<array<double>>").toPandas()
    if rows.empty:
        return documents.sparkSession.createDataFrame([], f"{doc_id} {key_type}, reading_level int"), None
    rows = rows.sort_values("id")
    model = train([[list(r) for r in x] for x in rows["x"]], rows["y"].to_numpy(float), rows["n"].to_numpy(float), rows["source"].to_numpy())
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = b[[t is not None and is_russian(t) and has_words(t, least_words) for t in b["text"]]]
            for s in range(0, len(part), 1000):
                some = part.iloc[s : s + 1000]
                yield pd.DataFrame({"id": some["id"], "reading_level": shared.value.levels([features(t) for t in some["text"]])})

    graded = known.select("id", "text").mapInPandas(grade, f"id {key_type}, reading_level int")
    return graded.withColumnRenamed("id", doc_id), model
