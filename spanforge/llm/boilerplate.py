"""The main body of web pages, by a site style tree.

The pages of a host are merged into one tree.  Under the host stand the styles of blocks (marks of link lists, leading
labels, sentence ends, length), under a style the heads and tails of blocks (label or first sentence, last sentence),
under these the whole block, all with numbers, quoted names and disguises masked, and its content as it stands.  Two entropies tell how
important a branch is:

* of its content: a content spread evenly over the pages of its host has the full entropy log(pages) and says nothing about any
  one of them, a content of one page has none;
* of its presentation: the parts of the frame are labelled at random, those of the body by one rule.  What "at random" means
  is read off the contents that the first entropy convicts; the profiles of the body are found by expectation
  maximisation, one for each kind.  Where all blocks are labelled alike, the profiles agree and content alone decides.

Every node inherits the importance of its parent and moves away from it as its own occurrences tell, so that nodes seen
once are judged too, by their style, their content and their own label.  Branches of low importance are removed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.lookalike import COMPOSED, PLAIN, TO_SKELETON
from spanforge.operators.joins import lookup
from spanforge.session import cut

KINDS = ("chapter_title", "article_title", "body", "other", "")
#: Weight of a parent against the occurrences of its child: of a style, and of the same node over all hosts.
STYLE_WEIGHT, HOST_WEIGHT = 2.0, 10.0
#: Log odds that a content on a single page of its host adds, and one on all pages; one at the share ``REPEATED`` of the full entropy adds none.
SINGLE_ODDS, REPEATED_ODDS = -2.0, 2.0
#: Share of the full entropy from which a content tells how the frame is presented.
REPEATED = 0.75
STYLES = 24

_DISGUISED = re.compile("[^\n -@\\[-`{-~А-ЯЁа-яё№«»—–…©·›→←²³]")
_FOLD = str.maketrans(PLAIN | TO_SKELETON | {chr(0x301): "", "[": "", "]": ""})
_ACCENT = re.compile(f"[{chr(0x306)}{chr(0x308)}]")
_QUOTED, _NUMBER = re.compile("«[^»]*»+"), re.compile(r"\d+")
_SEPARATED = re.compile(r"[|·›»¦•→←/\n]|  ")
_SEPARATOR = re.compile(r"\s*[|·›»¦•→←]+\s+|\s+[|·›¦•→←]\s*|\s+/\s+|\n+| {2,}")
_LEADING = re.compile(r"^[\s—–>*-]+")
_LABEL, _FIRST = re.compile(r"([^.:!?]{1,60}[:.!?])(?:\s|$)"), re.compile(r".*?[.!?:;](?=\s|$)")
_LAST = re.compile(r"(?<=[.!?])\s+")
_NODES = "style int, head long, tail long, whole long, content long"


def nodes_of(text: str | None) -> tuple[int, str, str, str]:
    """(style, head, tail, whole) of a block; an empty or null text has style -1 and empty nodes, a block of one sentence no tail."""
    if not text:
        return -1, "", "", ""
    if _DISGUISED.search(text):
        text = text.translate(_FOLD).upper().translate(_FOLD)
        if _ACCENT.search(text):
            for pair, one in COMPOSED.items():
                text = text.replace(pair, one)
    else:
        text = text.replace("[", "").replace("]", "").upper()
    masked = _NUMBER.sub("0", _QUOTED.sub("@", text) if "«" in text else text).strip()
    parts = [p for p in map(str.strip, _SEPARATOR.split(masked)) if p] if _SEPARATED.search(masked) else [masked] if masked else []
    if not parts:
        return -1, "", "", ""
    first, last = _LEADING.sub("", parts[0]), parts[-1]
    label, sentence = _LABEL.match(first), _FIRST.match(first)
    head = label[1] if label else sentence[0] if sentence else first
    tail = _LAST.split(last)[-1]
    tail = tail.rstrip(".!?") if len(parts) > 1 or len(tail) < len(last) else ""
    words = masked.count(" ") + 1
    style = (len(parts) > 1) * 12 + (label is not None and len(head) < len(first)) * 6 + (masked[-1] in ".!?…") * 3 + (words > 3) + (words > 14)
    return style, head, tail, "|".join(parts)


def _hash(role: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(role + text) - (1 << 63)


def described(blocks: DataFrame, key: str, page: str, kind: str, text: str) -> DataFrame:
    """(key, page, kind, style, head, tail, whole, content): blocks as hashes of their nodes, where they lie; texts go no further."""
    key_type, page_type = (blocks.schema[c].dataType.simpleString() for c in (key, page))
    number = {k: i for i, k in enumerate(KINDS)}

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [nodes_of(t) for t in b["text"]]
            yield pd.DataFrame({
                "key": b["key"], "page": b["page"], "kind": [number.get(k, 4) for k in b["kind"]], "style": [s for s, *_ in found],
                "head": [_hash("h", h) for _, h, _, _ in found], "tail": [_hash("t", t) if t else 0 for _, _, t, _ in found], "whole": [_hash("w", w) for *_, w in found], "content": [_hash("c", " ".join(t.split())) if t else 0 for t in b["text"]],
            })

    rows = blocks.select(F.col(key).alias("key"), F.col(page).alias("page"), F.col(kind).alias("kind"), F.col(text).alias("text"))
    return rows.mapInPandas(describe, f"key {key_type}, page {page_type}, kind int, {_NODES}")


def shares(counts: np.ndarray, profiles: np.ndarray, prior: np.ndarray, weight: float, rounds: int = 20) -> np.ndarray:
    """The share of each node's occurrences that follow each profile, starting from its parent's shares."""
    out = prior
    total = counts.sum(axis=1, keepdims=True) + weight
    for _ in range(rounds):
        mixed = np.maximum(out @ profiles, 1e-12)
        # (an over-relaxed step: shares that belong at nought get there sooner)
        gain = ((counts / mixed) @ profiles.T + weight * prior / np.maximum(out, 1e-12)) / total
        out = out * gain**1.8
        out = out / out.sum(axis=1, keepdims=True)
    return out


def fit_profiles(repeated: np.ndarray, vectors: np.ndarray, times: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Presentation profiles, the frame's first, and how often nodes follow each.

    ``repeated`` counts the kinds of the contents that their entropy convicts; ``vectors`` are mean kind counts of groups
    of ``times`` nodes each.  The body has one profile for each kind, started from a node that shows hardly any other.
    """
    k = vectors.shape[1]
    total = vectors.T @ times + 1.0
    base = total / total.sum()
    frame = (repeated + base) / (repeated.sum() + 1)
    profiles = np.vstack([frame, *(0.85 * np.eye(k)[i] + 0.15 * base for i in range(k))])
    mix = np.full(k + 1, 1 / (k + 1))
    importance = times * np.minimum(vectors.sum(axis=1), 50)
    for _ in range(rounds):
        fit = np.log(mix)[None] + vectors @ np.log(np.maximum(profiles, 1e-9)).T
        held = np.exp(fit - fit.max(axis=1, keepdims=True))
        held = held / held.sum(axis=1, keepdims=True)
        own = (held * times[:, None]).T @ vectors
        own[0] += repeated
        profiles = np.vstack([(own[j] + 5 * profiles[j]) / (own[j].sum() + 5) for j in range(k + 1)])
        profiles[1:] = 0.97 * profiles[1:] + 0.03 * base
        mix = (held * importance[:, None]).sum(axis=0) + 1
        mix = mix / mix.sum()
    return profiles, mix


def judge(b: pd.DataFrame, profiles: np.ndarray, mix: np.ndarray, styles: np.ndarray) -> np.ndarray:
    """The importance (0 frame, 1 body) of contents, from their own counts, those of their parents, and their pages."""
    counts = lambda c: np.array([x if x is not None else np.zeros(len(KINDS)) for x in b[c]], dtype=float).reshape(len(b), len(KINDS))
    own = counts("own")

    def node(role: str, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # A content is no witness in its own case: its parents are judged by all others.
        here, everywhere = (np.maximum(counts(f"{role}_{c}") - own, 0) for c in ("host", "all"))
        return shares(here, profiles, shares(everywhere, profiles, parent, STYLE_WEIGHT), HOST_WEIGHT), everywhere.sum(axis=1)

    style = styles[b["style"].to_numpy()]
    head, n_head = node("h", style)
    tail, n_tail = node("t", style)
    # A noisy tail convicts unless the head is body and better known; a sound one clears prose whose head is less known.
    noisy, sound = tail[:, 0] > 0.7, (tail[:, 0] < 0.3) & (b["style"].to_numpy() < 12)
    by_tail = b["has_tail"].to_numpy() & (n_tail > 0) & (noisy & (head[:, 0] > 0.3) | (noisy | sound) & (n_tail > n_head))
    above, known = np.where(by_tail[:, None], tail, head), np.where(by_tail, n_tail, n_head)
    whole, n_whole = node("w", above)
    # A whole that is nearly all its parent has would tell the same twice.
    mixed = np.where((n_whole * 2 > known)[:, None], above, whole)
    frame = np.clip(mixed[:, 0], 0.001, 0.999)
    body = np.maximum(mixed[:, 1:], 1e-4)
    body = np.log(body / body.sum(axis=1, keepdims=True))
    logs = np.log(np.maximum(profiles, 1e-9))
    fit = body + own @ logs[1:].T
    top = fit.max(axis=1)
    evidence = own @ logs[0] - (top + np.log(np.exp(fit - top[:, None]).sum(axis=1)))
    # The better a branch is known as frame by its labels, and the more labels tell, the less the content has to say.
    told = -math.log(min(1.0, float((np.sqrt(profiles[:1] * profiles[1:]).sum(axis=1) * mix[1:]).sum() / mix[1:].sum())))
    seen, pages = b["seen"].to_numpy(dtype=float), b["pages"].to_numpy(dtype=float)
    spread = np.where(pages > 1, np.log(np.minimum(seen, np.maximum(pages, 2))) / np.log(np.maximum(pages, 2)), 0.5)
    said = np.where(spread < REPEATED, SINGLE_ODDS * (1 - spread / REPEATED), REPEATED_ODDS * (spread - REPEATED) / (1 - REPEATED))
    odds = np.log(frame / (1 - frame)) + evidence + said / (1 + told * known * frame)
    return 1 / (1 + np.exp(np.clip(odds, -50, 50)))


def judged_blocks(blocks: DataFrame, key: str, page: str, kind: str, text: str, pages: DataFrame, host: str) -> DataFrame:
    """(key, importance, is_frame) of every block; ``pages`` holds the host of each page, one row a page.

    A repeated key counts once (its greatest row).  A null or unknown host is a host of its own, a null or unknown kind a kind
    of its own; empty and null texts are frame.  Blocks leave their place as hashes only; equal contents of a host are one
    row before they are shuffled further, and rows of hot hosts, heads and contents are met by broadcast.  No threshold
    on occurrences keeps a block from being judged.
    """
    rows = described(blocks, key, page, kind, text)
    best = rows.groupBy("key").agg(F.max(F.struct("page", "kind", "style", "head", "tail", "whole", "content")).alias("b")).select("key", "b.*")
    hosts = pages.select(F.col(page).alias("page"), F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit(""))).alias("host"))
    rows = cut(best.join(hosts, "page", "left").withColumns({"host": F.coalesce("host", F.lit(0)), "page": F.xxhash64("page")}))
    per_kind = [F.count_if(F.col("kind") == i).alias(f"k{i}") for i in range(len(KINDS))]
    columns = [f"k{i}" for i in range(len(KINDS))]
    sums = [F.sum(c).alias(c) for c in columns]
    vector = lambda name: F.array(*(F.col(c).cast("double") for c in columns)).alias(name)
    contents = rows.filter("style >= 0").groupBy("host", "content").agg(
        *(F.first(c).alias(c) for c in ("style", "head", "tail", "whole")), F.count("*").alias("n"), *per_kind, F.min("page").alias("low"), F.max("page").alias("high")
    )
    contents = cut(contents.withColumn("seen", F.when(F.col("low") == F.col("high"), 1).otherwise(F.col("n"))).drop("low", "high"))
    sizes = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    weights = contents.groupBy("host").agg(F.count("*").alias("_n"))
    contents = cut(lookup(contents, sizes.join(weights, "host"), ["host"], "_n"))
    # Heads, tails and wholes, on their host and over all.
    parents = F.explode(F.when(F.col("tail") != 0, F.array("head", "whole", "tail")).otherwise(F.array("head", "whole"))).alias("node")
    on_host = cut(contents.select("host", *columns, parents).groupBy("host", "node").agg(*sums, F.count("*").alias("_n")))
    everywhere = cut(on_host.groupBy("node").agg(*sums, F.count("*").alias("_n")))
    # What comes to the driver is a histogram: a row for each style, and for each (leading kind, size class, purity class).
    entropy = F.log(F.least("seen", "pages")) / F.log("pages")
    repeated = contents.filter("pages > 1 and seen > 2").filter(entropy >= REPEATED).agg(*sums).first()
    n, top = sum((F.col(c) for c in columns), F.lit(0)), F.greatest(*columns)
    leading = F.array_position(F.array(*columns), top)
    groups = everywhere.groupBy(leading.alias("g"), F.floor(F.log2(n)).alias("s"), F.floor(top / n * 20).alias("p")).agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("times")).toPandas()
    per_style = contents.groupBy("style").agg(*sums).toPandas()
    profiles, mix = fit_profiles(np.array([x or 0 for x in repeated], dtype=float), groups[columns].to_numpy(dtype=float), groups["times"].to_numpy(dtype=float))
    styles = np.tile(mix, (STYLES, 1))
    if len(per_style):
        styles[per_style["style"].to_numpy()] = shares(per_style[columns].to_numpy(dtype=float), profiles, np.tile(mix, (len(per_style), 1)), STYLE_WEIGHT, 40)
    # Each content with the counts of its parents: (host, node) first, which brings those over all hosts along.
    both = lookup(on_host.select("host", "node", vector("host_counts"), F.col("_n").alias("_rows")), everywhere.join(on_host.groupBy("node").agg(F.count("*").alias("_h")), "node").select("node", vector("all_counts"), "_h"), ["node"], "_h")
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("node")) for r, c in (("h", "head"), ("t", "tail"), ("w", "whole"))))
    asked = contents.select("host", "content", F.explode(roles).alias("a")).select("host", "content", "a.*").filter("node <> 0")
    met = lookup(asked, both, ["host", "node"], "_rows").groupBy("host", "content").agg(*(F.max(F.when(F.col("role") == r, F.col(f"{c}_counts"))).alias(f"{r}_{c}") for r in "htw" for c in ("host", "all")))
    facts = contents.select("host", "content", "style", (F.col("tail") != 0).alias("has_tail"), "n", vector("own"), "seen", "pages").join(met, ["host", "content"])

    def judge_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "content": b["content"], "importance": judge(b, profiles, mix, styles), "n": b["n"]})

    values = cut(facts.mapInPandas(judge_all, "host long, content long, importance double, n long"))
    found = lookup(rows.filter("style >= 0").select("key", "host", "content"), values, ["host", "content"], "n").select("key", "importance")
    empty = rows.filter("style < 0").select("key", F.lit(0.0).alias("importance"))
    return found.unionByName(empty).select(F.col("key").alias(key), "importance", (F.col("importance") < 0.5).alias("is_frame"))
