import itertools
import random
from collections import Counter

import numpy as np
import pandas as pd

from spanforge.llm import cross_split, grouped_splits, leaks, reading_level
from spanforge.llm.words import fold, reach, within, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 11))] for _ in range(2))
        k = rng.randint(0, 8)
        d = distance(a, b)
        assert within(a, b, k) == (d if d <= k else None)
        far = reach(a, b, 0, 0, 1, k)
        best = [max(i for i in range(len(a) + 1) if min(distance(a[:i], b[:j]) for j in range(len(b) + 1)) <= e) for e in range(k + 1)]
        assert far == best
        assert reach(a[::-1], b[::-1], len(a) - 1, len(b) - 1, -1, k) == best


def test_words():
    assert words("Cбoр — «Ёлка», 12,5\nLіmmas") == ["сбор", "ёлка", "12", "5", "limmas"] and fold("BULGAM") == "bulgam"


def near_texts(rng, n):
    vocabulary = [f"слово{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 40))] for _ in range(n)]
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(t) // 4))):
            p = rng.randrange(len(t) + 1)
            how = rng.random()
            if how < 0.4 and p < len(t):
                t[p] = rng.choice(vocabulary)
            elif how < 0.7:
                t.insert(p, rng.choice(vocabulary))
            elif p < len(t):
                del t[p]
        base.append(t)
    return base


def test_cross_split_pairs_against_brute_force(spark):
    rng = random.Random(8)
    texts = near_texts(rng, 90)
    rows = [(f"k{i:03d}", rng.choice(["dev", "eval"]), " ".join(t), 1) for i, t in enumerate(texts)]
    rows += [("n1", "dev", None, 1), ("n2", "eval", "", 1), ("n3", "eval", "—", 1), ("n4", None, "слово1", 1)]
    df = spark.createDataFrame(rows, "id string, split string, t string, n int")
    members, linked, counted = cross_split.overlap_report(df, "id", "split", "t")
    got = {(r["key_1"], r["key_2"]) for r in cross_split.member_pairs(members, linked).collect()}
    want = set()
    for (a, sa, ta, _), (b, sb, tb, _) in itertools.combinations(rows[:-4], 2):
        x, y = ta.split(), tb.split()
        if sa != sb and x and y and within(x, y, int(0.2 * max(len(x), len(y)) + 1e-9)) is not None:
            want.add((a, b))
    assert got == want and len(want) > 20
    assert counted.count() == sum(bool(t.strip()) for _, _, t, _ in rows[:-4]) + 1
    partners = {r["key"]: r["partners"] for r in cross_split.partner_counts(members, linked).collect()}
    assert {k: n for k, n in partners.items() if n} == dict(Counter(k for pair in want for k in pair))
    empty = cross_split.overlap_report(df.limit(0), "id", "split", "t")
    assert cross_split.member_pairs(*empty[:2]).count() == 0


def test_a_template_in_many_records_and_maximum_weights(spark, monkeypatch):
    monkeypatch.setattr(cross_split, "LIST_PART", 7)
    rng = random.Random(5)
    template = [f"шаблон{i}" for i in range(30)]
    rows = []
    for i in range(120):
        t = list(template)
        for p in rng.sample(range(30), rng.choice([1, 2, 4, 9])):
            t[p] = f"w{rng.randrange(9)}"
        rows.append((i, rng.choice(["a", "b", "c"]), " ".join(t)))
    df = spark.createDataFrame(rows, "id int, split string, t string")
    members, linked, _ = cross_split.overlap_report(df, "id", "split", "t")
    got = {(r["key_1"], r["key_2"]) for r in cross_split.member_pairs(members, linked).collect()}
    want = {(a, b) for (a, sa, ta), (b, sb, tb) in itertools.combinations(rows, 2) if sa != sb and within(ta.split(), tb.split(), 6) is not None}
    assert got == want and len(want) > 500
    # A record whose lists no other split has cannot reach its bound and enters none.
    alone = spark.createDataFrame([(1, "a", "один два три четыре пять шесть"), (2, "b", "семь восемь девять десять")], "id int, split string, t string")
    _, classes = cross_split.text_classes(alone, "id", "split", "t")
    assert cross_split._postings(classes, 0.2).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(2)
    nodes = [f"n{i:03d}" for i in range(300)]
    rows = [(n, f"k{rng.randrange(260)}") for n in nodes for _ in range(rng.choice([0, 1, 1, 2]))] + [(n, None) for n in nodes] + [("n000", "hot")] + [(n, "hot") for n in nodes[200:]]
    rows += [(nodes[i], f"chain{i}") for i in range(40)] + [(nodes[i + 1], f"chain{i}") for i in range(40)] + [(None, "k1")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n, k in rows:
        if n and k:
            parent[find(("k", k))] = find(("n", n))
    groups = {}
    for n in nodes:
        groups.setdefault(find(("n", n)), []).append(n)
    want = {n: min(g) for g in groups.values() for n in g}
    df = spark.createDataFrame(rows, "u string, k string")
    assert {r["u"]: r["root"] for r in grouped_splits.components(df, "u", "k").collect()} == want
    assert grouped_splits.components(df.limit(0), "u", "k").count() == 0


def test_link_values(spark):
    values = ["GRP_01-a", " grp 01 А", "№ 0123 ", "0123", "N 0123", "нет", "N/A", "не указано", "000", "", None, "—", "unknown", "UNKNOWN"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r["i"]: r["x"] for r in df.select("i", grouped_splits.link_value(df["v"]).alias("x")).collect()}
    assert got[0] == got[1] is not None and got[2] == got[3] == got[4] == "0123" and all(got[i] is None for i in range(5, 14))


def test_grouped_splits(spark):
    rng = random.Random(4)
    rows = [(i, f"g{rng.randrange(900)}" if i > 900 else "giant", rng.choice(["a", "a", "a", "b", None]), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, root string, label string, size string")
    shares = {"train": 0.6, "test": 0.4}
    results = []
    for block in (100_000, 3):
        got = grouped_splits.grouped_splits(df, "id", "root", "label", shares, block).collect()
        assert len(got) == 3000 and len({(r["root"], r["split"]) for r in got}) == len({r["root"] for r in got})
        assert abs(sum(r["split"] == "train" for r in got) / 3000 - 0.6) < 0.01
        results.append({r["id"]: r["split"] for r in got})
    assert results[0] == results[1]
    assert grouped_splits.grouped_splits(df.limit(0), "id", "root", "label", shares).count() == 0


def test_rare_labels_keep_their_proportions(spark):
    rng = random.Random(7)
    rows = [(i, f"g{i // 2}", "rare" if i % 200 < 2 else rng.choice("abc")) for i in range(8000)]
    df = spark.createDataFrame(rows, "id int, root string, label string")
    got = {r["id"]: r["split"] for r in grouped_splits.grouped_splits(df, "id", "root", "label", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    for label, tolerance in (("rare", 0.011), ("a", 0.01), ("b", 0.01), ("c", 0.01)):
        own = [i for i, _, x in rows if x == label]
        for split, want in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
            assert abs(sum(got[i] == split for i in own) / len(own) - want) <= tolerance


def test_leaks_against_planted_passages(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(5)]
    docs, want = [], set()
    for d in range(120):
        doc = [rng.choice(vocabulary) for _ in range(150)]
        if d % 2:
            i, n = rng.randrange(5), rng.choice([20, 21, 30, 45, 60])
            start = rng.randint(0, 60 - n)
            part = items[i][start : start + n]
            for p in rng.sample(range(n), n // 10):
                part[p] = "чужое"
            doc[50:50] = part
            want.add((d, i))
        docs.append((d, " ".join(doc).replace(" ", ",\n", 3), 1))
    docs += [(200, None, 1), (201, "", 1), (202, "w1", 1), (203, " ".join(items[0][:15]), 1)]
    corpus = spark.createDataFrame(docs, "id int, text string, item_id int")
    held = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in enumerate(items)] + [(9, None), (10, "")], "id int, text string")
    got = {(r["id"], r["item_id"]) for r in leaks.leaked_items(corpus, "id", "text", held, "id", "text").collect()}
    assert got == want
    blocks = leaks.leaked_items(corpus, "id", "text", held, "id", "text", block_chars=200).collect()
    assert {(r["id"], r["item_id"]) for r in blocks} == want
    assert leaks.leaked_items(corpus.limit(0), "id", "text", held, "id", "text").count() == 0
    assert leaks.leaked_items(corpus, "id", "text", held.limit(0), "id", "text").count() == 0


def test_joined_line_breaks_count_as_one_word(spark):
    item = " ".join(f"слово{i}кон" for i in range(30))
    text = "до " + item.replace("слово5кон", "слово5-\nкон").replace("слово9", "слo" + chr(0x200B) + "во9") + " после"
    docs = spark.createDataFrame([(1, text)], "d int, t string")
    held = spark.createDataFrame([(7, item)], "i int, t string")
    r = leaks.leaked_items(docs, "d", "t", held, "i", "t").first()
    assert (r["i"], r["item_start"], r["edits"]) == (7, 0, 0)


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(3)
    index = leaks.index_items([(0, " ".join(f"w{i}" for i in range(300)))]).windows[6]
    some = index.prints[rng.integers(0, len(index.prints), 200)].copy()
    for n in range(200):
        for bit in rng.choice(64, rng.integers(0, leaks.RADIUS + 1), replace=False):
            some[n] ^= np.uint64(1) << np.uint64(bit)
    at, to = leaks._near(some, index)
    got = set(zip(at.tolist(), to.tolist()))
    brute = {(a, b) for a in range(200) for b in range(len(index.prints)) if int(some[a] ^ index.prints[b]).bit_count() <= leaks.RADIUS}
    assert got == brute and {a for a, _ in brute} == set(range(200))


def test_items_of_every_length_are_found_with_an_edit_at_every_place():
    rng = random.Random(1)
    for n in [*range(1, 24), 29, 30, 39, 40, 60]:
        item, docs = [f"i{n}x{k}" for k in range(n)], []
        for how in ("change", "add", "drop"):
            for place in range(n):
                t = list(item)
                edited = [place, *rng.sample([q for q in range(n) if q != place], n // 10 - 1)] if n >= 10 else []
                for q in sorted(edited, reverse=True):
                    t[q : q + (how != "add")] = [] if how == "drop" else ["чужое"]
                docs.append(" ".join(["до"] * 9 + t + ["после"] * 9))
        got = leaks._leaks_of(pd.DataFrame({"id": range(len(docs)), "text": docs}), leaks.index_items([(n, " ".join(item))]), {}, 20, 0.1)
        assert {g[0] for g in got} == set(range(len(docs)))
        many = leaks._leaks_of(pd.DataFrame({"id": [0], "text": " ".join(w if k % 5 else "иное" for k, w in enumerate(item))}), leaks.index_items([(n, " ".join(item))]), {}, 20, 0.1)
        assert not many


def test_weighted_shingles_reject_common_turns_of_phrase():
    turn = [f"общее{k}" for k in range(8)]
    items = [(i, " ".join([*turn, *(f"своё{i}x{k}" for k in range(60))])) for i in range(40)]
    index = leaks.index_items(items)
    doc = index.tokens[3][:8] + [1] * 60
    assert not leaks.plausible(index.tokens[3], index.weights[3], doc, 0, 0, 20, 0.1)
    assert leaks.plausible(index.tokens[3], index.weights[3], index.tokens[3][:20], 0, 0, 20, 0.1)


EASY, HARD = "Мы шли домой. Был снег. Он был рад. ", "Предусмотренное законодательством обеспечение исполнения контрактных обязательств предполагает предварительное согласование эксплуатационных параметров, включая показатели, определяемые дифференцированно. "


def test_reading_levels(spark):
    docs, labels = [], []
    for i in range(60):
        hard = i % 2
        text = (HARD if hard else EASY) * (6 if hard else 14) + (EASY if hard else HARD)
        docs.append((i, text, None if i % 7 == 0 else f"s{i % 6}", 0))
        labels += [(i, 3 if hard else 1)] * (1 + i % 2) + [(i, None), (i, 9)]
    docs += [(100, None, "s", 0), (101, "", "s", 0), (102, "Коротко.", "s", 0), (103, "This is an English text about a long act of the buyer. " * 9, "s", 0), (104, HARD * 40 + EASY * 10, "s", 0)]
    d = spark.createDataFrame(docs, "doc_id int, text string, source string, reading_level int")
    rated = spark.createDataFrame(labels, "doc_id int, y int")
    found, model = reading_level.reading_levels(d, "doc_id", "text", "source", rated, "doc_id", "y")
    got = {r["doc_id"]: r["reading_level"] for r in found.collect()}
    assert got == {**{i: 3 if i % 2 else 1 for i in range(60)}, 104: 3} and model.agreement == 1.0
    none, model = reading_level.reading_levels(d, "doc_id", "text", "source", rated.limit(0), "doc_id", "y")
    assert none.count() == 0 and model is None
    assert reading_level.reading_levels(d.limit(0), "doc_id", "text", "source", rated, "doc_id", "y")[0].count() == 0


def test_trees_and_isotonic_regression():
    rng = np.random.default_rng(0)
    x = rng.random((800, 4))
    y = (x[:, 0] > 0.5) + 2.0 * (x[:, 1] > 0.3)
    trees = reading_level.fit(x[:600], y[:600], np.ones(600))
    assert np.abs(trees.predict(x[600:]) - y[600:]).mean() < 0.1
    starts, values = reading_level.isotonic(x[:, 0], y, np.ones(800))
    assert (np.diff(values) >= 0).all() and (np.diff(starts) >= 0).all()
