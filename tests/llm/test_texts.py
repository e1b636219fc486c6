import random
import sys
import re
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.llm import boilerplate, lookalikes, packing, personal, splitting

BREVE, ZERO_WIDTH, STRESS = chr(0x306), chr(0x200B), chr(0x301)


def canonical(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, canonical_text string")
    return {r["id"]: r["canonical_text"] for r in lookalikes.canonical_texts(df, "text", **kw).collect()}


def test_canonical_forms(spark):
    plain = ["на складе а также в городе", "на складе оценка АО", "товар Limmas R5 и сайт cookie", "the act of a buyer", None, "", "сбор и отчёт"]
    dirty = ["нa скла" + ZERO_WIDTH + "де a также", "товар Lіmmаs", "AO оценкa", "сбор" + chr(0xA0) + "и" + chr(0x3000) + "ＡＢ１", "оценка отчe" + chr(0x308) + "т", "скла" + STRESS + "де", "сооkіе", "и" + BREVE + "од"]
    got = canonical(spark, plain + dirty)
    n = len(plain)
    assert [got[i] for i in range(n)] == plain
    assert [got[n + i] for i in range(len(dirty))] == ["на складе а также", "товар Limmas", "АО оценка", "сбор и AB1", "оценка отчёт", "скла" + STRESS + "де", "cookie", chr(0x439) + "од"]
    assert set(canonical(spark, plain + dirty, changed_only=True)) == {n, n + 1, n + 2, n + 3, n + 4, n + 6, n + 7}
    assert canonical(spark, []) == {}


def test_trie_reaches_by_twins_only():
    trie = lookalikes.Trie()
    for w, c in (("склад", 5), ("скад", 1), ("Ha", 1), ("На", 9)):
        trie.add(w, c)
    assert [w for _, _, w in trie.reach("cклaд")] == ["склад"]
    assert [w for _, _, w in trie.reach("Ha")] == ["На", "Ha"]
    assert {w for _, _, w in trie.reach("склад", budget=1)} == {"склад", "скад"}
    assert trie.reach("слад") == []


def test_strange_letters_cost_little_and_other_edits_too_much(spark):
    alpha = chr(0x251)
    trie = lookalikes.Trie()
    for w, c in (("склад", 50), ("слад", 9), ("каз", 3), ("киз", 2)):
        trie.add(w, c)
    assert [w for _, _, w in trie.reach("скл" + alpha + "д", lookalikes.BUDGET)] == ["склад"] and trie.reach("сквад", lookalikes.BUDGET) == []
    assert lookalikes.spell("к" + alpha + "з", trie, 1)[0] == "к" + alpha + "з"
    plain = ["поставка на склад по договору"] * 8 + ["нечто ещё"]
    dirty = ["пост" + alpha + "вка на скл" + alpha + "д", "скл" + alpha + "дище", "Müller и λόγος"]
    got = canonical(spark, plain + dirty)
    assert [got[len(plain) + i] for i in range(3)] == ["поставка на склад", dirty[1], dirty[2]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="абв .,;\n!АБ" + STRESS, max_size=400), st.integers(5, 60), st.integers(0, 70))
def test_pieces_rebuild_the_text(text, limit, overlap):
    pieces = splitting.cuts(text, limit, overlap)
    own = min(overlap, limit - 1)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b in pieces)
    assert all(y[0] == x[1] - own and y[1] > x[1] for x, y in zip(pieces, pieces[1:]))
    assert text[: pieces[0][1]] + "".join(text[x[1] : y[1]] for x, y in zip(pieces, pieces[1:])) == text


def test_pieces_end_at_the_topic_change():
    a = "Кошки любят молоко. Кошки пьют молоко утром. Кошки спят. "
    b = "Трактор пашет поле. Трактор везёт зерно. Поле большое. "
    text = a + b
    assert splitting.cuts(text, 100, 0)[0] == (0, len(a))


def test_valleys_by_walking_outwards_and_in_linear_time():
    rng = random.Random(9)
    text = " ".join(rng.choice(["Кошки пьют молоко.", "Трактор пашет поле.", "Поле и кошки.", "Снег."]) for _ in range(300))
    ends, depths = splitting._valleys(text)
    for k in rng.sample(range(len(ends)), 60):
        words, starts = [m[0].lower()[:6] for m in splitting._WORD.finditer(text)], [m.start() for m in splitting._WORD.finditer(text)]

        def cohesion(at):
            i = sum(s < ends[at] for s in starts)
            a, b = Counter(words[max(0, i - 40) : i]), Counter(words[i : i + 40])
            norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
            return sum(v * b[w] for w, v in a.items()) / norm if norm else 0.0

        depth = 0.0
        for step in (-1, 1):
            here, at = cohesion(k), k
            while 0 <= at + step < len(ends) and cohesion(at + step) >= here:
                at += step
                here = cohesion(at)
            depth += here - cohesion(k)
        assert abs(depth - depths[k]) < 1e-9
    table = "Строка таблицы номер один. " * 40_000
    began = time.time()
    assert len(splitting.cuts(table, 700, 100)) > 1000
    assert time.time() - began < 20


def test_split_rows(spark):
    rows = [("a", "слово " * 50, 7, 1), ("b", None, 0, 1), ("c", "", 0, 1), ("d", "коротко", 0, 1), ("e", "ы" * 90, None, 1), ("e", "ы" * 90, None, 1)]
    df = spark.createDataFrame(rows, "id string, t string, at int, piece int")
    got = splitting.split_texts(df, "id", "t", [(40, 5), (80, 0)], "at").collect()
    assert {r["id"] for r in got} == {"a", "e"} and all(len(r["piece"]) == r["char_end"] - r["char_start"] <= r["max_chunk"] for r in got)
    assert min(r["char_start"] for r in got if r["id"] == "a") == 7 and sum(r["id"] == "e" and r["max_chunk"] == 80 for r in got) == 4
    assert splitting.split_texts(df.limit(0), "id", "t", [(40, 5)]).count() == 0 and splitting.split_texts(df, "id", "t", []).count() == 0


PEOPLE = "Жалобу подала Иванова-Петрова Анна Львовна, ПЕТРОВ И. И. и О. П. Сидорова; Oleg Ivanov и Петру Кузнецову отказано."


def kinds(text):
    return [(k, text[a:b]) for k, a, b in personal.find(text)]


def test_personal_data():
    assert kinds(PEOPLE) == [("PERSON", "Иванова-Петрова Анна Львовна"), ("PERSON", "ПЕТРОВ И. И."), ("PERSON", "О. П. Сидорова"), ("PERSON", "Oleg Ivanov"), ("PERSON", "Петру Кузнецову")]
    text = "Связь: a.b (at) firm (dot) test, +7 (912) 345–67–89; живёт: 012345, г. Новый, ул. Малая, д. 5/1, кв. 7; паспорт 45 06 № 123456."
    assert kinds(text) == [("EMAIL", "a.b (at) firm (dot) test"), ("PHONE", "+7 (912) 345–67–89"), ("ADDRESS", "012345, г. Новый, ул. Малая, д. 5/1, кв. 7"), ("PASSPORT", "45 06 № 123456")]
    nine, ten = "112233445", "5001007322"
    assert kinds(f"СНИЛС 112-233-445 {personal.snils_check(nine)}, ИНН {ten}{personal.tax_check(ten)}") == [("SNILS", f"112-233-445 {personal.snils_check(nine)}"), ("TAX_ID", ten + personal.tax_check(ten))]
    assert kinds("Диапазон 8-590-178 мм, цена 8 300 141,45 руб., извещение № 0192835012537997147, отбор @ 44 единиц, статья 5.") == []
    hidden = "тел. +7" + ZERO_WIDTH + " 912 345 67 89"
    assert kinds(hidden) == [("PHONE", hidden[5:])]
    assert kinds("Почта p.ivan" + chr(0xFF20) + "mail.test.")[0] == ("EMAIL", "p.ivan" + chr(0xFF20) + "mail.test")


def test_feistel_is_a_permutation_and_keeps_formats():
    for n in (1, 2, 3):
        assert len({personal.permute(f"{i:0{n}d}", b"k") for i in range(10**n)}) == 10**n
    snils = "112-233-445 " + personal.snils_check("112233445")
    out = personal.pseudonym("SNILS", snils, b"k")
    digits = out.replace("-", "").replace(" ", "")
    assert out[3] == "-" and digits[9:] == personal.snils_check(digits[:9]) and out == personal.pseudonym("SNILS", snils, b"k")
    assert personal.pseudonym("PERSON", "Кузнецов Пётр", b"k") == personal.pseudonym("PERSON", "Петру Кузнецову", b"k")


def test_names_by_shape_and_context():
    text = "Позвонил Тагир Хабибуллин, их встретил Азат Мингазов; Гульнара Садыкова; Смит Джон"
    assert [v for _, v in kinds(text)] == ["Тагир Хабибуллин", "Азат Мингазов", "Гульнара Садыкова", "Смит Джон"]
    assert kinds("Город Саратов, Московский Никитин двор, завод «Пермь Иванов», ул. Тагир Никитин, Жалоба Петров") == []


def test_pseudonyms_are_injective_and_keyed():
    rng = random.Random(3)
    for kind, own, check in (("SNILS", 9, personal.snils_check), ("TAX_ID", 10, personal.tax_check)):
        values = set()
        for _ in range(400):
            head = f"{rng.randrange(10**own):0{own}d}"
            values |= {head + check(head), *(head + f"{rng.randrange(100):02d}" for _ in range(4))}
        made = {v: personal.pseudonym(kind, v, b"k") for v in values}
        assert len(set(made.values())) == len(values)
        assert all((check(v[:own]) == v[own:]) == (check(p[:own]) == p[own:]) for v, p in made.items())
    days = {f"{d:02d}.{m:02d}.{y}" for d in range(1, 29) for m in range(1, 13) for y in range(1960, 1975)}
    assert len({personal.pseudonym("BIRTH_DATE", d, b"k") for d in days}) == len(days)
    assert personal.pseudonym("PHONE", "+7 (912) 345-67-89", b"k")[2:] == personal.pseudonym("PHONE", "8 (912) 345-67-89", b"k")[1:]
    assert personal.pseudonym("PASSPORT", "4506123456", b"k") != personal.pseudonym("PASSPORT", "4506123456", b"other")
    assert len(personal.pseudonym("PERSON", "Иванов И. И.", b"k")) == 32
    out = personal.redact("Дата рождения: 05.11.1980, протокол от 05.11.2019.", b"k")
    assert re.fullmatch(r"Дата рождения: \[BIRTH_DATE:\d\d\.\d\d\.\d{4}\], протокол от 05\.11\.2019\.", out) and "05.11.1980" not in out


def test_redaction_changes_nothing_else(spark):
    df = spark.createDataFrame([(1, PEOPLE, "q"), (2, None, "q"), (3, "", "q")], "id int, text string, kind string")
    got = {r["id"]: r["redacted"] for r in personal.redacted(df, "text", "key").collect()}
    assert got[2] is None and got[3] == "" and got[1].startswith("Жалобу подала [PERSON:") and got[1].endswith("] отказано.")
    assert personal.personal_data(df, "text").count() == 5 and personal.personal_data(df.limit(0), "text").count() == 0


def pages(n=60, kind=lambda k: k):
    rng, rows = random.Random(3), []
    kinds_ = ["chapter_title", "body", "body", "body", "other", "other", "other", None]
    for p in range(n):
        frame = ["Главная  Новости  Поиск", f"Читайте также: Статья про {p}", "© «Фирма». Все права защищены."]
        body = [f"Обзор номер {p}", f"Первый абзац {rng.random()} о деле. Он длинный.", "Решила: признать жалобу обоснованной, дело " + rng.choice("абвгдежз") * 9 + "."]
        for k, (t, main) in enumerate([(frame[0], 0), (body[0], 1), (body[1], 1), (frame[1], 0), (body[2], 1), (frame[2], 0)]):
            own = rng.choice(kinds_) if not main else "chapter_title" if k == 1 else "body"
            rows.append((f"{p:02d}-{k}", p, kind(own), t, main, 0.0))
    return rows


def judged(spark, rows):
    df = spark.createDataFrame(rows, "block_id string, page_id int, kind string, text string, main int, importance double")
    sites = spark.createDataFrame([(p, f"site{p % 2}", "x") for p in range(60)], "page_id int, site string, kind string")
    return {r["block_id"]: r for r in boilerplate.judged_blocks(df, "block_id", "page_id", "kind", "text", sites, "site").collect()}, df, sites


def test_frame_of_pages(spark):
    rows = pages() + [("n", None, None, None, 0, 0.0), ("e", 1, "body", "", 0, 0.0), ("e", 1, "body", "", 0, 0.0), ("x", 99, "body", "Второй абзац о деле. Он короткий.", 1, 0.0)]
    got, df, sites = judged(spark, rows)
    assert len(got) == len(rows) - 1 and all(got[r[0]]["is_frame"] == (r[4] == 0) for r in rows)
    assert boilerplate.judged_blocks(df.limit(0), "block_id", "page_id", "kind", "text", sites, "site").count() == 0


def test_frame_without_kinds_and_in_a_block_seen_once(spark):
    for kind in (None, "body"):
        rows = pages(kind=lambda k, kind=kind: kind)
        got, _, _ = judged(spark, rows)
        # What stands on all pages of a host goes, what stands on one stays, headings too.
        assert all(got[r[0]]["is_frame"] for r in rows if r[3].startswith(("Главная", "©")))
        assert not any(got[r[0]]["is_frame"] for r in rows if r[4] == 1)
    # A block seen once is judged by its style and its own label; frame and body in the styles that the others taught.
    once = [("o1", 1, "other", "Смотрите тоже: Новый разбор 5", 0, 0.0), ("o2", 1, "body", "Суд отложил дело. Стороны мирились. Срок вышел в мае.", 1, 0.0)]
    got, _, _ = judged(spark, pages() + once)
    assert got["o1"]["is_frame"] and not got["o2"]["is_frame"]


def test_genetic_search_beats_best_fit_on_triplets():
    for seed in range(3):
        rng, sizes = random.Random(seed), []
        for _ in range(20):
            a = rng.randint(380, 490)
            b = rng.randint(250, max(250, (1000 - a) // 2))
            sizes += [a, b, 1000 - a - b]
        rng.shuffle(sizes)
        plain = packing.best_fit(packing.Packing([], []), sorted(range(60), key=lambda p: -sizes[p]), sizes, 1000)
        codes = packing.evolve(sizes, 1000, seed, [])
        loads = packing._from_codes(codes, sizes).loads
        assert max(loads) <= 1000 and sum(loads) == sum(sizes) and len(loads) <= len(plain.bins) - 2


def test_a_full_group_is_searched_to_the_end(monkeypatch):
    # A thousand pieces are searched for as many generations as sixty, unless the bound is met.
    crossings, crossover = [], packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: crossings.append(1) or crossover(*a))
    for seed, saved in ((0, 1), (3, 2)):
        rng = random.Random(seed)
        sizes = [int(rng.lognormvariate(5.65, 0.7)) % 512 for _ in range(1000)]
        plain = packing.best_fit(packing.Packing([], []), sorted(range(1000), key=lambda p: -sizes[p]), sizes, 512)
        crossings.clear()
        loads = packing._from_codes(packing.evolve(sizes, 512, seed, []), sizes).loads
        assert max(loads) <= 512 and sum(loads) == sum(sizes) and len(loads) <= len(plain.bins) - saved
        assert len(crossings) == 200 * packing.POPULATION // 2


def test_one_container_of_hundreds_is_saved():
    # Best fit puts 400 beside 400; the bound is one container below it, and is met.
    sizes = [500] * 700 + [400] * 2 + [300] * 4
    assert len(packing.best_fit(packing.Packing([], []), list(range(706)), sizes, 1000).bins) == 353
    assert max(packing.evolve(sizes, 1000, 0, [])) + 1 == 352


def test_as_many_exchanges_as_there_are():
    # Each of a hundred containers gets full by one exchange.
    held = packing.Packing([[i] for i in range(100)], [90] * 100)
    sizes = [90] * 100 + [100] * 100
    assert [sizes[p] for p in packing.exchange(held, list(range(100, 200)), sizes, 100)] == [90] * 100
    assert held.loads == [100] * 100


def test_a_full_group_is_searched_with_few_calls():
    # All generations of a thousand pieces took 1,160,000 calls when each crossing looked at all containers.
    for seed in (0, 3):
        rng, calls = random.Random(seed), [0]
        sizes = [int(rng.lognormvariate(5.65, 0.7)) % 512 for _ in range(1000)]

        def count(_, event, __, calls=calls):
            calls[0] += event in ("call", "c_call")

        before = sys.getprofile()
        sys.setprofile(count)
        try:
            packing.evolve(sizes, 512, seed, [])
        finally:
            sys.setprofile(before)
        assert calls[0] < 700_000


def test_search_meets_a_bound_that_exchanges_missed():
    rng = random.Random(7)
    sizes = [int(rng.lognormvariate(5.65, 0.9)) % 1024 for _ in range(300)]
    codes = packing.evolve(sizes, 1024, 7, [], generations=60)
    assert max(packing._from_codes(codes, sizes).loads) <= 1024
    assert max(codes) + 1 == packing.least_containers(sizes, 1024)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=9), st.integers(20, 30))
def test_each_container_is_as_full_as_the_pieces_left_can_make_it(sizes, capacity):
    filled = packing.fill(packing.Packing([[len(sizes)]], [capacity]), list(range(len(sizes))), [*sizes, capacity], capacity)
    assert sorted(p for b in filled.bins for p in b) == list(range(len(sizes) + 1))
    # In the order in which they were filled.
    own = sorted((sorted(sizes[p] for p in b if sizes[p]) for b in filled.bins if len(sizes) not in b), key=lambda b: (b[-1], sum(b)), reverse=True)
    left = sorted(x for x in sizes if x)
    for b in own:
        assert b[-1] == left[-1]
        sums = {left[-1]}
        for x in left[:-1]:
            sums |= {s + x for s in sums if s + x <= capacity}
        assert sum(b) == max(sums)
        for x in b:
            left.remove(x)
    assert not left


def test_large_containers_are_filled_in_units():
    # Sums are bits: a billion of them for each piece would take gigabytes.
    rng = random.Random(1)
    for capacity in (131_073, 10**9):
        sizes = [rng.randint(1, capacity) for _ in range(60)]
        filled = packing.fill(packing.Packing([], []), list(range(60)), sizes, capacity)
        assert sorted(p for b in filled.bins for p in b) == list(range(60))
        assert filled.loads == [sum(sizes[p] for p in b) for b in filled.bins] and max(filled.loads) <= capacity
        assert len(filled.bins) <= len(packing.best_fit(packing.Packing([], []), list(range(60)), sizes, capacity).bins)


def fewest(sizes, capacity):
    """Containers of an optimal filling, by trying all."""
    best = [len(sizes)]

    def place(i, loads):
        if len(loads) < best[0]:
            if i == len(sizes):
                best[0] = len(loads)
            else:
                for b in range(len(loads)):
                    if loads[b] + sizes[i] <= capacity:
                        place(i + 1, [*loads[:b], loads[b] + sizes[i], *loads[b + 1 :]])
                place(i + 1, [*loads, sizes[i]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=8), st.integers(20, 30))
def test_bound_and_settled_pieces_keep_the_optimum(sizes, capacity):
    best = fewest(sorted(sizes, reverse=True), capacity)
    assert packing.least_containers(sizes, capacity) <= best
    done, left = packing.settled(sizes, capacity)
    assert sorted([*left, *(p for b in done for p in b)]) == list(range(len(sizes)))
    assert all(sum(sizes[p] for p in b) <= capacity for b in done)
    # (pieces without size need no container of their own where there is another)
    rest = [sizes[p] for p in left]
    assert len(done) + fewest(sorted(rest, reverse=True) if any(rest) or not done else [], capacity) == best
    codes = packing.evolve(sizes, capacity, 1, [], generations=5)
    loads = packing._from_codes(codes, sizes).loads
    assert sorted(set(codes)) == list(range(len(loads))) and max(loads, default=0) <= capacity and sum(loads) == sum(sizes) and len(loads) >= best
    again = packing.evolve(sizes, capacity, 2, [codes], generations=5)
    assert len(set(again)) <= len(loads)


def test_containers(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 3, 40, 55, 60, 100, 130, 350]), "x") for i in range(300)] + [(300, None, "x"), (301, -4, "x"), (1, 5, "x")]
    df = spark.createDataFrame(rows, "id int, n int, container string")
    got = packing.containers(df, "id", "n", [100, 256], group=100).collect()
    for c in (100, 256):
        loads, pieces = {}, {}
        for r in got:
            if r["capacity"] == c:
                loads[r["container"]] = loads.get(r["container"], 0) + r["token_end"] - r["token_start"]
                pieces.setdefault(r["id"], []).append((r["part_no"], r["token_start"], r["token_end"]))
        assert max(loads.values()) <= c and len(pieces) == 302
        for i, n, _ in rows[2:300]:
            p = sorted(pieces[i])
            assert p[-1][2] == n and (len(p) == 1 or n > c) and all(a[2] == b[1] for a, b in zip(p, p[1:]))
        total = sum(loads.values())
        assert len(loads) <= 1.1 * total / c + 2
    assert packing.containers(df.limit(0), "id", "n", [100]).count() == 0


def test_crossover_keeps_every_piece_once():
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(200)]
    a, b = (packing.best_fit(packing.Packing([], []), rng.sample(range(200), 200), sizes, 100) for _ in range(2))
    for child in (packing.crossover(a, b, sizes, 100, rng), packing.mutate(a, sizes, 100, rng)):
        assert sorted(p for x in child.bins for p in x) == list(range(200))
        assert all(sum(sizes[p] for p in x) == n <= 100 for x, n in zip(child.bins, child.loads))


def test_token_counts(spark):
    import pytest

    public_tokenizers = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "Закупка товара"), (2, ""), (3, None), (4, "<|endoftext|>")], "id int, t string")
    got = {r["id"]: r["n_tokens"] for r in packing.token_counts(df, "id", "t", str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN).collect()}
    assert got[2] == got[3] == 0 and got[1] > 2 and got[4] > 1
    assert F is not None
