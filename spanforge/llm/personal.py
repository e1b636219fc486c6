"""Personal data in free text: found, and replaced by typed placeholders with format-preserving pseudonyms.

Numbers and dates of birth are validated (check digits, calendar, lengths, the words around) and permuted within their format by a
keyed Feistel network: a pseudonym has the format of its value and valid check digits exactly where the value has them,
different values get different pseudonyms, and equal values equal ones in all documents.  Names, addresses and mail
addresses get a keyed 128-bit tag of their normal form, so that a name in another grammatical case stays linked.

Names are told by patronymics, initials, the shape and agreement of first name and surname, and by what stands around them;
a list of first names only lets a pair pass whose surname has no telling shape beside it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import lookalike as L

KINDS = ("EMAIL", "SNILS", "TAX_ID", "PASSPORT", "PHONE", "ADDRESS", "PERSON")

# Common first names; their case forms follow by rule.
FIRST_NAMES = """
Александр Алексей Анатолий Андрей Антон Аркадий Арсений Артём Артур Богдан Борис Вадим Валентин Валерий Василий Виктор
Виталий Владимир Владислав Всеволод Вячеслав Геннадий Георгий Герман Глеб Григорий Даниил Данила Денис Дмитрий Евгений
Егор Захар Иван Игорь Илья Кирилл Константин Лев Леонид Лука Максим Марат Марк Матвей Михаил Никита Николай Олег Павел
Пётр Роман Руслан Рустам Савелий Семён Сергей Станислав Степан Тарас Тимофей Тимур Фёдор Филипп Эдуард Юлиан Юрий Яков
Ярослав Алина Алиса Алла Анастасия Ангелина Анна Антонина Валентина Валерия Варвара Василиса Вера Вероника Виктория Галина
Дарья Диана Ева Евгения Екатерина Елена Елизавета Жанна Зинаида Зоя Инна Ирина Карина Кира Клавдия Кристина Ксения Лариса
Лидия Лилия Любовь Людмила Маргарита Марина Мария Милана Надежда Наталья Наталия Нина Оксана Ольга Полина Раиса Регина
Светлана София Софья Таисия Тамара Татьяна Ульяна Юлия Яна
""".split()

# Latin spelling of Cyrillic letters in names.
_LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", ("a", "b", "v", "g", "d", "e", "e", "zh", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "", "y", "", "e", "yu", "ya")))


def _forms(name: str) -> set[str]:
    """The name in all cases, lower case, with and without the dots of ё."""
    n = name.lower()
    if n == "лев":
        out = {n, "льва", "льву", "львом", "льве"}
    elif n == "любовь":
        out = {n, "любови", "любовью"}
    elif n == "павел":
        out = {n, *(f"павл{x}" for x in ("а", "у", "ом", "е"))}
    elif n == "пётр":
        out = {n, *(f"петр{x}" for x in ("а", "у", "ом", "е"))}
    elif n[-1] in "йь":
        out = {n, *(n[:-1] + x for x in ("я", "ю", "ем", "е", "и", "ём"))}
    elif n[-1] == "а":
        out = {n, *(n[:-1] + x for x in ("ы", "и", "е", "у", "ой", "ою", "ей"))}
    elif n[-1] == "я":
        out = {n, *(n[:-1] + x for x in ("и", "е", "ю", "ей", "ею", "ёй"))}
    else:
        out = {n, *(n + x for x in ("а", "у", "ом", "е"))}
    return out | {x.replace("ё", "е") for x in out}


_FIRST = frozenset(x for n in FIRST_NAMES for x in _forms(n))
_FIRST_LATIN = frozenset(y for n in FIRST_NAMES for x in [n.lower(), n.lower().replace("ий", "ы"), n.lower().replace("ё", "ио")] for y in ["".join(_LATIN[c] for c in x), "".join(_LATIN[c] for c in x).replace("iy", "y").replace("ya", "ia")])

_C = "[А-ЯЁа-яё]"
_SEP = r"\s+"
_PATRONYMIC = rf"{_C}{{2,}}(?:(?:ов|ев|ёв|ь)ич(?:а|у|ем|ом|е)?|(?:ов|ев|ёв)н(?:а|ы|е|у|ой|ою)|инич?н(?:а|ы|е|у|ой)|ичн(?:а|ы|е|у|ой)|(?:Ил|Лук|Фом|Кузьм|Савв)ич(?:а|у|ем|е)?)"
_SURNAME_END = r"(?:ов|ев|ёв|ин|ын)(?:а|у|ым|ом|е|ой|ою|ую|ы)?|[сц]к(?:ий|ого|ому|им|ом|ая|ой|ую)|(?:енко|ко|юк|ук|ян|дзе|швили|ых|их)"
_SURNAME = rf"(?:{_C}{{2,}}-)?{_C}{{1,}}(?:{_SURNAME_END})(?:-{_C}{{2,}})?"
_WORD = rf"{_C}{{2,}}"
_EDGE, _END = r"(?<![\w-])", r"(?![\w-])"
_I = r"[А-ЯЁ]\."

_BY_PATRONYMIC = re.compile(rf"{_EDGE}(?:(?P<before>{_SURNAME}){_SEP})?(?P<first>{_WORD}){_SEP}(?P<pat>{_PATRONYMIC}){_END}(?:{_SEP}(?P<after>{_SURNAME}){_END})?", re.I)
_SURNAME_INITIALS = re.compile(rf"{_EDGE}(?P<name>[А-ЯЁ](?:[а-яё]+|[А-ЯЁ]+)(?:-[А-ЯЁ](?:[а-яё]+|[А-ЯЁ]+))?){_SEP}{_I}\s?{_I}")
_INITIALS_SURNAME = re.compile(rf"(?<![\w.-]){_I}\s?{_I}\s?(?P<name>[А-ЯЁ](?:[а-яё]+|[А-ЯЁ]+)(?:-[А-ЯЁ](?:[а-яё]+|[А-ЯЁ]+))?){_END}")
_PAIR = re.compile(rf"{_EDGE}(?=(?P<a>[А-ЯЁ]{_C}+(?:-[А-ЯЁ]{_C}+)?){_SEP}(?P<b>[А-ЯЁ]{_C}+(?:-[А-ЯЁ]{_C}+)?){_END})")
_IS_SURNAME = re.compile(_SURNAME, re.I)
_TITLED = re.compile(r"(?<![\w-])(?:гр(?:ажданин\w*|ажданк\w+|\.)|г-н\w*|г-ж\w+|господин\w*|госпож\w+)\s+(?=(?P<a>[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?)\s+(?P<b>[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?)(?![\w-]))", re.I)
# Surnames that are no adjectives; the shape of a first name of either sex in its cases.
_OWN_SURNAME = re.compile(r"[А-ЯЁ][а-яё]{1,}(?:ов|ев|ёв|ин|ын)(?P<f>а|ой|ою)?(?:у|ым|ом|е)?|[А-ЯЁ][а-яё]{2,}(?:енко|дзе|швили|ян|янц)")
_FEMALE_FIRST, _MALE_FIRST = re.compile(r"[А-ЯЁ][а-яё]{2,}(?:а|я|ы|и|е|у|ю|ой|ей)"), re.compile(r"[А-ЯЁ][а-яё]+(?:[бвгджзйклмнпрстфх]|[бвгджзклмнпрстфх](?:а|у|ом|е)|ь|ья)")
#: Words that stand with a capital but name no person: their endings, and the first of a sentence.
_NO_NAME = re.compile(r"(?:ий|ый|ой|ая|яя|ое|ее|ые|ие|ого|его|ому|ему|ых|их|ым|им|ую|юю|ость|ости|ание|ания|ение|ения|ция|ции|тель|теля|ство|ства|ила|ыла|ала|ела|али|или|ели|ил|ыл|ял|ует|ает|ит|ся|сь|ции|изм|ник|ика|щик|лись|ован|ана|ено|ано|ены|аны)$", re.I)
_NOT_FIRST = frozenset("город города улица область край район посёлок село республика завод фонд банк группа компания общество суд закон приказ акт лот этап раздел пункт часть статья глава отдел отдела центр рынок дом парк театр музей остров озеро река станция метро склад проект договор контракт заказ".split())
_LATIN_PAIR = re.compile(r"(?<![\w.@-])(?=(?P<a>[A-Z][A-Za-z]+)\s+(?P<b>[A-Z][A-Za-z]+(?:-[A-Z][A-Za-z]+)?)(?![\w@]))")
_LATIN_SURNAME = re.compile(r"(?:\w+-)?\w+(?:ov|ova|ev|eva|yov|in|ina|yn|yna|sky|skiy|skaya|enko|uk|yuk|ko|yan)(?:-\w+)?", re.I)

_AT = r"\s*(?:@|\(at\)|\[at\]|\(собака\)|\[собака\]|(?<=\s)(?:собака|at)(?=\s))\s*"
_DOT = r"(?:\.|\s*(?:\(dot\)|\[dot\]|\(точка\)|\[точка\]|(?<=\s)(?:точка|dot)(?=\s))\s*)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._+-])[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?(?:\s*(?:\(dot\)|\(точка\))\s*[A-Za-z0-9_+-]+)*{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+", re.I)
_S = r"[ \t\n.–—-]"
_PHONE = re.compile(rf"(?<![\d.,/+-])(?<!№)(?<!№ )(?:\+\s?\d{{1,2}}{_S}{{0,2}}|[78]{_S}{{0,2}})\(?\d{{3}}\)?{_S}{{0,3}}\d{{3}}{_S}{{0,3}}\d{{2}}{_S}{{0,3}}\d{{2}}(?![\d/])|\(\d{{3}}\){_S}{{0,2}}\d{{3}}{_S}{{0,2}}\d{{2}}{_S}{{0,2}}\d{{2}}(?![\d/])")
_SNILS = re.compile(r"(?<![\d.,/-])\d{3}[ \n–-]{0,2}\d{3}[ \n–-]{0,2}\d{3}[ \n–-]{0,2}\d{2}(?![\d/])")
_TAX = re.compile(r"(?<![\d.,/-])\d{12}(?![\d/])|(?<![\d.,/-])\d{4}[ \n-]\d{4}[ \n-]\d{4}(?![\d/]| \d)|(?<![\d.,/-])\d{2}[ \n-]\d{2}[ \n-]\d{6}[ \n-]\d{2}(?![\d/])")
_PASSPORT = re.compile(r"(?<![\d.,/-])\d{2}[ \n]?\d{2}[ \n]{0,2}(?:№|N|номер)?[ \n]{0,2}\d{6}(?![\d/])", re.I)
_BIRTH = re.compile(r"(?<![\d.])(\d{2})[./](\d{2})[./](\d{4})(?!\d)")
_BIRTH_WORDS, _BORN_AFTER = re.compile(r"(?:рожд\w*|родил\w*)[^\d.;]{0,12}$", re.I), re.compile(r"\s*(?:г\.?\s*р\b|года? рожд)", re.I)
_PASSPORT_WORDS = re.compile(r"паспорт|документ|сери[ияюей]|удостоверени|личност", re.I)
_SNILS_WORDS = re.compile(r"снилс|страхов", re.I)
_TAX_WORDS = re.compile(r"инн|налогоплат|идентификационн", re.I)
_UNIT_AFTER = re.compile(r"\s*(?:,\d\d\b|руб|мм\b|шт\b|кг\b|%)", re.I)

_NAME = rf"[А-ЯЁ]{_C}+(?:[- ][А-ЯЁ]{_C}+)?"
_CITY = rf"(?:г\.|гор\.|город|пос\.|посёлок|поселок|пгт\.?|с\.|село|дер\.|деревня|ст-ца|станица|хутор|х\.)\s*{_NAME}"
_STREET = rf"(?:(?:ул\.|улица|пр-кт|пр\.|просп\.|проспект|пер\.|переулок|ш\.|шоссе|наб\.|набережная|б-р|бульвар|пл\.|площадь|проезд|пр-д|мкр\.?|микрорайон|тупик|аллея|линия)\s*(?:\d+-?[а-я]*\s)?{_NAME}|{_NAME}\s(?:улица|ул\.|проспект|пр-кт|переулок|пер\.|шоссе|бульвар|площадь))"
_REGION = rf"(?:{_C}+(?:ая|ой)\s(?:область|обл\.|области)|{_C}+(?:ий|ого)\s(?:край|края|район|р-н|района)|Республика\s{_NAME})"
_HOUSE = r"(?:д\.|дом|вл\.|владение|уч\.)?\s*\d+[а-яА-Я]?(?:[/-]\d+[а-яА-Я]?)?(?![/-]?\d)"
_REST = r"(?:(?:корп\.|корпус|к\.|стр\.|строение|литера|лит\.|кв\.|квартира|оф\.|офис|пом\.|помещение|ком\.|комната|под\.|подъезд|эт\.|этаж)\s*(?:[а-яА-Я]\b|\d+[а-яА-Я]?(?:[/-]\d+)?))"
_ADDRESS = re.compile(rf"(?<![\w-])(?:\d{{6}},?\s+)?(?:{_REGION},?\s+)*(?:{_CITY},?\s+)?{_STREET},?\s+{_HOUSE}(?:,?\s+{_REST})*", re.I)


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def snils_check(nine: str) -> str:
    return f"{sum(int(d) * (9 - i) for i, d in enumerate(nine)) % 101 % 100:02d}"


def tax_check(ten: str) -> str:
    # The weights of the two check digits of a person's number.
    a = sum(w * int(d) for w, d in zip((7, 2, 4, 10, 3, 5, 9, 4, 6, 8), ten)) % 11 % 10
    b = sum(w * int(d) for w, d in zip((3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8), ten + str(a))) % 11 % 10
    return f"{a}{b}"


def _plain(text: str) -> tuple[str, list[int] | None]:
    """The text with ordinary characters, and the place of each in the original (None: the same places)."""
    if text.isascii() or not _ODD.search(text):
        return text, None
    out, places = [], []
    for i, c in enumerate(text):
        if c in L.INVISIBLE or 0x300 <= ord(c) <= 0x36F:
            if c in (L.BREVE, L.DIAERESIS) and out:
                out[-1] = L.COMPOSED.get(L.skeleton_text(out[-1]) + c, out[-1])
            continue
        out.append(L.PLAIN.get(c, c))
        places.append(i)
    plain = re.sub(r"\w+", lambda m: m[0] if m[0].isascii() else L.one_script(m[0]), "".join(out))
    return plain, places


_ODD = re.compile("[" + re.escape("".join(L.PLAIN)) + f"{chr(0x300)}-{chr(0x36F)}{chr(0x370)}-{chr(0x3FF)}{re.escape(L.FOREIGN_CYRILLIC)}]|[A-Za-z][А-я]|[А-я][A-Za-z]")


def _named(first: str, last: str, text: str, at: int) -> bool:
    """Whether two capitalised words are a first name and a surname by their shapes, which agree in sex."""
    if not (shape := _OWN_SURNAME.fullmatch(last)) or first.lower() in _NOT_FIRST or len(last) < 4 or _NO_NAME.search(first):
        return False
    if first.lower() in _FIRST or _OWN_SURNAME.fullmatch(first):
        return False
    # (a quoted name, or one after the mark of a place, is none of a person)
    if text[at - 1 : at] in ("«", '"', "“") or _PLACE_BEFORE.search(text, max(0, at - 16), at):
        return False
    female = shape["f"] or last[-1] in "ау" and last[-3:-1] in ("ов", "ев", "ёв", "ин", "ын") and first[-1] in "ауяюые"
    if not female and (last[-1] in "вн") != (first[-1] not in "ауеяюом"):
        return False  # one of them stands in another case
    return bool((_FEMALE_FIRST if female else _MALE_FIRST).fullmatch(first))


def _listed(text: str, found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Pairs of capitalised words that fill an item of a list next to a person."""
    for a, b in found:
        if m := _NEXT_ITEM.match(text, b):
            yield m.span(1)
        if m := _ITEM_BEFORE.search(text, max(0, a - 60), a):
            yield m.span(1)


_PLACE_BEFORE = re.compile(r"(?:ул|г|пр|пер|пос|с|д|им|имени|улиц\w|город\w?|площад\w|проспект\w?)\.?\s*$", re.I)
_CAPITALISED = r"[А-ЯЁ][а-яё]{2,}"
_NEXT_ITEM = re.compile(rf";\s+({_CAPITALISED}\s{_CAPITALISED})(?=\s*(?:[;.)]|$))")
_ITEM_BEFORE = re.compile(rf"(?:[:;]\s+)({_CAPITALISED}\s{_CAPITALISED});\s+$")


def _persons(text: str) -> Iterator[tuple[int, int]]:
    for m in _BY_PATRONYMIC.finditer(text):
        first = m["first"]
        if not first[0].isupper() or not m["pat"][0].isupper():
            continue
        start, end = m.start("first"), m.end("pat")
        if m["before"] and m["before"][0].isupper():
            start = m.start("before")
        elif m["after"] and m["after"][0].isupper():
            end = m.end("after")
        yield start, end
    for m in _SURNAME_INITIALS.finditer(text):
        yield m.span()
    for m in _INITIALS_SURNAME.finditer(text):
        yield m.span()
    for m in _PAIR.finditer(text):
        a, b = m["a"].lower(), m["b"].lower()
        if a in _FIRST and _IS_SURNAME.fullmatch(b) or b in _FIRST and _IS_SURNAME.fullmatch(a):
            yield m.start("a"), m.end("b")
        elif _named(m["a"], m["b"], text, m.start("a")) or _named(m["b"], m["a"], text, m.start("a")):
            yield m.start("a"), m.end("b")
    for m in _TITLED.finditer(text):
        if m["a"][0].isupper() and m["b"][0].isupper() and m["a"].lower() not in _NOT_FIRST:
            yield m.start("a"), m.end("b")
    for m in _LATIN_PAIR.finditer(text):
        a, b = m["a"].lower(), m["b"].lower()
        if a in _FIRST_LATIN and _LATIN_SURNAME.fullmatch(b) or b in _FIRST_LATIN and _LATIN_SURNAME.fullmatch(a):
            yield m.start("a"), m.end("b")


def _candidates(text: str) -> Iterator[tuple[str, int, int]]:
    before = lambda i, n=48: text[max(0, i - n) : i]
    if "@" in text or "at" in text.lower() or "собака" in text.lower():
        for m in _EMAIL.finditer(text):
            yield "EMAIL", *m.span()
    if any(c.isdigit() for c in text):
        for m in _SNILS.finditer(text):
            d, named = _digits(m[0]), bool(_SNILS_WORDS.search(before(m.start())))
            if snils_check(d[:9]) == d[9:] and (named or not m[0].isdigit()) or named and not _PHONE.match(text, m.start()):
                yield "SNILS", *m.span()
        for m in _TAX.finditer(text):
            d = _digits(m[0])
            if tax_check(d[:10]) == d[10:] or _TAX_WORDS.search(before(m.start(), 40)):
                yield "TAX_ID", *m.span()
        for m in _PASSPORT.finditer(text):
            if _PASSPORT_WORDS.search(before(m.start(), 40)):
                yield "PASSPORT", *m.span()
        for m in _PHONE.finditer(text):
            if not _UNIT_AFTER.match(text, m.end()):
                yield "PHONE", *m.span()
        for m in _ADDRESS.finditer(text):
            last = max(i for i in range(m.start(), m.end()) if text[i].isdigit())
            yield "ADDRESS", m.start(), last + 1
    people = list(_persons(text))
    for a, b in people:
        yield "PERSON", a, b
    if people and ";" in text:
        for a, b in _listed(text, people):
            yield "PERSON", a, b


def find(text: str, dates: bool = False) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data of a text, in order and without overlap; places count in the text as it stands.

    Where candidates overlap, the kind listed first in ``KINDS`` wins, then the longer one; ``dates`` adds dates of birth, which
    are of no listed kind and give way to all of them.
    """
    plain, places = _plain(text)
    taken: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(_candidates(plain), key=lambda c: (KINDS.index(c[0]), c[1] - c[2], c[1])):
        if all(b <= x or a >= y for _, x, y in taken):
            taken.append((kind, a, b))
    if dates:
        for m in _BIRTH.finditer(plain):
            if (_BIRTH_WORDS.search(plain, max(0, m.start() - 40), m.start()) or _BORN_AFTER.match(plain, m.end())) and all(m.end() <= x or m.start() >= y for _, x, y in taken):
                taken.append(("BIRTH_DATE", *m.span()))
    if places is not None:
        taken = [(k, places[a], places[b - 1] + 1) for k, a, b in taken]
        # Accents written apart belong to the last letter.
        taken = [(k, a, b + (b < len(text) and 0x300 <= ord(text[b]) <= 0x36F)) for k, a, b in taken]
    return sorted(taken, key=lambda t: t[1])


def permute(digits: str, key: bytes, tweak: str = "", rounds: int = 8) -> str:
    """A keyed permutation of all strings of that many digits: an unbalanced Feistel network with sums modulo a power of ten.

    Each ``tweak``, such as a kind of number, has a permutation of its own.
    """
    draw = lambda r, x: int.from_bytes(hashlib.blake2b(f"{tweak}|{r}|{len(digits)}|{x}".encode(), key=key, digest_size=16).digest(), "big")
    if len(digits) < 2:
        return digits if not digits else str((int(digits) + draw(0, "")) % 10)
    half = len(digits) // 2
    a, b = digits[:half], digits[half:]
    for r in range(rounds):
        a, b = b, f"{(int(a) + draw(r, b)) % 10 ** len(a):0{len(a)}d}"
    return a + b


def _checked(d: str, own: int, check: Callable[[str], str], key: bytes, kind: str) -> str:
    """Numbers with valid check digits permuted among themselves, and the others among themselves, so that no two become one."""
    if check(d[:own]) == d[own:]:
        head = permute(d[:own], key, kind)
        return head + check(head)
    while True:
        d = permute(d, key, kind + " unchecked")
        if check(d[:own]) != d[own:]:
            return d


# The days that dates of birth are permuted over.
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1), 73_049


def _date_pseudonym(value: str, key: bytes) -> str:
    """The date in its own format moved by a permutation of all days from 1900 to 2099; other dates permute their digits."""
    day, month, year = _BIRTH.fullmatch(value).groups()
    try:
        number = (datetime.date(int(year), int(month), int(day)) - _FIRST_DAY).days
    except ValueError:
        number = -1
    if not 0 <= number < _DAYS:
        return "?" + _refill(value, permute(_digits(value), key, "odd date"))
    while True:
        number = int(permute(f"{number:05d}", key, "date"))
        if number < _DAYS:
            return _refill(value, (_FIRST_DAY + datetime.timedelta(number)).strftime("%d%m%Y"))


def _refill(shape: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def _stem(word: str) -> str:
    return re.sub(r"(?:ого|ому|ыми?|ими?|ой|ою|ую|ий|ая|ом|ем|[аеёиоуыюья])$", "", word.lower().replace("ё", "е"))


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """The stand-in of a value: digits permuted in its own format, or a keyed tag of its normal form."""
    value = _plain(value)[0]
    d = _digits(value)
    if kind == "SNILS" and len(d) == 11:
        return _refill(value, _checked(d, 9, snils_check, key, kind))
    if kind == "TAX_ID" and len(d) == 12:
        return _refill(value, _checked(d, 10, tax_check, key, kind))
    if kind == "PHONE":
        own = d[-10:]
        return _refill(value, d[: len(d) - len(own)] + permute(own, key, kind))
    if kind == "PASSPORT":
        return _refill(value, permute(d, key, kind))
    if kind == "BIRTH_DATE":
        return _date_pseudonym(value, key)
    if kind == "PERSON":
        words = re.findall(r"\w+", value)
        norm = " ".join(sorted(_stem(w) if len(w) > 1 else w.lower() for w in words))
    elif kind == "EMAIL":
        norm = re.sub(r"\s*(?:\((?:dot|точка)\)|\[dot\]|\sточка\s|\sdot\s)\s*", ".", re.sub(_AT, "@", value.lower()))
    else:
        norm = re.sub(r"\W+", " ", value.lower()).strip()
    return hashlib.blake2b(f"{kind}|{norm}".encode(), key=key, digest_size=16).hexdigest()


def redact(text: str, key: bytes) -> str:
    """``text`` with each piece of personal data, dates of birth too, as [KIND:pseudonym] and nothing else changed."""
    out, at = [], 0
    for kind, a, b in find(text, dates=True):
        out += [text[at:a], f"[{kind}:{pseudonym(kind, text[a:b], key)}]"]
        at = b
    return "".join(out) + text[at:]


def _found_all(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "char_start": a, "char_end": b} for k, a, b in find(t)] if t else [] for t in texts])


_FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())]))


def with_pieces(texts: DataFrame, text: str, into: str) -> DataFrame:
    """``texts`` with the array of its pieces, dates of birth too, as ``into``; null and empty texts have none."""

    def all_(column: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "char_start": a, "char_end": b} for k, a, b in find(t, dates=True)] if t else [] for t in column])

    return texts.withColumn(into, F.pandas_udf(all_, _FOUND)(F.col(text)))


def personal_data(texts: DataFrame, text: str) -> DataFrame:
    """The rows of ``texts`` once for each piece of personal data, with kind, char_start and char_end.

    Places are half-open and count code points.  Null and empty texts have none; nothing is shuffled.
    """
    found = F.explode(F.pandas_udf(_found_all, _FOUND)(F.col(text))).alias("_found")
    rest = [c for c in texts.columns if c not in ("kind", "char_start", "char_end")]
    return texts.select(*rest, found).select(*rest, "_found.*")


def redacted(texts: DataFrame, text: str, key: str, into: str = "redacted") -> DataFrame:
    """``texts`` with the redacted form of ``text`` as ``into``; null stays null.  Who has ``key`` can invert the numbers."""
    if not key:
        raise ValueError("a key is needed")
    secret = hashlib.sha256(key.encode()).digest()

    def all_(column: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t, secret) for t in column])

    return texts.withColumn(into, F.pandas_udf(all_, T.StringType())(F.col(text)))
