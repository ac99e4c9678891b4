"""Surrogates for personal data: detected entities receive keyed replacements of the same type and format.

The same entity gets the same surrogate in every document, and different ones get different surrogates: numbers go through
a keyed permutation of all numbers of their format, words through keyed generators whose results are checked. Spark gathers
the distinct entities of the corpus, finds surrogates that two of them share or that are entities themselves, and moves all
but one of them to their next attempt, until none is left. Only those few exceptions travel back to the documents.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, spread_join, stash

EMAIL = re.compile(r"[A-Za-z0-9À-ɏ._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.])")
CARD = re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)")
PHONE = re.compile(r"(?<![\d.])(?:\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,8}+){1,5}+|(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4})(?![\d.]*\d)")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![\d.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")
#: Dates are no entities, nor parts of telephone numbers.
DATE = re.compile(r"(?<![\d.])(?:(?:19|20)\d\d([-./])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-./])(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d)(?!\d)")
#: Telephone codes of countries of one and two digits; all others have three.
CODES = {1: "1 7".split(), 2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: Ranges of addresses that stay in their range: first address and size.
RANGES = [(10 << 24, 1 << 24), (100 << 24 | 64 << 16, 1 << 22), (127 << 24, 1 << 24), (169 << 24 | 254 << 16, 1 << 16), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16), (0, 1 << 24), (224 << 24, 1 << 29)]
#: Titles that announce a person, and the gender they tell.
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "господин": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "госпожа": "f", "Dr": "n", "Prof": "n", "Professor": "n"}
_NAME = r"[A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-яё]+"
PERSON = re.compile(rf"\b({'|'.join(TITLES)})\.?[ ]({_NAME})(?:[ ]({_NAME}))?")
_TITLE = re.compile("|".join(TITLES))
_WORD = re.compile(r"[^\W\d_]+")
#: Given names by gender and script, and the syllables of family names by script.
GIVEN = {
    ("f", "latin"): "Anna Clara Elena Emma Eva Ida Irene Julia Laura Lea Lina Marta Mia Nora Olga Paula Rosa Sara Sofia Vera".split(),
    ("m", "latin"): "Adam Alan Bruno David Emil Felix Hugo Ivan Jonas Karl Leon Lucas Mario Nils Oscar Paul Peter Simon Tom Victor".split(),
    ("n", "latin"): "Alex Andrea Chris Dominique Jean Jo Kim Lou Luca Maxime Nico Noel Robin Sacha Sam Sascha Toni Uli Vivian Yael".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Светлана Юлия".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Денис Иван Кирилл Максим Олег Павел Роман".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава Шура".split(),
}
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ka ke ki la le li lo ma me mi mo na ne no ra re ri ro sa se so ta te ti to va ve vi za ze".split(), "cyrillic": "ба бе бо ва ве да де до ка ки ко ла ле ли ло ма ме ми мо на не но ра ре ри ро са се со та те ти то".split()}


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def permuted(key: bytes, value: int, size: int, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network on a square domain, walked until inside."""
    side = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, side)
        for r in range(8):
            a, b = b, (a + _number(key, tweak, size, r, b)) % side
        value = a * side + b
        if value < size:
            return value


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    back = [int(c) for c in reversed(digits)]
    return sum(back[::2] + [d * 2 - 9 * (d > 4) for d in back[1::2]]) % 10 == 0


def _digits(key: bytes, digits: str, kind: str) -> str:
    while True:
        digits = str(permuted(key, int(digits), 10 ** len(digits), f"{kind}{len(digits)}")).zfill(len(digits))
        if kind == "phone":
            return digits
        if luhn(digits) == (kind == "card"):
            return digits


def _country(digits: str) -> int:
    """How many digits the country's code has."""
    return next((n for n in (1, 2) if digits[:n] in CODES[n]), 3)


def _address(key: bytes, value: int) -> int:
    """Another address of the same range; one of no range stays outside all of them."""
    for base, size in RANGES:
        if base <= value < base + size:
            return base + permuted(key, value - base, size, f"ip{base}")
    while True:
        value = permuted(key, value, 2**32, "ip")
        if not any(base <= value < base + size for base, size in RANGES):
            return value


def iban_check(country: str, account: str) -> str:
    """The two check digits."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _account(key: bytes, account: str, country: str) -> str:
    """Another account of the country with digits and letters at the same places."""
    sizes = [10 if c.isdigit() else 26 for c in account]
    value = 0
    for c, n in zip(account, sizes, strict=True):
        value = value * n + (int(c) if n == 10 else ord(c) - 65)
    value = permuted(key, value, math.prod(sizes), f"iban{country}{''.join('9' if n == 10 else 'A' for n in sizes)}")
    out = []
    for n in reversed(sizes):
        value, d = divmod(value, n)
        out.append(str(d) if n == 10 else chr(65 + d))
    return "".join(reversed(out))


def script(word: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", word) else "latin"


def _syllables(number: int, some: list[str], count: int) -> str:
    out = ""
    for _ in range(count):
        number, i = divmod(number, len(some))
        out += some[i]
    return out


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The replacement of a canonical entity. Numbers of a format permute, so their first attempts never collide."""
    tweak = f"{kind}/{attempt}"
    if kind == "phone" and entity[0] == "+":
        n = 1 + _country(entity[1:])
        rest = entity[n:]
        for _ in range(attempt + 1):
            rest = _digits(key, rest, kind)
        return entity[:n] + rest
    if kind == "iban":
        country, account = entity[:2], entity[4:]
        for _ in range(attempt + 1):
            account = _account(key, account, country)
        return country + iban_check(country, account) + account
    if kind == "ssn":
        for _ in range(attempt + 1):
            while True:
                entity = _digits(key, entity, "phone")
                if SSN.fullmatch(f"{entity[:3]}-{entity[3:5]}-{entity[5:]}"):
                    break
        return entity
    if kind in ("card", "number", "phone"):
        for _ in range(attempt + 1):
            entity = _digits(key, entity, kind)
        return entity
    if kind == "ip":
        value = 0
        for part in entity.split("."):
            value = value * 256 + int(part)
        for _ in range(attempt + 1):
            value = _address(key, value)
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ip6":
        value = int(ipaddress.IPv6Address(entity))
        for _ in range(attempt + 1):
            value = permuted(key, value, 2**128, kind)
        return ipaddress.IPv6Address(value).compressed
    n = _number(key, tweak, entity)
    if kind == "email":
        local, _, host = entity.partition("@")
        digits = re.sub(r"\D", "", local)
        tail = str(n % 10 ** len(digits)).zfill(len(digits)) if digits else ""
        return f"{_syllables(n >> 64, SYLLABLES['latin'], 5 + attempt)}{'.' if '.' in local else ''}{tail}@{_syllables(_number(key, 'host', host), SYLLABLES['latin'], 4)}.example"
    alphabet = script(entity)
    if kind == "family":
        return _syllables(n, SYLLABLES[alphabet], 4 + attempt).capitalize()
    some = GIVEN[kind[-1], alphabet]
    return some[n % len(some)] + _syllables(n // len(some), SYLLABLES[alphabet], 2 + attempt)


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, canonical)`` of the entities of a text, in order, none overlapping; earlier kinds win."""
    found: list[tuple[int, int, str, str]] = []
    # Spans that are taken, in order; they don't overlap.
    begins: list[int] = []
    ends: list[int] = []

    def free(a: int, b: int) -> bool:
        i = bisect_left(begins, b)
        if i and ends[i - 1] > a:
            return False
        begins.insert(i, a)
        ends.insert(i, b)
        return True

    def add(a: int, b: int, kind: str, canonical: str) -> None:
        if free(a, b):
            found.append((a, b, kind, canonical))

    if "@" in text:
        for m in EMAIL.finditer(text):
            start = m.start() + len(m[0]) - len(m[0].lstrip(".%+-"))
            if start < m.end() and text[start] != "@":
                add(start, m.end(), "email", text[start : m.end()].lower())
    if "::" in text or text.count(":") >= 7:
        for m in IP6.finditer(text):
            # Two groups and a digit at least: pairs of colons stand in programs too.
            if sum(map(bool, m[0].split(":"))) >= 2 and re.search(r"\d", m[0]):
                try:
                    add(m.start(), m.end(), "ip6", ipaddress.IPv6Address(m[0]).compressed)
                except ipaddress.AddressValueError:
                    continue
    if re.search(r"\d", text):
        for m in IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]:
                add(m.start(), m.end(), "iban", plain)
        for m in DATE.finditer(text):
            free(m.start(), m.end())
        for m in SSN.finditer(text):
            add(m.start(), m.end(), "ssn", m[0].replace("-", ""))
        for m in IP.finditer(text):
            add(m.start(), m.end(), "ip", ".".join(str(int(p)) for p in m[0].split(".")))
        for m in CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            add(m.start(), m.end(), "card" if luhn(digits) else "number", digits)
        for m in PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 7 <= len(digits) <= 15 and ("+" in m[0] or "(" in m[0] or len(digits) >= 9):
                add(m.start(), m.end(), "phone", "+" * (m[0][0] == "+" and len(digits) > 1 + _country(digits)) + digits)
    if _TITLE.search(text):
        genders: dict[str, set[str]] = {}
        families = set()
        titled = list(PERSON.finditer(text))
        for m in titled:
            if m[3]:
                genders.setdefault(m[2].lower(), set()).add(TITLES[m[1]])
            families.add(m[3 if m[3] else 2].lower())
        # One kind a given name and text: the gender that titles tell; neutral if none does, or both.
        given = {name: f"given_{min(told - {'n'}) if len(told - {'n'}) == 1 else 'n'}" for name, told in genders.items()}
        for m in titled:
            if m[3]:
                add(m.start(2), m.end(2), given[m[2].lower()], m[2].lower())
            k = 3 if m[3] else 2
            add(m.start(k), m.end(k), "family", m[k].lower())
        bare = []
        for m in _WORD.finditer(text) if titled else ():
            name = m[0].lower()
            if (name in families or name in given) and (m[0] == m[0].capitalize() or m[0].isupper()):
                if free(m.start(), m.end()):
                    bare.append((m.start(), m.end(), "family" if name in families else given[name], name))
        found += bare
    return sorted(found)


def _dressed(original: str, kind: str, new: str) -> str:
    """``new`` in the format of the original: separators stay where they are, capitals as they were."""
    if kind in ("card", "number", "phone", "ssn", "iban"):
        marks = iter(c for c in new if c.isalnum())
        return "".join(next(marks) if c.isalnum() else c for c in original)
    return new.upper() if kind != "email" and original.isupper() and len(original) > 1 else new


def distinct_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, entity``: the distinct canonical entities of the corpus."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = sorted({(k, c) for t in batch.column(0) for _, _, k, c in entities(t.as_py() or "")})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], ["kind", "entity"])

    small_batches(docs.sparkSession)
    return docs.select(text_col).mapInArrow(find, "kind string, entity string").distinct()


def _with_surrogates(known: DataFrame, key: bytes) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, entity, attempt = (c.to_pylist() for c in batch.columns)
            new = [surrogate(key, *row).lower() for row in zip(kind, entity, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "entity", "attempt", "new"])

    return known.select("kind", "entity", "attempt").mapInArrow(make, "kind string, entity string, attempt int, new string")


def exceptions(known: DataFrame, key: bytes, rounds: int = 30) -> DataFrame:
    """``kind, entity, attempt`` of entities whose first surrogate another one has or that is an entity itself."""
    now = stash(_with_surrogates(known.withColumn("attempt", F.lit(0)), key))
    # Kinds that look alike share their surrogates' names: a number must not turn into a telephone's digits, nor a family into a given name.
    group = F.when(F.col("kind").isin("card", "number", "phone", "ssn"), "digits").when(F.col("kind").startswith("given_") | (F.col("kind") == "family"), "name").otherwise(F.col("kind"))
    real = stash(known.select(group.alias("g"), F.col("entity").alias("new")).distinct())
    for _ in range(rounds):
        own = now.withColumn("g", group)
        first = own.groupBy("g", "new").agg(F.min_by(F.struct("kind", "entity"), F.struct(-F.col("attempt"), "kind", "entity")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "new", "first")
        twice = own.join(first, ["g", "new"]).where(F.struct("kind", "entity") != F.col("first")).select("kind", "entity")
        taken = own.join(real, ["g", "new"]).select("kind", "entity")
        moved = stash(twice.union(taken).distinct())
        if moved.isEmpty():
            return now.where("attempt > 0").select("kind", "entity", "attempt")
        again = now.join(moved, ["kind", "entity"]).withColumn("attempt", F.col("attempt") + 1)
        now = stash(now.join(moved, ["kind", "entity"], "left_anti").union(_with_surrogates(again, key)))
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def with_surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_entities, spans, text``: one row per row of ``docs``; text has every entity replaced.

    Spans are ``kind:start:end`` of the original text, in code points. Kinds: email, ip (another of its private range, or outside
    all of them), ip6, iban and card (right check digits; an account keeps its country), number, phone (a country's code stays),
    ssn, given_f/m/n and family (names behind a title, and the same names elsewhere in the text, capitalised or in capitals;
    a given name has one gender in a text, the titles' one or n). Texts without entities stay as they are, null stays null and empty
    stays empty. Whoever holds ``key`` can undo numbers; keep it secret. Repeated rows are treated each, a null id is
    carried, other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    odd = stash(exceptions(stash(distinct_entities(rows, "__text")), key))
    kind = dict(rows.dtypes)["__id"]
    if odd.isEmpty():
        work = rows.withColumn("__odd", F.lit(None).cast("array<string>"))
    else:
        work = _with_exceptions(rows, odd, kind)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, texts = [], [], []
            for text, mine in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                moved = {tuple(x.split("\x1f")[:2]): int(x.split("\x1f")[2]) for x in mine.as_py() or ()}
                found = entities(text or "")
                out, at = [], 0
                for a, b, k, c in found:
                    out += [text[at:a], _dressed(text[a:b], k, surrogate(key, k, c, moved.get((k, c), 0)))]
                    at = b
                texts.append(text if not found else "".join(out) + text[at:])
                n.append(len(found))
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k, _ in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_entities", "spans", "text"])

    return work.mapInArrow(replace, f"doc_id {kind}, n_entities long, spans string, text string")


def _with_exceptions(rows: DataFrame, odd: DataFrame, kind: str) -> DataFrame:
    """``rows`` with the exceptions that each one's text holds; a row is known by its id and the hash of its text."""
    rows = rows.withColumn("__h", F.xxhash64("__text"))

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h.as_py(), *e) for t, h in zip(batch.column(0), batch.column(1), strict=True) for e in sorted({(k, c) for _, _, k, c in entities(t.as_py() or "")})]
            h, k, c = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.string()), pa.array(c, pa.string())], ["__h", "kind", "entity"])

    where = rows.select("__text", "__h").mapInArrow(occur, "__h long, kind string, entity string").withColumn("__e", F.concat_ws("\x1f", "kind", "entity"))
    named = stash(odd.select(F.concat_ws("\x1f", "kind", "entity").alias("__e"), "attempt"))
    mine = spread_join(where, named, "__e", F.col("__h"), counted=stash(where.select("__e")) if named.count() > 400_000 else where).select("__h", F.concat_ws("\x1f", "__e", "attempt").alias("x"))
    mine = stash(mine.groupBy("__h").agg(F.collect_set("x").alias("__odd")))
    return rows.join(broadcast_if_small(mine, 50_000), "__h", "left").select("__id", "__text", "__odd")
