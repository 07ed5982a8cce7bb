"""PII detection with keyed, type-consistent surrogates.

Structured entities (e-mail, phone, card, national id, IPv4) are replaced by a keyed permutation of all
strings of their own format, so replacements keep the format, differ for different entities, never equal
the original and agree wherever the entity occurs, in any document. The permutation is one long cycle: a
Feistel cipher P, walked until it stays inside the domain, gives x -> P^-1(P(x) + 1). Card numbers stay
valid or invalid by their check digit.

Persons are names after a title, after a cue such as "my name is", and listed given names with a family name
behind them. A family name becomes the keyed permutation of all names of its own pattern of vowels, consonants and
letter case in its script, so different family names get different surrogates in the whole corpus and one
name always the same. A given name becomes one of the list of its gender and script, by keyed hash of name and
gender; where two given names of a document would meet, the later one gets a second name, a permutation of its own
letters, so they stay apart. Later mentions of the full, given or family name follow.

Defined results: a null text stays null and an empty one empty, with no entities; repeated rows are replaced
alike; where detections overlap, the one that starts first and then the longer one counts; names that differ in
letter case only are one name; an empty table gives an empty table; very long texts are read whole, in time that
grows in proportion; other columns pass through unchanged, whatever their names (the column of spans takes a free
one). The key has to be secret, as whoever knows it can invert the permutations; callers pass it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspan.llm.text import free_name, slices_of

KINDS = ("email", "card", "phone", "national_id", "ip", "person")
KEY_SETTING = "spark.docspan.surrogates.key"  # setting of the session that holds the secret
TEST_KEY = "docspan-surrogates"  # stands in where the session has none, for tests and synthetic tables only

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_DIGITS = re.compile(r"\d[\d ().-]{5,}\d")
_CARD = re.compile(r"(?<![\d.])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?:\d{3})?(?!\d)")
_PHONE = re.compile(r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d.])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)")
_NATIONAL = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)")

#: Titles that announce a name, with the gender that they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "господин": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Doña": "f", "госпожа": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n", "Professor": "n",
}
#: Given names to draw from, by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Lucas Martin Nils Oscar Paul Ralf Simon Tomas Viktor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Elena Flora Greta Helena Irma Julia Klara Laura Maria Nora Olga Paula Rosa Sara Teresa Vera".split(),
    ("latin", "n"): "Alex Andrea Charlie Dana Eli Francis Jamie Kim Lee Marlin Noel Pat Quinn Robin Sam Sasha Sidney Terry Toni Val".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Ирина Лидия Мария Нина".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος Τάσος".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
    ("greek", "n"): "Άρης Φοίβη".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa ze zo".split(),
    "cyrillic": "ба ве го да зе ка ло ма не по ра си та фо ха ше".split(),
    "greek": "βα γε δο ζα θε κα λο μα νε πα ρο σα τε φο χα".split(),
}
#: Words that a name follows.
CUES = ("my name is", "name:", "named", "signed,", "sincerely,", "regards,", "dear", "ich heiße", "je m'appelle", "me llamo", "меня зовут", "με λένε")
#: Letters that may stand for each other in a name, by script.
LETTERS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåèéêëìíîïòóôõöùúûüýÿ", "çñčšžćđłńśźż", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ")
_CLASS_OF = {c: i for i, letters in enumerate(LETTERS) for c in letters}
_WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_LISTED = {name: gender for (_, gender), names in GIVEN.items() for name in names}
_CUED = re.compile(rf"(?<!\w)(?i:{'|'.join(sorted(map(re.escape, CUES), key=len, reverse=True))})\s({_WORD})(?: ({_WORD}))?")
_GIVEN = re.compile(rf"(?<!\w)({'|'.join(sorted(_LISTED, key=len, reverse=True))}) ({_WORD})")
_PERSON = re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})\.? ({_WORD})(?: ({_WORD}))?")


class Permutation:
    """A keyed permutation of range(n) that is a single cycle, so that nothing maps to itself (n > 1)."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), tweak.encode()

    def _f(self, i: int, x: int) -> int:
        size = (self.half + 7) // 8
        data = b"%d|%d|%s|" % (i, self.n, self.tweak) + x.to_bytes(size, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=max(8, size)).digest(), "big") & self.mask

    def _forward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in range(6):
                a, b = b, a ^ self._f(i, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def _inverse(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in reversed(range(6)):
                a, b = b ^ self._f(i, a), a
            x = a << self.half | b
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        return self._inverse((self._forward(x) + 1) % self.n)


def permute_format(text: str, key: bytes, tweak: str) -> str:
    """Replace letters and digits of a string, keeping every other character, letter case and digit places."""
    sizes = [26 if c.isascii() and c.isalpha() else 10 if c.isascii() and c.isdigit() else 1 for c in text]
    n, x = 1, 0
    for c, size in zip(text, sizes):
        if size > 1:
            x = x * size + (ord(c.lower()) - 97 if size == 26 else int(c))
            n *= size
    if n == 1:
        return text
    y = Permutation(key, tweak + "|" + "".join("a" if s == 26 else "0" if s == 10 else c for c, s in zip(text, sizes)), n)(x)
    out = []
    for c, size in zip(reversed(text), reversed(sizes)):
        if size > 1:
            y, d = divmod(y, size)
            c = (chr(97 + d).upper() if c.isupper() else chr(97 + d)) if size == 26 else str(d)
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return str(-total % 10)


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.rpartition("@")
    name, _, tld = domain.rpartition(".")
    return f"{permute_format(local, key, 'local')}@{permute_format(name, key, 'domain')}.{tld}"


def _card(text: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", text)
    valid = luhn_digit(digits[:-1]) == digits[-1]
    if valid:
        body = permute_format(digits[1:-1], key, "card")
        new = digits[0] + body
        new += luhn_digit(new)
    else:
        new = digits[0] + permute_format(digits[1:], key, "card-unchecked")
        if luhn_digit(new[:-1]) == new[-1]:  # walk on until the number is invalid like the original
            walk = new
            while luhn_digit(walk[:-1]) == walk[-1]:
                walk = walk[0] + permute_format(walk[1:], key, "card-unchecked")
            new = walk
    put = iter(new)
    return re.sub(r"\d", lambda _: next(put), text)


def _phone(text: str, key: bytes) -> str:
    lead = re.match(r"\+\d{1,3}(?=\D)", text)
    at = lead.end() if lead else 0
    return text[:at] + permute_format(text[at:], key, "phone" + text[:at])


def _ip(text: str, key: bytes) -> str:
    x = 0
    for part in text.split("."):
        x = x << 8 | int(part)
    y = Permutation(key, "ip", 1 << 32)(x)
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


_STRUCTURED = {"email": _email, "card": _card, "phone": _phone, "ip": _ip, "national_id": lambda t, k: permute_format(t, k, "national")}


def script_of(name: str) -> str:
    for c in name:
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), key=key[:64], digest_size=8).digest(), "big")


def _cased(new: str, like: str) -> str:
    return new.upper() if like.isupper() and len(like) > 1 else new.lower() if like.islower() else new[:1].upper() + new[1:]


def family_for(name: str, key: bytes) -> str:
    """The keyed permutation of names with the same pattern of letter classes; each letter keeps its case."""
    lower = [c.lower() for c in name]
    classes = [_CLASS_OF.get(c, -1) for c in lower]
    n, x = 1, 0
    for c, k in zip(lower, classes):
        if k >= 0:
            x = x * len(LETTERS[k]) + LETTERS[k].index(c)
            n *= len(LETTERS[k])
    if n == 1:  # a script without letter classes: syllables by keyed hash
        bits, syllables, out = _number(key, "family", name.casefold()), _SYLLABLES["latin"], ""
        for _ in range(5):
            bits, i = divmod(bits, len(syllables))
            out += syllables[i]
        return out.capitalize()
    y = Permutation(key, "family|" + ",".join(c if k < 0 else str(k) for c, k in zip(lower, classes)), n)(x)
    out = []
    for c, k in zip(reversed(name), reversed(classes)):
        if k >= 0:
            y, d = divmod(y, len(LETTERS[k]))
            c = LETTERS[k][d].upper() if c.isupper() else LETTERS[k][d]
        out.append(c)
    return "".join(reversed(out))


def given_for(name: str, gender: str, key: bytes) -> str:
    """A listed name of the gender and script; never the name itself."""
    names = [x for x in GIVEN[script_of(name), gender] if x.casefold() != name.casefold()]
    return _cased(names[_number(key, "given", gender, name.casefold()) % len(names)], name)


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int
    new: str


def persons(text: str) -> list[tuple[int, int, str, tuple]]:
    """Names behind titles and cues, and listed given names with a family name: (start, end, kind, (gender, given, family) as spans)."""
    found = []
    for m in _PERSON.finditer(text):
        found.append((m.start(), m.end(), TITLES[m[1]], m.span(2), m.span(3)))
    lowered = text.lower()
    if any(cue in lowered for cue in CUES):
        found += [(m.start(1), m.end(), None, m.span(1), m.span(2)) for m in _CUED.finditer(text)]
    found += [(m.start(), m.end(), _LISTED[m[1]], m.span(1), m.span(2)) for m in _GIVEN.finditer(text)]
    out = []
    for start, end, gender, first, last in found:
        if not text[first[0]].isupper() or text[first[0] : first[1]] in TITLES:
            continue
        if last[0] < 0 or not text[last[0]].isupper():
            last, end = None, first[1]
        gender = gender or _LISTED.get(text[first[0] : first[1]], "n")
        out.append((start, end, "person", (gender, first, last) if last else (gender, None, first)))
    return out


def detect(text: str) -> list[tuple[int, int, str, tuple | None]]:
    """Non-overlapping structured entities and names, by start."""
    found: list[tuple[int, int, str, tuple | None]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", None) for m in _EMAIL.finditer(text)]
    if _DIGITS.search(text):
        for kind, pattern in (("card", _CARD), ("phone", _PHONE), ("national_id", _NATIONAL), ("ip", _IP)):
            found += [(m.start(), m.end(), kind, None) for m in pattern.finditer(text)]
    found += persons(text)
    out, at = [], 0
    for hit in sorted(found, key=lambda h: (h[0], -h[1], KINDS.index(h[2]))):
        if hit[0] >= at:
            out.append(hit)
            at = hit[1]
    return out


def replace_entities(text: str, key: bytes) -> tuple[str, list[Entity]]:
    """The text with surrogates, and the entities (positions in the source)."""
    hits = detect(text)
    if not hits:
        return text, []
    entities: list[Entity] = []
    given: dict[tuple[str, str], str] = {}  # (name, gender) -> surrogate
    mentions: dict[str, str] = {}  # any name -> the surrogate of its first use

    def given_name(name: str, gender: str) -> str:
        own = name.casefold(), gender
        if own not in given:
            new = given_for(name, gender, key)
            if new.casefold() in map(str.casefold, given.values()):
                new += "-" + _cased(family_for(name.capitalize(), key), name)
            given[own] = new
        return _cased(given[own], name) if "-" not in given[own] else given[own]

    for start, end, kind, person in hits:
        if kind != "person":
            entities.append(Entity(kind, start, end, _STRUCTURED[kind](text[start:end], key)))
            continue
        gender, first, last = person
        for span, new in ((first, lambda x: given_name(x, gender)), (last, lambda x: family_for(x, key))):  # noqa: B023
            if span:
                name = text[span[0] : span[1]]
                entities.append(Entity(kind, *span, new(name)))
                mentions.setdefault(name.casefold(), entities[-1].new)
    if mentions:
        taken = bytearray(len(text))
        for e in entities:
            taken[e.start : e.end] = b"\1" * (e.end - e.start)
        for m in re.finditer(_WORD, text):
            new = mentions.get(m.group().casefold())
            if new and m.group()[0].isupper() and not taken[m.start()]:
                entities.append(Entity("person", m.start(), m.end(), _cased(new, m.group()) if "-" not in new else new))
    entities.sort(key=lambda e: e.start)
    out, at = [], 0
    for e in entities:
        out += [text[at : e.start], e.new]
        at = e.end
    return "".join(out) + text[at:], entities


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def secret_key(spark: SparkSession) -> str:
    """The session's secret, or the key for tests where it has none."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def replace_pii(docs: DataFrame, key: str, spans: str = "pii") -> DataFrame:
    """docs with surrogates in text, and a column (spans, or the next free name) of kind and span in the source of each entity."""
    columns, spans = docs.columns, free_name(docs, spans)
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, _SPAN)])
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    at = columns.index("text")
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices_of(whole)):
            texts, found = [], []
            for text in batch.column(at).to_pylist():
                new, entities = replace_entities(text, secret) if text else (text, [])
                texts.append(new)
                found.append([{"kind": e.kind, "start": e.start, "end": e.end} for e in entities])
            arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, span)], names=[*columns, spans])

    return docs.mapInArrow(per_batch, schema)


def summarise(replaced: DataFrame) -> DataFrame:
    """doc_id, n_entities and the count of each kind, pii, and the text with surrogates."""
    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return replaced.select("doc_id", F.size("pii").cast("long").alias("n_entities"), *map(count, KINDS), "pii", "text")
