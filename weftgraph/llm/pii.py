"""Personal data replaced by surrogates.

Detected entities get keyed replacements of their own type: digits stay digits, letters keep
their script and case, cards keep their check digit, addresses their structure, names their gender
and script. A surrogate depends on the key and the entity alone, so equal entities stay equal in
the whole corpus, and later mentions of a name without its title or its other names get the
surrogates of the first. Distinct entities must stay distinct: surrogates that collide, or that
are somebody's real value, are drawn again; from LENGTHEN attempts on they also grow, so room never runs out.

Texts are searched where they can hold an entity only: digits, @, prefixes of keys, labels of
secrets and known names are looked up in the bytes of a whole batch, and the pattern runs over the
words around them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from weftgraph.llm.tokens import chunks
from weftgraph.session import Scratch

#: Entities with a redrawn surrogate that are sent to the tasks with the code; with more of them texts are joined with theirs.
SENT = 100_000
#: From this attempt on surrogates get longer, by 2, 4, 8 .. 64 characters; at MOST_ATTEMPTS 64 drawn characters can't all collide.
LENGTHEN = 6
MOST_ATTEMPTS = 24
#: Bytes after a hint that the pattern sees at least, up to the next white space.
REACH = 256

# Forms of address and given names by gender, Latin and Cyrillic. They serve detection only.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Госпожа"],
    "n": ["Dr", "Prof", "Professor"],
}
GIVEN = {
    "m": [
        "James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Paul", "Mark", "Peter", "Hans", "Klaus", "Jürgen", "Stefan",
        "Wolfgang", "Jean", "Pierre", "Michel", "Jacques", "José", "Juan", "Carlos", "Luis", "Miguel", "Antonio", "Александр", "Дмитрий", "Сергей", "Андрей", "Алексей", "Иван", "Михаил", "Николай",
    ],
    "f": [
        "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Emma", "Laura", "Ursula", "Monika", "Petra", "Sabine", "Renate",
        "Marie", "Nathalie", "Isabelle", "Sylvie", "María", "Carmen", "Ana", "Isabel", "Dolores", "Pilar", "Анна", "Мария", "Елена", "Ольга", "Татьяна", "Наталья", "Ирина", "Светлана",
    ],
}
# What surrogate names are made of: syllables, then an ending of the gender.
SYLLABLES = {
    "latin": ["bar", "bel", "ber", "cal", "cor", "dal", "den", "dor", "fal", "fen", "gar", "hal", "han", "har", "kel", "ker", "lan", "lin", "lor", "mar", "mel", "mon", "nar", "nel", "nor", "pal", "per", "ral", "ren", "ros", "sal", "sen", "sol", "tan", "tel", "tor", "val", "ven", "vor", "wel"],
    "cyrillic": ["бар", "бел", "вар", "вел", "гор", "дан", "дел", "жар", "зор", "кал", "кор", "лан", "лин", "мар", "мел", "нар", "нор", "пал", "рен", "рос", "сал", "сен", "тан", "тор"],
}
ENDINGS = {
    ("m", "latin"): ["an", "en", "ik", "o", "or", "us"],
    ("f", "latin"): ["a", "elle", "ia", "ina", "ine", "ita"],
    ("m", "cyrillic"): ["ан", "ей", "ий", "ир", "ислав"],
    ("f", "cyrillic"): ["а", "ана", "ина", "ия", "ислава"],
}
# Endings of Cyrillic surnames, which tell the gender and stay, longer ones first.
SURNAME_ENDINGS = ["ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин"]
# Labels of secrets, those of passwords and those after which a plain word is prose; words before a date of birth; streets.
PASSWORD_LABELS = ["password", "passwd", "pwd"]
KEY_LABELS = ["secret", "token", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key"]
BIRTH_LABELS = ["date of birth", "birth date", "birthdate", "birthday", "born on", "born", "dob", "geboren am", "geboren", "nacido el", "nacida el"]
STREETS = ["Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Dr", "Boulevard", "Blvd", "Court", "Way", "Square"]
# First and last letter of scripts without case, and of the lower-case letters of those with it and their distance to upper case.
PLAIN_SCRIPTS = [(0x05D0, 0x05EA), (0x0627, 0x063A), (0x0641, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
CASED_SCRIPTS = [(0x61, 0x7A, 32), (0xE0, 0xF6, 32), (0x3B1, 0x3C1, 32), (0x430, 0x44F, 32), (0x561, 0x586, 48)]
# Marks that stand for the marks of a secret which has nothing else.
MARKS = "!#$%&*+-./:=?@^_~"
# Letters outside ASCII that count as one in it when case is ignored.
OTHER_CASES = {"s": "ſ", "k": "\u212a"}

_GENDER = {n: g for g, names in GIVEN.items() for n in names}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}


def _any(words: list[str], folded: bool = False) -> str:
    """An alternation, longer words first; ``folded``: in either case."""
    fold = lambda w: "".join(f"[{c}{c.upper()}{OTHER_CASES.get(c, '')}]" if "a" <= c <= "z" else re.escape(c) for c in w) if folded else re.escape(w)
    return "|".join(fold(w) for w in sorted(words, key=lambda w: (-len(w), w)))


_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:[-'][A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-яё]+)?"
PATTERN = re.compile(
    rf"""
      (?P<email>(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)
    | (?P<aws>(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{{16}}(?![A-Za-z0-9]))
    | (?P<token>(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{{20,}}+|sk-[A-Za-z0-9_-]{{20,}}+|xox[abp]-[A-Za-z0-9-]{{10,}}+))
    | (?P<assign>(?<![A-Za-z])(?:(?:{_any(PASSWORD_LABELS, True)})["']?\s{{0,3}}[=:]\s{{0,3}}["']?
        |(?:{_any(KEY_LABELS, True)})["']?\s{{0,3}}[=:]\s{{0,3}}["']?(?![A-Za-zÀ-ÖØ-öø-ÿ]{{1,15}}(?:[\s.,;:!?"')]|$))))(?P<secret>[^\s"',;]{{4,}}+)
    | (?P<hex>(?<![0-9A-Za-z])[0-9a-fA-F]{{32,128}}(?![0-9A-Za-z]))
    | (?P<iban>(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:\ ?[A-Z0-9]{{4}}){{3,7}}(?:\ ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))
    | (?P<ip>(?<![0-9.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?![0-9]|\.[0-9]))
    | (?P<ssn>(?<![0-9-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-]))
    | (?P<card>(?<![0-9+])[0-9](?:[\ -]?[0-9]){{12,18}}(?![0-9]))
    | (?P<phone>(?<![\w+])(?:\+[0-9]{{1,3}}[\ .-]?)?\([0-9]{{2,5}}\)[\ .-]?[0-9]{{2,4}}(?:[\ .-]?[0-9]{{2,4}}){{1,3}}(?!\w)|(?<![\w+])\+[0-9]{{1,3}}(?:[\ .-]?[0-9]{{2,4}}){{2,5}}(?!\w)|(?<![\w.-])[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}(?![\w-]))
    | (?P<birth>(?<![A-Za-z])(?:{_any(BIRTH_LABELS, True).replace(chr(92) + " ", "[ ]")})[\ :]{{1,3}})(?P<date>[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:[0-9]{{4}}|[0-9]{{2}})|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?![\w/-])
    | (?P<address>(?<![\w.-])[0-9]{{1,5}}[A-Za-z]?(?:\ {_NAME}){{1,3}}\ (?:{_any(STREETS)})(?!\w))
    | (?P<named>(?<!\w)(?P<title>{_any(list(_TITLE))})\.?\ (?P<names>{_NAME}(?:\ {_NAME}){{0,2}}))
    | (?P<full>(?<!\w)(?:{_any(list(_GENDER))})\ {_NAME}(?!\w))
    """,
    re.VERBOSE,
)


def _marked(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_DIGIT_OR_AT = _marked(b"0123456789@")
_HEX = bytes(120 if c in b"0123456789abcdefABCDEF" else 32 for c in range(256))
_SPACE = _marked(b" \t\n\r\x0b\x0c")
_LITERALS = re.compile(b"A[KS]IA|gh[pousr]_|sk-|xox[abp]-|" + b"|".join(re.escape(w.encode()) for w in sorted([*_TITLE, *_GENDER])))
_WORDS = sorted({*PASSWORD_LABELS, "secret", "token", "key", *BIRTH_LABELS})
_LABELS = re.compile(b"|".join(re.escape(w.encode()) for w in _WORDS))
_ODD_LABELS = re.compile("|".join("".join(f"[{c}{OTHER_CASES[c]}]" if c in OTHER_CASES else re.escape(c) for c in w) for w in _WORDS))
_LONG_HEX = re.compile(b"x{32,}")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def windows(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each text the stretches [start, end), between white space, outside of which no entity can begin."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    if any(c.encode() in joined for c in OTHER_CASES.values()):
        odd = joined.translate(_LOWER).decode()
        labels = [len(odd[: m.start()].encode()) for m in _ODD_LABELS.finditer(odd)]
    else:
        labels = [m.start() for m in _LABELS.finditer(joined.translate(_LOWER))]
    hints = labels + [m.start() for hint, where in ((_LITERALS, joined), (_LONG_HEX, joined.translate(_HEX))) for m in hint.finditer(where)]
    at = np.unique(np.concatenate((np.flatnonzero(_DIGIT_OR_AT[data]), np.array(hints, np.int64))))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(at):
        return out
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    space = np.flatnonzero(_SPACE[data])
    row = np.searchsorted(ends, at)
    before = np.searchsorted(space, at) - 1
    start = np.where(before >= 0, space[np.maximum(before, 0)] + 1, 0)
    stop = np.minimum(space[np.minimum(np.searchsorted(space, at + REACH), len(space) - 1)], ends[row])
    # Starts and stops rise together, so a window goes on while the next one starts in it.
    first = np.concatenate(([True], start[1:] > stop[:-1]))
    last = np.concatenate((first[1:], [True]))
    begins = np.concatenate(([0], ends[:-1] + 1))
    for r, a, b in zip(row[first].tolist(), start[first].tolist(), stop[last].tolist(), strict=True):
        out[r].append((a - int(begins[r]), b - int(begins[r])))
    return out


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


class _Draw:
    """Numbers from the key, the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self._key, self._of, self._block, self._left = key, f"{kind}\0{attempt}\0{entity}", 0, b""

    def below(self, n: int) -> int:
        if len(self._left) < 4:
            self._left += hashlib.blake2b(f"{self._block}\0{self._of}".encode(), key=self._key, digest_size=64).digest()
            self._block += 1
        number, self._left = int.from_bytes(self._left[:4], "little"), self._left[4:]
        return number % n

    def of(self, choices):
        return choices[self.below(len(choices))]


def _letter(c: str, draw: _Draw) -> str:
    """Another letter of the script and case of ``c``."""
    for first, last in PLAIN_SCRIPTS:
        if first <= ord(c) <= last:
            return chr(first + draw.below(last - first + 1))
    for first, last, up in CASED_SCRIPTS:
        if first <= ord(c) <= last or first - up <= ord(c) <= last - up:
            return chr(first + draw.below(last - first + 1) - (0 if first <= ord(c) <= last else up))
    return chr((65 if c.isupper() else 97) + draw.below(26))


def _alike(entity: str, draw: _Draw) -> str:
    """Each character by one of its kind; marks stay."""
    return "".join(chr(ord(c) - int(c) + draw.below(10)) if c.isdecimal() else _letter(c, draw) if c.isalpha() else c for c in entity)


def _more(entity: str, draw: _Draw, attempt: int) -> str:
    """What a surrogate is longer by: digits after digits alone, else letters."""
    n = 0 if attempt < LENGTHEN else min(64, 2 << (attempt - LENGTHEN))
    return "".join(chr(48 + draw.below(10)) if entity.isdecimal() else chr(97 + draw.below(26)) for _ in range(n))


def _word(draw: _Draw, syllables: int, script: str) -> str:
    return "".join(draw.of(SYLLABLES[script]) for _ in range(syllables))


def _date(entity: str, draw: _Draw, attempt: int) -> str:
    """A date in the same format; days and months are 1 to 12, so that either order is valid. Years spread with the attempts."""
    fields = re.split(r"([./-])", entity)
    for i, f in enumerate(fields):
        if i % 2:
            continue
        year = len(f) == 4 or (i == 4 and len(fields[0]) < 4)
        number = draw.below(75 << min(attempt, 6)) if year else 1 + draw.below(12)
        fields[i] = (str(1930 + number) if len(f) == 4 or number > 69 else f"{30 + number}") if year else f"{number:0{len(f)}d}"
    return "".join(fields)


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity in its normal form."""
    draw = _Draw(key, kind, entity, attempt)
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        new = [labels[0], labels[-1]] if len(labels) == 2 else labels
        return f"{_alike(local, draw)}{_more(local, draw, attempt)}@" + ".".join([*[_alike(x, draw) for x in new[:-1]], new[-1]])
    if kind == "ip":
        if attempt >= LENGTHEN:  # addresses kept for documentation, of the longer format
            return "2001:db8:" + ":".join(f"{draw.below(1 << 16):x}" for _ in range(6))
        return ".".join(str(1 + draw.below(223) if i == 0 else draw.below(256)) for i in range(4))
    if kind == "card":
        if not luhn(entity):
            return entity[0] + _alike(entity[1:], draw)
        body = entity[0] + _alike(entity[1:-1], draw)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "hex":
        value = "".join(draw.of("0123456789abcdef") for _ in entity)
        return value if entity == entity.lower() else value.upper()
    if kind == "aws":
        return entity[:4] + "".join(draw.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in entity[4:])
    if kind == "token":
        prefix = re.match(r"gh[pousr]_|sk-|xox[abp]-", entity)[0]
        return prefix + _alike(entity[len(prefix) :], draw) + _more(entity, draw, attempt)
    if kind == "iban":
        body = _alike(entity[4:], draw)
        number = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - number % 97:02d}{body}"
    if kind == "date":
        more = _more("0", draw, attempt - 2)
        return _date(entity, draw, attempt) + (f"-{more}" if more else "")
    if kind == "address":
        number, *_, street = entity.split(" ")
        return f"{_alike(number, draw)}{_more('0', draw, attempt)} {_word(draw, 2 + attempt, 'latin').capitalize()} {street}"
    if kind.startswith(("given", "surname")):
        role, *gender, script = kind.split("_")
        parts = []
        for part in re.split(r"([-'])", entity):
            if part in ("-", "'"):
                parts.append(part)
            elif role == "given":
                parts.append((_word(draw, 1 + attempt, script) + draw.of(ENDINGS[gender[0], script])).capitalize())
            else:
                kept = next((e for e in SURNAME_ENDINGS if part.endswith(e)), "")
                parts.append((_word(draw, 3 + attempt, script) + kept).capitalize())
        return "".join(parts)
    if kind == "secret" and not any(c.isalnum() for c in entity):
        return "".join(draw.of(MARKS) for _ in entity) + "".join(draw.of(MARKS) for _ in _more(entity, draw, attempt))
    if kind == "phone" and entity.startswith("+"):
        return entity[:2] + _alike(entity[2:], draw) + _more("0", draw, attempt)
    return _alike(entity, draw) + _more(entity, draw, attempt)


def _script(word: str) -> str:
    return "cyrillic" if re.search("[а-яёА-ЯЁ]", word) else "latin"


def _found(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Spans of characters with the kind and the normal form of their entity, from left to right."""
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        if m["assign"] is not None:
            yield (*m.span("secret"), "secret", m["secret"])
        elif m["birth"] is not None:
            yield (*m.span("date"), "date", m["date"])
        elif m["named"] is not None or m["full"] is not None:
            words = [(m.start("names") + w.start(), w[0]) for w in re.finditer(r"\S+", m["names"])] if m["named"] is not None else [(m.start() + w.start(), w[0]) for w in re.finditer(r"\S+", m["full"])]
            gender = _TITLE[m["title"]] if m["named"] is not None else _GENDER.get(words[0][1], "n")
            for i, (at, word) in enumerate(words):
                known = _GENDER.get(word)
                first = i < len(words) - 1 or known is not None
                kind = f"given_{known or gender}_{_script(word)}" if first and (known or gender) != "n" else f"surname_{_script(word)}"
                yield at, at + len(word), kind, word
        elif kind == "ip":
            if all(int(x) < 256 for x in m[0].split(".")):
                yield (*m.span(), kind, m[0])
        elif kind in ("card", "ssn"):
            yield (*m.span(), kind, re.sub(r"\D", "", m[0]))
        elif kind == "phone":
            yield (*m.span(), kind, ("+" if m[0].startswith("+") else "") + re.sub(r"\D", "", m[0]))
        elif kind == "iban":
            yield (*m.span(), kind, m[0].replace(" ", ""))
        elif kind == "email":
            yield (*m.span(), kind, m[0].lower())
        else:
            yield (*m.span(), kind, m[0])


Mention = tuple[int, int, str, str]


def _again(text: bytes, mentions: list[Mention]) -> list[Mention]:
    """The mentions, with those of their names that stand alone elsewhere in the text."""
    names: dict[bytes, str] = {}
    for _, _, kind, entity in mentions:
        if kind.startswith(("given", "surname")):
            names.setdefault(entity.encode(), kind)
    if not names:
        return mentions
    inside = rb"A-Za-z0-9_\x80-\xff"
    alone = re.compile(b"(?<![" + inside + b"])(?:" + b"|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + b")(?![" + inside + b"])")
    taken = iter([*mentions, (len(text) + 1, len(text) + 1, "", "")])
    out, (start, end, kind, entity) = [], next(taken)
    for m in alone.finditer(text):
        while end <= m.start():
            out.append((start, end, kind, entity))
            start, end, kind, entity = next(taken)
        if m.end() <= start:
            out.append((*m.span(), names[m[0]], m[0].decode()))
    return [*out, *([(start, end, kind, entity)] if kind else []), *[t for t in taken if t[2]]]


def detect(texts: list[bytes]) -> list[list[Mention]]:
    """For each text its mentions from left to right: start and end in bytes, kind, normal form of the entity."""
    out = []
    for text, stretches in zip(texts, windows(texts), strict=True):
        mentions: list[Mention] = []
        for a, b in stretches:
            part = text[a:b].decode()
            plain = part.isascii()
            for start, end, kind, entity in _found(part):
                lead = start if plain else len(part[:start].encode())
                mentions.append((a + lead, a + lead + (end - start if plain else len(part[start:end].encode())), kind, entity))
        out.append(_again(text, mentions) if mentions else mentions)
    return out


def shaped(raw: str, kind: str, value: str) -> str:
    """The surrogate of a normal form with the marks of this mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(value.lstrip("+"))
        return "".join(next(rest) if c.isalnum() else c for c in raw) + "".join(rest)
    if kind == "email" and raw.isupper():
        return value.upper()
    return value


def replaced(text: bytes, mentions: list[Mention], key: bytes, redrawn: dict[tuple[str, str], int]) -> bytes:
    parts, left = [], 0
    for start, end, kind, entity in mentions:
        value = surrogate(kind, entity, key, redrawn.get((kind, entity), 0))
        parts += [text[left:start], shaped(text[start:end].decode(), kind, value).encode()]
        left = end
    return b"".join([*parts, text[left:]])


_ENTITY = pa.schema([("kind", pa.string()), ("entity", pa.string())])


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: set[tuple[str, str]] = set()
    for batch in batches:
        for _, texts in chunks(batch.column(0)):
            found.update((k, e) for mentions in detect(texts) for _, _, k, e in mentions)
        if len(found) > 200_000:
            yield pa.RecordBatch.from_pylist([{"kind": k, "entity": e} for k, e in found], schema=_ENTITY)
            found = set()
    if found:
        yield pa.RecordBatch.from_pylist([{"kind": k, "entity": e} for k, e in found], schema=_ENTITY)


def _drawn(key: bytes):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, entities, attempts = (batch.column(i).to_pylist() for i in range(3))
            values = [surrogate(k, e, key, a) for k, e, a in zip(kinds, entities, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.string())], names=["kind", "entity", "attempt", "value"])

    return draw


def redraws(entities: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, entity, attempt) for the entities whose first surrogate collides or is a real value of its kind; all names are one kind here.

    Only entities that fail go into a further round. Rounds end: from LENGTHEN on surrogates grow with each of them.
    """
    ddl = "kind string, entity string, attempt int, value string"
    alike = F.when(F.col("kind").startswith("given") | F.col("kind").startswith("surname"), "name").otherwise(F.col("kind")).alias("alike")
    drawn = scratch.save(entities.select("kind", "entity", F.lit(0).alias("attempt")).mapInArrow(_drawn(key), ddl))
    real = entities.select(alike, F.col("entity").alias("value")).distinct()
    for _ in range(MOST_ATTEMPTS):
        rows = drawn.select("*", alike)
        # The earliest attempt keeps a value, then the smallest entity.
        first = rows.groupBy("alike", "value").agg(F.min(F.struct("attempt", "entity", "kind")).alias("keeps"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        twice = rows.join(first, ["alike", "value"]).filter("entity <> keeps.entity or kind <> keeps.kind").select("kind", "entity")
        taken = rows.join(real, ["alike", "value"], "left_semi").select("kind", "entity")
        bad = scratch.save(twice.union(taken).distinct())
        if bad.isEmpty():
            return drawn.filter("attempt > 0").select("kind", "entity", "attempt")
        again = drawn.join(bad, ["kind", "entity"], "left_semi").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_drawn(key), ddl)
        drawn = scratch.save(drawn.join(bad, ["kind", "entity"], "left_anti").union(again))
    raise RuntimeError(f"surrogates still collide after {MOST_ATTEMPTS} attempts")


_OUT = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n_entities", LongType()), StructField("kinds", ArrayType(StringType()))])


def _rewriter(key: bytes, redrawn: dict[tuple[str, str], int], joined: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                found = detect(texts)
                new = batch.column(1).slice(first, len(texts))
                if any(found):
                    none = new.is_null().to_pylist()
                    values = []
                    for i, (text, mentions) in enumerate(zip(texts, found, strict=True)):
                        own = {(x["kind"], x["entity"]): x["attempt"] for x in batch.column(2)[first + i].as_py() or ()} if joined and mentions else redrawn
                        values.append(None if none[i] else replaced(text, mentions, key, own) if mentions else text)
                    new = pa.array(values, pa.binary()).cast(pa.string())
                kinds = [sorted({k.split("_")[0] for _, _, k, _ in mentions}) for mentions in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), new, pa.array([len(x) for x in found], pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=["doc_id", "text", "n_entities", "kinds"]
                )

    return run


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column(0).to_pylist()
        for first, texts in chunks(batch.column(1)):
            rows = [(hashes[first + i], k, e) for i, mentions in enumerate(detect(texts)) for k, e in {(k, e) for _, _, k, e in mentions}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["text_hash", "kind", "entity"])


def pseudonymised(docs: DataFrame, key: str, sent: int = SENT) -> DataFrame:
    """doc_id, text (with surrogates), n_entities (mentions replaced), kinds (found, sorted).

    Null texts stay null and empty ones empty; repeated rows get equal results; texts without entities
    don't change. An empty table gives no rows. Other columns are ignored, whatever their names; doc_id must be
    null or a whole number. ``key`` is the user's secret: who has it can draw the surrogates again.

    Names are found after a title or a known given name, and then wherever they stand in the same text.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    entities = scratch.save(texts.select("text").mapInArrow(_entities, "kind string, entity string").distinct())
    again = scratch.save(redraws(entities, secret, scratch))
    if again.count() <= sent:
        few = {(r.kind, r.entity): r.attempt for r in again.collect()}
        return texts.mapInArrow(_rewriter(secret, few, False), _OUT)
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    mentions = hashed.select("text_hash", "text").mapInArrow(_mentions, "text_hash long, kind string, entity string").distinct()
    lists = mentions.join(again, ["kind", "entity"]).groupBy("text_hash").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("redrawn"))
    return hashed.join(lists, "text_hash", "left").select("doc_id", "text", "redrawn").mapInArrow(_rewriter(secret, {}, True), _OUT)
