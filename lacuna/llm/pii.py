"""PII surrogates: what is detected is replaced by a keyed, made-up value of the same type and format.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, payment-card numbers (Luhn), IBANs
(mod 97), US social-security numbers, access keys and tokens, values after `password=` and the like,
and persons' names after a title or `my name is`, with every later or earlier mention of the name or
of one of its parts in the same text.

A surrogate comes from a keyed permutation of all values of the entity's own format (a Feistel network
over the format's units, cycle-walked), so that within a kind and format different entities always
get different surrogates, the same entity gets the same one in every document, task and run, and none
keeps its value: x goes to P^-1(P(x) + 1). Formats that could meet are kept apart by walking on until
the value is of its own format again. Check digits are computed anew. How a value is written does not
count: numbers are permuted without their separators, addresses without their case, and written as
they were.

Names are replaced part by part, so that `John Smith`, `Smith` and john.smith@ stay one person. A known
first name becomes one of the same gender and script. In other parts runs of consonants are exchanged
for runs that names of the script have, vowels for vowels; Cyrillic endings that tell the gender stay.

Before a text is given out, its surrogates are checked: where two entities would meet in one surrogate,
the later one is moved on (`collide` makes the same check over a whole corpus).

A null text stays null, an empty one empty; texts of any length are read whole, in time proportional to
their length. Repeated rows come out alike. Extra columns are ignored by `mask`, which returns doc_id
(null where it was), text, n_entities and kinds; `mask_column` keeps all columns. Of detectors that
meet in a place the earlier one in DETECTORS goes first. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm._text import blocks

#: Stands in where no key is given; anyone who has it can invert the surrogates, so give a secret one.
KEY = b"lacuna surrogate key: replace in production"
ROUNDS = 8
#: Surrogates that a task remembers.
REMEMBERED = 1 << 15

#: First names by gender and script.
FIRST_NAMES = [
    "Mary Anna Laura Sarah Emma Julia Maria Sofia Elena Claire Alice Ingrid Paula Lucia Nora Helen Carmen Isabel Pilar Marta Sophie Camille Juliette Marie Jeanne Greta Heidi Ursula Sabine Petra Linda Karen Susan Jane Emily Grace Olivia Chloe Diana Rosa".split(),
    "John Peter Paul James Thomas Daniel David Carlos Pedro Pierre Hans Klaus Louis Mark Oscar Henry Robert William Michael George Jorge Miguel Luis Javier Diego Jean Jacques Marcel Antoine Lucas Wolfgang Jürgen Stefan Karl Otto Adam Simon Victor Hugo Felix".split(),
    "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Екатерина Юлия Людмила Галина Вера Нина Дарья Ксения".split(),
    "Иван Пётр Сергей Алексей Дмитрий Андрей Николай Михаил Александр Владимир Борис Олег Павел Егор Антон Игорь".split(),
]
FIRST = {name.lower(): names for names in FIRST_NAMES for name in names}
#: Characters that are exchanged among themselves.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
CLASS_OF = {c: s for s in CLASSES for c in s}
#: Runs of consonants that names begin with, hold and end with.
RUNS = {
    "begin": "bl br ch cl cr dr fl fr gl gr kl kn kr ph pl pr sc sh sk sl sm sn sp st sw th tr tw wh wr бл бр вл гл гр др кл кр пл пр св сл см сп ст тр хл хр".split(),
    "hold": "bb ch ck dd dr ff gg ld ll lm ls lt mb mm mp nd ng nk nn ns nt pp rb rd rg rk rl rm rn rr rs rt sh ss st th tt tr ll бр дн др жн зн кт лл лк нд нк нн рк рн рт ск сл ст тр шк".split(),
    "end": "ch ck ld lf ll lm ls lt mp nd ng nk nn ns nt ph rd rg rk rl rm rn rs rt sh ss st th tt tz".split(),
}
#: Endings of Cyrillic surnames that tell the gender; none is the end of another.
ENDINGS = ("ова", "ева", "ина", "ая", "ов", "ев", "ин", "ий")
HEX = "0123456789abcdef"


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def _iban_check(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _digits_of(value: str) -> str:
    return "".join(c for c in value if c in "0123456789")


def _written(value: str, new: str, kept: Callable[[str], bool]) -> str:
    """The new characters in the places of those that count; the others stay as written."""
    it = iter(new)
    return "".join(next(it) if kept(c) else c for c in value)


def _lower(value: str) -> str:
    """Lower case, character by character, so that the length stays."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in value)


def _units(low: str) -> tuple[list[str], list[Sequence[str]]]:
    """A name's part in lower case as units, and what each is exchanged for."""
    end = next((len(low) - len(e) for e in ENDINGS if low.endswith(e) and len(low) > len(e) + 1), len(low))
    units, pools, at = [], [], 0
    consonant = lambda c: CLASS_OF.get(c, "")[:1] in ("b", "б")
    while at < end:
        to = at + 1
        while consonant(low[at]) and to < end and consonant(low[to]):
            to += 1
        run, pool = low[at:to], RUNS["begin" if at == 0 else "end" if to == len(low) else "hold"]
        if run in pool:
            units.append(run)
            pools.append([r for r in pool if (r < "а") == (run < "а")])
        else:
            units += run
            pools += [CLASS_OF.get(c, "") for c in run]
        at = to
    return units + [low[end:]] * (end < len(low)), pools + [""] * (end < len(low))


class Surrogates:
    """The surrogates of one key."""

    def __init__(self, key: bytes = KEY):
        self.key = hashlib.blake2b(key, digest_size=64).digest()
        self._of = lru_cache(REMEMBERED)(self._make)
        self._subkey = lru_cache(4096)(lambda tag, r: hashlib.blake2b(tag + bytes([r]), key=self.key, digest_size=32).digest())

    def _round(self, tag: bytes, r: int, value: int, size: int) -> int:
        """A keyed number below size."""
        width = (size.bit_length() + 7) // 8 + 8
        out = hashlib.blake2b(value.to_bytes((value.bit_length() + 7) // 8 or 1, "big"), key=self._subkey(tag, r), digest_size=min(64, width)).digest()
        while len(out) < width:
            out += hashlib.blake2b(out, digest_size=64).digest()
        return int.from_bytes(out[:width], "big") % size

    def permute(self, tag: bytes, x: int, n: int, back: bool = False) -> int:
        """A keyed permutation of 0 ... n - 1, or its inverse."""
        half = isqrt(n - 1) + 1
        while True:
            left, right = divmod(x, half)
            for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                if back:
                    left, right = (right - self._round(tag, r, left, half)) % half, left
                else:
                    left, right = right, (left + self._round(tag, r, right, half)) % half
            x = left * half + right
            if x < n:
                return x

    def moved(self, tag: bytes, x: int, n: int) -> int:
        """A keyed permutation that is one cycle of all n values."""
        return self.permute(tag, (self.permute(tag, x, n) + 1) % n, n, back=True)

    def exchange(self, kind: str, units: Sequence[str], pools: Sequence[Sequence[str]]) -> str:
        """Moves the value among all whose units come from the same pools; a unit with an empty pool stays."""
        n, x = 1, 0
        for u, pool in zip(units, pools, strict=True):
            if pool:
                n, x = n * len(pool), x * len(pool) + pool.index(u)
        if n < 2:
            return "".join(units)
        tag = f"{kind}|{'|'.join(pool[0] if pool else u for u, pool in zip(units, pools, strict=True))}|{n}".encode()
        x, out = self.moved(tag, x, n), []
        for u, pool in zip(reversed(units), reversed(pools), strict=True):
            if pool:
                x, k = divmod(x, len(pool))
                u = pool[k]
            out.append(u)
        return "".join(reversed(out))

    def alike(self, kind: str, value: str) -> str:
        """Each letter or digit is exchanged within its class."""
        return self.exchange(kind, value, [CLASS_OF.get(c, "") for c in value])

    def part(self, part: str) -> str:
        """A part of a name."""
        low = _lower(part)
        if names := FIRST.get(low):
            new = names[self.moved(f"first|{names[0]}".encode(), [x.lower() for x in names].index(low), len(names))]
            return new.upper() if part.isupper() else new.lower() if part.islower() else new
        units, pools = _units(low)
        while True:  # known names, and what reads as other units, are formats of their own
            new, at, found = self.exchange("name", units, pools), 0, []
            for u in units:
                found.append(new[at : at + len(u)])
                at += len(u)
            units = found
            if new not in FIRST and _units(new)[1] == pools:
                return "".join(x.upper() if c.isupper() else x for x, c in zip(new, part, strict=True))

    def email(self, value: str) -> str:
        local, _, domain = value.lower().rpartition("@")
        name, _, top = domain.rpartition(".")
        tokens = re.split(r"([^a-z]+)", local)
        between = iter(self.exchange("mail", digits := _digits_of(local), ["0123456789"] * len(digits)))
        local = "".join(self.part(t) if t and not i % 2 else "".join(next(between) if c in "0123456789" else c for c in t) for i, t in enumerate(tokens))
        new = f"{local}@{self.alike('domain', name)}.{top}"
        if value.isupper():
            return new.upper()
        return "".join(c.upper() if o.isupper() else c for c, o in zip(new, value, strict=True)) if len(new) == len(value) else new

    def ip(self, value: str) -> str:
        n, x, groups = 1, 0, []
        for p in map(int, value.split(".")):
            low, high = (0, 10) if p < 10 else (10, 100) if p < 100 else (100, 256)
            groups.append((low, high - low))
            n, x = n * (high - low), x * (high - low) + p - low
        x, out = self.moved(f"ip|{groups}".encode(), x, n), []
        for low, size in reversed(groups):
            x, k = divmod(x, size)
            out.append(str(low + k))
        return ".".join(reversed(out))

    def number(self, kind: str, value: str, keep: int = 0) -> str:
        """The first digits stay; the next one stays zero or not zero."""
        d = _digits_of(value)
        pools = ["" if i < keep else "0123456789" if i > keep else "123456789" if c != "0" else "" for i, c in enumerate(d)]
        return _written(value, self.exchange(kind, d, pools), lambda c: c in "0123456789")

    def phone(self, value: str) -> str:
        country = re.match(r"\+(\d{1,3})[ .-]", value)
        return self.number("phone", value, len(country[1]) if country else 2 if value[0] == "+" else 0)

    def card(self, value: str) -> str:
        """The first digit stays, the last one is the check digit of the rest."""
        d = _digits_of(value)
        body = d[0] + self.exchange(f"card {d[0]}", d[1:-1], ["0123456789"] * (len(d) - 2))
        return _written(value, body + str(-luhn(body + "0") % 10), lambda c: c in "0123456789")

    def iban(self, value: str) -> str:
        plain = value.replace(" ", "")
        body = self.exchange("iban " + plain[:2], plain[4:], [CLASS_OF["0"] if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in plain[4:]])
        return _written(value, plain[:2] + f"{98 - _iban_check(plain[:2] + '00' + body):02d}" + body, lambda c: c != " ")

    def secret(self, value: str) -> str:
        """Numbers, hexadecimal and other values stay among themselves."""
        form = lambda v: 0 if v.isdecimal() else 1 if set(v) <= set(HEX) else 2
        new = value
        while True:
            new = self.exchange("hex", new, [HEX] * len(new)) if form(value) == 1 else self.alike("secret", new)
            if form(new) == form(value):
                return new

    def token(self, value: str, head: int) -> str:
        return value[:head] + self.alike("token " + value[:head], value[head:])

    def _make(self, kind: str, value: str) -> str:
        return {
            "email": self.email, "ip": self.ip, "phone": self.phone, "card": self.card, "iban": self.iban, "secret": self.secret,
            "ssn": lambda v: self.number("ssn", v), "name": lambda v: "".join(t if i % 2 else self.part(t) for i, t in enumerate(_BETWEEN.split(v))),
            "access_key": lambda v: self.token(v, 4), "token": lambda v: self.token(v, _head(v)),
        }[kind](value)

    def of(self, kind: str, value: str) -> str:
        return self._of(kind, value)


def _head(token: str) -> int:
    return (token.rindex("_") if "_" in token else token.index("-")) + 1


def canonical(kind: str, value: str) -> str:
    """What makes two ways to write an entity one."""
    if kind in ("email", "name"):
        return _lower(value)
    return re.sub(r"[^0-9A-Z+]", "", value) if kind in ("phone", "card", "iban", "ssn") else value


_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Don|Doña|г-н|г-жа)\.?|[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo|[Мм]еня зовут"
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][\w'’-]*[^\W\d_]"
#: kind, what a text must hold, pattern (group 1 is the entity, if there is one), further test.
DETECTORS: list[tuple[str, str, re.Pattern, Callable[[str], bool]]] = [
    ("email", "@", re.compile(r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.A), lambda v: True),
    ("access_key", "IA", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"), lambda v: True),
    ("token", "_", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{20,}\b|\b[sprx][kox][a-z]?_(?:live|test)_[A-Za-z0-9]{16,}\b"), lambda v: True),
    ("token", "-", re.compile(r"\b(?:sk|xox[abpr])-[A-Za-z0-9-]{16,}\b"), lambda v: True),
    ("secret", "", re.compile(r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|private[_-]?key)[\"']?\s*[=:]\s*[\"']?([^\s\"'<>,;]{4,})"), lambda v: len(v) >= 8 and any(c.isdigit() for c in v) or len(set(map(CLASS_OF.get, v)) - {None}) > 2),
    ("iban", "", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), lambda v: v.isascii() and _iban_check(v.replace(" ", "")) == 1),
    ("card", "", re.compile(r"(?<![\w.+-])[2-6]\d{3}(?:[ -]?\d){9,15}(?![\w-])", re.A), lambda v: luhn(_digits_of(v)) == 0),
    ("ip", ".", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)", re.A), lambda v: True),
    ("ssn", "-", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A), lambda v: True),
    ("phone", "", re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-]|\.\d)|(?<![\w+])\+\d{9,14}(?!\w)", re.A), lambda v: True),
    ("name", "", re.compile(rf"(?<!\w)(?:{_TITLE})\s+({_CAPITAL}(?: {_CAPITAL})?)"), lambda v: any(c in CLASS_OF for c in v)),
]
_DIGIT = re.compile(r"\d[\d .()-]*\d[\d .()-]*\d")
_NEEDS_DIGITS = {"iban", "card", "ip", "ssn", "phone"}
_BETWEEN = re.compile(r"([ -])")
_WORD = re.compile(r"[^\W\d_][\w'’]*[^\W\d_]")
_POSSESSIVE = re.compile(r"['’][sS](?=[ -]|$)")
_PAIR = re.compile(rf"(?<!\w)(?=({_CAPITAL}) ({_CAPITAL}))")


def _bare(value: str) -> str:
    """A name up to its possessive ending."""
    m = _POSSESSIVE.search(value)
    return value[: m.start()] if m else value


def _mailed(text: str, mails: list[str]) -> set[str]:
    """Parts of the names of two capitalised words that a mail address of the text is made of."""
    owners = [o for o in ({t for t in re.split(r"[\W\d_]+", m.rpartition("@")[0].lower()) if len(t) > 1} for m in mails) if len(o) > 1]
    tokens = set().union(*owners)
    if not tokens:
        return set()
    pairs = ({_bare(p) for p in m.groups()} for m in _PAIR.finditer(text) if _bare(m[1]).lower() in tokens)
    return {p for pair in pairs if len(pair) == 2 and any({x.lower() for x in pair} <= o for o in owners) for p in pair}


def detect(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of each entity, none overlapping; the earlier detector goes first."""
    out: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def take(a: int, b: int, kind: str) -> None:
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\x01" * (b - a)
            out.append((a, b, kind))

    digits = _DIGIT.search(text) is not None
    for kind, needs, pattern, test in DETECTORS:
        if needs not in text or kind in _NEEDS_DIGITS and not digits:
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1 if pattern.groups else 0)
            value = text[a:b]
            if pattern.groups and kind == "secret":
                value = value.rstrip(".)!?")
                b = a + len(value)
            if kind == "name":
                value = _bare(value)
                b = a + len(value)
            if value and test(value):
                take(a, b, kind)
    parts = {p for a, b, kind in out if kind == "name" for p in re.split(r"[ -]", text[a:b]) if len(p) > 1}
    parts |= _mailed(text, [text[a:b] for a, b, kind in out if kind == "email"])
    if parts:  # every other mention
        capitals = {p.upper() for p in parts if len(p) > 2}
        for m in _WORD.finditer(text):
            word = _bare(m[0])
            if word in parts or word in capitals:
                take(m.start(), m.start() + len(word), "name")
    return sorted(out)


def replaced(text: str, surrogates: Surrogates) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and surrogate of each entity; different entities of a kind never share one."""
    owner: dict[tuple[str, str], str] = {}
    out = []
    for a, b, kind in detect(text):
        value = text[a:b]
        new, entity = surrogates.of(kind, value), canonical(kind, value)
        while owner.setdefault((kind, canonical(kind, new)), entity) != entity:
            new = surrogates.of(kind, new)
        out.append((a, b, kind, new))
    return out


def replace(text: str, surrogates: Surrogates | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds found."""
    found = replaced(text, surrogates or Surrogates())
    parts, at = [], 0
    for a, b, _, new in found:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]]), [k for _, _, k, _ in found]


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """doc_id, text, n_entities and kinds of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            for part in blocks(batch, "text"):
                texts, counts, kinds = [], [], []
                for t in part.column(1).to_pylist():
                    new, found = (None, []) if t is None else replace(t, surrogates)
                    texts.append(new)
                    counts.append(len(found))
                    kinds.append(",".join(sorted(set(found))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], ["doc_id", "text", "n_entities", "kinds"])

    pair = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return pair.mapInArrow(run, "doc_id long, text string, n_entities long, kinds string")


def mask_column(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """All columns, the text with surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            for part in blocks(batch, text_col):
                new = pa.array([None if t is None else replace(t, surrogates)[0] for t in part.column(i).to_pylist()], part.schema.field(i).type)
                yield part.set_column(i, part.schema.field(i), new)

    return docs.mapInArrow(run, docs.schema)


def collide(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """kind and surrogate digest of each surrogate that different entities of the corpus share; empty if all is well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        digest = lambda kind, s: hashlib.blake2b(unicodedata.normalize("NFC", canonical(kind, s)).encode(), digest_size=16).digest()
        for batch in batches:
            for part in blocks(batch, "text"):
                rows = {(k, digest(k, t[a:b]), digest(k, new)) for t in part.column(0).to_pylist() if t for a, b, k, new in replaced(t, surrogates)}
                cols = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["kind", "entity", "surrogate"])

    found = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "kind string, entity binary, surrogate binary")
    return found.groupBy("kind", "surrogate").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).where("a <> b").select("kind", "surrogate")
