"""Personal data and secrets replaced by keyed, type-consistent surrogates.

``find`` detects mentions in a text. Every distinct entity, whatever its spelling, has one
surrogate, written in the mention's own format.

Identifiers (addresses, numbers, keys) are permuted inside their own format by a keyed bijection
without fixed points: an entity's form is a number below the size of its format, a Feistel network
permutes those numbers, and a step of one along that permutation gives the surrogate. So distinct
entities have distinct surrogates by construction, in every document, whatever their number; check
digits stay valid, and a domain is the same in every address. Names are drawn: script and gender
stay, and a check over the whole corpus lets no two names share a surrogate and no surrogate be
a name of the corpus; names that fail draw again, longer ones each time, until none does.
"""

from __future__ import annotations

import hmac
from collections.abc import Callable, Iterator
from hashlib import sha256
from ipaddress import IPv4Address, IPv6Address, ip_network
from math import isqrt

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from aislewise.llm.common import map_batches, ship, text_or_empty, unwrapped, wrapped
from aislewise.session import released, stored

COUNTRY = "1"  # calling code of numbers written without one, in groups of 3, 3 and 4 digits

_EMAIL = regex.compile(r"[\p{L}\p{M}\p{N}._%+-]*[\p{L}\p{M}\p{N}_%+-]@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}")
_SECRET = regex.compile(
    r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?"
    r"([A-Za-z0-9+/_-]{16,}={0,2})")
_IBAN = regex.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_IP = regex.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")
_IP6 = regex.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_KEY = regex.compile(r"\b(?:AKIA|ASIA)([0-9A-Z]{16})\b|\bsk-((?:[a-z]+-)?[A-Za-z0-9_-]{20,})|\bgh[pousr]_([A-Za-z0-9]{36})\b")
_CURRENCY = r"(?! ?(?:[€$£¥₹%]|(?i:eur|usd|gbp|inr|euros?|dollars?|dollar|rupees|million)\b))"
#: International; 3-3-4 as in North America; pairs, or an area code with a zero, as in Europe.
_PHONES = [
    ("international", regex.compile(r"(?<![\p{L}\d+])\+(\d{1,3})((?:[ ./-]{0,2}\(?\d{1,8}\)?){1,6})(?!\d)")),
    ("default", regex.compile(r"(?<![\p{L}\d.,(-])(\(\d{3}\) ?|\d{3}[ .-])(\d{3}[ .-]\d{4})(?![\d-])"
                              + _CURRENCY)),
    ("national", regex.compile(r"(?<![\p{L}\d.,-])(0\d(?:[ .]\d{2}){4})(?![\d-])" + _CURRENCY)),
    ("national", regex.compile(r"(?<![\p{L}\d.,-])(0\d{1,4}[ /-]{1,2}\d{3,8}(?:[ -]\d{2,5}){0,2})(?![\d-])"
                               + _CURRENCY)),
    ("cued", regex.compile(r"(?i:\b(?:phone|tel|tel[ée]fono|t[ée]l[ée]phone|telefon|mobile|mobil|fon|"
                           r"call|cell|fax)\b[.:]?\s{0,3}(?:no\.?|nr\.?|number)?\s{0,3})(\d{7,11})(?!\d)"))]
_SSN = regex.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_NUMBER = regex.compile(r"(?<![\p{L}\d])\d(?:[ -]?\d){12,18}(?!\d)")
#: Forms of address by the gender they state.
TITLES = {"m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"],
          "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Госпожа",
                "Κυρία"],
          "n": ["Dr", "Prof"]}
_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
_NAME = regex.compile(r"\b(" + "|".join(sorted(_GENDER, key=len, reverse=True))
                      + r")\b\.?\s(\p{Lu}[\p{L}\p{M}'’-]+(?: \p{Lu}[\p{L}\p{M}'’-]+){0,2})")
#: Given names that begin a person's name without a title, by gender.
GIVEN = {"m": "James John Robert Michael William David Richard Joseph Thomas Daniel Paul Mark George "
              "Peter Alexander Hans Klaus Jürgen Wolfgang Stefan Andreas Pierre Jean Jacques Michel "
              "François Louis José Juan Carlos Luis Miguel Javier Pedro Antonio Иван Пётр Сергей "
              "Γιώργος Νίκος".split(),
         "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma "
              "Laura Julia Maria Ursula Monika Petra Sabine Claudia Marie Jeanne Françoise Isabelle "
              "Nathalie Sophie Carmen Ana Isabel Lucía Elena Ольга Анна Μαρία Ελένη".split()}
_GIVEN = {n: g for g, names in GIVEN.items() for n in names}
_PERSON = regex.compile(r"\b(" + "|".join(sorted(_GIVEN, key=len, reverse=True))
                        + r")((?: \p{Lu}[\p{L}\p{M}'’-]+){1,2})")
_WORD = regex.compile(r"\b\p{Lu}[\p{L}\p{M}'’-]*")
#: Syllables of made-up names by script: consonants, vowels, ending of a female given name.
_SCRIPTS = {"LATIN": ("bdfgklmnprstv", "aeiou", "a"), "CYRILLIC": ("бвгдклмнпрст", "аеиоу", "а"),
            "GREEK": ("βγδκλμνπρστ", "αειου", "α")}


def _luhn(digits: str) -> int:
    """Sum of a card number by the Luhn rule; a valid one is a multiple of ten."""
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return sum(map(int, digits[-1::-2])) + sum(twice)


def _iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def _compact(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


class _Spans:
    """Mentions without overlap; what was added first keeps its place. Each kind adds its own in
    order, so that a merge is one sweep."""

    def __init__(self):
        self.held: list[tuple] = []

    def add(self, found: list[tuple]) -> None:
        out, k = [], 0
        for mention in found:
            while k < len(self.held) and self.held[k][1] <= mention[0]:
                out.append(self.held[k])
                k += 1
            free = (k == len(self.held) or mention[1] <= self.held[k][0]) and (
                not out or out[-1][1] <= mention[0])
            if free and mention[0] < mention[1]:
                out.append(mention)
        self.held = out + self.held[k:]


def _phone(form: str, m: regex.Match) -> tuple | None:
    """A phone mention: its country's code (none where the form does not tell) and national digits."""
    if form == "international":
        country, rest = m[1], _compact(m[2])
        if m[2][:1].isdigit():  # not set apart: a code of one digit for 1 and 7, else of two
            whole = country + rest
            size = 1 if whole[0] in "17" else 2
            country, rest = whole[:size], whole[size:]
        return (*m.span(), "phone", f"{country}-{rest}") if 6 <= len(rest) <= 13 else None
    begin, end = m.span(1)[0], m.end()
    digits = _compact(m[0][begin - m.start():])
    if form == "default":
        return begin, end, "phone", f"{COUNTRY}-{digits}"
    if form == "cued":
        return begin, end, "phone", f"{COUNTRY if len(digits) == 10 else ''}-{digits}"
    return (begin, end, "phone", f"-{digits}") if 8 <= len(digits) <= 13 else None


def _six(text: str) -> IPv6Address | None:
    try:
        return IPv6Address(text)
    except ValueError:
        return None


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """(begin, end, type, canonical form, gender) of the mentions, in order and without overlap.

    The gender is m, f or n for a given name, empty for all else. The work is linear in the text.
    """
    spans = _Spans()
    plain = lambda found: spans.add([(*f, "") for f in found if f])
    if "@" in text:
        plain((*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(text))
    plain((*m.span(1), "secret", m[1]) for m in _SECRET.finditer(text))
    plain((*m.span(m.lastindex), "secret", m[m.lastindex]) for m in _KEY.finditer(text))
    if ":" in text:
        plain((*m.span(), "ip6", _six(m[0]).exploded) for m in _IP6.finditer(text)
              if len(m[0]) > 4 and _six(m[0]))
    if any(c in text for c in "0123456789"):
        plain((*m.span(), "iban", _compact(m[0])) for m in _IBAN.finditer(text)
              if _iban_rest(_compact(m[0])) == 1)
        plain((*m.span(), "ip", ".".join(str(int(x)) for x in m[0].split(".")))
              for m in _IP.finditer(text) if all(int(x) < 256 for x in m[0].split(".")))
        plain((*m.span(), "card" if _luhn(_compact(m[0])) % 10 == 0 else "number", _compact(m[0]))
              for m in _NUMBER.finditer(text))
        plain((*m.span(), "ssn", _compact(m[0])) for m in _SSN.finditer(text))
        for form, pattern in _PHONES:
            plain(_phone(form, m) for m in pattern.finditer(text))
    names: dict[str, tuple[str, str]] = {}
    for pattern, genders in ((_NAME, _GENDER), (_PERSON, _GIVEN)):
        found = []
        for m in pattern.finditer(text):
            group = 2 if pattern is _NAME else 0
            parts = [(p.start(), p[0]) for p in regex.finditer(r"[^ ]+", m[group])]
            for k, (at, part) in enumerate(parts):
                kind = ("surname", "") if k == len(parts) - 1 else ("given", genders[m[1]])
                names.setdefault(part, kind)
                begin = m.start(group) + at
                found.append((begin, begin + len(part), kind[0], part.lower(), kind[1]))
        spans.add(found)
    if names:  # the same name elsewhere in the document, without a title
        upper = {n.upper(): n for n in names}
        found = []
        for m in _WORD.finditer(text):
            name = m[0] if m[0] in names else upper.get(m[0])
            if name:
                found.append((*m.span(), names[name][0], name.lower(), names[name][1]))
        spans.add(found)
    return spans.held


def _draws(key: bytes, kind: str, canonical: str, attempt: int) -> Iterator[int]:
    """Endless small numbers that depend on all arguments."""
    count = 0
    while True:
        yield from hmac.new(key, f"{kind}|{canonical}|{attempt}|{count}".encode(), sha256).digest()
        count += 1


def _script(text: str) -> str:
    import unicodedata
    for c in text:
        name = unicodedata.name(c, "")
        if c.isalpha():
            return next((s for s in _SCRIPTS if name.startswith(s)), "OTHER")
    return "OTHER"


def _round(key: bytes, tweak: str, number: int, value: int) -> int:
    digest = hmac.new(key, f"{tweak}|{number}|{value}".encode(), sha256).digest()
    wide = value.bit_length() // 8 + 8
    while len(digest) < wide + 8:
        digest += sha256(digest).digest()
    return int.from_bytes(digest, "big")


def _feistel(key: bytes, tweak: str, size: int, value: int, back: bool) -> int:
    """A keyed permutation of the numbers below ``size``, or its inverse."""
    a = isqrt(size - 1) + 1  # size <= a * a
    while True:
        left, right = divmod(value, a)
        for k in (range(7, -1, -1) if back else range(8)):
            if back:
                left, right = (right - _round(key, tweak, k, left)) % a, left
            else:
                left, right = right, (left + _round(key, tweak, k, right)) % a
        value = left * a + right
        if value < size:  # what falls outside walks on until it is inside
            return value


def moved(key: bytes, tweak: str, size: int, value: int) -> int:
    """A keyed bijection of the numbers below ``size`` without a fixed point (but for size 1)."""
    if size < 2:
        return value
    at = _feistel(key, tweak, size, value, False)
    return _feistel(key, tweak, size, (at + 1) % size, True)


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _alphabet(c: str) -> str:
    """The characters that may stand for one: those of its kind and case, beyond ASCII those of its
    block of 64. All of them have the same alphabet."""
    if c.isascii():
        return (_DIGITS if c.isdigit() else _LOWER if c.islower() else _LOWER.upper()
                if c.isupper() else c)
    if c.isdecimal():
        zero = ord(c) - int(c)
        return "".join(chr(zero + k) for k in range(10))
    if c.isalpha():
        block = [chr((ord(c) & ~63) | k) for k in range(64)]
        return "".join(x for x in block if x.isalpha() and x.isupper() == c.isupper()
                       and x.islower() == c.islower())
    return c


def permuted(key: bytes, tweak: str, text: str, alphabet: Callable[[str], str] = _alphabet) -> str:
    """A text of the same format: the numbers of its characters in their alphabets, moved."""
    kinds = [alphabet(c) for c in text]
    size, value = 1, 0
    for c, kind in zip(text, kinds, strict=True):
        size, value = size * len(kind), value * len(kind) + kind.index(c)
    value = moved(key, f"{tweak}|{'|'.join(kinds)}", size, value)
    out = []
    for kind in reversed(kinds):
        value, at = divmod(value, len(kind))
        out.append(kind[at])
    return "".join(reversed(out))


#: Address ranges that keep to themselves.
_RANGES = [ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8",
                                   "169.254.0.0/16", "224.0.0.0/4", "0.0.0.0/8")]


def _range(address: IPv4Address) -> int:
    return next((k for k, n in enumerate(_RANGES) if address in n), len(_RANGES))


def domain_surrogate(key: bytes, domain: str) -> str:
    """The last label stays; the others are moved together."""
    labels, _, last = domain.rpartition(".")
    return f"{permuted(key, 'domain|' + last, labels)}.{last}"


def surrogate(key: bytes, kind: str, canonical: str) -> str:
    """The canonical form of an identifier's replacement: one to one within a kind."""
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        return permuted(key, "local|" + domain, local) + "@" + domain_surrogate(key, domain)
    if kind == "secret":
        whole = canonical.rstrip("=")
        hexadecimal = all(c in "0123456789abcdef" for c in whole) or all(
            c in "0123456789ABCDEF" for c in whole)
        own = _DIGITS + ("ABCDEF" if any(c in "ABCDEF" for c in whole) else "abcdef")
        made = permuted(key, "secret", whole, (lambda c: own) if hexadecimal and not
                        whole.isdecimal() else _alphabet)
        return made + canonical[len(whole):]
    if kind == "ip":
        address = IPv4Address(canonical)
        block = _range(address)
        if block < len(_RANGES):
            first, size = int(_RANGES[block][0]), _RANGES[block].num_addresses
            return str(IPv4Address(first + moved(key, f"ip{block}", size, int(address) - first)))
        value = int(address)
        while True:  # a walk along the permutation to the next address outside the ranges
            value = moved(key, "ip", 1 << 32, value)
            if _range(IPv4Address(value)) == block:
                return str(IPv4Address(value))
    if kind == "ip6":
        groups = canonical.split(":")
        used = [k for k, g in enumerate(groups) if int(g, 16)]
        value = 0
        for k in used:
            value = value * 65535 + int(groups[k], 16) - 1
        value = moved(key, "ip6|" + ",".join(map(str, used)), 65535 ** len(used), value)
        for k in reversed(used):
            value, at = divmod(value, 65535)
            groups[k] = f"{at + 1:04x}"
        return ":".join(groups)
    if kind == "phone":
        country, _, digits = canonical.partition("-")
        lead = digits[:1] if digits[:1] == "0" else ""  # a trunk zero stays
        return f"{country}-{lead}{permuted(key, 'phone|' + country, digits[len(lead):])}"
    if kind == "card":
        body = canonical[0] + permuted(key, "card|" + canonical[0], canonical[1:-1])
        return body + str(-_luhn(body + "0") % 10)
    if kind == "iban":
        body = permuted(key, "iban|" + canonical[:2], canonical[4:])
        rest = 98 - _iban_rest(canonical[:2] + "00" + body)
        return f"{canonical[:2]}{rest:02d}{body}"
    return permuted(key, kind, canonical)


def drawn_name(key: bytes, kind: str, canonical: str, gender: str, attempt: int) -> str:
    """A made-up name of the same script and, if it is a given name, gender."""
    draws = _draws(key, kind, canonical, attempt)
    consonants, vowels, female = _SCRIPTS.get(_script(canonical), _SCRIPTS["LATIN"])
    pick = lambda letters: letters[next(draws) % len(letters)]
    # Later draws are longer, so that names never run out.
    name = "".join(pick(consonants) + pick(vowels) for _ in range(2 + attempt // 4))
    return name + pick(consonants) + (female if kind == "given" and gender == "f" else "")


def _grouped(mention: str, replacement: str) -> str:
    """The groups of an IPv6 address in the places of a mention's groups."""
    head, gap, tail = mention.partition("::")
    groups = replacement.split(":")
    left, right = ([g for g in side.split(":") if g] for side in (head, tail))
    short = lambda old, new: f"{int(new, 16):x}".zfill(len(old) if old.startswith("0") else 1)
    front = ":".join(short(o, n) for o, n in zip(left, groups, strict=False))
    back = ":".join(short(o, n) for o, n in zip(right, groups[8 - len(right):], strict=False))
    return front + gap + back


def rendered(mention: str, kind: str, replacement: str) -> str:
    """A surrogate in the format of one mention."""
    if kind == "phone":
        # A mention may lack the country's code.
        country, _, digits = replacement.partition("-")
        count = sum(c.isdigit() for c in mention)
        signs = iter((country + digits)[-count:] if count <= len(country + digits) else digits)
        return "".join(next(signs) if c.isdigit() else c for c in mention)
    if kind in ("card", "number", "ssn", "iban"):
        signs = iter(replacement)
        return "".join(next(signs) if c.isalnum() else c for c in mention)
    if kind == "email":
        return "".join(c.upper() if i < len(mention) and mention[i].isupper() else c
                       for i, c in enumerate(replacement))
    if kind == "ip6":
        return _grouped(mention, replacement)
    if kind in ("given", "surname"):
        return (replacement.upper() if mention.isupper() and len(mention) > 1
                else replacement[:1].upper() + replacement[1:])
    return replacement


NAMES = ("given", "surname")


def mentions(docs: DataFrame, key: bytes) -> DataFrame:
    """(id, text) to one row per mention: id, content (hash of the text), begin, end (characters),
    type, canonical, gender, written, put (its replacement; null for names). Null texts have none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = [], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            for begin, end, kind, canonical, gender in find(text):
                rows.append(k)
                put = None if kind in NAMES else rendered(text[begin:end], kind,
                                                          surrogate(key, kind, canonical))
                found.append((begin, end, kind, canonical, gender, text[begin:end], put))
        columns = list(zip(*found, strict=True)) or [[]] * 7
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at),
             *(pa.array(c, pa.int32()) for c in columns[:2]),
             *(pa.array(c, pa.string()) for c in columns[2:])],
            names=["id", "content", "begin", "end", "type", "canonical", "gender", "written",
                   "put"])

    kind = docs.schema["id"].dataType.simpleString()
    text = text_or_empty("text")
    return map_batches(docs.select("id", F.xxhash64(text).alias("content"), text.alias("text")), run,
                       f"id {kind}, content long, begin int, end int, type string, "
                       "canonical string, gender string, written string, put string")


def name_surrogates(names: DataFrame, key: bytes) -> DataFrame:
    """(type, canonical, gender) of name mentions to (type, canonical, replacement), one to one by
    type, and no replacement is a name of the same type.

    A given name has one gender in the corpus: the one most mentions state, m in a tie. Names that
    collide draw again until none does; every fourth draw is a syllable longer.
    """
    count = lambda g: F.count_if(F.col("gender") == g)
    entities = names.groupBy("type", "canonical").agg(
        F.when(count("f") > count("m"), "f").otherwise("m").alias("gender"))

    @F.pandas_udf("string")
    def drawn(kinds, canonicals, genders, attempts):
        import pandas as pd
        return pd.Series([drawn_name(key, k, c, g, int(a)) for k, c, g, a in zip(
            kinds, canonicals, genders, attempts, strict=True)])

    ship(names.sparkSession)
    draw = drawn("type", "canonical", "gender", "attempt")
    state = stored(entities.withColumn("attempt", F.lit(0)).withColumn("replacement", draw))
    while True:
        # Of those that share a replacement the first keeps it; nobody keeps a name of the corpus.
        taken = state.groupBy("type", "replacement").agg(
            F.count(F.lit(1)).alias("n"), F.min("canonical").alias("owner"))
        real = state.select("type", F.col("canonical").alias("replacement")).withColumn(
            "real", F.lit(True))
        checked = (state.join(taken.where("n > 1"), ["type", "replacement"], "left")
                   .join(real, ["type", "replacement"], "left"))
        again = F.col("real").isNotNull() | (F.coalesce("owner", "canonical") != F.col("canonical"))
        clash = stored(checked.where(again).select("type", "canonical"))
        if clash.isEmpty():
            return state.select("type", "canonical", "replacement")
        redrawn = (state.join(clash, ["type", "canonical"], "left_semi")
                   .withColumn("attempt", F.col("attempt") + 1).withColumn("replacement", draw))
        before, state = state, stored(state.join(clash, ["type", "canonical"], "left_anti")
                                      .unionByName(redrawn))
        released(before)
        released(clash)


def _replaced(text: Column) -> Column:
    """The text with its ``spans`` (begin, end, put) replaced, from the last to the first."""
    return F.aggregate(F.reverse("spans"), text, lambda t, s: F.concat(
        F.substr(t, F.lit(1), s["begin"]), s["put"], F.substr(t, s["end"] + 1)))


def pseudonymise(docs: DataFrame, key: bytes, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """The rows as struct ``row`` with text (replaced), entities (their number) and types.

    Documents without a mention keep their text, null included. Repeated rows and ids are handled
    by their text as well as their id. An empty table gives an empty result. Other columns ride
    along in ``row`` untouched, the original text too.
    """
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = stored(mentions(named, key))
    names = found.where(F.col("put").isNull())
    chosen = name_surrogates(names.select("type", "canonical", "gender"), key)

    @F.pandas_udf("string")
    def put(written, kinds, replacements):
        import pandas as pd
        return pd.Series([rendered(w, k, r) for w, k, r in zip(
            written, kinds, replacements, strict=True)])

    columns = ["id", "content", "begin", "end", "put", "type"]
    renamed = names.distinct().join(chosen, ["type", "canonical"]).withColumn(
        "put", put("written", "type", "replacement")).select(columns)
    spans = (found.where(F.col("put").isNotNull()).select(columns).distinct().unionByName(renamed)
             .groupBy("id", "content").agg(
                 F.sort_array(F.collect_list(F.struct("begin", "end", "put", "type")))
                 .alias("spans")))
    text = F.col(f"row.`{text_column}`")
    rows = wrapped(docs).withColumn("content", F.xxhash64(text_or_empty(text)))
    joined = rows.alias("d").join(
        spans.alias("s"), F.col(f"d.row.`{id_column}`").eqNullSafe(F.col("s.id"))
        & (F.col("d.content") == F.col("s.content")), "left").select("row", "spans")
    return joined.select(
        "row", F.when(F.col("spans").isNull(), text).otherwise(_replaced(text)).alias("text"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("entities"),
        F.coalesce(F.array_sort(F.array_distinct(F.col("spans.type"))),
                   F.array().cast("array<string>")).alias("types"))


def redact(docs: DataFrame, key: bytes, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """The documents with their texts replaced, all other columns as they were."""
    found = pseudonymise(docs, key, id_column, text_column)
    return unwrapped(found.withColumn("row", F.struct(*[
        (F.col("text") if c == text_column else F.col(f"row.`{c}`")).alias(c)
        for c in docs.columns])), docs.columns)
