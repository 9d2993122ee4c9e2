"""Pseudonyms for personal data by format-preserving Feistel permutations.

Values are found by pattern and validated (check digits, ranges of numbers, calendar); each is then permuted by a keyed
Feistel network over all values of its own format: a card number becomes another card number with a right check digit, a date
another date written alike. A permutation depends on key and format only, so equal values get equal pseudonyms in every
document, however they are spaced, and different values different ones. Permutations over sizes that are no power of two walk
on until they are inside. Lengths in characters never change. Dates stay within their part of a month and of a year (days to 9,
to 12, from 13; months to 9, from 10), so that one date has one pseudonym in all numeric formats, padded or not, and with short
month names; long names keep their length and are linked among themselves. Letters and digits of emails, secrets and IBANs are
permuted in stretches of at most CHUNK. Phone numbers with a plus sign keep their country code, known by its first digits.

Kinds: email (local part), iban, ip, card, ssn, phone, date, and secret (values of password, token, key assignments).
Where a match isn't valid, shorter ones that end between its groups are tried, then later starts; what is valid nowhere is left
alone. Dates are numbers, or a day, an English month name (or its first three letters) and a year. Digits are ASCII ones. What
follows a word for a version or section is no address.

Nulls and odd rows: a null text stays null with no finds. Every row is handled by itself: null ids, ties, repeated rows
and very long texts need nothing special (time grows with their length). Extra columns pass through `pseudonymise`; ones named n_found or found give way.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidebar.llm.common import table

#: For tests and examples only: whoever has the key can undo the pseudonyms.
EXAMPLE_KEY = b"tidebar example key"
ROUNDS = 8
CHUNK = 64
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FIRST, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def permuted(x: int, size: int, key: bytes, kind: str, inverse: bool = False) -> int:
    """The keyed permutation of 0..size-1 for a kind of value: a balanced Feistel network, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    salt = f"{kind}:{size}".encode()

    def mixed(i: int, value: int) -> int:
        told = salt + bytes([i]) + value.to_bytes(width, "big")
        made = b"".join(blake2b(told + bytes([j]), key=key[:64], digest_size=min(64, width - 64 * j)).digest() for j in range((width + 63) // 64))
        return int.from_bytes(made, "big") & mask

    while True:
        a, b = x >> half, x & mask
        for i in range(ROUNDS)[:: -1 if inverse else 1]:
            a, b = (b ^ mixed(i, a), a) if inverse else (b, a ^ mixed(i, b))
        x = a << half | b
        if x < size:
            return x


def _digits(found: str) -> str:
    return "".join(c for c in found if c in _DIGITS)


def _refill(found: str, new: str) -> str:
    """The letters and digits of new in the places of those of found."""
    own = iter(new)
    return "".join(next(own) if c.isalnum() else c for c in found)


def _walk(digits: str, key: bytes, kind: str, valid: Callable[[str], bool]) -> str:
    """Permutes a string of digits until it is valid again."""
    x = int(digits)
    while True:
        x = permuted(x, 10 ** len(digits), key, kind)
        if valid(out := str(x).zfill(len(digits))):
            return out


def luhn_digit(body: str) -> str:
    doubled = [sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body))]
    return str(-sum(doubled) % 10)


def _card(found: str, key: bytes) -> str | None:
    n = _digits(found)
    if not 13 <= len(n) <= 19 or luhn_digit(n[:-1]) != n[-1] or len(set(n)) == 1:
        return None
    body = str(permuted(int(n[:-1]), 10 ** (len(n) - 1), key, "card")).zfill(len(n) - 1)
    return _refill(found, body + luhn_digit(body))


def _by_class(value: str, key: bytes, kind: str) -> str:
    """Permutes letters and digits, each within its own class and case; other characters stay."""
    return "".join(_chunk(value[i : i + CHUNK], key, f"{kind}:{i}" if i else kind) for i in range(0, len(value), CHUNK))


def _chunk(value: str, key: bytes, kind: str) -> str:
    sets = [next((s for s in (_DIGITS, _LOWER, _UPPER) if c in s), None) for c in value]
    x, size = 0, 1
    for c, s in zip(value, sets, strict=True):
        if s:
            x, size = x * len(s) + s.index(c), size * len(s)
    if size == 1:
        return value
    shape = "".join("-" if s is None else s[0] for s in sets)
    x, out = permuted(x, size, key, f"{kind}:{shape}"), []
    for c, s in zip(reversed(value), reversed(sets), strict=True):
        if s:
            x, i = divmod(x, len(s))
            c = s[i]
        out.append(c)
    return "".join(reversed(out))


def _email(found: str, key: bytes) -> str | None:
    local, at, domain = found.rpartition("@")
    return _by_class(local, key, "email") + at + domain


def _secret(found: str, key: bytes) -> str | None:
    return _by_class(found, key, "secret") if re.search("[0-9]", found) else None


def _iban_digits(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return str(98 - int(number) % 97).zfill(2)


def _iban(found: str, key: bytes) -> str | None:
    n = found.replace(" ", "")
    if not 15 <= len(n) <= 34 or _iban_digits(n[:2], n[4:]) != n[2:4]:
        return None
    rest = _by_class(n[4:], key, "iban:" + n[:2])
    return _refill(found, n[:2] + _iban_digits(n[:2], rest) + rest)


def _ip(found: str, key: bytes) -> str | None:
    parts = found.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    # Walks among the addresses whose numbers have as many digits each, so that the text keeps its length.
    low = [{1: 0, 2: 10, 3: 100}[len(p)] for p in parts]
    span = [{1: 10, 2: 90, 3: 156}[len(p)] for p in parts]
    x = size = 0
    size = 1
    for p, a, n in zip(parts, low, span, strict=True):
        x, size = x * n + int(p) - a, size * n
    x, out = permuted(x, size, key, "ip:" + ".".join(str(len(p)) for p in parts)), []
    for a, n in zip(reversed(low), reversed(span), strict=True):
        x, i = divmod(x, n)
        out.append(str(a + i))
    return ".".join(reversed(out))


def _valid_ssn(n: str) -> bool:
    return n[:3] not in ("000", "666") and n[0] != "9" and n[3:5] != "00" and n[5:] != "0000"


def _ssn(found: str, key: bytes) -> str | None:
    n = _digits(found)
    return _refill(found, _walk(n, key, "ssn", _valid_ssn)) if _valid_ssn(n) else None


def _phone(found: str, key: bytes) -> str | None:
    n = _digits(found)
    plus = found.startswith("+")
    lead = len(n) - 10 if not plus or n.startswith("1") else -1
    if lead in (0, 1):
        # Area codes that aren't given out (from 0 or 1) count only where the plus sign says that it is a number; they stay among themselves.
        own, odd = n[lead:], n[lead] in "01"
        if odd and not plus or own[3] in "01" or n[:lead] not in ("", "1"):
            return None
        return _refill(found, n[:lead] + _walk(own, key, "phone", lambda x: (x[0] in "01") == odd and x[3] not in "01"))
    if not plus or not 8 <= len(n) <= 15 or n[0] in "01":
        return None
    keep = 1 if n[0] == "7" else 2 if n[:2] in TWO_DIGIT_CODES else 3
    return _refill(found, n[:keep] + _walk(n[keep:], key, "phone:" + n[:keep], lambda x: True))


def _part(d: date) -> tuple[int, int]:
    """Part of the month and of the year; a date's pseudonym stays in both."""
    return (d.day > 9) + (d.day > 12), int(d.month > 9)


@lru_cache
def _days(part: tuple[int, int], months: tuple[int, ...] = ()) -> list[date]:
    """The dates of a part, or of some months."""
    every = map(date.fromordinal, range(_FIRST, _FIRST + _DAYS))
    return [d for d in every if _part(d) == part and (not months or d.month in months)]


def _other_day(d: date, key: bytes, months: tuple[int, ...] = ()) -> date | None:
    if not 0 <= d.toordinal() - _FIRST < _DAYS:
        return None
    days = _days(_part(d), months)
    kind = "date:" + ":".join(map(str, (*_part(d), *months)))
    return days[permuted(bisect_left(days, d), len(days), key, kind)]


def _date(found: str, key: bytes) -> str | None:
    """Year first, or day and month first; what could be either is read month first with slashes, else day first."""
    parts = re.split(r"[-/.]", found)
    a, b, c = map(int, parts)
    if len(parts[0]) == 4:
        order = "ymd"
    else:
        order = "dmy" if a > 12 or "/" not in found and b <= 12 else "mdy"
    at = dict(zip(order, (a, b, c), strict=True))
    try:
        new = _other_day(date(at["y"], at["m"], at["d"]), key)
    except ValueError:
        return None
    if new is None:
        return None
    marks = iter([*re.findall(r"[-/.]", found), ""])
    return "".join(str({"y": new.year, "m": new.month, "d": new.day}[k]).zfill(len(p)) + next(marks) for k, p in zip(order, parts, strict=True))


_MONTHS = "January February March April May June July August September October November December".split()


def _named_date(found: str, key: bytes) -> str | None:
    """Another date with a month name as long as its own, in the same case; May counts as shortened."""
    name = re.search(r"[A-Za-z]{3,}", found)[0]
    names = [x[:3] if len(name) == 3 else x for x in _MONTHS]
    day, year = (x for x in re.findall(r"[0-9]+", found))
    same = tuple(i + 1 for i, x in enumerate(names) if len(x) == len(name)) if len(name) > 3 else ()
    try:
        d = _other_day(date(int(year), [x.lower() for x in names].index(name.lower()) + 1, int(day)), key, same)
    except ValueError:
        return None
    if d is None:
        return None
    case = str.upper if name.isupper() else str.lower if name.islower() else str.title
    parts = {name: case(names[d.month - 1]), year: str(d.year)}
    return re.sub(r"[A-Za-z]{3,}|[0-9]{4}|[0-9]{1,2}", lambda m: parts.get(m[0], str(d.day).zfill(len(day))), found)


# The country codes of two digits; of the others 1 and 7 have one, the rest three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: What stands before a number of a version or section, not before an address.
_NUMBERED = re.compile(r"(?i)\b(?:version|ver|release|build|firmware|section|chapter|clause|v|rev)[.:]?\s*$")
KINDS: tuple[tuple[str, re.Pattern, Callable[[str, bytes], str | None]], ...] = (
    ("secret", re.compile(r"(?i:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?()([A-Za-z0-9_\-]{8,})"), _secret),
    ("email", re.compile(r"(?<![\w.+%-])()([A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"), _email),
    ("iban", re.compile(r"(?<!\w)()([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"), _iban),
    ("ip", re.compile(r"(?<![\w.])()((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?!\.?[0-9])"), _ip),
    ("date", re.compile(r"(?<![0-9./-])()([0-9]{4}([-/.])[0-9]{1,2}\3[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\4[0-9]{4})(?![0-9/-]|\.[0-9])"), _date),
    ("date", re.compile(r"(?i)(?<![\w./-])()([0-9]{1,2} (?:MONTHS),? [0-9]{4}|(?:MONTHS) [0-9]{1,2},? [0-9]{4})(?!\w)".replace("MONTHS", "|".join([*_MONTHS, *(x[:3] for x in _MONTHS)]))), _named_date),
    ("card", re.compile(r"(?<![0-9+])()([0-9](?:[ -]?[0-9]){12,18})(?![0-9])"), _card),
    ("ssn", re.compile(r"(?<![0-9-])()([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"), _ssn),
    ("phone", re.compile(r"(?<![\w+])()((?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])"), _phone),
    ("phone", re.compile(r"(?<![\w+])()(\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6})(?![0-9])"), _phone),
)
GROUPED = frozenset(["card", "iban", "phone"])
_SOME = re.compile(r"[0-9@]")


@lru_cache(1 << 16)
def _new(kind: int, found: str, key: bytes) -> str | None:
    return KINDS[kind][2](found, key)


def replace(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and kind and span of each; spans hold in either text."""
    if not _SOME.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []  # in order, and none over another
    for i, (kind, pattern, _) in enumerate(KINDS):
        at = 0
        while m := pattern.search(text, at):
            a, b = m.span(2)
            at = m.start() + 1
            if kind == "ip" and _NUMBERED.search(text, max(0, a - 12), a):
                continue
            here = bisect_left(found, (a,))
            free = here == 0 or found[here - 1][1] <= a
            to = found[here][0] if here < len(found) else len(text)
            while m:
                if free and m.end(2) <= to and (new := _new(i, m[2], key)) is not None:
                    insort(found, (a, m.end(2), kind, new))
                    at = max(at, m.end())
                    break
                # The last border between groups before the end of this match; other kinds have no groups to leave out.
                b = max(text.rfind(" ", a, b), text.rfind("-", a, b)) if kind in GROUPED else -1
                m = pattern.match(text, m.start(), b) if b > a else None
    parts, at = [], 0
    for a, b, _, new in found:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]]), [{"kind": k, "start": a, "end": b} for a, b, k, _ in found]


def pseudonymise(docs: DataFrame, key: bytes = EXAMPLE_KEY, report: bool = True) -> DataFrame:
    """The documents with pseudonyms in their texts; with report also n_found and found (kind and span of each)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    added = [T.StructField("n_found", T.LongType()), T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))] if report else []
    kept = [f for f in docs.schema.fields if f.name not in [x.name for x in added]]
    schema = T.StructType([*kept, *added])

    def run(batches):
        for b in batches:
            texts, n, spans = [], [], []
            for x in b.column("text"):
                text = x.as_py()
                new, at = (None, []) if text is None else replace(text, key)
                texts.append(new)
                n.append(len(at))
                spans.append(at)
            own = {"text": pa.array(texts, pa.string()), "n_found": pa.array(n, pa.int64()), "found": pa.array(spans, pa.list_(span))}
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name == "text" or f in added else b.column(f.name) for f in schema], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
