"""Pseudonyms for personal data that keep its format and stay linked across documents.

Numbers and dates are first validated (check digits, octets, calendar), then ranked within the set of
all valid values of their format and moved by a keyed Feistel permutation of that set. The permutation
depends on key, kind and format alone, so equal values get equal pseudonyms in every document, two
values never share one, and the holder of the key can invert it.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table

ROUNDS = 8


class Feistel:
    """A keyed permutation of ``range(n)``: a balanced Feistel network with cycle walking."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, i: int, half: int, mask: int) -> int:
        digest = hashlib.blake2b(f"{tweak}|{i}|{half}".encode(), key=self.key, digest_size=16).digest()
        return int.from_bytes(digest, "big") & mask

    def _once(self, x: int, bits: int, tweak: str, order: range) -> int:
        mask = (1 << bits) - 1
        left, right = x >> bits, x & mask
        for i in order:
            left, right = right, left ^ self._round(tweak, i, right, mask)
        return right << bits | left

    def forward(self, x: int, n: int, tweak: str) -> int:
        return self._walk(x, n, tweak, range(ROUNDS))

    def backward(self, x: int, n: int, tweak: str) -> int:
        return self._walk(x, n, tweak, range(ROUNDS - 1, -1, -1))

    def _walk(self, x: int, n: int, tweak: str, order: range) -> int:
        if n < 2:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, bits, tweak, order)
            if x < n:
                return x


def _mixed(digits: list[int], radices: list[int]) -> int:
    value = 0
    for d, r in zip(digits, radices, strict=True):
        value = value * r + d
    return value


def _unmixed(value: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        value, d = divmod(value, r)
        out.append(d)
    return out[::-1]


def _product(radices: list[int]) -> int:
    n = 1
    for r in radices:
        n *= r
    return n


def luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _refill(shape: str, digits: list[int]) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(str(next(it)) if c.isdigit() else c for c in shape)


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c.isdigit()]


def card(text: str, move: Callable[[int, int, str], int]) -> str | None:
    """13 to 19 digits with a valid Luhn check digit; the first digit (the network) stays."""
    d = _digits(text)
    if not 13 <= len(d) <= 19 or d[0] == 0 or len(set(d)) == 1 or not luhn(d):
        return None
    radices = [10] * (len(d) - 2)
    body = _unmixed(move(_mixed(d[1:-1], radices), _product(radices), f"card{len(d)}{d[0]}"), radices)
    check = next(c for c in range(10) if luhn([d[0], *body, c]))
    return _refill(text, [d[0], *body, check])


#: Country codes of one and two digits; all others have three.
_ONE, _TWO = "[17]", "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_CODE = re.compile(f"{_ONE}|{_TWO}|[0-9]{{3}}")


def _moved(text: str, d: list[int], keep: int, move: Callable[[int, int, str], int], tweak: str) -> str:
    radices = [10] * (len(d) - keep)
    return _refill(text, d[:keep] + _unmixed(move(_mixed(d[keep:], radices), _product(radices), tweak), radices))


def phone(text: str, move: Callable[[int, int, str], int]) -> str | None:
    """Ten digits in the North American format; a country code stays."""
    d = _digits(text)
    return _moved(text, d, len(d) - 10, move, "phone")


def international(text: str, move: Callable[[int, int, str], int]) -> str | None:
    """A country code and up to 15 digits in all; the code and a trunk zero in brackets stay."""
    d = _digits(text)
    zeros = 2 if text[0] == "0" else 0
    code = _CODE.match("".join(map(str, d[zeros:])))[0]
    keep = zeros + len(code) + ("(0)" in text)
    n = len(d) - keep
    return _moved(text, d, keep, move, "phone" if code == "1" and n == 10 else f"phone{code}.{n}")


def ssn(text: str, move: Callable[[int, int, str], int]) -> str | None:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = map(int, re.split(r"[- ]", text))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    radices = [898, 99, 9999]
    a, g, s = _unmixed(move(_mixed([area - 1 - (area > 666), group - 1, serial - 1], radices), _product(radices), "ssn"), radices)
    return f"{a + 1 + (a >= 665):03d}{text[3]}{g + 1:02d}{text[6]}{s + 1:04d}"


def ip(text: str, move: Callable[[int, int, str], int]) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    return ".".join(map(str, _unmixed(move(_mixed([int(p) for p in parts], [256] * 4), 256**4, "ip"), [256] * 4)))


def iban(text: str, move: Callable[[int, int, str], int]) -> str | None:
    """Country stays, account characters move within their classes, check digits are made anew (modulo 97)."""
    flat = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = flat[4:]
    radices = [10 if c.isdigit() else 26 for c in body]
    values = [int(c) if c.isdigit() else ord(c) - 65 for c in body]
    out = _unmixed(move(_mixed(values, radices), _product(radices), "iban" + flat[:2] + "".join("d" if r == 10 else "a" for r in radices)), radices)
    body = "".join(str(v) if r == 10 else chr(65 + v) for v, r in zip(out, radices, strict=True))
    flat = flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body
    it = iter(flat)
    return "".join(c if c == " " else next(it) for c in text)


#: Characters of an IBAN by country, fixed values of the public registry.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
    "GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 "
    "PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)
_LENGTHS = {x[:2]: int(x[2:]) for x in IBAN_LENGTHS.split()}


def iban_readings(text: str) -> list[str]:
    """What may be an account number in a match that can hold words after it: it up to a blank or its end, the country's own length first."""
    ends = [i for i, c in enumerate(text) if c == " "] + [len(text)]
    own = _LENGTHS.get(text[:2])
    return sorted((text[:e] for e in ends), key=lambda x: (len(x.replace(" ", "")) != own, -len(x)))


FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date_kind(day: datetime.date) -> tuple[bool, bool, bool]:
    """What must not change, so that a pseudonym is read as its date was, in every format and with as many digits."""
    return day.day < 10, day.day > 12, day.month < 10


def date(text: str, move: Callable[[int, int, str], int]) -> str | None:
    """Real dates from 1900 to 2099: year first, or day and month before the year (the reading that is valid, day first on a tie).

    A date gets the same pseudonym however it is written.
    """
    parts = re.split(r"[-/.]", text)
    orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy")
    for order in orders:
        try:
            at = {k: int(v) for k, v in zip(order, parts, strict=True)}
            day = datetime.date(at["y"], at["m"], at["d"]).toordinal()
        except ValueError:
            continue
        if FIRST <= day <= LAST:
            widths = {k: len(v) for k, v in zip(order, parts, strict=True)}
            kind = _date_kind(datetime.date.fromordinal(day))
            while True:
                day = FIRST + move(day - FIRST, LAST - FIRST + 1, "date")
                new = datetime.date.fromordinal(day)
                if _date_kind(new) == kind:
                    break
            values = {"y": new.year, "m": new.month, "d": new.day}
            return text[len(parts[0])].join(f"{values[k]:0{widths[k]}d}" for k in order)
    return None


def email(text: str, move: Callable[[int, int, str], int]) -> str | None:
    """ASCII letters and digits of the local part move within their classes; other letters and the rest of the address stay."""
    local, _, domain = text.partition("@")
    radices = [10 if c.isdigit() else 26 for c in local if c.isascii() and c.isalnum()]
    if not radices:
        return None
    chars = [c for c in local if c.isascii() and c.isalnum()]
    shape = "".join("d" if c.isdigit() else "A" if c.isupper() else "a" for c in chars)
    values = [int(c) if c.isdigit() else ord(c.lower()) - 97 for c in chars]
    out = iter(zip(_unmixed(move(_mixed(values, radices), _product(radices), f"email{shape}@{domain.lower()}"), radices), shape, strict=True))

    def put(c: str) -> str:
        if not (c.isascii() and c.isalnum()):
            return c
        v, kind = next(out)
        return str(v) if kind == "d" else chr((65 if kind == "A" else 97) + v)

    return "".join(map(put, local)) + "@" + domain


#: In the order in which they claim text.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("email", r"[^\W_][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("iban", r"(?<![A-Za-z0-9])(?=(?P<g>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])))[A-Z]", iban),
    ("card", r"(?<![A-Za-z0-9])[1-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])", card),
    ("ssn", r"(?<![A-Za-z0-9-])[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![A-Za-z0-9-])", ssn),
    ("phone", r"(?<![A-Za-z0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])", phone),
    ("ip", r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])", ip),
    ("date", r"(?<![A-Za-z0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?:(?=[Tt][0-9]{2}|[Zz](?![A-Za-z0-9]))|(?![A-Za-z0-9]|[./-][0-9]))", date),
)


_SHAPES = r"[0-9]{4}[-/.][0-9]{1,2}[-/.]|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}(?![0-9])|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"


def _national(least: int, most: int) -> str:
    """So many digits with separators; a date or an IP address after a blank isn't part of them."""
    sep = rf"(?:[   ](?!{_SHAPES})|[./-])?"
    return rf"(?:{sep}\(0\))?(?:{sep}\((?=[0-9]{{2,5}}\){sep}[0-9]))?(?:{sep}[0-9]\)?){{{least},{most}}}"


#: Phones with '+' or 00 before a country code, 8 to 15 digits in all; after 00 a separator must follow the code.
INTERNATIONAL = (
    "phone",
    rf"(?<![A-Za-z0-9+])(?!00[17][ .-][0-9]{{3}}[ .-][0-9]{{4}}(?![0-9]))(?:\+ ?|(?<![0-9][ .-])00(?=(?:{_ONE}|{_TWO}|[0-9]{{3}})[   ./(-]))"
    rf"(?:{_ONE}{_national(10, 10)}|(?:{_TWO}){_national(6, 13)}|(?!{_ONE}|{_TWO})[2-9][0-9]{{2}}{_national(5, 12)})(?![A-Za-z0-9])",
    international,
)
#: Cards in their usual groups beside other digits, which the longer reading of ``KINDS`` would take in; any two may overlap.
GROUPED = ("card", r"(?=(?P<g>(?<![A-Za-z0-9])[1-9](?:[0-9]{3}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,4}(?:\2[0-9]{3})?|[0-9]{3}([ -])[0-9]{6}\3[0-9]{5}|[0-9]{12,18})(?![A-Za-z0-9])))[1-9]", card)
_PATTERNS = [(name, re.compile(pattern), f) for name, pattern, f in (*KINDS[:2], INTERNATIONAL, KINDS[2], GROUPED, *KINDS[3:])]
_ANY = re.compile("[0-9@]")


def pseudonymise(text: str, move: Callable[[int, int, str], int]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and the spans (code points of the input, end exclusive) that were replaced."""
    if not _ANY.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []  # in order, none overlapping
    for name, pattern, f in _PATTERNS:
        group = "g" if "g" in pattern.groupindex else 0
        for m in pattern.finditer(text):
            start = m.start(group)
            for part in iban_readings(m[group]) if name == "iban" else (m[group],):
                end = start + len(part)
                at = bisect.bisect_left(found, (end,))
                if (at == 0 or found[at - 1][1] <= start) and (new := f(part, move)) is not None:
                    found.insert(at, (start, end, name, new))
                    break
    if not found:
        return text, []
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(k, a, b) for a, b, k, _ in found]


COUNTS = tuple(f"n_{name}" for name, _, _ in KINDS)
SCHEMA = "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "n_pii long, spans string, text string"


def mask_pii(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every whole text with validated personal data replaced by pseudonyms: counts by kind, spans and the new text.

    A null text stays null with no spans; an empty one stays empty. Rows are independent: repeated rows
    give repeated results, a null id stays null, an empty table gives an empty one, and other columns are
    not read. Where two kinds claim the same characters, the kind that stands first in ``KINDS`` has them,
    but ``INTERNATIONAL`` phones come before cards. A very long text is read whole.
    """
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move = lru_cache(maxsize=1 << 16)(Feistel(key).forward)
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(1).to_pylist():
                new, found = (None, []) if text is None else pseudonymise(text, move)
                texts.append(new)
                spans.append(found)
            counts = [pa.array([sum(k == name for k, _, _ in s) for s in spans], pa.int64()) for name, _, _ in KINDS]
            columns = [batch.column(0), *counts, pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in spans], pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "n_pii", "spans", "text"])

    return docs.selectExpr(f"cast({id_column} as long) doc_id", f"{text_column} text").mapInArrow(scan, SCHEMA)


#: For the query alone; a real run passes its own secret.
QUERY_KEY = b"a key for the registered query"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_pii(table(spark, sf_dir, "documents"), QUERY_KEY)
