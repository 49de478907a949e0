"""Format-preserving pseudonyms of personal data.

What is found is validated (Luhn sums, IBAN check digits, octets, calendar days,
numbering rules), ranked within the set of all values of its format, permuted
there by a keyed Feistel network with cycle walking, and written in the same
format: card numbers stay Luhn-valid, IBANs keep valid check digits, dates stay
calendar days, phone numbers keep their country, addresses keep their domain and
their pattern of letters and digits. The permutation is one-to-one and depends
on the key and the kind only, so equal values stay linked across documents,
however they are spelt, and different ones stay different. Numbers that fail
validation are left as they are.

Dates of days up to the twelfth and later ones are permuted apart: a date in
numbers so has a pseudonym that is read in the same order of day and month (day
first, where both can be). IPv6 addresses are written in their short form.

Null texts stay null; texts without findings come back unchanged. Where
findings overlap the earlier kind of ``KINDS`` wins. Repeated rows are rewritten
alike; an empty table gives an empty one. Time grows with a text's length.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm import _io

KINDS = ("email", "iban", "ip", "card", "ssn", "phone", "date")
ROUNDS = 10
#: Key of the registered query; users pass their own.
DEMO_KEY = b"demonstration key, not a secret"

_EVERY_DAY = range(datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal())
#: Days up to the twelfth of a month, and later ones.
_DAYS = tuple([d for d in _EVERY_DAY if (datetime.date.fromordinal(d).day > 12) == late] for late in (False, True))
_RANK = {d: i for days in _DAYS for i, d in enumerate(days)}
# Country codes of one and two digits; the others have three.
_ONE_DIGIT = ("1", "7")
_TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Alphabets within which a character is replaced.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])), "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)])))
_PLACE = {c: (alphabet, i) for alphabet in _ALPHABETS for i, c in enumerate(alphabet)}


class Feistel:
    """A keyed permutation of range(n) for any n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, i: int, kind: str, n: int, half: int, side: int) -> int:
        size = min(64, (side.bit_length() + 7) // 8 + 8)
        seed = b"%d:%s:%d:%d" % (i, kind.encode(), n, half)
        out = b"".join(hashlib.blake2b(seed + b":%d" % j, key=self.key, digest_size=size).digest() for j in range(-(-(side.bit_length() // 8 + 8) // size)))
        return int.from_bytes(out) % side

    def permute(self, x: int, n: int, kind: str, back: bool = False) -> int:
        if n < 2:
            return x
        side = isqrt(n - 1) + 1
        while True:
            a, b = divmod(x, side)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    a, b = (b - self._round(i, kind, n, a, side)) % side, a
                else:
                    a, b = b, (a + self._round(i, kind, n, b, side)) % side
            x = a * side + b
            if x < n:
                return x


def _masked(text: str, feistel: Feistel, kind: str, back: bool = False) -> str:
    """Characters of known alphabets permuted together, the others kept."""
    places = [_PLACE.get(c) for c in text]
    radices = [len(p[0]) for p in places if p]
    rank = 0
    for p in places:
        if p:
            rank = rank * len(p[0]) + p[1]
    rank = feistel.permute(rank, prod(radices), kind + "".join(str(_ALPHABETS.index(p[0])) if p else "-" for p in places), back)
    out = []
    for c, p in zip(reversed(text), reversed(places), strict=True):
        if p:
            rank, i = divmod(rank, len(p[0]))
            c = p[0][i]
        out.append(c)
    return "".join(reversed(out))


def _refill(shape: str, digits: str) -> str:
    supply = iter(digits)
    return "".join(next(supply) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn_digit(payload: str) -> int:
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(payload))))
    return -total % 10


def _card(text: str, feistel: Feistel, back: bool) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]):
        return None
    payload = _masked(digits[:-1], feistel, "card", back)
    return _refill(text, payload + str(luhn_digit(payload)))


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _iban(text: str, feistel: Feistel, back: bool) -> str | None:
    plain = text.replace(" ", "")
    country, account = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, account) != int(plain[2:4]):
        return None
    account = _masked(account, feistel, "iban", back)
    new = iter(f"{country}{_iban_check(country, account):02d}{account}")
    return "".join(c if c == " " else next(new) for c in text)


def _ip(text: str, feistel: Feistel, back: bool) -> str | None:
    if ":" in text:
        try:
            address = ipaddress.IPv6Address(text)
        except ValueError:
            return None
        if sum(map(bool, text.split(":"))) < 4:  # names of code have two colons too
            return None
        return ipaddress.IPv6Address(feistel.permute(int(address), 1 << 128, "ipv6", back)).compressed
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    x = feistel.permute(int.from_bytes(bytes(octets)), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4)))


def _ssn(text: str, feistel: Feistel, back: bool) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank, serial = divmod(feistel.permute(rank, 898 * 99 * 9999, "ssn", back), 9999)
    area, group = divmod(rank, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, feistel: Feistel, back: bool) -> str | None:
    digits = _digits(text)
    if text[0] == "+":
        code = 1 if digits[0] in _ONE_DIGIT else 2 if digits[:2] in _TWO_DIGITS else 3
    else:
        code = 2 if text[0] == "0" else 0  # a national number keeps its trunk and zone
    if not (8 <= len(digits) <= 15 and digits[0] != "0" if text[0] == "+" else len(digits) == 10):
        return None
    return _refill(text, digits[:code] + _masked(digits[code:], feistel, "phone" + digits[:code] * (text[0] == "0"), back))


def _date(text: str, feistel: Feistel, back: bool) -> str | None:
    a, mark, b, _, c = re.match(r"([0-9]+)([-/.])([0-9]+)([-/.])([0-9]+)", text).groups()
    orders = [(int(a), int(b), int(c))] if len(a) == 4 else [(int(c), int(b), int(a)), (int(c), int(a), int(b))]
    for at, parts in enumerate(orders):
        try:
            day = datetime.date(*parts)
        except ValueError:
            continue
        if day.toordinal() not in _RANK:
            return None
        days = _DAYS[day.day > 12]
        new = datetime.date.fromordinal(days[feistel.permute(_RANK[day.toordinal()], len(days), f"date{day.day > 12}", back)])
        if len(a) == 4:
            return f"{new.year:04d}{mark}{new.month:02d}{mark}{new.day:02d}"
        first, second = (new.day, new.month) if at == 0 else (new.month, new.day)
        return f"{first:02d}{mark}{second:02d}{mark}{new.year:04d}"
    return None


def _email(text: str, feistel: Feistel, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{_masked(local, feistel, 'email', back)}@{domain}"


_PATTERNS: dict[str, tuple[re.Pattern, Callable[[str, Feistel, bool], str | None]]] = {
    "email": (re.compile(r"(?<![^\W_])[^\W_](?:[\w.%+-]{0,63})@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"), _email),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), _iban),
    "ip": (re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])|(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:]|\.[0-9])"), _ip),
    "card": (re.compile(r"(?<![\w+])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?!\w)"), _card),
    "ssn": (re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _ssn),
    "phone": (re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?<![.-])0[1-9](?:[ .-][0-9]{2}){4}(?![.-]?[0-9]))(?!\w)"), _phone),
    "date": (re.compile(r"(?<![\w/.-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![\w/-]|\.[0-9])"), _date),
}
_LOCAL = re.compile(r"[\w.%+-]")
_TRIGGER = re.compile(r"[0-9@]").search


def _emails(text: str) -> Iterator[re.Match]:
    """Matches around each @, found without trying every word of the text."""
    pattern, at, done = _PATTERNS["email"][0], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and at - start < 64 and _LOCAL.match(text[start - 1]):
            start -= 1
        while start < at:
            if found := pattern.match(text, start):
                done = found.end()
                yield found
                break
            start += 1
        at = text.find("@", max(at + 1, done))


def findings(text: str, feistel: Feistel, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, replacement) in ascending order, without overlaps."""
    if not _TRIGGER(text):
        return []
    out: list[tuple[int, int, str, str]] = []
    for kind in KINDS:
        pattern, replace = _PATTERNS[kind]
        starts, more = [f[0] for f in out], []
        for m in _emails(text) if kind == "email" else pattern.finditer(text):
            at = bisect_right(starts, m.start())
            free = (not at or out[at - 1][1] <= m.start()) and (at == len(out) or m.end() <= starts[at])
            if free and (new := replace(m[0], feistel, back)) is not None:
                more.append((m.start(), m.end(), kind, new))
        if more:
            out = sorted(out + more)
    return out


def rewrite(text: str, found: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for start, end, _, new in found:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", counts: bool = True, back: bool = False) -> DataFrame:
    """docs with findings in the text column replaced, and with columns pii_<kind> of counts if asked for, which replace columns of their names.

    back: undoes it, given the key.
    """
    names = [f"pii_{k}" for k in KINDS] if counts else []

    def start():
        feistel = Feistel(key)

        def run(column: pa.Array) -> dict:
            texts, found = [], []
            for x in column:
                raw = x.as_py()
                own = findings(raw, feistel, back) if raw else []
                texts.append(rewrite(raw, own) if own else raw)
                found.append(own)
            return {text: pa.array(texts, pa.string())} | {n: pa.array([sum(f[2] == n[4:] for f in own) for own in found], pa.int32()) for n in names}

        return run

    return _io.beside(docs, text, start, {text: "string"} | dict.fromkeys(names, "int"), [*(c for c in docs.columns if c not in names), *names])


def op2_pii(spark, sf_dir: str, key: bytes = DEMO_KEY) -> DataFrame:
    return pseudonymise(_io.table(spark, sf_dir, "documents").select("doc_id", "text"), key)
