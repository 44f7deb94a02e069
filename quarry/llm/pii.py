"""Format-preserving pseudonyms.

Validated values (card numbers with a right check digit, IBANs, phone and social
security numbers, IPv4 addresses, calendar dates, mail addresses and quoted hex secrets)
are replaced by others of the same format: the value's index in its format's domain goes
through a keyed Feistel permutation. Equal values get equal pseudonyms in every
document, different ones differ, and who has the key can go back. Punctuation, letter
case, country codes and check digits' validity stay.

Formats are sought one after the other, each where the ones before left the text. Where
digit groups stand side by side, every span of them that has a card's length is tried:
usual layouts first, then, after the other formats, any span, longest first. A pseudonym
beside other digits can by chance (one in ten for each overlapping span) make a likelier
span valid; then going back reads that one.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect_left, insort
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import arrays as A

#: For tests and trials; a production run passes a secret of its own.
TRIAL_KEY = b"trial key, not a secret"
ROUNDS = 8
#: Characters of a mail address's local part that are permuted as one number: as many as mail allows.
LOCAL_CHARS = 64
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


def feistel(x: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """Keyed permutation of 0..size-1: a Feistel network on pairs (left, right) of the least
    square-like grid that holds the domain, repeated while the image is outside."""
    if size < 2:
        return x
    a = isqrt(size - 1) + 1
    b = -(-size // a)

    def f(i: int, value: int, modulus: int) -> int:
        digest = hashlib.blake2b(b"%d:%d:%d" % (size, i, value), key=key[:64], person=kind.encode()[:16],
                                 digest_size=16).digest()
        return int.from_bytes(digest, "little") % modulus

    while True:
        left, right = divmod(x, b)
        for i in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * f(i, left, b)) % b
            else:
                left = (left + sign * f(i, right, a)) % a
        x = left * b + right
        if x < size:
            return x


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """Digits of ``shape`` replaced in order; everything else stays."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _card(s, key, back):
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = str(feistel(int(d[:-1]), 10 ** (len(d) - 1), key, "card", back)).zfill(len(d) - 1)
    return _refill(s, body + luhn_digit(body))


def _phone(s, key, back):
    head = re.match(r"\+\d{1,3}(?=\D)", s)
    cut = head.end() if head else (1 if s[0] == "+" else 0)
    d = _digits(s[cut:])
    if not 7 <= len(d) <= 14:
        return None
    return s[:cut] + _refill(s[cut:], str(feistel(int(d), 10 ** len(d), key, "phone", back)).zfill(len(d)))


def _social(s, key, back):
    area, group, serial = (int(x) for x in s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    i = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    i, serial = divmod(feistel(i, 898 * 99 * 9999, key, "social", back), 9999)
    area, group = divmod(i, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _address(s, key, back):
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255:
        return None
    x = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _alphabet(c: str) -> str:
    for letters in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in letters:
            return letters
    return c


def _by_class(s: str, key: bytes, kind: str, back: bool) -> str:
    """Digits, small and capital letters permuted as one mixed-radix number."""
    x, size = 0, 1
    for c in s:
        letters = _alphabet(c)
        x, size = x * len(letters) + letters.index(c), size * len(letters)
    x = feistel(x, size, key, kind, back)
    out = []
    for c in reversed(s):
        letters = _alphabet(c)
        x, i = divmod(x, len(letters))
        out.append(letters[i])
    return "".join(reversed(out))


def _mail(s, key, back):
    local, _, domain = s.partition("@")
    pieces = [_by_class(local[i:i + LOCAL_CHARS], key, f"mail{i or ''}", back) for i in range(0, len(local), LOCAL_CHARS)]
    return f"{''.join(pieces)}@{domain}"


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(s, key, back):
    plain = s.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(body) <= 30 or _iban_check(country, body) != int(check):
        return None
    body = _by_class(body, key, "iban", back)
    it = iter(f"{country}{_iban_check(country, body):02d}{body}")
    return "".join(c if c == " " else next(it) for c in s)


def _hex(s, key, back):
    x = feistel(int(s, 16), 16 ** len(s), key, "hex", back)
    out = f"{x:0{len(s)}x}"
    return out.upper() if s.upper() == s else out


def _date(s, key, back):
    sep = next(c for c in s if not c.isdigit())
    parts = s.split(sep)
    order = "ymd" if len(parts[0]) == 4 else "mdy" if sep == "/" else "dmy"
    fields = dict(zip(order, map(int, parts)))
    if sep == "/" and order == "mdy" and fields["m"] > 12:
        order, fields = "dmy", dict(zip("dmy", map(int, parts)))
    try:
        day = dt.date(fields["y"], fields["m"], fields["d"])
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    # the three readings of a date are domains of their own; a day over 12 marks day-first dates
    days = _days(order, sep)
    at = days.index(day) if order != "ymd" else (day - FIRST_DAY).days
    day = days[feistel(at, len(days), key, "date" + order, back)]
    shown = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
    return sep.join(shown[c] for c in order)


class _Days(list):
    def __init__(self, days):
        super().__init__(days)
        self.at = {d: i for i, d in enumerate(days)}

    def index(self, day):
        return self.at[day]


@lru_cache(maxsize=None)
def _days(order: str, sep: str) -> "_Days":
    """Days a format can stand for: with slashes, day-first is only read where the day is
    over 12, so its pseudonyms are too."""
    n = (LAST_DAY - FIRST_DAY).days + 1
    every = [FIRST_DAY + dt.timedelta(i) for i in range(n)]
    return _Days([d for d in every if d.day > 12] if order == "dmy" and sep == "/" else every)


# fixed values: the formats
_KINDS = [
    ("mail", r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _mail),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}(?!\w)){2,7}(?: [A-Z0-9]{1,4})?)(?!\w)", _iban),
    ("date", r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)", _date),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _address),
    ("social", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _social),
    ("card", r"(?<![\w.-])\d+(?!\w)(?:[ -]\d+(?!\w))*", _card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w])"
              r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\w])"
              r"|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])", _phone),
    ("other card", r"(?<![\w.-])\d+(?!\w)(?:[ -]\d+(?!\w))*", _card),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])", _hex),
]
_FORMATS = [(name, re.compile(pattern), make) for name, pattern, make in _KINDS]
#: How cards are printed, besides in one group.
_LAYOUTS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))
_GROUP = re.compile(r"\d+")
#: Characters of an IBAN by country: the likeliest end where groups follow.
_IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 "
    "MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 VG24 XK20").split()}


def _card_spans(text: str, start: int, end: int, usual: bool) -> list[tuple[int, int]]:
    """Spans of 13 to 19 digits between borders of the run's digit groups."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    if text[end:end + 1] == "-":  # what follows belongs to the last group
        groups.pop()
    found = []
    for i in range(len(groups)):
        n, sizes = 0, []
        for a, b in groups[i:]:
            n += b - a
            sizes.append(b - a)
            if n > 19:
                break
            if n >= 13:
                rank = 0 if len(sizes) == 1 else 1 + _LAYOUTS.index(tuple(sizes)) if tuple(sizes) in _LAYOUTS else -n
                if (rank >= 0) == usual:
                    found.append((rank, groups[i][0], b))
    return [(a, b) for _, a, b in sorted(found)]


def _spans(name: str, m: re.Match) -> list[tuple[int, int]]:
    """Where values of a format may stand in a match, likeliest first."""
    if name in ("card", "other card"):
        return _card_spans(m.string, m.start(), m.end(), name == "card")
    if name == "iban" and " " in m.group():
        ends = [m.start() + i for i in range(len(m.group()), 0, -1) if m.group()[i:i + 1] in ("", " ")]
        wanted = _IBAN_LENGTHS.get(m.group()[:2])
        size = lambda end: end - m.start() - m.string.count(" ", m.start(), end)
        return [(m.start(), end) for end in sorted(ends, key=lambda end: size(end) != wanted)]
    return [m.span()]


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, int]:
    """The text with every validated value replaced, and how many there were."""
    # pieces of text not taken so far are searched with their surroundings
    done: list[tuple[int, int, str]] = []
    for name, pattern, make in _FORMATS:
        at, found = 0, []
        taken = sorted(done)
        while m := pattern.search(text, at):
            here = []
            for a, b in _spans(name, m):
                if not _meets(taken, a, b) and not _meets(here, a, b):
                    new = make(text[a:b], key, back)
                    if new is not None:
                        insort(here, (a, b, new))
                        if name == "iban":
                            break
            found += here
            at = m.end() if here or name in ("card", "other card") else m.start() + 1
            if name == "iban" and here:
                at = here[0][1]
        done += found
    out, at = [], 0
    for a, b, new in sorted(done):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), len(done)


def _meets(taken: list[tuple[int, int, str]], a: int, b: int) -> bool:
    """Whether one of the sorted, separate spans has characters of a..b."""
    i = bisect_left(taken, (b,)) - 1
    return i >= 0 and taken[i][1] > a


_HINT = re.compile(r"[0-9@]|[A-Fa-f]{32}")


def pseudonyms(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with all columns and ``text`` replaced; ``count`` names a further column
    with the number of values replaced (refused if the table has it).

    Null texts stay null (count 0), empty ones empty; a value is treated alike wherever
    it stands, repeated rows and very long texts included; an empty table stays empty;
    other columns are carried along unread. ``key`` is a secret of the caller. A mail
    address's local part of more than ``LOCAL_CHARS`` characters is permuted piece by piece.
    """
    if count is not None and count in docs.columns:
        raise ValueError(f"the table has a column {count}")
    place = docs.columns.index(text)
    schema = docs.schema if count is None else docs.select("*", F.lit(0).cast("bigint").alias(count)).schema

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            done = [(s, 0) if s is None or not _HINT.search(s) else pseudonymise(s, key) for s in texts]
            columns = list(batch.columns)
            columns[place] = pa.array([d[0] for d in done], batch.column(place).type)
            names = list(batch.schema.names)
            if count is not None:
                columns.append(pa.array([d[1] for d in done], pa.int64()))
                names.append(count)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(A.tidy(run), schema)
